import json
import random
import re

from pyspark.sql import functions as F

from verifold.functions import fuzzy
from verifold.operators import evaluation, gates, keywords, logs, search
from verifold.plans import queries
from verifold.plans.profiles import alias_table, keyword_table
from verifold.streaming import log_stream


def best_by_hand(text, kw, kind="flat"):
    """The best of the metrics over everything that a keyword is looked for in."""
    norm = " ".join(text.lower().split())
    if kw in norm:
        return 100.0
    parts = [" ".join(p.lower().split()) for p in re.split(r"[|\n•·]", text)]
    parts = [p for p in parts if p]
    places = [norm, *parts, *map(" ".join, zip(parts, parts[1:])), *map(" ".join, zip(parts, parts[1:], parts[2:])), norm.replace(" ", "")]
    if " " not in kw and len(kw) <= 12 and any(kw in p.replace(" ", "") for p in places):
        return 100.0
    metrics = [fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio] + ([fuzzy.wratio] if kind != "excluded" else [])
    return max((m(p, kw) for p in places if p for m in metrics), default=0.0)


def test_gates(spark):
    def one(profile, extraction, **expected):
        row = {"expected_name": "", "expected_nik": "", "expected_bank": "", "expected_account": ""} | expected
        frame = spark.createDataFrame([(*row.values(), json.dumps(extraction))], ", ".join(f"{k} string" for k in [*row, "extraction"]))
        return gates.decide(frame, gates.GATES[profile], {"140": "mandiri"}).first()

    ok = one("ktp", {"is_ktp": "ya", "holder_name": "BUDI CONTOH", "nik": "3200000000000001"}, expected_name="Budi Contoh")
    assert ok.document_matched and ok.identity_pass and ok.id_pass is None
    by_id = one("ktp", {"is_ktp": 1, "holder_name": "X", "nik": 3200000000000001}, expected_name="Budi Contoh", expected_nik="3200000000000001")
    assert by_id.document_matched and not by_id.name_pass
    assert one("ijasah", {"is_ijasah": True}).identity_pass is None
    assert one("ijasah", {"is_ijasah": False}, expected_name="Budi Contoh").blockers == ["DOCUMENT_TYPE", "IDENTITY"]
    bank = one("mutasi", {"is_mutation": True, "account_number": "1401234567"}, expected_bank="Mandiri", expected_account="1401234567")
    assert bank.document_matched and bank.account_method == "exact" and bank.detected_bank == "mandiri"
    assert one("mutasi", {"is_mutation": True}, expected_bank="mandiri").blockers == ["BANK", "ACCOUNT"]
    assert one("mutasi", {}).type_pass is False


def test_errors_and_marital(spark):
    rows = spark.createDataFrame([(1, "Helper", "BELUM KAWIN"), (2, "helper gudang", "KAWIN"), (3, "driver", "KAWIN"), (4, "helper", None)], "i int, job string, status string")
    got = {r.i: r.marital_pass for r in gates.marital_gate(rows, "job", "status").collect()}
    assert got == {1: True, 2: False, 3: None, 4: False}
    bad = rows.withColumn("document_matched", F.col("i") == 1)
    out = {r.i: r.error_cases for r in gates.error_codes(bad, [("a", F.col("i") > 2), ("b", F.col("i") == 3)]).collect()}
    assert out == {1: [], 2: ["generic.validation_failed"], 3: ["a", "b"], 4: ["a"]}


def test_members(spark):
    rows = [(1, "Budi Contoh", "3200000000000001", json.dumps({"members": [{"name": "Siti", "nik": "1"}, {"name": "BUDI CONTOH", "nik": ""}]})), (2, "Budi", "", "{}")]
    got = {r.doc_id: r.member_pass for r in gates.members(spark.createDataFrame(rows, "doc_id int, expected_name string, expected_nik string, extraction string")).collect()}
    assert got == {1: True, 2: False}


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "Nomor Rekening\nsaldo mutasi"), (2, "nomor  rekening | saldo"), (3, None)], "doc_id int, text string")
    table = keyword_table(spark, {"rekening": {"flat": ["nomor rekening", "saldo"], "excluded": ["mutasi"]}, "other": {"any": [["saldo"], ["nomor", "kode"]]}})
    per = keywords.type_gate(keywords.profiles(keywords.score(docs, table)))
    got = {(r.doc_id, r.profile): r.type_pass for r in per.collect()}
    assert got == {(1, "rekening"): False, (1, "other"): True, (2, "rekening"): True, (2, "other"): True, (3, "rekening"): False, (3, "other"): False}
    best = {r.doc_id: r.profile for r in keywords.detect(per).collect()}
    assert best[2] == "rekening" and best[1] == "other"
    fuzzy = keywords.score(docs.where("doc_id = 2"), keyword_table(spark, {"p": {"flat": ["nomer rekening"]}}), fuzzy=True).first()
    assert 85 < fuzzy.score < 100 and fuzzy.hit
    names = keywords.resolve_profile(spark.createDataFrame([(" KTP ",), ("surat skck",), ("bpjs  TK",), ("x",)], "t string"), "t", alias_table(spark, {"surat skck": "skck"}), ["ktp", "bpjs_tk"])
    assert [r.profile for r in names.collect()] == ["ktp", "skck", "bpjs_tk", None]


def test_keyword_scores_fuzzy_of_all_documents(spark, tmp_path):
    texts = ["all of us togethre\nagain", "no thing other | x", None, "together", "quite apart", "nothing othr"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.kw): (r.score, r.hit) for r in queries.Q["keyword_scores_fuzzy"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, kw) for i in range(len(texts)) for kw in ("together", "nothing other")}
    for (i, kw), (score, hit) in got.items():
        want = best_by_hand(texts[i] or "", kw)
        assert abs(score - want) < 1e-9 and hit == (want >= 70), (i, kw)


def test_keywords_over_line_ends(spark):
    rng = random.Random(4)
    letters = "abeghnort  ||\n"
    texts = ["x noth1ng\n0ther y", "t o g e t h e r", "toge | ther", "tog\n\neth • er", "other | things and nothing", "r", "é together".replace("g", "q")]
    texts += ["".join(rng.choice(letters) for _ in range(rng.choice((3, 9, 14, 40, 150)))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = keyword_table(spark, {"p": {"flat": ["together", "nothing other", "the there the"], "excluded": ["together", "other nothing"]}})
    got = keywords.score(docs, table, fuzzy=True).collect()
    assert len(got) == 5 * len(texts)
    for r in got:
        assert abs(r.score - best_by_hand(texts[r.doc_id], r.kw, r.kind)) < 1e-9, (texts[r.doc_id], r)
    assert {r.doc_id: r.score for r in got if r.kw == "together"}[1] == 100


def test_names_of_other_first_words_meet(spark, tmp_path):
    names = ["green bolt", "gren bolt", "bolt green", "red nut"]
    spark.createDataFrame([(n,) for n in [*names, "red nut"]], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.a, r.b): r for r in queries.Q["name_metrics"](spark, str(tmp_path)).collect()}
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    assert all(abs(r.token_sort_ratio - fuzzy.token_sort_ratio(a, b)) < 1e-9 and abs(r.wratio - fuzzy.wratio(a, b)) < 1e-9 for (a, b), r in got.items())
    assert got["bolt green", "green bolt"].token_sort_ratio == 100
    ratios = {(r.a, r.b): r.ratio for r in queries.Q["name_ratio_all_pairs"](spark, str(tmp_path)).collect()}
    assert ratios == {(a, b): round(fuzzy.ratio(a, b), 6) for a in names for b in names if a != b}


def test_evaluation(spark):
    good, bad = evaluation.explicit_refs(spark.createDataFrame([(1, "A/x.jpg"), (2, "a/X.JPG"), (3, "../x"), (4, "y.pdf")], "pos int, ref string"))
    assert [(r.pos, r.folder, r.file) for r in good.orderBy("pos").collect()] == [(1, "A", "x.jpg"), (4, None, "y.pdf")]
    assert [r.error for r in bad.collect()] == ["traversal"]
    f = spark.range(1).select(evaluation.filename_fields(F.lit("ktp_Budi_Contoh_3200000000000001.jpg")).alias("f")).first().f
    assert (f.folder, f.person, f.kind) == ("ktp", "Budi Contoh", "id")
    empty = evaluation.statistics(spark.createDataFrame([], "folder string, ok boolean, matched boolean"), ["folder"])
    assert empty.count() == 0


def test_search(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\n# C\nz"), (2, ""), (3, None)], "doc_id int, text string")
    got = {(r.doc_id, r.section): (r.path, r.content) for r in search.markdown_sections(docs).collect()}
    assert got[1, 0] == ([], "intro") and got[1, 2] == (["A", "B"], "y") and got[1, 3] == (["C"], "z") and got[2, 0] == ([], "")
    assert search.pack("a" * 10 + "\n\n" + "b" * 5, 12) == ["a" * 10, "b" * 5] and search.pack("a" * 30, 12) == ["a" * 12, "a" * 12, "a" * 6] and search.pack("") == []
    m = search.match_dimensions(spark.createDataFrame([(1, "Sarjana Teknik, UI")], "doc_id int, text string"), {"education": ("sarjana teknik", 65), "none": ("", 1)}).first()
    assert m.matched and m.overall == 100


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(f"{n}-{i}", f"2024-01-01 0{n}:00:0{i}", "click") for i in range(4)], "id string, logged_at string, document_type string").coalesce(1).write.mode("append").json(src)
    stream = log_stream.read(spark, src, "id string, logged_at timestamp, document_type string", 1)
    log_stream.ring(stream, 5, str(tmp_path / "ring"), str(tmp_path / "cp")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "ring/ring-2"))
    assert last.count() == 5 and {r.id[0] for r in last.collect()} <= {"0", "1", "2"}
    log_stream.validate(stream, lambda rows: rows.withColumn("ok", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_logs(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int")
    assert sorted(r.k for r in logs.upsert(old, new, "k", "v").collect()) == ["a", "b", "c"]
    assert [r.k for r in logs.delete(old, "k", ["a"]).collect()] == ["b"]
    assert logs.newest(old, 0, order=("v", "k")).count() == 0


def test_upsert_takes_the_first_stored_of_equal_versions(spark, tmp_path):
    """The rows of the SQL where versions tie across files of unequal size, and where versions or values are null."""
    import duckdb

    lines = tmp_path / "lineitem.parquet"
    lines.mkdir()
    sql = duckdb.connect(config={"threads": 1})
    for name, rows in (("a", "SELECT i AS k, 5 AS n, i AS p FROM range(10) t(i)"), ("b", "SELECT i % 1000 AS k, 5 - i // 1000 % 2 AS n, i + 100 AS p FROM range(60000) t(i)"), ("c", "SELECT * FROM (VALUES (2000, NULL, 1), (2001, 1, 7), (2001, 4, NULL), (NULL, 2, 3))")):
        sql.execute(f"COPY (SELECT k::BIGINT AS l_orderkey, n::INT AS l_linenumber, p::BIGINT AS l_partkey FROM ({rows}) t(k, n, p)) TO '{lines}/{name}.parquet'")
    sql.execute(f"CREATE VIEW lineitem AS FROM '{lines}/*.parquet'")
    got = sorted(map(tuple, queries.Q["upsert_latest"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "l_partkey").collect()), key=repr)
    assert got == sorted(sql.sql(queries.SQL["upsert_latest"]).fetchall(), key=repr)
