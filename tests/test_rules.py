"""Banks, members, outcomes and health letters by hand: edges, ties, nulls and empty texts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from verifold.functions import ids
from verifold.functions import text as T
from verifold.operators import banks, health, logs, outcomes, participants, search
from verifold.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "text, name",
    [("ANNISA", True), ("Budi Santoso", True), ("budi", False), ("Kewarganegaraan WNI", False), ("kota bekasi", False), ("tempattol", False), ("12-03-1990 x", False), ("", False), (None, False)],
)
def test_looks_like_name(spark, text, name):
    assert one(spark, T.looks_like_name(F.lit(text).cast("string")))[0] is name


def test_names_and_lines(spark):
    refined = one(spark, T.refined_names(F.lit("Selamat siang, usep maulidin!")), T.refined_names(F.lit(None).cast("string")))
    assert refined == (["usep maulidin"], [])
    assert one(spark, T.is_cv_name_line(F.lit("- Siti Aminah")), T.is_cv_name_line(F.lit("PT Maju Jaya")), T.is_cv_name_line(F.lit(None).cast("string"))) == (True, False, False)
    assert one(spark, T.is_trailing_name(F.lit("Maulidin"), F.lit("Usep Maulidin")), T.is_trailing_name(F.lit("Usep"), F.lit("Usep Maulidin"))) == (True, False)
    merged = one(spark, participants.merged_capitals(F.split(F.lit("ACHMAD SAEFUL\nRHOMADHONI\nsiti\nBUDI"), "\n")), participants.beside_numbers(F.lit("BUDI\n1234567890123456\nANI\nX1")))
    assert merged == (["ACHMAD SAEFUL RHOMADHONI", "siti", "BUDI"], ["BUDI", "ANI"])


def test_numbers(spark):
    assert one(spark, ids.member_ids(F.lit("No. 1234567890123456\n3201 2345 6789 0002\n1234567890123456")))[0] == ["3201234567890002"]
    assert one(spark, ids.birthdate_in(F.lit("tgl 12-07-90"), F.lit("3201125207900001")), ids.birthdate_in(F.lit("tgl 13-07-90"), F.lit("3201125207900001"))) == ("12-07-1990", None)
    assert one(spark, ids.birthdate_in(F.lit("12-07-90"), F.lit("12")))[0] is None
    shown = one(spark, ids.account_check(F.lit("rek 100 1234 567"), F.lit("1234567890")), ids.account_check(F.lit("x"), F.lit("12")))
    assert (shown[0]["account_pass"], shown[0]["method"], shown[1]["account_pass"]) == (True, "placeholder_visible_account", None)
    assert one(spark, ids.family_rows(F.lit("| 1 | BUDI | 3201234567890002 |\n| 2 | ANI | 3201234567890003 |")))[0][1]["name"] == "ANI"


def test_banks(spark):
    texts = ["Livin by Mandiri rekening 1250 0123 45678", "transfer dari bank mas 1001234567 ke 1250012345678", "MAS Saving 1001234567", "bakn mandlri", "bank mandiri, mas saving", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    got = dict(banks.scores(rows, "text").select("n", banks.decide()).collect())
    assert [got[i] for i in range(len(texts))] == ["mandiri", "mandiri", "mas", "mandiri", None, None, None]
    assert banks.scores(rows.limit(0), "text").count() == 0


def test_members(spark):
    text = "Nama Peserta: BUDI SANTOSO (AKTIF)\nFaskes\nKLINIK X\nSITI\nAMINAH\nTIDAK AKTIF\nAP*** SU****\naktif"
    cases = [("Siti Aminah", "SITI AMINAH", "tidak_aktif"), ("Apri Sundari", "AP*** SU****", "aktif"), ("Joko Widodo", None, None), (None, None, "aktif")]
    rows = spark.createDataFrame([(i, text, c[0]) for i, c in enumerate(cases)] + [(9, None, "x"), (10, "", None)], "n int, text string, name string")
    got = {r["n"]: r for r in participants.status(rows, "text", "name").collect()}
    for i, (_, name, status) in enumerate(cases):
        assert ((got[i]["member"] or {"name": None})["name"], got[i]["member_status"]) == (name, status)
    assert (got[9]["members"], got[9]["member_status"], got[10]["members"]) == ([], None, [])
    lines = spark.createDataFrame([(1, "Curriculum Vitae\nBUDI SANTOSO\n- Siti Aminah\nPT Maju")], "n int, text string")
    assert [tuple(r) for r in participants.cv_headers(lines, "text", "n").orderBy("position").collect()] == [(1, 1, "BUDI SANTOSO", 39.0), (1, 2, "Siti Aminah", 28.0)]


def test_health_letters(spark):
    rows = spark.createDataFrame(
        [
            (1, "Lahir 12-03-1990 ... Bekasi, 66/11/226 dinyatakan SEHAT berlaku 2 (dua) minggu. Demikian surat, Bekasi 15 juri 2026 dokter"),
            (2, "tidak sehat sampai dengan 30 juni 2026"), (3, "Sehat / Tidak Sehat"), (4, None), (5, ""), (6, "sehat, sip 12/03/2026"),
        ],
        "n int, text string",
    )
    got = {r["n"]: (r["health_pass"], r["expiry_pass"], r["checked_on"], r["valid_until"]) for r in health.gate(rows, "text").collect()}
    assert got[1] == (True, True, date(2026, 6, 15), date(2026, 6, 29))
    assert got[2] == (False, True, None, date(2026, 6, 30))
    assert got[3] == (True, True, None, None) and got[4] == got[5] == (False, True, None, None)
    assert got[6] == (True, True, None, None)
    assert one(spark, health.mended_day(F.lit(66)), health.mended_day(F.lit(41)), health.mended_year(F.lit("226")), health.mended_year(F.lit("1999"))) == (6, None, 2026, None)
    null = F.lit(None).cast("string")
    assert one(spark, health.iso_day(F.lit("2024-02-30")), health.iso_day(F.lit("2024-02-29T1")), health.iso_day(null)) == (None, date(2024, 2, 29), None)
    v = one(spark, health.resolved_validity(F.lit("1 Maret 2024"), F.lit(""), F.lit("sampai dengan 1-2-2024"), null, F.lit("2023-01-01")))[0]
    assert (v["from"], v["until"]) == (date(2024, 2, 1), date(2024, 3, 1))


def test_outcomes(spark):
    raw = spark.createDataFrame([(1, '{"holder_name":"N/A","document_type_label":"Kartu  Keluarga"}'), (2, "x"), (3, '{"holder_name":" Budi "}'), (4, None)], "n int, raw string")
    got = {r["n"]: r["a"] for r in raw.select("n", outcomes.annotation(F.col("raw")).alias("a")).collect()}
    assert (got[1]["holder_name"], got[2], got[3]["holder_name"], got[4]) == (None, None, "Budi", None)
    b = outcomes.boosts(F.lit("ktp"), F.lit("NIK 1234567890123456 WNI lahir"), F.lit("ktp"))
    assert one(spark, b, outcomes.boosted(F.lit(0.5), b), outcomes.boosted(F.lit(0.95), b)) == ({"structural": 0.12, "document_type_label": 0.1}, 0.65, 1.0)
    assert one(spark, F.size(outcomes.boosts(F.lit("odd"), F.lit(None).cast("string"), F.lit(None).cast("string"))))[0] == 0
    docs = spark.createDataFrame([(1, "halo\nBUDI SANTOSO\nsaldo", "Budi Santoso"), (2, None, "Budi"), (3, "Budi Santoso", "Budi Santoso")], "n int, text string, name string")
    assert {tuple(r) for r in outcomes.compare_names(docs, "text", "name", "n").select("n", "score", "matched").collect()} == {(1, 100.0, True), (2, 0.0, False), (3, 100.0, True)}
    logged = outcomes.log_row(spark.createDataFrame([(1, True, list(map(str, range(50))))], "n int, type_pass boolean, keywords array<string>"), "n").first()
    assert logged.asDict().keys() == {"n", "type_pass", "keywords"} and len(logged["keywords"]) == 40


def test_sections_logs_and_vectors(spark, tmp_path):
    assert one(spark, search.section_kind(F.lit("")), search.section_kind(F.lit("Riwayat Pekerjaan > PT X")), search.section_kind(F.lit("Hobi"))) == ("nama", "pengalaman", "other")
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], "doc_id int, n int, content string")
    vectors = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0), (2, 1, 4.0), (4, 0, 5.0)], "doc_id int, n int, vector double")
    got = {(r["doc_id"], r["n"], r["error"]) for r in files.chunk_vectors(chunks, vectors).collect()}
    assert got == {(1, 0, None), (1, 1, None), (2, None, "1 chunks, 2 vectors"), (3, None, "1 chunks, 0 vectors"), (4, None, "0 chunks, 1 vectors")}
    path = str(tmp_path / "log")
    logs.append(spark.createDataFrame([("a",), ("b",)], "event string"), path)
    assert logs.clear(spark, path, str(tmp_path / "stamps")) == 2
    assert spark.read.schema("event string").json(path).count() == 0 and spark.read.json(str(tmp_path / "stamps")).first()["rows"] == 2
    listing = spark.createDataFrame([("b", "x.png"), ("a", "x.png")], "folder string, file string")
    assert [r["folder"] for r in logs.folders(spark.createDataFrame([("x.png",), ("y.png",)], "file string"), listing).orderBy("file").collect()] == ["a", None]


def test_sql_functions(spark):
    from verifold.plans.register import register

    assert len(register(spark)) == len(set(register(spark))) == 14
    row = spark.sql(
        "SELECT normalize_text('  A \t b\n') AS n, digits_only('a1-2') AS d, compact_text('A-b 1') AS c, fold_letters('O1l') AS l, expiry_state(DATE'2024-01-01', NULL, DATE'2024-01-02') AS e,"
        " identity('budi santoso', 'Budi Santoso').score AS s, letter_dates('bekasi 15 juni 2026 dokter').checked AS day, size(members_of(array('BUDI SANTOSO', 'aktif'))) AS m"
    ).first()
    assert tuple(row) == ("a b", "12", "ab1", "011", "missing", 100.0, date(2026, 6, 15), 1)
    assert spark.sql("SELECT normalize_text(NULL) AS n").first()["n"] is None
