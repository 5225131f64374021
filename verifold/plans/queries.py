"""Registered queries of the document-validation operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, fuzzy, ids, names
from ..functions import text as T
from ..operators import evaluation, extract, gates, keywords, logs, search
from .profiles import keyword_table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The day on which validity is judged.
AS_OF = "1998-01-01"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def results(spark: SparkSession, d: str) -> DataFrame:
    """The events as evaluation results: type the folder, errors failed runs, purchases matched."""
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("folder"), (F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 3 == 0).alias("matched"), F.col("value").alias("validation"), "user_id", "event_id", "ts")


STATS_SQL = """
SELECT *, CASE WHEN total > 0 THEN round(validation_pass / total, 4) ELSE 0.0 END AS success_ratio,
 CASE WHEN total > 0 THEN round(validation_fail / total, 4) ELSE 0.0 END AS failure_ratio,
 CASE WHEN total > 0 THEN round(pipeline_error / total, 4) ELSE 0.0 END AS error_ratio FROM (
 SELECT {group} count(*) AS total, count(*) FILTER (event_type <> 'error' AND user_id % 3 = 0) AS validation_pass,
  count(*) FILTER (event_type <> 'error' AND user_id % 3 <> 0) AS validation_fail, count(*) FILTER (event_type = 'error') AS pipeline_error
 FROM events {by})"""


@query(STATS_SQL.format(group="event_type AS folder,", by="GROUP BY event_type"))
def bench_summary_by_folder(spark, d):
    return evaluation.statistics(results(spark, d), ["folder"])


@query(STATS_SQL.format(group="coalesce(event_type, '(all)') AS folder,", by="GROUP BY ROLLUP (event_type)"))
def bench_summary_rollup(spark, d):
    r = results(spark, d)
    ok, m = F.col("ok"), F.col("matched")
    counts = r.rollup("folder").agg(F.count("*").alias("total"), F.count_if(ok & m).alias("validation_pass"), F.count_if(ok & ~m).alias("validation_fail"), F.count_if(~ok).alias("pipeline_error"))
    return evaluation.ratios(counts.withColumn("folder", F.coalesce("folder", F.lit("(all)"))))


@query("SELECT event_type AS folder, count(value) AS n, round(avg(value) * 1000) AS mean_milli FROM events GROUP BY 1")
def bench_timing_means(spark, d):
    return results(spark, d).groupBy("folder").agg(F.count("validation").alias("n"), F.round(F.avg("validation") * 1000).alias("mean_milli"))


@query("SELECT source AS folder, count(*) AS n_files FROM documents GROUP BY 1")
def dataset_folders(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("folder"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"))
    return evaluation.folders(files)


@query("SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place BETWEEN 6 AND 15")
def file_page_per_folder(spark, d):
    return evaluation.page(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 10, 5).select("source", "doc_id", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS index, count(*) OVER () AS total FROM events")
def bench_progress(spark, d):
    return evaluation.progress(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 8).select("event_id", "index", "total")


@query("SELECT min(pos) AS pos, arg_min(ref, pos) AS ref FROM (SELECT doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN lang || '/' || source ELSE upper(lang) || '/' || source END AS ref FROM documents) GROUP BY lower(ref)")
def explicit_ref_dedupe(spark, d):
    docs = table(spark, d, "documents")
    name = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.upper("lang"))
    good, _ = evaluation.explicit_refs(docs.select(F.col("doc_id").alias("pos"), F.concat_ws("/", name, "source").alias("ref")))
    return good.select("pos", "ref")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10")
def log_newest_first_page(spark, d):
    return logs.newest(table(spark, d, "events"), 50, 10, ("ts", "event_id"), where=F.col("event_type") == "click").select("event_id", "event_type")


@query("SELECT event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500 OFFSET 0) WHERE event_type = 'click'")
def log_page_then_filter(spark, d):
    return logs.newest(table(spark, d, "events"), 500, 0, ("ts", "event_id"), where=F.col("event_type") == "click", compat=True).select("event_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def log_ring_trim(spark, d):
    return logs.ring(table(spark, d, "events"), 100, ("ts", "event_id")).select("event_id", "ts")


@query("SELECT coalesce(nullif(trim(event_type), ''), 'lainnya') AS document_type, count(*) AS n FROM events GROUP BY 1")
def log_stats_by_type(spark, d):
    return logs.by_type(table(spark, d, "events"), "event_type")


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS large FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000)")
def log_outcome_counts(spark, d):
    return logs.outcome_counts(table(spark, d, "events"), 2000, ("ts", "event_id"), errors=F.col("event_type") == "error", large=F.col("value") > 50)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def log_left_anti_orphans(spark, d):
    return logs.orphans(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT l_orderkey, arg_max(l_linenumber, l_linenumber) AS l_linenumber, arg_max(l_partkey, l_linenumber) AS l_partkey FROM lineitem GROUP BY 1")
def upsert_latest(spark, d):
    # Of equal line numbers arg_max takes the first as stored, and it passes over nulls.
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    late = F.coalesce(F.col("l_linenumber") >= 3, F.lit(False))
    return logs.upsert(rows.where(~late), rows.where(late), "l_orderkey", "l_linenumber", ("file", "place"), fill=True)


@query("SELECT s.s_suppkey, coalesce(n.n_name, r.r_name) AS value FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON s.s_suppkey % 7 = r.r_regionkey")
def manifest_two_stage_lookup(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key_1"), (F.col("s_suppkey") % 7).cast("int").alias("key_2"))
    first = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    second = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return evaluation.two_stage_lookup(rows, first, second).select("s_suppkey", "value")


@query("SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1) ON o_orderkey = l_orderkey")
def seed_last_wins_join(spark, d):
    last = evaluation.last_wins(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], [F.desc("l_linenumber"), F.desc("l_partkey")])
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "l_linenumber", "l_partkey")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS normal_sha FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("normal_sha"))


@query(r"SELECT p_partkey, list_aggregate(list_sort(list_filter(string_split(trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')), ' '), lambda t: t <> '')), 'string_agg', ' ') AS sorted_name FROM part")
def token_sort(spark, d):
    return table(spark, d, "part").select("p_partkey", T.sorted_tokens(F.col("p_name")).alias("sorted_name"))


@query("SELECT p_partkey, translate(lower(p_name), '01234568', 'oizeasgb') AS folded, translate(p_brand, 'OoQDIilLZzSsBbGg', '0000111122558866') AS digits FROM part")
def ocr_fold(spark, d):
    return table(spark, d, "part").select("p_partkey", T.fold_digits(F.lower("p_name")).alias("folded"), T.fold_letters(F.col("p_brand")).alias("digits"))


@query(r"""SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<br\s*/?>|</(p|div|tr|li|h[1-6]|table)>', chr(10), 'gi'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' '))::BIGINT AS n FROM pages""")
def html_flatten(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.flatten_html(F.col("html"))).cast("long").alias("n"))


@query("SELECT doc_id, x AS id FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'), lambda n: length(n) = 16))) AS x FROM documents)")
def id16_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(ids.cards(F.col("text"))).alias("id"))


@query("""SELECT doc_id, unnest(list_filter(a, lambda y: len(list_filter(p, lambda z: contains(z, y))) = 0)) AS account FROM (
 SELECT doc_id, list_distinct(list_filter(r, lambda n: length(n) BETWEEN 10 AND 13)) AS a, list_filter(r, lambda n: length(n) = 16) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS r FROM documents))""")
def account_minus_pan(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(ids.accounts(F.col("text"))).alias("account"))


ID_SQL = "lpad(c_custkey::VARCHAR, 16, '3')"


@query(f"SELECT c_custkey, hamming({ID_SQL}, {ID_SQL.replace('c_custkey', '(c_custkey + 1)')})::INT AS distance, hamming({ID_SQL}, {ID_SQL.replace('c_custkey', '(c_custkey + 1)')}) <= 1 AS same FROM customer")
def id_hamming1_match(spark, d):
    a, b = F.lpad(F.col("c_custkey").cast("string"), 16, "3"), F.lpad((F.col("c_custkey") + 1).cast("string"), 16, "3")
    return table(spark, d, "customer").select("c_custkey", ids.hamming(a, b).cast("int").alias("distance"), ids.same_id(a, b).alias("same"))


ACCT = "lpad((s_suppkey * 7919)::VARCHAR, 10, '0')"


@query(f"""SELECT s_suppkey, CASE WHEN f = e THEN 'exact' WHEN ltrim(f, '0') = ltrim(e, '0') THEN 'leading_zero' WHEN length(f) = length(e) AND hamming(f, e) = 1 THEN 'one_digit_off'
 WHEN length(f) = length(e) - 1 AND len(list_filter(range(1, length(e) + 1), lambda i: e[1:i-1] || e[i+1:] = f)) > 0 THEN 'missing_digit' END AS method FROM (
 SELECT s_suppkey, {ACCT} AS e, CASE s_suppkey % 5 WHEN 0 THEN {ACCT} WHEN 1 THEN '0' || {ACCT} WHEN 2 THEN {ACCT}[1:9] || ((({ACCT}[10:])::INT + 1) % 10)::VARCHAR WHEN 3 THEN {ACCT}[1:4] || {ACCT}[6:] ELSE '5555500000' END AS f FROM supplier)""")
def account_match_method(spark, d):
    e = F.lpad((F.col("s_suppkey") * 7919).cast("string"), 10, "0")
    last = ((F.substr(e, F.lit(10)).cast("int") + 1) % 10).cast("string")
    f = (
        F.when(F.col("s_suppkey") % 5 == 0, e).when(F.col("s_suppkey") % 5 == 1, F.concat(F.lit("0"), e)).when(F.col("s_suppkey") % 5 == 2, F.concat(F.left(e, F.lit(9)), last))
        .when(F.col("s_suppkey") % 5 == 3, F.concat(F.left(e, F.lit(4)), F.substr(e, F.lit(6)))).otherwise("5555500000")
    )
    return table(spark, d, "supplier").select("s_suppkey", ids.account_method(f, e).alias("method"))


@query("SELECT doc_id, left(sha256(doc_id::VARCHAR || '|' || source || '|' || left(text, 80)), 32) AS chunk_id FROM documents")
def sha_chunk_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chunk_key(F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 397) || '...' ELSE text END AS cut, left(translate(text, chr(13) || chr(10), '  '), 240) AS preview FROM documents")
def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 400).alias("cut"), T.preview(F.col("text")).alias("preview"))


NAMES_SQL = "WITH RECURSIVE p AS (SELECT DISTINCT p_name AS n FROM part), q AS (SELECT a.n AS a, b.n AS b FROM p a JOIN p b ON a.n <> b.n AND split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1))"
LCS_SQL = """, s AS (SELECT a, b, 1 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS prev FROM q
 UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN b[j] = a[i] THEN prev[j] + 1 ELSE prev[j + 1] END]), lambda acc, v: list_append(acc, greatest(acc[len(acc)], v[1])), [0]) FROM s WHERE i <= length(a))"""


@query(NAMES_SQL + LCS_SQL + " SELECT a, b, round(200.0 * prev[len(prev)] / (length(a) + length(b)), 6) AS ratio FROM s WHERE i = length(a) + 1")
def name_ratio_pairs(spark, d):
    """Names blocked by their first word, compared without Python."""
    p = table(spark, d, "part").select(F.col("p_name").alias("n"), F.split("p_name", " ")[0].alias("first")).distinct()
    pairs = p.select(F.col("n").alias("a"), "first").join(p.select(F.col("n").alias("b"), "first"), "first").where("a <> b")
    return pairs.select("a", "b", F.round(fuzzy.ratio_native(F.col("a"), F.col("b")), 6).alias("ratio"))


def distinct_names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("n")).distinct()


ALL_NAMES_SQL = "WITH RECURSIVE p AS (SELECT DISTINCT p_name AS n FROM part), q AS (SELECT a.n AS a, b.n AS b FROM p a JOIN p b ON a.n <> b.n)"
RATIO_SQL = " SELECT a, b, round(200.0 * prev[len(prev)] / (length(a) + length(b)), 6) AS ratio FROM s WHERE i = length(a) + 1"


@query(ALL_NAMES_SQL + LCS_SQL + RATIO_SQL)
def name_ratio_all_pairs(spark, d):
    """Every distinct name with every other, whatever their words; no block that could lose a pair."""
    p = distinct_names(spark, d)
    pairs = p.select(F.col("n").alias("a")).crossJoin(p.select(F.col("n").alias("b"))).where("a <> b")
    return pairs.select("a", "b", F.round(fuzzy.ratio_native(F.col("a"), F.col("b")), 6).alias("ratio"))


@query()
def name_metrics(spark, d):
    p = distinct_names(spark, d)
    pairs = p.select(F.col("n").alias("a")).crossJoin(p.select(F.col("n").alias("b"))).where("a < b")
    return pairs.select("a", "b", fuzzy.scores(F.col("a"), F.col("b")).alias("s")).select("a", "b", "s.*")


@query()
def identity_score(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", names.identity(F.col("p_name"), F.array_join(F.reverse(F.split("p_name", " ")), " ")).alias("s")).select("p_partkey", "s.*")


PROFILE = {
    "latin": {"flat": ["que", "de"], "any": [["la", "le"], ["en"]]},
    "german": {"flat": ["der", "die", "und"], "excluded": ["queue"]},
    "english": {"any": [["the", "and"], ["of", "to"]], "excluded": ["idiot"]},
}
KEY_SQL = "(VALUES " + ", ".join(
    f"('{p}', {n}, '{kind}', {g}, '{w}')"
    for n, (p, own) in enumerate(PROFILE.items())
    for kind, groups in (("flat", [own.get("flat", [])]), ("any", own.get("any", [])), ("excluded", [own.get("excluded", [])]))
    for g, words in enumerate(groups)
    for w in words
) + ") k(profile, def_pos, kind, group_idx, kw)"
SCORED_SQL = rf"SELECT doc_id, k.*, contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), kw) AS hit FROM documents, {KEY_SQL}"
PROFILES_SQL = f"""SELECT doc_id, profile, def_pos, avg(m) FILTER (kind = 'flat') AS flat_mean, avg(x) FILTER (kind = 'any') AS group_mean, bool_and(x >= 0.7) FILTER (kind = 'any') AS groups_pass,
 coalesce(bool_or(x >= 0.7) FILTER (kind = 'excluded'), false) AS exclusion FROM (SELECT doc_id, profile, def_pos, kind, group_idx, avg(hit::INT) AS m, max(hit::INT)::DOUBLE AS x FROM ({SCORED_SQL}) GROUP BY ALL) GROUP BY ALL"""
AGGREGATE_SQL = f"SELECT *, CASE WHEN exclusion THEN 0.0 WHEN flat_mean IS NOT NULL AND group_mean IS NOT NULL THEN (flat_mean + group_mean) / 2 ELSE coalesce(flat_mean, group_mean, 0.0) END AS aggregate FROM ({PROFILES_SQL})"


def scored(spark, d):
    return keywords.score(table(spark, d, "documents").select("doc_id", "text"), keyword_table(spark, PROFILE))


@query(f"SELECT doc_id, profile, kind, kw, hit FROM ({SCORED_SQL})")
def keyword_profile_scores(spark, d):
    return scored(spark, d).select("doc_id", "profile", "kind", "kw", "hit")


@query(f"""SELECT doc_id, profile, round(aggregate, 6) AS aggregate, CASE WHEN exclusion THEN false WHEN group_mean IS NOT NULL AND flat_mean IS NULL THEN groups_pass
 WHEN group_mean IS NOT NULL THEN flat_mean >= 0.7 AND groups_pass AND aggregate >= 0.7 ELSE coalesce(flat_mean >= 0.7, false) END AS type_pass, exclusion FROM ({AGGREGATE_SQL})""")
def type_gate(spark, d):
    return keywords.type_gate(keywords.profiles(scored(spark, d))).select("doc_id", "profile", F.round("aggregate", 6).alias("aggregate"), "type_pass", "exclusion")


@query(f"""SELECT doc_id, profile, score >= 0.5 AND NOT (score < 0.58 AND score - second < 0.06) AS confident FROM (
 SELECT doc_id, profile, aggregate AS score, coalesce(lead(aggregate) OVER w, 0.0) AS second, row_number() OVER w AS r FROM ({AGGREGATE_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY aggregate DESC, def_pos)) WHERE r = 1""")
def detect_profile_ranked(spark, d):
    return keywords.detect(keywords.profiles(scored(spark, d))).select("doc_id", "profile", "confident")


@query()
def keyword_scores_fuzzy(spark, d):
    return keywords.score(table(spark, d, "documents").select("doc_id", "text"), keyword_table(spark, {"english": {"flat": ["together", "nothing other"]}}), fuzzy=True).select("doc_id", "kw", "score", "hit")


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate::DATE + 90 < DATE '{AS_OF}' THEN 'expired' WHEN o_orderdate::DATE > DATE '{AS_OF}' THEN 'not_yet_valid' ELSE 'valid' END AS expiry FROM orders")
def status_expiry_gate(spark, d):
    begin = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", dates.expiry(begin, F.date_add(begin, 90), F.lit(AS_OF).cast("date")).alias("expiry"))


@query("SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS month_until, (o_orderdate::DATE + 14)::DATE AS week_until FROM orders")
def validity_add_months(spark, d):
    begin = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", dates.until_of(begin, F.lit(1), F.lit("bulan")).alias("month_until"), dates.until_of(begin, F.lit(2), F.lit("minggu")).alias("week_until"))


@query("SELECT o_orderkey, day(o_orderdate)::VARCHAR || ' ' || ['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember'][month(o_orderdate)] || ' ' || year(o_orderdate)::VARCHAR AS shown FROM orders")
def date_display(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.display(F.to_date("o_orderdate")).alias("shown"))


@query("SELECT o_orderkey, o_orderdate::DATE AS found FROM orders")
def dates_from_text(spark, d):
    """The date of each order written out in words and found again."""
    said = F.concat(F.lit("nomor 12, berlaku sampai "), dates.display(F.to_date("o_orderdate")), F.lit(" di kota"))
    return table(spark, d, "orders").select("o_orderkey", dates.after_label(said, dates.found(said), "berlaku sampai").alias("found"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS until, CAST(o_orderdate AS DATE) + 1 AS printed, 4 AS n_found FROM orders")
def dates_repeated(spark, d):
    """One date three times, and once as the end of a longer one: each label has the date after it."""
    day = F.to_date("o_orderdate")
    short = F.date_format(day, "d-M-yyyy")
    said = F.concat(F.lit("terbit "), short, F.lit(", berlaku sampai "), short, F.lit(" oleh "), F.date_format(day, "dd-MM-yyyy"), F.lit(", dicetak "), F.date_format(F.date_add(day, 1), "d/M/yyyy"))
    found = dates.found(said)
    return table(spark, d, "orders").select(
        "o_orderkey", dates.after_label(said, found, "berlaku sampai").alias("until"), dates.after_label(said, found, "dicetak").alias("printed"), F.size(found).alias("n_found")
    )


@query("""SELECT user_id, min(event_id) AS event_id FROM (SELECT e.user_id, e.event_id, e.ts, min(e.ts) OVER (PARTITION BY e.user_id) AS first_ts FROM (
 SELECT e.* FROM events e JOIN (SELECT user_id, min(ts) AS label_ts FROM events WHERE event_type = 'signup' GROUP BY 1) l ON e.user_id = l.user_id AND e.ts > l.label_ts) e) WHERE ts = first_ts GROUP BY 1""")
def first_event_after_label(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    label = F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).over(Window.partitionBy("user_id"))
    return e.withColumn("label_ts", label).where(F.col("ts") > F.col("label_ts")).groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus = 'F' THEN 'policy.marital' END, CASE WHEN o_totalprice > 200000 THEN 'document.type' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'bank.mismatch' END], lambda x: x IS NOT NULL) AS c,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN len(c) = 0 THEN 'generic.validation_failed' ELSE c[1] END AS error_code FROM orders""".replace("SELECT o_orderkey, list_filter", "SELECT o_orderkey, error_code FROM (SELECT o_orderkey, list_filter", 1) + ")")
def error_cases_ordered(spark, d):
    o = table(spark, d, "orders").withColumn("document_matched", F.col("o_orderkey") % 5 == 0)
    rules = [("policy.marital", F.col("o_orderstatus") == "F"), ("document.type", F.col("o_totalprice") > 200000), ("bank.mismatch", F.col("o_orderpriority") == "1-URGENT")]
    return gates.error_codes(o, rules).select("o_orderkey", "error_code")


@query("""SELECT c_custkey, has_flag AS type_pass, CASE WHEN want = '' THEN NULL ELSE got = want END AS id_pass, has_flag AND (want = '' OR got = want) AS document_matched FROM (
 SELECT c_custkey, c_custkey % 4 <> 0 AS has_flag, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lpad(c_custkey::VARCHAR, 16, '3') END AS want, lpad((c_custkey - c_custkey % 2)::VARCHAR, 16, '3') AS got FROM customer)""")
def extraction_gate(spark, d):
    """A gate from its table row: flag and identity number of a JSON extraction."""
    c = table(spark, d, "customer")
    got = F.lpad((F.col("c_custkey") - F.col("c_custkey") % 2).cast("string"), 16, "3")
    rows = c.select(
        "c_custkey", F.lit("").alias("expected_name"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.lpad(F.col("c_custkey").cast("string"), 16, "3")).alias("expected_nik"),
        F.to_json(F.struct(F.when(F.col("c_custkey") % 4 != 0, "ya").otherwise("tidak").alias("is_bpjs_tk"), got.alias("nik"), F.lit("").alias("holder_name"))).alias("extraction"),
    )
    return gates.decide(rows, gates.GATES["bpjs_tk"]).select("c_custkey", "type_pass", "id_pass", "document_matched")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN true ELSE c_custkey % 3 <> 0 END AND c_custkey % 7 <> 0 AS card_pass,
 concat_ws(',', CASE WHEN (c_custkey % 5 <> 0 AND c_custkey % 3 = 0) OR c_custkey % 7 = 0 THEN 'CARD_MISMATCH' END, CASE WHEN c_custkey % 4 = 0 THEN 'DOCUMENT_TYPE' END) AS blocked FROM customer""")
def card_gate(spark, d):
    """Card numbers of two places, with zeros and separators, against an expected one that every fifth row lacks; a foreign card in every third row, a second one in the notes of every seventh."""
    number = F.lpad(F.col("c_custkey").cast("string"), 12, "8")
    shown = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("9"), number)).otherwise(F.concat(F.lit("0"), number))
    dashed = F.concat(F.left(shown, F.lit(4)), F.lit("-"), F.substring(shown, 5, 20))
    rows = table(spark, d, "customer").select(
        "c_custkey", F.lit("").alias("expected_name"), F.lit("").alias("expected_nik"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(number).alias("expected_card_number"),
        F.to_json(F.struct(
            (F.col("c_custkey") % 4 != 0).alias("is_bpjs_kesehatan"), shown.alias("card_number"), dashed.alias("info_peserta_card_number"),
            F.when(F.col("c_custkey") % 7 == 0, "nomor lain 77777777777").otherwise("").alias("notes"),
        )).alias("extraction"),
    )
    return gates.decide(rows, gates.GATES["bpjs"]).select("c_custkey", "card_pass", F.array_join("blockers", ",").alias("blocked"))


@query("""SELECT doc_id, line_no::INT AS line_no, (sum(CASE WHEN length(line) BETWEEN 1 AND 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS section FROM (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents)""")
def section_running_id(spark, d):
    rows = search.lines(table(spark, d, "documents").select("doc_id", "text"))
    return search.running_sections(rows, F.length("line").between(1, 20)).select("doc_id", "line_no", "section")


@query()
def chunk_pack(spark, d):
    sections = search.markdown_sections(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("# "), F.col("role"), F.lit("\n"), F.col("text")).alias("text")))
    return search.chunks(sections).select("doc_id", "section", "n", "chunk_id", "kind")


KNN_SQL = """SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id,
 list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS s
 FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings v) QUALIFY rank <= 10"""


@query(KNN_SQL)
def vector_knn(spark, d):
    """The stated query set (ids divisible by 100) against all rows, exactly."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.nearest(q, v).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


TERMS = "the of and"
BM25_SQL = rf"""WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
 z AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t), f AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t) WHERE term IN ('the', 'of', 'and') GROUP BY ALL),
 g AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
 SELECT doc_id, row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS rank FROM (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a)))) AS s FROM f JOIN g USING (term), z GROUP BY 1) QUALIFY rank <= 20"""


@query(BM25_SQL)
def bm25_topk(spark, d):
    q = spark.createDataFrame([(0, TERMS)], "query_id long, query string")
    return search.bm25(table(spark, d, "documents").select("doc_id", "text"), q, 20).select("doc_id", F.col("rank").cast("long").alias("rank"))


def _rankings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("query_id"), "n_chars")
    w = lambda *o: Window.partitionBy("query_id").orderBy(*o)
    a = docs.withColumn("rank", F.row_number().over(w(F.desc("n_chars"), "doc_id"))).where("rank <= 50")
    b = docs.withColumn("rank", F.row_number().over(w(F.col("doc_id") % 97, "doc_id"))).where("rank <= 50")
    return a, b


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 97, doc_id) AS r FROM documents QUALIFY r <= 50)
 SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS s FROM a FULL JOIN b ON a.doc_id = b.doc_id) QUALIFY rank <= 10""")
def rrf_hybrid(spark, d):
    return search.fuse(*_rankings(spark, d)).select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT conv_id AS doc_id, count(*) AS n_chunks, arg_min(role, turn) AS title FROM conversations GROUP BY 1 ORDER BY n_chunks DESC, doc_id LIMIT 200")
def doc_catalogue(spark, d):
    return search.catalogue(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), F.col("role").alias("title")))


@query()
def cv_match_dims(spark, d):
    return search.match_dimensions(table(spark, d, "documents"), {"education": ("the of", 65.0), "experience": ("and was", 70.0), "position": ("", 50.0)})


@query("SELECT window_start, event_type AS document_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type FROM events) GROUP BY ALL")
def log_hourly_counts(spark, d):
    from ..streaming import log_stream

    return log_stream.hourly(table(spark, d, "events").withColumnRenamed("event_type", "document_type"), "ts")


@query(r"""WITH t AS (SELECT item_id AS doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark)
 SELECT DISTINCT doc_id, unnest(list_concat(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')), list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS window FROM t""")
def word_windows(spark, d):
    return extract.windows_of(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), 4)


@query()
def name_candidates_best(spark, d):
    """Part names as names in labelled texts, found and matched again."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("expected_name"), F.concat(F.lit("NO 12 | Nama : "), F.initcap("p_name"), F.lit("\nALAMAT LAIN")).alias("text"))
    return extract.best_name(extract.name_candidates(p), p)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 <> o_custkey % 2 + 1 END AS conflict FROM orders")
def card_number_conflict(spark, d):
    a = F.when(F.col("o_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("o_custkey") % 3).cast("string")))
    b = F.array((F.col("o_custkey") % 2 + 1).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", extract.number_conflict(a, b).alias("conflict"))
