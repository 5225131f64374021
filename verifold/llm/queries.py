"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, common, embed_dedup, ngram_join, ppm_score, quality_rules, source_mix, token_files, toxicity, url_filter

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "allow"), ("org/es/", "block")]
#: The block list of the query: hosts of advertising, betting, pill and link farms.
BLOCKED_HOSTS = ["ads-track.example.com", "free-bets.example.net", "cheap-pills.example.net", "spam-farm.example.org", "casino-win.example.net", "adult-x.example.com"]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.apply(common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.amounts(common.table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.apply(common.table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, BLOCKED_HOSTS)


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score.scores(common.table(spark, sf_dir, "documents", "doc_id", "text"), lambda i: ~toxicity.held_out(i, 10))


def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.groups(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_files.scratch_path(spark)
    token_files.write(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    return token_files.checksums(spark, path)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    rows = toxicity.training_rows(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"), lambda i: ~toxicity.held_out(i))
    out = toxicity.score(docs, toxicity.fit(rows))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence", "cosines")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in URL_RULES)
_HOSTS = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
URL_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}), hosts(blocked) AS (VALUES {_HOSTS}),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict FROM parts JOIN rules
  ON ('.' || host LIKE '%.' || rule_host) AND starts_with(path, rule_path) GROUP BY page_id),
bad AS (SELECT page_id, arg_max(blocked, length(blocked)) AS blocked_host FROM parts JOIN hosts ON ('.' || host LIKE '%.' || blocked) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN blocked_host IS NULL THEN 'allow' ELSE 'block' END) AS verdict, blocked_host
FROM parts LEFT JOIN fit USING (page_id) LEFT JOIN bad USING (page_id)"""
_REACH = """
pairs AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS x, b AS y FROM pairs UNION SELECT reach.x, pairs.b FROM reach JOIN pairs ON reach.y = pairs.a),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)"""
EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id
  AND list_dot_product(p.e, q.e) >= 0.98 * sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(q.e, q.e))), {_REACH}
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM v LEFT JOIN least ON x = vec_id"""
JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{common.WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS o FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON x = doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": URL_SQL, "op7_embed_dedup": EMBEDDING_SQL, "op8_ngram_join": JACCARD_SQL}
