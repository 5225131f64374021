"""From documents to training ids in five stages, each an operator of ``verifold.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.

Null and empty texts leave at the quality stage; rows of a null doc_id are never near duplicates
and stay; of equal rows the least doc_id stays; an empty table gives an empty result; columns beyond
those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verifold.llm import byte_bpe, common, ngram_join, quality_rules, source_mix, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from labelled rows outside of the test fold."""
    rows = toxicity.training_rows(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"), lambda i: ~toxicity.held_out(i))
    return toxicity.keep(docs.select(*COLUMNS), toxicity.fit(rows))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and line-first cleaning, whole."""
    return quality_rules.keep(docs.select(*COLUMNS))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies: five words, similarity 0.8."""
    return ngram_join.keep_one(docs.select(*COLUMNS), ngram_join.Join(words=5, percent=80)).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, dealt to shards and shuffled in each."""
    return source_mix.mixed(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("source_mix", mixing_stage),
    ("byte_bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Fitted scores, drawn blocks and recursive contraction are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None
