"""Readers and writers: document folders, manifests, event logs, search index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evaluation import EXTENSIONS

MANIFEST = "employees array<struct<nik:string,nomor_ktp:string,selected_bank:string,nomor_rekening_bank:string>>"


def documents(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """folder, file, path, length (and content) of the document files one folder below root.

    Without content only listings are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(root)
    parts = F.split("path", "/")
    rows = found.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "path", "length", *["content"] * content)
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    return rows.where(ext.isin(*EXTENSIONS) & ~F.col("folder").startswith(".") & ~F.col("file").startswith("."))


def manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """bank_by_id, account_by_id, bank_by_account as (key, value); rows without a whole key are dropped, the last wins."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select(F.posexplode("employees").alias("pos", "e")).select("pos", "e.*")
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\D", "")
    number = F.when(F.length(digits("nik")) == 16, digits("nik")).when(F.length(digits("nomor_ktp")) == 16, digits("nomor_ktp"))
    account = F.when(F.length(digits("nomor_rekening_bank")) >= 10, digits("nomor_rekening_bank"))
    bank = F.nullif(F.lower(F.trim("selected_bank")), F.lit(""))

    def lookup(key, value) -> DataFrame:
        return rows.select(key.alias("key"), value.alias("value"), "pos").where("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.max_by("value", "pos").alias("value"))

    return {"bank_by_id": lookup(number, bank), "account_by_id": lookup(number, account), "bank_by_account": lookup(account, bank)}


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; those that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def overwrite_latest(row: DataFrame, path: str) -> None:
    """A table of one row, replaced as a whole."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def by_suffix(files: DataFrame) -> DataFrame:
    """How each file of (file) is read: text, image, pdf, or by a structured parser."""
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    route = F.when(ext.isin("txt", "md"), "text").when(ext.isin("jpg", "jpeg", "png", "webp"), "image").when(ext == "pdf", "pdf").otherwise("structured")
    return files.withColumn("route", route)


def chunk_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks(doc_id, n, ...) with vectors(doc_id, n, vector) and error, null for whole documents.

    A document with other numbers of either is one row of its doc_id and the error alone.
    """
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("_chunks")).join(vectors.groupBy("doc_id").agg(F.count("*").alias("_vectors")), "doc_id", "full")
    bad = sizes.where(~F.col("_chunks").eqNullSafe(F.col("_vectors")))
    note = F.format_string("%d chunks, %d vectors", F.coalesce("_chunks", F.lit(0)), F.coalesce("_vectors", F.lit(0)))
    whole = chunks.join(bad.select("doc_id"), "doc_id", "left_anti").join(vectors, ["doc_id", "n"]).withColumn("error", F.lit(None).cast("string"))
    return whole.unionByName(bad.select("doc_id", note.alias("error")), allowMissingColumns=True)


def fetch(index: DataFrame, doc_id: str, most: int = 200) -> DataFrame:
    """A document's chunks in order."""
    w = Window.partitionBy("doc_id").orderBy("n")
    return index.where(F.col("doc_id") == doc_id).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
