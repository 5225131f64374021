"""Batch evaluation: listing and planning of files, expected values, grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The extensions of documents.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "pdf")
MOST_FILES = 500


def folders(files: DataFrame) -> DataFrame:
    """files(folder, file) -> folder, n_files of visible folders and known extensions, by name."""
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    shown = files.where(~F.col("folder").startswith(".") & ~F.col("file").startswith(".") & ext.isin(*EXTENSIONS))
    return shown.groupBy("folder").agg(F.count("*").alias("n_files")).orderBy("folder")


def page(rows: DataFrame, group: str, order: list, limit: int, offset: int = 0, most: int = MOST_FILES) -> DataFrame:
    """Of each group the rows after offset, at most limit (0 to ``most``), with their place."""
    w = Window.partitionBy(group).orderBy(*order)
    n = max(0, min(limit, most))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place").between(max(0, offset) + 1, max(0, offset) + n))


def explicit_refs(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs(pos, ref) as ``file`` or ``folder/file``: (good, first of each name whatever its case; bad, with a reason)."""
    part = F.split("ref", "/")
    bad = F.when(F.trim("ref") == "", "empty").when(F.col("ref").rlike(r"\.\.|\\|^/"), "traversal").when(F.size(part) > 2, "too_deep")
    parsed = refs.withColumn("error", bad).withColumn("folder", F.when(F.size(part) == 2, part[0])).withColumn("file", F.element_at(part, -1))
    w = Window.partitionBy(F.lower("ref")).orderBy("pos")
    good = parsed.where(F.col("error").isNull()).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "error")
    return good, parsed.where(F.col("error").isNotNull()).select("pos", "ref", "error")


def filename_fields(name: Column) -> Column:
    """struct(folder, person, number, kind) of ``folder_Name_digits.ext``: 16 digits an id, 10-13 an account."""
    pattern = r"^([^_]+)_(.+)_([0-9]{10,16})\.[A-Za-z0-9]+$"
    number = F.regexp_extract(name, pattern, 3)
    kind = F.when(F.length(number) == 16, "id").when(F.length(number).between(10, 13), "account")
    return F.struct(F.regexp_extract(name, pattern, 1).alias("folder"), F.translate(F.regexp_extract(name, pattern, 2), "_", " ").alias("person"), number.alias("number"), kind.alias("kind"))


def two_stage_lookup(rows: DataFrame, first: DataFrame, second: DataFrame, override: str | None = None) -> DataFrame:
    """Adds value: the override, else by key_1, else by key_2.  Lookups are (key, value) tables with unique keys."""
    a = first.select(F.col("key").alias("_k1"), F.col("value").alias("_v1"))
    b = second.select(F.col("key").alias("_k2"), F.col("value").alias("_v2"))
    out = rows.join(a, rows["key_1"] == a["_k1"], "left").join(b, rows["key_2"] == b["_k2"], "left")
    own = [F.col(override)] if override else []
    return out.withColumn("value", F.coalesce(*own, "_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")


def last_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the last by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def statistics(results: DataFrame, by: list[str], timings: tuple[str, ...] = ()) -> DataFrame:
    """Counts, ratios to four places and mean timings of results(ok, matched, ...) by group.

    A group's counts are combined before the shuffle.  A result that isn't ok is a pipeline error.
    """
    ok, matched = F.coalesce("ok", F.lit(False)), F.coalesce("matched", F.lit(False))
    counts = [
        F.count("*").alias("total"),
        F.count_if(ok & matched).alias("validation_pass"),
        F.count_if(ok & ~matched).alias("validation_fail"),
        F.count_if(~ok).alias("pipeline_error"),
        *(F.avg(t).alias(f"avg_{t}") for t in timings),
    ]
    return ratios(results.groupBy(*by).agg(*counts))


def ratios(counts: DataFrame) -> DataFrame:
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total"), 4)).otherwise(0.0)
    return counts.withColumns({"success_ratio": share("validation_pass"), "failure_ratio": share("validation_fail"), "error_ratio": share("pipeline_error")})


def progress(jobs: DataFrame, order: list, batches: int = 64) -> DataFrame:
    """Adds index and total.  Ranks inside range partitions, plus the rows before each: no single task sorts all."""
    dealt = jobs.repartitionByRange(batches, *order).withColumn("_part", F.spark_partition_id())
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("index", F.col("_own") + F.col("_before")).drop("_part", "_p", "_own", "_before")


def failure_detail(*sources: Column) -> Column:
    """The first two that say something, joined."""
    said = F.filter(F.array(*(F.nullif(F.trim(c), F.lit("")) for c in sources)), lambda x: x.isNotNull())
    return F.array_join(F.slice(F.array_distinct(said), 1, 2), " — ")


def events(results: DataFrame, kind: str) -> DataFrame:
    """One JSON line for each row, for a stream to a client."""
    return results.select(F.to_json(F.struct(F.lit(kind).alias("event"), *results.columns)).alias("line"))
