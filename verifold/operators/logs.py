"""Event logs: append, newest first, ring trim, statistics, orphans, upsert, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Failures that are not logged.
SKIPPED_KINDS = ("empty_file", "empty_document_type", "unknown_document_type")


def newest(log: DataFrame, limit: int, offset: int = 0, order: tuple = ("logged_at", "id"), most: int = 500, where=None, compat: bool = False) -> DataFrame:
    """The newest rows after offset.  where is applied first; compat applies it to the page alone."""
    by = [F.desc(c) for c in order]
    rows = log if where is None or compat else log.where(where)
    rows = rows.orderBy(*by).offset(max(0, offset)).limit(max(0, min(limit, most)))
    return rows.where(where) if where is not None and compat else rows


def ring(log: DataFrame, keep: int, order: tuple = ("logged_at", "id"), least: int = 50) -> DataFrame:
    """The newest ``keep`` rows (``least`` at least): a distributed top-k, no global sort."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(max(keep, least))


def ring_per_key(log: DataFrame, key: str, keep: int, order: tuple = ("logged_at", "id")) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def loggable(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("failure_kind", F.lit("")).isin(*SKIPPED_KINDS))


def by_type(log: DataFrame, column: str = "document_type", other: str = "lainnya") -> DataFrame:
    return log.groupBy(F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(other)).alias("document_type")).agg(F.count("*").alias("n"))


def outcome_counts(log: DataFrame, keep: int, order: tuple = ("logged_at", "id"), **conditions) -> DataFrame:
    """Counts of conditions over the newest rows."""
    return ring(log, keep, order, least=0).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def orphans(uploads: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Uploads that no kept row names."""
    return uploads.join(log.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str, version: str, order: tuple = (), fill: bool = False) -> DataFrame:
    """The row of the highest version for each key; on a tie the new one, then the first by ``order`` (columns that are left out of the result).

    fill: nulls replace nothing, neither a value nor rows without a version; each column has the value of the highest version that has one.
    """
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(version), F.desc("_new"), *order)
    if fill:
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        known = {c: F.first(F.when(F.col(version).isNotNull(), F.col(c)), ignorenulls=True).over(every) for c in table.columns if c not in (key, *order)}
        both = both.select(key, "_new", *order, *(v.alias(c) for c, v in known.items()), F.row_number().over(w).alias("_n")).select(*table.columns, "_new", "_n")
    else:
        both = both.withColumn("_n", F.row_number().over(w))
    return both.where("_n = 1").drop("_n", "_new", *order)


def delete(table: DataFrame, key: str, values) -> DataFrame:
    return table.where(~F.coalesce(F.col(key).isin(*values), F.lit(False)))


def append(rows: DataFrame, path: str) -> None:
    """Adds id and time where the rows have none, and appends."""
    out = rows
    for name, made in (("id", F.expr("uuid()")), ("logged_at", F.current_timestamp())):
        out = out.withColumn(name, F.coalesce(F.col(name), made) if name in rows.columns else made)
    out.write.mode("append").json(path)


def magic(content) -> F.Column:
    """The kind of an upload by its first bytes; null if unknown."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(12)))
    return (
        F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("25504446"), "pdf")
        .when(head.startswith("52494646") & (F.substr(head, F.lit(17), F.lit(8)) == "57454250"), "webp")
    )


def storable(uploads: DataFrame, most_bytes: int = 12 << 20) -> DataFrame:
    """uploads(id, name, content) that are small enough and of a known kind."""
    known = F.lower(F.regexp_extract("name", r"\.(jpe?g|png|webp|pdf)$", 1))
    kind = F.coalesce(F.nullif(known, F.lit("")), magic(F.col("content")))
    return uploads.withColumn("kind", kind).where((F.length("content") <= most_bytes) & F.col("kind").isNotNull())


def clear(spark, path: str, kept_at: str) -> int:
    """Counts a JSON-lines log's rows, leaves one row that says when it was cleared, returns the count.

    The stamp is written to ``kept_at`` before the log is emptied, so a run that ends in between loses no row unseen.
    """
    n = spark.read.json(path).count()
    stamp = spark.range(1).select(F.lit("cleared").alias("event"), F.current_timestamp().alias("at"), F.lit(n).alias("rows"))
    stamp.write.mode("append").json(kept_at)
    spark.createDataFrame([], "event string").write.mode("overwrite").json(path)
    return n


def stored_files(log: DataFrame, files: DataFrame) -> DataFrame:
    """log(id) with the stored file's name by files(id, file); null where none is stored."""
    return log.join(files.select("id", "file"), "id", "left")


def folders(names: DataFrame, listing: DataFrame) -> DataFrame:
    """names(file) with the first folder, by name, of listing(folder, file) that holds it; null where none does."""
    first = listing.groupBy("file").agg(F.min("folder").alias("folder"))
    return names.join(first, "file", "left")
