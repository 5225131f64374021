"""Names and numbers out of texts, with where each came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, names
from ..functions import text as T

#: Labels before a name.
NAME_LABELS = ("nama lengkap", "nama", "name", "atas nama", "a.n.")


def name_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, pos, candidate, method of docs(doc_id, text): after a label, whole segments, runs of capitals.

    A normalised name stays once, from the first method that gave it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    labels = "|".join(label.replace(".", r"\.") for label in NAME_LABELS)
    found = {
        "label": F.regexp_extract_all(text, F.lit(rf"(?im)\b(?:{labels})\s*[:=]\s*([^\n|:]+)"), 1),
        "segment": T.segments(text),
        "capitals": F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Z'.-]+(?: [A-Z][A-Z'.-]+){1,5}\b"), 0),
    }
    def tagged(order: int, method: str, array: Column) -> Column:
        return F.transform(array, lambda c: F.struct(F.lit(order).alias("order"), F.lit(method).alias("method"), F.trim(c).alias("candidate")))

    every = F.concat(*(tagged(i, m, a) for i, (m, a) in enumerate(found.items())))
    rows = docs.select("doc_id", F.posexplode(F.filter(every, lambda c: T.is_person_name(c["candidate"]))).alias("pos", "c")).select("doc_id", "pos", "c.method", "c.candidate")
    rows = rows.withColumn("norm", T.normalize_name(F.col("candidate")))
    w = Window.partitionBy("doc_id", "norm").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_name(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request's best candidate: requests(doc_id, expected_name); ties go to the earlier one."""
    pairs = candidates.join(requests.select("doc_id", "expected_name"), "doc_id").withColumn("s", names.identity(F.col("candidate"), F.col("expected_name")))
    best = pairs.groupBy("doc_id", "expected_name").agg(F.max(F.struct(F.col("s.score").alias("score"), (-F.col("pos")).alias("before"), F.col("candidate"), F.col("method"), F.col("s.gate").alias("gate"))).alias("b"))
    return best.select("doc_id", "expected_name", "b.candidate", "b.method", "b.score", (F.col("b.gate") & (F.col("b.score") >= names.PASS)).alias("identity_pass"))


def windows_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, window: distinct runs of so many and one more words."""
    return docs.select("doc_id", F.explode(T.windows(T.tokens(F.coalesce(F.col("text"), F.lit(""))), width, width + 1)).alias("window"))


def zipped_members(docs: DataFrame) -> DataFrame:
    """Names and numbers by position, only where there are as many of either."""
    rows = docs.withColumn("_ids", ids.national_ids(F.coalesce(F.col("text"), F.lit("")))).withColumn("_names", F.filter(T.segments(F.coalesce(F.col("text"), F.lit(""))), T.is_person_name))
    rows = rows.where((F.size("_ids") == F.size("_names")) & (F.size("_ids") > 0))
    return rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("_names").alias("name"), F.col("_ids").alias("nik"))).alias("pos", "m")).select("doc_id", "pos", F.col("m.name"), F.col("m.nik"))


def number_conflict(left: Column, right: Column) -> Column:
    """Whether two lists of numbers, both given, differ as sets; null if either is empty."""
    a, b = (F.array_sort(F.array_distinct(F.filter(F.transform(x, ids.digits_only), lambda n: n != ""))) for x in (left, right))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), a != b)


def bank_of(text: Column, banks: dict[str, tuple[str, ...]], least: float = 1.0, gap: float = 1.0) -> Column:
    """The bank whose phrases the text holds most often, if it leads by ``gap``; else null."""
    norm = T.normalize(text)
    scores = [F.struct(sum((norm.contains(p).cast("double") for p in phrases), F.lit(0.0)).alias("score"), F.lit(name).alias("bank")) for name, phrases in banks.items()]
    ranked = F.sort_array(F.array(*scores), asc=False)
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when((first["score"] >= least) & (first["score"] - F.coalesce(second["score"], F.lit(0.0)) >= gap), first["bank"])
