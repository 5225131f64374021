"""Keyword profiles against documents: scores, group and exclusion gates, ranked detection.

The dimension of a few hundred keywords is one row with an array, which is exploded beside each
document after its text is normalised once; nothing but the small per-profile aggregates is
shuffled, and detection and the gates share one scored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fuzzy import keyword_score


def score(docs: DataFrame, keywords: DataFrame, fuzzy: bool = False, minimum: float = 70.0) -> DataFrame:
    """doc_id x keyword with its score (0-100) and hit.

    A keyword in the normalised text scores 100 and skips the fuzzy metrics; otherwise it
    scores 0, or with fuzzy the best of four metrics over the whole text, its segments, windows of
    two and three neighbouring segments and the text without spaces; a keyword of up to 12 letters
    without a space scores 100 where one of these holds it once spaces are gone.
    """
    text = T.normalize(F.coalesce("text", F.lit("")))
    # Dimensions are small constants; one row of them is joined, and each text is normalised before its keywords multiply it.
    all_of = keywords.withColumn("key", T.normalize_keyword(F.col("kw"))).agg(F.collect_list(F.struct(*keywords.columns, "key")).alias("_all"))
    beside = docs.select("doc_id", text.alias("norm"), *(["text"] if fuzzy else [])).join(F.broadcast(all_of))
    pairs = beside.select("*", F.explode("_all").alias("_one")).select("doc_id", "norm", *(["text"] if fuzzy else []), "_one.*")
    exact = F.col("norm").contains(F.col("key"))
    if not fuzzy:
        return pairs.select("doc_id", *keywords.columns, F.when(exact, 100.0).otherwise(0.0).alias("score"), exact.alias("hit"))
    sure = pairs.where(exact).select("doc_id", *keywords.columns, F.lit(100.0).alias("score"))
    parts = F.filter(F.transform(T.segments(F.coalesce("text", F.lit(""))), T.normalize), lambda p: p != "")
    # Excluded keywords leave the weighted ratio out: one shared word would reach it.
    best = keyword_score(F.col("norm"), parts, F.col("key"), F.col("kind") != "excluded")
    rest = pairs.where(~exact).select("doc_id", *keywords.columns, best.alias("score"))
    return sure.unionByName(rest).withColumn("hit", F.col("score") >= minimum)


def profiles(scored: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Per document and profile: flat mean, group mean, whether every group passes, exclusion, aggregate."""
    share = F.col("score") / 100.0
    grouped = scored.groupBy("doc_id", "profile", "def_pos", "kind", "group_idx").agg(F.avg(share).alias("mean"), F.max(share).alias("most"))
    flat, any_, out = (F.col("kind") == k for k in ("flat", "any", "excluded"))
    per = grouped.groupBy("doc_id", "profile", "def_pos").agg(
        F.max(F.when(flat, F.col("mean"))).alias("flat_mean"),
        F.avg(F.when(any_, F.col("most"))).alias("group_mean"),
        F.min(F.when(any_, (F.col("most") >= ratio).cast("int"))).alias("groups"),
        F.coalesce(F.max(F.when(out, (F.col("most") >= ratio).cast("int"))), F.lit(0)).alias("excluded"),
    )
    both = F.when(F.col("flat_mean").isNotNull() & F.col("group_mean").isNotNull(), (F.col("flat_mean") + F.col("group_mean")) / 2)
    whole = F.coalesce(both, "flat_mean", "group_mean", F.lit(0.0))
    return per.select(
        "doc_id", "profile", "def_pos", "flat_mean", "group_mean",
        (F.col("groups") == 1).alias("groups_pass"),
        (F.col("excluded") == 1).alias("exclusion"),
        F.when(F.col("excluded") == 1, 0.0).otherwise(whole).alias("aggregate"),
    )


def type_gate(per: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Adds type_pass: exclusion fails; groups alone; flat and groups and their mean; flat alone."""
    flat, groups = F.col("flat_mean").isNotNull(), F.col("group_mean").isNotNull()
    passed = (
        F.when(F.col("exclusion"), False)
        .when(groups & ~flat, F.col("groups_pass"))
        .when(groups & flat, (F.col("flat_mean") >= ratio) & F.col("groups_pass") & (F.col("aggregate") >= ratio))
        .otherwise(F.coalesce(F.col("flat_mean") >= ratio, F.lit(False)))
    )
    return per.withColumn("type_pass", passed)


def detect(per: DataFrame, minimum: float = 0.5, margin: float = 0.08, lead: float = 0.06, bonus: Column | None = None) -> DataFrame:
    """The best profile of each document, its score, the runner-up's, and whether the choice is confident."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("aggregate"), F.desc("bonus"), "def_pos")
    ranked = per.withColumn("bonus", bonus if bonus is not None else F.lit(0.0)).withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("aggregate").over(w))
    best = ranked.where("rank = 1")
    sure = (F.col("aggregate") >= minimum) & ~((F.col("aggregate") < minimum + margin) & (F.col("aggregate") - F.coalesce("second", F.lit(0.0)) < lead))
    return best.select("doc_id", "profile", F.col("aggregate").alias("score"), F.coalesce("second", F.lit(0.0)).alias("second_score"), sure.alias("confident"))


def resolve_profile(requests: DataFrame, column: str, aliases: DataFrame, names: list[str]) -> DataFrame:
    """Adds profile: by alias, else by name, else by name without spaces, else null."""
    text = T.normalize(F.col(column))
    known = F.array(*(F.lit(n) for n in names))
    out = requests.withColumn("_text", text).join(F.broadcast(aliases.select(F.col("alias").alias("_alias"), F.col("profile").alias("_by_alias"))), F.col("_text") == F.col("_alias"), "left")
    under = F.regexp_replace("_text", " ", "_")
    squeezed = F.filter(known, lambda n: F.regexp_replace(n, "_", "") == F.regexp_replace(F.col("_text"), "[ _]", ""))
    named = F.when(F.array_contains(known, under), under)
    return out.withColumn("profile", F.coalesce("_by_alias", named, F.get(squeezed, F.lit(0)))).drop("_text", "_alias", "_by_alias")


def worst(scored: DataFrame, n: int = 5) -> DataFrame:
    """The n keywords of lowest score of each document and profile."""
    w = Window.partitionBy("doc_id", "profile").orderBy("score", "kind", "group_idx", "kw_pos")
    return scored.where("kind <> 'excluded'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
