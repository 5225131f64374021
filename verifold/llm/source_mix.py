"""Mixing sources to target weights.

1. Sources share a budget of words by weight; a source gets at most ``max_epochs`` times its own
   words, and what it can't use is shared again among the others (water filling).
2. A source's documents fall by a seeded hash into blocks of about equal words.  Its blocks,
   in a seeded permutation and once an epoch, are slots; the target says how many slots are
   drawn, and where in the last block the draw ends.
3. The drawn slots are dealt to output shards by a splitting tree: each node halves its shards
   and draws the left half's share of every source from the multivariate hypergeometric
   distribution, so that shards have equal numbers of blocks, sources stay mixed as in a fair
   shuffle, and quotas are exact.  A shard finds its own leaf from the root alone.
4. A shard's rows are its disjoint blocks' documents, in an order of its own (a local shuffle).

Everything follows from the seed and the rows, so reruns and retried tasks agree.  The number
of blocks is at most ``max_blocks`` plus one a source; documents themselves are only ever
aggregated by (source, block).

Defined results: a null text has size 0; a null source is a source of its own, the last; equal
rows share their fate; an empty table gives no rows; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Quotas of so many sources are sent to the tasks that walk the tree (16 bytes each).
MAX_SOURCES = 1_000_000


@dataclass(frozen=True)
class Mix:
    weights: Sequence[float] = (3, 1, 2)  # of the sources in code-point order, repeating
    budget: float = 1.5  # times all words
    max_epochs: int = 2
    block_words: int = 50_000
    max_blocks: int = 1 << 18
    shards: int = 32
    seed: int = 20


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, words -> also source_no (code-point order, null last), weight, target.

    One row a source: this is the only place where one task sees all of them.
    """
    every = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in mix.weights)), (F.col("source_no") % len(mix.weights) + 1).cast("int"))
    by_room = Window.orderBy((F.col("cap") / F.col("weight")), "source_no")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    out = (
        sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("words") * float(mix.max_epochs))
        .withColumn("all_words", F.sum("words").over(every))
        .withColumn("level", (F.col("all_words") * mix.budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("level", F.max("level").over(every))
    )
    # The level rises with every source that is full and falls with the first that isn't: the common one is the highest.
    return out.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight"))).drop("cap", "level")


def shard_quotas(quotas: np.ndarray, shards: int, seed: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """From the tree's root to one leaf: each source's first slot and number of slots in that shard."""
    lo, hi, node = 0, shards, 1
    first, n = np.zeros_like(quotas), quotas.copy()
    while hi - lo > 1:
        left = (hi - lo) // 2
        total = int(n.sum())
        rng = np.random.default_rng([seed, node])
        share = rng.multivariate_hypergeometric(n, total * left // (hi - lo), method="marginals") if total else np.zeros_like(n)
        if shard < lo + left:
            n, hi, node = share, lo + left, 2 * node
        else:
            first, n, lo, node = first + share, n - share, lo + left, 2 * node + 1
    return first, n


def draws(docs: DataFrame, text: Column, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(documents with their source's figures and block, drawn blocks with their shards).

    docs needs doc_id and source; the first result has doc_id, source_no, source_size, target,
    size, mark (a seeded hash of the row) and block; the second source_no, block, epoch, shard
    and stop (words of the block after which the draw ends; null: the whole block).
    """
    spark = docs.sparkSession
    sized = common.materialize(docs.select("doc_id", "source", common.n_words(text).alias("size"), F.xxhash64(F.lit(mix.seed), F.col("doc_id"), text).alias("mark")), "sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("words")), mix)
    plan = plan.withColumn("block_words", F.greatest(F.lit(float(mix.block_words)), F.col("all_words") / mix.max_blocks))
    plan = plan.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("block_words"))).cast("long"))
    plan = common.materialize(plan.select(F.col("source").alias("of_source"), "source_no", F.col("words").alias("source_size"), "target", "n_blocks").coalesce(1), "targets")
    unit = F.shiftrightunsigned("mark", 11) / F.lit(float(1 << 53))
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("block", F.least(F.floor(unit * F.col("n_blocks")), F.col("n_blocks") - 1).cast("long")).drop("of_source")

    permuted = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(mix.seed + 1), "source_no", "block"), "block")
    blocks = (
        placed.groupBy("source_no", "block")
        .agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
        .withColumn("upto", F.sum("words").over(permuted))
        .withColumn("slot", F.row_number().over(permuted) - 1)
        .withColumn("n", F.count("*").over(Window.partitionBy("source_no")))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(mix.max_epochs - 1))))
        .withColumn("slot", F.col("slot") + F.col("epoch") * F.col("n"))
        .withColumn("room", F.col("target") - F.col("epoch") * F.col("source_size") - (F.col("upto") - F.col("words")))
        .where((F.col("room") > 0) & (F.col("words") > 0))
        # blocks without words leave gaps in the slots
        .withColumn("slot", F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1)
        .select("source_no", "block", "epoch", "slot", F.when(F.col("room") < F.col("words"), F.col("room")).alias("stop"))
    )
    blocks = common.materialize(blocks, "blocks")

    counts = blocks.groupBy("source_no").count().toArrow()  # a row a source
    if counts.num_rows > MAX_SOURCES:
        raise ValueError(f"{counts.num_rows} sources; group them to at most {MAX_SOURCES}")
    numbers = np.array(counts.column("source_no").to_pylist(), np.int64)
    order = np.argsort(numbers)
    numbers, quotas = numbers[order], np.array(counts.column("count").to_pylist(), np.int64)[order]
    held = spark.sparkContext.broadcast((numbers, quotas))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_numbers, own_quotas = held.value
        for batch in batches:
            for shard in batch["id"]:
                first, n = shard_quotas(own_quotas, mix.shards, mix.seed, int(shard))
                at = np.flatnonzero(n)
                yield pd.DataFrame({"source_no": own_numbers[at], "first": first[at], "n": n[at], "shard": int(shard)})

    dealt = (
        spark.range(0, mix.shards, 1, min(mix.shards, 64))
        .mapInPandas(leaves, "source_no long, first long, n long, shard int")
        .select("source_no", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    )
    return placed, common.materialize(blocks.join(dealt, ["source_no", "slot"]).select("source_no", "block", "epoch", "shard", "stop"), "draws")


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block, in the order of the marks, what still fits into the rest of the target; then
    the smallest document left out, if the rest is over half of it."""
    rows = rows.sort_values(["mark", "doc_id"], kind="stable", ignore_index=True)
    left, take = float(rows["stop"].iloc[0]), np.zeros(len(rows), bool)
    for i, size in enumerate(rows["size"].tolist()):
        if 0 < size <= left:
            take[i], left = True, left - size
    out = np.flatnonzero(~take & (rows["size"].to_numpy() > 0))
    if len(out) and left > rows["size"].iloc[best := out[rows["size"].to_numpy()[out].argmin()]] / 2:
        take[best] = True
    return rows[take]


def _taken(placed: DataFrame, drawn: DataFrame) -> DataFrame:
    """A row for each document and draw.

    Whole blocks need no more than the join; only the one block of a source where its draw ends
    (about block_words) is gone through document by document.
    """
    joined = placed.select("source_no", "block", "doc_id", "mark", "size").join(drawn, ["source_no", "block"])
    ends = joined.where(F.col("stop").isNotNull())
    return joined.where(F.col("stop").isNull()).unionByName(ends.groupBy("source_no", "block", "epoch").applyInPandas(_fill, ends.schema))


def amounts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of ``docs(doc_id, text, source)``: one row for each document."""
    placed, drawn = draws(docs, F.col("text"), mix)
    columns = ["doc_id", "source", "size", "source_size", "target", "mark", "source_no", "block"]
    ends = _taken(placed, drawn.where(F.col("stop").isNotNull())).groupBy("source_no", "block", "mark", "doc_id").agg(F.max(F.lit(1)).alias("ended"))
    whole = drawn.where(F.col("stop").isNull()).groupBy("source_no", "block").agg(F.count("*").alias("whole"))
    return (
        placed.select(*columns)
        .join(whole, ["source_no", "block"], "left")
        .join(ends.select("source_no", "block", "mark", F.col("doc_id").alias("end_id"), "ended"), ["source_no", "block", "mark"], "left")
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("size") * (F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce(F.when(F.col("end_id").eqNullSafe(F.col("doc_id")), F.col("ended")), F.lit(0)))).alias("taken"),
        )
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: rows of docs, one for each draw, dealt to shards and shuffled inside each."""
    columns = [c for c in docs.columns if c not in ("doc_id", "source")]
    body = F.struct(*(F.col(f"`{c}`") for c in columns))
    placed, drawn = draws(docs, F.col("text"), mix)
    rows = docs.select(F.col("doc_id"), F.col("source"), body.alias("body"), F.xxhash64(F.lit(mix.seed), F.col("doc_id"), F.col("text")).alias("mark"))
    # The draw of a row is known by its mark alone; equal rows count once there and all follow it.
    chosen = _taken(placed, drawn).select("mark", "epoch", "shard").distinct()
    return (
        rows.join(chosen, "mark")
        .repartition(mix.shards, "shard")
        .sortWithinPartitions("shard", F.xxhash64(F.lit(mix.seed + 2), "mark", "epoch"), "doc_id")
        .select(*(F.col(c) if c in ("doc_id", "source") else F.col(f"body.`{c}`").alias(c) for c in docs.columns))
    )
