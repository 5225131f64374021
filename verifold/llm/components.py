"""Connected components of an edge table, by contraction.

Each round hooks every node to its least neighbour, shortens the hooks once, replaces the ends
of the edges by what they hang on and drops loops and repetitions.  Rounds are written to the
shared folder, so lineage stays short and a lost executor repeats no earlier round.  Minima are
combined before they are shuffled, and a hub's edges are an ordinary skewed join: no group of
edges is ever held by one task or by the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node, root for every end of ``edges(a, b)`` (long); root is the least node of its component.

    Loops count as nodes; nulls in either end are ignored; no edges give no rows.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    maps: list[DataFrame] = []
    while True:
        hooked = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "hooks")
        higher = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hooks = common.materialize(hooked.join(higher, "up").select("node", F.col("top").alias("root")), "roots")
        common.discard(hooked)
        maps.append(hooks)
        of_a, of_b = (hooks.select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("a", "ra"), ("b", "rb")))
        left = common.materialize(
            edges.join(of_a, "a").join(of_b, "b").where(F.col("ra") != F.col("rb")).select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges"
        )
        if len(maps) > 1:
            common.discard(edges)
        if not left.take(1):
            common.discard(left)
            break
        edges = left
        both = edges.union(edges.select(F.col("b"), F.col("a")))
    # A root that isn't its component's least node was a node of the next round's edges.
    found = maps[0]
    for later in maps[1:]:
        found = found.join(later.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
