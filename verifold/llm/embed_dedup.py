"""Near-duplicate embeddings by collision-counting projections.

Two unit vectors of cosine c are ``r = sqrt(2 - 2c)`` apart, so on any unit direction their
projections differ by r at most, and on a random one by a normal deviate of about
``r / sqrt(dim)``.

1. Equal vectors of a label are merged into one with a multiplicity.
2. A first direction cuts each label into bands of width r: linked vectors lie in the same or
   in neighbouring bands, without exception.  Bands over block_rows are dealt into blocks, and
   each pair of blocks that may hold links is a task of its own.
3. In a task the projections on each further direction are sorted, every query's window is
   found by binary search, and collisions are counted for each pair.  Pairs with a count that
   a linked pair reaches with the required recall are verified by their cosine in double
   precision.
4. A task returns numbers of links and a spanning forest, never its pairs; components of the
   forests are the groups.

Defined results: a vector links with nothing if its label, its id or itself is null, if it is
zero or holds null or non-finite components; vectors of different length do not link; rows of
equal vec_id are vectors of their own; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components


@dataclass(frozen=True)
class Dedup:
    cosine: float = 0.98
    directions: int = 16
    window: float = 2.0  # half width, in deviations of a pair that just links
    miss: float = 1e-6  # of such pairs may go below the count
    block_rows: int = 1024
    seed: int = 7

    @property
    def apart(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)

    def least_count(self) -> int:
        """The largest count that all but ``miss`` of the pairs that just link reach."""
        p, n, below = math.erf(self.window / math.sqrt(2)), self.directions, 0.0
        for k in range(n + 1):
            below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if below > self.miss:
                return k
        return n


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """Unit columns; orthogonal as far as the dimension allows."""
    g = np.random.default_rng([seed, dim]).standard_normal((dim, max(n, 1)))
    q = np.concatenate([np.linalg.qr(g[:, i : i + dim])[0] for i in range(0, n, dim)], axis=1)
    return q[:, :n]


def collisions(x: np.ndarray, y: np.ndarray, half: float) -> np.ndarray:
    """For projections x (a row a query) and y: in how many columns y lies in x's window."""
    out = np.zeros((len(x), len(y)), np.uint8)
    rows = np.arange(len(x))
    for j in range(x.shape[1]):
        order = np.argsort(y[:, j], kind="stable")
        column = y[order, j]
        steps = np.zeros((len(x), len(y) + 1), np.int8)
        steps[rows, np.searchsorted(column, x[:, j] - half, "left")] += 1
        steps[rows, np.searchsorted(column, x[:, j] + half, "right")] -= 1
        out[:, order] += np.cumsum(steps[:, :-1], axis=1, dtype=np.int8).view(np.uint8)
    return out


def _links(x: np.ndarray, y: np.ndarray, how: Dedup) -> np.ndarray:
    """Which rows of the unit vectors x and y link: counted, then verified."""
    d = directions(x.shape[1], how.directions + 1, how.seed)[:, 1:]
    # the floor is for rounding, where a direction's share of the distance vanishes
    half = how.window * how.apart / math.sqrt(x.shape[1]) + 1e-12
    passed = collisions(x @ d, y @ d, half) >= (how.least_count() if x.shape[1] > how.directions else 0)
    at = np.nonzero(passed)
    if len(at[0]) > 20_000:
        return passed & (x @ y.T >= how.cosine)
    passed[at] = np.einsum("ij,ij->i", x[at[0]], y[at[1]]) >= how.cosine
    return passed


def prepared(vectors: DataFrame, how: Dedup) -> DataFrame:
    """vec_id, label, vector (its doubles as bytes; null if it can't link), band."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()), ("band", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bands = [], []
            for i, label, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                a = None if i is None or label is None or not v or None in v else np.array(v, np.float64)
                norm = None if a is None else float(np.linalg.norm(a))
                if not norm or not np.isfinite(a).all() or not math.isfinite(norm):
                    raw.append(None)
                    bands.append(None)
                else:
                    raw.append(a.astype("<f8").tobytes())
                    bands.append(math.floor(float(a @ directions(len(a), 1, how.seed)[:, 0]) / norm / (how.apart * (1 + 1e-9))))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(raw, pa.binary()), pa.array(bands, pa.int64())], schema=schema)

    return common.map_batches(vectors.select("vec_id", "label", "embedding"), run, "vec_id long, label long, vector binary, band long")


def groups(vectors: DataFrame, how: Dedup = Dedup()) -> DataFrame:
    """vec_id, n_links, component_id, kept of ``vectors(vec_id, embedding, label)``: a row for each vector."""
    spark = vectors.sparkSession
    rows = common.materialize(prepared(vectors, how), "vectors")
    size = F.length("vector").alias("bytes")
    own = common.materialize(
        rows.where(F.col("vector").isNotNull()).groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("band").alias("band")), "distinct"
    )
    bands = own.groupBy("label", size, "band").agg(F.ceil(F.count("*") / how.block_rows).cast("int").alias("blocks"))
    line = Window.partitionBy("label", "bytes").orderBy("band")
    beside = lambda f, by: F.when(f("band").over(line) == F.col("band") + by, f("blocks").over(line)).otherwise(0)
    bands = bands.withColumn("blocks_below", beside(F.lag, -1)).withColumn("blocks_above", beside(F.lead, 1))
    bands = bands.select(F.col("label").alias("l"), F.col("bytes").alias("s"), F.col("band").alias("g"), "blocks", "blocks_below", "blocks_above")
    placed = own.join(bands, (F.col("label") == F.col("l")) & (F.length("vector") == F.col("s")) & (F.col("band") == F.col("g")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # A meeting: block i of band ``low`` with block j of the same band or of the next.
    to = lambda n, make: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), make)
    meetings = F.concat(
        to(F.col("blocks"), lambda o: F.struct(F.col("band").alias("low"), F.lit(0).alias("step"), F.least(o, block).alias("i"), F.greatest(o, block).alias("j"))),
        to(F.col("blocks_above"), lambda o: F.struct(F.col("band").alias("low"), F.lit(1).alias("step"), block.alias("i"), o.alias("j"))),
        to(F.col("blocks_below"), lambda o: F.struct((F.col("band") - 1).alias("low"), F.lit(1).alias("step"), o.alias("i"), block.alias("j"))),
    )
    side = F.when(F.col("m.step") == 1, (F.col("band") > F.col("m.low")).cast("int")).otherwise((block != F.col("m.i")).cast("int"))
    key = ["label", "bytes", "low", "step", "i", "j"]
    met = placed.select("label", F.col("s").alias("bytes"), "band", "blocks", "id", "n", "vector", F.explode(meetings).alias("m")).select(
        "label", "bytes", "m.low", "m.step", "m.i", "m.j", side.alias("side"), "id", "n", "vector"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, *key).sortWithinPartitions(*key, "side", "id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def done() -> pa.RecordBatch:
            out: list[tuple[int, int | None, int]] = []
            if len(held) > 1:
                side, ids, n = (np.array([r[c] for r in held], np.int64) for c in range(3))
                x = np.frombuffer(b"".join(r[3] for r in held), "<f8").reshape(len(held), -1)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                left = np.flatnonzero(side == 0)
                right = left if held_key[3] == 0 and held_key[4] == held_key[5] else np.flatnonzero(side == 1)
                if len(left) and len(right):
                    link = _links(x[left], x[right], how)
                    if right is left:
                        np.fill_diagonal(link, False)
                        link |= link.T
                    else:
                        out += [(int(i), None, int(k)) for i, k in zip(ids[right], link.T @ n[left], strict=True) if k]
                    out += [(int(i), None, int(k)) for i, k in zip(ids[left], link @ n[right], strict=True) if k]
                    out += [(a, b, 0) for a, b in _forest(link, ids[left], ids[right])]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:6] != held_key:
                    yield done()
                    held_key, held = row[:6], []
                held.append(row[6:])
        yield done()

    found = common.materialize(common.map_batches(met, run, "a long, b long, n long"), "links")
    degree = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    roots = components(found.where(F.col("b").isNotNull())).select(F.col("node").alias("id"), "root")
    named = own.select("label", "vector", "id", "n").join(degree, "id", "left").join(roots, "id", "left")
    named = named.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    component = F.coalesce("root", "vec_id")
    return rows.join(named, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``link`` connects: at most one for each row and column."""
    n = len(left)
    of_left, of_right = np.arange(n), np.full(len(right), n)
    while True:  # the least row of every group reaches all of its rows and columns
        new_right = np.minimum(of_right, np.where(link, of_left[:, None], n).min(0, initial=n))
        new_left = np.minimum(of_left, np.where(link, new_right[None, :], n).min(1, initial=n))
        if (new_left == of_left).all() and (new_right == of_right).all():
            break
        of_left, of_right = new_left, new_right
    out = [(int(left[r]), int(left[i])) for i, r in enumerate(of_left) if r != i]
    return out + [(int(left[r]), int(right[i])) for i, r in enumerate(of_right) if r < n and left[r] != right[i]]
