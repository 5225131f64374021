"""N-gram Jaccard join: groups of documents whose word shingles overlap.

A document is the set of hashes of its shingles.  Two documents link when
``100 * intersection >= percent * union``.  Linked documents' sizes differ by that ratio at
most, and their sets differ in at most ``(a + b) * (100 - percent) / (100 + percent)`` shingles.

1. Every document is described by its set's size and fingerprint; equal sets are one class.
2. *Candidates.*  Hash space is cut into more parts than a linked pair of its size band can
   differ in, so a linked pair agrees on at least one part more than the *spare* ones
   (pigeonhole).  The hash of a part's content is a signature.  Classes with a rare signature
   in common are joined to the least of them.  A signature of more than ``few`` classes (of a
   passage that many share, or of a large group of copies) and an empty part prove little
   alone: if all parts that a linked pair agrees on are such, they are over spare in number in
   both, so the pair has two of them in common among a prefix of either's list, the rarest
   first (prefix filter), and such twos (in large sets such ones) are signatures again.
3. Components of that graph are clusters.  Many a large one is a chain of sets that share little,
   so one over block_docs is cut again by prefixes of whole sets: in any one order of shingles
   linked sets have one in common among the first ``n - ceil(percent * n / 100) + 1`` of each.  The
   order puts frequent shingles last and those of one set first, so chains fall apart.
   A cluster's sets meet as a *sparse matrix product*:
   the document by n-gram incidence is multiplied with its transpose in blocks of columns,
   overlaps accumulate, and pairs below the bound of their sizes are discarded.  A cluster
   over block_docs documents is cut into blocks, and every pair of blocks is a task of its own.
4. Components of the remaining links give each document its group.

Nothing is dropped or capped: signatures of one value are scanned in a sorted stream, copies
are merged before they are shuffled, and large clusters are split.

Sets are told apart by 64-bit hashes (shingles, and fingerprints of whole sets).

Defined results: a null text or one without words has an empty set and links with nothing;
with fewer words than a shingle the whole sequence is the one shingle; documents with equal
sets link whatever their texts; repeated doc_ids are rows of their own and a group's id is the
least doc_id that is not null; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

U = np.uint64
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Join:
    words: int = 4  # of a shingle
    percent: int = 85
    block_docs: int = 512
    columns: int = 4096  # of the incidence matrix at a time
    few: int = 2  # a signature of more classes counts only together with others
    twos: int = 100  # parts of a band up to which they count in twos


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int):
        self.words = words

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: A-Z alone
        if not words:
            return np.zeros(0, U)
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))  # dearer to look up than to make
        k = min(self.words, len(w))
        h = w[: len(w) - k + 1].copy()
        for i in range(1, k):
            h *= U(0x9E3779B97F4A7C15)
            h += w[i : len(w) - k + 1 + i]
        h = mix(h + U(k))
        h.sort()
        return h[np.append(True, h[1:] != h[:-1])]


class Parts:
    """Size bands, and for each the number of parts and its surplus."""

    def __init__(self, join: Join):
        self.join, self.low, self.known = join, [1], {}

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, -(-3 * self.low[-1] // 2)))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def bands(self, n: int) -> list[int]:
        """Where a set of n elements may meet a linked one: its own band, and those in which the larger of a pair may lie."""
        own = self.band(n)
        out = [own]
        while 100 * n >= self.join.percent * self.low[out[-1] + 1]:
            out.append(out[-1] + 1)
            self.band(self.low[out[-1]])
        return out

    def of(self, band: int) -> tuple[int, int]:
        """Parts, and how many more they are than the differing ones: about as many as are empty by chance in the least sets."""
        if band not in self.known:
            while len(self.low) < band + 2:
                self.band(self.low[-1])
            most = 2 * (self.low[band + 1] - 1) * (100 - self.join.percent) // (100 + self.join.percent)
            least, spare = self.low[band] * self.join.percent // 100, 0
            while spare < 0.3 * most and spare < (empty := (n := most + 1 + spare) * (1 - 1 / n) ** least) + 2 * empty**0.5:
                spare += 1
            self.known[band] = most + 1 + spare, spare
        return self.known[band]

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        """A hash for each part's content; its last six bits are the band."""
        out = []
        for band in self.bands(len(hashes)):
            n, _ = self.of(band)
            part = ((hashes >> U(32)) * U(n)) >> U(32)  # sorted, as the hashes are
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sums = np.add.reduceat(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)), first)
            tag = U((band * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
            own = [mix(sums + mix(part[first] + tag))]
            if n > len(first):
                empty = np.ones(n, bool)
                empty[part[first].astype(np.int64)] = False
                empty = np.flatnonzero(empty).astype(U)
                own.append(mix(mix(empty + tag) + U(7)))
            out.append(np.concatenate(own) & ~U(63) | U(band))
        return np.concatenate(out) if out else np.zeros(0, U)


def described(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, class (fingerprint of the set; null when empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(join.words)
        for batch in batches:
            sets = [shingles.of(t) for t in common.texts(batch)]
            prints = [_fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64())], schema=schema)

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, class long")


def signatures(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """key, class: the signatures of every set, once for the copies of a batch."""
    schema = pa.schema([("key", pa.int64()), ("class", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, parts = Shingles(join.words), Parts(join)
        for batch in batches:
            keys, owners, done = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
            for text in common.texts(batch):
                hashes = shingles.of(text)
                if len(hashes) and (own := _fingerprint(hashes)) not in done:
                    done.add(own)
                    keys.append(parts.signatures(hashes).view(np.int64))
                    owners.append(np.full(len(keys[-1]), own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], schema=schema)

    return common.map_batches(docs.select("doc_id", "text"), run, "key long, class long")


def _fingerprint(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _scan(rows: DataFrame, few: int | None) -> DataFrame:
    """rows(key, class) by equal keys, as a sorted stream: hot, a, b.

    Up to ``few`` classes (None: any number) are joined to the least: a is that, b another.
    More make the key hot: a is the key, b each class.
    """
    schema = pa.schema([("hot", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])
    most = few or 1 << 62

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = np.zeros(0, np.int64)  # the last key's rows, which may go on in the next batch
        held_own, hot_key = held_key, None

        def found(key: np.ndarray, own: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held_key, held_own, hot_key
            new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
            key, own = key[new], own[new]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            least = np.repeat(own[start], size)
            hot = np.repeat(size > most, size)
            if hot_key is not None:
                hot |= key == hot_key
            hold = np.zeros(len(key), bool)
            if not last:
                hold[start[-1] :] = True
                if hot[-1]:  # known to be hot: nothing to hold
                    hold[:], hot_key = False, key[-1]
                elif few is None:  # the least is all that must be held
                    hold[:] = False
                held_key, held_own = key[hold], own[hold]
                if few is None:
                    held_key, held_own = key[-1:], least[-1:]
            edge = ~hot & ~hold & (own != least)
            for flag, a, b in ((True, key[hot], own[hot]), (False, least[edge], own[edge])):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), flag)), pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            key, own = (np.concatenate([held, batch.column(i).to_numpy(zero_copy_only=False)]) for i, held in enumerate((held_key, held_own)))
            if len(key):
                yield from found(key, own, False)
        if len(held_key):
            yield from found(held_key, held_own, True)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "class").repartition(n, "key").sortWithinPartitions("key", "class")
    return common.map_batches(dealt, scan, "hot boolean, a long, b long")


def candidates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """a, b: edges over classes that connect every pair that may link, written to the shared folder."""
    found = common.materialize(_scan(signatures(docs, join), join.few), "signatures")
    schema = pa.schema([("key", pa.int64()), ("class", pa.int64())])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(join)
        for batch in batches:
            keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own, band, hot in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, spare = parts.of(band)
                if len(hot) > spare:
                    # twos of many parts would be too many; there the rarest alone are telling
                    k = min(spare + 1, 2) if n <= join.twos else 1
                    h = np.array(hot[: len(hot) - spare - 1 + k], np.int64).view(U)
                    i, j = np.triu_indices(len(h), 1)
                    made = mix(h) if k == 1 else mix(mix(np.minimum(h[i], h[j])) + np.maximum(h[i], h[j]))
                    keys.append(made.view(np.int64))
                    owners.append(np.full(len(made), own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], schema=schema)

    hot = found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("class"))
    # Counts are made before the shuffle; a frequent key's rows meet its count where they are, or in a join whose skewed partitions are split.
    often = common.materialize(hot.groupBy("key").agg(F.count("*").alias("often")), "often")
    near = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    ranked = hot.join(near, "key").select("class", F.col("key").bitwiseAND(63).cast("int").alias("band"), F.struct("often", "key").alias("ranked"))
    # A class has a part's signature once, so a list is no longer than a band has parts; the rarest come first.
    lists = ranked.groupBy("class", "band").agg(F.transform(F.array_sort(F.collect_set("ranked")), lambda r: r["key"]).alias("hot"))
    pairs = _scan(common.map_batches(lists, combine, "key long, class long"), None)
    out = common.materialize(found.where("not hot").select("a", "b").union(pairs.select("a", "b")).distinct(), "candidates")
    common.discard(found)
    common.discard(often)
    return out


def product_links(sets: list[np.ndarray], join: Join, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, root of i) of the groups within these sets; split: only pairs across it are new, all are counted.

    The incidence matrix holds the columns that two sets or more have.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    overlap = np.zeros((n, n), np.float32)
    if len(row):
        column = np.cumsum(np.append(0, column[1:] != column[:-1]))
        for lo in range(0, int(column[-1]) + 1, join.columns):
            a, b = np.searchsorted(column, [lo, lo + join.columns])
            block = np.zeros((n, min(join.columns, int(column[-1]) + 1 - lo)), np.float32)
            block[row[a:b], column[a:b] - lo] = 1
            overlap += block @ block.T
    link = overlap.astype(np.int64) * (100 + join.percent) >= join.percent * (size[:, None] + size[None, :])
    np.fill_diagonal(link, True)
    root = np.arange(n)
    while True:
        new = np.where(link, root[None, :], n).min(1)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def cut_large(docs: DataFrame, classes: DataFrame, clusters: DataFrame, join: Join = Join()) -> DataFrame:
    """clusters (node, root) with those of over block_docs nodes cut; linked nodes stay together, nodes that can't link leave."""
    large = common.materialize(clusters.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > join.block_docs), "large")
    if not (n_large := large.count()):
        common.discard(large)
        return clusters
    large = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    members = clusters.join(large, "root").select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    members = common.materialize(members.join(classes.select("class", F.col("row").alias("doc_id")), "class"), "members")
    n_members = members.count()
    near = F.broadcast(members) if n_members <= BROADCAST_ROWS else members
    texts = common.materialize(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(near, "doc_id").select("class", "cluster", "text"), "texts", compression="zstd")

    schema = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("size", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(join.words)
        for batch in batches:
            keys, owners, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own, cluster, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch), strict=True):
                found = shingles.of(text)
                if len(found) and _fingerprint(found) == own:  # another row of that doc_id has another text
                    keys.append(mix(found + U(cluster & 0xFFFFFFFFFFFFFFFF)).view(np.int64))
                    owners.append(np.full(len(found), own))
                    sizes.append(np.full(len(found), len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owners, sizes)], schema=schema)

    # A set's shingles that no other set of the cluster has come first in the order and meet nothing, so only the others go on.
    w = Window.partitionBy("key")
    shared = common.map_batches(texts, keyed, "key long, class long, size long").select("*", F.count("*").over(w).alias("n"), F.min("class").over(w).alias("least"), F.max("class").over(w).alias("most")).where("least <> most")
    lists = shared.groupBy("class", "size").agg(F.array_sort(F.collect_set(F.struct("n", "key"))).alias("ranked"))
    spare = F.size("ranked") - F.expr(f"cast((size * {join.percent} + 99) div 100 as int)")  # below 0: links with nothing
    first = lists.where(spare >= 0).select("class", F.explode(F.slice("ranked", F.lit(1), spare + 1)).alias("first"))
    met = common.materialize(_scan(first.select("first.key", "class"), None).select("a", "b").distinct(), "prefixes")
    common.discard(texts)
    out = components(met)
    common.discard(met)
    return clusters.join(large, "root", "left_anti").select("node", "root").union(out.select("node", "root"))


def links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, join: Join = Join()) -> DataFrame:
    """a, b (classes): enough of the links to connect every group.

    classes: class, row (the least doc_id); clusters: node (a class), root.
    """
    spark = docs.sparkSession
    sized = common.materialize(clusters.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "clusters")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / join.block_docs)).cast("int")
    members = clusters.join(sized, "root").select(
        F.col("node").alias("class"), F.col("root").alias("cluster"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")
    )
    members = common.materialize(members.join(classes.select("class", F.col("row").alias("doc_id")), "class"), "members")
    near = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(near, "doc_id")
    schema = pa.schema([("cluster", pa.int64()), ("blocks", pa.int32()), ("block", pa.int32()), ("class", pa.int64()), ("set", pa.binary())])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(join.words)
        for batch in batches:
            sets = [shingles.of(t) for t in common.texts(batch)]
            own = pa.array([_fingerprint(s) if len(s) else 0 for s in sets], pa.int64())
            rows = pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("cluster", "blocks", "block", "class")), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)
            yield rows.filter(pa.compute.equal(own, rows.column(3)))  # another row of that doc_id has another text

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = common.map_batches(texts, to_sets, "cluster long, blocks int, block int, class long, set binary")
    i, j = F.least("block", "other"), F.greatest("block", "other")
    meeting = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", i.alias("i"), j.alias("j"), "class", "set")
    meeting = meeting.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "class")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []  # one meeting of two blocks at a time

        def done() -> tuple[list[int], list[int]]:
            own = dict(held)  # a class may come from several rows
            ids, arrays = list(own), [np.frombuffer(x, U) for x in own.values()]
            if len(ids) < 2:
                return [], []
            at, root = product_links(arrays, join)
            return [ids[x] for x in root.tolist()], [ids[x] for x in at.tolist()]

        for batch in batches:
            a, b = [], []
            for key, own, hashes in zip(zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if key != held_key:
                    for out, found in zip((a, b), done(), strict=True):
                        out += found
                    held_key, held = key, []
                held.append((own, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = done()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return common.map_batches(meeting, multiply, "a long, b long")


def groups(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id of ``docs(doc_id, text)``: a row for each document."""
    rows = common.materialize(described(docs, join), "described")
    classes = common.materialize(rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("row")), "classes")
    edges = candidates(docs, join)
    clusters = cut_large(docs, classes, components(edges), join)
    common.discard(edges)
    found = common.materialize(links(docs, classes, clusters, join), "links")
    roots = components(found)
    common.discard(found)
    member = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "row", F.coalesce("root", "class").alias("root"))
    least = member.groupBy("root").agg(F.min("row").alias("component_id"))
    named = member.join(least, "root").select("class", "component_id")
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of docs whose doc_id is its group's least; rows of one kept doc_id all stay, those without doc_id too."""
    drop = common.materialize(groups(docs, join).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "dropped")
    gone = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    return docs.join(gone, "doc_id", "left_anti")
