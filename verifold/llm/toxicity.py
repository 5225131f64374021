"""Toxicity by nearest labelled examples.

A bounded sample of the labelled training rows are the examples.  Features are their words and word
beginnings (inflected forms share them), all of them; how many training rows of either class
have a feature is counted over all training rows.  A feature's weight in a text is its
frequency's logarithm times its inverse document frequency times the cube of how surely the
classes differ in it (the lower bound of its log odds; a feature whose bound is zero has no
weight).  The examples' unit vectors stand in an inverted index whose postings are cut into blocks with the greatest weight of each.  A text's
nearest examples by cosine are found exactly: a batch of texts meets the longest postings as a
dense product in single precision and sums the others; examples that reach the k-th nearest
within that product's greatest error get whole products in double precision.  A text with
fewer near examples takes the blocks' greatest weights as bounds of the long postings in place
of that.  Distance-weighted votes give a raw score, which a logistic curve fitted on
left-one-out votes of the examples calibrates.  The neighbours are the evidence.

Only the index (bounded by the sample's size) is sent to the tasks; documents are scored
where they are read.

Defined results: a document without a feature of weight, empty and null texts included, scores the share
of toxic rows among training rows that share no word with the examples, smoothed by that of all; without any labelled row every score is 0.  A doc_id
with several labels is toxic if one of them says so; null labels are no labels.  Repeated rows
are scored one by one, and are one example.  Other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Memory

LETTERS = re.compile(r"[^\W\d_]+")
#: A side of a join is broadcast up to so many rows (16 bytes each); beyond, Spark's own join is left to shuffle.
BROADCAST_ROWS = 2_000_000
Sparse = tuple[np.ndarray, np.ndarray]  # features and their counts or weights


@dataclass(frozen=True)
class Model:
    examples: int = 4_000  # labelled rows in the index: the documented bound of the sample
    prefixes: tuple[int, ...] = (4, 5, 6)
    sure: float = 1.5  # deviations by which a feature's log odds are lowered
    neighbours: int = 15
    prior_votes: float = 0.5
    block: int = 64
    seed: int = 10


def features_of(token: str, prefixes: tuple[int, ...]) -> list[str]:
    out = []
    for word in LETTERS.findall(token.lower()):
        out.append(word)
        out += [f"{word[:n]}~" for n in prefixes if len(word) > n]
    return out


class Vectors:
    """Counts of known features in texts; what a token holds is remembered."""

    def __init__(self, features: list[str], prefixes: tuple[int, ...]):
        self.number, self.prefixes, self.memory = {f: i for i, f in enumerate(features)}, prefixes, Memory()

    def counts(self, texts: list[bytes]) -> list[Sparse]:
        """Of each text, its features in order and how often it has them."""
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        coded, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        codes, memory, number = coded.indices.to_numpy(), self.memory, self.number
        tokens = coded.dictionary.to_pylist()
        new = memory.missing(tokens)
        memory.store(new, [tuple(number[f] for f in features_of(token, self.prefixes) if f in number) for token in new])
        held = list(map(memory.__getitem__, tokens))
        memory.turn()
        size = np.fromiter(map(len, held), np.int64, len(held))
        flat = np.fromiter(chain.from_iterable(held), np.int64, int(size.sum()))
        n = size[codes]
        text = np.repeat(np.repeat(np.arange(len(texts)), np.diff(ends)), n)
        width = max(len(number), 1)
        key, count = np.unique(text * width + flat[_spans((np.cumsum(size) - size)[codes], n)], return_counts=True)
        cuts = np.searchsorted(key, np.arange(len(texts) + 1) * width)
        return [(key[a:b] % width, count[a:b].astype(float)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, in a row."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Unit vectors by example and by feature, and each feature's greatest weight in blocks of ``block`` examples."""

    #: The longest postings that are also held as a dense matrix, and the texts that meet it at once.
    DENSE, TEXTS = 2048, 256

    def __init__(self, vectors: list[Sparse], n_features: int, block: int = 64):
        size = np.array([len(f) for f, _ in vectors], np.int64)
        own_f = np.concatenate([f for f, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int32)
        self._build(np.append(0, np.cumsum(size)), own_f, np.concatenate([w for _, w in vectors] or [np.zeros(0)]), n_features, block)

    def __getstate__(self):
        return self.own_first, self.own_f, self.own_w, self.n_features, self.block  # the rest follows from it

    def __setstate__(self, state) -> None:
        self._build(*state)

    def _build(self, own_first: np.ndarray, own_f: np.ndarray, own_w: np.ndarray, n_features: int, block: int) -> None:
        self.own_first, self.own_f, self.own_w, self.n_features, self.block = own_first, own_f, own_w, n_features, block
        self.n = len(own_first) - 1
        order = np.argsort(own_f, kind="stable")
        self.at, self.w = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(own_first))[order], own_w[order]
        feature = own_f[order]
        self.first = np.searchsorted(feature, np.arange(n_features + 1))
        key = feature.astype(np.int64) * (self.n // block + 1) + self.at // block
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block_at, self.block_max = self.at[start] // block, np.maximum.reduceat(self.w, start) if len(key) else self.w
        self.block_first = np.searchsorted(feature[start], np.arange(n_features + 1))
        self.long = np.diff(self.first) > max(self.n // 4, block)
        self.column = None  # of a feature in the dense matrix; made when texts are first searched

    def _make_dense(self) -> None:
        size = np.diff(self.first)
        most = np.sort(np.argsort(-size, kind="stable")[: self.DENSE])
        most = most[size[most] > self.n // 20]
        self.column = np.full(self.n_features, -1, np.int32)
        self.column[most] = np.arange(len(most))
        self.dense = np.zeros((len(most), self.n), np.float32)
        rows = _spans(self.first[most], size[most])
        self.dense[np.repeat(np.arange(len(most)), size[most]), self.at[rows]] = self.w[rows]
        self.scratch = np.zeros(self.n_features)

    def nearest(self, vectors: list[Sparse], k: int, skip: int = -1) -> list[list[tuple[float, int]]]:
        """search() of each of the vectors.  skip: the example left out of the first's, the next of the next's and so on."""
        if self.n <= k:
            return [self.search(v, k, skip + i if skip >= 0 else -1) for i, v in enumerate(vectors)]
        if self.column is None:
            self._make_dense()
        out = []
        for lo in range(0, len(vectors), self.TEXTS):
            part = vectors[lo : lo + self.TEXTS]
            f, w = (np.concatenate([v[i] for v in part]) for i in (0, 1))
            text = np.repeat(np.arange(len(part)), [len(v[0]) for v in part])
            column = self.column[f]
            in_dense = column >= 0
            left = np.zeros((len(part), len(self.dense)), np.float32)
            left[text[in_dense], column[in_dense]] = w[in_dense]
            f, w, text = f[~in_dense], w[~in_dense], text[~in_dense]
            about = (left @ self.dense).astype(float)
            ends = np.searchsorted(text, np.arange(len(part) + 1))
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):  # one text's postings at a time are held
                about[i] += self._sum(f[a:b], w[a:b], self.first, self.at, self.w, self.n)
            if skip >= 0:
                about[np.arange(len(part)), skip + lo + np.arange(len(part))] = -1.0
            least = np.partition(about, self.n - k, axis=1)[:, self.n - k]
            for i, (v, row) in enumerate(zip(part, about, strict=True)):
                # Terms are not negative and sum to 1 at most, so rounding errs by less than this.
                wrong = (len(v[0]) + 8) * 2.0**-23
                if least[i] <= 2 * wrong:
                    out.append(self.search(v, k, skip + lo + i if skip >= 0 else -1))
                    continue
                some = np.flatnonzero(row >= least[i] - 2 * wrong)
                self.scratch[v[0]] = v[1]
                scores = self._exact(some, self.scratch)
                self.scratch[v[0]] = 0
                order = np.lexsort((some, -scores))[:k]
                out.append(list(zip(scores[order].tolist(), some[order].tolist(), strict=True)))
        return out

    def _exact(self, examples: np.ndarray, dense: np.ndarray) -> np.ndarray:
        size = self.own_first[examples + 1] - self.own_first[examples]
        rows = _spans(self.own_first[examples], size)
        return np.bincount(np.repeat(np.arange(len(examples)), size), dense[self.own_f[rows]] * self.own_w[rows], len(examples))

    def _sum(self, f: np.ndarray, w: np.ndarray, first: np.ndarray, at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        size = first[f + 1] - first[f]
        rows = _spans(first[f], size)
        return np.bincount(at[rows], np.repeat(w, size) * weights[rows], n)

    def search(self, vector: Sparse, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k nearest (cosine, example), ties by example; cosines over 0 alone.  skip: an example left out."""
        f, w = vector
        if not len(f) or not self.n:
            return []
        far = self.long[f]
        near = self._sum(f[~far], w[~far], self.first, self.at, self.w, self.n)
        if far.any():
            blocks = self._sum(f[far], w[far], self.block_first, self.block_at, self.block_max, self.n // self.block + 1)
            bound = near + np.repeat(blocks, self.block)[: self.n]
        else:
            bound = near
        if skip >= 0:
            near[skip] = bound[skip] = -1.0
        least = np.partition(near, self.n - k)[self.n - k] if self.n > k else 0.0
        some = np.flatnonzero((bound >= least - 1e-12) & (bound > 0))
        if far.any():
            dense = np.zeros(self.n_features)
            dense[f] = w
            best = some[np.argsort(-bound[some], kind="stable")]
            found, scores = np.zeros(0, np.int64), np.zeros(0)
            for lo in range(0, len(best), 256):  # by falling bound, until none can be nearer
                part = best[lo : lo + 256]
                if len(scores) >= k and bound[part[0]] < np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-12:
                    break
                found, scores = np.append(found, part), np.append(scores, self._exact(part, dense))
        else:
            found, scores = some, near[some]
        order = np.lexsort((found, -scores))[:k]
        return [(float(scores[i]), int(found[i])) for i in order if scores[i] > 0]


@dataclass
class Fitted:
    features: list[str]
    weights: np.ndarray  # of the features
    ids: list[int]
    toxic: np.ndarray
    weight: np.ndarray  # how many training rows an example stands for
    index: BlockMaxIndex
    plain_score: float  # of a document without features
    base_rate: float
    curve: tuple[float, float]
    model: Model

    def vector(self, counts: Sparse) -> Sparse:
        f, n = counts
        raw = (1 + np.log(n)) * self.weights[f]
        norm = math.sqrt(float(raw @ raw))
        stay = raw > 0
        return (f[stay], raw[stay] / norm) if norm else (f[:0], raw[:0])

    def raw(self, near: list[tuple[float, int]]) -> float:
        """Votes weighted by closeness, log odds."""
        yes = no = 0.0
        for cosine, i in near:
            vote = self.weight[i] / (1.05 - min(cosine, 1.0))
            if self.toxic[i]:
                yes += vote
            else:
                no += vote
        p = self.model.prior_votes
        return math.log((yes + p * self.base_rate + 1e-6) / (no + p * (1 - self.base_rate) + 1e-6))

    def scores(self, counts: list[Sparse]) -> list[tuple[float, list[tuple[float, int]]]]:
        out, (a, b) = [], self.curve
        for near in self.index.nearest([self.vector(c) for c in counts], self.model.neighbours):
            out.append((1 / (1 + math.exp(-max(-35.0, min(35.0, a * self.raw(near) + b)))) if near else self.plain_score, near))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic curve by Newton's method, with the targets and slope of Platt's smoothing."""
    up, down = float(w[y].sum()), float(w[~y].sum())
    t = np.where(y, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([(w * (p - t) * x).sum() + 0.01 * (a - 1), (w * (p - t)).sum() + 0.01 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.05), b


def training_rows(docs: DataFrame, labels: DataFrame, train) -> DataFrame:
    """toxic, doc_id, text of the labelled rows for which train(doc_id) holds, written once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(train(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = F.broadcast(known) if labels.count() <= BROADCAST_ROWS else known
    return common.materialize(docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", "toxic", "text"), "labelled", compression="zstd")


def fit(rows: DataFrame, model: Model = Model()) -> Fitted | None:
    """rows: training_rows()."""
    sizes = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic + n_clean:
        return None
    base_rate = n_toxic / (n_toxic + n_clean)
    prefixes = model.prefixes
    spark = rows.sparkSession

    # The examples: of each class the distinct rows of the least seeded hashes.
    hashed = rows.select("doc_id", "toxic", "text", F.xxhash64(F.lit(model.seed), "doc_id", "text").alias("h"))
    cut = {}
    for y in (True, False):
        least = hashed.where(F.col("toxic") == y).select("h").distinct().orderBy("h").limit(model.examples // 2).collect()
        cut[y] = least[-1].h if least else -(1 << 63)
    some = hashed.where(F.when(F.col("toxic"), F.col("h") <= cut[True]).otherwise(F.col("h") <= cut[False])).dropDuplicates(["h"])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in common.texts(batch):
                n: Counter[str] = Counter()
                for token, k in Counter(text.split()).items():
                    for f in features_of(token.decode(), prefixes):
                        n[f] += k
                found.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(n) for n in found], pa.list_(pa.string())), pa.array([list(n.values()) for n in found], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "features", "counts"],
            )

    sample = common.map_batches(some.select("doc_id", "toxic", "text"), described, "doc_id long, toxic boolean, features array<string>, counts array<long>").toArrow()
    ids, marks = sample.column("doc_id").to_pylist(), sample.column("toxic").to_pylist()
    own_n = sample.column("counts").combine_chunks().flatten().to_numpy().astype(float)
    lists = sample.column("features").combine_chunks()
    del sample  # what is not needed any more goes at once: all examples' features are here
    coded, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
    del lists
    order = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order)).to_pylist()
    own_f = np.argsort(order)[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
    del coded, order
    common.trim()
    held = spark.sparkContext.broadcast(names)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vectors(held.value, prefixes)
        n = np.zeros((2, len(known.number) + 1), np.int64)  # the last: rows without any
        for batch in batches:
            for (f, _), y in zip(known.counts(common.texts(batch)), batch.column(batch.schema.get_field_index("toxic")).to_pylist(), strict=True):
                n[int(y), f if len(f) else -1] += 1
        for y in (0, 1):
            at = np.flatnonzero(n[y])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), bool(y))), pa.array(n[y, at])], names=["feature", "toxic", "n"])

    counted = common.map_batches(rows.select("toxic", "text"), seen, "feature long, toxic boolean, n long").groupBy("feature", "toxic").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    n = np.zeros((2, len(names) + 1))
    n[counted.column("toxic").to_numpy().astype(int), counted.column("feature").to_numpy()] = counted.column("n").to_numpy()
    (plain_clean, plain_toxic), (in_clean, in_toxic) = n[:, -1], n[:, :-1]
    odds = np.log((in_toxic + 0.5) / (n_toxic + 1)) - np.log((in_clean + 0.5) / (n_clean + 1))
    sure = np.maximum(0, np.abs(odds) - model.sure * np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_clean + 0.5)))
    weights = (np.log((n_toxic + n_clean + 1) / (in_toxic + in_clean + 1)) + 1) * sure**3
    has = weights > 0
    number = np.where(has, np.cumsum(has) - 1, -1)
    names, weights = [names[i] for i in np.flatnonzero(has)], weights[has]

    def known(i: int) -> Sparse:
        f = number[own_f[offsets[i] : offsets[i + 1]]]
        return f[f >= 0], own_n[offsets[i] : offsets[i + 1]][f >= 0]

    fitted = Fitted(
        names, weights, [], np.zeros(0, bool), np.zeros(0), BlockMaxIndex([], len(names)), (plain_toxic + base_rate) / (plain_toxic + plain_clean + 1), base_rate, (1.0, 0.0), model
    )
    made = [(fitted.vector(known(i)), ids[i], marks[i]) for i in range(len(ids))]
    made = [m for m in made if len(m[0][0])]
    made.sort(key=lambda v: (int(v[0][0][v[0][1].argmax()]), v[1], v[2], len(v[0][0])))  # alike examples share blocks, so bounds are tight
    fitted.ids, fitted.toxic = [i for _, i, _ in made], np.array([y for *_, y in made], bool)
    stands_for = {y: total / max(1, sum(m[2] == y for m in made)) for y, total in ((True, n_toxic), (False, n_clean))}
    fitted.weight = np.array([stands_for[y] for *_, y in made], float)
    fitted.index = BlockMaxIndex([v for v, *_ in made], len(names), model.block)
    if made:
        held_out = np.array(list(map(fitted.raw, fitted.index.nearest([v for v, *_ in made], model.neighbours, skip=0))))
        fitted.curve = _logistic(held_out, fitted.toxic, fitted.weight)
    fitted.index.column = fitted.index.dense = None  # the driver asks no more
    del made, own_f, own_n, ids, marks, number
    common.trim()
    return fitted


def _scores(docs: DataFrame, fitted: Fitted | None):
    """A function of a batch of texts, for the tasks: scores and neighbours."""
    held = docs.sparkSession.sparkContext.broadcast(fitted)
    common.trim()  # what pickling took

    def start():
        own = held.value
        if own is None:
            return lambda texts: [(0.0, []) for _ in texts]
        known = Vectors(own.features, own.model.prefixes)
        return lambda texts: own.scores(known.counts(texts))

    return start, held


def score(docs: DataFrame, fitted: Fitted | None) -> DataFrame:
    """doc_id, score, predicted, and as evidence the nearest examples' doc_ids with their cosines."""
    start, held = _scores(docs, fitted)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, ids = start(), held.value.ids if held.value else []
        for batch in batches:
            rows = judge(common.texts(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([s for s, _ in rows], pa.float64()),
                    pa.array([int(s >= 0.5) for s, _ in rows], pa.int32()),
                    pa.array([[ids[i] for _, i in near] for _, near in rows], pa.list_(pa.int64())),
                    pa.array([[c for c, _ in near] for _, near in rows], pa.list_(pa.float64())),
                ],
                schema=schema,
            )

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int, evidence array<long>, cosines array<double>")


def keep(docs: DataFrame, fitted: Fitted | None, below: float = 0.5) -> DataFrame:
    """The rows of documents that score below the limit, whole and unchanged."""
    start, _ = _scores(docs, fitted)
    at = docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = start()
        for batch in batches:
            found = judge([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()])
            yield batch.filter(pa.array([s < below for s, _ in found], pa.bool_()))

    return common.map_batches(docs, run, docs.schema)


def held_out(doc_id, folds: int = 5):
    """The fold of tests: crc32 of the id as text; a null id is in the training folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
