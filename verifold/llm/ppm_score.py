"""LM scoring by prediction by partial matching over bytes.

A byte-context trie is learnt from training documents: how often each byte followed each
context of up to ``order`` bytes.  A byte is coded in the longest context that has seen it; on
the way down an escape is paid in every context that hasn't (method D: half a count
of every distinct byte goes to the escape), and bytes that the longer contexts know are excluded from the shorter ones.
Below the empty context all bytes not yet excluded are alike.  A document is the sequence of
its bytes and an end byte, after a context of ``order`` start bytes; its score is the log10
probability of that sequence.

Every level of the trie is an array of (context, byte) keys.  What exclusion takes from a
context's parent depends on the context alone, so it is worked out once per context, and the
distinct grams of a batch are scored level by level with hash probes; only bytes that escape go on.

The trie is whole, however many keys it has.  A context's parents share its last two bytes, so
the levels of two bytes and more are built in parts by those two, one task a part; the parts'
arrays and hash slots are files in the shared folder (or, where that is no file system, files that
Spark ships to every executor), and workers memory-map them.

Beside it, a smoothed unigram score of words: counts come from all training documents.  The
most frequent words' counts are sent to the tasks; the other words meet their counts in a join,
on keys that are rare by construction.

Defined results: a null or empty text is the end token (the end byte) alone; a null doc_id is
in training; without training documents the byte model is uniform and every word's
probability is 1 by the formula; equal rows get equal scores; other columns are never read.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

U = np.uint64
END = ""  # the end token: no word is empty


@dataclass(frozen=True)
class Ppm:
    order: int = 5
    part_keys: int = 200_000  # (context, byte) keys of the longest level in a part, about; nothing is left out
    frequent_words: int = 100_000  # whose counts are sent to the tasks
    smoothing: float = 0.1


def _slices(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in order, about so many bytes at a time: an array of a batch's grams has eight bytes for each."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def grams(texts: list[bytes], order: int) -> np.ndarray:
    """For every byte and end byte: it and the ``order`` bytes before it, the first highest."""
    pad = b"\0" * order
    flat = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    key = np.zeros(len(flat) - order, U)
    for i in range(order + 1):
        key = (key << U(8)) | flat[i : len(flat) - order + i]
    starts = np.cumsum([0, *(len(t) + 1 + order for t in texts)])[:-1]
    keep = np.ones(len(flat), bool)
    keep[(starts[:, None] + np.arange(order)[None, :]).ravel()] = False  # a start byte is not coded
    return key[keep[order:]]


def _part(suffix, parts: int):
    """The part of a context that ends in these two bytes; numbers, arrays and columns alike."""
    mixed = suffix * 40503 % 65536 * parts
    return F.floor(mixed / 65536) if isinstance(mixed, Column) else mixed >> 16


class Table:
    """Positions of unique 64-bit keys, by open addressing; probes are vectorised.

    Keys stand in parts, told by the two bytes above the lowest ``skip`` bits; each part has slots of
    its own, which hold positions inside the part.
    """

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.slots, self.keys = np.full(1 << bits, -1, np.int32), keys
        self.skip, self.part_of = 0, None
        self.shift, self.mask, self.slot, self.first = np.array([64 - bits], U), np.array([(1 << bits) - 1]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        left = np.arange(len(keys))
        at = self.home(keys, self.shift[0])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of those that want a slot, one gets it
            stay = self.slots[at] != left
            left, at = left[stay], (at[stay] + 1) & self.mask[0]

    @classmethod
    def of_parts(cls, keys: np.ndarray, slots: np.ndarray, parts: list[tuple[int, int, int]], n_parts: int, skip: int) -> Table:
        """parts: part, keys and slots in the order in which they stand; a part that isn't there is empty."""
        self = cls.__new__(cls)
        self.keys, self.slots, self.skip = keys, slots, skip
        self.part_of = _part(np.arange(1 << 16), n_parts)
        self.shift, self.mask, self.slot, self.first = np.full(n_parts, 63, U), np.zeros(n_parts, np.int64), np.full(n_parts, -1, np.int64), np.zeros(n_parts, np.int64)
        key = slot = 0
        for part, n_keys, n_slots in parts:
            self.shift[part], self.mask[part], self.slot[part], self.first[part] = 65 - n_slots.bit_length(), n_slots - 1, slot, key
            key, slot = key + n_keys, slot + n_slots
        return self

    @staticmethod
    def home(keys: np.ndarray, shift) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        part = self.part_of[((keys >> U(self.skip)) & U(0xFFFF)).astype(np.int64)] if self.part_of is not None else np.zeros(len(keys), np.int64)
        at, slot, first = self.home(keys, self.shift[part]), self.slot[part], self.first[part]
        left = np.flatnonzero(slot >= 0)
        while len(left):
            now = self.slots[slot[left] + at[left]]
            left, now = left[now >= 0], now[now >= 0] + first[left[now >= 0]]
            same = self.keys[now] == keys[left]
            out[left[same]] = now[same]
            left = left[~same]
            at[left] = (at[left] + 1) & self.mask[part[left]]
        return out


class Model:
    """levels: for each order from 0 the sorted (context, byte) keys and their counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], discount: float = 0.5):
        self.order = len(levels) - 1
        self.seen, self.log_count, self.contexts, self.fresh, self.after = [], [], [], [], []
        below: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
        for keys, counts in levels:
            context, start = np.unique(keys >> U(8), return_index=True)
            counts = counts - discount
            total = np.add.reduceat(counts, start) if len(keys) else counts
            number = np.diff(np.append(start, len(keys)))
            distinct = number * discount
            self.seen.append(Table(keys))
            self.log_count.append(np.log10(counts))
            self.contexts.append(Table(context))
            with np.errstate(divide="ignore", invalid="ignore"):
                self.fresh.append((np.log10(distinct / (total + distinct)), np.log10(total + distinct)))
                if below is None:
                    left = 256 - number  # bytes that the empty context doesn't know
                    self.after.append((np.zeros(len(context)), np.log10(np.maximum(left, 1))))
                else:
                    k, c, ctx, tot, dis = below
                    j = len(self.seen) - 1
                    parent_key = (keys & U((1 << (8 * j)) - 1)) if j else keys
                    at = np.minimum(np.searchsorted(k, parent_key), max(len(k) - 1, 0))
                    there = k[at] == parent_key if len(k) else np.zeros(len(keys), bool)
                    excluded = np.add.reduceat(np.where(there, c[at], 0), start)
                    n_excluded = np.add.reduceat(there * discount, start)
                    up = (context & U((1 << (8 * (j - 1))) - 1)) if j > 1 else np.zeros(len(context), U)
                    p = np.minimum(np.searchsorted(ctx, up), max(len(ctx) - 1, 0))
                    known = ctx[p] == up if len(ctx) else np.zeros(len(context), bool)
                    escapes = np.where(known, dis[p] - n_excluded, 0)
                    whole = np.where(known, tot[p] - excluded, 0) + escapes
                    # nothing left in the parent: the escape from it is certain
                    self.after.append((np.where(whole > 1e-9, np.log10(escapes / whole), 0.0), np.where(whole > 1e-9, np.log10(whole), 0.0)))
            below = keys, counts, context, total, distinct

    def log10(self, key: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(key))
        left, via = np.arange(len(key)), np.full(len(key), -1)
        for j in range(self.order, -1, -1):
            part = key & U((1 << (8 * (j + 1))) - 1)
            hit = self.seen[j].find(part)
            own = self.contexts[j].find(part >> U(8))
            escape, whole = self.fresh[j]
            if j == self.order:
                fresh = np.ones(len(part), bool)
            else:
                fresh = via < 0
            take, esc = np.zeros(len(part)), np.zeros(len(part))
            at = fresh & (own >= 0)
            take[at], esc[at] = whole[own[at]], escape[own[at]]
            if j < self.order:
                escape_after, whole_after = self.after[j + 1]
                take[~fresh], esc[~fresh] = whole_after[via[~fresh]], escape_after[via[~fresh]]
            found = hit >= 0
            out[left[found]] += self.log_count[j][hit[found]] - take[found]
            miss = ~found
            out[left[miss]] += esc[miss]
            left, key, via = left[miss], part[miss], own[miss]
            if not len(left):
                return out
        unknown = self.after[0][1][0] if len(self.after[0][1]) else math.log10(256)
        out[left] -= np.where(via >= 0, unknown, math.log10(256))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([self._score(part) for part in _slices(texts, 2 << 20)] or [np.zeros(0)])

    def _score(self, texts: list[bytes]) -> np.ndarray:
        keys, at = np.unique(grams(texts, self.order), return_inverse=True)
        sums = np.append(0.0, np.cumsum(self.log10(keys)[at]))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return sums[ends] - sums[ends - [len(t) + 1 for t in texts]]


def gather(training: DataFrame, ppm: Ppm) -> DataFrame:
    """word, gram, n: how often each word (END for ends) and each longest gram occur in ``training(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            texts = common.texts(batch)
            words: Counter[bytes] = Counter()
            for t in texts:
                words.update(t.lower().split())
            words[END.encode()] = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.binary()).cast(pa.string()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "gram", "n"]
            )
            for part in _slices(texts, 4 << 20):
                new, n = np.unique(grams(part, ppm.order), return_counts=True)
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], names=["word", "gram", "n"])

    return common.map_batches(training.select("text"), run, "word string, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def levels_of(keys: np.ndarray, counts: np.ndarray, orders: Iterable[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The trie's levels: shorter contexts' counts are sums over all longer grams."""
    out = []
    for j in orders:
        level, at = np.unique(keys & U((1 << (8 * (j + 1))) - 1), return_inverse=True)
        out.append((level, np.bincount(at, weights=counts, minlength=len(level)).astype(np.int64)))
    return out


#: A part's arrays of one level: keys and their slots, log10 of counts, contexts and their slots, and four rates of each.
ARRAYS = {"keys": U, "key_slots": np.int32, "log_count": np.float64, "contexts": U, "context_slots": np.int32, "rates": np.float64}
LOW = 2  # levels of less than two bytes have 65,536 keys at most and are sent with the task


@dataclass(frozen=True)
class Trie:
    """What a task needs to open the model: the low levels, and files and parts of the others."""

    low: list[tuple[np.ndarray, np.ndarray]]
    tag: str
    folder: str | None  # None: files were shipped
    n_parts: int
    parts: dict[int, list[tuple[int, int, int, int, int]]]  # level: part, keys, key slots, contexts, context slots

    def open(self) -> Model:
        model = Model(self.low)
        for j, parts in sorted(self.parts.items()):
            got = {}
            for name, kind in ARRAYS.items():
                file = f"{self.tag}-{j}-{name}"
                path = os.path.join(self.folder, file) if self.folder else SparkFiles.get(file)
                got[name] = np.memmap(path, kind, "r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, kind)
            rates = got["rates"].reshape(-1, 4)
            model.seen.append(Table.of_parts(got["keys"], got["key_slots"], [(p, k, s) for p, k, s, _, _ in parts], self.n_parts, 8))
            model.contexts.append(Table.of_parts(got["contexts"], got["context_slots"], [(p, k, s) for p, _, _, k, s in parts], self.n_parts, 0))
            model.log_count.append(got["log_count"])
            model.fresh.append((rates[:, 0], rates[:, 1]))
            model.after.append((rates[:, 2], rates[:, 3]))
            model.order = j
        return model


def build(gathered: DataFrame, ppm: Ppm) -> Trie:
    """Build the whole trie in parts and write its arrays to files that every executor can open."""
    spark = gathered.sparkSession
    every = gathered.where(F.col("gram").isNotNull()).select("gram", "n")
    mask = (1 << (8 * min(LOW, ppm.order + 1))) - 1
    got = every.groupBy(F.col("gram").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 2**16
    low = levels_of(got.column("key").to_numpy().astype(U), got.column("n").to_numpy(), range(min(LOW, ppm.order + 1)))
    n_parts = min(1 << 16, 1 + every.count() // ppm.part_keys)
    orders = range(LOW, ppm.order + 1)
    tag, parts = uuid.uuid4().hex, {j: [] for j in orders}
    if not orders:
        return Trie(low, tag, None, n_parts, parts)

    def one_part(table: pa.Table) -> pa.Table:
        keys, counts = table.column("gram").to_numpy().astype(U), table.column("n").to_numpy()
        model = Model(low + levels_of(keys, counts, orders))
        rows = []
        for j in orders:
            rates = np.stack([*model.fresh[j], *model.after[j]], axis=1)
            arrays = (model.seen[j].keys, model.seen[j].slots, model.log_count[j], model.contexts[j].keys, model.contexts[j].slots, rates)
            rows.append({"part": table.column("part")[0].as_py(), "level": j} | {name: a.tobytes() for name, a in zip(ARRAYS, arrays, strict=True)})
        return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("level", pa.int64()), *((name, pa.binary()) for name in ARRAYS)]))

    part = _part(F.shiftrightunsigned("gram", 8).bitwiseAND(0xFFFF), n_parts).cast("long")
    split = every.withColumn("part", part).repartition(n_parts, "part").groupBy("part")
    built = common.materialize(split.applyInArrow(one_part, "part long, level long, " + ", ".join(f"{name} binary" for name in ARRAYS)), "trie")
    shared = urlsplit(common.shared_dir(spark))
    folder = os.path.join(unquote(shared.path), f"verifold-trie-{tag}") if shared.scheme in ("", "file") else None
    if folder:
        os.makedirs(folder)
    local = folder or tempfile.mkdtemp(prefix="trie-")
    files = {(j, name): open(os.path.join(local, f"{tag}-{j}-{name}"), "wb") for j in orders for name in ARRAYS}
    for r in built.toLocalIterator():
        for name in ARRAYS:
            files[r.level, name].write(r[name])
        parts[r.level].append((r.part, len(r.keys) // 8, len(r.key_slots) // 4, len(r.contexts) // 8, len(r.context_slots) // 4))
    for f in files.values():
        f.close()
        if not folder:
            spark.sparkContext.addFile(f.name)
    common.discard(built)
    return Trie(low, tag, folder, n_parts, parts)


_models: dict[str, Model] = {}


def scores(docs: DataFrame, train, ppm: Ppm = Ppm()) -> DataFrame:
    """A row for each document of ``docs(doc_id, text)``; train(doc_id) marks those to learn from.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    gathered = common.materialize(gather(docs.where(train(F.col("doc_id"))), ppm), "gathered")
    words = gathered.where(F.col("word").isNotNull()).select("word", F.col("n").alias("c"))
    n_all, v_all = (int(x or 0) for x in words.agg(F.sum("c"), F.count("*")).first())
    s, below = ppm.smoothing, math.log10(n_all + ppm.smoothing * (v_all + 1))
    top = words.orderBy(F.desc("c"), "word").limit(ppm.frequent_words).toArrow()
    frequent = dict(zip((w.encode() for w in top.column("word").to_pylist()), top.column("c").to_pylist(), strict=True))
    ends = words.where(F.col("word") == END).select("c").first()
    frequent[END.encode()] = ends.c if ends else 0
    trie = build(gathered, ppm)
    held = spark.sparkContext.broadcast((frequent, trie))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, trie = held.value
        if trie.tag not in _models:
            _models.clear()
            _models[trie.tag] = trie.open()
        model = _models[trie.tag]
        logs = {w: math.log10(c + s) for w, c in counts.items()}
        end = counts[END.encode()]
        for batch in batches:
            texts = common.texts(batch)
            own, n, known, base, rare = batch.column(2).to_pylist(), [], [], [], []
            for key, text in zip(own, texts, strict=True):
                tokens = Counter(text.lower().split())
                total = hits = 0
                score = math.log10(end + s)
                for w, k in tokens.items():
                    total += k
                    if (log := logs.get(w)) is not None:
                        hits += k
                        score += k * log
                    else:
                        rare.append((w, key, k))
                n.append(total + 1)
                known.append(hits + (end > 0))
                base.append(score)
            m, r = len(texts), len(rare)
            w, keys, k = zip(*rare, strict=True) if rare else ((), (), ())
            nulls = lambda kind, size: pa.nulls(size, kind)
            first = [batch.column(0).cast(pa.int64()), batch.column(2), nulls(pa.string(), m), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model.score(texts))]
            rest = [nulls(pa.int64(), r), pa.array(keys, pa.int64()), pa.array(w, pa.binary()).cast(pa.string()), pa.array(k, pa.int64()), *(nulls(t, r) for t in (pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(first, rest, strict=True)], names=["doc_id", "row", "word", "n", "known", "base", "score"])

    # Rows are told apart by a hash of id and text; rows equal in both share their sums.
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    out = common.materialize(common.map_batches(rows, run, "doc_id long, row long, word string, n long, known long, base double, score double"), "scored")
    per_doc = out.where(F.col("word").isNull())
    met = out.where(F.col("word").isNotNull()).select("word", "row", "n").join(words, "word", "left")
    more = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + s)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    copies = per_doc.groupBy("row").agg(F.count("*").alias("copies"))
    more = more.join(copies, "row")
    return per_doc.join(more, "row", "left").select(
        "doc_id",
        (~train(F.col("doc_id"))).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce((F.col("more_known") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0)) - F.col("n") * F.lit(below)).alias("base_score"),
        "score",
    )
