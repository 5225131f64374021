"""Token ids as Parquet files of list columns.

``write`` encodes documents in ascending doc_id order; a file holds one range of ids with the
columns doc_id, offset (ids before the document in its file), n_tokens and ids.  Values are
dictionary encoded while a dictionary pays and delta encoded after that; row groups and pages
have set sizes, and the column and offset indexes of the pages are written, so that
``metadata`` reads no token and ``tokens`` only the pages of the documents asked for.

The texts are dealt by doc_id range once; encoding, writing and the offsets need no other
shuffle.  A document's place in the whole is its file's place plus its offset.

Defined results: a null or empty text is the end id alone; null doc_ids come first; equal
doc_ids are ordered by a hash of their text, then by the text; other columns are never read; an empty table gives a
folder without rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import BYTES, Lexicon

SCHEMA = "doc_id long, offset long, n_tokens long, ids array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "1000",
}


#: Marks that may be cut off a word's end.
MARKS = b".,;:!?*%&$#"


ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


def stem_of(word: bytes) -> tuple[bytes, bytes]:
    """A word as two that the library tokenises alike: lower-cased letters, and sentence marks after them.

    A run of marks after a letter or digit is a pre-token of its own, and the normaliser lowers
    case; words that may hold a special token are left as they are.
    """
    if b"<|" in word:
        return word, b""
    stem = word.rstrip(MARKS)
    if stem and stem != word and (stem[-1:].isalnum() or stem[-1] >= 128 and stem.decode()[-1].lower().isalpha()):
        return stem.lower(), word[len(stem) :]
    return word.lower(), b""


class Encoder:
    """A tokenizer file of the tokenizers library, applied to distinct words.

    ASCII white space separates pre-tokens of the vocabulary and its normaliser joins nothing
    across it, so a text's ids are its words' ids in order; ``check`` holds a batch against the
    library's own answer for whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.stems = Lexicon(self.learn, 64 << 20)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's number of them."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = cut.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), self.words(coded.dictionary)
        bounds = common.offsets_of(words) // 4
        n = np.diff(bounds)[codes]
        ids = common.gather(np.frombuffer(common.data_of(words), "<u4").astype(np.int32), bounds[:-1][codes], n)
        upto = np.append(0, np.cumsum(n))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return (ids, np.diff(upto)) if end is None else (np.insert(ids, upto[1:], end), np.diff(upto) + 1)

    def words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The packed ids of distinct words, each as two parts; see stem_of, which sees to words of other than ASCII before their marks."""
        special = pc.match_substring(words, "<|")
        stems = pc.ascii_rtrim(words, characters=MARKS.decode())
        ends, stop = common.offsets_of(words), pc.binary_length(stems).to_numpy()
        size, raw = np.diff(ends), np.frombuffer(common.data_of(words), np.uint8)
        ends = ends[:-1]
        lower = np.frombuffer(common.data_of(pc.ascii_lower(words)), np.uint8)
        text = np.where(np.repeat(special.to_numpy(zero_copy_only=False), size), raw[ends[0] : ends[0] + size.sum()], lower) if len(words) else lower
        marked = (0 < stop) & (stop < size) & ~special.to_numpy(zero_copy_only=False)
        before = np.zeros(len(words), np.uint8)
        before[marked] = raw[(ends + stop - 1)[marked]]
        parts = marked & ALNUM[before]
        for i in np.flatnonzero(marked & (before >= 128)).tolist():
            parts[i] = bool(stem_of(words[i].as_py().encode())[1])
        at = np.cumsum(size) - size
        cuts = np.stack([at + np.where(parts, stop, size), at + size], 1).ravel()
        halves = common.packed(text, cuts).dictionary_encode()
        ids = self.stems.of(halves.dictionary).take(halves.indices)
        return common.packed(np.frombuffer(common.data_of(ids), "<u4"), common.offsets_of(ids)[2::2] // 4)

    def learn(self, stems: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The packed ids of stems.

        A word of letters is one pre-token and ends with the one id that ends a word, so such
        words are encoded many to a text; the others one by one.
        """
        new = stems.to_pylist()
        known: dict[bytes, bytes] = {b"": b""}
        letters = [w for w in new if w.isalpha() or (not w.isascii() and (t := w.decode()).isalpha() and t.lower().isalpha())]
        for at in range(0, len(letters), 20_000):
            part = letters[at : at + 20_000]
            joined = [b" ".join(part[i : i + 200]).decode() for i in range(0, len(part), 200)]
            known.update(zip(part, self.ended(part, np.fromiter(chain.from_iterable(e.ids for e in self.library.encode_batch_fast(joined, add_special_tokens=False)), np.int64)), strict=True))
        rest = [w for w in new if w not in known]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            ids = [e.ids for e in self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
            known.update(zip(part, [np.array(x, "<u4").tobytes() for x in ids], strict=True))
        return pa.array(list(map(known.__getitem__, new)), BYTES)

    def ended(self, words: list[bytes], flat: np.ndarray) -> list[bytes]:
        """Their ids cut into words by the ids that end one."""
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(words):  # the vocabulary doesn't end words as expected
            return [np.array(self.library.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words]
        packed, cuts = flat.astype("<u4").tobytes(), (4 * np.append(0, ends)).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def check(self, texts: list[str]) -> bool:
        ids, sizes = self.encode(pa.array(texts, pa.large_string()))
        whole = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
        return sizes.tolist() == list(map(len, whole)) and ids.tolist() == list(chain.from_iterable(whole))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's to deal out
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, vocabulary: str, end: int, path: str) -> None:
    """Encode ``docs(doc_id, text)`` into Parquet files under path."""
    spark = docs.sparkSession
    arrow = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            ids, sizes = encoder(vocabulary).encode(batch.column(1), end)
            offsets = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(offsets), pa.array(sizes), lists], schema=arrow)

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text")
    common.map_batches(ordered, run, SCHEMA).write.options(**LAYOUT).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _file_starts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: how many ids the files before it hold.  Token pages are not read."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    sums = _read(spark, path).select(number.alias("file_number"), "n_tokens").groupBy("file_number").agg(F.sum("n_tokens").alias("file_ids"))
    earlier = Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file_number", F.coalesce(F.sum("file_ids").over(earlier), F.lit(0)).alias("file_start"))


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    return rows.join(_file_starts(spark, path), "file_number").withColumn("start", F.col("file_start") + F.col("offset")).drop("file_number", "file_start", "offset")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, start of every document; reads no token."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return _placed(_read(spark, path).select("doc_id", "n_tokens", "offset", number.alias("file_number")), spark, path)


def tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id, ids of the documents with first <= doc_id <= last; other pages are skipped."""
    return _read(spark, path).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files."""
    arrow = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file_number", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(3)], schema=arrow)

    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    rows = common.map_batches(
        _read(spark, path).select("doc_id", "offset", "ids", number.alias("file_number")), run, "doc_id long, offset long, n_tokens long, ids_crc32 long, file_number long"
    )
    return _placed(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def scratch_path(spark: SparkSession) -> str:
    return f"{common.shared_dir(spark)}/verifold-tokens-{uuid.uuid4().hex}"
