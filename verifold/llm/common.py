"""What the training-data operators share: reading, bounded Arrow batches, cutting lineage.

A *word* is a run of bytes outside 0x20 and 0x09-0x0D; ``bytes.split()`` cuts exactly there.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same words for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch: a batch of the longest texts still fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


#: What an entry of a Memory takes besides its key's and value's bytes, about.
ENTRY = 200
#: The same for a Lexicon, with the table of hashes that a search builds.
LEXICON_ENTRY = 60


class Memory(dict):
    """A dict of two generations, each of so many bytes: when the young one is full it becomes the old one.

    Keys, and values that are bytes or text, count by their length.
    """

    def __init__(self, most: int = 40 << 20):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError: not known
        self.store([key], [value])
        return value

    def missing(self, keys) -> list:
        """Those that neither generation knows; what the old one knows comes to the young one."""
        new = [k for k in keys if k not in self]
        if self.old and new:
            met = [k for k in new if k in self.old]
            self.store(met, [self.old[k] for k in met])
            new = [k for k in new if k not in self]
        return new

    def store(self, keys: list, values: list) -> None:
        self.update(zip(keys, values, strict=True))
        self.held += ENTRY * len(keys) + sum(map(len, keys))
        if values and isinstance(values[0], (bytes, str)):
            self.held += sum(map(len, values))

    def turn(self) -> None:
        if self.held > self.most:
            self.old = dict(self) if self.held < 2 * self.most else {}
            self.clear()
            self.held = 0


BYTES = pa.large_binary()


def packed(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Pieces of one array's bytes that end at these items."""
    offsets = np.append(0, ends).astype(np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(BYTES, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def offsets_of(column: pa.LargeBinaryArray) -> np.ndarray:
    """Where the items of a column without nulls begin in its data, and where the last ends."""
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)


def data_of(column: pa.LargeBinaryArray) -> memoryview:
    return memoryview(column.buffers()[2] or b"")


def gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n items of flat from each place on, in a row."""
    ends = np.cumsum(n)
    return flat[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Lexicon:
    """Byte strings and what ``learn`` finds of them, as two Arrow columns: some 60 bytes an entry beside their own.

    Beyond ``most`` bytes those asked for longest ago are forgotten, which only costs work.
    """

    def __init__(self, learn: Callable[[pa.LargeBinaryArray], pa.LargeBinaryArray], most: int):
        self.learn, self.most, self.calls = learn, most, 0
        self.keys = self.values = pa.array([], BYTES)
        self.used = np.zeros(0, np.int64)

    def of(self, keys: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The values of distinct keys."""
        self.calls += 1
        at = pc.index_in(keys, value_set=self.keys)
        unknown = at.is_null()
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = keys.filter(unknown)
        if len(new):
            at[unknown.to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(len(new))
            self.keys, self.values = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.values, self.learn(new)])
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[at] = self.calls
        found = self.values.take(pa.array(at))
        sizes = np.diff(offsets_of(self.keys)) + np.diff(offsets_of(self.values)) + LEXICON_ENTRY
        if sizes.sum() > self.most:
            latest = np.argsort(-self.used, kind="stable")
            keep = np.sort(latest[np.cumsum(sizes[latest]) <= self.most * 3 // 4])
            self.keys, self.values, self.used = self.keys.take(pa.array(keep)), self.values.take(pa.array(keep)), self.used[keep]
        return found


def slices(items: Iterable, most: int, size: Callable[..., int]) -> Iterator[list]:
    """Items in order, of about so much size at a time."""
    part, held = [], 0
    for x in items:
        part.append(x)
        held += size(x)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; others, whatever they are called, are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def trim() -> None:
    """Give memory that Arrow and the C library hold free back to the system: workers live on, and so would it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, with trim() when its task ends, however it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            trim()

    return run


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow under the bounds of a batch, which are the same for every operator; smaller ones of the session stay."""
    spark = df.sparkSession
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        try:
            now = spark.conf.get(key).lower().removesuffix("b")
        except Exception:  # a Spark without that setting
            continue
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    return df.mapInArrow(trimmed(fn), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where none is configured, a temporary one of a local master (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            path = have.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            path = tempfile.mkdtemp(prefix="verifold-")
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "part", **options: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verifold-{name}-{uuid.uuid4().hex}"
    trim()  # what earlier steps took in the driver's Python isn't needed while this one runs
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing needs any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/verifold-" in root:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    at = batch.schema.get_field_index(column)
    return [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]


def n_words(column) -> F.Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
