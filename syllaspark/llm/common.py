"""What the operators share: stored intermediate tables, code shipping, Arrow batch cutting, vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
U64 = np.uint64
#: Bytes of an Arrow batch, about.
BATCH_BYTES = "8m"

# ---------------------------------------------------------------- stored tables


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints/syllaspark"
    return f"{base.rstrip('/')}/stored"


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df, written once to the shared folder and read back: the lineage ends there and no executor's loss costs a recomputation."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stored_path", None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    def clean() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            pass

    atexit.register(clean)


# ---------------------------------------------------------------- code


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the executors' Python workers, once a context; and bounds the Arrow batches that they get by bytes, as texts may be long."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_syllaspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), "syllaspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._syllaspark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, part_bytes: int) -> int:
    """Parts for a shuffle that grows with df: one for each part_bytes of its input where Spark knows its size, the session's number at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(n_partitions(df.sparkSession), size // part_bytes if size < 1 << 52 else 0)


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 is the held-out fold. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def repeated_ids(docs: DataFrame, doc_id: str) -> DataFrame | None:
    """_again: the ids that several rows have, null included; None if there are none. Only the ids are read."""
    again = stored(docs.groupBy(F.col(doc_id).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again"))
    return None if again.isEmpty() else again


# ---------------------------------------------------------------- Arrow batches


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.StringArray:
    """A batch's text column, nulls as ''."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def byte_offsets(col: pa.StringArray) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)


#: What empties the caches that a Python worker keeps from task to task.
WORKER_CACHES: list[Callable[[], object]] = []


def tidy(keep: bool = False) -> None:
    """Gives memory that a task no longer uses back to the system, as workers outlive their tasks; keep: not the caches."""
    for clear in [] if keep else WORKER_CACHES:
        clear()
    _Powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def cut(batches: Iterable[pa.RecordBatch], name: str = "text", most: int = 4_000_000, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about `most` bytes of text; a longer text is a slice of its own. keep: the worker's caches stay."""
    tidy(keep)
    yield from _slices(batches, name, most)
    tidy(keep)


def _slices(batches: Iterable[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = byte_offsets(texts_of(batch, name))
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


# ---------------------------------------------------------------- word hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    n = 0
    up = down = np.zeros(0, U64)

    @classmethod
    def clear(cls) -> None:
        cls.n = 0
        cls.up = cls.down = np.zeros(0, U64)

    @staticmethod
    def _made(base: int, n: int) -> np.ndarray:
        out = np.ones(n + 1, U64)
        have = 1
        while have <= n:  # in place, as long texts need long tables
            more = min(have, n + 1 - have)
            np.multiply(out[:more], U64(pow(base, have, 1 << 64)), out=out[have : have + more])
            have += more
        return out

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = max(n, 1 << 20)
            cls.up, cls.down = (cls._made(x, cls.n) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up, cls.down


@dataclass
class Words:
    """The words of some texts. start, end: byte places in buf; first: for each text the index of its first word, and the number of words last; text_at: byte places of the texts."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_at: np.ndarray
    sums: np.ndarray

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges, of the words by default; equal bytes have equal hashes in any batch."""
        s, e = (self.start, self.end) if start is None else (start, end)
        _, down = _Powers.of(len(self.buf))
        return mix((self.sums[e] - self.sums[s]) * down[s] + (e - s).astype(U64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


@functools.lru_cache(8)
def _is_word(separators: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


def words_of(texts: pa.StringArray, separators: bytes = SPACE, lower: bool = False) -> Words:
    """Finds and hashes the words (runs of bytes that are no separators) of all texts at once, without Python strings."""
    at = byte_offsets(texts)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if lower:
        buf = _LOWER[buf]
    word = _is_word(separators)[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0] = False
    before[1:] = word
    before[at] = False  # a text's first byte follows nothing
    after = np.empty(len(buf) + 1, bool)
    after[:-1] = word
    after[-1] = False
    start = np.flatnonzero(after & ~before)
    after[at] = False
    before[1:] = word
    before[0] = False
    end = np.flatnonzero(before & ~after)
    up, _ = _Powers.of(len(buf))
    sums = np.empty(len(buf) + 1, U64)
    sums[0] = 0
    np.take(_VALUES, buf, out=sums[1:])
    np.multiply(sums[1:], up[: len(buf)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return Words(buf, start, end, np.searchsorted(start, at), at, sums)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive items of h (len(h) - n + 1 of them, at least 0), in about log n passes."""
    if len(h) < n:
        return np.zeros(0, U64)
    base, have, size, done = U64(_BASE | 1), h, 1, None
    rest, have_done = n, 0
    power = {1: base}
    while True:
        if rest & size:
            if done is None:
                done, have_done = have, size
            else:  # [what is done][size more]
                m = len(h) - (have_done + size) + 1
                done = done[:m] * power[size] + have[have_done : have_done + m]
                have_done += size
            rest -= size
        if not rest:
            return mix(done[: len(h) - n + 1] + U64(n))
        have = have[:-size] * power[size] + have[size:]
        power[2 * size] = U64(int(power[size]) ** 2 & 0xFFFFFFFFFFFFFFFF)
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w consecutive items."""
    have, size = x, 1
    while 2 * size <= w:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return have if size == w else np.minimum(have[: len(x) - w + 1], have[w - size :])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... (lengths[0] of them), starts[1], ... in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
