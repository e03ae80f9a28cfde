"""Packing documents into sequences: best-fit decreasing by partition, certified by lower bounds, with exchanges between partitions that have gaps."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, ship, stored, table, texts_of

CAPACITY, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Pieces of a partition that are packed together, about.
PARTITION_PIECES = 20_000


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; null texts count as empty (one piece: the end id)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import piece_rows

        for b in cut(batches, "_text", 6_000_000, keep=True):
            rows = piece_rows(texts_of(b, "_text"), path, end_id, capacity)
            which, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return ids.mapInArrow(run, f"doc_id {ids.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the largest of two families of dual feasible functions' bounds.

    For a threshold t up to half the capacity: an item longer than capacity - t counts as a whole bin, one shorter
    than t as nothing, others by their length. And for k from 1 to 32: no bin holds more than k items that are
    longer than capacity / (k + 1).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    up_to, weight = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    t = np.arange(capacity // 2 + 1)
    large = up_to[capacity] - up_to[capacity - t]
    below = np.where(t > 0, weight[np.maximum(t - 1, 0)], 0)
    middle = weight[capacity - t] - below
    best = int((large + -(-middle // capacity)).max())
    k = np.arange(1, 33)
    over = up_to[capacity] - up_to[capacity // (k + 1)]
    return max(best, int((-(-over // k)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill. Longest first, each into the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set if a bin has room r
    fill: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if r > n:
            room[r - n].append(b)
            free |= 1 << (r - n)
    return bins, offsets, np.array(fill, np.int64)


def _pack_groups(items: DataFrame, capacity: int) -> DataFrame:
    """Packs each group g of items; adds bin (unique in all groups of a round), offset, the bin's fill, and the group's gap: bins beyond the bound."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        lengths = g["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        return g[["doc_id", "piece", "start", "length", "ids_crc32", "g"]].assign(bin=bins, offset=offsets, fill=fill[bins], gap=len(fill) - lower_bound(lengths, capacity))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema if f.name in ("doc_id", "piece", "start", "length", "ids_crc32", "g"))
    return items.groupBy("g").applyInPandas(run, f"{fields}, bin long, offset long, fill long, gap long")


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PARTITION_PIECES) -> DataFrame:
    """Adds sequence_id, offset and certified to pieces (doc_id, piece, start, length, ids_crc32); lengths are 1 to capacity.

    Partitions of about `per_partition` pieces are packed by best-fit decreasing. A partition whose bin count equals
    its lower bound is certified: no packing of its pieces needs fewer bins. The others keep their full bins; the
    pieces of their bins with room are exchanged: dealt anew into fewer partitions, and packed again, until all are
    certified, or only one partition is left, or a round saves no bin. certified: whether the sequence is full or from
    a partition that was certified when it was packed. Pieces of equal rows are packed as any others.
    """
    items = stored(items)
    done: list[DataFrame] = []
    left = items
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    bins_before = None
    for k in itertools.count():
        n = left.count()
        groups = max(1, -(-n // per_partition))
        dealt = left.select(*columns).withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.lit(k)), F.lit(groups)).cast("int"))
        packed = stored(_pack_groups(dealt, capacity))
        open_ = (F.col("gap") > 0) & (F.col("fill") < capacity)
        # The round, the group and its bin in bits of their own, so that no two sequences share a number.
        sequence = F.lit(k).cast("long") * (1 << 57) + F.col("g").cast("long") * (1 << 28) + F.col("bin")
        heads = packed.where(F.col("offset") == 0).agg(F.count(F.lit(1)).alias("all"), F.count_if(open_).alias("open")).first()
        last = groups == 1 or not heads["open"] or (bins_before is not None and heads["all"] >= bins_before)
        bins_before = heads["open"]
        certified = (F.col("gap") == 0) | (F.col("fill") == capacity)
        done.append((packed if last else packed.where(~open_)).select(*columns, sequence.alias("sequence_id"), "offset", certified.alias("certified")))
        if left is items:
            forget(items)
        if last:
            break
        left = packed.where(open_)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified of every piece of docs' texts.

    Rows that repeat an id, and rows with a null id, are packed one by one. Extra columns are not read; an empty table
    gives no pieces.
    """
    import public_tokenizers

    return pack(pieces(docs, path or public_tokenizers.path(VOCABULARY)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


#: Packing has no SQL form; the query is tested against the tokenizer itself and the bound.
SQL = None
