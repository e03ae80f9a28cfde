"""Benchmark decontamination: a distributed positional inverted index of the training text, searched for benchmark windows."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, stored, table, texts_of, words_of

WINDOW, MIN_ITEMS = 8, 2
#: Bytes of text in a segment of the index, about; bytes of benchmark text that are broadcast at once.
SEGMENT_BYTES, BLOCK_BYTES = 6_000_000, 32_000_000
#: ASCII characters that are no letters or digits, once A-Z are lower-cased.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_INDEX = "doc_id array<{id}>, first binary, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per segment (some documents): their ids and word counts, the distinct terms' hashes in order, and each term's positions in order.

    Positions number the words of the segment's documents in a row. Every word of every whole text is posted. The
    index is split by documents, so building and searching it need no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text", SEGMENT_BYTES):
            w = words_of(texts_of(b, "_text"), SEPARATORS, lower=True)
            h = w.hashes()
            order = np.argsort(h, kind="stable")
            h = h[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(h)))
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            packed = [w.first.astype(np.int32), h[new], counts.astype(np.int32), order.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["doc_id", "first", "terms", "counts", "positions"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return ids.mapInArrow(run, _INDEX.format(id=ids.schema[0].dataType.simpleString()))


class Segment:
    """One row of the index."""

    def __init__(self, first: bytes, terms: bytes, counts: bytes, positions: bytes) -> None:
        self.first, self.terms = np.frombuffer(first, np.int32), np.frombuffer(terms, np.uint64)
        self.counts, self.positions = np.frombuffer(counts, np.int32), np.frombuffer(positions, np.int32)
        self.at = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])

    def rows_of(self, terms: np.ndarray) -> np.ndarray:
        """The terms' rows, -1 for those that don't occur."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def postings(self, row: int) -> np.ndarray:
        return self.positions[self.at[row] : self.at[row + 1]]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1

    def phrase(self, rows: np.ndarray) -> np.ndarray:
        """Starts of all occurrences of a phrase in one document: the terms' lists less their offsets, intersected from the rarest on."""
        order = np.argsort(self.counts[rows], kind="stable")
        starts = self.postings(rows[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                return starts
            own, want = self.postings(rows[k]), starts + k
            starts = starts[own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want]
        starts = starts[(starts >= 0)]
        return starts[self.doc_of(starts) == self.doc_of(starts + len(rows) - 1)]

    def near(self, rows: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term that have each other term within `span` words in the same document, in any order."""
        order = np.argsort(self.counts[rows], kind="stable")
        at = self.postings(rows[order[0]])
        doc = self.doc_of(at)
        for k in order[1:]:
            own = self.postings(rows[k])
            low = np.maximum(at - span, self.first[doc])
            high = np.minimum(at + span + 1, self.first[doc + 1])
            keep = np.searchsorted(own, low) < np.searchsorted(own, high)
            at, doc = at[keep], doc[keep]
        return at


@dataclass
class Queries:
    """Distinct windows of some items. terms: their hashes in a row; at: where each window's begin; items: pairs of window and item."""

    terms: np.ndarray
    at: np.ndarray
    window: np.ndarray
    item: np.ndarray
    ids: list[str]

    def names(self, window: int) -> list[str]:
        """The ids of the items that have a window."""
        own = self.item[np.searchsorted(self.window, window) : np.searchsorted(self.window, window, side="right")]
        return [self.ids[i] for i in own if i >= 0]


def make_queries(items: list[tuple[object, str | None]], n: int = WINDOW, short: bool = True) -> Queries:
    """Windows of n consecutive words of each item; an item of fewer, but not none, is one window (not if short is false). The windows of items with a null id have no item (-1)."""
    items = [(None if i is None else str(i), x or "") for i, x in items]
    ids = sorted({i for i, _ in items if i is not None})
    number = {None: -1} | {x: k for k, x in enumerate(ids)}
    w = words_of(pa.array([x for _, x in items], pa.string()), SEPARATORS, lower=True)
    h = w.hashes()
    seen: dict[tuple[int, ...], int] = {}
    pairs = set()
    for k, (i, _) in enumerate(items):
        own = h[w.first[k] : w.first[k + 1]].tolist()
        for j in range(max(1 if short else 0, len(own) - n + 1) if own else 0):
            pairs.add((seen.setdefault(tuple(own[j : j + n]), len(seen)), number[i]))
    at = np.concatenate([[0], np.cumsum([len(x) for x in seen])]).astype(np.int64)
    window, item = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
    return Queries(np.array([t for x in seen for t in x], np.uint64), at, window, item, ids)


def search_segment(seg: Segment, q: Queries, span: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(window, places where it occurs) of the windows that occur in a segment."""
    rows = seg.rows_of(q.terms)
    if not len(rows):
        return
    for k in np.flatnonzero(np.minimum.reduceat(rows, q.at[:-1]) >= 0):
        own = rows[q.at[k] : q.at[k + 1]]
        found = seg.phrase(own) if span is None else seg.near(own, span)
        if len(found):
            yield int(k), found


def query_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", short: bool = True) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark's windows in blocks of items of at most about BLOCK_BYTES, each broadcast as it is asked for; and whether it is the only one."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("x"))
    total = items.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    n = 1 + total // BLOCK_BYTES
    blocks = (items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) for k in range(n))
    for b in blocks:
        yield spark.sparkContext.broadcast(make_queries([(r.i, r.x) for r in b.collect()], short=short)), n == 1


def _pass(run_of, index: DataFrame, benchmark: DataFrame, schema: str, short: bool = True) -> list[DataFrame]:
    """The index searched for one block of the benchmark after the other. Of several, each block's results are written before the next block is broadcast, so only one is in memory."""
    out = []
    for block, alone in query_blocks(benchmark, short=short):
        found = index.mapInArrow(run_of(block), schema)
        if not alone:
            found = stored(found)
            block.destroy()
        out.append(found)
    return out


def search(index: DataFrame, benchmark: DataFrame, span: int | None = None) -> DataFrame:
    """doc_id, item_id, position of every exact occurrence (span None) or proximity match of every window of every item. Items with a null id aren't searched for."""
    ship(index.sparkSession)
    kind = index.schema["doc_id"].dataType.elementType.simpleString()

    def run_of(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = block.value
            for b in batches:
                for r in b.to_pylist():
                    seg = Segment(r["first"], r["terms"], r["counts"], r["positions"])
                    rows = []
                    for k, found in search_segment(seg, q, span):
                        doc = seg.doc_of(found)
                        rows += [(r["doc_id"][d], x, p) for d, p in zip(doc.tolist(), (found - seg.first[doc]).tolist(), strict=True) for x in q.names(k)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "position"])

        return run

    return functools.reduce(DataFrame.unionByName, _pass(run_of, index, benchmark, f"doc_id {kind}, item_id string, position long"))


def contamination(index: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS, short: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document of the index (short: items of fewer than WINDOW words count too).

    With one block of benchmark text that is one narrow pass. With more, each pass leaves a bit per word that was hit
    and the items of each document; both are put together by document.
    """
    ship(index.sparkSession)
    kind = index.schema["doc_id"].dataType.elementType.simpleString()

    def run_of(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = block.value
            for b in batches:
                for k in range(b.num_rows):
                    row = b.slice(k, 1)
                    ids = row.column(0).flatten()
                    packed = [row.column(c)[0].as_py() for c in range(1, 5)]
                    seg = Segment(*packed)
                    n = len(ids)
                    edge = np.zeros(int(seg.first[-1]) + 1, np.int32)
                    items: dict[int, set[str]] = {}
                    for w, found in search_segment(seg, q):
                        np.add.at(edge, found, 1)
                        np.add.at(edge, found + int(q.at[w + 1] - q.at[w]), -1)
                        for d in np.unique(seg.doc_of(found)).tolist():
                            items.setdefault(d, set()).update(q.names(w))
                    covered = np.cumsum(edge[:-1]) > 0
                    ends = seg.first.tolist()
                    bits = [np.packbits(covered[x:y]).tobytes() if d in items else None for d, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
                    name = hashlib.sha256(b"".join(packed)).digest()  # a segment's name, the same in each pass
                    columns = [ids, pa.array([name] * n, pa.binary()), pa.array(np.arange(n)), pa.array(np.diff(seg.first).astype(np.int64)), pa.array(bits, pa.binary()), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "segment", "nr", "n_words", "bits", "items"])

        return run

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [int(sum(x.bit_count() for x in bits)) if bits else 0 for bits in b.column("bits").to_pylist()]
            own = [sorted(set(x)) for x in b.column("items").to_pylist()]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in own]
            count = np.array([len(x) for x in own], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array(count), pa.array(sha, pa.string()), pa.array(count >= min_items)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    passes = _pass(run_of, index, benchmark, f"doc_id {kind}, segment binary, nr long, n_words long, bits binary, items array<string>", short)
    if len(passes) > 1:
        # Equal segments (copies of whole stretches of documents) have equal hits, so they may share a name.
        each = passes[0].select("doc_id", "segment", "nr", "n_words")
        some = functools.reduce(DataFrame.unionByName, passes).where(F.col("bits").isNotNull()).select("segment", "nr", "bits", "items").distinct()

        def merge(g: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in g.column("bits").to_pylist()])
            items = sorted({x for xs in g.column("items").to_pylist() for x in xs})
            return pa.table({"_s": g.column("segment").slice(0, 1), "_n": g.column("nr").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary()), "items": pa.array([items], pa.list_(pa.string()))})

        merged = some.groupBy("segment", "nr").applyInArrow(merge, "_s binary, _n long, bits binary, items array<string>")
        every = each.join(merged, (F.col("segment") == F.col("_s")) & (F.col("nr") == F.col("_n")), "left").select("doc_id", "segment", "nr", "n_words", "bits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    else:
        every = passes[0]
    return every.select("doc_id", "n_words", "bits", "items").mapInArrow(judge, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, short: bool = True) -> DataFrame:
    """What `contamination` returns, for docs (doc_id, text) against benchmark (item_id, text).

    Null texts have no words. Rows that repeat an id are judged one by one; items that repeat an id are one item with
    all their windows. The words of items with a null id are hit like any others, but such items have no name, so they
    are neither counted nor listed. Empty tables give no rows, or no hits. Extra columns are not read.
    """
    return contamination(stored(build_index(docs)), benchmark, short=short)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Too slow in SQL over whole tables; the query is tested against a brute-force version.
SQL = None
