"""Substring deduplication by relative Lempel-Ziv parsing against an index of every block of the corpus.

A factor of a document is a run of words that is copied from one place of earlier text; only factors of at least WINDOW
words count. The index has, for each window of that length of every block (some documents that a task has in hand),
where it starts. A document's windows are looked up from left to right; a factor begins at a window that is found and
goes on, greedily, as long as the next window's source is the next place of the same text. Where it ends, the windows
across its boundary have been looked up like any others: where one of them is found too, with another source, the next
factor begins inside this one; where none is, the words between two factors stay.

A window's source is the first place that has its words, so a factor is cut where the sources change, also if a later
text has all of it: the words that factors cover are the same, and a passage is always traced to its first text.

A window goes to the part of the index that its minimiser names (the least hash of its SEED-word runs), so equal
windows meet wherever they are. Windows in a row that have the same minimiser travel together, and parts of factors
from different parts of the index are joined for each document at the end. Windows are equal if the 64 bits of their
minimiser and 48 bits of their own hash are.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, mix, parts_for, ragged, ship, shingles, sliding_min, table, texts_of, words_of

WINDOW, SEED = 20, 6
#: Bytes of text in a block, about, and of the input for which one part of the index is made.
BLOCK_BYTES, PART_BYTES = 4_000_000, 12_000_000
_NO_ID = -(1 << 63)
_U16, _U32, _I32, _I64, _U64 = np.uint16, np.uint32, np.int32, np.int64, np.uint64


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as 64-bit integers, null as the least."""
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], _I64).tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, _I64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


#: A run of windows with one minimiser: minimiser, document, first window's place, windows; and of each window 48 bits of its hash.
_RUN = (_U64, _I64, _I32, _I32, _U32, _U16)
#: Windows in a row that have sources in a row: document, first window's place, windows; the source's document and place.
_SPAN = (_I64, _I32, _I32, _I64, _I32)
_FACTOR = np.dtype([("place", _I32), ("windows", _I32), ("source", _I64), ("at", _I32)])


def block_runs(ids: np.ndarray, texts: pa.StringArray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """A block's runs for the index; and spans (document, first window, windows) of runs that are copies of earlier ones in the block, which the index needn't see."""
    w = words_of(texts, SPACE)
    h, n = w.hashes(), w.counts()
    whole = shingles(h, WINDOW)
    least = sliding_min(shingles(h, SEED), WINDOW - SEED + 1)
    owner = np.repeat(np.arange(len(n)), n)[: len(whole)]
    at = np.flatnonzero(np.arange(len(whole)) + WINDOW <= w.first[owner + 1])
    key = least[at]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])])) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(at))).astype(_I32)
    start = at[head]
    key, doc, place = key[head], ids[owner[start]], (start - w.first[owner[start]]).astype(_I32)
    # Short runs with the same first and last window are the same words.
    same = mix(mix(key ^ mix(whole[start])) + whole[start + size - 1] + size.astype(_U64))
    same = np.where(size <= WINDOW, same, mix(np.arange(len(size), dtype=_U64) ^ _U64(1 << 63)))
    order = np.lexsort((place, doc, same))
    new = np.ones(len(order), bool)
    new[1:] = same[order][1:] != same[order][:-1]
    group = np.cumsum(new) - 1
    firsts = order[new]
    origin = firsts[group]
    repeat = (doc[order] != doc[origin]) | (place[order] != place[origin])
    # The hash that named the group is checked on what it was made of.
    last = start + size - 1
    repeat &= (key[order] == key[origin]) & (size[order] == size[origin]) & (whole[start[order]] == whole[start[origin]]) & (whole[last[order]] == whole[last[origin]])
    copies, origin = order[repeat], origin[repeat]
    stay = np.ones(len(size), bool)
    stay[order[~new]] = ~((doc[order] == doc[firsts[group]]) & (place[order] == place[firsts[group]]))[~new]
    stay[copies] = False
    kept = np.flatnonzero(stay)
    windows = whole[ragged(start[kept], size[kept])]
    runs = key[kept], doc[kept], place[kept], size[kept], (windows >> _U64(32)).astype(_U32), (windows & _U64(0xFFFF)).astype(_U16)
    return runs, (doc[copies], place[copies], size[copies], doc[origin], place[origin])


def _deal(arrays: tuple[np.ndarray, ...], part: np.ndarray, size: np.ndarray | None = None) -> dict[int, bytes]:
    """The arrays, packed for each part that has any; with size, those after the fourth have `size` items an entry."""
    order = np.argsort(part, kind="stable")
    used, begin = np.unique(part[order], return_index=True)
    ends = np.append(begin, len(order))
    flat = [a[order] for a in (arrays if size is None else arrays[:4])]
    ends_of = [ends] * len(flat)
    if size is not None:
        pick = ragged((np.cumsum(size) - size)[order], size[order])
        flat += [a[pick] for a in arrays[4:]]
        ends_of += [np.concatenate([[0], np.cumsum(size[order])])[ends]] * len(arrays[4:])
    return {p: _pack(*(a[e[i] : e[i + 1]] for a, e in zip(flat, ends_of, strict=True))) for i, p in enumerate(used.tolist())}


def repeated_windows(key: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place, source document, source place) of all windows of some runs whose words also start earlier: in a document with a smaller id, or before in the same one. The source is the first place."""
    _, kind, many = np.unique(key, return_inverse=True, return_counts=True)
    most = WINDOW - SEED + 1
    looked = (many[kind] > 1) | (size > most)
    # A shorter run that is alone with its minimiser has equal windows only if its words repeat with a period below its length.
    run = np.repeat(np.arange(len(size), dtype=_I32), size)
    for lag in range(1, most):
        at = np.flatnonzero((high[lag:] == high[:-lag]) & (low[lag:] == low[:-lag]))
        looked[run[at[run[at] == run[at + lag]]]] = True
    use = np.flatnonzero(looked)
    pick = ragged((np.cumsum(size) - size)[use], size[use])
    owner = np.repeat(use, size[use])
    own = (high[pick].astype(_U64) << _U64(16)) | low[pick]
    where = place[owner] + ragged(np.zeros(len(use), np.int64), size[use]).astype(_I32)
    d = doc[owner]
    # Minimisers by number: in one word with the windows' 48 bits if they are few, else as a key of their own.
    one = kind[owner].astype(_U64)
    if len(many) <= 1 << 16:
        own |= one << _U64(48)
        one = np.zeros(len(own), _U64)
        order = np.lexsort((where, d, own))
    else:
        order = np.lexsort((where, d, own, one))
    own, one, d, where = own[order], one[order], d[order], where[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (one[1:] != one[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(own) else order
    later = (d != d[first]) | (where != where[first])
    return d[later], where[later], d[first][later], where[first][later]


def join_factors(doc: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and factors in order, those in a row joined that go on in the same source."""
    order = np.lexsort((factors["place"], doc))
    doc, f = doc[order], factors[order]
    if not len(f):
        return doc, f
    again = np.concatenate([[False], (doc[1:] == doc[:-1]) & (f["place"][1:] == f["place"][:-1])])  # rows that repeat an id
    doc, f = doc[~again], f[~again]
    goes_on = (doc[1:] == doc[:-1]) & (f["place"][1:] == f["place"][:-1] + f["windows"][:-1]) & (f["source"][1:] == f["source"][:-1]) & (f["at"][1:] == f["at"][:-1] + f["windows"][:-1])
    head = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    out = f[head].copy()
    out["windows"] = np.add.reduceat(f["windows"], head)
    return doc[head], out


def factors_by_doc(doc: np.ndarray, place: np.ndarray, size: np.ndarray, source: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(document, its packed factors), as far as a part of the index knows them."""
    f = np.empty(len(doc), _FACTOR)
    f["place"], f["windows"], f["source"], f["at"] = place, size, source, at
    doc, f = join_factors(doc, f)
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
    for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=False):
        yield int(doc[a]), f[a:b].tobytes()


def duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_key (the id, -2^63 for null), spans (packed factors): a few rows per document that has duplicate words."""
    spark = docs.sparkSession
    ship(spark)
    parts = parts_for(docs, PART_BYTES)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text", BLOCK_BYTES):
            runs, copies = block_runs(_ids(b.column(0)), texts_of(b, "_text"))
            a = _deal(runs, (mix(runs[0]) % _U64(parts)).astype(np.int64), runs[3])
            c = _deal(copies, (mix(copies[0].astype(_U64)) % _U64(parts)).astype(np.int64))
            both = sorted({*a, *c})
            if both:
                yield pa.RecordBatch.from_arrays([pa.array(both, pa.int32()), pa.array([a.get(p) for p in both], pa.binary()), pa.array([c.get(p) for p in both], pa.binary())], ["part", "runs", "copies"])

    def parse(group: pa.Table) -> pa.Table:
        runs = [_unpack(x, _RUN) for x in group.column("runs").to_pylist() if x]
        spans = [_unpack(x, _SPAN) for x in group.column("copies").to_pylist() if x]
        if runs:
            doc, place, source, at = repeated_windows(*(np.concatenate(x) for x in zip(*runs, strict=True)))
            spans.append([doc, place, np.ones(len(doc), _I32), source, at])
        rows = list(factors_by_doc(*(np.concatenate(x) for x in zip(*spans, strict=True)))) if spans else []
        return pa.table({"doc_key": pa.array([r[0] for r in rows], pa.int64()), "spans": pa.array([r[1] for r in rows], pa.binary())})

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return ids.mapInArrow(index, "part int, runs binary, copies binary").groupBy("part").applyInArrow(parse, "doc_key long, spans binary")


def kept_words(text: str | None, spans: list[bytes] | None) -> tuple[int, int, bytes]:
    """Words of a text, those in duplicate spans, and the others joined by a space."""
    words = (text or "").encode().split()
    if not spans:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    f = np.frombuffer(b"".join(spans), _FACTOR)
    np.add.at(edge, np.minimum(f["place"], len(words)), 1)
    np.add.at(edge, np.minimum(f["place"].astype(np.int64) + f["windows"] + WINDOW - 1, len(words)), -1)
    keep = np.cumsum(edge)[:-1] == 0
    return len(words), int(len(words) - keep.sum()), b" ".join(itertools.compress(words, keep.tolist()))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and kept_text if asked for.

    Removed is each word that a window of WINDOW words covers whose word sequence also starts earlier; windows are
    judged on the input. Ids are integers; a null id comes before all others. Rows that repeat an id and a text are
    no copies of each other and have the same result; an id should not be given to different texts. Ids that are no
    integers are an error. Null texts have no words. Other columns are not read and may have any name. An empty table
    gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    spans = duplicate_spans(docs, doc_id, text).groupBy("doc_key").agg(F.collect_list("spans").alias("_spans"))
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc_key"))
    both = ids.join(spans, "doc_key", "left").select("doc_id", "_text", "_spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [kept_words(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([r[2].decode() for r in rows], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_key, start, length, source_key, source_start: the factors of every document, in words; keys are ids, -2^63 for null."""
    spans = duplicate_spans(docs, doc_id, text).groupBy("doc_key").agg(F.collect_list("spans").alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(b"".join(x), _FACTOR) for x in b.column(1).to_pylist()]
            doc, f = join_factors(np.repeat(b.column(0).to_numpy(), [len(x) for x in parts]), np.concatenate([*parts, np.zeros(0, _FACTOR)]))
            columns = [doc, f["place"].astype(_I64), f["windows"].astype(_I64) + WINDOW - 1, f["source"], f["at"].astype(_I64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_key", "start", "length", "source_key", "source_start"])

    return spans.mapInArrow(run, "doc_key long, start long, length long, source_key long, source_start long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


#: Too slow in SQL over whole tables; the query is tested against a brute-force version.
SQL = None
