"""Whole documents at once, without a row for each unit or token of their text.

Texts are cut into units by chunks of documents. A chunk has each of its distinct units once, and its documents as numbers of
them. Units are described once per distinct one (what tokens a unit has, what it is decoded to), each chunk gets its own
units' descriptions by a join, and its documents are put together from them.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import script
from ..sources.tables import kept, ship, spread

#: Units as they are written, with the white space before them (those of `encode.units`, in Python's terms).
UNITS = {"gms": r"\s*(?:, |,|[^\s,]+)", "cv": r"\s*\S+", "morph": r"\s|\S+", "hybrid": r"[\s.,;:!?።፡፤፣]|[^\s.,;:!?።፡፤፣]+"}
#: A chunk ends after the document with which it has so many distinct units, characters of them, or units.
MOST_DISTINCT, MOST_CHARS, MOST_UNITS = 100_000, 4_000_000, 2_000_000
#: Units after which a task begins anew to keep descriptions; it takes over those of the last so many that come again.
MOST_HERE = 80_000
#: Places up to this are written from a table.
PLACES = 200_000


def chunk_words(text: DataFrame, column: str = "text") -> DataFrame:
    """chunk: what stands between white space, each once per some MB of text; a null text has none."""
    ship(text.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    seen.update(t.as_py().split())
                if len(seen) >= MOST_DISTINCT:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["chunk"])
                    seen = set()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["chunk"])

    return spread(text.select(column)).mapInArrow(run, "chunk string")


class _Numbers(dict):
    """Texts numbered as they come."""

    chars = 0

    def __missing__(self, key: str) -> int:
        self.chars += len(key)
        n = self[key] = len(self)
        return n


def chunks(kind: str, docs: DataFrame) -> DataFrame:
    """chunk, doc_id, units (numbers, 4 bytes each) of documents with any unit; and a row for each chunk with its distinct units in order of number (raws)."""
    ship(docs.sparkSession)
    pattern = UNITS[kind]
    key = docs.select("doc_id").schema[0]
    key_type = _arrow(docs.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part, made = re.compile(pattern).findall, TaskContext.get().partitionId(), 0
        numbers, n = _Numbers(), 0

        def rows(keys, units, raws=None) -> pa.RecordBatch:
            chunk = pa.array([(part << 32) + made] * len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([chunk, pa.array(keys, key_type), pa.array(units, pa.binary()), pa.array([raws] * len(keys), pa.list_(pa.string()))], ["chunk", "doc_id", "units", "raws"])

        for b in batches:
            keys, units = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = array("i", map(numbers.__getitem__, find(text.as_py()))) if text.is_valid else ()
                if not own:
                    continue
                keys.append(doc_id)
                units.append(own.tobytes())
                n += len(own)
                if len(numbers) >= MOST_DISTINCT or numbers.chars >= MOST_CHARS or n >= MOST_UNITS:
                    yield rows(keys, units)
                    yield rows([None], [None], list(numbers))
                    keys, units, numbers, n, made = [], [], _Numbers(), 0, made + 1
            if keys:
                yield rows(keys, units)
        if numbers:
            yield rows([None], [None], list(numbers))

    return docs.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_id {key.dataType.simpleString()}, units binary, raws array<string>")


def unit_counts(kind: str, docs: DataFrame, by: str | None = None) -> DataFrame:
    """raw, n, and the column `by`: how often each unit, as it is written with the white space before it, is in the documents."""
    ship(docs.sparkSession)
    pattern = UNITS[kind]
    keys = docs.select(*([by] if by else []))
    types = [_arrow(keys)] if by else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = re.compile(pattern).findall, {}

        def rows() -> Iterator[pa.RecordBatch]:
            for k, c in counts.items():
                own = [pa.array([k] * len(c), types[0])] if by else []
                yield pa.RecordBatch.from_arrays([*own, pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], [*([by] if by else []), "raw", "n"])
            counts.clear()

        for b in batches:
            values = b.column(1).to_pylist() if by else [None] * b.num_rows
            for text, k in zip(b.column(0), values, strict=True):
                if text.is_valid:
                    counts.setdefault(k, Counter()).update(find(text.as_py()))
                if sum(map(len, counts.values())) >= MOST_DISTINCT:
                    yield from rows()
        yield from rows()

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema), "raw string", "n long"])
    counted = docs.select("text", *([by] if by else [])).mapInArrow(run, schema)
    return counted.groupBy(*([by] if by else []), "raw").agg(F.sum("n").alias("n"))


def _arrow(one: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(one.schema[0].dataType)


def _sum(values: list, codes: list[int]) -> int:
    return sum(map(values.__getitem__, codes))


def _text(values: list, codes: list[int]) -> str:
    return "".join(map(values.__getitem__, codes))


def _md5(values: list, codes: list[int]) -> str:
    """Checksum of texts that stand between commas."""
    return hashlib.md5(",".join(map(values.__getitem__, codes)).encode()).hexdigest()


@functools.cache
def _places_md5() -> Callable[[list, list[int]], str]:
    """Checksum of begin:end of all pieces, each begun where the last one ended, from their lengths."""
    known = [f"{e},{e}:" for e in range(PLACES)]

    def run(values: list, codes: list[int]) -> str:
        ends = list(accumulate(chain.from_iterable(map(values.__getitem__, codes))))
        last = ends.pop()
        texts = map(known.__getitem__, ends) if last < PLACES else (f"{e},{e}:" for e in ends)
        return hashlib.md5(f"0:{''.join(texts)}{last}".encode()).hexdigest()

    return run


#: What a document gets from its units' values: its type, and a function that makes the function of values by number and a document's numbers.
WAYS = {"sum": ("long", lambda: _sum), "text": ("string", lambda: _text), "md5": ("string", lambda: _md5), "places_md5": ("string", _places_md5)}


def put_together(kind: str, docs: DataFrame, describe: Callable[[DataFrame], DataFrame], ways: dict[str, str]) -> DataFrame:
    """doc_id and the columns of `ways` (column: one of WAYS) of documents with any unit.

    describe gets the distinct units (raw) and gives them with those columns.
    """
    cut = kept(chunks(kind, docs))
    own = cut.where(F.col("raws").isNotNull()).select("chunk", F.posexplode("raws").alias("k", "raw"))
    described = describe(own.select("raw").distinct()).select("raw", *ways)
    values = own.join(described, "raw").select("chunk", "k", *ways)
    key_type = _arrow(docs.select("doc_id"))
    names = list(ways)
    made = {name: WAYS[way] for name, way in ways.items()}
    types = {"long": pa.int64(), "string": pa.string()}

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column("k").to_numpy())
        if len(order) != left.column("k").to_numpy().max(initial=-1) + 1:
            raise ValueError("a unit has no description")
        by_number = [left.column(c).combine_chunks().take(pa.array(order)).to_pylist() for c in names]
        functions = [made[c][1]() for c in names]
        out: list[list] = [[] for _ in names]
        for u in right.column("units").to_pylist():
            codes = np.frombuffer(u, np.int32).tolist()
            for f, v, o in zip(functions, by_number, out, strict=True):
                o.append(f(v, codes))
        columns = [pa.array(o, types[made[c][0]]) for c, o in zip(names, out, strict=True)]
        return pa.table([right.column("doc_id").cast(key_type), *columns], names=["doc_id", *names])

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} {t}" for c, (t, _) in made.items())])
    rows = cut.where(F.col("units").isNotNull()).select(F.col("chunk").alias("of"), "doc_id", "units")
    return values.groupBy("chunk").cogroup(rows.groupBy("of")).applyInArrow(lambda a, b: put(a, b), schema)


def put_together_here(kind: str, docs: DataFrame, describe: Callable[[str], tuple], ways: dict[str, str]) -> DataFrame:
    """The same without a join, where a function can describe a unit: each task keeps the descriptions of its last units (MOST_HERE)."""
    ship(docs.sparkSession)
    pattern, key_type, names = UNITS[kind], _arrow(docs.select("doc_id")), ["doc_id", *ways]
    made = [WAYS[way] for way in ways.values()]
    types = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, functions = re.compile(pattern).findall, [f() for _, f in made]
        numbers, values = _Numbers(), [[] for _ in made]
        before, old = _Numbers(), values
        for b in batches:
            keys, out = [], [[] for _ in made]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                codes = list(map(numbers.__getitem__, find(text.as_py()))) if text.is_valid else ()
                if not codes:
                    continue
                new = len(numbers) - len(values[0])
                for raw in reversed(list(islice(reversed(numbers), new))):
                    k = before.get(raw)
                    for v, x in zip(values, describe(raw) if k is None else [o[k] for o in old], strict=True):
                        v.append(x)
                keys.append(doc_id)
                for f, v, o in zip(functions, values, out, strict=True):
                    o.append(f(v, codes))
                if len(numbers) >= MOST_HERE or numbers.chars >= MOST_CHARS:
                    before, old = numbers, values
                    numbers, values = _Numbers(), [[] for _ in made]
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(o, types[t]) for o, (t, _) in zip(out, made, strict=True))], names)

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} {t}" for c, (t, _) in zip(ways, made, strict=True))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def raw_parts(kind: str, raws: DataFrame) -> DataFrame:
    """raws with unit (as it is cut) and ws, the white space before it; of morph and hybrid, white space is a unit."""
    if kind not in ("gms", "cv"):
        return raws.withColumn("unit", F.col("raw")).withColumn("ws", F.lit(0))
    unit: Column = F.ltrim(script.plain_space(F.col("raw"), "\n", but=" "), F.lit(" \n"))
    return raws.withColumn("unit", unit).withColumn("ws", F.length("raw") - F.length("unit"))


def words_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, w: the words between white space of each text; a null text has none."""
    key_type = _arrow(docs.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.as_py().split()) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(key_type), pa.array(n, pa.int64())], ["doc_id", "w"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, w long")


def count_words(docs: DataFrame) -> DataFrame:
    """n: the words between white space, a row for each batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.as_py().split()) for t in b.column(0) if t.is_valid)], pa.int64())], ["n"])

    return docs.select("text").mapInArrow(run, "n long")


def cv_texts(docs: DataFrame) -> DataFrame:
    """doc_id, chars, cv_md5, cv_chars: the length of each text, and checksum and length of its CV form; null of a null text."""
    table = {ord(g): cv for g, cv in script.fidel_pairs()}
    key_type = _arrow(docs.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = []
            for t in b.column(1):
                text = t.as_py()
                cv = None if text is None else text.translate(table)
                own.append((None, None, None) if text is None else (len(text), hashlib.md5(cv.encode()).hexdigest(), len(cv)))
            columns = [pa.array([x[k] for x in own], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(key_type), *columns], ["doc_id", "chars", "cv_md5", "cv_chars"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chars long, cv_md5 string, cv_chars long")
