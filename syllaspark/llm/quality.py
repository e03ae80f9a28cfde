"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, fold_of, ship, shingles, stored, table, texts_of, words_of

#: Labelled rows that the model is fitted on at most, chosen by hash.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 32, 8, 6, 120, 40, 0.15, 4
FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "punctuation", "exclamation", "newline", "high_byte", "pipe",
    "distinct_words", "distinct_pairs", "distinct_lines", "short_words", "symbol_words", "space_run", "hash_sign", "long_word",
]
_SETS = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#$%&*@^~_=+<>|\\/{}[]", "punctuation": b".,;:?-'\"()", "exclamation": b"!", "newline": b"\n", "high_byte": range(128, 256), "pipe": b"|", "hash_sign": b"#"}


def _distinct_share(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct keys of each text over its keys, 1 for a text without any."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    both = np.sort((keys >> np.uint64(20)) | (owner << np.uint64(44)))
    new = np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.zeros(0, bool)
    kinds = np.bincount((both[new] >> np.uint64(44)).astype(np.int64), minlength=len(n))
    return np.where(n > 0, kinds / np.maximum(n, 1), 1.0)


def features(texts: pa.StringArray) -> np.ndarray:
    """One row of FEATURES per whole text; all from array operations over the bytes."""
    w = words_of(texts, SPACE)
    n_bytes, n_words = np.diff(w.text_at), w.counts()
    out = {"log_bytes": np.log1p(n_bytes), "log_words": np.log1p(n_words)}

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[w.text_at[1:]] - total[w.text_at[:-1]]) / np.maximum(n_bytes, 1)

    member = {}
    for name, own in _SETS.items():
        member[name] = np.zeros(256, bool)
        member[name][list(own)] = True
        out[name] = share(member[name][w.buf])
    space = w.buf == 32
    out["space_run"] = share(np.concatenate([[False], space[1:] & space[:-1]]) if len(space) else space)
    length = w.end - w.start

    def mean(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(n_words, 1)

    out["word_length"], out["short_words"] = mean(length), mean(length <= 3)
    marks = np.concatenate([[0], np.cumsum(member["symbol"][w.buf])])
    out["symbol_words"] = mean(marks[w.end] > marks[w.start])
    out["long_word"] = np.log1p(np.maximum.reduceat(np.append(length, 0), np.minimum(w.first[:-1], len(length))) * (n_words > 0))
    h = w.hashes()
    out["distinct_words"] = _distinct_share(h, w.first)
    pair = np.append(shingles(h, 2), np.zeros(min(1, len(h)), np.uint64))
    last = np.zeros(len(h), bool)
    last[w.first[1:][n_words > 0] - 1] = True
    kept = np.concatenate([[0], np.cumsum(~last)])
    out["distinct_pairs"] = _distinct_share(pair[~last], kept[w.first])
    lines = words_of(texts, b"\n")
    out["distinct_lines"] = _distinct_share(lines.hashes(), lines.first)
    return np.column_stack([out[f] for f in FEATURES]).astype(np.float32)


@dataclass
class Gam:
    """intercept; per feature: cuts between its bins and a score per bin; per pair of features: coarser cuts and a table of scores."""

    intercept: float
    cuts: list[np.ndarray]
    scores: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_scores: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (c, s) in enumerate(zip(self.cuts, self.scores, strict=True)):
            z += s[np.searchsorted(c, x[:, j], side="right")]
        for (i, j), s in zip(self.pairs, self.pair_scores, strict=True):
            z += s[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-z))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A tree of a few leaves over ordered bins, split where the gain is largest; its value in each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts, out = [(0, len(g))], np.zeros(len(g))

    def best(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        if not len(k):
            return 0.0, a
        gl, hl, gt, ht = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        i = int(gain.argmax())
        return float(gain[i]), int(k[i])

    while len(parts) < leaves:
        gain, at, k = max((*best(*p), i) for i, p in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, at), (at, b)]
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cycles over the features, each time adding a shallow tree of that feature alone to its table; then over the pairs that explain most of what is left."""
    p = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(p / (1 - p))), [], [], [], [], [])
    model.cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    model.scores = [np.zeros(len(c) + 1) for c in model.cuts]
    if not len(y) or y.min() == y.max():
        return model
    z = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            q = 1 / (1 + np.exp(-z))
            add = RATE * _tree(np.bincount(b, y - q, len(model.scores[j])), np.bincount(b, q * (1 - q), len(model.scores[j])))
            model.scores[j] += add
            z += add[b]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]
    q = 1 / (1 + np.exp(-z))
    gains = []
    for i in range(len(bins)):
        for j in range(i):
            cell = coarse[i] * sizes[j] + coarse[j]
            g, h = (np.bincount(cell, v, sizes[i] * sizes[j]) for v in (y - q, q * (1 - q)))
            gains.append((float((g**2 / (h + 1)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_scores = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), s in zip(model.pairs, model.pair_scores, strict=True):
            q = 1 / (1 + np.exp(-z))
            cell = coarse[i] * sizes[j] + coarse[j]
            g, h = (np.bincount(cell, v, s.size).reshape(s.shape) for v in (y - q, q * (1 - q)))
            rows = _tree(g.sum(axis=1), h.sum(axis=1), 2)  # one cut along the first feature, then one along the second on each side
            add = np.empty(s.shape)
            for side in np.unique(rows):
                own = rows == side
                add[own] = _tree(g[own].sum(axis=0), h[own].sum(axis=0), 2)
            s += RATE * add
            z += RATE * add[coarse[i], coarse[j]]
    return model


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, f (the features) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "_text"):
            x = features(texts_of(b, "_text"))
            f = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), f], ["doc_id", "held_out", "f"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), (fold_of(doc_id) == 1).alias("held_out"), F.col(text).cast("string").alias("_text"))
    return ids.mapInArrow(run, f"doc_id {ids.schema[0].dataType.simpleString()}, held_out boolean, f array<float>")


def train(rows: DataFrame, labels: DataFrame, label: str = "quality") -> Gam:
    """The model of the rows outside the held-out fold that have a label; of more than FIT_ROWS, those with the least hashes."""
    y = labels.where(F.col(label).isNotNull() & (fold_of() != 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("y"))
    own = rows.where(~F.col("held_out")).join(y, F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("doc_id"), "y").limit(FIT_ROWS)
    got = own.select("f", "y").toArrow()
    x = got.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return fit(x.astype(np.float64), (got.column("y").to_numpy() > 0.5).astype(float))


def score(rows: DataFrame, model: Gam) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.predict(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), learnt from labels (doc_id, quality).

    Empty and null texts have features (and so a score) too. Rows that repeat an id are scored one by one; labels that
    repeat an id all count. Without labels the score is 0.5. Only text is an input of the score.
    """
    ship(docs.sparkSession)
    rows = stored(measured(docs))
    return score(rows, train(rows, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A boosted model has no SQL form; the query is tested by its held-out accuracy.
SQL = None
