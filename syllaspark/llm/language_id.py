"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Where a language has more n-grams than such arrays are made for, the same models are tables, and texts are scored by
joins of their n-grams: slower, but nothing is left out.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_offsets, cut, fold_of, forget, mix, ship, stored, table, texts_of

#: Characters of an n-gram, and bits of one.
ORDER, BITS = 5, 12
#: Most n-grams of a language in a model that is broadcast (with more it stays in tables, whole), and most texts whose entropies calibrate the rejection in the driver (those of more stay in a table, whole).
MAX_GRAMS, MAX_OWN = 2_000_000, 100_000
#: Rejected is a text whose cross-entropy lies further above its language's mean than LEAST_SIGMAS standard deviations, and MARGIN times further than that of all but one in a thousand of the language's own texts.
LEAST_SIGMAS, MARGIN, ACCEPTED = 4.0, 1.25, 0.999
_BEGIN, _GAP = 1, 0x20
_MASK = np.uint64((1 << BITS) - 1)


@functools.lru_cache(1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its 12-bit number (letters lower-cased, marks as they are, all others a gap; from U+1000 on, folded to 2,048 numbers), and whether it is a letter."""
    number = np.full(0x110000, _GAP, np.uint16)
    letter = np.zeros(0x110000, bool)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            letter[cp] = True
            low = c.lower()
            x = ord(low[0])
        elif unicodedata.category(c)[0] == "M":
            x = cp
        else:
            continue
        number[cp] = x if x < 0x1000 else 0x800 | (x & 0x7FF)
    return number, letter


def grams(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 5-grams of all texts in a row, where each text's begin (one place more than texts), and each text's letters. Runs of gaps are one gap; a text begins after four begin marks."""
    number, letter = _alphabet()
    at = byte_offsets(texts)
    raw = texts.buffers()[2]
    buf = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[at - at[0]]
    n = len(texts)
    pad = ORDER - 1
    x = np.full(len(points) + pad * n, _BEGIN, np.uint64)
    place = np.arange(len(points)) + pad * (np.repeat(np.arange(n), np.diff(at)) + 1)
    x[place] = number[points]
    letters = np.concatenate([[0], np.cumsum(letter[points])])
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != _GAP) | (x[:-1] != _GAP)
    begins = np.concatenate([[0], np.cumsum(keep)])[at + pad * np.arange(n + 1)]
    x = x[keep]
    g = x.copy()
    for k in range(1, ORDER):
        g[k:] |= x[:-k] << np.uint64(BITS * k)
    real = x != _BEGIN
    first = np.concatenate([[0], np.cumsum(real)])[begins]
    return g[real], first, letters[at[1:]] - letters[at[:-1]]


def count_sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


class HashArray:
    """Rows by 64-bit key: the keys' hashes in order, and a directory by their top bits; a key costs a probe or two."""

    def __init__(self, keys: np.ndarray) -> None:
        h = mix(keys)
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        top = (self.hash >> self.shift).astype(np.int64)
        self.at = np.searchsorted(top, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "order"}  # serves the fit only

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places in the order of hashes, -1 for keys that aren't there."""
        if not len(self.hash):
            return np.full(len(keys), -1, np.int32)
        h = mix(keys)
        top = (h >> self.shift).astype(np.int64)
        at, end = self.at[top], self.at[top + 1]
        out = np.where((at < end) & (self.hash[np.minimum(at, len(self.hash) - 1)] == h), at, -1).astype(np.int32)
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.hash[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (at[left] + 1 < end[left])]
        return out


@dataclass
class Model:
    """langs; per order, from 1 to 5: the n-grams known in any language with their log2 probability in each, and the contexts with the log2 weight of what comes below. mean, spread, noise: of the languages' cross-entropies (noise: of one character); sigmas: how many deviations above the mean are accepted."""

    langs: list[str]
    known: list[tuple[HashArray, np.ndarray]]
    contexts: list[tuple[HashArray, np.ndarray]]
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    sigmas: np.ndarray

    def logs(self, g: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 probability of each 5-gram's last character after the others, in each language."""
        if order == 0:
            return np.full((len(g), len(self.langs)), -float(BITS), np.float32)
        index, value = self.known[order - 1]
        rows = index.find(g & np.uint64((1 << BITS * order) - 1))
        if not len(value):
            return self.logs(g, order - 1)
        out = value[np.maximum(rows, 0)]
        if len(miss := np.flatnonzero(rows < 0)):
            low = g[miss]
            below = self.logs(low, order - 1)
            index, weight = self.contexts[order - 1]
            rows = index.find((low >> np.uint64(BITS)) & np.uint64((1 << BITS * (order - 1)) - 1))
            seen = rows >= 0
            below[seen] += weight[rows[seen]]
            out[miss] = below
        return out

    def entropies(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, in bits a character; the texts' characters and letters."""
        g, first, letters = grams(texts)
        n = np.diff(first)
        sums = np.zeros((len(n), len(self.langs)))
        step = 1 << 20
        owner = np.repeat(np.arange(len(n)), n)
        for k in range(0, len(g), step):
            part, own = self.logs(g[k : k + step]), owner[k : k + step]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            np.add.at(sums, own[heads], np.add.reduceat(part, heads, axis=0, dtype=np.float64))
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of each text's language (-1: no letter), score (the share of the best language if entropies differed over 50 characters at most), its entropy, and whether it is rejected."""
        return self.decide(*self.entropies(texts))

    def decide(self, h: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of texts' entropies, characters and letters."""
        if not self.langs:
            return np.full(len(n), -1), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
        best = h.argmin(axis=1)
        low = h[np.arange(len(n)), best]
        score = 1 / np.exp2(-(h - low[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
        none = letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, low), none | (self.deviations(best, low, n) > self.sigmas[best])

    def deviations(self, j: np.ndarray | int, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many standard deviations entropies h of texts of n characters lie above the mean of language j."""
        return (h - self.mean[j]) / np.sqrt(self.spread[j] ** 2 + self.noise[j] ** 2 / np.maximum(n, 1))

    def calibrate(self, j: int, h: np.ndarray, n: np.ndarray) -> None:
        """Fits what texts of language j are like to entropies of its own texts: long ones tell mean and spread, short ones the noise of a character."""
        if not len(h):  # nothing is known: nothing is rejected
            self.mean[j], self.spread[j], self.noise[j], self.sigmas[j] = BITS, BITS, 3.0, np.inf
            return
        long = n >= 200
        many = h[long] if long.sum() >= 20 else h
        self.mean[j] = np.median(many)
        self.spread[j] = 1.4826 * np.median(np.abs(many - self.mean[j])) + 0.05
        few = (np.abs(h - self.mean[j]) * np.sqrt(n))[~long]
        self.noise[j] = max(1.0, 1.4826 * np.median(few)) if len(few) >= 20 else 3.0
        self.sigmas[j] = max(LEAST_SIGMAS, MARGIN * np.quantile(self.deviations(j, h, n), ACCEPTED))

    def calibrate_wide(self, own: DataFrame) -> None:
        """The same for all languages at once, of j (the language's index), n and entropy of their texts; only counts and quantiles leave the table."""
        of, by = len(self.langs), lambda values: F.array(*(F.lit(x.item()) for x in values))[F.col("j")]
        all_n, long_n = np.zeros(of, np.int64), np.zeros(of, np.int64)
        for r in own.groupBy("j").agg(F.count(F.lit(1)), F.count_if(F.col("n") >= 200)).collect():
            all_n[r[0]], long_n[r[0]] = r[1], r[2]
        long, h, n = F.col("n") >= 200, F.col("entropy"), F.col("n")
        many = long | ~by(long_n >= 20)
        self.mean[:] = quantiles(own.where(many).select(F.col("j").alias("g"), h.alias("x")), of, 0.5)
        off = F.abs(h - by(self.mean))
        both = own.where(many).select(F.col("j").alias("g"), off.alias("x")).unionAll(own.where(~long).select((F.col("j") + of).alias("g"), (off * F.sqrt(n)).alias("x")))
        middle = 1.4826 * quantiles(both, 2 * of, 0.5)
        self.spread[:] = middle[:of] + 0.05
        self.noise[:] = np.where(all_n - long_n >= 20, np.fmax(1.0, middle[of:]), 3.0)
        apart = (h - by(self.mean)) / F.sqrt(by(self.spread**2) + by(self.noise**2) / n)
        self.sigmas[:] = np.fmax(LEAST_SIGMAS, MARGIN * quantiles(own.select(F.col("j").alias("g"), apart.alias("x")), of, ACCEPTED))
        for j in np.flatnonzero(all_n == 0):
            self.calibrate(j, np.zeros(0), np.zeros(0))


def quantiles(values: DataFrame, groups: int, q: float, bins: int = 1024) -> np.ndarray:
    """The q-quantile of x over all rows of each group g from 0 on, as np.quantile has it; nan for groups without rows.

    Exact: the range of x that holds the quantile's row is cut into bins, and the bin that holds it is the next range,
    from its least x to its largest, until they are one.
    """
    low, high, rows, before = np.full(groups, np.nan), np.full(groups, np.nan), np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    for r in values.groupBy("g").agg(F.min("x"), F.max("x"), F.count(F.lit(1))).collect():
        low[r[0]], high[r[0]], rows[r[0]] = r[1:]
    place = q * (rows - 1)
    rank = np.floor(place).astype(np.int64)
    x, by = F.col("x"), lambda each: F.array(*(F.lit(v.item()) for v in each))[F.col("g")]
    while len(left := np.flatnonzero(low < high)):
        inside = values.where(by(low < high) & x.between(by(low), by(high)))
        of = F.least(F.floor((x - by(low)) / by(high - low) * bins), F.lit(bins - 1)).alias("bin")
        found = sorted(tuple(r) for r in inside.groupBy("g", of).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect())
        todo = set(left.tolist())
        for g, _, n, least, most in found:
            if g in todo and before[g] + n > rank[g]:
                low[g], high[g] = least, most
                todo.remove(g)
            elif g in todo:
                before[g] += n
    after = low.copy()
    for r in values.groupBy("g").agg(F.count_if(x <= by(low)), F.min(F.when(x > by(low), x))).collect():
        if r[1] <= rank[r[0]] + 1 and r[2] is not None:
            after[r[0]] = r[2]
    return low + (after - low) * (place - rank)


def _discount(counts: np.ndarray) -> float:
    return _discount_of(int((counts == 1).sum()), int((counts == 2).sum()))


def _discount_of(one: int, two: int) -> float:
    return one / (one + 2 * two) if one else 0.5


def fit(counts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Model of (language, distinct 5-grams, their counts)."""
    langs = [x[0] for x in counts]
    keys = [{ORDER: np.asarray(x[1], np.uint64)} for x in counts]
    nums = [{ORDER: np.asarray(x[2], np.int64)} for x in counts]
    for k, c in zip(keys, nums, strict=True):
        for order in range(ORDER - 1, 0, -1):  # below the top: in how many ways a gram is continued to the left
            k[order], c[order] = count_sorted(k[order + 1] & np.uint64((1 << BITS * order) - 1))
    known, contexts = [], []
    model = Model(langs, known, contexts, *(np.zeros(len(langs)) for _ in range(4)))
    for order in range(1, ORDER + 1):
        union, _ = count_sorted(np.concatenate([k[order] for k in keys])) if keys else (np.zeros(0, np.uint64), None)
        around, _ = count_sorted(union >> np.uint64(BITS))
        index, index_c = HashArray(union), HashArray(around)
        value, weight = np.zeros((len(union), len(langs)), np.float32), np.zeros((len(around), len(langs)), np.float32)
        lower = model.logs(union, order - 1) if langs else value
        for j, (k, c) in enumerate(zip(keys, nums, strict=True)):
            d = _discount(c[order])
            ctx = k[order] >> np.uint64(BITS)
            heads = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
            total, kinds = np.add.reduceat(c[order], heads) if len(heads) else np.zeros(0), np.diff(np.append(heads, len(ctx)))
            where = np.searchsorted(around, ctx[heads])
            weight[where, j] = np.log2(d * kinds / total) if len(heads) else 0.0
            full = np.zeros(len(around))
            full[where] = total
            value[:, j] = np.exp2(lower[:, j] + weight[np.searchsorted(around, union >> np.uint64(BITS)), j])
            own = np.searchsorted(union, k[order])
            value[own, j] += np.maximum(c[order] - d, 0) / full[np.searchsorted(around, ctx)]
        value = value[index.order]
        known.append((index, np.log2(value, out=value)))
        contexts.append((index_c, weight[index_c.order]))
    return model


def _mask(order: int):
    return F.lit((1 << BITS * order) - 1)


@dataclass
class WideModel:
    """A model in tables. rule: langs, mean, spread and noise; per order: gram, n (by language); ctx, total, kinds (by language); the languages' discounts. found: the stored n-grams of the texts scored so far."""

    rule: Model
    known: list[DataFrame]
    contexts: list[DataFrame]
    discounts: list[list[float]]
    found: list[DataFrame] = field(default_factory=list)

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """gram, p (by language) of distinct 5-grams, as Model.logs has them."""
        each = range(len(self.rule.langs))
        below = None
        for order, (known, contexts, d) in enumerate(zip(self.known, self.contexts, self.discounts, strict=True), 1):
            x = asked.select(F.col("gram").bitwiseAND(_mask(order)).alias("gram")).distinct()
            x = x.select("gram", F.shiftright("gram", BITS).alias("ctx"), F.col("gram").bitwiseAND(_mask(order - 1)).alias("low"))
            x = x.join(known, "gram", "left").join(contexts, "ctx", "left")
            x = x.join(below.select(F.col("gram").alias("low"), F.col("p").alias("below")), "low") if below is not None else x.withColumn("below", F.array_repeat(F.lit(2.0**-BITS), len(each)))

            def p(j, d=d):
                own = F.greatest(F.coalesce(F.col("n")[j], F.lit(0)) - F.lit(d[j]), F.lit(0.0))
                return F.when(F.col("total")[j] > 0, (own + F.lit(d[j]) * F.col("kinds")[j] * F.col("below")[j]) / F.col("total")[j]).otherwise(F.col("below")[j])

            below = x.select("gram", F.array(*map(p, each)).alias("p"))
        return below

    def scored(self, docs: DataFrame, text: str) -> DataFrame:
        """docs with _entropies, those of the text in each language; null for texts without characters."""
        key = F.unhex(F.sha2(F.col(text).cast("string").cast("binary"), 256))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in cut(batches, "_text"):
                g, first, _ = grams(texts_of(b, "_text"))
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                order = np.lexsort((g, owner))
                g, owner = g[order], owner[order]
                heads = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])])) if len(g) else np.zeros(0, np.int64)
                c = np.diff(np.append(heads, len(g)))
                for k in range(0, len(heads), 1 << 16):
                    at = heads[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[at])), pa.array(g[at].astype(np.int64)), pa.array(c[k : k + (1 << 16)])], ["key", "gram", "c"])

        found = stored(docs.select(key.alias("key"), F.col(text).cast("string").alias("_text")).where(F.length("_text") > 0).mapInArrow(run, "key binary, gram long, c long"))
        self.found.append(found)
        # Equal texts add up, and so do their characters: the entropy is the same.
        sums = found.join(self.probabilities(found.select("gram").distinct()), "gram").groupBy("key")
        h = sums.agg(F.array(*(-F.sum(F.col("c") * F.log2(F.col("p")[j])) / F.sum("c") for j in range(len(self.rule.langs)))).alias("_entropies"))
        return docs.withColumn("_key", key).join(h.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def fit_wide(counted: DataFrame, langs: list[str]) -> WideModel:
    """Model of (lang, gram, n), as fit has it."""
    every = lambda of: F.array(*(of(j) for j in range(len(langs))))
    n = [F.col("n")[j] for j in range(len(langs))]
    known = [stored(counted.groupBy("gram").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in langs)).alias("n")))]
    for order in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND(_mask(order)).alias("gram")
        known.insert(0, stored(known[0].groupBy(low).agg(every(lambda j: F.count_if(n[j] > 0)).alias("n"))))
    contexts = [stored(k.groupBy(F.shiftright("gram", BITS).alias("ctx")).agg(every(lambda j: F.sum(n[j])).alias("total"), every(lambda j: F.count_if(n[j] > 0)).alias("kinds"))) for k in known]
    discounts = []
    for k in known:
        r = k.agg(every(lambda j: F.count_if(n[j] == 1)).alias("one"), every(lambda j: F.count_if(n[j] == 2)).alias("two")).first()
        discounts.append([_discount_of(a, b) for a, b in zip(r.one, r.two, strict=True)])
    return WideModel(Model(langs, [], [], *(np.zeros(len(langs)) for _ in range(4))), known, contexts, discounts)


def _scores(docs: DataFrame, model: Model | WideModel, text: str) -> tuple[DataFrame, Model]:
    """docs, with _entropies if the model is in tables, and what is broadcast of the model."""
    return (model.scored(docs, text), model.rule) if isinstance(model, WideModel) else (docs, model)


def _entropies(m: Model, b: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Model.entropies of a batch, looked up if it has them."""
    if "_entropies" not in b.schema.names:
        return m.entropies(texts_of(b, text))
    _, first, letters = grams(texts_of(b, text))
    h = np.zeros((b.num_rows, len(m.langs)))
    column = b.column("_entropies")
    h[column.is_valid().to_numpy(zero_copy_only=False)] = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, len(m.langs))
    return h, np.diff(first), letters


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n over all rows and whole texts; a worker adds up what it has before it sends it."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (g, n) in have.items():
                for k in range(0, len(g), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g[k : k + (1 << 16)])), pa.array(g[k : k + (1 << 16)].astype(np.int64)), pa.array(n[k : k + (1 << 16)])], ["lang", "gram", "n"])
            have.clear()

        for b in cut(batches, "_text"):
            col, names = texts_of(b, "_text"), b.column(0)
            for name in pc.unique(names).to_pylist():
                g, n = count_sorted(grams(col.filter(pc.equal(names, name)))[0])
                if name in have:
                    old, old_n = have[name]
                    both = np.concatenate([old, g])
                    order = np.argsort(both, kind="stable")
                    both, num = both[order], np.concatenate([old_n, n])[order]
                    heads = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
                    g, n = both[heads], np.add.reduceat(num, heads) if len(heads) else num
                have[name] = g, n.astype(np.int64)
            if sum(len(g) for g, _ in have.values()) > 3_000_000:
                yield from flush()
        yield from flush()

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _own_entropies(rows: DataFrame, model: Model | WideModel) -> DataFrame:
    """j (the language's index), n (characters), entropy in their own language of rows' whole texts, for those with a letter; equal texts of a language are one. Stored; what it took to make it is given up."""
    key = F.unhex(F.sha2(F.col("_text").cast("binary"), 256))
    rows, rule = _scores(rows.select("lang", key.alias("_own"), "_text"), model, "_text")
    shared = rows.sparkSession.sparkContext.broadcast(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {x: j for j, x in enumerate(m.langs)}
        for b in cut(batches, "_text"):
            h, n, letters = _entropies(m, b, "_text")
            j = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            use = pa.array(letters > 0)
            yield pa.RecordBatch.from_arrays([pa.array(j), b.column(1), pa.array(n.astype(np.int64)), pa.array(h[np.arange(len(n)), j])], ["j", "key", "n", "entropy"]).filter(use)

    own = rows.mapInArrow(run, "j long, key binary, n long, entropy double")
    own = stored(own.groupBy("j", "key").agg(F.min("n").alias("n"), F.min("entropy").alias("entropy")).drop("key"))
    shared.destroy()
    if isinstance(model, WideModel):
        forget(*model.found)
        model.found.clear()
    return own


def _fit_small(counted: DataFrame, langs: list[str]) -> Model:
    small = counted.toArrow()
    names, gram, n = (small.column(c).combine_chunks() for c in ("lang", "gram", "n"))
    counts = []
    for name in langs:
        own = pc.equal(names, name)
        g, c = gram.filter(own).to_numpy(zero_copy_only=False).astype(np.uint64), n.filter(own).to_numpy(zero_copy_only=False)
        order = np.argsort(g)
        counts.append((name, g[order], c[order]))
    return fit(counts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | WideModel:
    """The model of docs' rows with a lang. Grams are counted over all of them and all kept, in tables if a language has more than MAX_GRAMS; all of a language's texts, equal ones once, tell how its own texts score."""
    counted = count_grams(docs, text, lang).cache()
    sizes = {r["lang"]: r["count"] for r in counted.groupBy("lang").count().collect()}
    if any(n > MAX_GRAMS for n in sizes.values()):
        model = fit_wide(counted, sorted(sizes))
    else:
        model = _fit_small(counted, sorted(sizes))
    counted.unpersist()
    rule = model.rule if isinstance(model, WideModel) else model
    rows = docs.where(F.col(lang).isNotNull() & (F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))) > 0)).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("_text"))
    own = _own_entropies(rows, model)
    if own.count() > MAX_OWN:
        rule.calibrate_wide(own)
    else:
        got = own.toArrow()
        index, entropy, length = (got.column(c).to_numpy() for c in ("j", "entropy", "n"))
        for j in range(len(rule.langs)):
            rule.calibrate(j, entropy[index == j], length[index == j])
    forget(own)
    return model


def identify(docs: DataFrame, model: Model | WideModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every row.

    The language with the lowest cross-entropy a character; `und` with score 0 if the text is null or has no letter,
    or if no language was learnt. rejected: such a text, or one whose cross-entropy no text of the language has. Rows
    that repeat an id are judged one by one; other columns are not read and may have any name.
    """
    ship(docs.sparkSession)
    ids = docs.select(F.col(doc_id).alias("doc_id"), (fold_of(doc_id) == 1).alias("held_out"), F.col(text).cast("string").alias("_text"))
    ids, rule = _scores(ids, model, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in cut(batches, "_text"):
            best, score, low, no = m.decide(*_entropies(m, b, "_text"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[best], pa.string()), pa.array(score), pa.array(low), pa.array(no)], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return ids.mapInArrow(run, f"doc_id {ids.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | WideModel, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns: one narrow pass if the model is broadcast."""
    ship(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    docs, rule = _scores(docs, model, text)
    shared = docs.sparkSession.sparkContext.broadcast(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, text):
            yield b.filter(pa.array(~shared.value.decide(*_entropies(shared.value, b, text))[3])).select(names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(fold_of() != 1)))


#: A character model has no SQL form; the query is tested by its held-out accuracy and the model by its sums.
SQL = None
