"""Greedy segmentation of distinct words against a table of tokens; all matches of tokens in words; the older split."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import script
from ..sources.tables import kept, ship
from .documents import chunk_words

#: Tokens, and characters of tokens, that are broadcast to the matching function at most; larger tables are joined.
MOST_TOKENS, MOST_CHARS = 400_000, 6_000_000
#: Lengths up to this are tried one by one; of longer tokens only the lengths that tokens with the same first SHORT characters have.
SHORT = 8
#: Up to this length a word's beginnings are looked up one by one where first runs are asked for.
NEAR = 3
PIECES = "array<struct<at:int,piece:string,base_id:long>>"


@dataclass
class Tokens:
    """Tokens and their ids; for the first SHORT characters of longer ones, their lengths in order; for the first two characters of all, their lengths from the longest on."""

    ids: dict[str, int] = field(default_factory=dict)
    longer: dict[str, list[int]] = field(default_factory=dict)
    begun: dict[str, list[int]] = field(default_factory=dict)

    def add(self, token: str, base_id: int) -> None:
        self.ids[token] = base_id
        if len(token) > 1:
            self.begun.setdefault(token[:2], []).append(len(token))
        if len(token) > SHORT:
            self.longer.setdefault(token[:SHORT], []).append(len(token))

    def done(self) -> Tokens:
        self.longer = {k: sorted(set(v)) for k, v in self.longer.items()}
        self.begun = {k: sorted(set(v), reverse=True) for k, v in self.begun.items()}
        return self

    def longest_pieces(self, word: str) -> list[tuple[int, str, int | None]]:
        """Place, piece and id of the longest tokens one after another, as `walk` finds them."""
        at, out, ids, begun = 0, [], self.ids, self.begun
        while at < len(word):
            for n in begun.get(word[at : at + 2], ()):
                if (base := ids.get(p := word[at : at + n])) is not None and len(p) == n:
                    break
            else:
                base, n = ids.get(p := word[at]), 1
            out.append((at, p, base))
            at += n
        return out

    def lengths(self, word: str, at: int) -> Iterator[int]:
        """Lengths of all tokens that begin at a place, in order."""
        left = len(word) - at
        for n in range(1, min(SHORT, left) + 1):
            if word[at : at + n] in self.ids:
                yield n
        for n in self.longer.get(word[at : at + SHORT], ()):
            if n > left:
                return
            if word[at : at + n] in self.ids:
                yield n


def first_run(lengths: Iterable[int]) -> int:
    """The end of the first unbroken run of lengths, 0 without any."""
    got = 0
    for n in lengths:
        if got and n != got + 1:
            return got
        got = n
    return got


def longest(lengths: Iterable[int]) -> int:
    return max(lengths, default=0)


CHOICES = {"first_run": first_run, "longest": longest}


def _frame(by: list[str], df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in by), *more])


def matches(words: DataFrame, tokens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """word, at (from 0), token, base_id: every occurrence of every token in the words (word, and the columns `by` that both tables have).

    Joins only: of each place the substrings of up to SHORT characters, of the lengths that tokens have; and, where longer tokens begin with the same
    SHORT characters, substrings of their lengths. So a word of n letters gives about SHORT * n short rows, not n * n.
    """
    by = by or []
    key = [*by, "word"]
    ids = tokens.select(*by, "token", "base_id" if "base_id" in tokens.columns else F.lit(0).cast("long").alias("base_id")).where(F.length("token") > 0)
    words = words.select(*key, F.unhex(F.md5("word")).alias("_w"))
    places = words.where(F.length("word") > 0).select(*by, "_w", F.posexplode(F.expr(f"transform(sequence(1, length(word)), i -> substring(word, i, {SHORT}))")).alias("at", "_p"))
    lengths = [r.n for r in ids.select(F.least(F.length("token"), F.lit(SHORT)).alias("n")).distinct().collect()]  # SHORT at most
    own = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("_p")), lambda n: F.left("_p", n))
    short = places.select(*by, "_w", "at", F.explode(own).alias("token"))
    found = short.join(ids.where(F.length("token") <= SHORT), [*by, "token"])
    longer = ids.where(F.length("token") > SHORT).select(*by, F.expr(f"left(token, {SHORT})").alias("_p"), F.length("token").alias("_n")).distinct()
    asked = places.where(F.length("_p") == SHORT).join(longer, [*by, "_p"]).join(words, [*by, "_w"])
    asked = asked.where(F.col("at") + F.col("_n") <= F.length("word")).select(*by, "_w", "at", F.expr("substring(word, at + 1, _n)").alias("token"))
    found = found.unionByName(asked.join(ids, [*by, "token"]).select(found.columns))
    return found.join(words, [*by, "_w"]).select(*key, "at", "token", "base_id")


def walk(word: str, pick, lengths_at) -> list[tuple[int, int]]:
    """Place and length of a word's pieces, one after another; pick chooses among the lengths of the tokens at a place."""
    at, out = 0, []
    while at < len(word):
        n = pick(lengths_at(at)) or 1
        out.append((at, n))
        at += n
    return out


def shared_tokens(tokens: DataFrame, by: list[str] | None = None) -> Broadcast[dict[tuple, Tokens]] | None:
    """The tokens of each value of `by`, broadcast; None of tables too large for it."""
    by = by or []
    size = tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("token")), F.lit(0)).alias("chars")).first()
    if size.n > MOST_TOKENS or size.chars > MOST_CHARS:
        return None
    tables: dict[tuple, Tokens] = {}
    got = tokens.select(*by, "token", "base_id" if "base_id" in tokens.columns else F.lit(0).cast("long").alias("base_id")).toArrow().to_pydict()
    for *k, token, base_id in zip(*got.values(), strict=True):
        tables.setdefault(tuple(k), Tokens()).add(token, base_id)
    return tokens.sparkSession.sparkContext.broadcast({k: t.done() for k, t in tables.items()})


def segment(words: DataFrame, tokens: DataFrame, choice: str, by: list[str] | None = None) -> DataFrame:
    """word, pieces (array of at, piece, base_id; at from 0) of distinct words, and the columns `by` that both tables have.

    From place to place a piece's end is chosen among the tokens that begin there (CHOICES); where none does, a piece
    is one character and its base_id null. Tables of up to MOST_TOKENS tokens are broadcast to an Arrow function over
    the words; of larger ones, each word gets its own matches by `matches`. Both give the same pieces.
    """
    by = by or []
    ship(words.sparkSession)
    words = words.where(F.length("word") > 0)
    pick = CHOICES[choice]

    kind = pa.list_(pa.struct([("at", pa.int32()), ("piece", pa.string()), ("base_id", pa.int64())]))
    names = [*by, "word", "pieces"]
    schema = _frame([*by, "word"], words, f"pieces {PIECES}")
    if (shared := shared_tokens(tokens, by)) is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = Tokens()
            for b in batches:
                out = []
                for *k, word in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    t = shared.value.get(tuple(k), none)
                    out.append(t.longest_pieces(word) if choice == "longest" else [(a, p := word[a : a + n], t.ids.get(p)) for a, n in walk(word, pick, lambda at: t.lengths(word, at))])  # noqa: B023
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names)

        return words.select(*by, "word").mapInArrow(run, schema)

    hits = matches(words, tokens, by).select(*by, "word", "at", F.length("token").alias("n"), "base_id")
    hits = hits.groupBy(*by, "word").agg(F.array_sort(F.collect_list(F.struct("at", "n", "base_id"))).alias("hits"))
    both = words.select(*by, "word").join(hits, [*by, "word"], "left")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for word, own in zip(b.column("word").to_pylist(), b.column("hits").to_pylist(), strict=True):
                at: dict[int, dict[int, int]] = {}
                for h in own or ():
                    at.setdefault(h["at"], {})[h["n"]] = h["base_id"]
                out.append([(a, word[a : a + n], at.get(a, {}).get(n)) for a, n in walk(word, pick, lambda i: at.get(i, ()))])  # noqa: B023
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*by, "word"]), pa.array(out, kind)], names)

    return both.select(*by, "word", "hits").mapInArrow(put, schema)


def corpus_words(text: DataFrame, column: str = "text") -> DataFrame:
    """Distinct words of normalised text, kept for those who read them again. Nothing that normalising or splitting looks at reaches over white space, so they work on what stands between it, once per distinct piece."""
    own = chunk_words(text, column).distinct()
    return kept(own.select(F.explode(script.split_words(script.normalise(F.col("chunk")))).alias("word")).distinct())


def reachable(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """token: the distinct words at which a first run of lengths can end, so few of them that a table of all words isn't needed.

    These are the words whose own beginnings that are words have, together with the word, lengths without a gap. Up to
    NEAR characters a gap is seen by joins that leave few words; what is left is compared at the lengths there are.
    """
    by = by or []
    key = [*by, "token"]
    own = words.select(*by, F.col("word").alias("token"), F.length("word").alias("l")).where("l > 0")

    def begun(of: DataFrame, lengths: list[int]) -> DataFrame:
        """of with c and m: how many of the beginnings of these lengths are words, and the shortest one."""
        at = F.filter(F.array(*map(F.lit, lengths)), lambda n: n < F.col("l"))
        asked = of.select(*by, F.unhex(F.md5("token")).alias("_w"), "token", F.explode(at).alias("_n")).select(*by, "_w", "_n", F.expr("left(token, _n)").alias("_b"))
        known = of.where(F.col("l") <= max(lengths)).select(*by, F.col("token").alias("_b"))
        found = asked.join(known, [*by, "_b"]).groupBy(*by, "_w").agg(F.count(F.lit(1)).alias("c"), F.min("_n").alias("m"))
        return of.withColumn("_w", F.unhex(F.md5("token"))).join(found, [*by, "_w"], "left").drop("_w")

    no_gap = F.col("c").isNull() | (F.col("c") == F.least(F.col("l") - 1, F.lit(NEAR)) - F.col("m") + 1)
    left = kept(begun(own, list(range(1, NEAR + 1))).where(no_gap).select(*key, "l", F.col("c").isNotNull().alias("run")))
    lengths = sorted(r.l for r in left.where(F.col("l") > NEAR).select("l").distinct().collect())  # of the few words that are left
    if not lengths:
        return left.select(*key)
    whole = F.when(F.col("run"), F.coalesce("c", F.lit(0)) == F.col("l") - NEAR - 1).otherwise(F.col("c").isNull() | (F.col("c") == F.col("l") - F.col("m")))
    far = begun(left.where(F.col("l") > NEAR), lengths).where(whole)
    return left.where(F.col("l") <= NEAR).select(*key).unionByName(far.select(*key))


def greedy_pieces(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """word, pieces of words of two characters or more, cut at other words of the corpus."""
    return segment(words.where(F.length("word") > 1), kept(reachable(words, by)), "first_run", by)


def affixes(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """token, role: every character is a prefix; a word's pieces are stems, prefixes and suffixes by number, place and length."""
    by = by or []
    chars = words.select(*by, F.explode(F.split("word", "")).alias("token")).where("token <> ''").select(*by, "token", F.lit("prefix").alias("role"))
    p = greedy_pieces(words, by).select(*by, F.size("pieces").alias("n"), F.posexplode("pieces").alias("k", "p"), F.expr("length(pieces[0].piece) AS l0"), F.expr("coalesce(length(get(pieces, 1).piece), 0) AS l1"))
    role = (
        F.when(F.col("n") == 1, "stem")
        .when(F.col("n") == 2, F.when(F.col("l0") >= F.col("l1"), F.when(F.col("k") == 0, "stem").otherwise("suffix")).otherwise(F.when(F.col("k") == 0, "prefix").otherwise("stem")))
        .otherwise(F.when(F.col("k") == 0, "prefix").when(F.col("k") == 1, "stem").otherwise("suffix"))
    )
    return chars.unionByName(p.select(*by, F.col("p.piece").alias("token"), role.alias("role"))).distinct()


def _long(words: DataFrame) -> DataFrame:
    return words.where(F.length("word") > 1)


def legacy_stems(words: DataFrame) -> DataFrame:
    """Words of two characters or more that have no other such word in them.

    What has a word of two or three characters in it is left out first, before the few others are compared at all lengths.
    """
    long = _long(words).select("word")
    parts = F.array_union(*(F.expr(f"if(length(word) > {k}, transform(sequence(1, length(word) - {k - 1}), i -> substring(word, i, {k})), array())") for k in (2, 3)))
    short = long.where(F.length("word") <= 3).select(F.col("word").alias("token"))
    having = long.where(F.length("word") > 2).select("word", F.explode(parts).alias("token")).join(short, "token", "left_semi").select("word").distinct()
    long = kept(long.join(having, "word", "left_anti"))
    covered = matches(long, long.withColumnRenamed("word", "token")).where(F.col("token") != F.col("word")).select("word").distinct()
    return long.join(covered, "word", "left_anti")


def fold_affixes(known: set[str], texts: list[str]) -> set[str]:
    """Adds texts in order: a text that isn't known is cut at its longest (then leftmost) known part and the rests are added in turn; without such a part it becomes known."""
    for text in texts:
        queue = deque([text])
        while queue:
            piece = queue.popleft()
            if not piece or piece in known:
                continue
            n = len(piece)
            cut = next(((i, m) for m in range(n, 0, -1) for i in range(n - m + 1) if piece[i : i + m] in known), None)
            if cut is None:
                known.add(piece)
            else:
                queue.extend((piece[: cut[0]], piece[sum(cut) :]))
    return known


def legacy_affixes(words: DataFrame) -> DataFrame:
    """token, role (prefix or suffix) of the older split. Its fold depends on the order of all rests, so the distinct rests are folded in one ordered group per role; they grow with the vocabulary, not with the text."""
    stems = kept(legacy_stems(words))
    pairs = matches(_long(words), stems.withColumnRenamed("word", "token")).where(F.col("token") != F.col("word")).groupBy("word", F.col("token").alias("stem")).agg(F.min("at").alias("at"))
    rests = pairs.select("stem", "word", F.explode(F.array(F.struct(F.lit("prefix").alias("role"), F.expr("left(word, at)").alias("text")), F.struct(F.lit("suffix").alias("role"), F.expr("substring(word, at + length(stem) + 1)").alias("text")))).alias("r"))
    rests = rests.select(F.length("stem").alias("a"), "stem", F.length("word").alias("b"), "word", "r.role", "r.text").where("text <> ''")
    single = words.where(F.length("word") == 1).select(F.lit(0).alias("a"), F.col("word").alias("stem"), F.lit(0).alias("b"), "word", F.lit("prefix").alias("role"), F.col("word").alias("text"))
    first = rests.unionByName(single).groupBy("role", "text").agg(F.min(F.struct("a", "stem", "b", "word")).alias("o"))
    ordered = first.select("role", "text", F.row_number().over(Window.partitionBy("role").orderBy("o")).alias("nr"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"token": sorted(fold_affixes(set(), g.sort_values("nr")["text"].tolist()))}).assign(role=g["role"].iloc[0])

    return ordered.groupBy("role").applyInPandas(fold, "token string, role string")


def legacy_split(words: DataFrame) -> DataFrame:
    """token, role of the older split: stems, prefixes and suffixes."""
    return legacy_stems(words).select(F.col("word").alias("token"), F.lit("stem").alias("role")).unionByName(legacy_affixes(words))


def find_all(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """word, token, start, end (from 0, end excluded) of every occurrence of every pattern (token) in the distinct texts (word)."""
    return matches(texts, patterns).select("word", "token", F.col("at").cast("long").alias("start"), (F.col("at") + F.length("token")).cast("long").alias("end"))
