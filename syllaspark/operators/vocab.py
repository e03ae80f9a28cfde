"""Vocabularies: the union of what a corpus teaches and of fixed tokens, with ids by length and code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import script
from ..sources.tables import kept
from .segment import affixes, corpus_words, legacy_split

MODELS = ("gms", "cv", "morph", "hybrid")


def tokens_frame(spark: SparkSession, tokens) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tokens], "token string")


def with_ids(tokens: DataFrame, rank: str = "0") -> DataFrame:
    """token, base_id (from 2; 0 and 1 are <unk> and <pad>), by rank, then the longest first, then code points.

    Tokens are parted into ranges of that order and sorted within them; a range's first id is the number of tokens
    in the ranges before it. So no task has more than a range.
    """
    t = tokens.where(~F.col("token").isin(script.UNK, script.PAD)).select("token", F.expr(rank).alias("r"), (-F.length("token")).alias("l"))
    order = ["r", "l", "token"]
    ranged = kept(t.repartitionByRange(*order).sortWithinPartitions(*order).select("token", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)  # the partition's number; below it the row's
    sizes = [(r.p, r.n) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()]  # a row per partition
    first, rows = 2, []
    for p, n in sizes:
        rows.append((p, first))
        first += n
    firsts = F.broadcast(ranged.sparkSession.createDataFrame(rows, "p long, f long"))
    return ranged.join(firsts, part == F.col("p")).select("token", (F.col("f") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("base_id"))


def script_words(model: str, words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The distinct words in the model's script."""
    by = by or []
    return words.select(*by, "word") if model == "gms" else words.select(*by, script.decompose(F.col("word")).alias("word")).distinct()


def words_for(model: str, text: DataFrame) -> DataFrame:
    return script_words(model, corpus_words(text))


def fixed_tokens(model: str) -> list[str]:
    if model == "gms":
        return [*script.custom_tokens(), " "]
    extra = {"cv": [], "morph": script.MORPH_SUFFIXES + script.MORPH_PREFIXES, "hybrid": script.HYBRID_SUFFIXES + script.HYBRID_PREFIXES}[model]
    return sorted({*(cv for _, cv in script.fidel_pairs()), " ", *map(script.decompose_py, extra)})


def learnt(model: str, words: DataFrame, by: list[str] | None = None, old: bool = False) -> DataFrame:
    """token, role of a corpus's distinct normalised words, in the model's script; the hybrid model also knows its words as they are written (role `word`).

    old: by the older split, which the morphological and hybrid models don't have.
    """
    own = script_words(model, words, by)
    if old and model in ("gms", "cv"):
        return legacy_split(own)
    roles = affixes(own if model == "gms" else kept(own), by)
    return roles.unionByName(words.select(*(by or []), F.col("word").alias("token"), F.lit("word").alias("role"))) if model == "hybrid" else roles


def vocabulary_tokens(model: str, roles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The tokens of (token, role): a whole word of the hybrid model stands in its CV form."""
    token = F.when(F.col("role") == "word", script.decompose(F.col("token"))).otherwise(F.col("token")) if model == "hybrid" else F.col("token")
    return roles.select(*(by or []), token.alias("token"))


def morph_suffixes(roles: DataFrame) -> DataFrame:
    """token: the suffixes that the morphological model has learnt, and the listed ones."""
    listed = tokens_frame(roles.sparkSession, map(script.decompose_py, script.MORPH_SUFFIXES))
    return roles.where("role = 'suffix'").select("token").unionByName(listed).distinct()


def vocabulary(model: str, roles: DataFrame) -> DataFrame:
    """token, base_id of a model from its (token, role) table."""
    spark = roles.sparkSession
    fixed = tokens_frame(spark, fixed_tokens(model))
    if model != "morph":
        return with_ids(vocabulary_tokens(model, roles).unionByName(fixed).distinct())
    own = [("suffix", script.MORPH_SUFFIXES), ("prefix", script.MORPH_PREFIXES)]
    listed = spark.createDataFrame([(script.decompose_py(x), role) for role, xs in own for x in xs], "token string, role string")
    rank = F.expr("CASE role WHEN 'suffix' THEN 0 WHEN 'prefix' THEN 1 WHEN 'stem' THEN 2 ELSE 3 END")
    every = roles.unionByName(listed).unionByName(fixed.withColumn("role", F.lit("other")))
    # A token that is shown like a listed affix (a bare consonant, say) is ranked like one.
    shown = script.recompose(F.col("token"))
    as_listed = F.when(shown.isin(script.MORPH_SUFFIXES), 0).when(shown.isin(script.MORPH_PREFIXES), 1).otherwise(3)
    return with_ids(every.groupBy("token").agg(F.min(rank).alias("rk")).withColumn("rk", F.least("rk", as_listed)), "rk")


def train(model: str, text: DataFrame, old: bool = False) -> DataFrame:
    return vocabulary(model, learnt(model, corpus_words(text), old=old))


def merge(model: str, vocab: DataFrame, text: DataFrame, old: bool = False) -> DataFrame:
    """A vocabulary with another corpus's tokens added; all ids may change."""
    more = vocabulary_tokens(model, learnt(model, corpus_words(text), old=old))
    return with_ids(vocab.select("token").unionByName(more).distinct())


def train_many(model: str, texts: list[DataFrame], old: bool = False) -> DataFrame:
    """One vocabulary of several corpora, each cut at its own words only."""
    if not texts:
        raise ValueError("no corpus")
    return vocabulary(model, reduce(DataFrame.unionByName, (learnt(model, corpus_words(t), old=old) for t in texts)).distinct())
