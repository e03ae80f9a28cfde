"""Reading corpora and saving models: text files or parquet in, parquet tables and JSON out."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import script
from ..operators.encode import Model
from ..operators.vocab import morph_suffixes, tokens_frame

#: What a model's algorithm is called in its JSON file; raw-script models have no such entry.
ALGORITHMS = {"cv": "decomposed", "morph": "morphological", "hybrid": "hybrid"}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """text, a row per line. White space parts words, so lines may be read apart. A missing path is an error."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """text: the lines that aren't blank, without white space around them."""
    ws = script.WS
    return read_text(spark, path).select(F.regexp_replace("text", f"^[{ws}]+|[{ws}]+$", "").alias("text")).where("text <> ''")


def ethiopicised(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", script.transliterate(F.col("text")))


def save_model(model: Model, path: str) -> None:
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    if model.roles is not None:
        model.roles.write.mode("overwrite").parquet(f"{path}/roles")
    meta = model.vocab.agg(F.lit(model.kind).alias("algorithm"), F.lit(script.PAD).alias("pad_token"), F.lit(script.UNK).alias("unk_token"), F.lit(model.roles is not None).alias("has_roles"), F.count(F.lit(1)).alias("vocab_size"))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/tokenizer")


def load_model(spark: SparkSession, path: str) -> Model:
    meta = spark.read.json(f"{path}/tokenizer").first()
    roles = spark.read.parquet(f"{path}/roles") if meta["has_roles"] else None
    return Model(meta["algorithm"], spark.read.parquet(f"{path}/vocab"), roles)


def _write(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """One text file from parts, by the file system of its path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        held: list[str] = []
        for x in parts:
            held.append(x)
            if len(held) == 10_000:
                out.write(bytearray("".join(held).encode()))
                held.clear()
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()


def _listed(rows: DataFrame, item) -> Iterator[str]:
    """The rows as the items of a JSON list or object, one partition at a time."""
    for k, r in enumerate(rows.toLocalIterator()):
        yield ("" if k == 0 else ",\n    ") + item(r)


def save_pretrained(model: Model, path: str) -> None:
    """vocab.json (token: id, specials included) and tokenizer.json (specials, tokens in order of id, and what the algorithm needs), each written row by row.

    For interchange: one file holds all tokens. `save_model` has the form that grows.
    """
    spark = model.vocab.sparkSession
    text = lambda x: json.dumps(x, ensure_ascii=False)
    every = model.all_tokens().orderBy("base_id")

    def vocab() -> Iterator[str]:
        yield "{\n    "
        yield from _listed(every, lambda r: f"{text(r.token)}: {r.base_id}")
        yield "\n}\n"

    lists = {"tokens": model.vocab.orderBy("base_id").select("token")}
    if model.kind == "morph":
        by = {role: model.roles.where(F.col("role") == role).select("token") for role in ("stem", "prefix")}
        listed = tokens_frame(spark, map(script.decompose_py, script.MORPH_PREFIXES))
        lists |= {"stems": by["stem"].orderBy("token"), "prefixes": by["prefix"].unionByName(listed).distinct().orderBy("token"), "suffixes": morph_suffixes(model.roles).orderBy("token")}
    elif model.kind == "hybrid":
        lists["original_corpus_words"] = model.roles.where("role = 'word'").select("token").distinct().orderBy("token")

    def config() -> Iterator[str]:
        head = {"pad_token": script.PAD, "unk_token": script.UNK}
        if model.kind != "gms":
            head |= {"algorithm": ALGORITHMS[model.kind], "fidel_map": dict(script.fidel_pairs())}
        yield "{\n  " + text(head)[1:-1]
        for name, rows in lists.items():
            yield f",\n  {text(name)}: [\n    "
            yield from _listed(rows, lambda r: text(r.token))
            yield "\n  ]"
        yield "\n}\n"

    _write(spark, f"{path}/vocab.json", vocab())
    _write(spark, f"{path}/tokenizer.json", config())


def load_pretrained(spark: SparkSession, path: str) -> Model:
    """A model from its tokenizer.json alone; ids follow the order of its tokens."""
    one = spark.read.option("multiLine", True).json(f"{path}/tokenizer.json")
    kind = "gms" if "algorithm" not in one.columns else {v: k for k, v in ALGORITHMS.items()}[one.first()["algorithm"]]
    vocab = one.select(F.posexplode("tokens").alias("at", "token")).select("token", (F.col("at") + 2).cast("long").alias("base_id"))
    own = {"morph": [("stems", "stem"), ("prefixes", "prefix"), ("suffixes", "suffix")], "hybrid": [("original_corpus_words", "word")]}.get(kind, [])
    roles = None
    for name, role in own:
        part = one.select(F.explode(F.col(name).cast("array<string>")).alias("token")).withColumn("role", F.lit(role))
        roles = part if roles is None else roles.unionByName(part)
    return Model(kind, vocab, roles)


def save_metrics(results: DataFrame, path: str) -> None:
    """The rows of `evaluate` as one JSON list; a row per model."""
    _write(results.sparkSession, path, [json.dumps([r.asDict() for r in results.collect()], ensure_ascii=False, indent=2)])


def save_curve(curve: DataFrame, path: str) -> None:
    """algorithm, step, ppl as one JSON object: the checkpoints, and each algorithm's points."""
    rows = curve.orderBy("algorithm", "step").collect()  # a row per model and step
    points: dict[str, list[dict]] = {}
    for r in rows:
        points.setdefault(r.algorithm, []).append({"step": r.step, "ppl": r.ppl})
    _write(curve.sparkSession, path, [json.dumps({"checkpoints": sorted({r.step for r in rows}), "curves": points}, ensure_ascii=False, indent=2)])


def save_cv_maps(keys: DataFrame, path: str) -> None:
    """key_to_glyph.json, with keys as JSON lists in text, and glyph_to_key.json."""
    spark, rows = keys.sparkSession, keys.orderBy("consonant", "vowel").collect()  # three blocks of the character set at most
    pair = [([r.consonant, r.vowel], r.glyph) for r in rows]
    _write(spark, f"{path}/key_to_glyph.json", [json.dumps({json.dumps(k, ensure_ascii=False): g for k, g in pair}, ensure_ascii=False, indent=2)])
    _write(spark, f"{path}/glyph_to_key.json", [json.dumps({g: k for k, g in pair}, ensure_ascii=False, indent=2)])


def save_vocab_json(model: Model, path: str) -> None:
    """token and id as JSON lines, the specials included."""
    model.all_tokens().select("token", F.col("base_id").alias("id")).write.mode("overwrite").json(path)


def save_cv_keys(keys: DataFrame, path: str) -> None:
    keys.select(F.to_json(F.array("consonant", "vowel")).alias("key"), F.col("glyph").alias("value")).write.mode("overwrite").json(path)


def load_cv_keys(spark: SparkSession, path: str) -> DataFrame:
    pair = F.from_json("key", "array<string>")
    return spark.read.json(path).select(F.col("value").alias("glyph"), pair[0].alias("consonant"), pair[1].alias("vowel"))


def load_fidel_map(spark: SparkSession, path: str) -> DataFrame:
    """glyph, cv of a JSON object, or of the outermost braces of an assignment that has one."""
    body = F.regexp_extract("value", r"(?s)(\{.*\})", 1)
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"#[^\n]*", ""), "'", '"'), r",\s*\}", "}")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(tidy, "map<string,string>")).alias("glyph", "cv"))
