"""Command line: python -m syllaspark train | encode | decode | build-maps."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import script
from .operators import encode as E
from .operators import vocab as V
from .sources import corpus as C


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="syllaspark")
    sub = p.add_subparsers(dest="command", required=True)
    train = sub.add_parser("train", help="learn a vocabulary from text files")
    train.add_argument("--corpus", required=True)
    train.add_argument("--additional-corpus", nargs="*", default=[], help="merged one after the other; raw-script models only")
    train.add_argument("--outdir", required=True)
    train.add_argument("--model", choices=V.MODELS, default="gms")
    train.add_argument("--use-old-algorithm", action="store_true", help="the older split, for gms and cv")
    encode = sub.add_parser("encode", help="ids of a text")
    encode.add_argument("--tokenizer", required=True, help="the folder of a model")
    encode.add_argument("--text", required=True)
    decode = sub.add_parser("decode", help="text of ids")
    decode.add_argument("--tokenizer", required=True)
    decode.add_argument("--ids", nargs="+", type=int, required=True)
    maps = sub.add_parser("build-maps", help="keys of consonant and vowel of all syllables")
    maps.add_argument("--outdir", required=True)
    return p


def run(spark: SparkSession, argv: list[str] | None = None) -> str:
    """What a command prints."""
    a = parser().parse_args(argv)
    if a.command == "train":
        model = E.fit(a.model, C.read_text(spark, a.corpus), old=a.use_old_algorithm)
        for more in a.additional_corpus:
            model = E.Model(a.model, V.merge(a.model, model.vocab, C.read_text(spark, more), old=a.use_old_algorithm), model.roles)
        C.save_pretrained(model, a.outdir)
        C.save_cv_maps(script.cv_keys(spark), a.outdir)
        return f"saved model and maps to {a.outdir}"
    if a.command == "encode":
        docs = spark.createDataFrame([(0, a.text)], "doc_id long, text string")
        return " ".join(str(r.id) for r in E.encode(C.load_pretrained(spark, a.tokenizer), docs).orderBy("pos").collect())
    if a.command == "decode":
        ids = spark.createDataFrame([(0, a.ids)], "doc_id long, ids array<long>")
        return E.decode(C.load_pretrained(spark, a.tokenizer), ids).first().text
    C.save_cv_maps(script.cv_keys(spark), a.outdir)
    return f"saved maps to {a.outdir}"


def main() -> None:
    spark = SparkSession.builder.appName("syllaspark").config("spark.ui.enabled", "false").getOrCreate()
    print(run(spark))
    spark.stop()


if __name__ == "__main__":
    main()
