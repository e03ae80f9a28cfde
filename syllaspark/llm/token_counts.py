"""Token counts under a unigram vocabulary: a Viterbi pass that carries scores and counts only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, table, texts_of

VOCABULARY = "piece_bpe_32k.model"


def token_counts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens long, score double (the best segmentation's sum of scores) of every row.

    path: a sentencepiece model file whose pieces and scores are taken as the unigram vocabulary. The file given is that
    of a byte-pair tokenizer, whose scores are its merges' ranks: the counts are those of the best unigram segmentation
    under these scores, not those of that tokenizer (see README). No file at hand has unigram scores, and none is
    trained here. Null and empty texts have 0 tokens; rows that repeat an id are counted one by one; other columns are
    not read; an empty table gives no rows. One narrow pass over whole texts.
    """
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import unigram_counts

        for b in cut(batches, "_text", 6_000_000, keep=True):
            n, score = unigram_counts(texts_of(b, "_text"), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(score)], ["doc_id", "n_tokens", "score"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return ids.mapInArrow(run, f"doc_id {ids.schema[0].dataType.simpleString()}, n_tokens long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


#: A segmentation has no SQL form; the query is tested against the public tokenizer library.
SQL = None
