"""Streams: micro-batches of documents are encoded by a fixed model, or grow a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import encode as E
from ..operators.vocab import merge
from ..sources.tables import keeping


def encode_stream(stream: DataFrame, model: E.Model, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the tokens of a stream (doc_id, text) to a parquet table. A batch is written to its own folder, so a retried batch replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        with keeping():
            E.encode(model, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grow_vocabulary(stream: DataFrame, kind: str, start: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merges each batch's tokens into a vocabulary, one version per batch under path."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = start if number == 0 else spark.read.parquet(f"{path}/version={number - 1}")
        with keeping():
            merge(kind, before, batch).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
