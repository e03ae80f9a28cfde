"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, repeated_ids, stored, table

#: Runs at the leaves, and the bits of a run's number that a round removes: rounds merge 4 runs into one until one is left.
RUN_BITS, ROUND_BITS = 6, 2
_KEY = ["text_sha256", "norm_len", "norm_check"]
#: Digest ranges: each has a tree of its own, so the last round's runs are dealt over as many tasks as there are ranges.
RANGES = 4096


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: id, code points of the original text, digest of the text without white space, and the run it is in."""
    whole = F.coalesce(F.col(text), F.lit(""))
    norm = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.length(whole).alias("n_points"), norm.alias("_norm")).select(
        "doc_id",
        "n_points",
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        F.length("_norm").alias("norm_len"),
        F.xxhash64("_norm").alias("norm_check"),
        F.pmod(F.spark_partition_id(), F.lit(1 << RUN_BITS)).alias("run"),
    ).withColumn("digest_range", F.pmod(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long"), F.lit(RANGES)).cast("int"))


def _best() -> Column:
    """Orders a group's rows: the longest original text, then the smallest id, null ids last."""
    return F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("keep_id"))


def winners(leaves: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the group's size.

    A run is what some partitions have of a range of digests, sorted by digest. In a round the partitions exchange
    runs: the four whose numbers differ in the lowest bits go to one partition (the exchange is by range and run, and
    the rows are sorted as they come together), are merged there in order, and of each digest only the best row stays.
    Aggregation by sorting reads the merged runs as they lie, without an exchange of its own. So no task ever gets
    more rows of one digest than a round merges, however many copies there are. A second hash and the length are part
    of the key, so a merge is verified at every level: texts of equal digests that differ in them are never taken for
    copies.
    """
    at = ["digest_range", "run"]
    n = n_partitions(leaves.sparkSession)
    level = leaves.groupBy(*at, *_KEY).agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    for _ in range(0, RUN_BITS, ROUND_BITS):
        runs = level.withColumn("run", F.shiftright("run", ROUND_BITS)).repartition(n, *at).sortWithinPartitions(*at, *_KEY)
        level = runs.groupBy(*at, *_KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return level.select(*_KEY, F.col("best.keep_id").alias("keep_id"), "group_size", F.col("best.a").alias("_best_points"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical after deleting white space `[\\x20\\x09-\\x0D]`; a null text counts as empty.
    Of equal texts the one with the most code points stays, then the one with the smallest id; rows that repeat
    both are all marked as kept (the id stays; `dedup_filter` keeps one of them). A null id counts as the largest. Other columns are not read, so
    they may have any name. An empty table gives an empty result.
    """
    leaves = stored(digests(docs, doc_id, text))
    won = winners(leaves)
    # Downwards: what won goes to each run that has the digest, and in the run to its rows.
    runs = leaves.groupBy(*_KEY, "run").agg(F.count(F.lit(1)).alias("_n"))
    down = runs.join(won, _KEY)
    return leaves.join(down, [*_KEY, "run"]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def dedup_filter(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group. Of rows that repeat an id, those with the text that stays; of rows that repeat id and text, one."""
    kept = exact_dedup(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    same = F.col(doc_id).eqNullSafe(F.col("_kept_id"))
    again = repeated_ids(docs, doc_id)
    ids = kept.select("_kept_id").distinct()
    if again is None:
        return docs.join(ids, same, "left_semi")
    # Only rows whose id repeats are digested again, to tell which of them has the text that stays.
    once = docs.join(ids.join(again, F.col("_kept_id").eqNullSafe(F.col("_again")), "left_anti"), same, "left_semi")
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")
    many = docs.join(again, F.col(doc_id).eqNullSafe(F.col("_again")), "left_semi").withColumn("_sha", F.sha2(norm.cast("binary"), 256))
    many = many.join(kept.distinct(), same & (F.col("_sha") == F.col("_kept_sha")), "left_semi").dropDuplicates([doc_id, "_sha"]).drop("_sha")
    return once.unionByName(many)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY pts DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
