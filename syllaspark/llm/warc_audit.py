"""WARC fixity audit: Merkle trees over records and ordered offset ranges; replicas are compared from the root down.

Records lie in archives, in order, at byte offsets. The records of a range of RANGE_BYTES offsets make a leaf: the hash
of their places, lengths and digests in order. Sixteen neighbouring ranges make a node, and so on up to the archive's
root; the roots of the archives in a slot make the slot's hash, and sixteen slots a node, up to the root of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import forget, stored, table

#: Children of a node, as bits; levels of ranges in an archive below its root; consecutive ids of an archive, as bits; archives' rows of a slot, about.
FAN_BITS, RANGE_LEVELS, ARCHIVE_BITS, SLOT_ROWS = 4, 2, 10, 1024
RANGE_BYTES = 1 << 16
#: Different records of one id beyond which they are spread over archives by their digests.
HOT_RECORDS = 4096
_RECORD = ["page_id", "record_sha256", "record_length"]


def record(url: Column, body: Column) -> Column:
    """A page as the text of a WARC response record."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def digests(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, record_sha256, record_length, copies: the different records of each id and how often each is there."""
    rec = record(F.col(url), F.col(body))
    rows = pages.select(F.col(page_id).alias("page_id"), F.sha2(rec.cast("binary"), 256).alias("record_sha256"), F.octet_length(rec).cast("long").alias("record_length"))
    return rows.groupBy(*_RECORD).agg(F.count(F.lit(1)).alias("copies"))


def manifest(records: DataFrame, spread_ids: DataFrame) -> DataFrame:
    """Adds archive_id, record_offset and paired to `digests`.

    An archive holds the pages of 1,024 consecutive ids in order of id and digest (ids that are no integers: of their
    hash); a record's offset is the length of all records before it in its archive, copies included. Records with a
    null id, or one of `spread_ids` (page_id), have their archive by digest, so no archive is large; paired is false.
    """
    whole = isinstance(records.schema["page_id"].dataType, IntegralType)
    place = F.col("page_id").cast("long") if whole else F.xxhash64("page_id")
    rows = records.join(spread_ids.select(F.col("page_id").alias("_spread")), F.col("page_id") == F.col("_spread"), "left")
    rows = rows.withColumn("paired", F.col("page_id").isNotNull() & F.col("_spread").isNull()).drop("_spread")
    rows = rows.withColumn("archive_id", F.when(F.col("paired"), F.shiftright(place, ARCHIVE_BITS)).otherwise(F.shiftright(F.xxhash64("record_sha256"), ARCHIVE_BITS)))
    before = Window.partitionBy("archive_id").orderBy("page_id", "record_sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("record_offset", F.coalesce(F.sum(F.col("record_length") * F.col("copies")).over(before), F.lit(0)))


def _sha(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(parts), ",").cast("binary"), 256)


def _number(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 20, "0")


def tree(records: DataFrame, slot_levels: int) -> DataFrame:
    """(level, archive_id, node, hash) of a manifest.

    Level 0: an archive's offset ranges (node: offset div RANGE_BYTES); up to RANGE_LEVELS: sixteen ranges each; the
    next: archives (node: slot); above them, archive_id is null: slots, and sixteen slots each up to the root.
    A hash covers the numbers and hashes of what is below it in order. Each level is an aggregation of small groups.
    """
    entry = F.concat_ws(":", _number("record_offset"), "record_length", "copies", "record_sha256", F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
    level = records.withColumn("node", F.expr(f"record_offset div {RANGE_BYTES}")).groupBy("archive_id", "node").agg(_sha(F.collect_list(entry)).alias("hash"))
    out = level.select(F.lit(0).alias("level"), "archive_id", "node", "hash")
    child = F.concat_ws(":", _number("node"), "hash")
    for k in range(1, RANGE_LEVELS + 1):
        level = level.withColumn("_up", F.shiftright("node", FAN_BITS)).groupBy("archive_id", "_up").agg(_sha(F.collect_list(child)).alias("hash")).withColumnRenamed("_up", "node")
        out = out.unionByName(level.select(F.lit(k).alias("level"), "archive_id", "node", "hash"))
    slot = F.pmod(F.xxhash64("archive_id"), F.lit(1 << FAN_BITS * slot_levels))
    level = level.groupBy("archive_id").agg(_sha(F.collect_list(child)).alias("hash")).withColumn("node", slot)
    out = out.unionByName(level.select(F.lit(RANGE_LEVELS + 1).alias("level"), "archive_id", "node", "hash"))
    level = level.groupBy("node").agg(_sha(F.collect_list(F.concat_ws(":", "archive_id", "hash"))).alias("hash"))
    for k in range(RANGE_LEVELS + 2, RANGE_LEVELS + 3 + slot_levels):
        out = out.unionByName(level.select(F.lit(k).alias("level"), F.lit(None).cast("long").alias("archive_id"), "node", "hash"))
        level = level.withColumn("_up", F.shiftright("node", FAN_BITS)).groupBy("_up").agg(_sha(F.collect_list(child)).alias("hash")).withColumnRenamed("_up", "node")
    return out


def differing(ours: DataFrame, theirs: DataFrame, slot_levels: int) -> DataFrame | None:
    """archive_id, node: the offset ranges whose leaves differ between two stored trees; None if the roots are equal.

    From the roots down, a level a step; only children of nodes that differ are compared, and what differs is written
    to the shared folder before the next level is read.
    """
    archives = RANGE_LEVELS + 1
    bad = None
    for k in range(archives + 1 + slot_levels, -1, -1):
        sides = [t.where(F.col("level") == k).select("archive_id", "node", F.col("hash").alias(n)) for t, n in ((ours, "ours"), (theirs, "theirs"))]
        if bad is not None:  # the parent of a slot and of a range is a sixteenth; of an archive its slot; of an archive's highest ranges the archive
            up = F.col("_node") == (F.col("node") if k == archives else F.shiftright("node", FAN_BITS))
            same = F.col("_archive") == F.col("archive_id")
            on = up if k >= archives else same if k == archives - 1 else same & up
            parents = bad.select(F.col("archive_id").alias("_archive"), F.col("node").alias("_node"))
            sides = [s.join(parents, on, "left_semi") for s in sides]
        a, b = (s.withColumn("_a", F.coalesce("archive_id", F.lit(0))) for s in sides)
        found = a.join(b.drop("archive_id"), ["_a", "node"], "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs")))
        now = stored(found.select((F.col("_a") if k <= archives else F.lit(None).cast("long")).alias("archive_id"), "node"))
        if bad is not None:
            forget(bad)
        bad = now
        if k == archives + 1 + slot_levels and not bad.limit(1).count():  # below it, a node that differs has a child that does
            return None
    return bad


def audit(ours: DataFrame, theirs: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, archive_id, record_offset, record_length, kind, expected_sha256, found_sha256: a row per record that two replicas don't share.

    Replicas are compared as multisets of records, so a copy too few or too many counts. kind: missing (only in ours),
    extra (only in theirs), or altered: a missing and an extra record of one id, paired in order of their digests.
    Records with a null id can't be told apart by it and are never paired, nor are those of an id with more than
    HOT_RECORDS different records. Offsets and lengths are those of our archive, null for extra records (their
    archive_id: where they lie in theirs). Null url or body count as empty. Ids may be of any type, with repeats; other
    columns are not read. Equal replicas and empty tables give an empty result.
    """
    mine, other = (stored(digests(x, page_id, url, body)) for x in (ours, theirs))
    both = mine.select("page_id", "record_sha256").unionByName(other.select("page_id", "record_sha256")).where(F.col("page_id").isNotNull())
    hot = stored(both.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_RECORDS).select("page_id"))
    rows = max(mine.count(), other.count())
    slot_levels = max(1, -(-max(1, rows // SLOT_ROWS).bit_length() // FAN_BITS))
    mine, other = (stored(manifest(x, hot)) for x in (mine, other))
    a, b = (stored(tree(x, slot_levels), ["level"]) for x in (mine, other))
    places = differing(a, b, slot_levels)
    forget(a, b)

    # The records of ranges that differ, as multisets: shifted ones are in both and drop out.
    sides = []
    for x in (mine, other):
        x = x.withColumn("_node", F.expr(f"record_offset div {RANGE_BYTES}"))
        at = (places if places is not None else x.select("archive_id", F.col("_node").alias("node")).limit(0)).select(F.col("archive_id").alias("_pa"), F.col("node").alias("_pn"))
        sides.append(x.join(at, (F.col("archive_id") == F.col("_pa")) & (F.col("_node") == F.col("_pn")), "left_semi").drop("_node"))
    own = sides[0].select(*[F.col(c).alias(f"_o_{c}") for c in sides[0].columns])
    on = F.col("page_id").eqNullSafe(F.col("_o_page_id")) & (F.col("record_sha256") == F.col("_o_record_sha256"))
    pairs = own.join(sides[1], on, "full_outer")
    n = F.coalesce("_o_copies", F.lit(0)) - F.coalesce("copies", F.lit(0))
    pick = lambda c: F.coalesce(f"_o_{c}", c).alias(c)
    odd = pairs.where(n != 0).select(pick("page_id"), pick("archive_id"), pick("record_sha256"), pick("paired"), F.col("_o_record_length").alias("length"), F.col("_o_record_offset").alias("offset"), F.abs(n).alias("n"), (n > 0).alias("lost"))
    # A copy each; of ids that may be paired, numbered on both sides in order of digest.
    first = Window.partitionBy("page_id", "lost").orderBy("record_sha256").rowsBetween(Window.unboundedPreceding, -1)
    every = odd.select("*", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("k", "_copy")).drop("_copy")
    single = every.where(~F.col("paired")).withColumn("nr", F.lit(None).cast("long"))
    numbered = odd.where("paired").withColumn("_before", F.coalesce(F.sum("n").over(first), F.lit(0))).select("*", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("k", "_copy"))
    numbered = numbered.withColumn("nr", F.col("_before") + F.col("k")).drop("_copy", "_before")
    place = F.when(F.col("lost"), F.col("offset") + F.col("k") * F.col("length"))
    at = "archive_id", place.alias("record_offset"), F.when(F.col("lost"), F.col("length")).alias("record_length")
    alone = single.select("page_id", *at, F.when(F.col("lost"), "missing").otherwise("extra").alias("kind"), F.when(F.col("lost"), F.col("record_sha256")).alias("expected_sha256"), F.when(~F.col("lost"), F.col("record_sha256")).alias("found_sha256"))
    lost = numbered.where("lost").select("page_id", "nr", *at, F.col("record_sha256").alias("expected_sha256"))
    new = numbered.where("NOT lost").select("page_id", "nr", F.col("archive_id").alias("_at"), F.col("record_sha256").alias("found_sha256"))
    kind = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "extra").otherwise("altered")
    met = lost.join(new, ["page_id", "nr"], "full_outer").select("page_id", F.coalesce("archive_id", "_at").alias("archive_id"), "record_offset", "record_length", kind.alias("kind"), "expected_sha256", "found_sha256")
    return met.unionByName(alone)


def damaged(pages: DataFrame) -> DataFrame:
    """A second copy of the pages with damage by a fixed rule, as there is only one copy to test with: of the ids' remainders by 97, at one the body has an extra byte, at one the page is gone."""
    kind = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(97))
    return pages.where(kind != 1).select("page_id", "url", F.when(kind == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("~"))).otherwise(F.col("html")).alias("html"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


_SQL_RECORD = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen({body}) || repeat(chr(13) || chr(10), 2) || {body} || repeat(chr(13) || chr(10), 2)"
#: A plain comparison of both copies; ids of pages don't repeat.
SQL = f"""
WITH a AS (SELECT page_id, {_SQL_RECORD.format(body="coalesce(html, '')")} AS r, {_SQL_RECORD.format(body="(coalesce(html, '') || '~')")} AS other FROM pages),
b AS (SELECT page_id, sha256(r) AS sha, strlen(r) AS n, CASE page_id % 97 WHEN 0 THEN sha256(other) WHEN 1 THEN NULL ELSE sha256(r) END AS found FROM a),
c AS (SELECT *, page_id >> {ARCHIVE_BITS} AS archive_id, coalesce(sum(n) OVER (PARTITION BY page_id >> {ARCHIVE_BITS} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM b)
SELECT page_id, archive_id, CAST(at_ AS BIGINT) AS record_offset, CAST(n AS BIGINT) AS record_length, CASE WHEN found IS NULL THEN 'missing' ELSE 'altered' END AS kind, sha AS expected_sha256, found AS found_sha256
FROM c WHERE found IS NULL OR found <> sha
"""
