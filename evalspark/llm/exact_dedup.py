"""Exact copies by an extendible-hash index kept as a table in the shared folder.

The distinct hashes of all texts build the directory. It starts as one bucket and doubles wherever a
bucket is overfull, until every bucket holds at most ``BUCKET_ENTRIES`` hashes. A bucket is a range of hashes and
has one owner task. Copies are first folded in ``LANES`` lanes, so that a group of any size reaches its
owner as at most one row a lane, with its bytes. The owner compares the bytes of the rows of each
hash: equal ones are one entry, and entries of equal hash and different bytes are chained. Rows
find their hash through the directory, and their entry in a chain of several by its digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import saved
from evalspark.session import scratch_path

BLANKS = r"[\x20\x09-\x0D]+"
BUCKET_ENTRIES = 1 << 13
# a hash has so many leading bits that the directory can use
MAX_DEPTH = 24
HASH_BITS = 64
# a group comes to its owner in at most so many rows
LANES = 16
# pointers of a directory of so many bits, 24 bytes each, may be broadcast
BROADCAST_DEPTH = 18


def normalized(text: Column) -> Column:
    """The text with every run of ASCII blanks as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _prefix(hash_: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a hash, as a number."""
    # a shift by 64 would be a shift by 0
    wide = F.shiftrightunsigned(hash_, HASH_BITS - MAX_DEPTH)
    return F.call_function("shiftright", wide, (F.lit(MAX_DEPTH) - depth).cast("int"))


def directory(entries: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """Buckets (``depth``, ``prefix``, ``entries``) of the hash column ``h``.

    A bucket of depth d holds the hashes that begin with its d bits. It is the shallowest on its
    path that isn't overfull; at ``MAX_DEPTH`` a bucket takes any load.
    """
    leaves = entries.groupBy(_prefix(F.col("h"), F.lit(MAX_DEPTH)).alias("slot")).count()
    loads = (
        leaves.select("count", "slot", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
        .select(
            "count",
            "depth",
            F.call_function("shiftright", F.col("slot"), F.lit(MAX_DEPTH) - F.col("depth")).alias("prefix"),
        )
        .groupBy("depth", "prefix")
        .agg(F.sum("count").alias("entries"))
    )
    fits = (F.col("entries") <= capacity) | (F.col("depth") == MAX_DEPTH)
    # a bucket exists if its parent was split; an overfull one is split in its turn
    split = loads.where(~fits).select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")
    )
    children = loads.where(fits).withColumn(
        "parent", F.call_function("shiftright", F.col("prefix"), F.lit(1))
    )
    root = children.where(F.col("depth") == 0)
    return (
        children.where(F.col("depth") > 0)
        .join(split, ["depth", "parent"], "left_semi")
        .unionByName(root)
        .select("depth", "prefix", "entries")
    )


def pointers(buckets: DataFrame, depth: int) -> DataFrame:
    """The directory at its global depth: the bucket of every ``slot`` of so many bits.

    A bucket of smaller depth has several slots that point to it.
    """
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(depth) - F.col("depth"))
    first = F.col("prefix") * width
    return buckets.select(
        F.explode(F.sequence(first, first + width - 1)).alias("slot"), "depth", "prefix"
    )


def group_copies(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. The smallest doc_id of a group stays; a
    null or empty text is the empty text, text of blanks alone is one space. A null doc_id is larger than any
    other; rows with the doc_id that stays are all marked ``kept``. Other columns of ``docs`` play no part.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", normalized(F.col("text")).alias("body")).withColumn(
        "h", F.xxhash64("body")
    )
    hashes = keyed.select("h").distinct()
    buckets = saved(directory(hashes, capacity), scratch_path(spark, "copy-directory"))
    depth = buckets.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    owners = pointers(buckets, depth)
    if depth <= BROADCAST_DEPTH:
        owners = F.broadcast(owners)
    slot = _prefix(F.col("h"), F.lit(depth))
    lanes = (
        keyed.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
        .groupBy("lane", "h", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    )
    in_bucket = Window.partitionBy("depth", "prefix", "h")
    index = saved(
        lanes.withColumn("slot", slot)
        .join(owners, "slot")
        .repartition("depth", "prefix")
        # rows of equal bytes have the same place in the chain of their hash
        .withColumn("chain", F.dense_rank().over(in_bucket.orderBy("body")))
        .select("depth", "prefix", "h", "chain", F.sha2("body", 256).alias("text_sha256"), "keep_id", "copies")
        .groupBy("depth", "prefix", "h", "chain")
        .agg(
            F.min("text_sha256").alias("text_sha256"),
            F.min("keep_id").alias("keep_id"),
            F.sum("copies").alias("group_size"),
        )
        .withColumn("chained", F.count(F.lit(1)).over(in_bucket)),
        scratch_path(spark, "copy-index"),
    )
    rows = keyed.select("doc_id", "h", F.sha2("body", 256).alias("digest"))
    found = (F.col("chained") == 1) | (F.col("digest") == F.col("text_sha256"))
    return (
        rows.withColumn("slot", slot)
        .join(owners, "slot")
        .join(index, ["depth", "prefix", "h"])
        .where(found)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )
