"""Seen sets as bitmaps.

A user's items of a day are bits of a few fixed-size bitmaps, one for every
``BITS`` consecutive item ids. Days are merged by a bitwise or, so a set is kept
up day by day without its items being listed again, and a candidate is masked by
one bit of one bitmap: no array is searched and no set is exploded.

A bitmap of a few items is all but empty, so what moves and is sorted are the
items; a task makes the bitmaps of a user and bucket and merges them as they come,
and holds one of them at a time.

Item ids are positive; rows without user or item belong to no set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32_768  # of the engine's bitmap functions


def seen_bitmaps(pairs: DataFrame, user: str = "user_id", item: str = "movie_id", *parts: str) -> DataFrame:
    """user, (parts), bucket, bits: a bitmap a user, part and bucket of items.
    The rows of a user and bucket lie together and in the order of the keys, which
    ``merged`` needs too: no bitmap is shuffled or sorted."""
    at = F.col(item).cast("long")
    known = pairs.where(F.col(user).isNotNull() & F.col(item).isNotNull()).select(
        user, F.bitmap_bucket_number(at).alias("bucket"), *parts, F.bitmap_bit_position(at).alias("_bit"))
    return (known.repartition(user, "bucket").groupBy(user, "bucket", *parts).agg(F.bitmap_construct_agg("_bit").alias("bits"))
            .select(user, *parts, "bucket", "bits"))


def merged(bitmaps: DataFrame, user: str = "user_id") -> DataFrame:
    """user, bucket, bits over all parts."""
    return bitmaps.groupBy(user, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def has_bit(bits: Column, position: Column) -> Column:
    """Whether the bit is set; the first bit is the lowest of the first byte."""
    byte = F.conv(F.hex(F.substring(bits, (F.expr("1") + F.floor(position / 8)).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def flagged(recs: DataFrame, seen: DataFrame, user: str = "user_id", item: str = "movie_id") -> DataFrame:
    """``recs`` with ``_hit``, 1 where the user's bitmap holds the item. The join
    is on (user, bucket): a user's candidates meet one row a bucket."""
    at = F.col(item).cast("long")
    rows = recs.withColumn("bucket", F.bitmap_bucket_number(at)).join(seen, [user, "bucket"], "left")
    return rows.withColumn("_hit", F.when(has_bit(F.col("bits"), F.bitmap_bit_position(at)), F.lit(1))).drop("bucket", "bits")


def set_sizes(bitmaps: DataFrame, user: str = "user_id") -> DataFrame:
    """user, n_items from bitmaps of distinct buckets."""
    return bitmaps.groupBy(user).agg(F.sum(F.bitmap_count("bits")).alias("n_items"))
