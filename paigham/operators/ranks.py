"""Running sums and ranks over a whole table without a task that gets all of it.

A running sum goes in levels: rows of a bucket, buckets of a bucket of buckets. Values of any
distribution are cut into ranges by a sort in parts; ids are their own buckets. Ties are told apart
by what the caller orders by; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paigham.storage import cut

#: Rows that one window may sort, and ids of a bucket.
ONE_WINDOW = 1_000_000
BUCKET = 4096


def _before(c: str, window) -> Column:
    return F.coalesce(F.sum(c).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def running(df: DataFrame, order: Column, sums: tuple[str, ...], one_window: int = ONE_WINDOW) -> DataFrame:
    """``df`` with ``before_<c>`` and ``next_<c>``: of each named column the sum over the rows ahead in ``order``, and the value of the row after.

    A table that one window can sort is sorted by one; a larger one in ranges of the order, each with
    the sums of the ranges ahead and the first row of the next; there are as many as shuffle partitions.
    """
    placed = cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    if placed.count() <= one_window:
        whole = W.partitionBy().orderBy(order)
        return placed.select(*df.columns, *[_before(c, whole).alias(f"before_{c}") for c in sums], *[F.lead(c).over(whole).alias(f"next_{c}") for c in sums])
    own, ranges = W.partitionBy("_range").orderBy(order), W.partitionBy().orderBy("_range")
    firsts = placed.withColumn("_row", F.row_number().over(own)).where("_row = 1").select("_range", *[F.col(c).alias(f"_first_{c}") for c in sums])
    ahead = placed.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums]).join(firsts, "_range")
    ahead = ahead.select("_range", *[_before(c, ranges).alias(f"_ahead_{c}") for c in sums], *[F.lead(f"_first_{c}").over(ranges).alias(f"_after_{c}") for c in sums])
    out = placed.join(F.broadcast(ahead), "_range")
    before = [(F.col(f"_ahead_{c}") + _before(c, own)).alias(f"before_{c}") for c in sums]
    return out.select(*df.columns, *before, *[F.coalesce(F.lead(c).over(own), F.col(f"_after_{c}")).alias(f"next_{c}") for c in sums])


def ranked(df: DataFrame, by: str, within: tuple[str, ...] = (), name: str = "rank", bucket: int = BUCKET) -> DataFrame:
    """``df`` with the rank, from 0, of the whole number ``by`` (within the named columns): rows of a bucket, buckets of a bucket, buckets of those."""
    keys = [F.col(c).alias(f"__{c}") for c in within]
    groups = [f"__{c}" for c in within]
    placed = df.withColumn("__b", F.floor(F.col(by) / bucket)).select("*", *keys)
    sizes = placed.groupBy(*groups, "__b").agg(F.count("*").alias("__m")).withColumn("__bb", F.floor(F.col("__b") / bucket))
    larger = sizes.groupBy(*groups, "__bb").agg(F.sum("__m").alias("__m"))
    larger = larger.select(*groups, "__bb", _before("__m", W.partitionBy(*groups).orderBy("__bb")).alias("__oo"))
    offsets = sizes.join(larger, [*groups, "__bb"]).select(*groups, "__b", (F.col("__oo") + _before("__m", W.partitionBy(*groups, "__bb").orderBy("__b"))).alias("__o"))
    place = F.col("__o") + F.row_number().over(W.partitionBy(*groups, "__b").orderBy(by)) - 1
    return placed.join(offsets, [*groups, "__b"]).withColumn(name, place).drop(*groups, "__b", "__o")
