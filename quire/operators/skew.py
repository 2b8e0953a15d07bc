"""Joins of many rows to one row per key where a few keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: No more than so many keys can be heavy: a heavy key holds at least one in so many of all rows.
HEAVY_KEYS = 10_000
HEAVY_LEAST = 10_000


def heavy_limit(total: int) -> int:
    return max(HEAVY_LEAST, total // HEAVY_KEYS)


def split_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``keyed``, which has one row per key and in column ``n`` the number of rows of that key.

    Keys of ``heavy_limit(total)`` rows or more, at most HEAVY_KEYS by that limit, are broadcast, so their rows aren't
    shuffled by key; all others shuffle, with a bounded number of rows a key. Null keys never match.
    """
    heavy = F.broadcast(keyed.where(F.col(n) >= heavy_limit(total)))
    light = keyed.where(F.col(n) < heavy_limit(total))
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(light, on))


def carried(rows: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null ``value`` up to each row, in the order of (bucket, *order) within group.

    A group of any size is cut into its buckets: each bucket's last value travels alone, and only these, one row a
    bucket, are ordered over the whole group.
    """
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where(F.col(value).isNotNull()).groupBy(group, bucket).agg(F.max_by(value, F.struct(*order)).alias("end_"))
    ends = rows.select(group, bucket).distinct().join(ends, [group, bucket], "left")
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(group, bucket, F.last("end_", ignorenulls=True).over(before).alias("before_"))
    x = rows.withColumn(out, F.last(value, ignorenulls=True).over(within)).join(ends, [group, bucket])
    return x.withColumn(out, F.coalesce(out, "before_")).drop("before_")


def running_sums(rows: DataFrame, group: str, bucket: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each name in ``sums``, the sum of its column up to and with each row, in the order of (bucket, *order) within group, by bucket sums as in ``carried``."""
    n = rows.groupBy(group, bucket).agg(*(F.sum(c).alias(f"{k}_") for k, c in sums.items()))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(group, bucket, *(F.coalesce(F.sum(f"{k}_").over(before), F.lit(0)).alias(f"{k}_") for k in sums))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.select("*", *(F.sum(c).over(within).alias(k) for k, c in sums.items())).join(n, [group, bucket])
    return x.withColumns({k: F.col(k) + F.col(f"{k}_") for k in sums}).drop(*(f"{k}_" for k in sums))


def numbered(rows: DataFrame, group: str, bucket: str, order: list[str], out: str) -> DataFrame:
    """1, 2, 3 ... in the order of (bucket, *order) within group."""
    return running_sums(rows, group, bucket, order, {out: F.lit(1)})


#: Keys that occur more than once are broadcast up to this count (about 50 MB), beyond it they are joined by shuffle.
BROADCAST_KEYS = 500_000


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row per key; rows of null keys are dropped. Keys alone are shuffled to find those that occur more than once, then only the rows of these."""
    x = rows.where(F.col(key).isNotNull())
    again = cut(x.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key))
    n = again.count()
    side = F.broadcast(again) if n <= BROADCAST_KEYS else again
    return x.join(side, key, "left_anti").unionByName(x.join(side, key, "left_semi").dropDuplicates([key])) if n else x
