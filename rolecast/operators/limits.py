"""First rows per group and counts up to them, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.operators.joins import lookup_join

MIN_SLICES = 32


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    unique: Sequence[str],
    rank: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """First ``k`` rows of every group, exactly, also when one group is huge.

    A group is cut to ``k`` rows in each of its slices first (as many as there
    are shuffle partitions, so a huge group uses all of them); the final cut then
    sees at most ``slices * k`` rows per group. ``unique`` names columns that tell
    the rows of a group apart: they spread the rows over the slices and break
    ties. ``rank`` keeps the 1-based position.
    """
    slices = slices or max(MIN_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = rank or "_place"
    by = [*order, *unique]
    within = Window.partitionBy(*keys, "_slice").orderBy(*by)
    whole = Window.partitionBy(*keys).orderBy(*by)
    cut = (
        df.withColumn("_slice", F.pmod(F.xxhash64(*unique), F.lit(slices)))
        .withColumn(place, F.row_number().over(within))
        .where(F.col(place) <= k)
        .withColumn(place, F.row_number().over(whole))
        .where(F.col(place) <= k)
        .drop("_slice")
    )
    return cut if rank else cut.drop(place)


def limit_per_group(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """First ``n`` rows of a group in scan order; the limit is checked after a row
    is taken, so anything below one still gives one."""
    return top_per_group(df, keys, [], max(n, 1), unique=[order])


def scan_counts(scanned: DataFrame, matched: Column, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Per group: rows read until the ``n``-th match (all rows when there are fewer)
    and matches kept. Only one number per group is shuffled beside the partial sums."""
    n = max(n, 1)
    narrow = scanned.select(*keys, order, F.coalesce(matched, F.lit(False)).alias("_hit"))
    nth = (
        top_per_group(narrow.where("_hit"), keys, [], n, unique=[order], rank="_match")
        .groupBy(*keys)
        .agg(F.max("_match").alias("_kept"), F.max(order).alias("_last"))
        .select(*keys, "_kept", F.when(F.col("_kept") == n, F.col("_last")).alias("_stop"))
    )
    joined = lookup_join(narrow, nth, keys, spread_by=order)
    read = F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))
    return joined.groupBy(*keys).agg(
        F.count_if(read).alias("scanned"), F.coalesce(F.max("_kept"), F.lit(0)).cast("bigint").alias("kept")
    )
