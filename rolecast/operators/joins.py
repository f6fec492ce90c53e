"""Joins that hold when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.session import materialize

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
HOT_KEYS = 10_000
HOT_ROWS = 100_000
# rows with a null key match nothing and are spread over this many slices
NULL_SLICES = 1_024


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join wide rows to a narrow table.

    The small side is written once and measured. Up to ``broadcast_rows`` rows
    and ``BROADCAST_BYTES`` of text it is broadcast, so the wide rows stay where
    they are. Beyond that it is a shuffled join whose hot keys are spread.
    """
    small = materialize(small)
    if small.count() <= broadcast_rows and text_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), list(keys), how)
    return hot_key_join(big, small, keys, spread_by, how, hot_rows)


def text_bytes(df: DataFrame) -> int:
    """Bytes of all rows written as JSON."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0


def hot_key_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner or left join on keys of which some may be very frequent on the left.

    A key with more than ``hot_rows`` left rows is cut into slices of about that
    many rows, by ``spread_by``, and its right rows are copied once per slice:
    all in all at most one copy per ``hot_rows`` left rows. The list of hot keys
    is broadcast; it holds at most ``HOT_KEYS`` rows, and a key outside it owns
    less than 1/``HOT_KEYS`` of the left side.
    """
    keys = list(keys)
    if left.isStreaming:
        return left.join(right, keys, how)
    lacking = reduce(or_, [F.col(k).isNull() for k in keys])
    counts = left.where(~lacking).groupBy(*keys).count().where(F.col("count") > hot_rows)
    slices = F.ceil(F.col("count") / hot_rows).alias("_slices")
    hot = materialize(counts.orderBy(F.desc("count")).limit(HOT_KEYS).select(*keys, slices))
    if hot.isEmpty():
        return left.join(right, keys, how)
    n = F.when(lacking, NULL_SLICES).otherwise(F.coalesce("_slices", F.lit(1)))
    sliced = left.join(F.broadcast(hot), keys, "left").withColumn("_slice", F.pmod(F.xxhash64(spread_by), n))
    copies = right.join(F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.expr("explode(sequence(0L, coalesce(_slices, 1L) - 1))")
    )
    return sliced.drop("_slices").join(copies.drop("_slices"), [*keys, "_slice"], how).drop("_slice")


def one_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key by ``order``, without that column; nulls in it come last.

    The rows are written once. Which of them are first is found on the keys
    alone; wide columns are read for these rows only and in no aggregate.
    """
    stored = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    place = F.struct(F.col(order).isNull(), order, "_row")
    first = materialize(stored.groupBy(key).agg(F.min_by("_row", place).alias("_row"), F.count("*").alias("_n")))
    if first.where("_n > 1").isEmpty():
        return stored.drop(order, "_row")
    return stored.join(first.select("_row"), "_row", "left_semi").drop(order, "_row")
