"""Facet options that narrow as facets are chosen, from landed memberships.

Which posting carries which value is kept as bitmaps: one bit for each posting,
one bitmap for each value of a facet and 32,768 postings. What is chosen is the
OR of the values' bitmaps inside a facet and the AND of the facets; what an
option would leave is the AND with its own bitmap. Only bitmaps move, and a value
that a third of all postings carry is as many rows as there are bitmaps.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.operators.facets import merge_facet_rows, search_options, unresolved_queries
from rolecast.operators.joins import lookup_join
from rolecast.session import materialize

VALUE = ("source_ord", "facet_key", "value")


class FacetIndex(NamedTuple):
    """``bits``: ``source_ord, facet_key, value, bucket, bitmap``; ``numbers``: ``source_ord, url, number``."""

    bits: DataFrame
    numbers: DataFrame


class Resolved(NamedTuple):
    """``matches``: the options chosen for each query, best first; ``misses``: ``source, query`` without any;
    ``facets``: ``source, facet_key, value, ord`` of everything chosen, repeats removed."""

    matches: DataFrame
    misses: DataFrame
    facets: DataFrame


def facet_index(members: DataFrame) -> FacetIndex:
    """The bitmaps of ``members`` (``source_ord``, ``url``, ``facet_key``, ``value``), stored.

    Postings are numbered in the order of their sites, so that a site's postings
    share few bitmaps; a site of any size is spread over the partitions. Rows
    with a null in these columns carry nothing.
    """
    members = members.select("source_ord", "url", "facet_key", "value").dropna()
    postings = members.select("source_ord", "url").distinct()
    dealt = postings.repartitionByRange("source_ord", "url").sortWithinPartitions("source_ord", "url")
    numbers = materialize(dealt.withColumn("number", F.monotonically_increasing_id() + 1))
    rows = members.join(numbers, ["source_ord", "url"])
    bits = rows.groupBy(*VALUE, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
    )
    return FacetIndex(materialize(bits), numbers)


def selection(index: FacetIndex, chosen: DataFrame) -> DataFrame:
    """``source_ord, bucket, bitmap``: the postings that carry, for every facet in ``chosen``, one of its values."""
    chosen = chosen.select(*VALUE).distinct()
    asked = chosen.groupBy("source_ord").agg(F.count_distinct("facet_key").alias("_asked"))
    picked = index.bits.join(chosen, list(VALUE), "left_semi")
    by_facet = picked.groupBy("source_ord", "facet_key", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    every = by_facet.groupBy("source_ord", "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("_met"))
    return every.join(asked, "source_ord").where("_met = _asked").select("source_ord", "bucket", "bitmap")


def recounted(index: FacetIndex, selected: DataFrame) -> DataFrame:
    """``source_ord, facet_key, value, left``: how many selected postings carry each value; values that none carries are absent."""
    mask = selected.select("source_ord", "bucket", F.col("bitmap").alias("_mask"))
    both = index.bits.join(mask, ["source_ord", "bucket"])
    pairs = both.select(*VALUE, "bucket", F.explode(F.array("bitmap", "_mask")).alias("bitmap"))
    met = pairs.groupBy(*VALUE, "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
    return met.groupBy(*VALUE).agg(F.sum(F.bitmap_count("bitmap")).alias("left")).where(F.col("left") > 0)


def carrying(index: FacetIndex, postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``postings`` (``source_ord``, ``url``) in the selection; sites without a choice keep all."""
    asked = chosen.select("source_ord").distinct().withColumn("_asked", F.lit(True))
    sides = lookup_join(postings, asked, ["source_ord"], spread_by="url")
    free, bound = sides.where("_asked is null").drop("_asked"), sides.where("_asked is not null").drop("_asked")
    numbered = index.numbers.withColumn("bucket", F.bitmap_bucket_number("number")).withColumn("bit", F.bitmap_bit_position("number"))
    held = lookup_join(numbered, selection(index, chosen), ["source_ord", "bucket"], spread_by="number", how="inner")
    # bytes count from the first, the bits of a byte from the lowest
    byte = F.expr("cast(conv(hex(substring(bitmap, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")
    inside = held.where(F.call_function("getbit", byte, F.expr("cast(bit % 8 as int)")) == 1)
    return free.unionByName(lookup_join(bound, inside.select("source_ord", "url"), ["source_ord", "url"], spread_by="url", how="left_semi"))


def narrowed_options(options: DataFrame, index: FacetIndex, chosen: DataFrame) -> DataFrame:
    """``options`` (with ``source_ord``) as ``chosen`` leaves them: counted again, without those that no posting carries.

    Sites where nothing is chosen keep their landed options and counts.
    """
    asked = chosen.select("source_ord").distinct().withColumn("_asked", F.lit(True))
    counts = recounted(index, selection(index, chosen))
    rows = options.join(asked, "source_ord", "left").join(counts, list(VALUE), "left")
    kept = rows.where(F.col("_asked").isNull() | F.col("left").isNotNull())
    return kept.withColumn("count", F.when(F.col("_asked"), F.col("left").cast("int")).otherwise(F.col("count"))).select(*options.columns)


def resolve_in_turn(
    options: DataFrame,
    index: FacetIndex,
    base: DataFrame,
    queries: Sequence[str],
    max_matches: int = 1,
    strict: bool = False,
) -> Resolved:
    """Choose options for one location query after the other; each sees what the ones before have left.

    ``options`` are facet options with ``source`` and ``source_ord``, ``base`` the
    facet rows chosen beforehand (``source``, ``source_ord``, ``facet_key``,
    ``value``, ``ord`` with the parts ``a`` and ``b``).
    """
    first = F.struct(F.lit(0).alias("part"), F.col("ord.a").cast("long").alias("a"), F.col("ord.b").cast("long").alias("b"))
    chosen = materialize(base.select("source", *VALUE, first.alias("ord")))
    columns = ["source", "source_ord", "query", "query_no", "rank", "facet_key", "value", "label", "count", "score"]
    matches = None
    for n, query in enumerate(queries):
        left = narrowed_options(options, index, chosen)
        found = search_options(left, [query], max(max_matches, 1), location_only=True, strict=strict)
        found = materialize(found.withColumn("query_no", F.lit(n)).select(*columns))
        then = F.struct(F.lit(1).alias("part"), F.lit(n).cast("long").alias("a"), F.col("rank").cast("long").alias("b"))
        chosen = chosen.unionByName(found.select("source", *VALUE, then.alias("ord")))
        matches = found if matches is None else matches.unionByName(found)
    if matches is None:
        matches = options.where("false").select(
            "source", "source_ord", F.lit("").alias("query"), F.lit(0).alias("query_no"), F.lit(0).alias("rank"),
            "facet_key", "value", "label", "count", F.lit(0.0).alias("score"),
        )
    sites = options.select("source").distinct()
    misses = unresolved_queries(sites, matches, queries) if queries else sites.select("source", F.lit("").alias("query")).where("false")
    return Resolved(matches, misses, merge_facet_rows(chosen, ("source", "source_ord")))
