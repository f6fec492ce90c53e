"""Best postings of every profile without a row for every posting and profile.

A score is what the hits add plus a bonus for length. Pairs with a hit are scored
one by one. All other pairs have the bonus alone, and the bonus of every profile
with the same divisor and cap puts the postings in the same order. So of that
order a profile needs only a prefix: until ``k`` postings without a hit are found,
or the bonus falls below the score of its k-th hit.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.operators.joins import lookup_join
from rolecast.operators.limits import top_per_group
from rolecast.operators.profiles import Profiles
from rolecast.operators.ranking import RankRules, _bonus
from rolecast.operators.tally import kinds, listed_for_all, numbered, rounded, tallied, with_matches
from rolecast.session import materialize

#: A prefix that did not do is made so many times as long.
GROWTH = 4
#: Different pairs of divisor and cap that are looked at together.
RULES = 256


class Pruned(NamedTuple):
    """``best``: the columns of the postings with ``profile``, ``rank``, ``score``, ``matches`` and ``notes``;
    ``pairs``: per profile how many pairs were scored by their ``hits`` and by their ``bonus`` alone."""

    best: DataFrame
    pairs: DataFrame


def _prefixes(texts: DataFrame, knobs: DataFrame, rules: RankRules, size: int) -> DataFrame:
    """``length_divisor, length_cap, place, _row, ingest_seq, score``: the first ``size`` postings by their bonus.

    Postings of one length have one bonus, so of each length only ``size`` can matter.
    """
    few = materialize(top_per_group(texts.select("_length", "ingest_seq", "_row"), ["_length"], [F.col("ingest_seq")], size, unique=["_row"]))
    kinds = materialize(knobs.select("length_divisor", "length_cap").distinct())
    number = -(-kinds.count() // RULES) or 1
    packed = kinds.withColumn("_pack", F.pmod(F.xxhash64("length_divisor", "length_cap"), F.lit(number)))
    packs = packed.groupBy("_pack").agg(F.collect_list(F.struct("length_divisor", "length_cap")).alias("_ps"))
    every = few.withColumn("_pack", F.expr(f"explode(sequence(0L, {number - 1}L))"))
    pairs = lookup_join(every, packs, ["_pack"], spread_by="_row", how="inner", broadcast_rows=100)
    scored = pairs.withColumn("_p", F.explode("_ps")).withColumn("score", rounded(_bonus(), rules))
    keys = ["length_divisor", "length_cap"]
    rows = scored.select(*[F.col(f"_p.{c}").alias(c) for c in keys], "_row", "ingest_seq", "score")
    return top_per_group(rows, keys, [F.desc("score"), F.col("ingest_seq")], size, unique=["_row"], rank="place")


def top_profiles(postings: DataFrame, tables: Profiles, k: int, rules: RankRules = RankRules()) -> Pruned:
    """Best ``k`` postings of every profile: score, then scan order, then any order among rows that share both.

    The rows are those of :func:`rolecast.operators.ranking.top_by_profile` over
    all pairs; ``postings`` needs the same columns. Profile tables may have any size.
    """
    texts = numbered(postings, rules)
    shared, members = kinds(tables)
    knobs = materialize(shared.profiles)
    by_score = [F.desc("score"), F.col("ingest_seq")]

    hits = tallied(texts, shared, rules, k)
    met = hits.where("_row is not null").drop("hits")
    best_hits = materialize(top_per_group(met, ["profile"], by_score, k, unique=["_row"], rank="_place"))
    # the k-th score of the hits bounds from below what a posting without a hit has to reach
    kth = best_hits.where(F.col("_place") == k).select("profile", F.col("score").alias("_kth"))
    open_ = materialize(knobs.join(kth, "profile", "left"))

    found, tried, size = None, None, k
    while True:
        prefix = materialize(_prefixes(texts, open_, rules, size))
        keys = ["length_divisor", "length_cap"]
        ends = prefix.groupBy(*keys).agg(F.max("place").alias("_size"), F.min("score").alias("_last"))
        pairs = lookup_join(prefix, open_, keys, spread_by="_row", how="inner")
        pairs = materialize(pairs.where(F.col("_kth").isNull() | (F.col("score") >= F.col("_kth"))).select("profile", "_row", "ingest_seq", "score"))
        # of the postings of the prefix alone all hits are listed
        held = lookup_join(texts, pairs.select("_row").distinct(), ["_row"], spread_by="_row", how="left_semi")
        known = tallied(held, Profiles(open_.select(*shared.profiles.columns), shared.terms.join(open_.select("profile"), "profile", "left_semi")), rules, None)
        free = pairs.join(known.select("profile", "_row"), ["profile", "_row"], "left_anti")
        free = materialize(top_per_group(free, ["profile"], by_score, k, unique=["_row"], rank="_place"))
        count = pairs.groupBy("profile").agg(F.count("*").alias("bonus"))
        enough = free.groupBy("profile").agg(F.count("*").alias("_free"))
        state = open_.join(ends, keys, "left").join(enough, "profile", "left")
        done = (F.coalesce("_size", F.lit(0)) < size) | (F.coalesce("_free", F.lit(0)) >= k) | F.coalesce(F.col("_last") < F.col("_kth"), F.lit(False))
        state = materialize(state.withColumn("_done", done))
        closed = free.join(state.where("_done").select("profile"), "profile", "left_semi")
        found = closed if found is None else found.unionByName(closed)
        tried = count if tried is None else tried.unionByName(count)
        left = state.where("not _done").select(*knobs.columns, "_kth")
        if left.isEmpty():
            break
        open_, size = left, size * GROWTH

    both = best_hits.drop("_place").unionByName(found.drop("_place"))
    scored, few = with_matches(texts, top_per_group(both, ["profile"], by_score, k, unique=["_row"]), shared, rules)
    best = top_per_group(scored, ["profile"], by_score, k, unique=["_row"], rank="rank")
    whole = listed_for_all(best, members, few, postings.columns, rules)
    hit_pairs = hits.groupBy("profile").agg(F.sum("hits").alias("hits"))
    bonus_pairs = tried.groupBy("profile").agg(F.sum("bonus").alias("bonus"))
    zero = F.lit(0).cast("long")
    counted = knobs.select("profile").join(hit_pairs, "profile", "left").join(bonus_pairs, "profile", "left")
    counted = counted.select(F.col("profile").alias("kind"), F.coalesce("hits", zero).alias("hits"), F.coalesce("bonus", zero).alias("bonus"))
    counted = lookup_join(members, counted, ["kind"], spread_by="profile", how="inner").select("profile", "hits", "bonus")
    return Pruned(whole, counted)
