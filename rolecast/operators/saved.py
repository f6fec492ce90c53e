"""Place searches kept as a table, matched with any number of postings.

A substring test between two tables has no key to join by. Here each searched
name is represented by its rarest three characters: only postings that hold these
are tested for the whole name. Names are tested once, however many searches ask
for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.places import aliases, is_country_query
from rolecast.operators.joins import lookup_join
from rolecast.session import materialize

GRAM = 3


def grams(text: str, size: Column | int) -> Column:
    """The different substrings of ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(text), i, size)))


def needles(searches: DataFrame) -> DataFrame:
    """``search_id, needle``: what has to occur in a place's text between two blanks.

    The names of a country have to be whole words, other names may lie inside longer ones.
    """
    rows = searches.select("search_id", is_country_query(F.col("query")).alias("country"), F.explode(aliases(F.col("query"))).alias("name"))
    spaced = F.when(F.col("country"), F.concat(F.lit(" "), "name", F.lit(" "))).otherwise(F.col("name"))
    return rows.select("search_id", spaced.alias("needle")).where("needle <> ''").distinct()


def met_needles(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``_key, needle``: which needles occur in which texts (``_key, hay``)."""
    wanted = asked.select("needle").distinct()
    sizes = sorted(r[0] for r in wanted.select(F.least(F.length("needle"), F.lit(GRAM))).distinct().collect())
    if not sizes:
        return texts.join(wanted, F.lit(False)).select("_key", "needle")
    # names shorter than a gram are grams themselves
    held = texts.select("_key", "hay", F.explode(F.array_distinct(F.concat(*[grams("hay", s) for s in sizes]))).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("often"))
    parts = wanted.select("needle", F.explode(grams("needle", F.least(F.length("needle"), F.lit(GRAM)))).alias("gram"))
    # a gram that no posting holds makes its name match nothing
    known = parts.join(often, "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct("often", "gram")).alias("gram"), F.bool_or(F.col("often").isNull()).alias("unheard")
    )
    chosen = known.where("not unheard").select("gram", "needle")
    near = lookup_join(held, chosen, ["gram"], spread_by="_key", how="inner")
    return near.where(F.contains("hay", F.col("needle"))).select("_key", "needle")


def saved_matches(places: DataFrame, searches: DataFrame, key: str = "ingest_seq") -> DataFrame:
    """``search_id`` and ``key`` for every search and posting that match, each pair once.

    ``places`` has the ``key`` and the reduced ``place`` text of a posting (see
    :func:`rolecast.operators.filters.location_text`), ``searches`` has
    ``search_id`` and ``query``. As in the filter by constants, a posting without
    a place matches nothing; a blank search asks for nothing and is not listed.
    """
    asked = materialize(needles(searches))
    hay = F.concat(F.lit(" "), "place", F.lit(" "))
    texts = places.where("place <> ''").select(F.col(key).alias("_key"), hay.alias("hay"))
    found = lookup_join(met_needles(texts, asked), asked, ["needle"], spread_by="_key", how="inner")
    return found.select("search_id", F.col("_key").alias(key)).distinct()


def saved_counts(places: DataFrame, searches: DataFrame, key: str = "ingest_seq") -> DataFrame:
    """``search_id, found``: how many postings :func:`saved_matches` lists for each search; those without any are left out.

    Postings with one text, and searches with the same names, are taken together:
    work and rows grow with the different texts and names, not with the matches.
    """
    hay = F.concat(F.lit(" "), "place", F.lit(" ")).alias("hay")
    rows = materialize(places.where("place <> ''").select(F.struct(key).alias("_key"), hay).distinct())
    per_key = rows.groupBy("_key").agg(F.count("*").alias("n"), F.min("hay").alias("hay"))
    per_key = materialize(per_key)
    single = materialize(per_key.where("n = 1").groupBy("hay").agg(F.count("*").alias("keys")))
    names = needles(searches).groupBy("search_id").agg(F.array_sort(F.collect_set("needle")).alias("needles"))
    names = materialize(names.select("search_id", F.to_json("needles").alias("kind"), "needles"))
    asked = materialize(names.select("kind", "needles").distinct().select("kind", F.explode("needles").alias("needle")))
    texts = rows.select("hay").distinct().select(F.col("hay").alias("_key"), "hay")
    met = lookup_join(met_needles(texts, asked), asked, ["needle"], spread_by="_key", how="inner")
    met = materialize(met.select("kind", F.col("_key").alias("hay")).distinct())
    counts = met.join(single, "hay").select("kind", "keys")
    # a posting with several texts counts once, whichever of them match
    several = rows.join(per_key.where("n > 1").select("_key"), "_key", "left_semi")
    others = met.join(several, "hay").select("kind", "_key").distinct().groupBy("kind").agg(F.count("*").alias("keys"))
    found = counts.unionByName(others).groupBy("kind").agg(F.sum("keys").alias("found"))
    return lookup_join(names.drop("needles"), found, ["kind"], spread_by="search_id", how="inner").select("search_id", "found")
