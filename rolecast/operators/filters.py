"""Row filters on title and place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.payload import field, location_words
from rolecast.functions.places import any_place_matches, title_matches
from rolecast.functions.text import match_key

# The parts of a summary that may name a place.
PLACE_FIELDS = ("$.locationsText", "$.location", "$.locations", "$.subtitles")


def place_blob() -> Column:
    """All location words of a posting (display text, summary, detail), reduced for matching."""
    parts = [location_words(field("raw_summary", p)) for p in PLACE_FIELDS]
    parts.append(location_words(field("raw_json_ld", "$.jobLocation")))
    return match_key(F.concat_ws(" ", "location", *map(F.expr, parts)))


def filter_by_title(postings: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return postings.where(title_matches(F.col("title"), keywords)) if keywords else postings


def filter_by_locations(postings: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Keep postings that match any location query; no query keeps all."""
    kept = [q for q in queries if q.strip()]
    return postings.where(any_place_matches(place_blob(), kept)) if kept else postings


def browser_match(queries: Sequence[str], keywords: Sequence[str]) -> Column:
    """Title and place test of one summary posting, as one condition."""
    title = title_matches(F.col("title"), keywords)
    return title & any_place_matches(place_blob(), queries) if [q for q in queries if q.strip()] else title


def filter_by_both(postings: DataFrame, queries: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    return postings.where(browser_match(queries, keywords))
