"""The row-wise part of the chain on list pages that are still landing.

Reading a page, its summaries, postings, filters and scores keep no state, so
the batch operators run on a stream as they are. Page cuts and limits keep a state
for each site, see :mod:`rolecast.streaming.cuts`; the best of every profile are
merged into a table, see :mod:`rolecast.streaming.best`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolecast.operators.facets import facet_options
from rolecast.operators.paging import facet_pages, parse_pages, summaries
from rolecast.operators.postings import alternate_postings, site_table, summary_postings, with_site
from rolecast.operators.profiles import Profiles
from rolecast.operators.ranking import RankRules, rank
from rolecast.sources.landed import LIST_PAGE


def stream_list_pages(spark: SparkSession, path: str, kind: str = "parquet", files: int = 1000) -> DataFrame:
    return spark.readStream.format(kind).schema(LIST_PAGE).option("maxFilesPerTrigger", files).load(path)


def stream_postings(pages: DataFrame, sites: DataFrame, alternate: bool = False) -> DataFrame:
    """Summary postings of each page as it lands; ``sites`` is a static table."""
    items = with_site(summaries(parse_pages(pages, alternate)), site_table(sites), spread_by="page_no")
    return alternate_postings(items) if alternate else summary_postings(items)


def stream_facets(write):
    """A function for ``foreachBatch`` over landed pages: ``write(options, number)`` gets their facet options, at any depth."""

    def run(batch: DataFrame, number: int) -> None:
        write(facet_options(facet_pages(batch)), number)

    return run


def stream_ranked(postings: DataFrame, tables: Profiles, rules: RankRules = RankRules()) -> DataFrame:
    """Scores of streamed postings; the profiles are constants of the running query."""
    return rank(postings, tables, rules)
