"""Landed inputs: raw list pages, detail pages and site addresses as files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from rolecast.sources.presets import EXAMPLE_SITES

LIST_PAGE = "source string, page_no bigint, payload string"
DETAIL_PAGE = "url string, html string"
ALTERNATE_DETAIL = "job_id string, payload string"


def _read(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    return spark.read.format(kind).schema(schema).load(path)


def read_list_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Raw list pages: the site's public address, page number from 1, JSON text."""
    return _read(spark, path, LIST_PAGE, kind)


def read_detail_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return _read(spark, path, DETAIL_PAGE, kind)


def read_alternate_details(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return _read(spark, path, ALTERNATE_DETAIL, kind)


def site_list(spark: SparkSession, addresses: Iterable[str]) -> DataFrame:
    """Public addresses with their ordinal, which leads the scan order."""
    return spark.createDataFrame(list(enumerate(addresses)), "source_ord bigint, source string").select(
        "source", "source_ord"
    )


def example_sites(spark: SparkSession, *names: str) -> DataFrame:
    """The sites offered as examples, all or those named, in the order given."""
    return site_list(spark, [EXAMPLE_SITES[n] for n in names or EXAMPLE_SITES])


# an input of fewer splits than this is small whatever the cluster's size
SMALL_SPLITS = 32


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few splits; a large input is left as it is.

    One small file is one task however costly the text work on it is. Only an
    input of fewer splits than cores, and fewer than ``SMALL_SPLITS``, is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = min(cores, SMALL_SPLITS)
    return df if df.rdd.getNumPartitions() >= few else df.repartition(few)
