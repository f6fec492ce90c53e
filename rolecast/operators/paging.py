"""Which landed list pages belong to a scan, and the rows on them.

``pages`` has one row per landed list page: ``source``, ``page_no`` (from 1) and
``payload`` (JSON text), see :mod:`rolecast.sources.landed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.functions.payload import alternate_items, alternate_total, is_object, parse_whole, posting_items
from rolecast.operators.joins import lookup_join
from rolecast.session import materialize

# running totals are built over runs of this many pages, then chained
PAGES_PER_RUN = 4096


def page_offset(page_no: Column, page_size: int) -> Column:
    """Offset of a page; page numbers start at one."""
    checked = F.when(page_no >= 1, page_no).otherwise(F.raise_error(F.lit("page must be >= 1")).cast("bigint"))
    return (checked - 1) * page_size


def ingest_seq(source_ord: Column, page_no: Column, position: Column) -> Column:
    """Scan order as one value that sorts by source, page and position."""
    parts = {"source_ord": source_ord, "page_no": page_no, "position": position}
    return F.struct(*[part.cast("bigint").alias(name) for name, part in parts.items()])


def site_ordinal(seq: Column) -> Column:
    """The source ordinal inside an ``ingest_seq``."""
    return seq["source_ord"]


def parse_pages(pages: DataFrame, alternate: bool = False) -> DataFrame:
    """Add ``doc``, ``readable``, the ``items`` of the page, how many it counts and its total.

    An unreadable page has no count: it is reported by :func:`unreadable_pages`
    and ends nothing. Of a repeated JSON key the last value is read.
    """
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = pages.withColumn("doc", F.expr(parse_whole("payload")))
    items = alternate_items("doc") if alternate else posting_items("doc")
    total = alternate_total("doc") if alternate else "cast(null as bigint)"
    return (
        parsed.withColumn("readable", F.col("doc").isNotNull())
        .withColumn("items", F.expr(items))
        .withColumn("n_items", F.when(F.col("readable"), F.size("items")))
        .withColumn("total", F.expr(total))
    )


def once(pages: DataFrame, alternate: bool = False) -> DataFrame:
    """Landed pages without repeats of a page number.

    Of copies a readable one stays, of those one with the most items, and of
    those that with the smallest hash of its payload.
    Only numbers move unless there are repeats, and then only the repeated pages.
    """
    keys = ["source", "page_no"]
    repeated = materialize(pages.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys))
    if repeated.isEmpty():
        return pages
    others = lookup_join(pages, repeated, keys, spread_by="page_no", how="left_anti")
    again = lookup_join(pages, repeated, keys, spread_by="page_no", how="left_semi")
    rest = [c for c in pages.columns if c not in keys]
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    doc = parse_whole("payload")
    items = F.expr(alternate_items(doc) if alternate else posting_items(doc))
    rank = again.select(
        "*", F.expr(doc).isNull().alias("_broken"), (-F.coalesce(F.size(items), F.lit(0))).alias("_fewer")
    )
    order = F.struct("_broken", "_fewer", F.xxhash64("payload"), "payload")
    first = F.min_by(F.struct(*rest), order).alias("_row")
    return others.unionByName(rank.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*pages.columns))


def unreadable_pages(parsed: DataFrame) -> DataFrame:
    """How many landed pages per source are no JSON."""
    return parsed.groupBy("source").agg(F.count_if(~F.col("readable")).alias("bad"), F.count("*").alias("pages"))


def cut_at_short_page(pages: DataFrame, page_size: int, max_pages: int | None = None) -> DataFrame:
    """Pages up to and including the first with fewer than ``page_size`` entries."""
    cuts = pages.groupBy("source").agg(
        F.min(F.when(F.col("n_items") < page_size, F.col("page_no"))).alias("_cut")
    )
    return _keep(pages, cuts, max_pages)


def cut_at_total(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages until one is empty or the entries read reach the total that page announces.

    A short page ends nothing here. The running count is built from runs of pages,
    so a source with very many pages is no single sort.
    """
    narrow = pages.select(
        "source", "page_no", "n_items", "total", F.floor(F.col("page_no") / PAGES_PER_RUN).alias("_run")
    )
    in_run = Window.partitionBy("source", "_run").orderBy("page_no")
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        narrow.groupBy("source", "_run")
        .agg(F.sum("n_items").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    read = (
        narrow.withColumn("_in_run", F.sum("n_items").over(in_run))
        .join(runs, ["source", "_run"])
        .withColumn("_read", F.col("_in_run") + F.col("_before"))
    )
    ends = (F.col("n_items") == 0) | (F.col("_read") >= F.col("total"))
    cuts = read.groupBy("source").agg(F.min(F.when(ends, F.col("page_no"))).alias("_cut"))
    return _keep(pages, cuts, max_pages)


def cut_fixed(pages: DataFrame, n_pages: int = 29) -> DataFrame:
    """The older scan: a fixed number of pages, whatever is on them."""
    return pages.where(F.col("page_no") <= n_pages)


def _keep(pages: DataFrame, cuts: DataFrame, max_pages: int | None) -> DataFrame:
    if max_pages is not None:
        pages = pages.where(F.col("page_no") <= max_pages)
    joined = lookup_join(pages, cuts, ["source"], spread_by="page_no")
    return joined.where(F.col("_cut").isNull() | (F.col("page_no") <= F.col("_cut"))).drop("_cut")


def summaries(pages: DataFrame) -> DataFrame:
    """One row per listed posting object: ``source``, ``page_no``, ``position``, ``item``."""
    return pages.select("source", "page_no", F.posexplode("items").alias("position", "item")).where(
        F.expr(is_object("item"))
    )


def facet_pages(pages: DataFrame) -> DataFrame:
    """Facet metadata per source: only the first page is read, and only for its facets."""
    return pages.where(F.col("page_no") == 1).select("source", F.expr(parse_whole("payload")).alias("doc"))


def search_text(postings: DataFrame, text: str, *columns: str) -> DataFrame:
    """Free-text search: every word occurs in one of the columns, case-blind.

    The remote search this stands for is not visible; this is the plain reading.
    """
    hay = F.lower(F.concat_ws("\n", *columns))
    for word in text.lower().split():
        postings = postings.where(F.contains(hay, F.lit(word)))
    return postings
