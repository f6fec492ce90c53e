"""Job-shaped views of the given tables.

None of the tables holds postings, so documents stand for postings, pages for
detail pages, nations and customers for facet trees, and so on. Every view reads
its whole table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.operators.postings import POSTING_COLUMNS
from rolecast.operators.profiles import Profiles, profile_tables
from rolecast.sources.landed import spread

SITE = "https://jobs.example.com/en-US/Careers"
# documents listed per landed page of a source
DOCS_PER_PAGE = 100

DEMO = {
    "demo": (
        {"the": 2.5, "that": 1.2, "of the": 1.6, "an-on": 0.7, "die&&&": 1.5},
        {"and": 0.5, "de la": 0.7, "license": 2.1, "***": 0.3},
        {"with": -1.3, "le": -0.4, "und": -0.8},
        1.35, 1.25, 900.0,
    ),
    "romance": (
        {"que": 1.5, "los": 1.1, "les": 0.9},
        {"de la": 0.7, "del": 0.4},
        {"the": -2.2},
        1.2, 1.0, 700.0,
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_line(text: str = "text") -> Column:
    return F.substring_index(text, "\n", 1)


def demo_profiles(spark: SparkSession, *names: str) -> Profiles:
    return profile_tables(spark, {n: DEMO[n] for n in names or DEMO})


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as postings: first line is the title, the text the description."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "source"))
    null = F.lit(None).cast("string")
    filled = {
        "ingest_seq": F.col("doc_id"),
        "source": F.col("source"),
        "req_id": F.concat(F.lit("JR"), F.col("doc_id").cast("string")),
        "title": first_line(),
        "location": F.lit(""),
        "posted": F.lit(""),
        "url": F.concat(F.lit(f"{SITE}/job/Doc_JR"), F.col("doc_id").cast("string")),
        "job_id": F.col("doc_id").cast("string"),
        "description_text": F.col("text"),
        "raw_summary": F.parse_json(F.lit("{}")),
        "raw_json_ld": F.parse_json(F.lit("{}")),
    }
    return docs.select(*[filled.get(c, null).alias(c) for c in POSTING_COLUMNS])


def list_pages(spark: SparkSession, folder: str, alternate: bool = False, announced: int | None = 25) -> DataFrame:
    """Landed list pages: the documents of a source, ``DOCS_PER_PAGE`` ids to a page.

    Pages are numbered per source without gaps. A page holds at most
    ``DOCS_PER_PAGE`` entries, so no group grows with the data.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    text = F.col("doc_id").cast("string")
    if alternate:
        item = F.struct(
            F.col("doc_id").alias("id"),
            first_line().alias("name"),
            F.array(F.col("lang"), F.lit(""), F.col("source")).alias("locations"),
            (F.lit(1_600_000_000) + F.col("doc_id") * 86_400).alias("t_create"),
            F.struct(F.struct(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("description")).alias("details")).alias("job"),
        )
    else:
        item = F.struct(
            first_line().alias("titleSimple"),
            F.concat(F.lit("/job/Doc_JR"), text).alias("externalPath"),
            F.col("doc_id").alias("uid"),
            F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("locationsText"),
            F.array(
                F.struct(F.lit("Posted On").alias("label"), F.concat(F.lit("day "), text).alias("value")),
                F.struct(F.lit("Locations").alias("label"), F.concat(F.lit("in "), F.col("lang")).alias("value")),
            ).alias("subtitles"),
        )
    block = F.floor(F.col("doc_id") / DOCS_PER_PAGE).cast("bigint")
    entries = F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item"))))
    pages = docs.groupBy(F.concat(F.lit("https://"), "source", F.lit(".example.com/Careers")).alias("source"),
                         (block + 1).alias("page_no")).agg(entries.alias("e"))
    items = F.transform("e", lambda e: e["item"])
    # a listing that announces no total ends where a page announces no more than has been read
    total = F.lit(announced if announced is not None else 1 << 40).cast("bigint").alias("count")
    body = F.struct(items.alias("positions"), total) if alternate else F.struct(items.alias("jobPostings"))
    return pages.select("source", "page_no", F.to_json(body).alias("payload"))


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """One site per document source; its ordinal is the number in its name."""
    return (
        table(spark, folder, "documents")
        .select("source")
        .distinct()
        .select(
            F.concat(F.lit("https://"), "source", F.lit(".example.com/Careers")).alias("source"),
            F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("source_ord"),
        )
    )


def json_ld_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with an entity-encoded JSON-LD script in front of their HTML."""
    pages = spread(table(spark, folder, "pages").select("page_id", "url", "html"))
    place = F.struct(F.struct(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("addressLocality")).alias("address"))
    posting = F.struct(
        F.lit("JobPosting").alias("@type"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")).alias("datePosted"),
        F.when(F.col("page_id") % 3 > 0, F.lit("FULL_TIME")).alias("employmentType"),
        F.struct(F.concat(F.lit("Org "), F.col("page_id").cast("string")).alias("name")).alias("hiringOrganization"),
        F.when(F.col("page_id") % 2 == 0, F.array(place)).alias("jobLocation"),
        F.col("html").alias("description"),
    )
    other = F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.lit("x").alias("title")))
    body = F.to_json(posting)
    listed = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("["), other, F.lit(","), body, F.lit("]"))).otherwise(body)
    encoded = F.replace(F.replace(listed, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    script = F.concat(F.lit("<script async type='application/ld+json'> "), encoded, F.lit(" </script>"))
    whole = F.when(F.col("page_id") % 7 == 6, F.col("html")).otherwise(F.concat(script, F.col("html")))
    address = F.concat(F.lit(f"{SITE}/job/Doc_JR"), F.col("page_id").cast("string"))
    return pages.select("page_id", address.alias("url"), whole.alias("html"))


def facet_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One facet payload per region: nations with their customer counts, market
    segments below them. The customers are counted first, so a payload holds as
    many nodes as there are nations and segments."""
    counts = table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    nation = table(spark, folder, "nation")
    segment = F.struct(F.col("c_mktsegment").alias("label"), F.concat_ws("/", "n_name", "c_mktsegment").alias("value"), F.col("n").alias("total"))
    nations = (
        counts.join(nation, counts.c_nationkey == nation.n_nationkey)
        .groupBy("n_regionkey", "n_nationkey", "n_name")
        .agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(segment)).alias("items"))
    )
    value = F.struct("n_nationkey", F.col("n_name").alias("descriptor"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n").alias("count"), "items")
    regions = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(value)).alias("values"))
    region = table(spark, folder, "region")
    facet = F.struct(F.lit("Locations").alias("descriptor"), F.lit("locationHierarchy1").alias("facetParameter"), "values")
    payload = F.to_json(F.struct(F.array(facet).alias("facets")))
    return regions.join(region, regions.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("source"), F.try_parse_json(payload).alias("doc")
    )


def placed_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as postings whose place is spread over the known shapes."""
    place = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, folder, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    summary = F.to_json(
        F.struct(
            F.array(F.struct(F.col("n_name").alias("descriptor"), F.lit("kept out").alias("note"))).alias("locations"),
            F.array(F.struct(F.lit("Segment").alias("label"), F.col("c_mktsegment").alias("value"))).alias("subtitles"),
        )
    )
    detail = F.to_json(F.struct(F.struct(F.struct(F.col("r_name").alias("addressRegion"), F.lit("zip").alias("code")).alias("address")).alias("jobLocation")))
    return rows.select(
        F.col("c_custkey").alias("ingest_seq"),
        F.concat_ws(" & ", "c_mktsegment", "c_name").alias("title"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("Remote, US")).otherwise("").alias("location"),
        F.parse_json(summary).alias("raw_summary"),
        F.parse_json(detail).alias("raw_json_ld"),
    )
