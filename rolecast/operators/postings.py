"""Posting rows: from a summary alone, or joined to the landed detail page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.payload import (
    elements,
    field,
    first_filled,
    first_text,
    first_value,
    is_array,
    is_object,
    is_text,
    json_ld_block,
    json_ld_place,
    json_ld_posting,
    json_ld_strict,
    nested_description,
    parse_whole,
    place_text,
    posted_date,
    posted_text,
)
from rolecast.functions.sql import bind, each, those
from rolecast.functions.text import blank_to_null, description_text
from rolecast.functions.urls import infer_site, posting_address, public_prefix, requisition_id
from rolecast.operators.joins import hot_key_join, lookup_join, one_per_key
from rolecast.operators.paging import ingest_seq

POSTING_COLUMNS = (
    "ingest_seq", "source", "req_id", "title", "location", "posted", "url", "job_id",
    "employment_type", "date_posted", "valid_through", "hiring_organization",
    "description_html", "description_text", "raw_summary", "raw_json_ld",
)

# The branded source with its own listing, and its addresses.
ALTERNATE_SOURCE = "Netflix"
ALTERNATE_PAGES = "https://explore.jobs.netflix.net/careers"


def site_table(sites: DataFrame) -> DataFrame:
    """``source`` (the public address) and ``source_ord`` to the parts of the site.

    Sites that have their parts already (see :func:`rolecast.plans.forms.site_arguments`) stay as they are.
    """
    if "base_url" in sites.columns:
        return sites
    info = infer_site(F.col("source"))
    return sites.withColumn("_s", info).select("source", "source_ord", "_s.*")


def with_site(rows: DataFrame, sites: DataFrame, spread_by: str) -> DataFrame:
    """Attach the site columns; the site list is broadcast only when it is short."""
    prefix = public_prefix(F.col("site"), F.col("locale"), F.col("public_prefix"))
    narrow = sites.where("error is null").select(
        "source", "source_ord", "base_url", "site", prefix.alias("site_prefix")
    )
    return lookup_join(rows, narrow, ["source"], spread_by=spread_by, how="inner")


def summary_postings(items: DataFrame) -> DataFrame:
    """Posting rows from list pages alone; the description stays empty.

    ``items`` comes from :func:`~rolecast.operators.paging.summaries` with the
    site columns attached.
    """
    null = F.lit(None).cast("string")
    rows = items.withColumn("_path", F.expr(first_text("item", "$.externalPath", "$.externalPathAndQuery")))
    return rows.select(
        ingest_seq(F.col("source_ord"), F.col("page_no"), F.col("position")).alias("ingest_seq"),
        F.col("site").alias("source"),
        requisition_id(F.col("_path")).alias("req_id"),
        F.expr(first_text("item", "$.title", "$.titleSimple")).alias("title"),
        F.expr(place_text("item")).alias("location"),
        F.expr(posted_text("item")).alias("posted"),
        posting_address(F.col("base_url"), F.col("site_prefix"), F.col("_path")).alias("url"),
        F.expr(first_text("item", "$.id", "$.jobId", "$.uid")).alias("job_id"),
        *[null.alias(c) for c in POSTING_COLUMNS[8:13]],
        F.lit("").alias("description_text"),
        F.col("item").alias("raw_summary"),
        F.parse_json(F.lit("{}")).alias("raw_json_ld"),
    )


def detail_facts(details: DataFrame, strict: bool = False) -> DataFrame:
    """Landed detail pages (``url``, ``html``) to one narrow row per address.

    The page is reduced to the fields a posting needs before anything is
    shuffled; ``landed_seq`` (optional) decides which copy of an address counts.
    """
    order = F.col("landed_seq") if "landed_seq" in details.columns else F.xxhash64("html")
    posting = json_ld_strict(F.col("html")) if strict else F.expr(json_ld_posting("_block"))
    organization = field("_p", "$.hiringOrganization")
    facts = (
        details.select("url", "html", order.alias("_order"))
        .withColumn("_block", json_ld_block(F.col("html")))
        .withColumn("_p", posting)
        .selectExpr(
            "url",
            "_order",
            f"{first_text('_p', '$.title')} as ld_title",
            f"{json_ld_place('_p')} as ld_place",
            f"{field('_p', '$.employmentType', 'string')} as ld_employment_type",
            f"{field('_p', '$.datePosted', 'string')} as ld_date_posted",
            f"{field('_p', '$.validThrough', 'string')} as ld_valid_through",
            f"if({is_object(organization)}, {field('_p', '$.hiringOrganization.name', 'string')}, null) as ld_organization",
            f"{field('_p', '$.description', 'string')} as ld_description",
            "to_json(_p) as ld_json",
        )
    )
    return one_per_key(facts, "url", "_order")


def asked_for(details: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """The detail rows whose ``key`` some posting has; copies of a hot key are spread by their place."""
    numbered = details.withColumn("_place", F.monotonically_increasing_id())
    return lookup_join(numbered, postings.select(key).distinct(), [key], spread_by="_place", how="left_semi").drop("_place")


def hydrate(postings: DataFrame, details: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Fill summary postings from their detail pages; a posting without one stays.

    Only pages that a posting asks for are read for their block.
    """
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    facts = detail_facts(asked_for(details, postings, "url"))
    joined = hot_key_join(postings, facts, ["url"], spread_by="ingest_seq", **options)
    filled = {
        "title": F.expr(first_filled("title", "ld_title")),
        "location": F.expr(first_filled("location", "ld_place")),
        "employment_type": F.col("ld_employment_type"),
        "date_posted": F.col("ld_date_posted"),
        "valid_through": F.col("ld_valid_through"),
        "hiring_organization": F.col("ld_organization"),
        "description_html": F.col("ld_description"),
        "description_text": description_text(F.col("ld_description")),
        "raw_json_ld": F.parse_json(F.coalesce("ld_json", F.lit("{}"))),
    }
    return joined.select(*[filled.get(c, F.col(c)).alias(c) for c in POSTING_COLUMNS])


def alternate_fields(item: str) -> dict[str, Column]:
    """Fields of one entry of an alternate listing, by name."""
    job_id = first_text(item, "$.id", "$.external_id")
    own_page = bind(job_id, lambda j: f"if({j} = '', '{ALTERNATE_PAGES}', concat('{ALTERNATE_PAGES}/job/', {j}))")

    def places(v: str) -> str:
        names = those(each(elements(v), lambda p: first_text(p, "$")), lambda n: f"{n} <> ''")
        return (
            f"case when {is_text(v)} then try_cast({v} as string) "
            f"when {is_array(v)} then array_join({names}, ', ') else '' end"
        )

    return {
        "job_id": F.expr(job_id),
        "title": F.expr(first_text(item, "$.name", "$.title")),
        "location": F.expr(bind(first_value(item, "$.locations", "$.location"), places)),
        "posted": F.expr(bind(first_value(item, "$.t_create", "$.created_at"), posted_date)),
        "url": F.expr(first_filled(first_text(item, "$.canonicalPositionUrl", "$.url"), own_page)),
        "description_html": nested_description(item),
    }


def alternate_postings(items: DataFrame) -> DataFrame:
    """Posting rows of the alternate listing, with the description it carries.

    The requisition id is the entry's own id and its description text is kept
    also without a detail join.
    """
    fields = alternate_fields("item")
    fields["url"] = posting_address(F.col("base_url"), F.col("site_prefix"), fields["url"])
    rows = items.select(
        "item",
        ingest_seq(F.col("source_ord"), F.col("page_no"), F.col("position")).alias("ingest_seq"),
        *[c.alias(n) for n, c in fields.items()],
    )
    null = F.lit(None).cast("string")
    return rows.select(
        "ingest_seq",
        F.lit(ALTERNATE_SOURCE).alias("source"),
        F.col("job_id").alias("req_id"),
        "title", "location", "posted", "url", "job_id",
        null.alias("employment_type"),
        F.col("posted").alias("date_posted"),
        null.alias("valid_through"),
        F.lit(ALTERNATE_SOURCE).alias("hiring_organization"),
        blank_to_null(F.col("description_html")).alias("description_html"),
        description_text(F.col("description_html")).alias("description_text"),
        F.col("item").alias("raw_summary"),
        F.parse_json(F.lit("{}")).alias("raw_json_ld"),
    )


def hydrate_missing(postings: DataFrame, details: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Join a landed detail (``job_id``, ``payload``) only where the description is blank.

    Everything else passes by without a shuffle. An unreadable or missing detail
    leaves the posting as it is.
    """
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    order = F.col("landed_seq") if "landed_seq" in details.columns else F.xxhash64("payload")
    doc = F.expr(parse_whole("payload"))
    blank = F.col("description_text") == ""
    lacking = postings.where(blank)
    usable = (
        asked_for(details, lacking, "job_id")
        .select("job_id", order.alias("_order"), doc.alias("_doc"))
        .where((F.col("job_id") != "") & F.expr(is_object("_doc")))
        .select("job_id", "_order", nested_description("_doc").alias("_found"), F.to_json("_doc").alias("_json"))
    )
    joined = hot_key_join(
        lacking, one_per_key(usable, "job_id", "_order"), ["job_id"], spread_by="ingest_seq", **options
    )
    html = F.coalesce(blank_to_null(F.col("_found")), F.col("description_html"))
    filled = {
        "description_html": html,
        "description_text": description_text(html),
        "raw_json_ld": F.parse_json(F.coalesce("_json", F.lit("{}"))),
    }
    hydrated = joined.select(*[filled.get(c, F.col(c)).alias(c) for c in POSTING_COLUMNS])
    return postings.where(~blank).select(*POSTING_COLUMNS).unionByName(hydrated)
