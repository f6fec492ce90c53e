"""The whole chains: discover, filter, hydrate, rank, cut."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.functions.urls import infer_site
from rolecast.operators import facets as facet_ops
from rolecast.operators import narrowing
from rolecast.operators.filters import browser_match
from rolecast.operators.joins import lookup_join
from rolecast.operators.limits import limit_per_group, scan_counts
from rolecast.operators.paging import (
    cut_at_short_page,
    cut_at_total,
    cut_fixed,
    facet_pages,
    once,
    parse_pages,
    search_text,
    site_ordinal,
    summaries,
)
from rolecast.operators.postings import (
    ALTERNATE_SOURCE,
    POSTING_COLUMNS,
    alternate_postings,
    hydrate,
    hydrate_missing,
    site_table,
    summary_postings,
    with_site,
)
from rolecast.operators.profiles import Profiles, override_weights
from rolecast.operators.ranking import RankRules, rank, top
from rolecast.plans.older import flat_records
from rolecast.session import materialize
from rolecast.sources.details import DetailStore

PAGE_SIZE = 20


class Landed(NamedTuple):
    """Landed tables of a crawl.

    ``alternate`` marks pages of the other listing interface; None decides by
    site, and a list may hold sites of both kinds. ``details`` are the detail
    pages (``url``, ``html``), of an alternate listing alone its detail payloads
    (``job_id``, ``payload``), which ``alternate_details`` holds in a mixed list.
    Either may be a :class:`rolecast.sources.details.DetailStore`.
    """

    sites: DataFrame
    pages: DataFrame
    details: DataFrame | DetailStore | None
    alternate: bool | None = False
    alternate_details: DataFrame | DetailStore | None = None


class Found(NamedTuple):
    postings: DataFrame
    counts: DataFrame


def split_sites(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites with the usual listing, and those with the alternate one (by tenant and site name)."""
    own = F.struct("tenant", "site") if "base_url" in sites.columns else infer_site(F.col("source"))
    parts = sites.withColumn("_s", own)
    alternate = F.coalesce((F.col("_s.tenant") == "netflix") & (F.col("_s.site") == ALTERNATE_SOURCE), F.lit(False))
    return parts.where(~alternate).drop("_s"), parts.where(alternate).drop("_s")


def by_kind(landed: Landed) -> list[Landed]:
    """The usual and the alternate part of a crawl whose kind is decided by site."""
    if landed.alternate is not None:
        return [landed]
    usual, other = split_sites(landed.sites)
    parts = [(usual, False, landed.details), (other, True, landed.alternate_details)]
    return [
        Landed(sites, lookup_join(landed.pages, sites.select("source"), ["source"], "page_no", "left_semi"), details, kind)
        for sites, kind, details in parts
        if not sites.isEmpty()
    ]


def scan(landed: Landed, max_pages: int | None = None, page_size: int = PAGE_SIZE, text: str = "") -> DataFrame:
    """Posting rows from the list pages alone, in scan order (``ingest_seq``).

    Repeated pages count once, unreadable ones end nothing. With ``text`` only
    postings that its words occur in are listed.
    """
    found = []
    for part in by_kind(landed):
        pages = parse_pages(once(part.pages, part.alternate), part.alternate)
        cut = cut_at_total(pages, max_pages) if part.alternate else cut_at_short_page(pages, page_size, max_pages)
        items = with_site(summaries(cut), site_table(part.sites), spread_by="page_no")
        found.append(alternate_postings(items) if part.alternate else summary_postings(items))
    return search_text(reduce(DataFrame.unionByName, found), text, "title", "location", "description_text")


def unlisted(landed: Landed) -> DataFrame:
    """``source, pages, error``: landed pages whose site is not listed, or whose address is not understood."""
    sites = site_table(landed.sites).select("source", "error", F.lit(True).alias("_listed"))
    pages = lookup_join(landed.pages.select("source", "page_no"), sites, ["source"], spread_by="page_no")
    lost = pages.where(F.col("_listed").isNull() | F.col("error").isNotNull())
    error = F.coalesce("error", F.lit("site is not listed"))
    return lost.groupBy("source", error.alias("error")).agg(F.count("*").alias("pages"))


def by_site(postings: DataFrame) -> DataFrame:
    """Add ``site_ord``: site names repeat between employers, the ordinal does not."""
    return postings.withColumn("site_ord", site_ordinal(F.col("ingest_seq")))


def fill(landed: Landed, postings: DataFrame) -> DataFrame:
    """Postings with what their details say, each kind from its own; without landed details they stay."""
    if landed.alternate is None:
        # by the site itself: another employer's site may have the same name
        other = split_sites(landed.sites)[1].select("source_ord").distinct()
        rows = postings.withColumn("source_ord", site_ordinal(F.col("ingest_seq")))
        kinds = [lookup_join(rows, other, ["source_ord"], "url", how).drop("source_ord") for how in ("left_anti", "left_semi")]
        usual, alternate = landed._replace(alternate=False), landed._replace(alternate=True, details=landed.alternate_details)
        return fill(usual, kinds[0]).unionByName(fill(alternate, kinds[1]))
    details = landed.details
    if details is None:
        return postings.select(*POSTING_COLUMNS)
    if isinstance(details, DetailStore):
        details = details.lookup(postings.where("description_text = ''") if landed.alternate else postings)
    return hydrate_missing(postings, details) if landed.alternate else hydrate(postings, details)


def discover(
    landed: Landed,
    max_pages: int | None = None,
    page_size: int = PAGE_SIZE,
    max_jobs: int | None = None,
    with_details: bool = True,
    text: str = "",
) -> DataFrame:
    """Postings of every site; the limit per site is applied before any detail is read."""
    postings = scan(landed, max_pages, page_size, text)
    if max_jobs is not None:
        postings = limit_per_group(by_site(postings), ["site_ord"], "ingest_seq", max_jobs).drop("site_ord")
    # written once: the detail join looks at the postings twice
    return fill(landed, materialize(postings)) if with_details else postings


def discover_filtered(
    landed: Landed,
    locations: Sequence[str] = (),
    titles: Sequence[str] = (),
    max_pages: int | None = None,
    page_size: int = PAGE_SIZE,
    max_jobs: int = 50,
    with_details: bool = True,
    text: str = "",
    members: DataFrame | None = None,
    location_matches: int = 1,
) -> Found:
    """Filter on the list pages first, keep the first ``max_jobs`` matches, then read details.

    With ``members`` the facets of the site addresses and the options that the
    ``locations`` resolve to, one after the other, choose the postings of the scan.
    """
    scanned = scan(landed, max_pages, page_size, text)
    if members is not None:
        index = narrowing.facet_index(members)
        asked = [q for q in locations if q.strip()]
        chosen = resolve_in_turn(landed, index, asked, location_matches).facets
        rows = materialize(scanned.withColumn("source_ord", site_ordinal(F.col("ingest_seq"))))
        scanned = narrowing.carrying(index, rows, chosen).drop("source_ord")
    # written once: matches, counts and the detail join all start from the scan
    postings = materialize(by_site(scanned))
    match = browser_match(locations, titles)
    kept = limit_per_group(postings.where(match), ["site_ord"], "ingest_seq", max_jobs).drop("site_ord")
    counts = scan_counts(postings, match, ["site_ord"], "ingest_seq", max_jobs)
    return Found(fill(landed, kept) if with_details else kept, counts)


def landed_options(landed: Landed) -> DataFrame:
    """Facet options of every usual site, a repeated page counted once; the alternate listing has none."""
    found = [
        facet_ops.facet_options(facet_pages(once(part.pages.where(F.col("page_no") == 1))))
        for part in by_kind(landed)
        if not part.alternate
    ]
    if not found:
        return facet_ops.facet_options(facet_pages(landed.pages)).where("false")
    return found[0]


def resolve(landed: Landed, queries: Sequence[str], max_matches: int = 1, strict: bool = False) -> DataFrame:
    """Facet rows for location queries on every site, each against the same options.

    ``strict`` scores options as published, with the bonuses for all of them.
    """
    return facet_ops.resolve_locations(landed_options(landed), queries, max_matches, strict)


def resolve_in_turn(
    landed: Landed, index: narrowing.FacetIndex, queries: Sequence[str], max_matches: int = 1, strict: bool = False
) -> narrowing.Resolved:
    """Options, misses and facets for location queries that narrow one after the other, from the address's facets on.

    This is also the answer when only the locations are asked for.
    """
    sites = landed.sites.select("source", "source_ord")
    options = materialize(landed_options(landed).join(sites, "source"))
    return narrowing.resolve_in_turn(options, index, address_facets(landed.sites).join(sites, "source"), queries, max_matches, strict)


def runtime_facets(base: DataFrame, resolved: DataFrame) -> DataFrame:
    """Facets from the address first, then the resolved locations, repeats removed."""
    first = base.select("source", "facet_key", "value", "ord")
    first = first.withColumn("ord", F.struct(F.lit(0).alias("part"), F.col("ord.a").alias("a"), F.col("ord.b").alias("b")))
    then = resolved.withColumn("ord", F.struct(F.lit(1).alias("part"), F.col("ord.a").alias("a"), F.col("ord.b").alias("b")))
    return facet_ops.merge_facet_rows(first.unionByName(then.select(*first.columns)))


def address_facets(sites: DataFrame) -> DataFrame:
    """Facet rows given in the query strings of the site addresses."""
    return (
        site_table(sites)
        .select("source", F.posexplode("facets").alias("k", "facet_key", "values"))
        .select("source", "facet_key", "k", F.posexplode("values").alias("v", "value"))
        .select("source", "facet_key", "value", F.struct(F.col("k").cast("bigint").alias("a"), F.col("v").cast("bigint").alias("b")).alias("ord"))
    )


def narrowed(postings: DataFrame, members: DataFrame, facets: DataFrame) -> DataFrame:
    """Postings that carry, for every facet key chosen for their site, at least one of its values.

    ``members`` says which posting carries what (``source_ord``, ``url``,
    ``facet_key``, ``value``), ``facets`` what is chosen (``source_ord``,
    ``facet_key``, ``value``). Sites without a choice keep all.
    """
    asked = facets.groupBy("source_ord").agg(F.count_distinct("facet_key").alias("_asked"))
    hits = lookup_join(members, facets.select("source_ord", "facet_key", "value").distinct(), ["source_ord", "facet_key", "value"], "url", "left_semi")
    carried = hits.groupBy("source_ord", "url").agg(F.count_distinct("facet_key").alias("_carried"))
    full = carried.join(asked, "source_ord").where("_carried = _asked").select("source_ord", "url")
    rows = postings.withColumn("source_ord", site_ordinal(F.col("ingest_seq")))
    chosen = lookup_join(rows, asked, ["source_ord"], spread_by="url")
    free = chosen.where("_asked is null").drop("_asked")
    bound = chosen.where("_asked is not null").drop("_asked").join(full, ["source_ord", "url"], "left_semi")
    return free.unionByName(bound).select(*postings.columns)


def chosen_by_facets(
    landed: Landed, postings: DataFrame, members: DataFrame, locations: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Postings that the facets of their site's address, and those that ``locations`` resolve to, leave."""
    chosen = address_facets(landed.sites)
    if locations:
        chosen = runtime_facets(chosen, resolve(landed, locations, strict=strict))
    return narrowed(postings, members, chosen.join(landed.sites.select("source", "source_ord"), "source"))


def ranked_search(
    landed: Landed,
    tables: Profiles,
    changes: Mapping[str, float] | None = None,
    max_pages: int | None = 3,
    page_size: int = PAGE_SIZE,
    max_jobs: int | None = 50,
    with_details: bool = True,
    rules: RankRules = RankRules(),
    text: str = "",
    locations: Sequence[str] = (),
    members: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Command-line chain: discover, override weights, rank.

    With ``members`` (see :func:`narrowed`) the facets of the site addresses and
    those that the ``locations`` resolve to choose the postings before the limit.
    """
    if members is None:
        postings = discover(landed, max_pages, page_size, max_jobs, with_details, text)
    else:
        postings = materialize(chosen_by_facets(landed, scan(landed, max_pages, page_size, text), members, locations, strict))
        if max_jobs is not None:
            postings = limit_per_group(by_site(postings), ["site_ord"], "ingest_seq", max_jobs).drop("site_ord")
        postings = fill(landed, materialize(postings)) if with_details else postings
    return rank(postings, override_weights(tables, changes or {}), rules)


def browser_search(
    landed: Landed,
    tables: Profiles,
    locations: Sequence[str] = (),
    titles: Sequence[str] = (),
    max_pages: int = 10,
    page_size: int = PAGE_SIZE,
    max_jobs: int = 50,
    top_rows: int = 25,
    with_details: bool = True,
    text: str = "",
    members: DataFrame | None = None,
    location_matches: int = 1,
) -> Found:
    """Browser chain: with any filter, details are read for matching postings only.

    With ``members`` the facets of the site addresses, and the options that the
    locations resolve to in turn, choose the postings first.
    """
    if [q for q in locations if q.strip()] or titles or members is not None:
        found = discover_filtered(
            landed, locations, titles, max_pages, page_size, max_jobs, with_details, text, members, location_matches
        )
    else:
        # counted before any detail is read
        listed = materialize(discover(landed, max_pages, page_size, max_jobs, False, text))
        n = F.count("*")
        counts = by_site(listed).groupBy("site_ord").agg(n.alias("scanned"), n.alias("kept"))
        found = Found(fill(landed, listed) if with_details else listed, counts)
    return Found(top(rank(found.postings, tables), top_rows), found.counts)


def older_records(landed: Landed, n_pages: int = 29, max_jobs: int = 200) -> DataFrame:
    """Older chain: fixed pages, strict details, digest; six flat values per posting."""
    pages = cut_fixed(parse_pages(once(landed.pages)), n_pages)
    items = with_site(summaries(pages), site_table(landed.sites), spread_by="page_no")
    postings = by_site(summary_postings(items))
    postings = limit_per_group(postings, ["site_ord"], "ingest_seq", max_jobs)
    details = landed.details.lookup(materialize(postings)) if isinstance(landed.details, DetailStore) else landed.details
    return flat_records(postings, details)
