"""Facets that narrow in turn, the text index and saved searches, against plain sets."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from rolecast.functions.places import any_place_matches
from rolecast.operators import narrowing, paging, saved, textindex
from rolecast.plans import search
from rolecast.session import shared_folder
from tests.test_details import files_read


def carried(seed, sites=3, postings=120):
    rng = random.Random(seed)
    rows = []
    for s in range(sites):
        for p in range(postings):
            rows += [(s, f"u{p}", "locationHierarchy1", rng.choice(["us", "de"])), (s, f"u{p}", "locationHierarchy2", rng.choice(["north", "south", "west"]))]
            rows += [(s, f"u{p}", "kind", k) for k in rng.sample(["a", "b", "c"], rng.randrange(3))]
    return rows


SHAPE = "source_ord long, url string, facet_key string, value string"


def plain_selection(rows, chosen):
    held = {}
    for s, u, k, v in rows:
        held.setdefault((s, u), set()).add((k, v))
    out = set()
    for (s, u), has in held.items():
        keys = {k for o, k, _ in chosen if o == s}
        if keys and all(any((k, v) in has for o, q, v in chosen if o == s and q == k) for k in keys):
            out.add((s, u))
    return out


def test_bitmaps_select_and_count_like_sets(spark):
    rows = carried(1)
    index = narrowing.facet_index(spark.createDataFrame([*rows, rows[0], (None, "u", "kind", "a"), (1, "u1", "kind", None)], SHAPE))
    chosen = [(0, "locationHierarchy1", "us"), (0, "kind", "a"), (0, "kind", "b"), (1, "kind", "nowhere"), (1, "locationHierarchy2", "west")]
    picked = spark.createDataFrame(chosen, "source_ord long, facet_key string, value string")
    selected = plain_selection(rows, chosen)
    want = {}
    for s, u, k, v in set(rows):
        if (s, u) in selected:
            want[s, k, v] = want.get((s, k, v), 0) + 1
    got = narrowing.recounted(index, narrowing.selection(index, picked)).collect()
    assert {tuple(r)[:3]: r["left"] for r in got} == want
    posts = spark.createDataFrame(sorted({(s, u, "x") for s, u, _, _ in rows}) + [(0, "unknown", "x"), (2, "unknown", "x")], "source_ord long, url string, row string")
    kept = {tuple(r)[:2] for r in narrowing.carrying(index, posts, picked).collect()}
    assert kept == selected | {(2, u) for s, u, _, _ in rows if s == 2} | {(2, "unknown")}


def test_a_site_with_very_many_postings_is_many_bitmaps(spark):
    rows = spark.range(100_000).select(F.lit(0).cast("long").alias("source_ord"), F.col("id").cast("string").alias("url"), F.lit("k").alias("facet_key"), (F.col("id") % 2).cast("string").alias("value"))
    index = narrowing.facet_index(rows)
    assert index.bits.select("bucket").distinct().count() >= 4
    one = spark.createDataFrame([(0, "k", "1")], "source_ord long, facet_key string, value string")
    assert [tuple(r) for r in narrowing.recounted(index, narrowing.selection(index, one)).collect()] == [(0, "k", "1", 50_000)]


def tree(counts):
    import json

    values = [{"descriptor": label, "id": v, "count": n} for v, label, n in counts]
    return json.dumps({"jobPostings": [], "facets": [{"facetParameter": "locationHierarchy1", "descriptor": "Locations", "values": values}]})


def landed(spark, pages, sites=("https://a.example.com/Careers",), **kinds):
    site_rows = spark.createDataFrame([(s, i) for i, s in enumerate(sites)], "source string, source_ord long")
    return search.Landed(site_rows, spark.createDataFrame(pages, "source string, page_no long, payload string"), None, **kinds)


def test_the_second_location_sees_what_the_first_has_left(spark):
    site = "https://a.example.com/Careers"
    options = [("us", "United States", 5), ("bos-us", "Boston", 2), ("bos-uk", "Boston Spa", 9), ("uk", "United Kingdom", 9)]
    members = [(0, f"p{i}", "locationHierarchy1", "us") for i in range(5)] + [(0, f"p{i}", "locationHierarchy1", "bos-us") for i in range(2)]
    members += [(0, f"q{i}", "locationHierarchy1", v) for i in range(9) for v in ("uk", "bos-uk")]
    crawl = landed(spark, [(site, 1, tree(options))])
    index = narrowing.facet_index(spark.createDataFrame(members, SHAPE))
    found = search.resolve_in_turn(crawl, index, ["US", "boston", "mars"])
    assert [(r.query, r.value, r["count"]) for r in found.matches.orderBy("query_no").collect()] == [("US", "us", 5), ("boston", "bos-us", 2)]
    assert [tuple(r) for r in found.misses.collect()] == [(site, "mars")]
    assert {(r.facet_key, r.value) for r in found.facets.collect()} == {("locationHierarchy1", "us"), ("locationHierarchy1", "bos-us")}
    # without narrowing an exact label wins as well, but nothing is counted again
    alone = search.resolve_in_turn(crawl, index, ["boston"], 2).matches.orderBy("rank").collect()
    assert [(r.value, r["count"]) for r in alone] == [("bos-us", 2), ("bos-uk", 9)]
    none = search.resolve_in_turn(crawl, index, [])
    assert none.matches.count() == none.misses.count() == none.facets.count() == 0


def test_facet_pages_that_landed_twice_count_once(spark):
    site = "https://a.example.com/Careers"
    page = (site, 1, tree([("i1", "House one", 3), ("i2", "House two", 2), ("i3", "Housing", 1)]))
    for pages in ([page], [page, page], [page, (site, 1, "broken"), page]):
        rows = search.resolve(landed(spark, pages), ["house"], 2).collect()
        assert sorted(r.value for r in rows) == ["i1", "i2"]


def test_a_site_named_like_the_other_listing_keeps_its_own_details(spark):
    """A mixed list: the kind of a posting follows its site, not the site's name."""
    usual = "https://acme.wd1.example.com/en-US/Netflix"
    import json

    page = json.dumps({"jobPostings": [{"title": "Engineer", "externalPath": "/job/X_JR1"}]})
    crawl = landed(spark, [(usual, 1, page)], [usual], alternate=None)
    url = search.scan(crawl).first().url
    html = '<script type="application/ld+json">{"@type":"JobPosting","title":"Engineer","description":"Builds things"}</script>'
    details = spark.createDataFrame([(url, html)], "url string, html string")
    other = spark.createDataFrame([], "job_id string, payload string")
    crawl = crawl._replace(details=details, alternate_details=other)
    assert [r.description_text for r in search.discover(crawl).collect()] == ["Builds things"]


def posts(spark, texts):
    return spark.createDataFrame([(i, t, "d " + (t or "")) for i, t in enumerate(texts)], "ingest_seq bigint, title string, description_text string")


TEXTS = ["The house with a view", "theWITH", "wi th the", None, "", "Other people with\tothers", "WITH", "the\nwith", "c++, with c#", "within the"]


@pytest.mark.parametrize("text", ["The WITH", "th", "c++", "unheard the", "", "  ", "WITH", "a view the"])
def test_an_indexed_search_finds_what_a_scan_does(spark, text):
    rows = posts(spark, TEXTS)
    index = textindex.build_text_index(rows, "title", "description_text", buckets=8)
    want = {r.ingest_seq for r in paging.search_text(rows, text, "title", "description_text").collect()}
    assert {r.ingest_seq for r in textindex.index_search(index, text).collect()} == want
    words = set(text.lower().split())
    whole = {i for i, t in enumerate(TEXTS) if words <= set(f"{t or ''}\nd {t or ''}".lower().split())}
    assert {r.ingest_seq for r in textindex.index_search(index, text, whole=True).collect()} == whole


def test_a_search_reads_only_the_buckets_that_it_asks_for(spark):
    rng = random.Random(2)
    rows = posts(spark, [" ".join(f"word{rng.randrange(900)}" for _ in range(40)) for _ in range(200)])
    index = textindex.build_text_index(rows, "title", "description_text", buckets=16)
    every = files_read(spark.read.parquet(index.path))
    assert every >= 16
    assert 1 <= files_read(textindex.index_search(index, "word77 word801", whole=True)) <= every // 4
    assert 1 <= files_read(textindex.index_search(index, "word877")) <= every // 8


def test_a_frequent_token_is_spread_over_files(spark):
    rows = spark.range(60_000).select(F.col("id").alias("ingest_seq"), F.lit("the").alias("title"), F.col("id").cast("string").alias("description_text"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else so little is one file
    spark.conf.set(name, "false")
    try:
        index = textindex.build_text_index(rows, "title", "description_text", buckets=4)
    finally:
        spark.conf.unset(name)
    lists = spark.read.parquet(index.path).where("token = 'the'").select(F.input_file_name().alias("f")).distinct()
    assert lists.count() > 1
    assert textindex.index_search(index, "the", whole=True).count() == 60_000


PLACES = ["boston ma us", "remote us", "austin texas", "london uk", "", "usual place", "berlin de", "new york ny united states", "cambridge massachusetts"]
QUERIES = ["US", "ma", "Boston", "texas", "usa", "uk", " ", "", "zz", "new york", "us", "TX", "re", "e"]


def test_saved_searches_match_like_the_filter(spark):
    places = spark.createDataFrame(list(enumerate(PLACES * 3)), "ingest_seq bigint, place string")
    searches = spark.createDataFrame([*enumerate(QUERIES), (0, "Boston")], "search_id bigint, query string")
    got = sorted(tuple(r) for r in saved.saved_matches(places, searches).collect())
    want = []
    for i, q in [*enumerate(QUERIES)]:
        asked = [q, "Boston"] if i == 0 else [q]
        if any(a.strip() for a in asked):
            want += [(i, r.ingest_seq) for r in places.where(any_place_matches(F.col("place"), asked)).where("place <> ''").collect()]
    assert got == sorted(want)


def test_saved_searches_need_no_nested_loop(spark):
    places = spark.createDataFrame(list(enumerate(PLACES)), "ingest_seq bigint, place string")
    searches = spark.createDataFrame(list(enumerate(QUERIES)), "search_id bigint, query string")
    plan = saved.saved_matches(places, searches)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert saved.saved_matches(places, searches.where("false")).count() == 0
    assert saved.saved_matches(places.where("false"), searches).count() == 0


def test_saved_searches_are_counted_without_a_row_for_a_match(spark):
    # postings that are listed twice, with one place or with two, and searches for the same names
    listed = [*enumerate(PLACES * 40), *enumerate(PLACES), (3, "remote us"), (None, "london uk"), (None, "austin texas")]
    places = spark.createDataFrame(listed, "ingest_seq bigint, place string")
    searches = spark.createDataFrame([*enumerate(QUERIES * 30), (0, "Boston")], "search_id bigint, query string")
    want = saved.saved_matches(places, searches).groupBy("search_id").agg(F.count("*").alias("found"))
    want = sorted(tuple(r) for r in want.collect())
    before = set(glob.glob(f"{shared_folder(spark)}/rolecast-*"))
    got = sorted(tuple(r) for r in saved.saved_counts(places, searches).collect())
    assert got == want
    stored = [spark.read.parquet(p).count() for p in set(glob.glob(f"{shared_folder(spark)}/rolecast-*")) - before]
    assert max(stored) <= max(len(listed), 30 * len(QUERIES)) < sum(n for _, n in got) / 10
    assert saved.saved_counts(places, searches.where("false")).count() == 0
    assert saved.saved_counts(places.where("false"), searches).count() == 0


def test_an_index_is_built_in_one_look_at_the_texts_and_searched_without_its_vocabulary(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = posts(spark, [f"the{i} with{i} other{i}" for i in range(300)])
    index = textindex.build_text_index(rows.mapInArrow(look, rows.schema), "title", "description_text", buckets=4)
    assert seen.value == 300
    found = textindex.index_search(index, "the")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 300
