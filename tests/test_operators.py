"""Paging, limits and joins, also on their skew paths, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rolecast.operators import joins, limits, paging, postings
from rolecast.plans import search
from rolecast.sources import landed as landed_files
from rolecast.sources.landed import LIST_PAGE
from rolecast.sources.presets import EXAMPLE_SITES


def pages_of(spark, sizes, total=None):
    """Landed pages from ``source -> [entries per page]``."""
    rows = []
    for source, counts in sizes.items():
        for i, n in enumerate(counts):
            body = {"jobPostings": [{"title": f"{source} {i} {j}", "externalPath": f"/job/x_{i}{j}"} for j in range(n)]}
            if total is not None:
                body = {"positions": body["jobPostings"], **({"count": total[source]} if total[source] else {})}
            rows.append((source, i + 1, json.dumps(body)))
    return spark.createDataFrame(rows, LIST_PAGE)


def kept(pages):
    got = {}
    for r in pages.select("source", "page_no").collect():
        got.setdefault(r.source, []).append(r.page_no)
    return {k: sorted(v) for k, v in got.items()}


def test_short_page_ends_the_scan(spark):
    parsed = paging.parse_pages(pages_of(spark, {"a": [2, 2, 1, 2], "b": [2, 0, 2], "c": [2, 2], "d": [1]}))
    assert kept(paging.cut_at_short_page(parsed, 2)) == {"a": [1, 2, 3], "b": [1, 2], "c": [1, 2], "d": [1]}
    assert kept(paging.cut_at_short_page(parsed, 2, max_pages=2))["a"] == [1, 2]
    assert kept(paging.cut_fixed(parsed, 3))["a"] == [1, 2, 3]


def test_short_test_counts_entries_that_are_no_objects(spark):
    body = json.dumps({"jobPostings": [{"title": "x"}, "y"]})
    parsed = paging.parse_pages(spark.createDataFrame([("a", 1, body), ("a", 2, "{}")], LIST_PAGE))
    assert kept(paging.cut_at_short_page(parsed, 2)) == {"a": [1, 2]}
    assert [r.position for r in paging.summaries(parsed).collect()] == [0]


def test_total_ends_the_scan(spark, monkeypatch):
    monkeypatch.setattr(paging, "PAGES_PER_RUN", 3)
    random.seed(1)
    sizes = {f"s{i}": [random.randint(0, 3) if random.random() < 0.9 else 0 for _ in range(12)] for i in range(8)}
    sizes["none"] = [2, 2]
    totals = {s: random.choice([1, 5, 9, 50]) for s in sizes} | {"none": None}
    parsed = paging.parse_pages(pages_of(spark, sizes, totals), alternate=True)
    expected = {}
    for s, counts in sizes.items():
        read, pages = 0, []
        for i, n in enumerate(counts):
            pages.append(i + 1)
            read += n
            if n == 0 or read >= (totals[s] or n):
                break
        expected[s] = pages
    assert kept(paging.cut_at_total(parsed)) == expected


def test_offsets_and_sequence(spark):
    assert spark.range(1).select(paging.page_offset(F.lit(3), 20).alias("o")).first().o == 40
    places = [(0, 1, 70_000), (0, 2, 0), (0, (1 << 24) + 1, 3), (1, 1, 0)]
    rows = spark.createDataFrame(places[::-1], "s long, p long, i long")
    seq = paging.ingest_seq(F.col("s"), F.col("p"), F.col("i"))
    got = rows.select(seq.alias("seq"), paging.site_ordinal(seq).alias("site")).orderBy("seq").collect()
    assert [tuple(r.seq) for r in got] == places
    assert [r.site for r in got] == [0, 0, 0, 1]
    with pytest.raises(Exception, match="page must be"):
        spark.range(1).select(paging.page_offset(F.col("id"), 20)).collect()


def test_top_per_group_is_exact_for_a_hot_group(spark):
    random.seed(2)
    rows = [("hot" if random.random() < 0.8 else f"g{i % 5}", random.randint(0, 9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, score int, seq int")
    got = limits.top_per_group(df, ["g"], [F.desc("score")], 7, unique=["seq"], rank="r")
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:7]
        assert [(r.g, r.score, r.seq) for r in got.where(F.col("g") == g).orderBy("r").collect()] == best


def test_scan_counts_and_limits(spark):
    random.seed(4)
    rows = [(f"g{i % 3}", i, random.random() < 0.2) for i in range(200)] + [("empty", 500, False), ("empty", 501, None)]
    df = spark.createDataFrame(rows, "g string, seq int, hit boolean")
    for n in (0, 1, 5, 1000):
        got = {r.g: (r.scanned, r.kept) for r in limits.scan_counts(df, F.col("hit"), ["g"], "seq", n).collect()}
        for g in {r[0] for r in rows}:
            scanned = hits = 0
            for r in rows:
                if r[0] != g:
                    continue
                scanned += 1
                hits += bool(r[2])
                if r[2] and hits >= n:
                    break
            assert got[g] == (scanned, hits), (g, n)
    assert limits.limit_per_group(df, ["g"], "seq", 0).count() == 4


@pytest.mark.parametrize("broadcast_rows,hot_rows", [(1000, 10), (0, 10), (0, 10**6)])
def test_lookup_join_paths_agree(spark, broadcast_rows, hot_rows):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"))
    small = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k bigint, v string")
    got = joins.lookup_join(big, small, ["k"], spread_by="n", broadcast_rows=broadcast_rows, hot_rows=hot_rows)
    assert sorted(map(tuple, got.select("k", "n", "v").collect())) == sorted(
        (n % 7, n, f"v{n % 7}" if n % 7 < 5 else None) for n in range(1000)
    )


@pytest.mark.parametrize("hot_rows", [50, 10**6])
def test_hot_key_join_paths_agree(spark, hot_rows):
    left = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.concat(F.lit("k"), "id")).alias("u"), F.col("id").alias("n"))
    right = spark.createDataFrame([("hot", 1), ("k6", 2), ("unused", 3)], "u string, v int")
    got = {r.n: r.v for r in joins.hot_key_join(left, right, ["u"], spread_by="n", hot_rows=hot_rows).collect()}
    assert got == {n: 1 if n % 3 else (2 if n == 6 else None) for n in range(600)}
    inner = joins.hot_key_join(left, right, ["u"], spread_by="n", how="inner", hot_rows=hot_rows)
    assert sorted(r.n for r in inner.collect()) == sorted(n for n in range(600) if n % 3 or n == 6)


def landed(spark, n_sites=2):
    sites = spark.createDataFrame([(f"https://s{i}.example.com/Careers", i) for i in range(n_sites)], "source string, source_ord bigint")
    pages = pages_of(spark, {f"https://s{i}.example.com/Careers": [3, 3, 1] for i in range(n_sites)})
    ld = {"@type": "JobPosting", "title": "x", "description": "<p>hello</p>", "datePosted": "2024-01-01", "jobLocation": {"address": {"addressLocality": "Rome"}}}
    html = f'<script type="application/ld+json">{json.dumps(ld)}</script>'
    url = "https://s0.example.com/en-US/Careers/job/x_00"
    return search.Landed(sites, pages, spark.createDataFrame([(url, html), (url, html), ("other", "")], "url string, html string"))


def test_discover_hydrates_and_limits_per_site(spark):
    rows = search.discover(landed(spark), page_size=3, max_jobs=4).orderBy("ingest_seq").collect()
    assert len(rows) == 8 and rows[0].title == "https://s0.example.com/Careers 0 0"
    assert tuple(rows[0].asDict()) == postings.POSTING_COLUMNS
    assert (rows[0].description_text, rows[0].location, rows[0].date_posted) == ("hello", "Rome", "2024-01-01")
    assert {r.description_text for r in rows[1:]} == {""} and {r.source for r in rows} == {"Careers"}


def test_filter_first_counts_what_was_read(spark):
    found = search.discover_filtered(landed(spark), [], ["1 0", "2 0"], page_size=3, max_jobs=1)
    assert [r.title for r in found.postings.orderBy("ingest_seq").collect()] == [f"https://s{i}.example.com/Careers 1 0" for i in (0, 1)]
    assert sorted(map(tuple, found.counts.collect())) == [(0, 4, 1), (1, 4, 1)]


def test_addresses_give_facets(spark):
    sites = spark.createDataFrame([("https://h.example.com/S?a=1&b=2&a=3", 0)], "source string, source_ord bigint")
    base = search.address_facets(sites)
    rows = [(sites.first().source, "b", "2", (0, 1)), (sites.first().source, "b", "9", (0, 2))]
    resolved = spark.createDataFrame(rows, "source string, facet_key string, value string, ord struct<a bigint, b bigint>")
    merged = search.runtime_facets(base, resolved).orderBy("ord").collect()
    assert [(r.facet_key, r.value) for r in merged] == [("a", "1"), ("a", "3"), ("b", "2"), ("b", "9")]


def test_alternate_details_fill_blank_descriptions_only(spark):
    body = {"positions": [{"id": 1, "name": "A", "description": "own"}, {"id": 2, "name": "B", "locations": "X"}, {"id": 3, "name": "C", "locations": ["Y", "", 5]}]}
    source = "https://explore.jobs.netflix.net/careers"
    sites = spark.createDataFrame([(source, 0)], "source string, source_ord bigint")
    details = spark.createDataFrame([("1", '{"description": "no"}'), ("2", '{"job": {"description": "<b>late</b>"}}'), ("3", "[]"), ("", '{"description": "z"}')], "job_id string, payload string")
    found = search.discover(search.Landed(sites, spark.createDataFrame([(source, 1, json.dumps(body))], LIST_PAGE), details, alternate=True))
    rows = found.orderBy("ingest_seq").collect()
    assert [(r.req_id, r.title, r.location, r.description_text, r.hiring_organization) for r in rows] == [
        ("1", "A", "", "own", "Netflix"), ("2", "B", "X", "late", "Netflix"), ("3", "C", "Y, 5", "", "Netflix"),
    ]
    assert rows[1].url == "https://explore.jobs.netflix.net/careers/job/2"


def test_older_chain_is_strict_about_the_pages_it_reads(spark):
    given = landed(spark, 1)
    block = '<script type="application/ld+json">{"description": "a What you will be doing: b / c"}</script>'
    url = "https://s0.example.com/en-US/Careers/job/x_0"
    pages = spark.createDataFrame([(f"{url}0", block), ("unread", "no block")], "url string, html string")
    rows = search.older_records(given._replace(details=pages), n_pages=2, max_jobs=5).orderBy("ingest_seq").collect()
    assert [(r.req_id, r.digest) for r in rows] == [("00", "b/c"), ("01", None), ("02", None), ("10", None), ("11", None)]
    bad = spark.createDataFrame([(f"{url}1", "no block")], "url string, html string")
    with pytest.raises(Exception, match="block not found"):
        search.older_records(given._replace(details=bad)).collect()


def test_locations_resolve_per_site(spark):
    body = {"facets": [{"facetParameter": "locations", "values": [{"descriptor": "Rome", "id": "R"}, {"descriptor": "Oslo", "id": "O"}]}]}
    pages = spark.createDataFrame([("s", 1, json.dumps(body)), ("s", 2, json.dumps({"facets": [{"name": "locations", "items": [{"label": "Rome", "id": "no"}]}]}))], LIST_PAGE)
    given = search.Landed(None, pages, None)
    assert [(r.facet_key, r.value) for r in search.resolve(given, ["rome"]).collect()] == [("locations", "R")]
    assert search.resolve(given._replace(alternate=True), ["rome"]).count() == 0


def test_landed_files_and_example_sites(spark, tmp_path):
    pages = spark.createDataFrame([("https://h.example.com/S", 1, '{"jobPostings": [{"title": "A"}]}')], LIST_PAGE)
    details = spark.createDataFrame([("u", "<p>")], landed_files.DETAIL_PAGE)
    more = spark.createDataFrame([("1", "{}")], landed_files.ALTERNATE_DETAIL)
    for kind in ("parquet", "json"):
        for name, df, read in (("l", pages, landed_files.read_list_pages), ("d", details, landed_files.read_detail_pages), ("a", more, landed_files.read_alternate_details)):
            df.write.format(kind).save(f"{tmp_path}/{kind}-{name}")
            assert read(spark, f"{tmp_path}/{kind}-{name}", kind).collect() == df.collect()
    known = landed_files.example_sites(spark)
    assert known.count() == len(EXAMPLE_SITES)
    assert {k for part in search.split_sites(known) for k in part.columns} == {"source", "source_ord"}
    assert search.split_sites(known)[1].count() == 1
    assert search.site_table(known).where("error is not null").count() == 0
    named = landed_files.example_sites(spark, "Draper", "Cisco").orderBy("source_ord").collect()
    assert [r.source for r in named] == [EXAMPLE_SITES["Draper"], EXAMPLE_SITES["Cisco"]]


def test_details_are_reduced_before_they_are_read(spark, monkeypatch):
    stored, write = [], joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df: stored.append(df) or write(df))
    details = spark.createDataFrame([(f"u{i}", "<p>", i) for i in range(9)], "url string, html string, landed_seq int").repartition(3)
    posts = spark.range(3).select(*[F.lit(None).cast("string").alias(c) for c in postings.POSTING_COLUMNS]).withColumn("url", F.lit("u1"))
    posts = posts.withColumn("raw_summary", F.parse_json(F.lit("{}"))).withColumn("raw_json_ld", F.parse_json(F.lit("{}")))
    postings.hydrate(posts, details)
    facts = next(df for df in stored if "ld_title" in df.columns)  # what is read is written before a copy is chosen
    plan = facts._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "Join LeftSemi" in line)
    below = []
    for line in plan[at + 1 :]:
        if depth(line) <= depth(plan[at]):
            break
        below.append(line)
    assert below and not any(word in line for line in below for word in ("regexp", "parse_json", "lambda", "AS _p"))
    assert any("AS ld_title" in line for line in plan[:at])


@pytest.mark.parametrize("alternate", [False, True])
def test_of_copies_the_readable_one_stays(spark, alternate):
    name = "positions" if alternate else "jobPostings"
    rows, wanted = [], {}
    for i in range(1, 31):
        good = json.dumps({name: [{"title": f"t{i}"}, {"title": "u"}]})
        wanted[i] = good
        rows += [("s", i, good)] + [("s", i, bad) for bad in (f'{{"{name}": [', None, "", "null", json.dumps({name: []}))]
    found = paging.once(spark.createDataFrame(rows, LIST_PAGE), alternate)
    assert {r.page_no: r.payload for r in found.collect()} == wanted
    assert found.count() == len(wanted)
