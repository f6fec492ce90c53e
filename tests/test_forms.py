"""Forms as rows, and sites given by their parts."""

import json

import pytest

from rolecast.operators import narrowing
from rolecast.operators.postings import site_table
from rolecast.plans import forms, search
from rolecast.plans.forms import COUNTS, KNOBS
from rolecast.sources.presets import DEFAULT_PROFILE, PROPERTY_PROFILE

TEXTS = ["form_id", "url", "location", "query", "title_keywords", "profile_key", "core_plus_weights", "nice_weights", "light_neg_weights"]
NAMES = [*TEXTS, *KNOBS, *COUNTS, "hydrate", "action"]


def submitted(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], ", ".join(f"{n} string" for n in NAMES))


def test_a_form_is_read_with_defaults_and_bounds(spark):
    read = forms.read_forms(
        submitted(
            spark,
            {"form_id": "empty"},
            {
                "form_id": "full", "url": " https://x ", "location": "US, Boston\n ,", "query": " go ", "title_keywords": "qa\nsdet", "profile_key": PROPERTY_PROFILE,
                "core_plus_weights": "python = 2\nbad line\nzoning = x", "light_neg_weights": "sales = -1", "title_boost": "99", "length_bonus_cap": "x",
                "length_bonus_divisor": "0", "pages": "0", "page_size": "1_0", "max_jobs": "9999999999999", "top": "7", "location_matches": "", "hydrate": "on", "action": "locations",
            },
            {"form_id": "odd", "profile_key": "unheard", "hydrate": "off", "pages": "ten"},
        )
    )
    rows = {r.form_id: r for r in read.settings.collect()}
    e, f, o = rows["empty"], rows["full"], rows["odd"]
    assert (e.url, e.locations, e.titles, e.query, e.profile_key, e.action, e.hydrate) == ("", [], [], "", DEFAULT_PROFILE, "rank", False)
    assert [e[c] for c in COUNTS] == [10, 20, 50, 25, 1] and [e[c] for c in KNOBS] == [1.35, 1.25, 900.0]
    assert (f.url, f.locations, f.titles, f.query, f.profile_key, f.action, f.hydrate) == ("https://x", ["US", "Boston"], ["qa", "sdet"], "go", PROPERTY_PROFILE, "locations", True)
    assert [f[c] for c in COUNTS][:1] == [1] and f.max_jobs == 500 and f.top == 7 and f.location_matches == 1
    assert [f[c] for c in KNOBS] == [10.0, 1.25, 1.0]
    assert o.profile_key == DEFAULT_PROFILE and o.pages == 10 and not o.hydrate
    assert sorted((r.bucket, r.term, r.weight) for r in read.tables.terms.collect()) == [("core", "python", 2.0), ("neg", "sales", -1.0)]
    assert sorted((r.form_id, r.bucket, r.line, r.error) for r in read.errors.collect()) == [
        ("full", "core", 2, "must look like term = weight"), ("full", "core", 3, "has a non-numeric weight"),
    ]


def crawl(spark):
    site = "https://acme.wd1.example.com/en-US/Jobs"
    jobs = [{"title": f"{t} Engineer", "externalPath": f"/job/X_JR{i}", "locationsText": p} for i, (t, p) in enumerate([("QA", "Boston"), ("Sales", "Boston"), ("QA", "Austin")])]
    values = [{"descriptor": p, "id": p.lower(), "count": n} for p, n in (("Boston", 2), ("Austin", 1))]
    payload = json.dumps({"jobPostings": jobs, "facets": [{"facetParameter": "locations", "descriptor": "Locations", "values": values}]})
    landed = search.Landed(
        spark.createDataFrame([(site, 0)], "source string, source_ord long"),
        spark.createDataFrame([(site, 1, payload)], "source string, page_no long, payload string"),
        None,
    )
    urls = [r.url for r in search.scan(landed).orderBy("ingest_seq").collect()]
    members = [(0, u, "locations", "boston" if i < 2 else "austin") for i, u in enumerate(urls)]
    return landed, spark.createDataFrame(members, "source_ord long, url string, facet_key string, value string")


def test_a_form_is_answered(spark):
    landed, members = crawl(spark)
    read = forms.read_forms(
        submitted(
            spark,
            {"form_id": "rank", "location": "boston", "core_plus_weights": "qa = 3\nsales = 1", "top": "5"},
            {"form_id": "where", "location": "boston\nmars", "action": "locations", "location_matches": "2"},
            {"form_id": "bad", "nice_weights": "x"},
        )
    )
    found = forms.answer(landed, read, "rank", members)
    assert [r.title for r in found.postings.orderBy("score", ascending=False).collect()] == ["QA Engineer", "Sales Engineer"]
    where = forms.answer(landed, read, "where", members)
    assert [r.value for r in where.matches.collect()] == ["boston"] and [r["query"] for r in where.misses.collect()] == ["mars"]
    assert isinstance(where, narrowing.Resolved)
    with pytest.raises(ValueError, match="nice line 1 must look like"):
        forms.answer(landed, read, "bad", members)
    with pytest.raises(ValueError, match="no form"):
        forms.answer(landed, read, "unheard", members)


def test_sites_by_their_parts(spark):
    rows = [
        (0, "https://acme.wd1.example.com/en-US/Jobs?place=a", None, None, None, None, ["place=b", "kind=c=d"]),
        (1, None, "https://x.example.com", "x", "Careers", None, ["place=a"]),
        (2, "", "https://x.example.com", None, None, "de-DE", None),
        (3, "https://y.example.com/Jobs", "https://ignored", "i", "I", "fr-FR", []),
    ]
    shape = "source_ord long, url string, base_url string, tenant string, site string, locale string, given array<string>"
    got = {r.source_ord: r for r in forms.site_arguments(spark.createDataFrame(rows, shape)).collect()}
    assert (got[0].source, got[0].tenant, got[0].site) == ("https://acme.wd1.example.com/en-US/Jobs?place=a", "acme", "Jobs")
    assert got[0].facets == {"place": ["a", "b"], "kind": ["c=d"]}
    assert (got[1].source, got[1].locale, got[1].facets, got[1].error) == ("https://x.example.com/wday/cxs/x/Careers/jobs", "en-US", {"place": ["a"]}, None)
    assert got[2].source is None and got[2].error == "give an address, or base_url, tenant and site; missing: tenant, site"
    assert (got[3].tenant, got[3].locale) == ("y", "fr-FR")
    sites = forms.site_arguments(spark.createDataFrame(rows, shape))
    assert site_table(sites).columns == sites.columns


def test_a_scan_of_a_site_given_by_its_parts(spark):
    shape = "source_ord long, url string, base_url string, tenant string, site string, locale string, given array<string>"
    sites = forms.site_arguments(spark.createDataFrame([(4, None, "https://x.example.com", "x", "Careers", None, None)], shape))
    source = sites.first().source
    page = json.dumps({"jobPostings": [{"title": "Engineer", "externalPath": "/job/X_JR1"}]})
    landed = search.Landed(sites, spark.createDataFrame([(source, 1, page)], "source string, page_no long, payload string"), None, None)
    assert [(r.title, r.url) for r in search.scan(landed).collect()] == [("Engineer", "https://x.example.com/en-US/Careers/job/X_JR1")]
