import pytest
from pyspark.sql import functions as F

from rolecast.functions import urls


def site(spark, url):
    return spark.createDataFrame([(url,)], "u string").select(urls.infer_site(F.col("u")).alias("s")).first().s


CASES = [
    ("https://acme.wd5.example.com/AcmeSite?locationHierarchy1=L&jobFamilyGroup=A&jobFamilyGroup=B", "acme", "AcmeSite", "en-US", None),
    ("https://acme.wd5.example.com/en-US/Acme_Careers/details/Foo_123", "acme", "Acme_Careers", "en-US", None),
    ("https://wd1.example.com/en-US/recruiting/fmr/FCareers", "fmr", "FCareers", "en-US", "/en-US/recruiting/fmr/FCareers"),
    ("https://wd1.example.com/recruiting/fmr/FCareers/x", "fmr", "FCareers", "en-US", "/recruiting/fmr/FCareers"),
    ("https://explore.jobs.netflix.net/careers", "netflix", "Netflix", "en-US", None),
    ("https://WWW.borgwarner.com/Careers/job-search", "borgwarner", "BorgWarner_Careers", "en-US", None),
    ("https://www.borgwarner.com/other", "www", "other", "en-US", None),
    ("https://t.wd1.example.com/wday/cxs/T/SITE/jobs", "T", "SITE", "en-US", None),
    ("https://t.wd1.example.com/wday/cxs/T/SITE", "t", "wday", "en-US", None),
    ("https://cw.wd1.example.com/en-US/External", "cw", "External", "en-US", None),
    ("https://cw.wd1.example.com/fr-FR", "cw", "fr-FR", "en-US", None),
    ("https://cw.wd1.example.com/fr-FR/Site", "cw", "Site", "fr-FR", None),
    ("https://papedawson.wd12.example.com/pde", "papedawson", "pde", "en-US", None),
]


@pytest.mark.parametrize("url,tenant,name,locale,prefix", CASES)
def test_infer_site(spark, url, tenant, name, locale, prefix):
    s = site(spark, url)
    assert (s.tenant, s.site, s.locale, s.public_prefix, s.error) == (tenant, name, locale, prefix, None)


def test_facets_of_an_address(spark):
    assert site(spark, CASES[0][0]).facets == {"locationHierarchy1": ["L"], "jobFamilyGroup": ["A", "B"]}
    s = site(spark, "https://a.example.com/S?q=x&searchText=y&b=&c&d=1%202+3&e=%zz#f?g=1")
    assert s.facets == {"d": ["1 2 3"], "e": ["%zz"]}


@pytest.mark.parametrize("url", ["not a url", "", None, "/path/only", "https://h.example.com/"])
def test_bad_addresses_are_reported(spark, url):
    s = site(spark, url)
    assert s.error and s.site is None


def test_site_addresses(spark):
    a, b, c = F.lit("https://h"), F.lit("T"), F.lit("S")
    row = spark.range(1).select(
        urls.list_address(a, b, c).alias("l"),
        urls.referer(a, c, F.lit("en-US"), F.lit("x/y")).alias("r"),
        urls.referer(a, c, F.lit("en-US"), F.lit(None).cast("string")).alias("d"),
    ).first()
    assert tuple(row) == ("https://h/wday/cxs/T/S/jobs", "https://h/x/y", "https://h/en-US/S")


def test_posting_address_and_requisition(spark):
    rows = [("/job/A_JR001767",), ("a_2012720?x=1",), ("_JR001-1",), ("",), ("http://x/y",), (None,), ("/job/A_\u0663\u0664",)]
    df = spark.createDataFrame(rows, "p string").select(
        urls.posting_address(F.lit("https://b"), F.lit("/en-US/S/"), F.col("p")).alias("u"),
        urls.requisition_id(F.col("p")).alias("r"),
        urls.requisition_id(F.col("p"), query_suffix=False).alias("o"),
    )
    got = [tuple(r) for r in df.collect()]
    assert got == [
        ("https://b/en-US/S/job/A_JR001767", "JR001767", "JR001767"),
        ("https://b/en-US/S/a_2012720?x=1", "2012720", ""),
        ("https://b/en-US/S/_JR001-1", "", ""),
        ("https://b/en-US/S/", "", ""),
        ("http://x/y", "", ""),
        ("https://b/en-US/S/", "", ""),
        ("https://b/en-US/S/job/A_\u0663\u0664", "\u0663\u0664", "\u0663\u0664"),
    ]


def test_facet_maps(spark):
    row = spark.range(1).select(
        urls.assigned_facets(F.array(F.lit("k=v=1"), F.lit("k=w"), F.lit("j="))).alias("a"),
        urls.single_facets(F.create_map(F.lit("q"), F.lit("x"), F.lit("r"), F.lit(""))).alias("s"),
        urls.mapping_facets(F.create_map(F.lit("m"), F.array(F.lit("a"), F.lit("")))).alias("m"),
    ).first()
    assert row.a == {"k": ["v=1", "w"], "j": [""]} and row.s == {"r": [""]} and row.m == {"m": ["a"]}
    with pytest.raises(Exception, match="key=value"):
        spark.range(1).select(urls.assigned_facets(F.array(F.lit("novalue")))).collect()
