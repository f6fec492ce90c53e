import json

from pyspark.sql import functions as F

from rolecast.operators import facets

NESTED = {
    "facets": [
        {"descriptor": "Location", "facetParameter": "locationHierarchy1", "values": [
            {"descriptor": "United States of America", "id": "US_ID", "count": 123, "children": [
                {"label": "Boston", "value": "B", "count": 0, "items": [{"text": "Deep", "wid": 7, "total": "12"}]},
                "not an object",
                {"label": "", "id": "skipped", "children": [{"label": "Kept", "id": "K", "count": "abc"}]},
            ]},
            {"descriptor": "Bangalore, India", "id": "BLR_ID", "count": 42},
        ]},
        {"name": "cat", "values": {"items": [{"label": "Canada", "value": "c", "count": 5000}]}},
        {"values": [{"label": "no key", "id": "x"}]},
        7,
    ]
}
CITIES = {
    "facetValues": {"facets": [{"descriptor": "Locations", "facetKey": "locations", "items": [
        {"descriptor": "Boston, Massachusetts, US", "id": "BOS_ID", "count": 5},
        {"descriptor": "RTP, North Carolina, US", "id": "RTP_ID", "count": 8},
    ]}]}
}


def docs(spark, **payloads):
    rows = [(k, json.dumps(v)) for k, v in payloads.items()]
    df = spark.createDataFrame(rows, "source string, payload string")
    return df.select("source", F.try_parse_json("payload").alias("doc"))


def test_flatten_walks_depth_first(spark):
    got = [tuple(r) for r in facets.facet_options(docs(spark, a=NESTED)).orderBy("seq").collect()]
    us = ["Location", "United States of America"]
    assert got == [
        ("a", 0, "locationHierarchy1", "US_ID", us[1], 123, us),
        ("a", 1, "locationHierarchy1", "B", "Boston", None, [*us, "Boston"]),
        ("a", 2, "locationHierarchy1", "7", "Deep", 12, [*us, "Boston", "Deep"]),
        ("a", 3, "locationHierarchy1", "K", "Kept", None, [*us, "Kept"]),
        ("a", 4, "locationHierarchy1", "BLR_ID", "Bangalore, India", 42, ["Location", "Bangalore, India"]),
        ("a", 5, "cat", "c", "Canada", 5000, ["cat", "Canada"]),
    ]


def test_other_payload_shapes(spark):
    got = facets.facet_options(docs(spark, a=CITIES, b={"facets": "x"}, c=[1], d={})).collect()
    assert [(r.source, r.value) for r in got] == [("a", "BOS_ID"), ("a", "RTP_ID")]


def chain(depth):
    deep = {"id": str(depth), "descriptor": f"level {depth}"}
    for i in range(depth - 1, -1, -1):
        deep = {"id": str(i), "descriptor": f"level {i}", "children": [deep, {"id": f"{i}b", "descriptor": "" if i % 2 else "side"}]}
    return {"facets": [{"facetParameter": "f", "values": [deep]}]}


def flat_chain(depth):
    """Ids in the order of the walk: down first, then the side branches from the deepest up."""
    return [str(i) for i in range(depth + 1)] + [f"{i}b" for i in range(depth - 1, -1, -1) if not i % 2]


def test_trees_of_any_depth_are_walked(spark):
    assert facets.facet_options(docs(spark, a=NESTED), levels=1).collect() == facets.facet_options(docs(spark, a=NESTED)).collect()
    rows = facets.facet_options(docs(spark, a=chain(12), b=NESTED, c=chain(40), d=chain(3))).orderBy("source", "seq").collect()
    for name, depth in (("a", 12), ("c", 40), ("d", 3)):
        own = [r for r in rows if r.source == name]
        assert [r.value for r in own] == flat_chain(depth) and [r.seq for r in own] == list(range(len(own)))
    assert [r.path for r in rows if r.source == "c" and r.value == "40"] == [["f", *[f"level {i}" for i in range(41)]]]
    assert len([r for r in rows if r.source == "b"]) == 6


def test_the_plan_does_not_grow_with_the_depth(spark):
    sizes = [len(facets.facet_options(docs(spark, a=chain(n)))._jdf.queryExecution().optimizedPlan().toString().splitlines()) for n in (10, 30)]
    assert sizes[0] == sizes[1]


def test_seventy_facet_keys(spark):
    rows = [(i, f"k{k}", "v") for i in range(3) for k in range(70) if (i, k) != (1, 69)]
    members = spark.createDataFrame(rows, "id int, facet_key string, value string")
    kept = facets.apply_facets(members, {f"k{k}": ["v", "w"] for k in range(70)}, "id")
    assert sorted(r.id for r in kept.collect()) == [0, 2]


def search(spark, payload, *queries, **options):
    found = facets.search_options(facets.facet_options(docs(spark, a=payload), 4), list(queries), **options)
    return [(r.query, r["rank"], r.value, r.score) for r in found.orderBy("query", "rank").collect()]


def test_country_query_takes_country_labels_only(spark):
    assert search(spark, NESTED, "US", location_only=True) == [("US", 1, "US_ID", 120.123)]
    assert search(spark, CITIES, "US") == []


def test_city_and_state_queries(spark):
    assert search(spark, CITIES, "Boston", location_only=True) == [("Boston", 1, "BOS_ID", 90.005)]
    assert search(spark, CITIES, "nc")[0][2:] == ("RTP_ID", 80.008)
    assert search(spark, CITIES, "  ") == []


def test_strict_scores_keep_bare_bonuses(spark):
    assert search(spark, CITIES, "zzz") == []
    assert search(spark, CITIES, "zzz", strict=True) == [("zzz", 1, "RTP_ID", 0.008), ("zzz", 2, "BOS_ID", 0.005)]
    assert search(spark, NESTED, "US", strict=True)[-1][2:] == ("c", 23.0)


def test_limit_and_keys(spark):
    assert [r[2] for r in search(spark, NESTED, "a", limit=2)] == ["c", "US_ID"]
    assert search(spark, NESTED, "canada", facet_keys={"locations"}) == []


def test_resolution_merges_queries(spark):
    options = facets.facet_options(docs(spark, a=NESTED, b=CITIES), 4)
    rows = facets.resolve_locations(options, ["Boston", "US", "Deep"]).orderBy("source", "ord").collect()
    assert [(r.source, r.value) for r in rows] == [("a", "B"), ("a", "US_ID"), ("a", "7"), ("b", "BOS_ID")]
    found = facets.search_options(options, ["Boston", "US"])
    missing = facets.unresolved_queries(options.select("source").distinct(), found, ["Boston", "US"]).collect()
    assert [tuple(r) for r in missing] == [("b", "US")]


def test_merge_maps(spark):
    a = F.create_map(F.lit("locations"), F.array(F.lit("A")))
    b = F.create_map(F.lit("locations"), F.array(F.lit("A"), F.lit("B")), F.lit("x"), F.array(F.lit("y"), F.lit("y")))
    row = spark.range(1).select(
        facets.merge_facet_maps(a, F.lit(None).cast("map<string,array<string>>"), b).alias("m"), facets.merge_facet_maps().alias("e")
    ).first()
    assert row.m == {"locations": ["A", "B"], "x": ["y"]} and row.e == {}


def test_applied_facets(spark):
    rows = [(1, "k", "a"), (1, "j", "x"), (2, "k", "b"), (2, "k", "a"), (3, "j", "x"), (3, "k", "c")]
    members = spark.createDataFrame(rows, "id int, facet_key string, value string")
    ids = lambda chosen: sorted(r.id for r in facets.apply_facets(members, chosen, "id").collect())
    assert ids({"k": ["a", "b"]}) == [1, 2]
    assert ids({"k": ["a", "c"], "j": ["x"]}) == [1, 3]
    assert ids({}) == ids({"k": []}) == [1, 2, 3]
