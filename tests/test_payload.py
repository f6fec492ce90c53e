import json

from pyspark.sql import functions as F

from rolecast.functions import forms, payload, places
from rolecast.functions.sql import bind
from rolecast.operators import filters


def evaluate(spark, value, *columns):
    df = spark.createDataFrame([(json.dumps(value),)], "j string").select(F.parse_json("j").alias("v"))
    return tuple(df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_fallback_chain_skips_falsy(spark):
    chain = payload.first_text("v", "$.a", "$.b", "$.c")
    for falsy in (None, "", 0, 0.0, False, [], {}):
        assert evaluate(spark, {"a": falsy, "b": "x"}, chain) == ("x",)
    assert evaluate(spark, {"a": "0", "b": "x"}, chain) == ("0",)
    assert evaluate(spark, {"a": True}, chain) == ("True",)
    assert evaluate(spark, {"c": 12}, chain) == ("12",)
    assert evaluate(spark, {}, chain) == ("",)


def test_whole_json_only(spark):
    df = spark.createDataFrame([("{}",), ("{}{",), ("[1],[2]",), ("",), ("{",), (None,), (" {} ",)], "t string")
    got = [r.x is not None for r in df.select(F.expr(payload.parse_whole("t")).alias("x")).collect()]
    assert got == [True, False, False, False, False, False, True]


def test_place_and_posted(spark):
    place, posted = payload.place_text("v"), payload.posted_text("v")
    subtitles = [{"label": "Loc", "value": "n"}, "x", {"label": "Locations", "value": ""}, {"label": "LOCATION", "value": "Here"}]
    assert evaluate(spark, {"locationsText": "T", "subtitles": subtitles}, place) == ("T",)
    assert evaluate(spark, {"locationsText": "", "subtitles": subtitles}, place) == ("Here",)
    named = [{"descriptor": "A"}, {"descriptor": None}, 3, {"descriptor": "B"}]
    assert evaluate(spark, {"locations": named}, place, posted) == ("A, B", "")
    blank = [{"label": "Date Posted", "value": None}]
    assert evaluate(spark, {"subtitles": blank, "postedOn": "x"}, posted) == ("",)
    assert evaluate(spark, {"subtitles": [], "postedOn": "x"}, posted) == ("x",)


def test_posted_date(spark):
    cases = {1700000000: "2023-11-14", 1700000000000: "2023-11-14", "1700000000": "2023-11-14", "2024-01-02T10": "2024-01-02",
             True: "1970-01-01", False: "1970-01-01", 1e300: "", -5: "1969-12-31", "Posted today": "Posted ", "": "", "x": "x"}
    cases["Posted today"] = "Posted today"
    for raw, expected in cases.items():
        assert evaluate(spark, {"t": raw}, bind(payload.field("v", "$.t"), payload.posted_date)) == (expected,), raw
    assert evaluate(spark, {"t": None}, payload.posted_date(payload.field("v", "$.t"))) == ("",)


def test_description_at_any_depth(spark):
    deep = {"description": "found"}
    for key in ("details", "data", "job", "position") * 2:
        deep = {key: deep}
    found = payload.nested_description("v")
    assert evaluate(spark, deep, found) == ("found",)
    assert evaluate(spark, {"description": " ", "custom_JD": {"data_fields": {"description_html": "c"}}}, found) == ("c",)
    assert evaluate(spark, {"job": {"x": 1}, "data": {"description": "d"}}, found) == ("d",)
    assert evaluate(spark, {"other": {"description": "d"}}, found) == ("",)
    both = {"data": {"description": "late"}, "job": {"details": {"job": {"description": "early"}}}}
    assert evaluate(spark, both, found) == ("early",)
    assert evaluate(spark, {"custom_JD": ["data_fields"], "job": [{"description": "no"}]}, found) == ("",)


def test_alternate_listing(spark):
    items, total = payload.alternate_items("v"), payload.alternate_total("v")
    size = f"size({items})"
    assert evaluate(spark, {"positions": [], "records": [{"a": 1}, 2], "count": 0, "total": "9"}, size, total) == (1, 9)
    assert evaluate(spark, {"jobs": [{}, {}]}, size, total) == (2, 2)
    assert evaluate(spark, {"jobs": "x", "count": "n"}, size, total) == (0, None)


def _words(value):
    """Independent walk over plain Python data."""
    hints = ("location", "address", "city", "state", "country", "descriptor")
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, list):
        return [w for v in value for w in _words(v)]
    if isinstance(value, dict):
        return [w for k, v in value.items() if any(h in k.lower() for h in hints) or isinstance(v, (dict, list)) for w in _words(v)]
    return []


def test_location_words(spark):
    value = {
        "addressCountry": "FR", "b": {"cityName": "Paris, \"x\" \\ é", "note": "no", "tags": ["kept", " ", 5, None, ["in"]]},
        "state": {"code": "no", "x": [{"descriptor": "D", "value": "V:\"descriptor\":\"fake\""}]}, "zip": "no",
    }
    got = evaluate(spark, value, payload.location_words("v"))[0]
    assert sorted(got.split()) == sorted(" ".join(_words(value)).split())
    assert evaluate(spark, "plain", payload.location_words("v")) == ("plain",)
    assert evaluate(spark, ["a", {"descriptor": "b"}, {"value": "c"}], payload.location_words("v")) == ("a b",)


def test_json_ld(spark):
    tag = "<script type='application/ld+json'>{}</script>".format
    cases = [
        ('<SCRIPT async type="application/ld+json" x>\n {"title": "T &amp; U"} </script>', "T & U"),
        (tag('[{"@type": "X", "title": "x"}, {"@type": "JobPosting", "title": "j"}]'), "j"),
        (tag('[{"@type": "X", "title": "x"}, 3]'), "x"),
        (tag("[3]"), ""), (tag("{bad"), ""), (tag('{"title": "a"} x'), ""), ("none", ""),
        (tag('{"title": "first"}') + tag('{"title": "second"}'), "first"),
        (tag('{"@type": "Other", "title": "any type"}'), "any type"),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    block = df.select("i", payload.json_ld_block(F.col("h")).alias("b")).select("i", F.expr(payload.json_ld_posting("b")).alias("p"))
    got = [r.t for r in block.select("i", F.expr(payload.first_text("p", "$.title")).alias("t")).orderBy("i").collect()]
    assert got == [t for _, t in cases]


def test_forms(spark):
    row = spark.range(1).select(
        forms.term_list(F.lit(" a, b\n\n,c ")).alias("t"),
        forms.weight_lines(F.lit("a = 1, B=x\n\n=3\nfoo\nQ r = 2.5=1")).alias("w"),
        *[forms.weight_number(F.lit(x)).alias(f"n{i}") for i, x in enumerate([4.0, 3.5, 1234567.0, 0.00001234, -2.0, 0.0, 123456.7, 1e100])],
        *[forms.clamp_int(F.lit(x), 10).alias(f"i{i}") for i, x in enumerate(["900", "x", "0", "", None, "99999999999999999999", "-3", " 7 ", "1.5"])],
        *[forms.clamp_float(F.lit(x), 2.5).alias(f"f{i}") for i, x in enumerate(["-1", None, "x", "7.25", "1e9"])],
    ).first().asDict()
    assert row["t"] == ["a", "b", "c"]
    assert [tuple(w) for w in row["w"]] == [
        (1, "a", 1.0, None), (2, "b", None, "has a non-numeric weight"), (4, "", None, "has an empty term"),
        (5, "foo", None, "must look like term = weight"), (6, "q r", None, "has a non-numeric weight"),
    ]
    numbers = [4.0, 3.5, 1234567.0, 0.00001234, -2.0, 0.0, 123456.7, 1e100]
    assert [row[f"n{i}"] for i in range(8)] == [f"{n:g}" for n in numbers]
    assert [row[f"i{i}"] for i in range(9)] == [500, 10, 1, 10, 10, 500, 1, 7, 10]
    assert [row[f"f{i}"] for i in range(5)] == [0.0, 2.5, 2.5, 7.25, 10_000.0]


def test_aliases_and_country(spark):
    names = ["U.S.", "ma", "California", "ca", "Paris", " ", "England"]
    df = spark.createDataFrame([(n,) for n in names], "q string").select(
        "q", F.array_sort(places.aliases(F.col("q"))).alias("a"), places.is_country_query(F.col("q")).alias("c")
    )
    got = {r.q: (r.a, r.c) for r in df.collect()}
    assert got["U.S."] == (["america", "u s", "u s a", "united states", "united states of america", "us", "usa"], True)
    assert got["ma"] == (["ma", "massachusetts"], False)
    assert got["California"] == (["ca", "california"], False)
    assert got["ca"] == (["ca", "california", "canada"], True)
    assert got["Paris"] == (["paris"], False) and got[" "] == ([], False)
    assert got["England"][1] and "great britain" in got["England"][0]


def test_filters(spark):
    rows = [(1, "Senior R&D Engineer", "Austin, US", "{}"), (2, "Clerk", "", json.dumps({"locations": [{"descriptor": "Germany"}]})),
            (3, "Intern", "", "{}"), (4, "Pilot", "Bus station", "{}")]
    df = spark.createDataFrame(rows, "ingest_seq int, title string, location string, s string").select(
        "ingest_seq", "title", "location", F.parse_json("s").alias("raw_summary"), F.parse_json(F.lit("{}")).alias("raw_json_ld")
    )
    ids = lambda d: sorted(r.ingest_seq for r in d.collect())
    assert ids(filters.filter_by_title(df, ["r and d", "zzz"])) == [1]
    assert ids(filters.filter_by_title(df, ["&&"])) == []
    assert ids(filters.filter_by_title(df, ["--"])) == ids(filters.filter_by_title(df, [])) == [1, 2, 3, 4]
    assert ids(filters.filter_by_locations(df, ["US"])) == [1]
    assert ids(filters.filter_by_locations(df, ["MA"])) == [2]
    assert ids(filters.filter_by_locations(df, ["us", "station"])) == [1, 4]
    assert ids(filters.filter_by_locations(df, [" "])) == [1, 2, 3, 4]
    assert ids(filters.filter_by_both(df, ["ma"], ["e"])) == [2]
