"""Scores and hits against a direct regex reading of the rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from rolecast.functions import forms
from rolecast.operators import profiles, ranking
from rolecast.operators.ranking import LITERAL, LOOSE, STRICT, RankRules
from rolecast.plans.older import rank_older
from rolecast.sources import presets


def jobs(spark, *rows):
    data = [(i, t, d, f"https://x/{i}") for i, (t, d) in enumerate(rows)]
    return spark.createDataFrame(data, "ingest_seq bigint, title string, description_text string, url string")


def default(spark):
    return profiles.preset_tables(spark)


def titles(ranked):
    return [r.title for r in ranked.orderBy(F.desc("score"), "ingest_seq").collect()]


def test_prefers_quality_automation(spark):
    ranked = ranking.rank(
        jobs(spark, ("ASIC Physical Design Engineer", "semiconductor timing constraints"),
             ("Senior Software Development Engineer in Test", "Python Linux test automation validation")),
        default(spark),
    )
    assert titles(ranked)[0].startswith("Senior")


def test_phrase_variants_hit(spark):
    row = ranking.rank(jobs(spark, ("Solutions Engineer", "customer facing Linux troubleshooting and networking")), default(spark)).first()
    assert row.score > 5
    assert {"customer-facing(+2.0)", "customer facing(+2.0)", "solutions engineer(+3.2)"} <= set(row.matches.core)


def test_new_negative_term(spark):
    tables = profiles.override_weights(default(spark), {"Cryptocurrency": -5})
    rows = ranking.rank(
        jobs(spark, ("Quality Automation Engineer", "python linux"), ("Quality Automation Engineer", "python linux cryptocurrency")), tables
    ).orderBy("ingest_seq").collect()
    assert rows[0].score > rows[1].score and rows[1].matches.neg == ["cryptocurrency(-5.0)"]


def test_profile_files(spark, tmp_path):
    body = {"name": "surveying-legal-property", "core_plus": {"surveying": 4, "zoning": 3.5}, "nice": {"permitting": "1.5"}, "light_neg": {"intern": -2}}
    (tmp_path / "p.json").write_text(json.dumps(body, indent=1), encoding="utf-8")
    tables = profiles.parse_profiles(profiles.read_profiles(spark, str(tmp_path / "p.json")))
    ranked = ranking.rank(
        jobs(spark, ("Software Engineer", "generic product engineering"), ("Zoning Platform QA Engineer", "surveying permitting workflows")), tables
    )
    best = ranked.orderBy(F.desc("score")).first()
    assert best.title == "Zoning Platform QA Engineer"
    assert best.notes == "profile='surveying-legal-property' title='Zoning Platform QA Engineer' url='https://x/1'"
    assert best.matches.core == ["zoning(+4.7)", "surveying(+4.0)", "zoning(+3.5)"]


@pytest.mark.parametrize(
    "body,fault",
    [("[]", "must be an object"), ('{"nice": 3}', "nice must be"), ('{"nice": {" ": 1}}', "blank"), ('{"nice": {"a": "b"}}', "non-numeric"),
     ('{"nice": {"a": null}}', "non-numeric"), ('{"title_boost": "x"}', "not a number"), ("{", "must be an object")],
)
def test_profile_faults(spark, body, fault):
    files = spark.createDataFrame([("f", body)], "path string, text string")
    with pytest.raises(ValueError, match=fault):
        profiles.parse_profiles(files)


def test_folded_repeats_take_the_last_weight_at_the_first_place(spark):
    files = spark.createDataFrame([("f", '{"core_plus": {"B": 1, "a": 2, "b": 3}}')], "path string, text string")
    tables = profiles.parse_profiles(files)
    assert [(r.term, r.weight) for r in tables.terms.orderBy("ord").collect()] == [("b", 3.0), ("a", 2.0)]
    assert tuple(tables.profiles.first()) == ("custom", 1.35, 1.25, 900.0)


def test_overrides_keep_buckets(spark):
    tables = profiles.profile_tables(spark, {"p": ({"x": 1.0}, {"x": 2.0, "y": 3.0}, {"z": -1.0}, 1, 1, 1)})
    changed = profiles.override_weights(tables, {"X": 9, "z": 5, "new": 0.5, "bad": -1})
    rows = sorted((r.bucket, r.term, r.weight) for r in changed.terms.collect())
    assert rows == [("core", "x", 9.0), ("neg", "bad", -1.0), ("neg", "z", 5.0), ("nice", "new", 0.5), ("nice", "x", 2.0), ("nice", "y", 3.0)]
    older = profiles.override_weights(tables, {"bad": -1}, new_bucket="nice").terms.where("term = 'bad'").first()
    assert older.bucket == "nice" and tables.terms.count() == 4


def test_weight_texts_round_trip(spark):
    tables = profiles.preset_tables(spark, presets.PROPERTY_PROFILE)
    texts = {r.bucket: r.weights for r in profiles.weight_texts(tables.terms).collect()}
    assert texts["core"].startswith("surveying = 4\nzoning = 3.5") and "real estate = 1.5" in texts["nice"]
    form = spark.createDataFrame([("p", texts["core"], texts["nice"], "sales", 1.5, 2.0, 1000.0)],
                                 "profile string, core string, nice string, neg string, title_boost double, length_cap double, length_divisor double")
    back, errors = profiles.profiles_from_texts(form)
    kept = tables.terms.where("bucket <> 'neg'").select("bucket", "term", "weight")
    assert sorted(map(tuple, back.terms.select("bucket", "term", "weight").collect())) == sorted(map(tuple, kept.collect()))
    assert [tuple(e) for e in errors.collect()] == [("p", "neg", 1, "must look like term = weight")]


def test_preset_sizes(spark):
    counts = {(r.profile, r.bucket): r["count"] for r in profiles.preset_tables(spark, *presets.PRESETS).terms.groupBy("profile", "bucket").count().collect()}
    assert [counts[presets.DEFAULT_PROFILE, b] for b in profiles.BUCKETS] == [90, 27, 33]
    assert [counts[presets.PROPERTY_PROFILE, b] for b in profiles.BUCKETS] == [5, 3, 2]
    assert [counts[presets.OLDER_PROFILE, b] for b in profiles.BUCKETS] == [36, 17, 10]
    assert "c " in presets.OLDER_NICE


SEPARATORS = {
    LOOSE: lambda t: r"[\s\-/]+".join(re.escape(p) for p in re.split(r"[ \-/]+", t)),
    LITERAL: re.escape,
    # a blank asks for separators, a slash and closing brackets; a hyphen for separators
    STRICT: lambda t: "".join({" ": r"[\s\[\-/]+/\]+", "-": r"[\s\-/]+"}.get(c, re.escape(c)) for c in t),
}
TERMS = ["c++", "c/c++", "red hat", "customer-facing", "integration & test", "épython", "python", "***", "ci/cd", "a_b", "ß", "x-y z", "c "]


def brute(title, description, tables, boost, cap, divisor, separators):
    title, body = title.casefold(), description.casefold()
    both, score, hits = f"{title}\n{body}", 0.0, {}
    for bucket, table in zip(profiles.BUCKETS, tables):
        hits[bucket] = []
        for text, factor in ((title, boost), (both, 1.0)):
            if bucket == "neg" and text is title:
                continue
            for term, weight in table.items():
                term = term.casefold()
                if re.search(rf"(?<!\w){SEPARATORS[separators](term)}(?!\w)", text):
                    score += weight * factor
                    hits[bucket].append(f"{term}({weight * factor:+.1f})")
    return score + min(len(body) / divisor, cap), hits


@pytest.mark.parametrize("separators,inline", [(LOOSE, 100), (LOOSE, 0), (LITERAL, 100), (STRICT, 100), (STRICT, 0)])
def test_both_paths_equal_the_regex_definition(spark, separators, inline):
    random.seed(11)
    pool = ["c++", "c", "/", " ", "-", "red", "hat", "customer", "facing", "integration", "&", "test", "épython", "python", "***", "\n",
            "ci", "cd", "a_b", "Straße", "ß", "x", "y", "z", "+", "]", "/]", " ", "½", ". "]
    rows = [("".join(random.choices(pool, k=5)), "".join(random.choices(pool, k=40))) for _ in range(150)]
    spec = ({t: 1.1 + i for i, t in enumerate(TERMS[:6])}, {t: 0.3 * (i + 1) for i, t in enumerate(TERMS[6:])}, {"red hat": -2.0, "z": -0.7})
    tables = profiles.profile_tables(spark, {"p": (*spec, 1.35, 1.25, 900.0), "q": ({"x": 1.0}, {}, {}, 2.0, 0.1, 7.0)})
    ranked = ranking.rank(jobs(spark, *rows), tables, RankRules(separators=separators, digits=None), inline_terms=inline)
    got = {(r.ingest_seq, r.profile): (r.score, r.matches.asDict()) for r in ranked.collect()}
    assert len(got) == 300
    for i, (title, description) in enumerate(rows):
        for name, args in (("p", (spec, 1.35, 1.25, 900.0)), ("q", (({"x": 1.0}, {}, {}), 2.0, 0.1, 7.0))):
            score, hits = brute(title, description, *args, separators)
            assert got[i, name][0] == pytest.approx(score, abs=1e-9) and got[i, name][1] == hits, (title, description)


def test_older_ranking(spark):
    records = jobs(spark, ("None of C here", None), ("linux kernel", "linux/kernel c , x")).withColumnRenamed("description_text", "digest")
    tables = profiles.preset_tables(spark, presets.OLDER_PROFILE)
    rows = rank_older(records, tables, {"None": -1.0}).orderBy("ingest_seq").collect()
    # a missing digest is scored as the word None
    assert rows[0].score == pytest.approx(-1.0 * 1.5 - 1.0 + 4 / 800)
    assert rows[0].matches.nice == ["none(-1.5)", "none(-1.0)"]
    assert rows[1].matches.core == ["linux(+3.0)", "linux(+2.0)"]
    assert rows[1].matches.nice == ["linux kernel(+1.5)", "c (+0.4)", "linux kernel(+1.0)"]
    assert rows[0].notes == "title='None of C here...' url='https://x/0'"


def test_ties_keep_scan_order_and_top_per_profile(spark):
    tables = profiles.profile_tables(spark, {"p": ({"a": 1.0}, {}, {}, 1, 0, 1), "q": ({"b": 1.0}, {}, {}, 1, 0, 1)})
    ranked = ranking.rank(jobs(spark, ("x", ""), ("a", ""), ("b", ""), ("a", "")), tables)
    assert [r.ingest_seq for r in ranking.top(ranked.where("profile = 'p'"), 3).collect()] == [1, 3, 0]
    best = ranking.top_by_profile(ranked, 2).orderBy("profile", "rank").collect()
    assert [(r.profile, r.ingest_seq) for r in best] == [("p", 1), ("p", 3), ("q", 2), ("q", 0)]


def test_the_first_weight_of_a_new_term_places_it(spark):
    tables = profiles.override_weights(profiles.profile_tables(spark, {"p": ({"a": 1.0}, {}, {}, 1.0, 1.0, 1.0)}), {"Foo": -1, "foo": 2, "A": 3})
    got = sorted((r.bucket, r.term, r.weight) for r in tables.terms.collect())
    assert got == [("core", "a", 3.0), ("neg", "foo", 2.0)]


@pytest.mark.parametrize(
    ("text", "value"),
    [("2", 2.0), (" -1.5e2 ", -150.0), ("+.5", 0.5), ("1_000", 1000.0), ("1.", 1.0), ("inf", float("inf"))]
    + [(t, None) for t in ("2d", "1.5f", "0x1p3", "", "1__0", "_1", "1e", "true", "--1", "1 2")],
)
def test_numbers_follow_the_decimal_grammar(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(forms.number(F.col("t"))).first()[0] == value


def test_both_ways_of_ranking_agree_bit_by_bit(spark):
    """Rows that share a number, many terms, unrounded scores."""
    random.seed(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i // 2, " ".join(random.choices(words, k=4)), " ".join(random.choices(words, k=80)), f"u{i}") for i in range(80)]
    terms = {f"{random.choice(words)} {random.choice(words)}": random.random() for _ in range(300)}
    terms |= {w: random.random() * 3 for w in words}
    tables = profiles.profile_tables(spark, {"p": (terms, {"w1 w2": 0.1}, {"w3": -0.7}, 1.3, 1.0, 900.0), "q": ({"w5": 0.1}, {}, {}, 1.0, 1.0, 1.0)})
    posts = spark.createDataFrame(rows, "ingest_seq bigint, title string, description_text string, url string")
    rules = ranking.RankRules(digits=None)
    one, two = (
        sorted(tuple(r) for r in ranking.rank(posts, tables, rules, inline_terms=n).select("url", "profile", "score", "matches.core", "matches.neg").collect())
        for n in (5000, 0)
    )
    assert one == two
