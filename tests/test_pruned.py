"""Top-k by bounds, and phrases in the joined ranking, against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from rolecast.operators import profiles, pruned, ranking
from rolecast.operators.ranking import RankRules


def posts(spark, rows):
    return spark.createDataFrame(rows, "ingest_seq bigint, title string, description_text string, url string")


def plain_top(spark, rows, tables, k, rules=RankRules()):
    ranked = ranking.rank(posts(spark, rows), tables, rules).select("profile", "score", "ingest_seq", "url", "matches.core", "matches.neg").collect()
    out = []
    for name in {r.profile for r in ranked}:
        best = sorted((-r.score, r.ingest_seq, r.url, tuple(r.core), tuple(r.neg)) for r in ranked if r.profile == name)[:k]
        out += [(name, n + 1, -s, seq, url, core, neg) for n, (s, seq, url, core, neg) in enumerate(best)]
    return sorted(out)


def pruned_top(spark, rows, tables, k, rules=RankRules()):
    found = pruned.top_profiles(posts(spark, rows), tables, k, rules)
    got = found.best.select("profile", "rank", "score", "ingest_seq", "url", "matches.core", "matches.neg").collect()
    return sorted((r.profile, r["rank"], r.score, r.ingest_seq, r.url, tuple(r.core), tuple(r.neg)) for r in got), found.pairs


def made(seed, n, terms=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(terms)] + ["c++", "r-d", "a/b"]
    return [(i, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.choice([0, 5, 40, 300]))), f"u{i:04}") for i in range(n)]


@pytest.mark.parametrize("k", [1, 4, 30])
def test_best_of_every_profile(spark, k):
    rows = made(k, 120) + [(200, None, None, "none"), (201, "", "", "empty"), (202, "w1 w2", None, "half")]
    tables = profiles.profile_tables(
        spark,
        {
            "phrases": ({"w1 w2": 3.0, "c++": 1.0, "r-d": 0.5, "a b": 0.25}, {"w3": 0.5}, {"w4 / w5": -0.5}, 1.5, 1.0, 900.0),
            "all shunned": ({}, {}, {f"w{i}": -1.0 for i in range(40)}, 1.0, 1.25, 700.0),
            "nothing": ({"unheard": 1.0}, {}, {}, 1.0, 0.5, 50.0),
            "small bonus": ({"w7": 0.01}, {}, {}, 1.0, 0.001, 900.0),
        },
    )
    got, pairs = pruned_top(spark, rows, tables, k)
    assert got == plain_top(spark, rows, tables, k)
    assert pairs.count() == 4


def test_pairs_that_are_scored_stay_near_the_hits(spark):
    rows = made(5, 400, terms=400)
    spec = {f"p{i}": ({f"w{i}": 1.0, f"w{i} w{i + 1}": 2.0}, {}, {f"w{i + 2}": -0.5}, 1.2, 1.0, 900.0) for i in range(60)}
    tables = profiles.profile_tables(spark, spec)
    got, pairs = pruned_top(spark, rows, tables, 3)
    assert got == plain_top(spark, rows, tables, 3)
    total = pairs.agg(F.sum("hits"), F.sum("bonus")).first()
    assert total[1] <= 4 * (total[0] + 60 * 3)
    assert total[0] + total[1] < 0.5 * 400 * 60


def test_a_profile_with_better_hits_than_any_bonus_tries_no_other_posting(spark):
    rows = [(i, "w1" if i < 10 else "x", "y " * i, f"u{i}") for i in range(60)]
    tables = profiles.profile_tables(spark, {"p": ({"w1": 5.0}, {}, {}, 1.0, 1.0, 900.0)})
    got, pairs = pruned_top(spark, rows, tables, 4)
    assert got == plain_top(spark, rows, tables, 4)
    assert tuple(pairs.first()) == ("p", 10, 0)


def test_ties_of_a_capped_bonus_keep_scan_order(spark):
    rows = [(50 - i, "t", "word " * (100 + i), f"u{i:02}") for i in range(40)]
    tables = profiles.profile_tables(spark, {"p": ({"unheard": 1.0}, {}, {}, 1.0, 0.5, 10.0)})
    got, _ = pruned_top(spark, rows, tables, 5)
    assert [(r[1], r[3]) for r in got] == [(1, 11), (2, 12), (3, 13), (4, 14), (5, 15)]


def test_empty_tables(spark):
    none = profiles.profile_tables(spark, {"p": ({}, {}, {}, 1.0, 1.0, 900.0)})
    got, pairs = pruned_top(spark, made(1, 5), none, 2)
    assert got == plain_top(spark, made(1, 5), none, 2) and pairs.count() == 1
    assert pruned_top(spark, [], none, 2)[0] == []


@pytest.mark.parametrize("separators", [ranking.LOOSE, ranking.STRICT, ranking.LITERAL])
def test_phrases_meet_signs_and_separators_as_the_pattern_does(spark, separators):
    texts = [
        "customer-facing work", "customer / facing", "customer, facing", "customer  -/ facing", "a customer\nfacing b", "customerfacing",
        "facing customer", "c++ and c", "c++", "(c++)", "r&d r & d", "r d", "node.js node js", "x customer facing role y", "customer facing",
        "facing", "***", "* * *", "-lead", "the -lead", "customer_facing", "Straße strasse", "customer\x01facing", "customer . facing", "",
    ]
    rows = [(n, t, u, f"u{n}-{m}") for n, t in enumerate(texts) for m, u in enumerate(("", "customer", "facing, customer facing"))]
    terms = ["customer-facing", "customer facing", "customer/facing role", "c++", "c", "r&d", "r-d", "node.js", "***", "-lead", "lead", "strasse", "facing customer facing"]
    tables = profiles.profile_tables(spark, {"p": ({t: 1.0 + n / 8 for n, t in enumerate(terms)}, {"facing": 0.5}, {"customer": -0.25}, 1.5, 1.0, 900.0)})
    rules = RankRules(separators, digits=None)
    one, two = (
        sorted(tuple(r) for r in ranking.rank(posts(spark, rows), tables, rules, inline_terms=n).select("url", "score", "matches.core", "matches.neg").collect())
        for n in (5000, 0)
    )
    assert one == two
