"""Ranked search and hard negatives against plain versions."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecast.llm import hard_negatives, ranked_search
from tests.llm.cases import ODD, fold, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(fold(text))


def plain_search(rows, items, k=10):
    docs = [(i, Counter(plain_terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    number, length = len(docs), sum(sum(c.values()) for _, c in docs)
    holding = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * number // length
            score = 0
            for t in plain_terms(text):
                if t in c:
                    w = floor(1000 * log((2 * number + 2) / (2 * holding[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("shard", [3, 16_384])
def test_ranked_search_of_odd_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked_search, "FIRST_READ", 2)
    items = [
        (1, "a repeated ROW and document 3"), (2, None), (3, ""), (4, "unheard of"), (5, "line line line more"),
        (None, "no id at all"), (7, "The same text, met many times over."), (7, "alpha"), (8, "Straße 中文 été"),
    ]
    got = ranked_search.search(frame(spark), asked(spark, items)).collect()
    assert order(got) == order(plain_search(ODD, items))


@pytest.mark.parametrize("first", [1, 16])
def test_ranked_search_reads_until_all_is_resolved(spark, monkeypatch, first):
    monkeypatch.setattr(ranked_search, "FIRST_READ", first)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 4)
    random.seed(first)
    words = [f"w{int(random.paretovariate(0.7)) % 80}" for _ in range(4000)]
    rows = [(i, " ".join(random.choices(words, k=random.choice([1, 3, 20, 200])))) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # ties, by id
    items = [(i, " ".join(random.choices(words, k=random.choice([1, 2, 9, 60])))) for i in range(11)]
    got = ranked_search.search(frame(spark, rows), asked(spark, items)).collect()
    assert order(got) == order(plain_search(rows, items))


def test_ranked_search_stops_early_when_the_rest_is_below():
    # one list: after the first read all that follows is lower, and every score met is exact
    n = 50_000
    lists = ranked_search.ImpactLists(np.zeros(n, np.int64), np.arange(n), np.arange(n) + 1, 1, n)

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.read += at.stop - at.start
            return super().__getitem__(at)

    lists.doc = lists.doc.view(Counted)
    found, score = lists.best(np.array([0]), np.array([3]), np.arange(n), 10)
    assert found.tolist() == list(range(n - 1, n - 11, -1)) and score[0] == 3 * n
    assert Counted.read <= 2 * ranked_search.FIRST_READ


def test_empty_searches(spark):
    none = frame(spark).where("false")
    item = asked(spark, [(1, "word")])
    assert ranked_search.search(none, item).count() == 0
    assert ranked_search.search(frame(spark), item.where("false")).count() == 0


# --- hard negatives -----------------------------------------------------------------


def plain_mine(rows, anchors, positives=5, negatives=10):
    usable = {}
    for i, label, v in sorted(((i, lb, v) for i, lb, v in rows if None not in (i, lb, v)), key=lambda r: (r[0], r[1])):
        if all(x is not None and np.isfinite(x) for x in v):
            usable.setdefault(i, (label, [floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a in sorted(i for i in usable if anchors(i)):
        label, v = usable[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, lb) for i, (lb, w) in usable.items() if i != a)
        for p, pid in [(-s, i) for s, i, lb in scores if lb == label][:positives]:
            fit = [(i, -s) for s, i, lb in scores if lb != label and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(a, pid, n + 1, i, p, s) for n, (i, s) in enumerate(fit)]
    return sorted(out)


SHAPE = "vec_id long, embedding array<float>, label int, tile string, part string, v string, slab string, cuts string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "t", "p", "v", "s", "c") for i, label, v in rows], SHAPE)


@pytest.mark.parametrize(("limit", "block"), [(40, 3), (4096, 2048)])
def test_hard_negatives_equal_all_pairs(spark, limit, block):
    random.seed(limit)
    rows = [(i, random.randrange(3), [random.gauss(0.1 * (i % 5), 0.3) for _ in range(12)]) for i in range(500)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(300)]  # one vector that very many rows share
    rows += [(2000 + i, i % 2, [0.0] * 12) for i in range(20)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0, block=block, limit=limit)
    want = plain_mine(rows, lambda i: i % 50 == 0)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.0]), (3, 2, [0.5, 0.0]), (4, None, [1.0, 1.0]), (5, 1, None),
        (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (None, 2, [0.5, 0.5]), (9, 2, []), (10, 2, [0.6]),
        (11, 1, [0.5, 0.0, 0.7]), (11, 2, [0.4, 0.0]), (12, 2, [-0.5, 0.0]), (100, 5, [0.3, 0.3]),
    ]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    want = plain_mine(rows, lambda i: i % 100 == 0)
    assert want and sorted(map(tuple, got.collect())) == want
    assert hard_negatives.mine(vectors(spark, rows).where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_hard_negatives_of_very_large_numbers(spark):
    rows = [(i, i % 2, [1e5 * (i + 1), 3e4 * (i % 7), -2e3 * i]) for i in range(60)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == plain_mine(rows, lambda i: i % 20 == 0)


def test_boxes_that_miss_the_window_are_not_opened():
    ids, labels = np.arange(640), np.zeros(640, np.int64)
    points = np.repeat(np.arange(10), 64)[:, None] * np.array([[10, 0]])
    tree = hard_negatives.Tree(ids, labels, points, True)
    opened = []
    tree.points = [type("Seen", (), {"T": property(lambda s, p=p, n=n: opened.append(n) or p.T)})() for n, p in enumerate(tree.points)]
    at, found, score = tree.best(np.array([[1, 0]]), np.array([-1]), np.array([1]), False, np.array([45]), np.array([75]), 10)
    assert len(found) == 10 and set(score) == {70} and sorted(found) == list(range(448, 458))
    assert len(opened) <= 2  # 70 is the best box in the window; 60 is strictly below the k-th
