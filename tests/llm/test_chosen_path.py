"""The chosen-path join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecast.llm import chosen_path, linking
from tests.llm.cases import ODD, fold, frame


def plain_set(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            if top(i) != top(j) and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                label[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, len(sets[i]), least.get(top(i)), doc == least.get(top(i))) for i, (doc, _) in enumerate(rows)]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def edited(base, share, rng):
    out = base.copy()
    size = max(1, int(len(out) * share))
    at = rng.randrange(len(out) - size + 1)
    out[at : at + size] = [f"x{rng.randrange(10**9)}" for _ in range(size)]
    return out


def test_odd_rows(spark):
    got = chosen_path.near_duplicates(frame(spark)).collect()
    assert order(got) == order(plain_components(ODD))


def test_empty_tables(spark):
    assert chosen_path.near_duplicates(frame(spark).where("false")).count() == 0
    only = [(3, None), (None, None), (4, "")]
    assert order(chosen_path.near_duplicates(frame(spark, only)).collect()) == order([(3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)])


def test_words_in_a_row_that_are_fewer_than_a_shingle(spark):
    rows = [(1, "one two"), (2, "ONE  two"), (3, "two one"), (4, "one two three"), (5, "one two three four")]
    assert order(chosen_path.near_duplicates(frame(spark, rows)).collect()) == order(plain_components(rows))


@pytest.mark.parametrize("small", [12, 4096])
def test_links_of_edited_copies(spark, small):
    rng = random.Random(small)
    rows = []
    for g in range(160):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 500]))]
        rows += [(100 * g, " ".join(base)), (100 * g + 1, " ".join(edited(base, rng.uniform(0.02, 0.16), rng)))]
    chain = [f"c{i}" for i in range(100)]
    for i in range(40):  # each is near the one before it only
        rows.append((50_000 + i, " ".join(chain)))
        chain = chain[5:] + [f"d{i}-{k}" for k in range(5)]
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [(60_000 + i, passage + " " + " ".join(f"own{i}-{k}" for k in range(rng.choice([20, 60, 200])))) for i in range(60)]
    got = chosen_path.near_duplicates(frame(spark, rows), small=small, levels=3).collect()
    assert order(got) == order(plain_components(rows))


def test_recall_at_the_least_similarity(spark):
    """100 words, 11 replaced in a row: 83 of 111 shingles and less; 8 replaced: 86 of 108, just below 0.8; 7: 87 of 107."""
    rng = random.Random(4)
    rows = []
    for g in range(1500):
        base = [f"w{rng.randrange(10**7)}" for _ in range(100)]
        other = base.copy()
        at, size = rng.randrange(4, 85), 7 + g % 2
        other[at : at + size] = [f"x{rng.randrange(10**9)}" for _ in range(size)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(frame(spark, rows)).collect()}
    want = {doc: low for doc, _, low, _ in plain_components(rows)}
    near = [d for d in want if want[d] != d]
    assert len(near) >= 700
    assert all(want[d] == got[d] for d in want if want[d] == d)  # none below is linked
    assert sum(got[d] == want[d] for d in near) >= 0.998 * len(near)


@pytest.mark.parametrize("share", [0.03, 0.13])
def test_a_group_that_is_larger_than_a_node(spark, share):
    """Near copies, or texts that are just too far from each other: the trees part them, the blocks take the rest."""
    rng = random.Random(share)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(base, share, rng))) for i in range(300)]
    got = chosen_path.near_duplicates(frame(spark, rows, False), small=64, levels=3).collect()
    same = sum(a == b for a, b in zip(order(got), order(plain_components(rows)), strict=True))
    assert same >= 0.97 * 300


def test_no_pair_of_a_block_is_left_out(spark):
    rows = [(p, i, i, 300, 0) for p in (1, 2) for i in range(300)]
    large = spark.createDataFrame(rows, "path long, id long, root long, n long, head long")
    nodes = linking.all_blocks(large, 32)
    assert nodes.groupBy("node").count().agg(F.max("count")).first()[0] <= 32 + 24
    met = nodes.alias("x").join(nodes.alias("y"), "node").where("x.id < y.id").select("x.id", F.col("y.id").alias("o")).distinct()
    assert met.count() == 300 * 299 // 2


def test_tokens_estimate_the_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 1000, np.uint64)
    agree = []
    for _ in range(30):
        b = np.concatenate([a[:889], rng.integers(0, 2**64, 111, np.uint64)])  # 889 / 1111
        rng.shuffle(a)
        agree.append((chosen_path.minwise(a) == chosen_path.minwise(np.concatenate([a[:889], b[889:]]))).mean())
    assert abs(np.mean(agree) - 889 / 1111) < 0.03
    assert chosen_path.trees(0.8) <= 8
