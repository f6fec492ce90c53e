import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rolecast.llm import components, exact_dedup, line_dedup, simhash
from tests.llm.cases import COPY, ODD, fold, frame

BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_copies(spark, keep):
    found = exact_dedup.exact_duplicates(frame(spark), keep).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[fold(t)].append(i)
    best = max if keep == "largest" else min
    assert len(found) == len(ODD)
    for t, ids in groups.items():
        rows = [r for r in found if r.text_sha256 == sha(t)]
        known = [i for i in ids if i is not None]
        keep_id = best(known) if known else None
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        assert {(r.group_size, r.keep_id) for r in rows} == {(len(ids), keep_id)}
        assert sum(r.kept for r in rows) == 1
        assert all(r.doc_id == keep_id for r in rows if r.kept)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("more", [0, 5_000])
def test_null_ids_among_copies_keep_one_row(spark, keep, more):
    rows = [(None, "a copy"), (1, "A copy"), (2, "a copy"), (None, "alone"), (None, "alone")]
    rows += [(10 + i, "a copy" if i % 2 else f"text {i}") for i in range(more)]
    found = exact_dedup.exact_duplicates(frame(spark, rows, False), keep)
    kept = found.groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("n"))
    assert kept.where("n <> 1").isEmpty()
    last = max([2, *(i for i, t in rows if i and t == "a copy")])
    assert [r.doc_id for r in found.where("kept").where(F.col("text_sha256") == sha("a copy")).collect()] == [1 if keep == "smallest" else last]


def test_a_text_with_very_many_copies_is_split(spark):
    docs = frame(spark, [(i, COPY) for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(500)], False)
    dealt = exact_dedup.content_buckets(docs).where(F.col("doc_id") < 3000).groupBy("bucket").count().collect()
    assert len(dealt) > 4
    found = exact_dedup.exact_duplicates(docs, "largest").where(F.col("doc_id") < 3000)
    assert found.select("keep_id", "group_size").distinct().collect() == [(2999, 3000)]
    assert found.where("kept").count() == 1


def test_empty_tables(spark):
    none = frame(spark, []).where("false")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def plain_lines(rows, min_chars=20, min_docs=3):
    held, last = Counter(), {}
    for i, t in rows:
        for k in {fold(x).strip(BLANKS) for x in (t or "").split("\n")}:
            held[k] += 1
            last[k] = max(last.get(k, -1), -1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [fold(x).strip(BLANKS) for x in lines]
        gone = [len(k) >= min_chars and held[k] >= min_docs and last[k] != (-1 if i is None else i) for k in keys]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("batches", [1, 7])
def test_repeated_lines(spark, batches):
    found = line_dedup.drop_repeated_lines(frame(spark), batches=batches)
    got = found.select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_lines(ODD), key=repr)
    assert found.select("row.*").columns == frame(spark).columns


def test_line_runs_merge_level_by_level(spark):
    runs = line_dedup.LineRuns(fanout=2, min_docs=2)
    batch = lambda i: line_dedup.line_keys(frame(spark, [(i, f"a line that all of them have\nonly number {i} has this one")], False))
    fresh = [runs.append(batch(i)).count() for i in range(5)]
    assert fresh == [2, 2, 1, 1, 1]  # the common line is frequent from the third batch on
    assert sorted(r.docs for r in runs.compact().collect()) == [1, 1, 1, 1, 1, 5]


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    found = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    label = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= radius) for v in values]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return {i: ids[k] for i, k in zip(ids, label, strict=True)}
        label = new


@pytest.mark.parametrize(("radius", "limit"), [(2, 4096), (9, 12)])
def test_near_copies(spark, radius, limit):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, t in ODD if i not in (None, 6, 7, 9, 10)]
    for g in range(12):
        base = [random.choice(words) for _ in range(120)]
        for k in range(6):
            rows.append((1000 + 10 * g + k, " ".join(base)))
            base[random.randrange(120)] = random.choice(words)
    fps = {i: plain_fingerprint(t) for i, t in rows}
    found = simhash.near_duplicates(frame(spark, rows), radius=radius, limit=limit).collect()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == plain_components(fps, radius)


def test_odd_rows_are_fingerprinted(spark):
    found = simhash.near_duplicates(frame(spark))
    assert found.count() == len(ODD)
    assert {r.component_id for r in found.where("fp = 0").collect()} == {3}


def test_shards_lose_no_pair_within_the_radius():
    random.seed(3)
    for radius, agreeing in ((2, 1), (2, 2), (9, 2), (9, 3)):
        masks = simhash.block_masks(list(range(64)), radius, agreeing)
        for _ in range(300):
            a = random.getrandbits(64)
            b = a
            for bit in random.sample(range(64), radius):
                b ^= 1 << bit
            assert any((a & m % 2**64) == (b & m % 2**64) for m in masks)


def test_check_bits_part_what_the_radius_joins(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(500)]
    base = [random.choice(words) for _ in range(200)]
    edited = base.copy()
    edited[100] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(random.choice(words) for _ in range(200)))]
    loose = simhash.near_duplicates(frame(spark, rows), 2, 40).collect()
    assert {r.component_id for r in loose} == {1}
    sure = simhash.near_duplicates(frame(spark, rows), 2, 40, 5, 27).collect()
    assert {r.doc_id: r.component_id for r in sure} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize(("words", "radius"), [(1, 2), (1, 9), (2, 42), (3, 60)])
def test_trees_find_each_pair_of_a_shard_once(words, radius, monkeypatch):
    monkeypatch.setattr(simhash, "VISITS", 500)
    rng = np.random.default_rng(radius)
    shard = np.sort(rng.integers(-5, 30, 700))
    fps = rng.integers(0, 2**64, (700, words), np.uint64, endpoint=False)
    fps[1::2] = fps[::2] ^ (fps[1::2] & rng.integers(0, 2**64, (350, words), np.uint64) & rng.integers(0, 2**64, (350, words), np.uint64))
    fps[4::9] = fps[3::9][: len(fps[4::9])]  # and equal ones
    differ = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=np.int64)
    a, b = np.nonzero((differ <= radius) & (shard[:, None] == shard[None]))
    trees = simhash.ShardTrees(shard, *(np.ascontiguousarray(fps[:, i]) for i in range(words)))
    got = [p for q, node in trees.within(radius) for p in zip(q.tolist(), node.tolist(), strict=True)]
    assert sorted(got) == sorted((x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x > y)
    assert len(got) > 20
    none = np.zeros(0, np.int64)
    assert list(simhash.ShardTrees(none, none.view(np.uint64)).within(radius)) == []


def test_like_copies_are_found_by_the_trees(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:100], "other", *words[101:]])), (3, " ".join(words).upper())]
    classes = lambda: len({r.component for r in simhash.like_copies(frame(spark, rows)).collect()})
    assert classes() == 1
    monkeypatch.setattr(simhash.ShardTrees, "within", lambda self, radius: iter(()))
    assert classes() == 2  # without them only what has the same set is one
    monkeypatch.undo()
    assert classes() == 1


def near_pairs(rows, least=0.8):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    near = lambda a, b: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    return {(a, b) for a in ids for b in ids if a < b and a // 10 == b // 10 and near(a, b)}


@pytest.mark.parametrize("kind", ["block", "scattered"])
def test_near_copies_by_their_similarity(spark, kind):
    random.seed(11)
    rows = []
    for g in range(150):
        base = [f"w{random.randrange(10**6)}" for _ in range(random.choice([60, 200, 400]))]
        n = len(base)
        edited = base.copy()
        if kind == "block":  # from 0.85 down to below 0.8
            size = int(n * random.uniform(0.07, 0.125))
            at = random.randrange(n - size)
            edited[at : at + size] = [f"x{random.randrange(10**6)}" for _ in range(size)]
        else:
            for _ in range(max(1, round(n * random.uniform(0.016, 0.024)))):
                edited[random.randrange(n)] = f"x{random.randrange(10**6)}"
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(edited))]
    wanted = near_pairs(rows)
    assert 30 < len(wanted) < 140
    found = {}
    for r in simhash.like_copies(frame(spark, rows)).collect():
        found.setdefault(r.component, []).append(r.doc_id)
    assert {tuple(sorted(g)) for g in found.values() if len(g) > 1} == wanted


def test_like_copies_of_odd_rows(spark):
    docs = frame(spark)
    found = simhash.like_copies(docs)
    assert found.count() == len(ODD)
    assert simhash.one_of_each(docs, found).where("text = '' or text is null").count() <= 1
    assert simhash.like_copies(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    groups = plain_components({n: plain_fingerprint(t) for n, (i, t) in enumerate(ODD)}, 2)
    assert kept.count() == len(set(groups.values()))


def test_components_of_any_graph(spark):
    random.seed(7)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    root = {n: n for p in pairs for n in p}
    for _ in range(300):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {n: root[n] for n in linked}
    assert len(found) == len(linked)


def test_comparisons_of_one_group_are_made_in_tasks(spark):
    """A group of texts that are pairwise a little below 0.8: no row for each pair, and no link."""
    from rolecast.llm import linking

    made = []
    for n in (100, 400):
        random.seed(n)
        base = [f"w{i}" for i in range(200)]
        rows = []
        for i in range(n):
            words = base.copy()
            at = random.randrange(185)
            words[at : at + 14] = [f"x{i}-{k}" for k in range(14)]
            rows.append((i, " ".join(words)))
        found = simhash.like_copies(frame(spark, rows, False), small=64)
        want = near_components(rows)
        got = {r.doc_id: r.component for r in found.collect()}
        assert len(set(got.values())) == len(set(want.values()))
        nodes = linking.small_nodes(spark.createDataFrame([(1, i, i, n, 0) for i in range(n)], "path long, id long, root long, n long, head long"), 64)
        made.append(nodes.count())
    assert made[1] <= 4.2 * made[0]


def near_components(rows, least=0.8):
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {r[0]: label[i] for i, r in enumerate(rows)}
