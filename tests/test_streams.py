"""Streams with state: page cuts in any order, top-k that can be replayed, deep facet trees."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rolecast.operators import facets, paging
from rolecast.operators.limits import limit_per_group
from rolecast.plans.search import Landed, by_site, scan
from rolecast.streaming import best, cuts, ingest
from tests.test_facets import NESTED, chain, flat_chain

SITES = [f"https://s{i}.example.com/Careers" for i in range(3)]


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    cuts.use_state_store(spark)
    yield
    spark.conf.unset(name)


def page(site, number, n, seed=0, total=None):
    items = [{"title": f"{number}-{i}", "externalPath": f"/job/{seed}-{number}-{i}_JR{i}", "id": f"{number}-{i}", "name": f"n{i}"} for i in range(n)]
    items.insert(min(1, len(items)), "not an object") if n and number % 2 else None
    body = {"positions": items, "count": total} if total is not None else {"jobPostings": items}
    return (site, number, json.dumps(body))


def landed_pages(seed):
    """Per site full pages of 3 entries, a short one, and pages behind it; some twice, some broken first."""
    rng = random.Random(seed)
    rows = []
    for site, full in zip(SITES, (4, 0, 2), strict=True):
        for n in range(1, full + 4):
            size = 1 if n == full + 1 else 3 - n % 2  # odd pages have one entry more that is no object
            rows.append(page(site, n, size))
            if rng.random() < 0.4:
                rows.append(rows[-1])
            if rng.random() < 0.3:
                rows.append((site, n, "broken"))
    rng.shuffle(rows)
    return rows


def landed_files(spark, rows, folder, each=6):
    shape = "source string, page_no bigint, payload string"
    for i in range(0, len(rows), each):
        spark.createDataFrame(rows[i : i + each], shape).coalesce(1).write.parquet(f"{folder}/pages/f{i:03}")
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/pages"), spark.createDataFrame(rows, shape)


def run(df, folder, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return df.sparkSession.table(name)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_of_pages_in_any_order_equals_the_batch(spark, store, tmp_path, seed):
    stream, batch = landed_files(spark, landed_pages(seed), tmp_path)
    sites = spark.createDataFrame([(s, i) for i, s in enumerate(SITES)], "source string, source_ord long")
    jobs = 4 if seed == 2 else None
    cut = cuts.stream_cut(stream, page_size=3, max_pages=5, max_jobs=jobs)
    got = run(cuts.stream_scan(cut, sites).select("ingest_seq", "title", "url"), tmp_path, f"cut{seed}")
    want = scan(Landed(sites, batch, None), max_pages=5, page_size=3)
    if jobs:
        want = limit_per_group(by_site(want), ["site_ord"], "ingest_seq", jobs).drop("site_ord")
    want = want.select("ingest_seq", "title", "url").collect()
    assert len(want) > 5 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_the_other_listing_ends_at_its_total(spark, store, tmp_path):
    rows = [page(SITES[0], n, 2, total=6) for n in (3, 1, 5, 4, 2)] + [page(SITES[1], n, 0 if n == 2 else 2, total=99) for n in (3, 2, 1)]
    stream, batch = landed_files(spark, rows, tmp_path, 2)
    got = run(cuts.stream_cut(stream, alternate=True), tmp_path, "totals").select("source", "page_no").collect()
    want = paging.cut_at_total(paging.parse_pages(batch, True)).select("source", "page_no").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_gap_holds_back_what_follows_until_it_closes(spark, store, tmp_path):
    rows = [page(SITES[0], n, 3) for n in (1, 3, 4)] + [page(SITES[0], 5, 1)]
    stream, _ = landed_files(spark, rows, tmp_path, 1)

    def pages_out():
        cut = cuts.stream_cut(stream, page_size=3).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        query = cut.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        return sorted(r.page_no for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert pages_out() == [1]
    spark.createDataFrame([page(SITES[0], 2, 3)], "source string, page_no bigint, payload string").write.parquet(f"{tmp_path}/pages/late")
    # the same query goes on where it ended
    assert pages_out() == [1, 2, 3, 4, 5]


def test_patience_ends_the_wait_for_a_missing_page(spark, store, tmp_path):
    rows = [page(SITES[0], n, 3) for n in (1, 3)] + [page(SITES[0], 4, 1), page(SITES[0], 6, 3)]
    stream, _ = landed_files(spark, rows, tmp_path, 4)
    cut = cuts.stream_cut(stream, page_size=3, patience_ms=500)
    query = cut.writeStream.format("memory").queryName("patient").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="300 milliseconds").start()
    for _ in range(100):
        query.awaitTermination(1)
        if len(spark.table("patient").collect()) >= 3:
            break
    query.stop()
    assert sorted(r.page_no for r in spark.table("patient").collect()) == [1, 3, 4]


# --- best of every profile ------------------------------------------------------------

SHAPE = "profile string, score double, ingest_seq bigint, title string"


def top(rows, k):
    held = {}
    for p, score, seq, title in rows:
        held[p, seq] = min(held.get((p, seq), (-score, title)), (-score, title))
    every = [(p, -s, seq, t) for (p, seq), (s, t) in held.items()]
    return sorted(r for p in {r[0] for r in every} for r in sorted((r for r in every if r[0] == p), key=lambda r: (-r[1], r[2]))[:k])


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(rng.randrange(12)), rng.randrange(40), f"t{rng.randrange(3)}") for _ in range(120)]
    merge = best.merge_best(str(tmp_path / "best"), 4)
    parts = [rows[i : i + 30] for i in range(0, 120, 30)]
    for number, part in enumerate(parts):
        df = spark.createDataFrame(part, SHAPE)
        merge(df, number)
        once = sorted(map(tuple, best.read_best(spark, str(tmp_path / "best")).select("profile", "score", "ingest_seq", "title").collect()))
        merge(df, number)  # as after a failure
        again = sorted(map(tuple, best.read_best(spark, str(tmp_path / "best")).select("profile", "score", "ingest_seq", "title").collect()))
        assert once == again == top([r for p in parts[: number + 1] for r in p], 4)
    assert len(list((tmp_path / "best").glob("batch=*"))) == best.KEPT


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "best")
    assert best.read_best(spark, folder) is None
    best.merge_best(folder, 2)(spark.createDataFrame([("a", 1.0, 1, "x")], SHAPE), 0)
    (tmp_path / "best" / "batch=1").mkdir()
    assert best.read_best(spark, folder).count() == 1


def test_best_of_a_stream_equals_the_batch(spark, tmp_path):
    rows = [("p", float(i * 7 % 50), i, "t") for i in range(100)]
    for i in range(4):
        spark.createDataFrame(rows[i::4], SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(best.merge_best(f"{tmp_path}/best", 5)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = best.read_best(spark, f"{tmp_path}/best").select("profile", "score", "ingest_seq", "title").collect()
    assert sorted(map(tuple, got)) == top(rows, 5)


# --- facets -----------------------------------------------------------------------------


def test_facet_trees_on_a_stream(spark, tmp_path):
    shape = "source string, page_no bigint, payload string"
    spark.createDataFrame([("a", 1, json.dumps(chain(40))), ("b", 1, json.dumps(NESTED)), ("b", 2, json.dumps(chain(2)))], shape).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    run_each = ingest.stream_facets(lambda options, number: options.write.mode("overwrite").parquet(f"{tmp_path}/out/{number}"))
    query = stream.writeStream.foreachBatch(run_each).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    rows = spark.read.parquet(f"{tmp_path}/out/0").orderBy("source", "seq").collect()
    assert [r.value for r in rows if r.source == "a"] == flat_chain(40) and sum(r.source == "b" for r in rows) == 6


def test_a_tree_that_is_too_deep_for_a_row_is_an_error_on_a_stream(spark, tmp_path):
    shape = "source string, page_no bigint, payload string"
    spark.createDataFrame([("a", 1, json.dumps(chain(12)))], shape).write.parquet(f"{tmp_path}/in")
    options = facets.facet_options(paging.facet_pages(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")))
    with pytest.raises(StreamingQueryException, match="more than"):
        run(options.select("value", F.col("seq")), tmp_path, "deep")
