"""Details in files by address, and the choice of one copy without moving texts."""

from pyspark.sql import functions as F

from rolecast.operators.joins import one_per_key
from rolecast.sources import details

SHAPE = "url string, html string"


def files_read(df):
    """How many files the scans of the plan opened; they count them when they run."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = df.select("*")
        run.collect()
        leaves = run._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        return sum(s.metrics().apply("numFiles").value() for s in scans if s.metrics().contains("numFiles") and "bucket" in s.toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_few_postings_open_few_files(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("https://x/"), "id").alias("url"), F.concat(F.lit("page "), "id").alias("html"))
    store = details.land_details(rows, str(tmp_path / "d"), buckets=64)
    few = spark.createDataFrame([(f"https://x/{i}",) for i in (5, 5, 17, 3999, 9999)] + [(None,)], "url string")
    found = store.lookup(few)
    assert sorted(r.html for r in found.collect()) == ["page 17", "page 3999", "page 5"]
    assert 1 <= files_read(found) <= 4 * 2
    assert files_read(store.lookup(rows.select("url"))) >= 64
    assert store.lookup(rows.select("url")).count() == 4000


def test_later_landings_add_copies(spark, tmp_path):
    first = spark.createDataFrame([("u1", "old"), ("u2", "x"), (None, "lost")], SHAPE)
    store = details.land_details(first, str(tmp_path / "d"), buckets=4)
    details.land_details(spark.createDataFrame([("u1", "new")], SHAPE), str(tmp_path / "d"), buckets=4)
    asked = spark.createDataFrame([("u1",), ("u3",)], "url string")
    assert sorted(r.html for r in store.lookup(asked).collect()) == ["new", "old"]
    assert store.lookup(asked.where("false")).count() == 0


def test_one_copy_of_each_key_without_an_aggregate_of_texts(spark):
    rows = [("a", 2, "late"), ("a", 1, "first"), ("a", 1, "first"), ("b", None, "unknown"), ("b", 5, "known"), ("c", None, "only")]
    df = spark.createDataFrame(rows, "key string, seq int, text string")
    got = one_per_key(df, "key", "seq")
    assert got.columns == ["key", "text"]
    assert sorted(map(tuple, got.collect())) == [("a", "first"), ("b", "known"), ("c", "only")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    alone = one_per_key(df.where("key = 'c'"), "key", "seq")
    assert [tuple(r) for r in alone.collect()] == [("c", "only")]
