"""Files written, streams, and the shape of the plans."""

import csv
import glob
import json

from pyspark.sql import functions as F

from checks.queries import REGISTERED
from checks.standins import demo_profiles, documents, list_pages, sites
from rolecast.operators.ranking import rank
from rolecast.sinks import exports
from rolecast.sources.landed import read_list_pages
from rolecast.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def test_csv_and_json_files(spark, tmp_path):
    ranked = rank(documents(spark, SMALL).withColumn("title", F.concat(F.lit('a "quoted", title '), "title")), demo_profiles(spark, "demo"))
    exports.write_csv(ranked, str(tmp_path / "c"))
    rows = []
    for part in sorted(glob.glob(str(tmp_path / "c" / "part-*"))):
        with open(part, newline="", encoding="utf-8") as handle:
            rows += list(csv.DictReader(handle))
    expected = exports.csv_view(ranked.orderBy(F.desc("score"), "ingest_seq")).collect()
    assert list(rows[0]) == [
        "score", "title", "req_id", "location", "posted", "date_posted", "source", "url",
        "core_matches", "nice_matches", "neg_matches", "description_preview",
    ]
    assert [[r[k] for k in rows[0]] for r in rows] == [[str(e[k]) for k in rows[0]] for e in expected]
    exports.write_json(ranked, str(tmp_path / "j"))
    lines = [json.loads(x) for p in sorted(glob.glob(str(tmp_path / "j" / "part-*"))) for x in open(p, encoding="utf-8")]
    assert len(lines) == len(rows) and list(lines[0]) == ["score", "job", "matches", "notes"]
    assert lines[0]["job"]["employment_type"] is None and len(lines[0]["job"]) == 15


def test_stream_equals_batch(spark, tmp_path):
    list_pages(spark, SMALL).repartition(3).write.parquet(str(tmp_path / "pages"))
    known, tables = sites(spark, SMALL), demo_profiles(spark, "demo")

    def scored(pages):
        return ingest.stream_ranked(ingest.stream_postings(pages, known), tables).select("ingest_seq", "title", "score")

    stream = scored(ingest.stream_list_pages(spark, str(tmp_path / "pages"), files=1))
    run = stream.writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    batch = scored(read_list_pages(spark, str(tmp_path / "pages")))
    assert sorted(map(tuple, spark.table("landed").collect())) == sorted(map(tuple, batch.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_ranking_does_not_shuffle(spark):
    spread_off = documents(spark, SMALL)
    text = plan(rank(spread_off, demo_profiles(spark)).select("ingest_seq", "profile", "score"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    # the one exchange spreads the single small input file over the cores
    assert text.count("Exchange") == 1 and "RoundRobinPartitioning" in text


def test_no_query_pairs_all_rows(spark):
    for name in ("rank_topk", "rank_joined_profiles", "hydrate_left", "facet_search_topk", "scan_counts", "location_filter", "applied_facets"):
        text = plan(REGISTERED[name](spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
