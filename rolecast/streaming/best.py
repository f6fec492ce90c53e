"""The best postings of every profile, kept up to date while postings land.

The table is a folder with one version for each micro-batch, named by the batch's
number. A batch merges its rows with the version before its own and writes its
own version anew, so a batch that is run again changes nothing, and a reader sees
whole versions only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.operators.limits import top_per_group

#: Versions that stay after a newer one is whole.
KEPT = 3


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions, in order; the folder may be in any store that Spark reads."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = []
    for entry in files.listStatus(path):
        name = re.fullmatch(r"batch=(\d+)", entry.getPath().getName())
        if name and files.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found.append(int(name[1]))
    return sorted(found)


def read_best(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest whole version, or that before batch ``before``; None if there is none."""
    known = [v for v in _versions(spark, folder) if before is None or v < before]
    return spark.read.parquet(f"{folder}/batch={known[-1]}") if known else None


def merge_best(folder: str, k: int, kept: int = KEPT):
    """A function for ``foreachBatch`` over ranked postings (``profile``, ``score``, ``ingest_seq`` and any columns).

    Of a posting that lands again for the same profile the row with the highest
    score counts, and of those the first by all columns that have an order.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in ("profile", "ingest_seq")]
        # only ordered values can break a tie
        ordered = [c for c in rest if c != "score" and dict(batch.dtypes)[c].split("<")[0] not in ("map", "variant") and "variant" not in dict(batch.dtypes)[c]]
        # at most k rows of a profile leave the batch, so the merge does not grow with it
        once = batch.groupBy("profile", "ingest_seq").agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), *ordered)).alias("_row"))
        cut = top_per_group(once.select("profile", "ingest_seq", "_row.*"), ["profile"], [F.desc("score")], k, unique=["ingest_seq"])
        before = read_best(spark, folder, number)
        if before is not None:
            both = cut.unionByName(before.select(*cut.columns))
            again = both.groupBy("profile", "ingest_seq").agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), *ordered)).alias("_row"))
            cut = top_per_group(again.select("profile", "ingest_seq", "_row.*"), ["profile"], [F.desc("score")], k, unique=["ingest_seq"])
        cut.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        forget(spark, folder, kept)

    return run


def forget(spark: SparkSession, folder: str, kept: int = KEPT) -> None:
    """Remove all but the newest ``kept`` versions."""
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in _versions(spark, folder)[:-kept]:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={old}"), True)
