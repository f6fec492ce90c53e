"""Exact duplicates by a content sort, with DataFrame operations only.

Null text counts as empty. A null id is kept only where a text has no other. Of
rows that share both text and id exactly one is kept, so every text keeps one row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecast.llm.common import folded, shuffle_partitions
from rolecast.session import materialize

#: Buckets of the content sort for each shuffle partition.
BUCKETS_PER_PARTITION = 4
#: Sampled keys for each splitter.
SAMPLES_PER_SPLIT = 20
#: Splitters are searched in steps of so many, then one by one.
STEP = 32
#: Leading characters that are compared before anything else.
HEAD = 16


def content_buckets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, norm, head, hash, rank, bucket, border``: every row with its place in the content order.

    The order is (first characters, hash, whole text, id). Splitters are sampled
    from it without the whole text, so they stay small, and a text that very many
    rows share is split by id over several buckets. Such a text lies on a splitter
    (``border``) and may go on in the next bucket.
    """
    buckets = BUCKETS_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), folded(text_column).alias("norm"))
    keyed = rows.withColumn(
        "key",
        F.struct(
            F.substring("norm", 1, HEAD).alias("head"),
            F.xxhash64("norm").alias("hash"),
            F.coalesce("doc_id", F.lit(-(2**63))).alias("rank"),
        ),
    )
    fraction = min(1.0, SAMPLES_PER_SPLIT * buckets / max(docs.count(), 1))
    drawn = keyed.select("key").sample(fraction, seed=7).agg(F.sort_array(F.collect_list("key")).alias("drawn"))
    splitters = drawn.select(
        F.expr(
            f"filter(array_distinct(transform(sequence(1, {buckets - 1}),"
            f" i -> get(drawn, cast(floor(i * size(drawn) / {buckets}) as int)))), s -> s is not null)"
        )
    ).scalar()
    steps = F.expr(f"size(filter(sequence(0, size(splitters) div {STEP}), i -> get(splitters, i * {STEP}) <= key))")
    bucket = F.expr(
        f"if(steps = 0, 0, (steps - 1) * {STEP} + size(filter("
        f"slice(splitters, (steps - 1) * {STEP} + 1, {STEP}), s -> s <= key)))"
    )
    border = F.expr(
        "coalesce(get(splitters, bucket - 1).hash = key.hash, false)"
        " or coalesce(get(splitters, bucket).hash = key.hash, false)"
    )
    placed = keyed.withColumn("splitters", splitters).withColumn("steps", steps).withColumn("bucket", bucket)
    return placed.select("doc_id", "norm", "key.*", "bucket", border.alias("border"))


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    A bucket is sorted outside memory where it must be, which places equal texts
    side by side; the window finds the end of a run by comparing whole texts of
    neighbours. Runs of border texts are then put together by their whole texts:
    two for each splitter at most, so that table is broadcast.
    """
    largest = {"largest": True, "smallest": False}[keep]
    pick = F.max if largest else F.min
    dealt = content_buckets(docs, id_column, text_column).repartition("bucket")
    # in both modes a known id goes before a null one
    order = F.col("rank").desc() if largest else F.col("doc_id").asc_nulls_last()
    run = Window.partitionBy("bucket", "head", "hash", "norm").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.select(
        "doc_id",
        "norm",
        "border",
        F.sha2("norm", 256).alias("text_sha256"),
        F.count("*").over(whole).alias("run_size"),
        pick("doc_id").over(whole).alias("run_keep"),
        (F.row_number().over(run) == 1).alias("first"),
    )
    ends = F.when(F.col("first") & F.col("border"), F.col("norm")).alias("border_text")
    runs = materialize(runs.select("doc_id", "text_sha256", "run_size", "run_keep", "first", ends))
    joined = (
        runs.where("border_text is not null")
        .groupBy("border_text")
        .agg(
            F.min("text_sha256").alias("text_sha256"),
            F.sum("run_size").alias("all_size"),
            pick("run_keep").alias("all_keep"),
        )
    )
    found = runs.drop("border_text").join(F.broadcast(joined.drop("border_text")), "text_sha256", "left")
    keep_id = F.when(F.col("all_size").isNull(), F.col("run_keep")).otherwise(F.col("all_keep"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("first") & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )
