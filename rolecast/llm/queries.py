"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.llm import (
    bpe,
    chosen_path,
    exact_dedup,
    hard_negatives,
    html_text,
    langid,
    licenses,
    line_dedup,
    packing,
    quality,
    ranked_search,
    simhash,
    token_count,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTERED[run.__name__] = run
    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op2_exact_dedup(spark, folder):
    found = exact_dedup.exact_duplicates(documents(spark, folder), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op4_line_dedup(spark, folder):
    cut = line_dedup.drop_repeated_lines(documents(spark, folder).select("doc_id", "text"))
    return cut.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op5_best_fit_packing(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(documents(spark, folder), path, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op7_simhash(spark, folder):
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", simhash.shown("fp").alias("fingerprint"), "component_id")


@query
def op9_token_counts(spark, folder):
    return token_count.count_tokens(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_bpe(spark, folder):
    coded = bpe.encode(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op1_licenses(spark, folder):
    return licenses.scan(documents(spark, folder))


@query
def op3_html_text(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return html_text.extract(pages, html_text.fit(pages))


@query
def op6_langid(spark, folder):
    return langid.identify(documents(spark, folder)).select(
        "doc_id",
        F.coalesce(langid.remainder() == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )


@query
def op8_quality(spark, folder):
    docs = documents(spark, folder)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality.assess(docs, model)


@query
def op12_ranked_search(spark, folder):
    return ranked_search.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op13_hard_negatives(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query
def op11_chosen_path(spark, folder):
    return chosen_path.near_duplicates(documents(spark, folder))
