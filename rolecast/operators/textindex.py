"""Search text by an inverted index in files, bucketed by token.

A token is what blanks part in the lower-cased texts, so a searched word, which
has no blank, lies inside a single token. The lists are rows (token, posting) in
order, written with delta encoding; frequent tokens are many files, not one. A
search looks through the vocabulary, not the texts, and reads the buckets of the
tokens it asks for, from the rarest word on.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.session import materialize, shared_folder

BUCKETS = 64
#: Parts of a bucket that are written apart, so that a token of nearly all postings is no single task.
SLICES = 8
#: The blanks of Python's str.split, by which searched texts are cut into words.
BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


class TextIndex(NamedTuple):
    """``path``: the lists, one folder a bucket; ``words``: ``bucket, token, postings``; ``key``: what names a posting."""

    path: str
    words: DataFrame
    key: str

    def lists(self, buckets: list[int]) -> DataFrame:
        rows = self.words.sparkSession.read.parquet(self.path)
        return rows.where(F.col("bucket").isin(*buckets))


def build_text_index(postings: DataFrame, *columns: str, key: str = "ingest_seq", buckets: int = BUCKETS) -> TextIndex:
    """Index the words of ``columns``; ``key`` tells the postings apart. Nulls are empty texts."""
    spark = postings.sparkSession
    tokens = F.array_distinct(F.split(F.lower(F.concat_ws("\n", *columns)), BLANKS))
    rows = postings.select(F.col(key).alias("posting"), F.explode(tokens).alias("token")).where("token <> ''")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    order = ["bucket", "token", "posting"]
    path = f"{shared_folder(spark)}/rolecast-index-{uuid.uuid4().hex}"
    # by hash: a range would be drawn from a sample, for which all texts are cut into tokens once more
    placed = rows.repartition("bucket", F.pmod(F.xxhash64("posting"), F.lit(SLICES))).sortWithinPartitions(*order)
    # without a dictionary, whole numbers are written as deltas by the second version of the format
    writer = placed.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
    writer.partitionBy("bucket").parquet(path)
    shape = f"posting {postings.schema[key].dataType.simpleString()}, token string, bucket int"
    words = spark.read.schema(shape).parquet(path).groupBy("bucket", "token").agg(F.count("*").alias("postings"))
    return TextIndex(path, materialize(words), key)


def index_search(index: TextIndex, text: str, whole: bool = False) -> DataFrame:
    """The keys of the postings in which every word of ``text`` occurs, case-blind, each once.

    Words may lie inside longer ones as in :func:`rolecast.operators.paging.search_text`;
    with ``whole`` they are tokens, and a word costs one bucket. A text without
    words finds every posting that has a token.
    """
    name = F.col("posting").alias(index.key)
    asked = []
    for word in dict.fromkeys(text.lower().split()):
        test = F.col("token") == word if whole else F.contains("token", F.lit(word))
        found = index.words.where(test)
        # at most one number for each bucket
        buckets, postings = found.agg(F.collect_set("bucket"), F.coalesce(F.sum("postings"), F.lit(0))).first()
        asked.append((postings, sorted(buckets), test))
    if not asked:
        return index.words.sparkSession.read.parquet(index.path).select(name).distinct()
    held = []
    for _, buckets, test in sorted(asked, key=lambda a: a[0]):
        # the lists hold the token itself; that of a whole word reaches the files' statistics
        held.append(index.lists(buckets).where(test).select("posting"))
    rarest = held[0].distinct()
    return reduce(lambda a, b: a.join(b, "posting", "left_semi"), held[1:], rarest).select(name)
