"""Detail pages in files by address, so that a lookup of few postings opens few files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.operators.joins import BROADCAST_ROWS
from rolecast.session import materialize

BUCKETS = 256
_BUCKET = "_bucket"


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class DetailStore(NamedTuple):
    """Landed details under ``path``, one folder for each of ``buckets`` hashes of ``key`` (``url`` or ``job_id``)."""

    path: str
    schema: str
    key: str = "url"
    buckets: int = BUCKETS

    def lookup(self, postings: DataFrame) -> DataFrame:
        """The details whose key some posting has; only the folders of these keys are opened.

        Inside a folder the files are in the order of the key, so the statistics
        of their blocks leave most of them unread where few keys are asked for.
        """
        spark = postings.sparkSession
        asked = materialize(postings.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct().withColumn(_BUCKET, bucket(F.col(self.key), self.buckets)))
        # at most one number for each bucket
        found = asked.agg(F.collect_set(_BUCKET), F.count("*"), F.min(self.key), F.max(self.key)).first()
        rows = spark.read.schema(f"{self.schema}, {_BUCKET} int").parquet(self.path).where(F.col(_BUCKET).isin(*found[0]))
        rows = rows.where(F.col(self.key).between(found[2], found[3]))
        few = F.broadcast(asked) if found[1] <= BROADCAST_ROWS else asked
        return rows.join(few, [_BUCKET, self.key], "left_semi").drop(_BUCKET)


def land_details(details: DataFrame, path: str, key: str = "url", buckets: int = BUCKETS, mode: str = "append") -> DetailStore:
    """Write details into their folders. A later landing adds files; a folder of any size is several files.

    Rows without a key are never asked for and not written.
    """
    rows = details.where(F.col(key).isNotNull()).withColumn(_BUCKET, bucket(F.col(key), buckets))
    placed = rows.repartitionByRange(_BUCKET, key).sortWithinPartitions(_BUCKET, key)
    placed.write.mode(mode).partitionBy(_BUCKET).parquet(path)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in details.schema)
    return DetailStore(path, shape, key, buckets)
