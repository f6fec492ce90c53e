"""Small pieces the operators share."""

from __future__ import annotations

import pickle
import string
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: UTF-8 bytes of text that a task works on at a time; one longer text is a batch of its own.
SLICE_BYTES = 4 << 20
#: Rows that Spark hands to a task's Python at a time. Whole texts are long, so the usual 10,000 are too many.
ARROW_ROWS = 1_000


def folded(text: Column | str) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts in column ``text`` of a slice have about ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def shipped(spark: SparkSession, value):
    """A function that gives ``value`` in a task; a worker unpacks it once and keeps what it remembers."""
    packed = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})

    def get():
        held = packed.value
        if "value" not in held:
            held["value"] = pickle.loads(held.pop("packed"))
        return held["value"]

    return get


@contextmanager
def lent(spark: SparkSession, value) -> Iterator[Callable]:
    """Like :func:`shipped` for results that are stored inside the block; nothing of the value stays anywhere after it."""
    packed = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})

    def get():
        held = packed.value
        if "value" not in held:
            held["value"] = pickle.loads(held.pop("packed"))
        return held["value"]

    try:
        yield get
    finally:
        packed.destroy()


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def short_batches(spark: SparkSession) -> None:
    """Lower the session's limit of rows in an Arrow batch; it is read when a result is computed."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def arrow_map(df: DataFrame, rows, schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``rows(batch)`` makes the columns of ``schema``, as a dict, from each slice of (key, text, ...) rows."""
    short_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for part in slices(batches, limit=limit):
            made = rows(part)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, stays, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``df``, all columns, for which ``stays(texts)`` is true; no row moves."""
    short_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        for part in slices(batches, at, limit):
            yield part.filter(pa.array(stays(part.column(at).to_pylist()), pa.bool_()))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)
