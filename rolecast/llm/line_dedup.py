"""Repeated lines across documents, found in levelled sorted runs, with DataFrame operations only.

A null or empty text is one empty line. Null ids rank below all others. Every
row counts as a document; rows with the same id share what the largest id keeps.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import folded
from rolecast.session import materialize

#: Characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Batches that the documents are added in, and runs of a level that are merged into one of the next.
BATCHES = 6
FANOUT = 3
#: A key with more than this share of all rows is hot; there are fewer than 1 / share of them.
HOT_SHARE = 1e-4


def line_key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def line_hash(key: Column) -> list[Column]:
    """128 bits of a line's key in two columns."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, h1, h2``: the distinct long line keys of every row."""
    long_keys = F.filter(F.transform(F.split(folded("text"), "\n"), line_key), lambda x: F.length(x) >= min_chars)
    keys = docs.select("doc_id", F.explode(F.array_distinct(long_keys)).alias("key"))
    return keys.select("doc_id", *line_hash(F.col("key")))


class LineRuns:
    """Sorted runs of (line hash, documents, largest id) in levels.

    A batch becomes one sorted run of level 0. When a level has ``fanout`` runs
    they are merged into one run of the next level, so a row is rewritten once a
    level. Batches must not share documents.
    """

    def __init__(self, fanout: int = FANOUT, min_docs: int = MIN_DOCS):
        self.levels: list[list[DataFrame]] = []
        self.fanout = fanout
        self.min_docs = min_docs

    def add(self, keys: DataFrame) -> None:
        """Add a batch's ``doc_id, h1, h2`` as a run; copies are combined before the shuffle."""
        self._put(0, keys.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))

    def append(self, keys: DataFrame) -> DataFrame:
        """The batch's rows whose line is not frequent in the runs so far; then the batch's own run is added."""
        fresh = materialize(self.anti_join(keys, F.lit(True))) if any(self.levels) else keys
        self.add(keys)
        return fresh

    def compact(self) -> DataFrame:
        """All runs as one: ``h1, h2, docs, last``."""
        runs = [run for level in self.levels for run in level]
        if len(runs) != 1:
            self.levels = []
            self._put(0, self._merged(runs))
            runs = self.levels[0]
        return runs[0]

    def anti_join(self, rows: DataFrame, unless: Column) -> DataFrame:
        """Rows without a line that ``min_docs`` documents hold; ``unless`` is a condition on ``last`` besides.

        Hot lines are few by definition and looked up without moving rows. The
        others are merged with the compacted run in hash order.
        """
        run = self.compact()
        total = run.agg(F.sum("docs")).first()[0] or 0
        often = run.where(F.col("docs") >= self.min_docs)
        hot = F.col("docs") > max(HOT_SHARE * total, self.min_docs)
        for part in (F.broadcast(often.where(hot)), often.where(~hot).hint("merge")):
            part = part.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "last")
            rows = rows.join(part, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & unless, "left_anti")
        return rows

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def _put(self, level: int, rows: DataFrame) -> None:
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(materialize(rows.sortWithinPartitions("h1", "h2")))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(runs))


def line_batches(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> list[DataFrame]:
    """The line keys of all rows in batches with about as many ids each, largest ids first."""
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or []
    batch = sum((F.coalesce(F.col("doc_id") > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    stored = materialize(line_keys(docs, min_chars).withColumn("batch", batch))
    return [stored.where(F.col("batch") == i).drop("batch") for i in range(batches - 1, -1, -1)]


def surviving_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """``doc_id, tag, survivors``: positions of the long lines that stay, by id and hash of the text.

    Whether a line is frequent is known after the last batch only. So all
    batches are added to the runs first, and then the lines are merge-anti-joined
    with the compacted run.
    """
    runs = LineRuns(min_docs=min_docs)
    for keys in line_batches(docs, batches, min_chars):
        runs.add(keys)
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("tag"), F.posexplode(F.split(folded("text"), "\n")).alias("place", "line")
    )
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "tag", "place", *line_hash(F.col("key")))
    kept = runs.anti_join(lines, ~F.col("doc_id").eqNullSafe(F.col("last")))
    return kept.groupBy("doc_id", "tag").agg(F.collect_set("place").alias("survivors"))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """``row`` (the input row), ``kept_text``, ``n_lines`` before dropping and ``n_dropped``.

    A line whose key has at least ``min_chars`` characters and occurs in at least
    ``min_docs`` documents stays in the document with the largest id only.
    """
    found = surviving_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches).alias("found")
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("found.doc_id")) & (F.xxhash64("row.text") == F.col("found.tag"))
    joined = rows.join(found, same, "left").select("row", "survivors")

    def parts(lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        short = F.filter(places, lambda i: F.length(line_key(F.get(lines, i))) < min_chars)
        stay = F.array_sort(F.concat(short, F.coalesce("survivors", F.array().cast("array<int>"))))
        return F.struct(
            F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("kept_text"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(stay)).cast("long").alias("n_dropped"),
        )

    # the lines are bound once, so that they are not split again for each position
    lines = F.array(F.split(F.coalesce("row.text", F.lit("")), "\n"))
    return joined.select("row", F.explode(F.transform(lines, parts)).alias("cut")).select("row", "cut.*")
