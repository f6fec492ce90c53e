"""Hard negatives by an STR-packed R-tree over inner products.

Rows without an id, a label or a vector, or with a null or non-finite component,
take no part. Of rows that share an id one takes part, the first by label and
vector. Shorter vectors count as filled up with zeros. Equal scores go by the
smaller id. Scores have to fit in 64 bits. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import lent
from rolecast.operators.limits import top_per_group
from rolecast.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Rows of a leaf, and of the part of the tree that one task call holds.
LEAF_ROWS, TILE_ROWS = 64, 4_096
#: Anchors that are looked for in one pass over the tree.
BLOCK_ANCHORS = 2_048
#: Numbers up to here are exact in floating point.
EXACT = 2**53


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v``: the rows that take part, with whole-number components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(usable).where(~bad).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_row")).select("vec_id", "_row.*")


def tiled(rows: DataFrame, limit: int = TILE_ROWS) -> DataFrame:
    """The rows with their place (``tile``, ``part``) in the upper levels of the tree.

    Sort-tile: the first coordinate is cut into slabs of as many rows, each slab
    by the second coordinate into tiles. A tile that equal coordinates make
    larger than twice ``limit`` is split by id; its parts have the same box.
    """
    tiles = ceil(rows.count() / limit)
    if tiles <= 1:
        return rows.withColumn("tile", F.lit(0)).withColumn("part", F.lit(0))
    slabs = ceil(tiles**0.5)
    cuts = ", ".join(str(i / slabs) for i in range(1, slabs)) or "0.5"
    first, second = "coalesce(get(v, 0), 0)", "coalesce(get(v, 1), 0)"
    below = "size(filter({cuts}, c -> c <= {value}))"
    edges = rows.agg(F.expr(f"percentile_approx({first}, array({cuts}))").alias("cuts")).scalar()
    slabbed = rows.withColumn("cuts", edges).withColumn("slab", F.expr(below.format(cuts="cuts", value=first))).drop("cuts")
    strips = slabbed.groupBy("slab").agg(F.expr(f"percentile_approx({second}, array({cuts}))").alias("cuts"))
    strip = F.expr(below.format(cuts="cuts", value=second))
    placed = materialize(slabbed.join(strips, "slab").select("vec_id", "label", "v", (F.col("slab") * slabs + strip).alias("tile")))
    parts = placed.groupBy("tile").agg(F.ceil(F.count("*") / (2 * limit)).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return placed.join(parts, "tile").select("vec_id", "label", "v", "tile", part.alias("part"))


class Tree:
    """A tile's leaves, packed sort-tile-recursively inside each label, and their bounding boxes.

    ``exact`` says that all scores times the number of rows are exact in floating point.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, exact: bool):
        self.ids = np.sort(ids)
        rank = np.searchsorted(self.ids, ids)
        falling = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable")
        self.leaves = [rows for label in np.unique(labels) for rows in self._packed(vectors, np.flatnonzero(labels == label), falling)]
        self.label = np.array([labels[rows[0]] for rows in self.leaves])
        self.kind, self.none = (np.float64, -(2**62)) if exact else (object, -(2**200))
        self.low = np.array([vectors[rows].min(axis=0) for rows in self.leaves]).astype(self.kind)
        self.high = np.array([vectors[rows].max(axis=0) for rows in self.leaves]).astype(self.kind)
        self.points = [vectors[rows].astype(self.kind) for rows in self.leaves]
        self.behind = [len(ids) - 1 - rank[rows] for rows in self.leaves]
        self.own = [ids[rows] for rows in self.leaves]

    @staticmethod
    def _packed(vectors: np.ndarray, rows: np.ndarray, dims: np.ndarray) -> Iterator[np.ndarray]:
        pages = -(-len(rows) // LEAF_ROWS)
        if pages == 1:
            yield rows
            return
        slabs = ceil(pages ** (1 / max(len(dims), 1)))
        if len(dims):
            rows = rows[np.argsort(vectors[rows, dims[0]], kind="stable")]
        size = LEAF_ROWS * -(-pages // slabs) if len(dims) else LEAF_ROWS
        for start in range(0, len(rows), size):
            yield from Tree._packed(vectors, rows[start : start + size], dims[1:])

    def best(self, queries, query_ids, query_labels, same: bool, low, high, k: int):
        """``search, id, score``: for each query its ``k`` best rows of the same label, or of others, with scores in a window.

        A box bounds its scores coordinate by coordinate. Each query takes the
        boxes best first, those that miss its window not at all, and ends when
        the next box lies below its k-th score.
        """
        q = queries.astype(self.kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        upper = up @ self.high.T + down @ self.low.T
        lower = up @ self.low.T + down @ self.high.T
        meets = (query_labels[:, None] == self.label[None, :]) == same
        meets &= (upper >= low[:, None]).astype(bool) & (lower <= high[:, None]).astype(bool)
        reach = np.where(meets, np.minimum(upper, high[:, None]), self.none)
        order = np.argsort(-reach, axis=1, kind="stable")
        stride, every = len(self.ids), np.arange(len(q))
        whole = np.int64 if self.kind is np.float64 else object
        keys = np.full((len(q), k), self.none, whole)  # score * stride + place by falling id
        for turn in range(len(self.leaves)):
            box = order[:, turn]
            bound = reach[every, box]
            go = np.flatnonzero((bound > self.none) & (bound >= keys.min(axis=1) // stride))
            if not len(go):
                break
            by_box = go[np.argsort(box[go], kind="stable")]
            for part in np.split(by_box, np.flatnonzero(np.diff(box[by_box])) + 1):
                b = box[part[0]]
                scores = (q[part] @ self.points[b].T).astype(whole)
                fits = (scores >= low[part, None]) & (scores <= high[part, None]) & (self.own[b][None, :] != query_ids[part, None])
                found = np.where(fits, scores * stride + self.behind[b][None, :], self.none)
                both = np.concatenate([keys[part], found], axis=1)
                keys[part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        at, place = np.nonzero(keys > self.none)
        key = keys[at, place]
        return at, self.ids[(stride - 1 - key % stride).astype(np.int64)], (key // stride).astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of one length."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def searched(tiles: DataFrame, asked: tuple, same: bool, k: int, exact: bool) -> DataFrame:
    """``anchor_id, positive_id, positive_score, vec_id, score``, stored: the best ``k`` rows of each search in each tile.

    ``asked``: ids, labels and vectors of the anchors, and for each search its
    anchor's place, its positive's id and score, and its window.
    """
    ids, labels, vectors, anchor, positive, above, low, high = asked
    width = vectors.shape[1]
    names = ("anchor_id", "positive_id", "positive_score", "vec_id", "score")
    schema = pa.schema([(n, pa.int64()) for n in names])
    with lent(tiles.sparkSession, asked) as get:

        def run(tile: pa.Table) -> pa.Table:
            ids, labels, vectors, anchor, positive, above, low, high = get()
            tile = tile.combine_chunks()
            own = [tile.column(n).to_numpy() for n in ("vec_id", "label")]
            tree = Tree(*own, matrix(tile.column("v").chunk(0), width), exact)
            kind = object if not exact else np.int64
            at, found, score = tree.best(
                vectors[anchor], ids[anchor], labels[anchor], same, low.astype(kind), high.astype(kind), k
            )
            columns = (ids[anchor][at], positive[at], above[at], found, score)
            return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        shape = ", ".join(f"{n} long" for n in names)
        return materialize(tiles.groupBy("tile", "part").applyInArrow(run, shape))


def blocks(anchors: DataFrame, width: int, size: int = BLOCK_ANCHORS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors' ids, labels and vectors, a bounded number at a time."""
    held = []

    def made():
        vectors = np.zeros((len(held), width), np.int64)
        for i, row in enumerate(held):
            vectors[i, : len(row.v)] = row.v
        return np.array([r.vec_id for r in held]), np.array([r.label for r in held]), vectors

    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    block: int = BLOCK_ANCHORS,
    limit: int = TILE_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``; rows for which
    ``anchors`` is true are the queries, all rows are searched. An anchor's
    positives are its best other rows of the same label; a positive's negatives
    are the best rows of other labels with ``least`` to ``most`` hundredths of its score.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors))
    tiles = materialize(tiled(rows, limit))
    size = F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))
    width, largest = (x or 0 for x in tiles.agg(*size).first())
    exact = width * largest**2 * 4 * limit < EXACT
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = spark.createDataFrame([], shape)
    far = 2**63 - 1
    for ids, labels, points in blocks(rows.where(anchors), width, block):
        n = len(ids)
        nothing = np.zeros(n, np.int64)
        asked = (ids, labels, points, np.arange(n), nothing, nothing, np.full(n, -far), np.full(n, far))
        near = searched(tiles, asked, True, positives, exact)
        # a few rows for each anchor of the block
        chosen = top_per_group(near, ["anchor_id"], [F.desc("score")], positives, unique=["vec_id"]).collect()
        if not chosen:
            continue
        place = {i: at for at, i in enumerate(ids.tolist())}
        at, positive, score = (np.array(x) for x in zip(*[(place[r.anchor_id], r.vec_id, r.score) for r in chosen], strict=True))
        whole = score.astype(object)  # the products may not fit
        window = (x.astype(np.int64) for x in (-(-least * whole // 100), most * whole // 100))
        asked = (ids, labels, points, at, positive, score, *window)
        far_ones = searched(tiles, asked, False, negatives, exact)
        best = top_per_group(far_ones, ["anchor_id", "positive_id"], [F.desc("score")], negatives, unique=["vec_id"], rank="rank")
        found = found.unionByName(
            best.select(
                "anchor_id",
                "positive_id",
                F.col("rank").cast("int").alias("rank"),
                F.col("vec_id").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            )
        )
    return found
