"""Links between documents by the Jaccard similarity of their shingle sets, inside groups of candidates.

A document is a row of ``nodes`` with an ``id``, and the ``doc_id``, ``t1`` and
``t2`` of one row of the table that has its text. ``root`` names what is known
to be connected; documents with the same root are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import SLICE_BYTES, short_batches
from rolecast.llm.components import components
from rolecast.session import materialize

#: Documents of a group that are compared one with another; a larger group is taken in parts.
SMALL = 4_096
#: Tables of numbers up to so many rows are broadcast: roots, and the texts to be compared.
BROADCAST_ROWS = 250_000
#: Rows that a task takes at a time, and bytes whose words it hashes at a time.
HELD_ROWS, PIECE_BYTES = 1 << 14, 1 << 18


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label[i]``: the smallest index connected with i, once the links a-b are added to the labels."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64, endpoint=False)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEP, _BACK = MIX, np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where words of UTF-8 bytes begin, and their hashes; no word goes across one of the ``cuts``.

    A hash is the sum of the bytes' numbers times powers of an odd number, so it
    is the difference of two running sums. Bytes are taken a piece at a time; a
    piece ends between words.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = edge[-1] = True
    inside = ~_BLANK[data]
    begins = inside & edge[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    stops = inside & edge[1:]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    out = np.zeros(len(first), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(first):
            upto = max(int(np.searchsorted(last, first[at] + PIECE_BYTES, side="right")), at + 1)
            start, end = int(first[at]), int(last[upto - 1])
            sums = np.zeros(end - start + 1, np.uint64)
            np.cumsum(_BYTE[data[start:end]] * _powers(_STEP, end - start), out=sums[1:])
            a, b = first[at:upto] - start, last[at:upto] - start
            out[at:upto] = (sums[b] - sums[a]) * _powers(_BACK, end - start)[a]
            at = upto
        out ^= out >> np.uint64(31)
        out *= MIX
    return first, out


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its different shingles, A-Z lower-cased; of all words if they are fewer.

    A null or empty text, or one without words, has none.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    ends = ends - ends[0] if len(column) else np.zeros(1, np.int64)
    first, words = word_hashes(raw, ends[:-1])
    bounds = np.searchsorted(first, ends).tolist()
    out = []
    with np.errstate(over="ignore"):
        rolled = np.full(max(len(words) - width + 1, 0), width, np.uint64)
        for k in range(width):
            rolled = rolled * MIX + words[k : k + len(rolled)]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                one = b - a
                for word in words[a:b].tolist():
                    one = (one * int(MIX) + word) % 2**64
                out.append(np.array([one ^ one >> 29], np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def marks() -> tuple[Column, Column]:
    """128 bits that tell texts apart."""
    return F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")


def runs(batches, hold: int, weigh=lambda batch: batch.num_rows) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, which are sorted by their first column, in pieces that no value of it is cut by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(map(weigh, held)) < hold:
            continue
        whole = pa.concat_batches(held)
        key = whole.column(0).to_numpy()
        ended = np.flatnonzero(key != key[-1])
        cut = int(ended[-1]) + 1 if len(ended) else 0
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def every_pair(near):
    """Finds the pairs of documents of one group, not connected yet, for which ``near(held, a, b)`` holds: all are compared."""

    def pairs(node, root, held):
        at, step = np.arange(len(node)), 0
        while True:
            step += 1
            at = at[at + step < len(node)]
            at = at[node[at] == node[at + step]]
            if not len(at):
                break
            a = at[root[at] != root[at + step]]
            a = a[near(held, a, a + step)]
            yield a, a + step

    return pairs


def candidate_groups(members: DataFrame, nodes: DataFrame, tokens: Sequence[str], read, pairs) -> DataFrame:
    """``cluster, id, root``: documents of a small group that may be near each other and are not connected yet.

    ``members`` has ``node, id, root``, ``nodes`` the ``tokens`` of each ``id``.
    ``pairs(node, root, read(columns of tokens))`` finds the pairs of a group
    that are near, in pieces. A cluster is what they connect. It is named after
    its members, so that the same cluster found in several groups is one.
    """
    schema = pa.schema([("cluster", pa.int64()), ("id", pa.int64()), ("root", pa.int64())])

    def run(batches):
        for part in runs(batches, HELD_ROWS):
            node, ids, root = (part.column(i).to_numpy() for i in range(3))
            label, linked = np.arange(len(node)), np.zeros(len(node), bool)
            for a, b in pairs(node, root, read(part.columns[3:])):
                linked[a] = linked[b] = True
                label = join_labels(label, a, b)
            kept = np.flatnonzero(linked)
            with np.errstate(over="ignore"):
                mixed = (ids[kept].astype(np.uint64) + np.uint64(1)) * MIX
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(30)
                name = np.zeros(len(node), np.uint64)
                np.add.at(name, label[kept], mixed)
            columns = (name[label[kept]].view(np.int64), ids[kept], root[kept])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    short_batches(nodes.sparkSession)
    joined = members.join(nodes.select("id", *tokens), "id").select("node", "id", "root", *tokens)
    dealt = joined.repartition("node").sortWithinPartitions("node")
    found = dealt.mapInArrow(run, "cluster long, id long, root long")
    return found.groupBy("cluster", "id").agg(F.min("root").alias("root"))


def true_links(found: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places of sets whose similarity is at least ``percent``; one link for each two labels that come together."""
    sizes = np.array([len(x) for x in found])
    values, inverse, often = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(found)), sizes)[np.argsort(inverse, kind="stable")]
    start = np.cumsum(often) - often
    ends = np.cumsum(sizes)
    links = []
    for i in range(len(found)):
        if (label == label[0]).all():
            break
        mine = inverse[ends[i] - sizes[i] : ends[i]]
        mine = mine[often[mine] > 1]
        count = often[mine]
        at = np.repeat(start[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(found))
        near = (100 * both >= percent * (sizes + sizes[i] - both)) & (label != label[i])
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def confirmed(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, percent: int, width: int) -> DataFrame:
    """``a, b``, stored: links inside the clusters by the whole sets, enough to connect what all such links connect."""
    clusters = materialize(clusters)
    texts = nodes.select("id", F.col("doc_id").alias("of"), F.col("t1").alias("h1"), F.col("t2").alias("h2"))
    wanted = materialize(clusters.join(texts, "id"))
    few = small_side(wanted)
    read = docs.select(F.col("doc_id").cast("long"), "text", *marks())
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2"))
    held = read.join(few, same).select("cluster", "id", "root", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for part in runs(batches, SLICE_BYTES, lambda batch: batch.nbytes):
            cluster, ids, root = (part.column(i).to_numpy() for i in range(3))
            edges = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(cluster)]
            made, every = [], shingle_sets(part.column(3), width)
            for a, b in zip(edges, edges[1:], strict=False):
                own, first = np.unique(ids[a:b], return_index=True)
                sets_here = [every[a + i] for i in first.tolist()]
                label = np.unique(root[a:b][first], return_inverse=True)[1]
                made += [(own[i], own[j]) for i, j in true_links(sets_here, label, percent)]
            ends = np.array(made, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=schema)

    short_batches(docs.sparkSession)
    dealt = held.repartition("cluster").sortWithinPartitions("cluster")
    return materialize(dealt.mapInArrow(run, "a long, b long"))


def small_side(stored: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, sent to all tasks if it has at most BROADCAST_ROWS."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``node, root``, stored, after more links (``a, b``); None as long as there was no link.

    Only what the links connect is looked at again: they are taken as links
    between roots.
    """
    if links.isEmpty():
        return roots
    if roots is None:
        return materialize(components(links))
    ends = links
    for end in ("a", "b"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    above = materialize(components(ends))
    higher = above.select(F.col("node").alias("root"), F.col("root").alias("_root"))
    old = roots.join(higher, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    new = above.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return materialize(old.unionByName(new))


def grown(nodes: DataFrame, roots: DataFrame | None, *columns: str) -> DataFrame:
    """``id, root`` and ``columns``: the documents with what they are connected to."""
    rows = nodes.select("id", *columns)
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    known = small_side(roots.select(F.col("node").alias("id"), "root"))
    return rows.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))


def small_nodes(large: DataFrame, small: int) -> DataFrame:
    """``node, id, root``: a large node's documents in nodes of usual size, each with the node's first document.

    A group of near copies is connected by this, however large; what it leaves
    apart goes on to the next level.
    """
    n = F.ceil(F.col("n") / (small - 1)).alias("parts")
    rows = large.select("path", "id", "root", "head", F.pmod(F.xxhash64("id"), n).alias("part"))
    heads = large.where("id = head").select("path", "id", "root", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    every = rows.where("id <> head").select("path", "id", "root", "part").unionByName(heads)
    return every.select(F.xxhash64("path", "part").alias("node"), "id", "root")


def all_blocks(large: DataFrame, small: int) -> DataFrame:
    """``node, id, root``: every two documents of a large node in a node of at most usual size."""
    parts = F.ceil(F.col("n") / (small // 4)).alias("parts")
    rows = large.select("path", "id", "root", parts).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    both = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return both.select(F.xxhash64("path", F.least("part", "other"), F.greatest("part", "other")).alias("node"), "id", "root")


class Compared(NamedTuple):
    """``rows`` as stored; ``links`` inside their groups; ``large`` (``path, n, head``): groups that may hold more links."""

    rows: DataFrame
    links: DataFrame
    large: DataFrame


def compared(rows: DataFrame, candidates, confirm, small: int, whole: bool = False) -> Compared:
    """Links inside the groups of ``rows`` (``path, id, root``, and more columns).

    A group with one root is left out. One of at most ``small`` documents is
    compared whole, a larger one in parts with its first document, or with
    ``whole`` every part with every other.
    """
    rows = materialize(rows)
    sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("head"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = materialize(sizes.where("low <> high").select("path", "n", "head"))
    fits = F.col("n") <= small
    members = rows.join(mixed.where(fits).select("path"), "path").select(F.col("path").alias("node"), "id", "root")
    large = mixed.where(~fits)
    if not large.isEmpty():
        more = rows.join(large, "path")
        members = members.unionByName(all_blocks(more, small) if whole else small_nodes(more, small))
    return Compared(rows, confirm(candidates(members)), large)
