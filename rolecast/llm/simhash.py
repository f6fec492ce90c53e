"""Near-duplicates by SimHash fingerprints, linked through BK-trees of shards.

A null or empty text has no shingle and the fingerprint zero, which is linked
like any other. Rows with the same id are separate rows. An empty table gives
an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import arrow_map, texts
from rolecast.llm.components import components
from rolecast.llm.linking import SMALL, candidate_groups, compared, confirmed, grown, join_labels, joined_roots, marks, shingle_sets
from rolecast.session import materialize

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
WORD_BITS = 64
#: Fingerprints of a usual shard, and of the largest shard tree; a larger shard is cut by further bits.
USUAL_ROWS = 128
SHARD_ROWS = 4_096
#: Shard rows that a task takes at a time; a shard goes on until it ends.
HELD_ROWS = 1 << 16
#: Tree visits held at a time in a task.
VISITS = 1 << 16

#: Texts are near copies if the Jaccard similarity of their sets of five-word shingles is at least so many hundredths.
LIKE_WIDTH, LIKE_PERCENT = 5, 80
#: Share of the pairs at exactly that similarity that no band of their fingerprints may bring together.
LIKE_MISS = 0.001
#: A bit of the fingerprints of two such sets differs with this probability at most: acos(2s / (1 + s)) / pi = 0.151
#: for large sets, 3/16 for one of four shingles and one of five. It depends on the sets only, not on where they differ.
LIKE_DIFFERS = 3 / 16
#: Bands that are looked at first.
FIRST_BANDS = 4
#: Radius of the BK-trees: of 128 further bits so many may differ in a pair that is compared; 24 do on average at most,
#: with a deviation of 4.4.
LIKE_CHECK_BITS = 42


# --- fingerprints -------------------------------------------------------------------


def shingles(text: str, width: int) -> list[bytes]:
    """The shingles of a text with A-Z lower-cased, repeats included; one of all words if they are fewer."""
    words = text.encode().lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return [joined[s:e] for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(digests: list[bytes], size: int) -> bytes:
    """``size`` bytes; a bit is 1 if it is set in over half the digests."""
    if not digests:
        return bytes(size)
    rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, size)
    ones = np.zeros(8 * size, np.int64)
    for start in range(0, len(rows), 65_536):
        ones += np.unpackbits(rows[start : start + 65_536], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).tobytes()


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """64 bits from the XXH64 of the shingles."""
    import xxhash

    return int.from_bytes(majority([xxhash.xxh64_digest(s, SEED) for s in shingles(text, width)], 8), "big")


def check_fingerprint(text: str, width: int) -> bytes:
    """128 bits from the XXH3 of the shingles."""
    import xxhash

    return majority([xxhash.xxh3_128_digest(s, SEED) for s in shingles(text, width)], 16)


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, check_width: int | None = None) -> DataFrame:
    """``doc_id, tag, fp, node``: a hash of the text, its fingerprint as a signed number, and as bytes with the check bits."""

    def rows(part):
        found = texts(part.column(1))
        fps = [fingerprint(t, width) for t in found]
        more = [check_fingerprint(t, check_width) for t in found] if check_width else [b""] * len(found)
        return {
            "doc_id": part.column(0),
            "tag": part.column(2),
            "fp": np.array(fps, np.uint64).view(np.int64),
            "node": [fp.to_bytes(8, "big") + m for fp, m in zip(fps, more, strict=True)],
        }

    read = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tag"))
    return arrow_map(read, rows, "doc_id long, tag long, fp long, node binary")


def shown(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- shards -------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(bits: list[int], radius: int, agreeing: int) -> list[int]:
    """Masks of ``agreeing`` out of ``radius + agreeing`` blocks of ``bits``.

    Two words that differ in at most ``radius`` bits are equal under at least one of them.
    """
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(bits, radius + agreeing)]
    return [_signed(sum(chosen)) for chosen in combinations(blocks, agreeing)]


def agreeing_blocks(rows: int, radius: int, usual: int = USUAL_ROWS) -> int:
    """How many blocks have to agree for a shard of evenly spread fingerprints to have at most ``usual`` rows."""
    bits = log2(max(rows / usual, 1))
    return next((k for k in range(1, 4) if WORD_BITS * k / (radius + k) >= bits), 4)


def shards(nodes: DataFrame, radius: int, agreeing: int, limit: int = SHARD_ROWS) -> DataFrame:
    """``mask, part, node``: every node in each shard that holds it and at least one other.

    A shard with more than ``limit`` nodes is cut again by blocks of the bits
    that it leaves free, which loses no pair within the radius, until it fits or
    too few bits are free.
    """
    masks = block_masks(list(range(WORD_BITS)), radius, agreeing)
    rows = nodes.select("node", "fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    done = None
    while True:
        rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = materialize(rows.groupBy("mask", "part").agg(F.count("*").alias("hold")).where("hold > 1"))
        narrow = [m for m in masks if WORD_BITS - (m & (2**64 - 1)).bit_count() <= radius]
        fits = (F.col("hold") <= limit) | F.col("mask").isin(narrow)
        kept = rows.join(sizes.where(fits), ["mask", "part"], "left_semi").select("mask", "part", "node")
        done = kept if done is None else done.unionByName(kept)
        large = sizes.where(~fits)
        if large.isEmpty():
            return done
        children = {}
        for m in set(masks) - set(narrow):
            free = [b for b in range(WORD_BITS) if not (m >> b) & 1]
            cuts = block_masks(free, radius, 1) if len(free) > radius else []
            children[m] = [_signed((m | c) & (2**64 - 1)) for c in cuts]
        hot = rows.join(large.select("mask", "part"), ["mask", "part"], "left_semi")
        below = F.create_map(*[x for m, c in children.items() for x in (F.lit(m), F.array(*map(F.lit, c)))])
        rows = hot.select("node", "fp", F.explode(below[F.col("mask")]).alias("mask")).distinct()
        masks = sorted({c for cs in children.values() for c in cs})


# --- trees --------------------------------------------------------------------------


class ShardTrees:
    """BK-trees of many shards in arrays: a child hangs from its parent by their Hamming distance.

    ``shard`` numbers the shard of each fingerprint, in order; ``words`` are the
    fingerprints, an array for each 64 bits. All trees are built and followed
    together, one level at a time.
    """

    def __init__(self, shard: np.ndarray, *words: np.ndarray):
        n = len(shard)
        self.words, self.width = words, WORD_BITS * len(words) + 1
        self.root = np.searchsorted(shard, shard)  # the first of a shard is its root
        rest = np.flatnonzero(self.root != np.arange(n))
        at = self.root[rest]
        keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(rest):
            key = at * self.width + self.distance(rest, at)
            order = np.argsort(key, kind="stable")
            first = np.ones(len(order), bool)
            first[1:] = key[order][1:] != key[order][:-1]
            children = rest[order][first]
            keys.append(key[order][first])
            nodes.append(children)
            parent = children[np.cumsum(first) - 1]  # the child that each goes on from
            below = ~first
            rest, at = rest[order][below], parent[below]
        key = np.concatenate(keys)
        self.child = np.concatenate(nodes)[np.argsort(key)]
        # the children of a node by their distance: where those of each distance begin
        self.first = np.zeros(n * self.width + 1, np.int32)
        np.cumsum(np.bincount(key, minlength=n * self.width), out=self.first[1:])

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.zeros(len(a), np.int64)
        for word in self.words:
            found += np.bitwise_count(word[a] ^ word[b])
        return found

    def within(self, radius: int):
        """All pairs of a shard with at most ``radius`` differing bits, each once, in pieces.

        Each fingerprint asks for those before it. What hangs below a node comes
        after it, so nothing is followed beyond the asking one.
        """
        every = np.arange(len(self.root))
        stack = [(every, self.root)]
        while stack:
            q, node = stack.pop()
            if len(q) > VISITS:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            before = node < q
            q, node = q[before], node[before]
            d = self.distance(q, node)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            # follow only edges whose distance is within the radius of this one
            edge = node * self.width
            lo = self.first[edge + np.maximum(d - radius, 0)]
            count = self.first[edge + np.minimum(d + radius, self.width - 1) + 1] - lo
            total = int(count.sum())
            if total:
                start = np.repeat(lo - np.cumsum(count) + count, count)
                stack.append((np.repeat(q, count), self.child[start + np.arange(total)]))


def shard_links(shard: np.ndarray, node: np.ndarray, radius: int, check_bits: int | None):
    """For each node that is linked inside its shard: its place, and that of the first of its component there."""
    words = node.view(">u8").astype(np.uint64)
    trees, label = ShardTrees(shard, np.ascontiguousarray(words[:, 0])), np.arange(len(node))
    for a, b in trees.within(radius):
        if check_bits is not None:
            differ = np.bitwise_count(words[a, 1:] ^ words[b, 1:]).sum(axis=1, dtype=np.int64)
            a, b = a[differ <= check_bits], b[differ <= check_bits]
        label = join_labels(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(node)))
    return moved, label[moved]


def links(nodes: DataFrame, radius: int, check_bits: int | None = None, limit: int = SHARD_ROWS) -> DataFrame:
    """``a, b``: links between distinct nodes whose components are those of all pairs within the radius.

    Shards go to tasks by a shuffle, as all trees together grow with the data
    and must not be broadcast. A component inside a shard gives one link for each
    of its members, not all pairs.
    """
    rows = shards(nodes, radius, agreeing_blocks(nodes.count(), radius), limit)
    dealt = rows.repartition("mask", "part").sortWithinPartitions("mask", "part")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def made(mask, part, raw):
        new = np.ones(len(mask), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])
        a, b = shard_links(np.cumsum(new), np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), radius, check_bits)
        ends = [pa.array([raw[i] for i in x.tolist()], pa.binary()) for x in (a, b)]
        return pa.RecordBatch.from_arrays(ends, schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < HELD_ROWS:
                continue
            mask, part, raw = columns(held)
            # the last shard may go on in the next batch
            ended = np.flatnonzero((mask != mask[-1]) | (part != part[-1]))
            n = int(ended[-1]) + 1 if len(ended) else 0
            if n:
                yield made(mask[:n], part[:n], raw[:n])
            held = [pa.concat_batches(held).slice(n)]
        if sum(b.num_rows for b in held):
            yield made(*columns(held))

    def columns(held):
        mask, part = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        return mask, part, [x for b in held for x in b.column(2).to_pylist()]

    return dealt.mapInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    width: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    check_width: int | None = None,
    check_bits: int | None = None,
    limit: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id, tag, fp, component, component_id`` for each row.

    Rows are linked if their fingerprints differ in at most ``radius`` bits and,
    where asked for, their check bits in at most ``check_bits``. ``component_id``
    is the smallest id reachable over any number of links, ``component`` a name
    of what is reachable. Rows with the same fingerprint are one node, so a text
    with very many copies costs no more than one.
    """
    stored = materialize(fingerprints(docs, width, check_width))
    nodes = materialize(stored.groupBy("node", "fp").agg(F.min("doc_id").alias("least")))
    roots = materialize(components(links(nodes.select("node", "fp"), radius, check_bits, limit)))
    member = nodes.join(roots, "node")
    low = member.groupBy("root").agg(F.min("least").alias("low"))
    linked = member.join(low, "root").select("node", "root", "low")
    named = nodes.join(linked, "node", "left").select(
        "node",
        F.coalesce("root", "node").alias("component"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("low")).alias("component_id"),
    )
    # both sides are read from files, so that a partition with very many copies of a text can be split
    return stored.join(materialize(named), "node").select("doc_id", "tag", "fp", "component", "component_id")


# --- near copies by the similarity itself ---------------------------------------------


def like_bands(rows: int, usual: int = USUAL_ROWS) -> tuple[int, int]:
    """Bits of a band and number of bands: ``usual`` of evenly spread rows share a band, and LIKE_MISS holds."""
    bits = max(8, ceil(log2(max(rows / usual, 1))))
    return bits, ceil(log(LIKE_MISS) / log(1 - (1 - LIKE_DIFFERS) ** bits))


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``64 * words`` bits as 0 and 1: each is 1 if more than half of the shingles have it in their hash."""
    with np.errstate(over="ignore"):
        seeds = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ones = np.zeros(64 * words, np.int64)
        for start in range(0, len(hashes), 2_048):
            x = hashes[start : start + 2_048, None] + seeds
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint16)
    return (2 * ones > len(hashes)).astype(np.uint8)


def like_rows(docs: DataFrame, bits: int, bands: int) -> DataFrame:
    """``doc_id, t1, t2, key, c1, c2, keys``: for each row a hash of its set, the check bits, and the bands' keys."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def rows(part):
        import xxhash

        key, checks, keys = [], [], []
        for hashes in shingle_sets(part.column(1), LIKE_WIDTH):
            found = wide_fingerprint(hashes, 2 + -(-bits * bands // 64))
            key.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            checks.append(np.packbits(found[:128]))
            keys.append((np.arange(bands) << 32) + found[128 : 128 + bits * bands].reshape(bands, bits) @ weights)
        checks = np.array(checks, np.uint8).reshape(-1, 16).view(np.int64)
        return {
            "doc_id": part.column(0),
            "t1": part.column(2),
            "t2": part.column(3),
            "key": key,
            "c1": np.ascontiguousarray(checks[:, 0]),
            "c2": np.ascontiguousarray(checks[:, 1]),
            "keys": [k.tolist() for k in keys],
        }

    read = docs.select(F.col("doc_id").cast("long"), "text", *marks())
    return arrow_map(read, rows, "doc_id long, t1 long, t2 long, key binary, c1 long, c2 long, keys array<long>")


def check_words(columns: list[pa.Array]) -> list[np.ndarray]:
    return [c.to_numpy().view(np.uint64) for c in columns]


def like_pairs(shard: np.ndarray, root: np.ndarray, checks: list[np.ndarray]):
    """Pairs of one shard, not connected yet, that its BK-tree has within LIKE_CHECK_BITS of each other."""
    for a, b in ShardTrees(shard, *checks).within(LIKE_CHECK_BITS):
        apart = root[a] != root[b]
        yield a[apart], b[apart]


def like_copies(docs: DataFrame, percent: int = LIKE_PERCENT, small: int = SMALL) -> DataFrame:
    """``doc_id, tag, component`` for each row: texts are linked if their shingle sets have a similarity of ``percent``.

    A band of the fingerprint is a shard, as in :func:`links`. Its BK-tree gives
    the texts whose check bits differ in few places, and those are compared by
    their sets, so no pair below ``percent`` is linked; LIKE_MISS is the share of
    those at LIKE_PERCENT that is lost, and above it is less. The first bands
    connect most copies; the others see only bands that hold texts not connected
    yet. Texts with the same set are one node.
    """
    bits, bands = like_bands(docs.count())
    stored = materialize(like_rows(docs, bits, bands))
    first = F.min_by(F.struct("doc_id", "t1", "t2", "c1", "c2", "keys"), F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2"))
    nodes = stored.groupBy("key").agg(first.alias("_row"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("id"), "key", "_row.*"))

    def candidates(members):
        return candidate_groups(members, nodes, ["c1", "c2"], check_words, like_pairs)

    def confirm(clusters):
        return confirmed(docs, nodes, clusters, percent, LIKE_WIDTH)

    roots = None
    for start, number in ((0, FIRST_BANDS), (FIRST_BANDS, bands - FIRST_BANDS)):
        known = grown(nodes, roots, "keys")
        rows = known.select("id", "root", F.explode(F.slice("keys", start + 1, number)).alias("path"))
        found = compared(rows, candidates, confirm, small)
        roots = joined_roots(roots, found.links)
        if not found.large.isEmpty():
            # what its first document and its part have not connected
            rest = found.rows.drop("root").join(found.large.select("path"), "path").join(grown(nodes, roots), "id")
            roots = joined_roots(roots, compared(rest, candidates, confirm, small, whole=True).links)
    named = grown(nodes, roots, "key").select("key", F.col("root").alias("component"))
    return stored.select("doc_id", F.col("t1").alias("tag"), "key").join(materialize(named), "key").select("doc_id", "tag", "component")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` but one of each component that ``found`` names: that with the smallest id.

    Null ids come last. Of rows that share id and text one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tag").alias("mark")))
    stay = found.groupBy("component").agg(first.alias("first")).select("first.id", "first.mark")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("tag"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("mark"))
    kept = rows.withColumn("doc_id", F.col("row.doc_id")).join(stay, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "tag"]).select("row.*")
