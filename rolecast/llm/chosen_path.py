"""Near-duplicates by a chosen-path set similarity join over shingle sets.

A set without words is linked with nothing, so null and empty texts stay alone
under their own id. Rows with the same set are linked whatever their ids. A null
id is never a component's id unless the component has no other; then all of its
rows count as kept. Rows that share an id are separate rows, and all of them are
kept if the id is that of their component. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import arrow_map
from rolecast.llm.linking import SMALL, candidate_groups, compared, confirmed, every_pair, grown, joined_roots, marks, shingle_sets
from rolecast.session import materialize

WIDTH, PERCENT = 4, 80
#: Minwise tokens of a document. A level of a tree chooses among BLOCK of them; 16 levels use different ones.
TOKENS, BLOCK = 64, 4
#: A pair is compared by its sets if so many tokens agree: at the least similarity fewer do in 2 of 100,000 pairs.
AGREE = 38
#: Share of the pairs at the least similarity that all trees together may miss, at any depth.
MISS = 0.001
#: Trees of the first pass; the others see only nodes that it has not connected.
FIRST_TREES = 2
#: After so many levels a node that is still large is compared in blocks.
LEVELS = 24


def trees(least: float, miss: float = MISS) -> int:
    """How many trees miss at most ``miss`` of the pairs with a similarity of ``least``.

    A node chooses one token or two, equally likely, and each agrees with
    probability ``least``. A pair is lost in a tree if the branching process of
    the nodes that they share dies out; that is the smallest fixed point.
    """
    lost = 0.0
    for _ in range(1_000):
        stay = 1 - least + least * lost
        lost = (stay + stay * stay) / 2
    return ceil(log(miss) / log(lost))


# --- sets ---------------------------------------------------------------------------


def _family() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(11).integers(0, 2**64, (2, TOKENS), np.uint64, endpoint=False)
    return made[0][:, None] | np.uint64(1), made[1][:, None]


TIMES, PLUS = _family()


def minwise(hashes: np.ndarray) -> np.ndarray:
    """TOKENS elements of the set, each the least under an order of its own, named by the lower half of its value there."""
    least = np.full(TOKENS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(hashes), 1_024):
            x = TIMES * hashes[None, start : start + 1_024]
            x += PLUS
            np.minimum(least, x.min(axis=1), out=least)
    return least.astype(np.uint32).view(np.int32)


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, t1, t2, n, key, sig, low``: for each row the size of its set, a hash of it, its minwise tokens, and a byte of each."""

    def rows(part):
        import xxhash

        found = shingle_sets(part.column(1), width)
        tokens = [minwise(x) if len(x) else None for x in found]
        return {
            "doc_id": part.column(0),
            "t1": part.column(2),
            "t2": part.column(3),
            "n": [len(x) for x in found],
            "key": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found],
            "sig": tokens,
            "low": [None if x is None else x.astype(np.uint8).tobytes() for x in tokens],
        }

    read = docs.select(F.col("doc_id").cast("long"), "text", *marks())
    return arrow_map(read, rows, "doc_id long, t1 long, t2 long, n long, key binary, sig array<int>, low binary")


# --- trees --------------------------------------------------------------------------


def children(rows: DataFrame, level: int) -> DataFrame:
    """``tree, path, id, root``: the documents of each node in the nodes that its chosen tokens lead to.

    ``rows`` has ``tree, path, id, root, sig``. Which tokens are chosen depends on
    the path alone, so documents part only where their tokens differ.
    """
    blocks = TOKENS // BLOCK
    first = f"pmod(xxhash64(path, 1), {BLOCK})"
    second = f"pmod({first} + 1 + pmod(xxhash64(path, 2), {BLOCK - 1}), {BLOCK})"
    start = f"{BLOCK} * pmod(2 * tree + {level}, {blocks})"
    step = "xxhash64(path, {at}, get(sig, cast({at} as int)))"
    one, two = (step.format(at=f"({start} + {c})") for c in (first, second))
    both = f"if(pmod(xxhash64(path, 3), 2) = 0, array({one}, {two}), array({one}))"
    return rows.select("tree", F.explode(F.expr(both)).alias("path"), "id", "root")


def tokens_of(columns: list[pa.Array]) -> np.ndarray:
    """A byte of each token: two that differ agree in it once in 256 times."""
    return np.frombuffer(b"".join(columns[0].to_pylist()), np.uint8).reshape(-1, TOKENS)


def alike(sig: np.ndarray, a: np.ndarray, b: np.ndarray, agree: int) -> np.ndarray:
    """Whether at least ``agree`` tokens of the documents a and b are the same."""
    pieces = [(sig[x] == sig[y]).sum(axis=1) >= agree for x, y in zip(*(np.split(z, range(4_096, len(z), 4_096)) for z in (a, b)), strict=True)]
    return np.concatenate(pieces)


def near_roots(
    docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, width: int = WIDTH, small: int = SMALL, agree: int = AGREE, levels: int = LEVELS
) -> DataFrame | None:
    """``node, root`` of the ``nodes`` (``id, sig, low, doc_id, t1, t2``) that are linked; None if none is."""

    def candidates(members):
        return candidate_groups(members, nodes, ["low"], tokens_of, every_pair(lambda sig, a, b: alike(sig, a, b, agree)))

    def confirm(clusters):
        return confirmed(docs, nodes, clusters, percent, width)

    roots = None
    every = list(range(trees(percent / 100)))
    for some in (every[:FIRST_TREES], every[FIRST_TREES:]):
        known = grown(nodes, roots, "sig")
        known = known.withColumn("tree", F.explode(F.array(*map(F.lit, some)))).withColumn("path", F.xxhash64("tree"))
        rows = children(known, 0)
        for level in range(1, levels + 1):
            found = compared(rows, candidates, confirm, small, whole=level == levels)
            roots = joined_roots(roots, found.links)
            if level == levels or found.large.isEmpty():
                break
            below = found.rows.drop("root").join(found.large.select("path"), "path").join(grown(nodes, roots, "sig"), "id")
            rows = children(below, level)
    return roots


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, small: int = SMALL, agree: int = AGREE, levels: int = LEVELS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Rows are linked if their sets of ``width``-word shingles have a Jaccard
    similarity of ``percent`` hundredths or more; every link is confirmed on the
    whole sets. ``component_id`` is the smallest id reachable.
    """
    stored = materialize(sets(docs, width))
    first = F.min_by(F.struct("doc_id", "t1", "t2", "sig", "low"), F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2"))
    nodes = stored.where("key is not null").groupBy("key").agg(first.alias("_row"), F.min("doc_id").alias("least"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("id"), "key", "least", "_row.*"))
    member = grown(nodes, near_roots(docs, nodes, percent, width, small, agree, levels), "key", "least")
    low = member.groupBy("root").agg(F.min("least").alias("component_id"))
    # both sides are read from files, so that a partition with very many copies of a set can be split
    named = materialize(member.join(low, "root").select("key", "component_id"))
    whole = stored.where("key is not null").select("key", "doc_id", "n").join(named, "key").select("doc_id", "n", "component_id")
    none = stored.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return whole.unionByName(none).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
