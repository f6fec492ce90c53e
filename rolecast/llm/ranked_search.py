"""Ranked lexical search: impact-sorted posting lists read in order, scores kept as intervals (NRA).

A term is a run of ASCII letters, ASCII digits and characters beyond ASCII, with
A-Z lower-cased. Null and empty texts have no term: such a document is never
found, such an item finds nothing. Rows with the same id are separate rows, of
documents as of items; among equal scores a null id comes last. Empty tables
give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import arrow_map, shipped, short_batches
from rolecast.operators.limits import top_per_group
from rolecast.session import materialize

TOP = 10
#: Items that are looked for in one pass over the documents, and the bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 4 << 20
#: Documents, and postings, of the lists that a task holds at a time.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1 << 20
#: Postings read from each list in the first round; twice as many in each further one.
FIRST_READ = 256

# Fixed values of the score.
SATURATION, BASE, SLOPE, SCALE, WEIGHT = 8, 100, 75, 1_000_000_000, 1_000


def _table() -> bytes:
    kept = (range(48, 58), range(65, 91), range(97, 123), range(128, 256))
    return bytes(b if any(b in r for r in kept) else 32 for b in range(256)).lower()


TERM_BYTES = _table()


def terms(text: bytes) -> list[bytes]:
    """The terms of UTF-8 text in order; every byte beyond ASCII belongs to a term."""
    return text.translate(TERM_BYTES).split()


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n, terms, tfs``: the length of each document and how often it holds the terms of the vocabulary."""
    get = shipped(docs.sparkSession, vocabulary)

    def rows(part):
        place, lengths, held, often, ends = get().get, [], [], [], [0]
        for text in part.column(1).cast(pa.binary()).to_pylist():
            words = terms(text or b"")
            found = Counter(map(place, words))
            found.pop(None, None)
            lengths.append(len(words))
            held.extend(found)
            often.extend(found.values())
            ends.append(len(held))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (held, often)]
        return {"doc_id": part.column(0), "n": lengths, "terms": lists[0], "tfs": lists[1]}

    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    return arrow_map(read, rows, "doc_id long, n long, terms array<int>, tfs array<int>")


class ImpactLists:
    """The postings of some documents: for each term its documents by falling impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def best(self, asked: np.ndarray, weight: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents with the ``k`` highest scores above 0, and the scores; equal scores by ``ids``.

        Every round reads on in each list. What a document's unread terms can
        still add is bounded by the last impact read in their lists. Reading ends
        once no other document can reach the k-th score, and the scores of those
        that can are known exactly.
        """
        here = self.start[asked] < self.start[asked + 1]
        asked, weight = asked[here], weight[here]
        at, end = self.start[asked], self.start[asked + 1]
        lower = np.zeros(self.n_docs, np.int64)
        seen = np.zeros((self.n_docs, len(asked)), bool)
        alive, unmet, size = np.ones(self.n_docs, bool), True, FIRST_READ
        while len(asked):
            to = np.minimum(at + size, end)
            for j, (a, b) in enumerate(zip(at.tolist(), to.tolist(), strict=True)):
                doc, impact = self.doc[a:b], self.impact[a:b]
                if not unmet:
                    stay = alive[doc]
                    doc, impact = doc[stay], impact[stay]
                lower[doc] += weight[j] * impact  # a list holds a document once
                seen[doc, j] = True
            at, size = to, 2 * size
            # a list read to its end adds nothing more
            rest = np.where(at < end, weight * self.impact[np.maximum(at, 1) - 1], 0)
            live = np.flatnonzero(alive & seen.any(axis=1)) if unmet else np.flatnonzero(alive)
            upper = lower[live] + int(rest.sum()) - (seen[live] @ rest.astype(np.float64)).astype(np.int64)
            kth = int(np.partition(lower[live], len(live) - k)[len(live) - k]) if len(live) >= k else 0
            if unmet and int(rest.sum()) < max(kth, 1):
                unmet = False  # no document that was not met can be among the best
            near = live[upper >= max(kth, 1)]
            if not unmet:
                alive[:] = False
                alive[near] = True
            if not unmet and (upper[upper >= max(kth, 1)] == lower[near]).all():
                order = near[np.lexsort((ids[near], -lower[near]))][:k]
                return order, lower[order]
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def shard_best(lists: DataFrame, items: list[Counter], weights: dict[int, int], documents: int, length: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the best ``k`` documents of each item in each shard of the documents."""
    places = sorted(weights)
    local = {t: i for i, t in enumerate(places)}
    asked = []
    for item in items:
        own = [(local[t], often * weights[t]) for t, often in sorted(item.items()) if weights.get(t, 0) > 0]
        asked.append((np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    get = shipped(lists.sparkSession, (asked, np.array(places, np.int64)))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def made(held):
        queries, known = get()
        ids, absent, size = [], [], []
        term, often, sizes = [], [], []
        for b in held:
            ids.append(b.column(0).fill_null(2**63 - 1).to_numpy(zero_copy_only=False))
            absent.append(b.column(0).is_null().to_numpy(zero_copy_only=False))
            size.append(b.column(1).to_numpy())
            term.append(b.column(2).flatten().to_numpy())
            often.append(b.column(3).flatten().to_numpy())
            sizes.append(b.column(2).value_lengths().to_numpy())
        ids, absent, size, term, often, sizes = map(np.concatenate, (ids, absent, size, term, often, sizes))
        doc = np.repeat(np.arange(len(ids)), sizes)
        m = BASE - SLOPE + SLOPE * size.astype(np.int64) * documents // max(length, 1)
        often = often.astype(np.int64)
        impact = SCALE * often // (1_000 * often + SATURATION * m[doc])
        shard = ImpactLists(np.searchsorted(known, term), doc, impact, len(known), len(ids))
        out = [shard.best(t, w, ids, k) for t, w in queries]
        at = np.concatenate([x for x, _ in out]).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(out), dtype=np.int32), [len(x) for x, _ in out])),
                pa.array(ids[at], mask=absent[at]),
                pa.array(np.concatenate([s for _, s in out]).astype(np.int64)),
            ],
            schema=schema,
        )

    def run(batches):
        held, docs, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs, postings = docs + batch.num_rows, postings + len(batch.column(2).flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield made(held)
                held, docs, postings = [], 0, 0
        if docs:
            yield made(held)

    short_batches(lists.sparkSession)
    return lists.mapInArrow(run, "item int, doc_id long, score long")


def item_blocks(items: DataFrame, id_column: str = "item_id") -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items and their terms, a bounded number at a time."""
    block, size = [], 0
    for item, text in items.select(F.col(id_column).cast("long"), "text").toLocalIterator():
        found = terms((text or "").encode())
        if not found:
            continue
        block.append((item, found))
        size += len(text)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` best documents with a score above 0.

    Documents stay where they are: each shard has its own impact-sorted lists of
    the asked terms and gives ``k`` candidates an item, whose best are the answer.
    Counts of documents, lengths and terms are of the whole table.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
        lists = materialize(counted(docs, vocabulary))
        documents, length = lists.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # as many rows as the block has terms
        holding = lists.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = {r["term"]: weight(documents, r["count"]) for r in holding}
        queries = [Counter(vocabulary[t] for t in own) for _, own in block]
        best = shard_best(lists.where("size(terms) > 0"), queries, weights, documents, length, k)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        best = top_per_group(materialize(best), ["item"], order, k, unique=["doc_id"], rank="rank")
        named = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item int, item_id long")
        found = found.unionByName(
            best.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        )
    return found
