"""Best-fit packing of tokenised documents into sequences of a fixed length.

A null text is empty and has the closing id only. Rows with the same id are
separate rows. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecast.llm.bpe import encoder
from rolecast.llm.common import arrow_map, shipped, shuffle_partitions, texts
from rolecast.session import materialize

CAPACITY = 1024
END_ID = 2
#: Slices of one length for each shuffle partition, so that no task numbers all pieces of a frequent length.
SLICES_PER_PARTITION = 1


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: the ids of every document, cut where they are too long.

    All pieces but the first have ``capacity`` ids. ``ids`` (little-endian
    unsigned 32-bit numbers) is null without ``with_ids``.
    """
    coder = shipped(docs.sparkSession, encoder(path))

    def rows(part):
        out = defaultdict(list)
        keys = part.column(0).to_pylist()
        for key, ids in zip(keys, coder().encode(texts(part.column(1))), strict=True):
            whole = np.append(ids, end_id).astype("<u4")
            ends = range(len(whole) % capacity or capacity, len(whole) + 1, capacity)
            start = 0
            for piece, end in enumerate(ends):
                raw = whole[start:end].tobytes()
                out["doc_id"].append(key)
                out["piece"].append(piece)
                out["start"].append(start)
                out["length"].append(end - start)
                out["ids_crc32"].append(zlib.crc32(raw))
                out["ids"].append(raw if with_ids else None)
                start = end
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for ``counts[length]`` items, as (number of equal bins, [(length, items of it), ...]).

    Lengths above a third of the capacity fit at most two to a bin: the longest
    one left is matched with the longest that still fits. All others go, longest
    first, where they leave the least room. Equal bins are handled together, so
    the work depends on the number of lengths, not of items.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    gaps: list[int] = []

    def put(bins: int, held: list[tuple[int, int]], gap: int) -> None:
        if bins:
            if not room[gap]:
                insort(gaps, gap)
            room[gap].append((bins, held))

    left = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    sizes = sorted(left)
    while sizes:
        n = sizes[-1]
        fits = bisect_left(sizes, capacity - n + 1) - 1
        partner = sizes[fits] if fits >= 0 else None
        if partner is None:
            put(left[n], [(n, 1)], capacity - n)
            left[n] = 0
        elif partner == n:
            put(left[n] // 2, [(n, 2)], capacity - 2 * n)
            left[n] %= 2
            if left[n]:
                below = sizes[-2] if len(sizes) > 1 else None
                put(1, [(n, 1)] + ([(below, 1)] if below else []), capacity - n - (below or 0))
                left[n] = 0
                if below:
                    left[below] -= 1
        else:
            both = min(left[n], left[partner])
            put(both, [(n, 1), (partner, 1)], capacity - n - partner)
            left[n] -= both
            left[partner] -= both
        sizes = [s for s in sizes if left[s]]

    for n in sorted((n for n in counts if 3 * n <= capacity and counts[n]), reverse=True):
        c = counts[n]
        while c:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                gap, bins, held = capacity, -(-c // (capacity // n)), []
            else:
                gap = gaps[at]
                bins, held = room[gap].pop()
                if not room[gap]:
                    gaps.pop(at)
            each = gap // n
            full = min(bins, c // each)
            put(full, [*held, (n, each)], gap - each * n)
            c -= full * each
            if full < bins:
                if c:
                    put(1, [*held, (n, c)], gap - c * n)
                    bins -= 1
                    c = 0
                if held:
                    put(bins - full, held, gap)
    return [x for gap in gaps for x in room[gap]]


def segments(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length where the items of each rank go: (first rank, items to a bin, place in the bin, first bin)."""
    out, used, first_bin = defaultdict(list), defaultdict(int), 0
    for number, held in bins:
        place = 0
        for n, each in held:
            out[n].append((used[n], each, place, first_bin))
            used[n] += number * each
            place += n * each
        first_bin += number
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; they need ``doc_id, piece, length`` and no null length.

    Only the number of pieces of each length, at most ``capacity`` numbers, goes
    through the driver. Pieces of a length are numbered in slices.
    """
    spark = pieces.sparkSession
    slices = SLICES_PER_PARTITION * shuffle_partitions(spark)
    cut = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    sizes = materialize(cut.groupBy("length", "_slice").agg(F.count("*").alias("_count")))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_slice", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    plan = [(n, [list(x) for x in rows]) for n, rows in segments(pack_lengths(counts, capacity)).items()]
    places = spark.createDataFrame(plan, "length long, _places array<array<long>>")
    order = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece")
    ranked = cut.withColumn("_rank", F.row_number().over(order) - 1).join(starts, ["length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_start"))
    found = ranked.join(F.broadcast(places), "length").withColumn(
        "_at", F.expr("get(_places, size(filter(_places, p -> p[0] <= _rank)) - 1)")
    )
    step = F.col("_rank") - F.col("_at")[0]
    each = F.col("_at")[1]
    return found.select(
        *pieces.columns,
        (F.col("_at")[3] + F.floor(step / each)).cast("long").alias("sequence_id"),
        (F.col("_at")[2] + F.col("length") * (step % each)).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The documents' pieces, each with its sequence and its place there. They are tokenised once and stored."""
    return place(materialize(token_pieces(docs, path, capacity, end_id, with_ids)), capacity)
