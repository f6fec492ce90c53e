"""Language of texts by interpolated Kneser-Ney character models, one for each language.

A null text and one without a letter are ``und`` with score 0, and so is every
text when nothing can be learned. Rows with the same id are separate rows; rows
with a null id are not learned from. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import arrow_filter, arrow_map, shipped, short_batches, slices, texts
from rolecast.session import materialize

UNKNOWN = "und"
ORDER = 4
PAD = ORDER - 1
BLANK = 32
#: Labelled rows for each language that scores and rejection are calibrated on instead of being counted, at most
#: this share of them, and the length of their short cuts.
CALIBRATION_ROWS = 400
CALIBRATION_SHARE = 0.1
SHORT_CUT = 40
#: A text is rejected when it is this many times further off its language than nearly all calibration texts.
SLACK = 3.0
#: No text is rejected that costs less than this more than usual, in bits times the root of its characters.
LEAST_LIMIT = 30.0
#: Characters beyond which a longer text does not make the mean cost surer.
SURE_CHARS = 400
#: Characters looked up at a time, and counted sequences that a task holds before it hands them on.
WINDOW = 1 << 19
HELD_GRAMS = 2_000_000
SLICE_BYTES = 2 << 20


class Letters:
    """Codes of 16 bits for the characters that the models see: lower-case letters and marks, all else a blank."""

    def __init__(self):
        self.code = np.full(0x110000, BLANK, np.uint16)
        self.letter = np.zeros(0x110000, bool)
        for point in range(0x110000):
            kind = unicodedata.category(chr(point))[0]
            if kind in "LM":
                low = chr(point).lower()
                low = ord(low) if len(low) == 1 else point
                self.code[point] = low if low < 0x10000 else 0xE000 + low % 0x1900
                self.letter[point] = kind == "L"

    def read(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of all texts with ``PAD`` blanks before each and runs of blanks as one; starts and ends; has letters."""
        joined = "".join(["\0" * PAD + p for p in parts])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        gaps = np.cumsum([0] + [len(p) + PAD for p in parts])
        code = self.code[points]
        keep = code != BLANK
        keep[1:] |= code[:-1] != BLANK
        for k in range(PAD):
            keep[gaps[:-1] + k] = True
        letters = np.concatenate([[0], np.cumsum(self.letter[points])])
        places = np.concatenate([[0], np.cumsum(keep)])
        return code[keep], places[gaps], letters[gaps[1:]] > letters[gaps[:-1]]


@cache
def letters() -> Letters:
    return Letters()


def grams(code: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The sequence of ``ORDER`` characters that ends at each place from ``begin`` to before ``end``."""
    out = np.zeros(end - begin, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | code[begin - PAD + k : end - PAD + k].astype(np.uint64)
    return out


class SortedHashes:
    """Keys in the order of their hash, with the place where each leading part of a hash begins."""

    def __init__(self, keys: np.ndarray):
        hashed = self.mix(keys)
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange(2**bits + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def mix(keys: np.ndarray) -> np.ndarray:
        """A one-to-one hash of 64 bits."""
        keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in hash order, -1 for those that are not there."""
        hashed = self.mix(keys)
        lead = (hashed >> self.shift).astype(np.int64)
        at, stop = self.first[lead], self.first[lead + 1]
        out = np.full(len(keys), -1, np.int32)
        live = np.flatnonzero(at < stop)
        while len(live):
            here = at[live]
            hit = self.hashes[here] == hashed[live]
            out[live[hit]] = here[hit]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return out


def discount(counts: np.ndarray, ones: int | None = None, twos: int | None = None) -> float:
    ones = int((counts == 1).sum()) if ones is None else ones
    twos = int((counts == 2).sum()) if twos is None else twos
    return ones / (ones + 2 * twos) if ones and twos else 0.75


class KneserNey:
    """One language's model. The longest sequences have their counts, shorter ones the number of their continuations."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ones: int | None = None, twos: int | None = None):
        self.levels = []
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                ones = twos = None
                keys, counts = np.unique(keys & np.uint64(2 ** (16 * order) - 1), return_counts=True)
            d = discount(counts, ones, twos)
            context, at = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(at, counts.astype(np.float64))
            kinds = np.bincount(at)
            found = np.maximum(counts - d, 0) / total[at]
            grams_at, contexts_at = SortedHashes(keys), SortedHashes(context)
            rest = d * kinds / total
            self.levels.append((grams_at, found[grams_at.order], contexts_at, rest[contexts_at.order]))
        self.floor = 1.0 / (len(keys) + 1)

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """Of the last character after those before it."""
        p = np.full(len(keys), self.floor)
        for order in range(1, ORDER + 1):
            grams_at, found, contexts_at, rest = self.levels[ORDER - order]
            part = keys & np.uint64(2 ** (16 * order) - 1) if order < 4 else keys
            at, before = grams_at.find(part), contexts_at.find(part >> np.uint64(16))
            p = np.where(before >= 0, rest[before] * p + np.where(at >= 0, found[at], 0.0), p)
        return np.log2(p)


class Model:
    """All languages: the logarithms of every known sequence in one table, and the calibration."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counted)
        self.letters = letters()
        self.parts = [KneserNey(*counted[x]) for x in self.languages]
        known = np.unique(np.concatenate([counted[x][0] for x in self.languages]))
        self.table = SortedHashes(known)
        known = known[self.table.order]
        self.logs = np.stack([m.log2(known) for m in self.parts], axis=1).astype(np.float32)
        # a language without calibration rows rejects nothing
        self.sharpness, self.usual, self.limit = 1.0, np.full(len(self.languages), np.inf), np.inf

    def costs(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean bits a character for each text and language; characters; whether there is a letter."""
        code, edges, lettered = self.letters.read(parts)
        sums = np.zeros((len(parts), len(self.languages)))
        for begin in range(PAD, len(code), WINDOW):
            end = min(begin + WINDOW, len(code))
            keys = grams(code, begin, end)
            at = self.table.find(keys)
            logs = self.logs[at]
            missing = np.flatnonzero(at < 0)
            if len(missing):
                rare, back = np.unique(keys[missing], return_inverse=True)
                logs[missing] = np.stack([m.log2(rare) for m in self.parts], axis=1)[back]
            total = np.zeros((end - begin + 1, len(self.languages)))
            np.cumsum(logs, axis=0, out=total[1:], dtype=np.float64)
            low = np.clip(edges[:-1] + PAD, begin, end) - begin
            high = np.clip(edges[1:], begin, end) - begin
            sums += np.where((high > low)[:, None], total[high] - total[low], 0.0)
        chars = np.diff(edges) - PAD
        return -sums / np.maximum(chars, 1)[:, None], chars, lettered

    def judge(self, costs: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its calibrated probability, and how far off its usual cost the text is."""
        best = costs.argmin(axis=1)
        odds = np.exp2((costs.min(axis=1)[:, None] - costs) * self.sharpness)
        off = (costs.min(axis=1) - self.usual[best]) * np.sqrt(np.minimum(chars, SURE_CHARS))
        return best, np.round(1 / odds.sum(axis=1), 9), off

    def calibrate(self, rows: list[tuple[str, str]]) -> None:
        """Fit the sharpness of the probabilities and the limit of rejection on labelled (text, language) rows."""
        parts = [t for t, _ in rows] + [t[:SHORT_CUT] for t, _ in rows]
        truth = np.array([self.languages.index(x) for _, x in rows] * 2)
        costs, chars, lettered = self.costs(parts)
        costs, chars, truth = costs[lettered], chars[lettered], truth[lettered]
        if not len(truth):
            return
        own = costs[np.arange(len(truth)), truth]

        def loss(sharpness: float) -> float:
            odds = np.exp2((own[:, None] - costs) * sharpness)
            return float(np.log(odds.sum(axis=1)).mean())

        self.sharpness = min(np.geomspace(0.25, 64, 33), key=loss)
        for i in range(len(self.languages)):
            if (truth == i).any():
                self.usual[i] = np.average(own[truth == i], weights=chars[truth == i])
        off = (own - self.usual[truth]) * np.sqrt(np.minimum(chars, SURE_CHARS))
        self.limit = max(SLACK * float(np.quantile(off, 0.999)), LEAST_LIMIT)


def count_grams(rows: DataFrame) -> DataFrame:
    """``lang, gram, n``: all character sequences of all rows ``lang, text``, combined in the tasks before the shuffle."""
    made = shipped(rows.sparkSession, letters())
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(pairs):
            keys, at = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([c for _, c in pairs])).astype(np.int64)

        def out():
            for lang, pairs in held.items():
                keys, n = merged(pairs)
                for at in range(0, len(keys), 1 << 16):
                    part = keys[at : at + (1 << 16)].view(np.int64)
                    names = pa.array([lang] * len(part), pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(part), pa.array(n[at : at + (1 << 16)])], schema=schema)
            held.clear()

        for batch in slices(batches, limit=SLICE_BYTES):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text or "")
            for lang, parts in by_lang.items():
                code, edges, _ = made().read(parts)
                real = np.ones(len(code), bool)
                for k in range(PAD):
                    real[edges[:-1] + k] = False
                keys = grams(code, PAD, len(code))[real[PAD:]]
                pairs = held.setdefault(lang, [])
                pairs.append(np.unique(keys, return_counts=True))
                if len(pairs) >= 8:
                    held[lang] = [merged(pairs)]
            if sum(len(k) for pairs in held.values() for k, _ in pairs) > HELD_GRAMS:
                yield from out()
        yield from out()

    short_batches(rows.sparkSession)
    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """A model from all ``lang, text`` rows; None if there are none.

    Sequences are counted over all rows but those of the calibration, which are
    chosen by the hash of their text, about ``calibration_rows`` for a language.
    All of them reach the driver, one language after the other, so the model
    grows with the different sequences of the input.
    """
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(0)
    for lang, n in sizes.items():
        part = min(CALIBRATION_SHARE, calibration_rows / n)
        share = F.when(F.col("lang") == lang, int(part * 10_000_000)).otherwise(share)
    apart = F.pmod(F.xxhash64("text"), F.lit(10_000_000)) < share
    counted = materialize(count_grams(labelled.where(~apart)))
    found = {}
    for lang in sorted(r.lang for r in counted.select("lang").distinct().collect()):
        rows = counted.where(F.col("lang") == lang).select("gram", "n").toArrow()
        found[lang] = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    if not found:
        return None
    model = Model(found)
    drawn = labelled.where(apart & F.col("lang").isin(model.languages)).limit(2 * calibration_rows * len(sizes))
    model.calibrate([(r.text, r.lang) for r in drawn.collect()])
    return model


def learnable(docs: DataFrame) -> DataFrame:
    """Rows whose id's crc32 leaves another remainder than 1 by 3; the others are held out."""
    return docs.where(remainder() != 1)


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, cost, rejected``.

    ``cost`` is the mean of bits a character in the chosen language. A text is
    ``rejected`` if it has no letter or costs far more than that language does.
    """
    made = shipped(docs.sparkSession, model)

    def rows(part):
        parts, known = texts(part.column(1)), made()
        if known is None:
            n = len(parts)
            return {"doc_id": part.column(0), "lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "cost": [0.0] * n, "rejected": [True] * n}
        costs, chars, lettered = known.costs(parts)
        best, score, off = known.judge(costs, chars)
        return {
            "doc_id": part.column(0),
            "lang_pred": [known.languages[b] if x else UNKNOWN for b, x in zip(best.tolist(), lettered.tolist(), strict=True)],
            "score": np.where(lettered, score, 0.0),
            "cost": np.where(lettered, costs.min(axis=1), 0.0),
            "rejected": ~lettered | (off > known.limit),
        }

    schema = "doc_id long, lang_pred string, score double, cost double, rejected boolean"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema, SLICE_BYTES)


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` with a model of the rows of ``docs`` that are not held out."""
    return predict(docs, fit(learnable(docs)))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected."""
    made = shipped(docs.sparkSession, model)

    def stays(parts):
        known = made()
        if known is None:
            return [False] * len(parts)
        costs, chars, lettered = known.costs([t or "" for t in parts])
        return lettered & (known.judge(costs, chars)[2] <= known.limit)

    return arrow_filter(docs, stays, limit=SLICE_BYTES)
