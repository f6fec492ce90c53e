"""Quality of texts: counted base rules and a calibrated logistic regression on hashed n-grams.

A null or empty text has no word and fails the base rules. Rows with the same id
are separate rows. Without labelled rows of both kinds the base rules decide
alone. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import arrow_filter, arrow_map, shipped, short_batches, slices

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
#: The model's verdict is "keep" from this calibrated probability on.
KEEP_FROM = 0.5
#: Labelled rows of each kind that the model is fitted on, by the hash of their id.
TRAIN_ROWS = 1_500
#: Every so many of these rows is left for the calibration.
CALIBRATE_EVERY = 5
CHAR_BITS = WORD_BITS = 15
DIMENSIONS = (1 << CHAR_BITS) + (1 << WORD_BITS)
#: Parts that a text's score is the sum of: character triples, words, pairs of words.
PARTS = 3
ROUNDS, RATE, SHRINK = 250, 0.05, 1e-5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Mean weights are small numbers; this brings them to the scale of the logistic curve.
SCALE = 30.0


def repeated_words(words: list[bytes], sums: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``width`` words found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = value * np.uint64(0x9E3779B97F4A7C15) + sums[k : k + n]
    order = np.argsort(value, kind="stable")
    equal = value[order][1:] == value[order][:-1]
    if not equal.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][equal]] = maybe[order[:-1][equal]] = True
    places: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(maybe).tolist():  # equal sums must be equal words
        places.setdefault(tuple(words[i : i + width]), []).append(i)
    change = np.zeros(len(words) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            at = np.array(found)
            np.add.at(change, at, 1)
            np.add.at(change, at + width, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


class Read:
    """What both the rules and the model need of a text."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.chars = len(text or "")
        self.words = self.raw.split()
        self.sums = np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words))

    def base(self) -> dict[str, int | bool]:
        n, raw = len(self.words), self.raw
        lines = [x for x in raw.split(b"\n") if x.strip()]
        repeat = repeated_words(self.words, self.sums)
        return {
            "n_words": n,
            "word_chars": self.chars - (len(raw) - len(raw.translate(None, BLANKS))),
            "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": repeat,
            "base_failed": n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n,
        }

    def features(self) -> list[np.ndarray]:
        """The hashed character triples, words and pairs of words, repeats included."""
        codes = np.frombuffer(self.raw, np.uint8).astype(np.uint32)
        triples = codes[:-2] | codes[1:-1] << np.uint32(8) | codes[2:] << np.uint32(16)
        triples = (triples * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)
        pairs = self.sums[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.sums[1:]
        last = np.uint64(64 - WORD_BITS)
        words = [(x * np.uint64(0xBF58476D1CE4E5B9)) >> last for x in (self.sums, pairs)]
        return [triples.astype(np.int64), *((1 << CHAR_BITS) + x.astype(np.int64) for x in words)]


class Model:
    """Weights of the hashed features, and the calibration of their sum."""

    def __init__(self):
        self.weights = np.zeros(DIMENSIONS)
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0
        self.fitted = False

    def raw_score(self, features: list[np.ndarray]) -> float:
        return self.bias + SCALE * sum(float(self.weights[f].mean()) for f in features if len(f))

    def probability(self, features: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw_score(features) + self.shift, -30, 30))))

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """``rows``: label, distinct features and their shares."""
        train = [r for i, r in enumerate(rows) if i % CALIBRATE_EVERY]
        check = rows[::CALIBRATE_EVERY]
        if len({r[0] for r in train}) < 2:
            return
        truth, feature, share, owner = self._flat(train)
        part = np.where(truth == 1, 0.5 / max(truth.sum(), 1), 0.5 / max((1 - truth).sum(), 1))
        first, second = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
        for step in range(1, ROUNDS + 1):
            score = self.bias + np.bincount(owner, self.weights[feature] * share, len(train))
            miss = (1 / (1 + np.exp(-score)) - truth) * part
            slope = np.append(np.bincount(feature, miss[owner] * share, DIMENSIONS) + SHRINK * self.weights, miss.sum())
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
            self.weights -= move[:-1]
            self.bias -= move[-1]
        self.fitted = True
        truth, feature, share, owner = self._flat(check)
        if len(set(truth.tolist())) == 2:
            self._calibrate(self.bias + np.bincount(owner, self.weights[feature] * share, len(check)), truth)

    @staticmethod
    def _flat(rows):
        sizes = [len(r[1]) for r in rows]
        feature = np.concatenate([r[1] for r in rows])
        share = SCALE * np.concatenate([r[2] for r in rows]).astype(np.float64)
        return np.array([r[0] for r in rows], np.float64), feature, share, np.repeat(np.arange(len(rows)), sizes)

    def _calibrate(self, score: np.ndarray, truth: np.ndarray) -> None:
        """Platt scaling with his smoothed targets, by Newton steps on rows that the weights have not seen."""
        good = truth.sum()
        target = np.where(truth == 1, (good + 1) / (good + 2), 1 / (len(truth) - good + 2))

        def loss(a: float, b: float) -> float:
            z = a * score + b
            return float((np.logaddexp(0, z) - target * z).sum())

        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * score + b, -500, 500)))
            curve = p * (1 - p)
            slope = np.array([((p - target) * score).sum(), (p - target).sum()])
            bend = np.array([[(curve * score * score).sum(), (curve * score).sum()], [(curve * score).sum(), curve.sum()]])
            step = np.linalg.solve(bend + 1e-6 * np.eye(2), slope)
            while np.abs(step).max() > 1e-9 and loss(a - step[0], b - step[1]) > loss(a, b):
                step /= 2
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() <= 1e-9:
                break
        if a > 0:
            self.slope, self.shift = float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of at most about ``train_rows`` labelled rows of each kind; a small share of the rows, evenly by id."""
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    model = Model()
    if len(sizes) < 2:
        return model
    share = F.lit(0)
    for kind, n in sizes.items():
        share = F.when(F.col("quality") == kind, int(min(1.0, train_rows / n) * 10_000_000)).otherwise(share)
    drawn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(10_000_000)) < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("feature", pa.binary()), ("share", pa.binary())])

    def run(batches):
        for part in slices(batches):
            out = []
            for key, text, kind in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                parts = Read(text).features()
                feature, at = np.unique(np.concatenate(parts), return_inverse=True)
                weight = np.concatenate([np.full(len(f), 1 / max(len(f), 1)) for f in parts])
                share = np.bincount(at, weight, len(feature)).astype(np.float32)
                out.append((key, int(kind), feature.astype(np.int32).tobytes(), share.tobytes()))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    short_batches(docs.sparkSession)
    found = rows.mapInArrow(run, "doc_id long, quality long, feature binary, share binary").collect()
    found = sorted(found, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.quality, bytes(r.feature)))
    model.fit([(r.quality, np.frombuffer(r.feature, np.int32), np.frombuffer(r.share, np.float32)) for r in found])
    return model


def verdict(model: Model, text: str | None, keep_from: float) -> tuple[dict, float, bool]:
    """Base counts of a text, the probability that its quality is good, and whether it stays."""
    read = Read(text)
    base = read.base()
    good = round(model.probability(read.features()), 9) if model.fitted else 1.0
    return base, good, not base["base_failed"] and good >= keep_from


def assess(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, the probability of good ``quality`` and ``kept``."""
    made = shipped(docs.sparkSession, model)

    def rows(part):
        found = [verdict(made(), text, keep_from) for text in part.column(1).to_pylist()]
        out = {name: [f[0][name] for f in found] for name in BASE}
        return out | {"doc_id": part.column(0), "quality": [f[1] for f in found], "kept": [f[2] for f in found]}

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, kept boolean, quality double"
    )
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


def accepted(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    made = shipped(docs.sparkSession, model)
    return arrow_filter(docs, lambda parts: [verdict(made(), t, keep_from)[2] for t in parts])
