"""Token counts of a unigram vocabulary without making the tokens.

A null or empty text has no token. Rows with the same id are separate rows. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import arrow_map, shipped, texts

#: Stands for a blank, and before every text.
MARK = "▁"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers.
CACHE_WORDS = 300_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentence-piece file, without control, byte and unknown pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = (i for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


class Counter(dict):
    """Remembers for each word the pieces of its best path, that path's score, and whether it begins or ends unknown."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.matcher = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matcher.add_word(piece, (len(piece), score))
        self.matcher.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def __reduce__(self):
        return _empty, (self.matcher, self.unknown)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = self.best(word)
        return found

    def best(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through a word.

        Of equal scores the path whose last piece begins first wins, as a later
        one has to be better to replace it. Unknown characters next to each other
        are one piece.
        """
        n = len(word)
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)
        unknown = [False] * (n + 1)
        by_end: dict[int, list[tuple[int, float]]] = {}
        for end, piece in self.matcher.iter(word):
            by_end.setdefault(end + 1, []).append(piece)
        for end in range(1, n + 1):
            best, start, single = None, -1, False
            for size, own in by_end.get(end, ()):  # longest first
                found = score[end - size] + own
                single |= size == 1
                if best is None or found > best:
                    best, start = found, end - size
            if not single:
                found = score[end - 1] + self.unknown
                if best is None or found > best:
                    best, start = found, -1
            score[end] = best
            if start < 0:
                unknown[end] = True
                count[end] = count[end - 1] + (not unknown[end - 1])
            else:
                count[end] = count[start] + 1
        return count[n], score[n]


def _empty(matcher, unknown: float) -> Counter:
    counter = Counter.__new__(Counter)
    counter.matcher, counter.unknown = matcher, unknown
    return counter


def words(text: str) -> list[str]:
    """A text cut before every mark, which stands for a blank and comes before the text."""
    marked = text.replace(" ", MARK)
    if not marked.startswith(MARK):
        marked = MARK + marked
    return [MARK + w for w in marked.split(MARK)[1:]]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, best_score``: pieces and score of each text's best path."""
    made = shipped(docs.sparkSession, Counter(read_pieces(path)))

    def rows(part):
        counter = made()
        counts, scores = [], []
        for text in texts(part.column(1)):
            found = [counter[w] for w in words(text)] if text else []
            counts.append(sum([f[0] for f in found]))
            scores.append(sum([f[1] for f in found]))
        return {"doc_id": part.column(0), "n_tokens": counts, "best_score": [float(s) for s in scores]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_tokens long, best_score double")

