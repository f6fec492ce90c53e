"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton accepts exactly the token sequences that the merges produce. It is
made from the automaton of single bytes by one gadget for each merge. A null
text is empty and has no token. Rows with the same id are separate rows. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import arrow_map, shipped, texts

#: Fixed value: the published pattern that cuts a text into words before merging.
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, BLANK = 1, 2, 3, 4
#: Longer words, in bytes, are encoded one by one, in time in proportion to their length.
LONG_WORD = 48
#: Characters of different words that a task remembers; longer words than LONG_WORD are not remembered.
CACHE_CHARS = 6_000_000
#: Characters worked on at a time.
CHUNK = 1 << 19


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary, by the published rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What the encoder needs of a tokenizer file: arc labels, merges in order, special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {k: i for k, i in model["vocab"].items() if k not in self.special}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.labels = [b""] * self.size
        for token, i in self.ids.items():
            self.labels[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.labels[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.bytes = [self.ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]

    def __getstate__(self):
        """Tasks need labels and special tokens only."""
        return {"labels": self.labels, "special": self.special, "size": self.size}


class Automaton:
    """States and arcs: ``allowed[state[t], column[t2]]`` says whether token t2 may follow token t.

    The state after a token depends on the token alone. State 0 is the start.
    Tokens whose arcs are alike share a state, and tokens that the same states
    allow share a column, until a merge tells them apart.
    """

    def __init__(self, vocabulary: Vocabulary):
        size = vocabulary.size
        self.state = np.zeros(size, np.int32)
        self.column = np.full(size, 1, np.int32)  # column 1: never allowed
        self.column[vocabulary.bytes] = 0
        # a bit for each state and column
        allowed = np.zeros((16_384, 128), np.uint8)
        allowed[0, 0] = 128
        rows, columns = 1, 2
        row_users, column_users = [257], [256, size]
        state, column = self.state.tolist(), self.column.tolist()
        for u, v, w in vocabulary.merges:
            if not (allowed[state[u], column[v] >> 3] >> (7 - (column[v] & 7))) & 1:
                continue  # u is never followed by v, so the merge never applies
            # an arc over w ends where the arc over v does
            state[w] = state[v]
            row_users[state[v]] += 1
            if row_users[state[u]] > 1:
                if rows == allowed.shape[0]:
                    allowed = np.concatenate([allowed, np.zeros_like(allowed[: rows // 2])])
                allowed[rows] = allowed[state[u]]
                row_users[state[u]] -= 1
                row_users.append(1)
                state[u], rows = rows, rows + 1
            # the state after u gives up its arc over v
            if column_users[column[v]] > 1:
                if columns == 8 * allowed.shape[1]:
                    allowed = np.concatenate([allowed, np.zeros_like(allowed[:, : columns // 16])], axis=1)
                c = column[v]
                bits = (allowed[:rows, c >> 3] >> (7 - (c & 7))) & 1
                allowed[:rows, columns >> 3] |= bits << (7 - (columns & 7))
                column_users[c] -= 1
                column_users.append(1)
                column[v], columns = columns, columns + 1
            allowed[state[u], column[v] >> 3] &= 255 ^ (128 >> (column[v] & 7))
            # every state with an arc over u gets one over w
            column_users[1] -= 1
            column[w] = column[u]
            column_users[column[u]] += 1
        self.state, self.column = np.array(state, np.int32), np.array(column, np.int32)
        self.allowed = allowed[:rows, : (columns + 7) // 8].copy()

    def allows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        column = self.column[token]
        return (self.allowed[state, column >> 3] >> (7 - (column & 7))) & 1


class Trie:
    """The tokens' bytes: ``step[node, byte]`` is the next node or -1, ``token[node]`` the token there or -1."""

    def __init__(self, vocabulary: Vocabulary):
        special = set(vocabulary.special.values())
        known: dict[bytes, int] = {b"": 0}
        tokens, edges = [-1], []
        for t, label in enumerate(vocabulary.labels):
            if t in special or not label:
                continue
            for i in range(1, len(label) + 1):
                if label[:i] not in known:
                    known[label[:i]] = len(tokens)
                    edges.append((known[label[: i - 1]], label[i - 1], len(tokens)))
                    tokens.append(-1)
            tokens[known[label]] = t
        self.token = np.array(tokens, np.int32)
        self.edges = np.array(edges, np.int32)
        self._spread()

    def _spread(self):
        parent, byte, child = self.edges.T
        parents = np.unique(parent)
        self.inner = np.full(len(self.token), -1, np.int32)  # rows only for nodes that go on
        self.inner[parents] = np.arange(len(parents))
        self.table = np.full((len(parents) + 1, 256), -1, np.int32)  # the last row for nodes that do not
        self.table[self.inner[parent], byte] = child

    def __getstate__(self):
        return self.token, self.edges

    def __setstate__(self, state):
        self.token, self.edges = state
        self._spread()


def char_classes() -> np.ndarray:
    """The class of every code point, by the pattern's own character classes."""
    points = [chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000)]
    text = "".join(points)
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = OTHER
    return out


def word_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which places begin a word of the pattern; ``kinds`` is 0 between texts, and at both ends."""
    start = np.zeros(len(points), bool)
    new = np.zeros(len(points), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[0] = True
    solid = (kinds != BLANK) & new
    first = np.flatnonzero(solid)
    word = kinds[first] != 0
    led = word & (first > 0) & (points[first - 1] == 0x20)  # a single blank goes with what follows it
    start[first[led] - 1] = True
    start[first[~led]] = True
    blank = np.flatnonzero((kinds == BLANK) & new)
    start[blank] = True
    # the last blank of a run is on its own unless the text ends there
    after = first[word & (first > 0) & (kinds[first - 1] == BLANK)]
    start[after - 1] = True
    # contractions where an apostrophe begins a word
    quote = np.flatnonzero((points == 0x27) & start)
    for tail in CONTRACTIONS:
        n = len(tail)
        quote_in = quote[quote + n < len(points)]
        fits = np.ones(len(quote_in), bool)
        for k, c in enumerate(tail):
            fits &= points[quote_in + 1 + k] == ord(c)
        at = quote_in[fits]
        start[at + 1] = False
        start[at + 1 + n] = True
    start[kinds == 0] = True
    return start


class Spellings:
    """Numbers for words, found by a hash and compared letter by letter.

    The hashes are in two sorted runs, of which the short one takes what is new.
    """

    def __init__(self):
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.points = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def find(self, keys: np.ndarray, points: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word (``sizes`` points from ``at``), -1 for those that are not known; whose hash is taken."""
        number = np.full(len(keys), -1, np.int64)
        for hashes, numbers in self.runs:
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
                hit = hashes[place] == keys
                number[hit] = numbers[place[hit]]
        known, taken = np.flatnonzero(number >= 0), number >= 0
        begin = self.starts[number[known]]
        odd = self.starts[number[known] + 1] - begin != sizes[known]
        number[known[odd]] = -1
        known, begin = known[~odd], begin[~odd]
        n = sizes[known]
        if n.sum():
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = points[np.repeat(at[known], n) + step] == self.points[np.repeat(begin, n) + step]
            number[known[~np.logical_and.reduceat(same, np.cumsum(n) - n)]] = -1
        return number, taken & (number < 0)

    def add(self, keys: np.ndarray, taken: np.ndarray, points: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        """Remember words under the next numbers, in order; one whose hash is taken is never found."""
        base = len(self.starts) - 1
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.points = np.concatenate([self.points, points[np.repeat(at, sizes) + step]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        fresh, numbers = keys[~taken], base + np.flatnonzero(~taken)
        long, short = self.runs
        short = tuple(np.concatenate(x) for x in zip(short, (fresh, numbers), strict=True))
        if len(short[0]) > len(long[0]) // 8:
            long, short = tuple(np.concatenate(x) for x in zip(long, short, strict=True)), tuple(x[:0] for x in short)
            order = np.argsort(long[0], kind="stable")
            long = tuple(x[order] for x in long)
        else:
            order = np.argsort(short[0], kind="stable")
            short = tuple(x[order] for x in short)
        self.runs = [long, short]


class Encoder:
    """Encodes and decodes texts; made once from a tokenizer file and broadcast."""

    def __init__(self, text: str):
        self.vocabulary = Vocabulary(text)
        self.automaton = Automaton(self.vocabulary)
        self.trie = Trie(self.vocabulary)
        self.kinds = char_classes()
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self._reset()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._reset()

    def _reset(self):
        self._known = Spellings()
        self._ids = np.zeros(0, np.int32)
        self._offsets = np.zeros(1, np.int64)
        self._powers = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, owner, ids = [], [], []  # id -1: text to encode, else a special token

        def put(text: str, special: int = -1) -> None:
            parts.append(text)
            owner.append(i)
            ids.append(special)

        for i, text in enumerate(texts):
            at = 0
            for m in self.special.finditer(text) if self.special is not None else ():
                if m.start() > at:
                    put(text[at : m.start()])
                put("", self.vocabulary.special[m.group()])
                at = m.end()
            if at < len(text):
                put(text[at:])
        found: list[list[np.ndarray]] = [[] for _ in texts]
        begin = 0
        while begin < len(parts):
            end, held = begin, 0
            while end < len(parts) and (end == begin or held + len(parts[end]) < CHUNK):
                held += len(parts[end]) + 1
                end += 1
            for i, one in enumerate(self._encode_plain(parts[begin:end]), begin):
                found[owner[i]].append(one if ids[i] < 0 else np.array([ids[i]], np.int32))
            begin = end
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.int32) for x in found]

    def decode(self, ids: np.ndarray) -> str:
        """The arc labels of the ids, put together."""
        labels = self.vocabulary.labels
        return b"".join([labels[i] for i in ids.tolist()]).decode("utf-8", "replace")

    def _encode_plain(self, parts: list[str]) -> list[np.ndarray]:
        text = "\0" + "\0".join(parts) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[points]
        gaps = np.cumsum([0] + [len(p) + 1 for p in parts])
        kinds[gaps] = 0
        starts = np.flatnonzero(word_starts(points, kinds))
        sizes = np.diff(starts, append=len(points))
        real = kinds[starts] != 0
        starts, sizes = starts[real], sizes[real]
        inverse, first, keys = self._distinct(points, kinds, starts, sizes)
        begin, lengths, store = self._places(text, points, starts[first], sizes[first], keys)
        begin, lengths = begin[inverse], lengths[inverse]
        ends = np.cumsum(lengths)
        shift = np.repeat((begin - ends + lengths).astype(np.int32), lengths)
        flat = store[shift + np.arange(len(shift), dtype=np.int32)]
        edges = np.searchsorted(starts, gaps)
        bounds = np.concatenate([[0], ends])[edges]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _distinct(self, points: np.ndarray, kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """For each word the number of its spelling; where each spelling occurs first; and its hash."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if self._powers is None or len(self._powers[0]) < len(points) + 1:
            step = np.full(max(len(points) + 1, CHUNK + 2), 0x9E3779B97F4A7C15, np.uint64)
            back = np.full(len(step), pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64)
            step[0] = back[0] = 1
            self._powers = np.cumprod(step), np.cumprod(back)
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed * self._powers[0][: len(points)], out=sums[1:])
        value = (sums[starts + sizes] - sums[starts]) * self._powers[1][starts] * np.uint64(2) + sizes.astype(np.uint64)
        keys, first, inverse = np.unique(value, return_index=True, return_inverse=True)
        # equal sums must be equal words
        away = np.repeat((starts[first][inverse] - starts).astype(np.int32), sizes)
        places = np.flatnonzero(kinds).astype(np.int32)
        same = points[places] == points[places + away]
        if (sizes != sizes[first][inverse]).any() or not same.all():
            seen: dict[bytes, int] = {}
            spelt = [points[s : s + n].tobytes() for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            inverse = np.array([seen.setdefault(x, len(seen)) for x in spelt])
            first = np.unique(inverse, return_index=True)[1]
            keys = value[first]
        return inverse, first, keys

    def _places(self, text: str, points: np.ndarray, at: np.ndarray, sizes: np.ndarray, keys: np.ndarray):
        """Where the ids of each word begin in an array of ids, how many they are, and the array."""
        if len(self._known.points) > CACHE_CHARS:
            powers = self._powers
            self._reset()
            self._powers = powers
        number, taken = self._known.find(keys, points, at, sizes)
        new = np.flatnonzero(number < 0)
        kept = sizes[new] <= LONG_WORD
        # those that are remembered first
        new = np.concatenate([new[kept], new[~kept]])
        kept = int(kept.sum())
        ids = self.encode_words([text[s : s + n].encode("utf-8", "surrogatepass") for s, n in zip(at[new].tolist(), sizes[new].tolist(), strict=True)])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        if kept:
            self._known.add(keys[new[:kept]], taken[new[:kept]], points, at[new[:kept]], sizes[new[:kept]])
            number[new[:kept]] = len(self._offsets) - 1 + np.arange(kept)
            self._ids = np.concatenate([self._ids, *ids[:kept]])
            self._offsets = np.concatenate([self._offsets, self._offsets[-1] + np.cumsum(lengths[:kept])])
        begin, many = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known = np.flatnonzero(number >= 0)
        begin[known] = self._offsets[number[known]]
        many[known] = self._offsets[number[known] + 1] - begin[known]
        store, rest = self._ids, new[kept:]
        if len(rest):
            store = np.concatenate([store, *ids[kept:]])
            many[rest] = lengths[kept:]
            begin[rest] = len(self._ids) + np.cumsum(many[rest]) - many[rest]
        return begin, many, store

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word: the one path of the automaton that spells it."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] = self._long_word(words[i])
        short = np.flatnonzero(sizes <= LONG_WORD)
        short = short[np.argsort(-sizes[short], kind="stable")]
        if len(short):
            for i, ids in zip(short.tolist(), self._short_words([words[i] for i in short.tolist()], sizes[short]), strict=True):
                out[i] = ids
        return out

    def _short_words(self, words: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        """All words at once, longest first; ``last[:, i]`` is the last token of the first i bytes."""
        n, width = len(words), int(sizes[0])
        spelt = np.zeros((n, width), np.uint8)
        inside = np.arange(width) < sizes[:, None]
        spelt[inside] = np.frombuffer(b"".join(words), np.uint8)
        trie, automaton = self.trie, self.automaton
        last = np.full((n, width + 1), -1, np.int32)
        for j in range(width):
            rows = np.arange(int(np.searchsorted(-sizes, -j)))  # words longer than j
            state = automaton.state[last[rows, j]] if j else np.zeros(len(rows), np.int32)
            node, i = np.zeros(len(rows), np.int32), j
            while len(rows):
                node = trie.table[trie.inner[node], spelt[rows, i]]
                i += 1
                on = node >= 0
                rows, node, state = rows[on], node[on], state[on]
                token = trie.token[node]
                ends = np.flatnonzero(token >= 0)
                ends = ends[automaton.allows(state[ends], token[ends]) == 1]
                last[rows[ends], i] = token[ends]
                on = sizes[rows] > i
                rows, node, state = rows[on], node[on], state[on]
        label_size = np.fromiter(map(len, self.vocabulary.labels), np.int64, self.vocabulary.size)
        who, at = np.arange(n), sizes.copy()
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            token = last[who, at[who]]
            pieces.append((who, token))
            at[who] -= label_size[token]
            who = who[at[who] > 0]
        owner = np.concatenate([p[0] for p in pieces[::-1]])
        tokens = np.concatenate([p[1] for p in pieces[::-1]])
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(n + 1))
        tokens = tokens[order]
        return [tokens[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _long_word(self, word: bytes) -> np.ndarray:
        trie, automaton = self.trie, self.automaton
        inner, table, tokens = trie.inner, trie.table, trie.token
        last = [-1] * (len(word) + 1)
        for j in range(len(word)):
            state = automaton.state[last[j]] if j else 0
            node = 0
            for i in range(j, len(word)):
                node = table[inner[node], word[i]]
                if node < 0:
                    break
                token = tokens[node]
                if token >= 0 and last[i + 1] < 0 and automaton.allows(state, token):
                    last[i + 1] = int(token)
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= len(self.vocabulary.labels[last[at]])
        return np.array(ids[::-1], np.int32)


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file that the driver can read."""
    with open(path, encoding="utf-8") as f:
        return Encoder(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the ids as little-endian unsigned 32-bit numbers, and the text made of their labels."""
    made = shipped(docs.sparkSession, encoder(path))

    def rows(part):
        coder = made()
        ids = coder.encode(texts(part.column(1)))
        return {
            "doc_id": part.column(0),
            "ids": [x.astype("<u4").tobytes() for x in ids],
            "decoded": [coder.decode(x) for x in ids],
        }

    return arrow_map(
        docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, ids binary, decoded string"
    )
