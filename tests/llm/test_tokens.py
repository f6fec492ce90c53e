import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from rolecast.llm import bpe, packing, token_count
from tests.llm.cases import ODD, frame

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = "aabcdefst're ve ll m 'd'S  \n\t\r\x0b\x85\xa0é1२Ⅷ٣!?#$€中​　👍🏽\x00\x1c﻿"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(BPE)


def random_texts(n, signs=SIGNS):
    random.seed(1)
    return ["".join(random.choice(signs) for _ in range(random.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(library, coder):
    texts = [*random_texts(4000), "'s'sabc'll", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x" * 500 + " " * 300 + "the" * 100]
    ids = coder.encode(texts)
    wanted = library.encode_batch(texts, add_special_tokens=False)
    assert [i.tolist() for i in ids] == [w.ids for w in wanted]
    assert [coder.decode(i) for i in ids] == [library.decode(w.ids, skip_special_tokens=False) for w in wanted]


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 250)
    monkeypatch.setattr(bpe, "CHUNK", 100)
    coder = bpe.encoder(BPE)
    texts = random_texts(300)
    assert [i.tolist() for i in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_automaton_allows_only_what_the_merges_make(library, coder):
    """Two tokens may follow each other if the library cuts their joined text the same way."""
    random.seed(2)
    words = [t for t, i in coder.vocabulary.ids.items() if t.isascii() and t.isalpha()]
    for _ in range(2000):
        a, b = random.choice(words), random.choice(words)
        ids = [coder.vocabulary.ids[a], coder.vocabulary.ids[b]]
        allowed = coder.automaton.allows(coder.automaton.state[[ids[0]]], np.array(ids[1:]))[0]
        assert bool(allowed) == (library.encode(a + b, add_special_tokens=False).ids == ids)


def test_encode_and_decode_documents(spark, library):
    found = bpe.encode(frame(spark), BPE).collect()
    wanted = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in ODD)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in found) == wanted
    assert bpe.encode(frame(spark, []), BPE).count() == 0


def test_pieces_and_their_places(spark, library):
    found = packing.pack(frame(spark), BPE).collect()
    wanted = []
    for i, t in ODD:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start, end, piece = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            wanted.append((str(i), piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), ids[start:end].tobytes()))
            start, end, piece = end, end + 1024, piece + 1
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found) == sorted(wanted)
    check_places(found, 1024)
    assert packing.pack(frame(spark, []), BPE).count() == 0


def check_places(found, capacity):
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def plain_first_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_as_tight_as_one_by_one(spark, seed):
    random.seed(seed)
    top = (1024, 400, 700, 341, 520, 30)[seed]
    lengths = [random.randint(1, top) for _ in range(900)] + [top] * 300
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = packing.pack_lengths(counts, 1024)
    for number, held in bins:
        assert sum(n * k for n, k in held) <= 1024
        assert sum(k for n, k in held if 3 * n > 1024) <= 2
    placed = defaultdict(int)
    for number, held in bins:
        for n, k in held:
            placed[n] += number * k
    assert placed == counts
    total = sum(number for number, _ in bins)
    assert math.ceil(sum(lengths) / 1024) <= total <= plain_first_fit(lengths, 1024) + 2


def test_many_pieces_of_one_length(spark):
    rows = [(i, 0, 0, n) for i, n in enumerate([5] * 2000 + [600] * 30 + [400] * 50 + [1024] * 3)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long")
    found = packing.place(pieces).collect()
    assert len(found) == len(rows)
    assert check_places(found, 1024) == plain_first_fit([r[3] for r in rows], 1024)


def test_counts_equal_the_library(spark):
    pieces = token_count.read_pieces(PIECES)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_count.Counter(pieces)
    for text in random_texts(2000, SIGNS + "▁ the and ing"):
        if text:
            assert sum(counter[w][0] for w in token_count.words(text)) == len(library.encode(text).ids), text
    found = token_count.count_tokens(frame(spark), PIECES).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted(
        (str(i), len(library.encode(t).ids) if t else 0) for i, t in ODD
    )
    assert token_count.count_tokens(frame(spark, []), PIECES).count() == 0


def test_of_equal_scores_the_longer_last_piece_wins():
    counter = token_count.Counter([("a", -1.0), ("ab", -2.0), ("b", -1.0), ("abc", -3.0), ("c", -1.0), ("bc", -2.0)])
    assert counter.best("abc") == (1, -3.0)
    assert counter.best("a?!b") == (3, -1.0 + 2 * counter.unknown - 1.0)
