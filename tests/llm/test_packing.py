"""Sequence packing against the tokenizer itself and against best fit."""

import bisect
import math
import zlib

import numpy as np
import pytest

from spendloom.llm import packing, registry

ODD = [
    None, "", " \n ", "it's Don't, a.b,c.. ,, 'S. <|endoftext|> <|ENDOFTEXT|>, x\x01y É. é, ÀB. Á, ﬁ. 1. 1,2, (a). ok).",
    "İ. ß, Σας Σ.", "\x01", "word, " * 9000, "a" * 3000, "é e ́ x", "tab\tand wide space\x1fend.",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_path())


def test_pieces_are_the_tokenizers(spark, documents, tokenizer):
    texts = [*ODD, *[r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]]
    expected = []
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], "<u4").tobytes()
            expected.append((i, k, at, len(own) // 4, zlib.crc32(own)))
    got = packing.pieces(documents(texts), registry.tokenizer_path()).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_words_are_forgotten_and_learned_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 5)
    tokens = packing.Tokens(registry.tokenizer_path())
    texts = [f"word{i} common, other{i % 3}." for i in range(50)]
    for text in texts * 2:
        assert tokens.of([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_words_of_letters_need_no_normalizing(tokenizer):
    """Most new words are letters with marks behind; the full tokenizer sees the marks alone, once each."""
    tokens = packing.Tokens(registry.tokenizer_path())
    full, seen = tokens.tokenizer, []

    class Seen:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return full.encode_batch_fast(texts, **options)

    tokens.tokenizer = Seen()
    texts = ["Plain words, été! straße&&& til?", "plain! Words... straße, ÿ"]
    assert tokens.of(texts) == [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert not any(c.isalpha() for c in "".join(seen))
    assert "".join(seen).count("!") == "".join(seen).count("&&&") == 1


def test_made_up_words_are_the_tokenizers(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3000)
    rng = np.random.default_rng(11)
    units = [*"abkz", "ing", "the", *"éßÿñµªº×÷ÀĀſǅяא한", "\u0301", "\u1100\u1161", *"019٣²", *"'.,!&-_<|>$", "'s", "'ll", "<|endoftext|>", "\x01", "\x1f", "\u00a0", *"  \n\t\v"]
    texts = ["".join(rng.choice(units, rng.integers(0, 60))) for _ in range(1500)]
    tokens = packing.Tokens(registry.tokenizer_path())
    for at in range(0, len(texts), 300):
        expected = [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts[at : at + 300]]
        assert tokens.of(texts[at : at + 300]) == expected


def best_fit(lengths):
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at == len(rooms):
            n += 1
            bisect.insort(rooms, 4096 - length)
        else:
            bisect.insort(rooms, rooms.pop(at) - length)
    return n


def check(rows, lengths):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    return len(by_sequence)


@pytest.mark.parametrize("kind", ["mixed", "one_length", "large", "tiny"])
def test_sequences_are_gapless_and_few(spark, kind):
    rng = np.random.default_rng(3)
    lengths = {
        "mixed": [*rng.integers(1, 4097, 1500), *rng.integers(1, 600, 1500)],
        "one_length": [1500] * 1000 + [4096] * 50,
        "large": list(rng.integers(2049, 4097, 300)),
        "tiny": [1] * 5000,
    }[kind]
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = check(packing.pack(cut).collect(), lengths)
    assert n <= max(best_fit(lengths) * 1.01, math.ceil(sum(lengths) / 4096) + 1)


@pytest.mark.parametrize(("kinds", "sequences"), [
    ({1365: 900}, 300), ({819: 1000}, 200), ({585: 700}, 100), ({2047: 200, 2049: 200}, 200), ({1365: 300, 2047: 100, 2049: 100, 819: 100}, 220),
])
def test_lengths_that_fit_exactly_are_packed(spark, kinds, sequences):
    lengths = [n for n, count in kinds.items() for _ in range(count)]
    cut = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert check(packing.pack(cut).collect(), lengths) == sequences


def test_a_hot_length_among_others():
    """A third of all pieces have one length that the steps of the plan round up."""
    rng = np.random.default_rng(5)
    lengths = [*[1365] * 3000, *rng.integers(256, 4097, 6000)]
    made = packing.plan(np.bincount(lengths, minlength=4097), 4096)
    assert np.array_equal(sum(np.bincount(sizes, minlength=4097) * count for sizes, count in made), np.bincount(lengths, minlength=4097))
    assert all(sizes.sum() <= 4096 for sizes, _ in made)
    assert sum(count for _, count in made) <= best_fit(lengths)


def test_no_documents_and_repeated_rows(documents):
    path = registry.tokenizer_path()
    assert packing.pack_documents(documents([]), path).count() == 0
    rows = packing.pack_documents(documents([(1, "same text"), (1, "same text"), (None, "x"), (None, None)]), path).collect()
    assert check(rows, [r["length"] for r in rows]) == 1
    assert len(rows) == 4
