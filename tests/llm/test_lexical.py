"""Ranked lexical search against SQL and plain counts."""

import random
import re

import pytest

from spendloom.llm import checks, lexical

from .test_search_and_archives import compare

ITEMS = "item_id long, text string"
WORDS = ["Alpha", "beta", "b", "gamma-ray", "naïve", "日本", "x1", "of", "of", "the", "the", "the", "a b", "ÉTÉ", "beta_b"]


def some_texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", "  ", ", ", "\n", ".", "\x7f", " "]) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_search_equals_sql(spark, documents):
    texts = [(i, t) for i, t in enumerate(some_texts(1, 300, 60))]
    texts += [(400, None), (401, ""), (402, " .,- \x00"), (403, "THE " * 2000), (None, "alpha beta"), (None, None)]
    texts += [(i, "the alpha of beta") for i in range(500, 530)] + [(510, "the alpha of beta")]
    docs = documents(texts).repartition(5)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(some_texts(2, 25, 12))] + [(90, None), (91, "?!"), (92, "zzz"), (93, "the"), (93, "the"), (94, "Alpha alpha BETA")], ITEMS)
    compare(lexical.ranked(docs, items), checks.lexical_sql("docs", "items"), docs=docs, items=items)


def test_many_blocks_and_slices(spark, documents, monkeypatch):
    docs = documents([(i, t) for i, t in enumerate(some_texts(3, 60, 80))])
    items = spark.createDataFrame([(i, t) for i, t in enumerate(some_texts(4, 9, 20))], ITEMS)
    whole = sorted(map(tuple, lexical.ranked(docs, items).collect()))
    monkeypatch.setattr(lexical, "ITEMS", 2)
    assert len(list(lexical.blocks(items))) >= 4
    assert sorted(map(tuple, lexical.ranked(docs, items).collect())) == whole
    monkeypatch.setattr(lexical, "ITEM_BYTES", 1)
    assert max(map(len, lexical.blocks(items))) == 1


def test_whole_terms_are_counted():
    terms = [b"a", b"ab", b"b", b"ba", "日本".encode(), "日".encode()]
    machine = lexical.automaton(terms)
    for text in some_texts(5, 20, 200) + ["a a ab ba aab a.b-a", "日 日本 日本日", "", "a", "ab" * 50]:
        plain = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text))
        expected = {k: plain.count(t.decode()) for k, t in enumerate(terms) if t.decode() in plain}
        for size in (1, 7, 1 << 20):
            assert dict(lexical.counted(machine, lexical.folded(text), size)) == expected
        assert len(lexical.folded(text).split()) == len(plain)


def test_long_sums_stay_exact():
    weights = [2**40, 3]
    postings = lexical.Postings([[0, 0, 1], [1]], weights)
    assert not postings.exact
    import numpy as np

    assert postings.scores(np.array([0, 1]), np.array([999_999, 7])).tolist() == [2 * 2**40 * 999_999 + 21, 21]


def test_columns_of_other_names_and_empty_tables(spark, documents):
    docs = documents([(1, "alpha beta"), (2, "beta")])
    items = spark.createDataFrame([(7, "alpha")], ITEMS)
    expected = [tuple(r) for r in lexical.ranked(docs, items).collect()]
    assert [x[:3] for x in expected] == [(7, 1, 1)]
    odd = docs.selectExpr("*", "'x' AS item_id", "1 AS score", "2 AS rank", "3 AS term")
    assert [tuple(r) for r in lexical.ranked(odd, items.selectExpr("*", "9 AS doc_id")).collect()] == expected
    empty = lexical.ranked(documents([]), items)
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(documents([(1, None)]), items).count() == 0


@pytest.mark.parametrize("text", ["alpha " * 400_000, "x" * 3_000_000 + " alpha"])
def test_very_long_texts(spark, documents, text):
    items = spark.createDataFrame([(1, "Alpha")], ITEMS)
    rows = lexical.ranked(documents([(5, text), (6, "alpha")]), items).collect()
    assert {r["doc_id"] for r in rows} == {5, 6}
