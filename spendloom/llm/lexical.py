"""Ranked lexical search: item terms are counted in the texts themselves, by an automaton, without an index.

Items (queries) come in blocks of bounded size. The terms of a block make one Aho-Corasick automaton in which every
term stands between two guards, and a text has its letters lowered and every character that belongs to no term
turned into a guard; so a term is found exactly where it is a whole term. The automaton is broadcast as its list of terms;
its outputs are term numbers, which map to the items of the block that hold the term.

Two passes read the texts of a block of items. The first counts, per task, the documents holding each term
(the very first one also the documents and terms of the corpus); the sums of all tasks give the weights. The second
scores: the occurrences of a document's terms are spread over the items, and a task keeps the TOP best
documents of every item. The best of all tasks meet per item, at most TOP a task.

A task holds a slice of a text, the automaton, one score per item of the block and TOP documents per item. The
driver holds one block of items.

Defined cases: a null or empty text has no terms, as a document (it does not count) and as an item (no rows).
Very long texts are scanned in slices cut at guards. Repeated documents are documents each; equal scores are ordered by
document id, null ids last. Equal (item_id, text) rows are one item; items of the same id and other text are ranked
each. An empty table gives no rows. Other columns are not looked at. Weights and scores are whole numbers; they are
summed up in doubles while sums stay below 2^53, else in 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.llm.common import checkpointed

TOP = 10
#: A block of items ends after so many items or bytes of text (one item at least).
ITEMS = 4096
ITEM_BYTES = 8 << 20
#: Bytes of a text that are scanned at once.
SLICE = 1 << 20
#: Constants of the score.
B100, K8 = 75, 8
ONE = 1_000_000_000

_TERM_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Letters lowered; what belongs to no term becomes a guard. All bytes of characters beyond ASCII belong to terms.
GUARD = b" "
FOLDED = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _TERM_BYTES else GUARD[0] for c in range(256))


def folded(text: object) -> bytes:
    return text.encode("utf-8", "replace").translate(FOLDED) if isinstance(text, str) else b""


def automaton(terms: list[bytes]):
    """Outputs the number of a term where it ends, guards included. Bytes are handled as characters."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        machine.add_word((GUARD + term + GUARD).decode("latin-1"), number)
    machine.make_automaton()
    return machine


def slices(text: bytes, size: int) -> Iterator[str]:
    """The text between guards, in pieces that begin and end with a guard and share it with their neighbours."""
    low = 0
    while low < len(text):
        high = text.find(GUARD, low + size)
        high = len(text) if high < 0 else high
        yield (GUARD + text[low:high] + GUARD).decode("latin-1")
        low = high + 1


def counted(machine, text: bytes, size: int = SLICE) -> Counter:
    """Occurrences by term number."""
    return Counter(map(itemgetter(1), chain.from_iterable(map(machine.iter, slices(text, size)))))


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items as (item_id, terms), a block at a time; only one partition of the items is on the driver at once."""
    block: list = []
    size = 0
    for row in items.select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        terms = folded(row["text"]).split()
        if not terms:
            continue
        if block and (len(block) >= ITEMS or size + len(row["text"]) > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((row["item_id"], terms))
        size += len(row["text"])
    if block:
        yield block


def corpus(docs: DataFrame, terms) -> DataFrame:
    """(term, n): documents holding each term; term -1: documents with a term at least; -2: all terms with repeats."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(terms.value)
        held = np.zeros(len(terms.value), np.int64)
        documents = words = 0
        for batch in batches:
            for text in map(folded, batch["text"]):
                n = len(text.split())
                if n:
                    documents, words = documents + 1, words + n
                    if found := counted(machine, text):
                        held[np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(held)
        yield pd.DataFrame({"term": np.r_[-1, -2, at], "n": np.r_[documents, words, held[at]]})

    return docs.select("text").mapInPandas(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Postings:
    """Items of each term with weight times repeats, and the scores of a document."""

    def __init__(self, items: list[list[int]], weights: list[int]):
        by_term: list[list[tuple[int, int]]] = [[] for _ in weights]
        for number, terms in enumerate(items):
            for term, times in Counter(terms).items():
                by_term[term].append((number, times * weights[term]))
        self.n_items = len(items)
        self.start = np.cumsum([0, *map(len, by_term)])
        self.items = np.array([i for own in by_term for i, _ in own], np.int64)
        self.gains = np.array([g for own in by_term for _, g in own], np.int64)
        # a term adds at most 1,000,000 times its weight
        self.exact = max((sum(weights[t] for t in own) for own in items), default=0) * (ONE // 1000) < 2**53

    def scores(self, terms: np.ndarray, parts: np.ndarray) -> np.ndarray:
        low, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.arange(n.sum()) + np.repeat(low - np.r_[0, n.cumsum()[:-1]], n)
        added = self.gains[at] * np.repeat(parts, n)
        if self.exact:
            return np.bincount(self.items[at], added, self.n_items).astype(np.int64)
        out = np.zeros(self.n_items, np.int64)
        np.add.at(out, self.items[at], added)
        return out


def length_part(n: int, documents: int, words: int) -> int:
    """How long a document of n terms is against the mean, in hundredths, softened."""
    return 100 - B100 + (B100 * n * documents) // words


def scored(docs: DataFrame, plan, documents: int, words: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each task for every item of the block."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, items, weights = plan.value
        machine, postings = automaton(terms), Postings(items, weights)
        best: list[list] = [[] for _ in items]
        least = np.ones(len(items), np.int64)  # a document must score as much
        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype(object), map(folded, batch["text"]), strict=True):
                found = counted(machine, text)
                if not found:
                    continue
                tf = np.fromiter(found.values(), np.int64, len(found))
                m = length_part(len(text.split()), documents, words)
                scores = postings.scores(np.fromiter(found, np.int64, len(found)), (ONE * tf) // (1000 * tf + K8 * m))
                order = -math.inf if pd.isna(doc) else -int(doc)  # equal scores: smaller ids first, null ids last
                for item in np.flatnonzero(scores >= least).tolist():
                    entry = (int(scores[item]), order)
                    if len(best[item]) < top:
                        heapq.heappush(best[item], entry)
                    elif entry > best[item][0]:
                        heapq.heapreplace(best[item], entry)
                    if len(best[item]) == top:
                        least[item] = best[item][0][0]
        out = [(item, None if order == -math.inf else -order, score) for item, own in enumerate(best) for score, order in own]
        yield pd.DataFrame(out, columns=["item", "doc_id", "score"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(work, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0."""
    spark = docs.sparkSession
    parts = []
    for block in blocks(items):
        terms = sorted(set(chain.from_iterable(own for _, own in block)))
        number = {term: k for k, term in enumerate(terms)}
        sent = spark.sparkContext.broadcast(terms)
        known = {r["term"]: r["n"] for r in corpus(docs, sent).collect()}  # as many rows as the block has terms
        sent.destroy()
        documents, words = known.get(-1) or 0, known.get(-2) or 0
        if not documents:
            break
        weights = [weight(documents, known.get(k, 0)) for k in range(len(terms))]
        plan = spark.sparkContext.broadcast((terms, [[number[t] for t in own] for _, own in block], weights))
        best = scored(docs, plan, documents, words, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item int, item_id long")
        parts.append(checkpointed(best.join(names, "item").select("item_id", "rank", "doc_id", "score")))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found
