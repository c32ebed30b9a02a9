"""Substring dedup: words covered by a 50-word window that a document with a smaller id has too.

Every window has a minimiser, the least hash of its eight-word runs; consecutive windows with the same
minimiser form a super-k-mer and travel as one packed string to the bucket of their minimiser. Equal windows have
equal minimisers, so they meet there; the bucket sorts its windows and finds the least document of each.

Two things keep the strings few. Super-k-mers whose minimiser occurs in a single document stay at home, as none
of their windows can occur elsewhere. And a minimiser with more than HEAVY super-k-mers (a passage that a
third of all documents may hold) has no bucket: documents are dealt into blocks, every block sends its distinct
windows of such minimisers with their least documents, packed, to ranges of hashes and gets the least documents of all
blocks back. So a frequent window is one entry per block, however many documents hold it.

Everything is one plan but a count of characters. The texts are dealt by document once; all passes read the same exchange.

Defined cases: null texts have no words; texts under 50 words have no windows and stay whole. A null id counts as
2^63 - 1, greater than all others. Documents with equal ids never remove words from each other. Repeated rows give
repeated results. An empty table gives an empty table; other columns are not looked at. Windows compare by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.hashing import WordHashes, as_long, mixed, runs

WINDOW = 50
MINIMISER = 8
HEAVY = 300
#: Super-k-mers that one bucket sorts, about.
BUCKET = 50_000
#: Characters of a block, and of the texts behind one range of hashes, about.
BLOCK = 6_000_000
RANGE = 24_000_000
LAST_ID = 2**63 - 1


def split(text: object) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if isinstance(text, str) else []


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """The minimiser of every window, as longs."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64)
    return as_long(least(runs(hashes, MINIMISER), WINDOW - MINIMISER + 1))


def window_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every window."""
    return as_long(runs(hashes, WINDOW)), as_long(runs(mixed(hashes), WINDOW, 0xD1342543DE82EF95))


def super_kmers(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 window of every run of equal minimisers."""
    cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
    return np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [len(found)]]).astype(np.int64)


def list_minimisers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        found = [minimisers(hashes.of(split(t))) for t in batch["text"]]
        found = [x[super_kmers(x)[0]] if len(x) else x for x in found]
        sizes = [len(x) for x in found]
        yield pd.DataFrame({"doc": np.repeat(batch["doc"].to_numpy(), sizes), "h": np.repeat(batch["h"].to_numpy(), sizes), "minimiser": np.concatenate([np.zeros(0, np.int64), *found])})


def pack_light(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The super-k-mers that are shared, as strings."""
    hashes = WordHashes()
    for batch in batches:
        out = []
        for doc, h, text, shared in zip(batch["doc"], batch["h"], batch["text"], batch["shared"], strict=True):
            words = split(text)
            found = minimisers(hashes.of(words))
            first, end = super_kmers(found)
            for k in np.flatnonzero(np.isin(found[first], np.asarray(shared))):
                a, b = int(first[k]), int(end[k])
                out.append((int(found[a]), doc, h, a, b" ".join(words[a : b + WINDOW - 1])))
        yield pd.DataFrame(out, columns=["minimiser", "doc", "h", "start", "packed"])


class HeavyWindows:
    """The windows of heavy minimisers of a block of documents, by document and place, and the distinct ones in order."""

    def __init__(self, rows: pd.DataFrame) -> None:
        hashes = WordHashes()
        ones, twos, starts, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for text, shared in zip(rows["text"], rows["shared"], strict=True):
            own = hashes.of(split(text))
            at = np.flatnonzero(np.isin(minimisers(own), np.asarray(shared)))
            one, two = window_hashes(own)
            ones.append(one[at])
            twos.append(two[at])
            starts.append(at)
            docs.append(len(at))
        one, two = np.concatenate(ones), np.concatenate(twos)
        self.start = np.concatenate(starts)
        self.row = np.repeat(np.arange(len(rows)), docs)
        self.doc = rows["doc"].to_numpy()[self.row] if len(rows) else self.start
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        self.one, self.two = one[order][new], two[order][new]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.doc[order], np.flatnonzero(new)) if len(order) else self.doc


def range_of(one: np.ndarray, ranges: int) -> np.ndarray:
    """Hashes are dealt by their size, so ranges in order hold sorted hashes in order."""
    return (((one >> 32) + 2**31) * ranges) >> 32


def ask(ranges: int):
    def asked(rows: pd.DataFrame) -> pd.DataFrame:
        own = HeavyWindows(rows)
        cuts = np.searchsorted(range_of(own.one, ranges), np.arange(ranges + 1))
        number = int(rows["block"].iloc[0])
        pieces = [(k, slice(cuts[k], cuts[k + 1])) for k in range(ranges) if cuts[k] < cuts[k + 1]]
        out = [(k, number, own.one[x].tobytes(), own.two[x].tobytes(), own.least[x].tobytes()) for k, x in pieces]
        return pd.DataFrame(out, columns=["key_range", "block", "one", "two", "least"])

    return asked


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    """The least document of every window that the blocks asked for, in the order asked."""
    columns = [[np.frombuffer(x, np.int64) for x in rows[name]] for name in ("one", "two", "least")]
    one, two, doc = (np.concatenate(x) for x in columns)
    order = np.lexsort((doc, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    found = np.empty(len(order), np.int64)
    found[order] = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    ends = np.cumsum([len(x) for x in columns[0]])[:-1]
    return rows[["key_range", "block"]].assign(least=[x.tobytes() for x in np.split(found, ends)])


def take_answers(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The windows of a block that a smaller document has too."""
    own = HeavyWindows(rows)
    parts = [np.frombuffer(x, np.int64) for x in answers.sort_values("key_range")["least"]]
    least = np.concatenate([np.zeros(0, np.int64), *parts])
    gone = least[own.place] < own.doc
    return spans_of(gone, own.row, own.start, rows)


def spans_of(gone: np.ndarray, row: np.ndarray, start: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of windows to remove; row and start say whose window each is, in order."""
    first = gone.copy()
    first[1:] &= ~gone[:-1] | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(first)
    length = np.diff(np.append(np.cumsum(gone)[at] - 1, gone.sum()))
    own = row[at]
    return pd.DataFrame({"doc": rows["doc"].to_numpy()[own], "h": rows["h"].to_numpy()[own], "start": start[at], "n": length})


def windows_of(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the packed strings: their hashes, and how many each string has."""
    hashes = WordHashes()
    ones, twos, sizes = [], [], []
    for low in range(0, len(packed), 1000):
        words = [p.split() for p in packed[low : low + 1000]]
        lengths = np.array([len(w) for w in words])
        one, two = window_hashes(hashes.of([w for own in words for w in own]))
        # windows that begin in the last 49 words of a string run into the next one
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        whole = np.flatnonzero(within <= np.repeat(lengths, lengths) - WINDOW)
        ones.append(one[whole])
        twos.append(two[whole])
        sizes.append(lengths - (WINDOW - 1))
    return np.concatenate(ones), np.concatenate(twos), np.concatenate(sizes)


def sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """The windows of a bucket that a smaller document has too."""
    one, two, sizes = windows_of(list(rows["packed"]))
    row = np.repeat(np.arange(len(rows)), sizes)
    docs = rows["doc"].to_numpy()
    doc = docs[row]
    order = np.lexsort((doc, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    smallest = np.empty(len(order), np.int64)
    smallest[order] = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    begin = np.cumsum(sizes) - sizes
    start = rows["start"].to_numpy()[row] + np.arange(len(row)) - begin[row]
    return spans_of(smallest < doc, row, start, rows)


def keep_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
            words = split(text)
            n, removed = len(words), 0
            if spans is not None and len(spans):
                first, length = np.asarray(spans).reshape(2, -1)
                depth = np.bincount(first, minlength=n + 1) - np.bincount(first + length + WINDOW - 1, minlength=n + 1)
                gone = depth[:-1].cumsum() > 0
                removed = int(gone.sum())
                words = [words[k] for k in np.flatnonzero(~gone)]
            kept = b" ".join(words)
            out.append((doc_id, n, removed, hashlib.sha256(kept).hexdigest(), kept.decode()))
        rows = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
        yield rows.astype({"doc_id": "Int64"})


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space) for every row."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("h")]
    # three columns that every pass reads, so that all of them share this exchange
    texts = docs.select(*key, "text").repartition("doc", "h")
    listed = texts.select("doc", "h", "text").mapInPandas(list_minimisers, "doc long, h long, minimiser long")
    counted = listed.groupBy(F.struct("minimiser").alias("of")).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
    shared = counted.filter("lo < hi").select("of.minimiser", (F.col("n") > HEAVY).alias("heavy"))
    marked = listed.distinct().join(shared, "minimiser").groupBy("doc", "h")
    marked = marked.agg(F.collect_list(F.when(~F.col("heavy"), F.col("minimiser"))).alias("light"), F.collect_list(F.when(F.col("heavy"), F.col("minimiser"))).alias("heavy"))

    def with_shared(kind: str) -> DataFrame:
        own = marked.filter(F.size(kind) > 0).select("doc", "h", F.col(kind).alias("shared"))
        return texts.join(own, ["doc", "h"]).select("doc", "h", "text", "shared")

    light = with_shared("light").mapInPandas(pack_light, "minimiser long, doc long, h long, start int, packed binary")
    # a super-k-mer begins about every 100 characters
    buckets = F.pmod(F.col("minimiser"), F.lit(max(64, chars // 100 // BUCKET)))
    from_light = light.groupBy(buckets.alias("bucket")).applyInPandas(sort_bucket, "doc long, h long, start int, n int")

    blocks, ranges = max(16, chars // BLOCK), max(64, chars // RANGE)
    block = F.pmod(F.xxhash64("doc", "h"), F.lit(blocks)).cast("int").alias("block")
    dealt = with_shared("heavy").select("doc", "h", "text", "shared", block).repartition("block")
    asked = dealt.groupBy("block").applyInPandas(ask(ranges), "key_range int, block int, one binary, two binary, least binary")
    told = asked.groupBy("key_range").applyInPandas(answer, "key_range int, block int, least binary")
    from_heavy = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(take_answers, "doc long, h long, start int, n int")

    spans = from_light.union(from_heavy).groupBy("doc", "h").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    spans = spans.select("doc", "h", F.concat("spans.start", "spans.n").alias("spans"))
    doc_id = F.nullif("doc", F.lit(LAST_ID)).alias("doc_id")
    return texts.join(spans, ["doc", "h"], "left").select(doc_id, "text", "spans").mapInPandas(
        keep_rest, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )

