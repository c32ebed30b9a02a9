"""Packing token sequences: a configuration linear program, rounded.

Documents become token ids; only a document longer than a sequence is cut, into full pieces and a rest.
A configuration says how many pieces of each length one sequence takes. The linear program over the
histogram of lengths (fewest sequences that hold all pieces) is solved by multiplicative weights: lengths
that lag behind weigh more, and a knapsack dynamic program finds the configuration with the greatest weight.
Configurations are taken in whole numbers as the rounds go; what is left is packed by best fit on the histogram.

The driver sees the histogram alone: `capacity` counts at most, whatever the input. Pieces get a rank
within their class from counts per (class, bucket), so that a class with a third of all pieces is not ranked
by one task, and class and rank give the sequence.

Lengths are exact throughout. The knapsack alone sees lengths from FINE on in steps of `grid` tokens: it proposes
configurations, which are filled with pieces of exact lengths, and best fit adds to the room that these leave. Best
fit of all pieces, without any proposal, is one of the solutions that are compared, so combinations that the steps
hide (3 x 1365, 2047 + 2049) are not lost. Ids, pieces and offsets are exact.

Defined cases: a null text counts as empty and is one piece with the end id only. Repeated rows are packed
each for itself; null ids are allowed. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from itertools import pairwise
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.llm.common import checkpointed, lean

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 4096
#: Lengths from FINE on count in steps of GRID tokens while configurations are proposed.
GRID = 4
FINE = 256
ROUNDS = 600
#: A round takes at most this share of the pieces of a class.
STEP = 0.25
#: How strongly a class that lags behind is preferred.
ETA = 0.2
END_ID = 1
#: Words whose ids a Python worker remembers; those known before are kept until as many are new.
KEPT_WORDS = 600_000
#: Characters of text whose words are looked up together, about.
READ_TOGETHER = 8_000_000
#: Words that the tokenizer takes as one unit and normalizing leaves as they are; marks are units behind them.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
MARKS = string.punctuation
#: Pieces that one task ranks in a class, about.
RANKED_TOGETHER = 1_000


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes. White space separates what the tokenizer sees, so
    ids are looked up by word, and a word is encoded once while it is remembered. Words are split, counted as
    distinct and replaced by their ids in Arrow. Marks behind letters are tokens of their own, so their ids are put
    behind those of the letters; letters that normalizing leaves as they are go to the model directly."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)  # for PLAIN words with a space between them
        bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), bytes_as_letters])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before; words in use move back
        self.apart = int.from_bytes(self.encode("\x01"), "little")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def encode(self, text: str, tokenizer: Tokenizer | None = None) -> bytes:
        return np.asarray((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        known, older = self.known, self.older
        plain: set[str] = set()
        others: set[str] = set()
        marked = []
        for w in words:
            if (ids := older.get(w)) is not None:
                known[w] = ids
                continue
            stem = w.rstrip(MARKS)
            if not PLAIN(stem):
                others.add(w)
            elif len(stem) == len(w):
                plain.add(w)
            else:
                marks = w[len(stem) :]
                marked.append((w, stem, marks))
                plain.add(stem)
                others.add(marks)
        for new in (plain, others):
            for w in [w for w in new if w in known or w in older]:
                known[w] = known[w] if w in known else older[w]
                new.discard(w)
        new_words = list(plain)
        for at in range(0, len(new_words), 4000):
            some = new_words[at : at + 4000]
            # one call for many words: a word of letters is one unit, and its last token says that it ends there
            raw = self.encode(" ".join(some), self.letters)
            last = 0
            for w, cut in zip(some, (4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4).tolist(), strict=True):
                known[w] = raw[last:cut]
                last = cut
        new_words = [w for w in others if "\x01" not in w]
        for at in range(0, len(new_words), 2000):
            some = new_words[at : at + 2000]
            # the same with a mark between them that none of them holds
            raw = self.encode(" \x01 ".join([*some, ""]))
            last = 0
            for w, cut in zip(some, (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.apart)).tolist(), strict=True):
                known[w] = raw[last:cut]
                last = cut + 4
        for w in others.difference(new_words):
            known[w] = self.encode(w)
        for w, stem, marks in marked:
            known[w] = known[stem] + known[marks]

    def of(self, texts: list[str]) -> list[bytes]:
        raw = pa.array([text.encode("utf-8", "replace") for text in texts], pa.large_string())
        # the tokenizer lower-cases; only in its special tokens capitals count
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(raw, "<|"), raw, pc.ascii_lower(raw)))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if missing := [w for w in distinct if w not in self.known]:
            if len(self.known) > KEPT_WORDS:
                self.older, self.known = self.known, {}
                missing = distinct
            self.learn(missing)
        ids = pa.array(map(self.known.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        # the ids of a text lie side by side
        _, starts, data = ids.buffers()
        bounds = np.frombuffer(starts, np.int64)[split.offsets.to_numpy()].tolist()
        joined = memoryview(data or b"")
        return [joined[low:high].tobytes() for low, high in pairwise(bounds)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every document."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(tokenizer_path)
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "")
            for _, part in texts.groupby((texts.str.len().cumsum() // READ_TOGETHER).to_numpy()):
                out = []
                for doc_id, ids in zip(batch["doc_id"][part.index], tokens.of(part.tolist()), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        out.append((doc_id, n, at // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lean(cut), schema)


def fullest(weights: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack: sizes (class numbers, with repeats) whose weights add up to the most within capacity.
    weights and left are by class; class k takes k units."""
    sizes = np.flatnonzero(left)
    gain = weights[sizes]
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = fits[room]
        if k:
            sums = best[room - sizes[:k]] + gain[:k]
            at = sums.argmax()
            if sums[at] > best[room]:
                best[room], taken[room] = sums[at], sizes[at]
    chosen, room = [], capacity
    while room > 0:
        if taken[room]:
            chosen.append(taken[room])
            room -= taken[room]
        else:
            room -= 1
    return np.array(chosen, np.int64)


def plan(histogram: np.ndarray, capacity: int, grid: int = GRID, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """(sizes in one sequence, number of such sequences) for a histogram by class."""
    whole = histogram.astype(np.int64)
    # the linear program is over the large lengths, rounded up to steps of grid tokens
    n = np.zeros(-(-capacity // grid) + 1, np.int64)
    np.add.at(n, -(-np.arange(FINE, capacity + 1) // grid), whole[FINE:])
    left = n.copy()
    units = capacity // grid
    made: list[tuple[np.ndarray, int]] = []
    kept_at = [(0, left.copy())]
    size = np.arange(len(n))
    for _ in range(rounds):
        if not left.any():
            break
        share = np.where(n > 0, left / np.maximum(n, 1), 0)  # what is still to be covered of each class
        weights = size * np.exp(ETA * (share - share.max()))
        chosen = fullest(weights, left, units)
        if chosen.sum() < units:  # no full sequences any more
            break
        sizes, times = np.unique(chosen, return_counts=True)
        while (left[sizes] < times).any():  # fewer are left than the knapsack took
            times = np.minimum(times, left[sizes])
        step = np.maximum(1, np.floor(STEP * n[sizes]).astype(np.int64))
        count = int(max(1, min((left[sizes] // times).min(), (step // times).min())))
        left[sizes] -= times * count
        made.append((np.repeat(sizes, times), count))
        kept_at.append((len(made), left.copy()))
    # rounding: the solution up to some round, and best fit for the rest; the later round wins a tie
    points = [kept_at[len(kept_at) * part // 8 - 1] for part in range(8, 0, -1)]

    def completed(taken: int) -> list[tuple[np.ndarray, int]]:
        todo = whole.copy()
        return best_fit(todo, exact(made[:taken], todo, grid), capacity)

    done = (completed(taken) for taken in dict.fromkeys([*(taken for taken, _ in points), 0]))
    return min(done, key=lambda kinds: sum(count for _, count in kinds))


def exact(made: list[tuple[np.ndarray, int]], left: np.ndarray, grid: int) -> list[tuple[np.ndarray, int]]:
    """The configurations of steps filled with exact lengths, which are taken from left, the longest of a step first."""
    filled: list[tuple[np.ndarray, int]] = []
    at: dict[int, int] = {}  # by step: the longest length that is left
    for steps, count in made:
        while count:
            sizes, now = [], count
            for step, times in zip(*np.unique(steps, return_counts=True), strict=True):
                step, times = int(step), int(times)
                length = at.get(step, min(step * grid, len(left) - 1))
                while not left[length]:
                    length -= 1
                at[step] = length
                if left[length] >= times:
                    now = min(now, int(left[length]) // times)
                    sizes += [length] * times
                    continue
                now = 1  # one sequence of several lengths
                while times:
                    own = min(times, int(left[length]))
                    sizes += [length] * own
                    times -= own
                    length -= 1
            sizes = np.array(sizes, np.int64)
            np.subtract.at(left, sizes, now)
            filled.append((sizes, now))
            count -= now
    return filled


def best_fit(left: np.ndarray, made: list[tuple[np.ndarray, int]], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Packs what is left, largest first, each into the fullest kind of sequence with room; takes over kinds of `made`."""
    by_room: dict[int, list[list]] = {}
    for sizes, count in made:
        by_room.setdefault(capacity - int(sizes.sum()), []).append([sizes, count])
    rooms = np.zeros(capacity + 1, bool)
    rooms[list(by_room)] = True
    for size in np.flatnonzero(left)[::-1]:
        todo = int(left[size])
        while todo:
            found = np.flatnonzero(rooms[size:])
            if len(found):  # into the fullest kind that has room
                room = int(found[0] + size)
                kind = by_room[room][-1]
                count = min(todo, kind[1])
                sizes = np.append(kind[0], size)
                kind[1] -= count
                if not kind[1]:
                    by_room[room].pop()
                    rooms[room] = bool(by_room[room])
            else:
                each = capacity // size
                count, own = (todo // each, each) if todo >= each else (1, todo)
                sizes = np.full(own, size)
                todo -= count * (own - 1)
            todo -= count
            rest = capacity - int(sizes.sum())
            by_room.setdefault(rest, []).append([sizes, count])
            rooms[rest] = True
    return [(sizes, count) for kinds in by_room.values() for sizes, count in kinds if count]


def slots(made: list[tuple[np.ndarray, int]], classes: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: where runs of ranks begin, their first sequence, and how many ranks share a sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(classes, np.int64)
    first = 0
    for sizes, count in made:
        for size, times in zip(*np.unique(sizes, return_counts=True), strict=True):
            runs.setdefault(int(size), []).append((int(used[size]), first, int(times)))
            used[size] += count * times
        first += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY, grid: int = GRID, rounds: int = ROUNDS) -> DataFrame:
    """The rows of cut with sequence_id and offset. cut is read twice; it should be checkpointed."""
    classed = cut.withColumn("class", F.col("length").cast("int"))
    histogram = np.zeros(capacity + 1, np.int64)
    counted = classed.groupBy("class").agg(F.count("*").alias("n")).toPandas()  # `capacity` rows at most
    histogram[counted["class"].to_numpy(np.int64)] = counted["n"]
    places = slots(plan(histogram, capacity, grid, rounds), capacity + 1)
    if not places:
        return classed.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("class")
    buckets = 1 + int(histogram.max()) // RANKED_TOGETHER
    order = ["doc_id", "piece", "start", "ids_crc32", "length"]
    salted = classed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per_bucket = salted.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(*order)) - 1)
        .join(starts, ["class", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("base"))
    )

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            sequence = np.zeros(len(batch), np.int64)
            for k, rows in batch.groupby("class").indices.items():
                begin, first, times = places[int(k)]
                rank = batch["rank"].to_numpy()[rows]
                run = np.searchsorted(begin, rank, "right") - 1
                sequence[rows] = first[run] + (rank - begin[run]) // times[run]
            batch["sequence_id"] = sequence
            yield batch[[*names, "sequence_id"]]

    names = list(cut.columns)
    kinds = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    seated = ranked.select(*names, "class", "rank").mapInPandas(placed, f"{kinds}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(checkpointed(pieces(docs, tokenizer_path, capacity, with_ids)), capacity)
