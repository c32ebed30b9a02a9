"""Language-model scores by deleted interpolation.

P(word | previous) = l2 * c(previous, word) / c(previous) + l1 * c(word) / N + l0 / (V + 1): maximum-likelihood
estimates of orders two, one and zero, mixed by weights that depend on how often the previous word was seen (one
set of weights per power of two). The weights come from held-out counts: a part of the training documents is
taken out of the counts, expectation-maximisation finds the weights that make these documents likeliest, and
the score uses the counts of all training documents.

Counts stay distributed. Texts are dealt into blocks once. A block sends its distinct words and word pairs, as
sorted 64-bit hashes with their counts, in one packed row per key range; a key range adds up the counts of all blocks
and sends each block the totals of the keys it asked for, in the same order. So a word that a third of all
tokens hold is one number per block, and a block needs only the counts of its own keys. The likelihood ratios of
the held-out tokens are counted in fixed bins (at most LEVELS * RATIOS^2), on which the weights are fitted in one task.

Words are compared by 64-bit hashes. Tokens: words, lower-cased in A-Z, then one end per document.

Defined cases: a null text is empty and has the end token only. A null id hashes as the empty string (remainder 0, so it
trains). Without training documents all counts are 0 and every token has the uniform share 1 / (V + 1). Repeated rows count
and are scored each. An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.hashing import WordHashes, mixed

FOLDS = 5
#: Remainder of crc32(id) of the documents that are never learned from, and of those that fit the weights.
TESTED, FITTED = 1, 0
#: Characters of a block, and of the texts behind one key range, about.
BLOCK = 6_000_000
RANGE = 24_000_000
LEVELS = 40
#: Bins of a likelihood ratio: its binary logarithm from -32 to 32 in quarters; the first bin is a ratio of 0.
RATIOS = 256
ROUNDS = 60
#: Weights of orders zero, one and two before anything is fitted, and if there is nothing to fit them on.
FIRST_GUESS = [0.1, 0.3, 0.6]
END = b"\n"  # no word holds white space
START = b"\n\n"
ONE = np.uint64(1)


class Block:
    """The tokens of a block of documents: numbers into its sorted distinct keys."""

    def __init__(self, texts: list, hashes: WordHashes) -> None:
        end, start = hashes[END], hashes[START]
        parts, sizes = [], []
        for text in texts:
            words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
            parts += [np.array([start], np.uint64), hashes.of(words), np.array([end], np.uint64)]
            sizes.append(len(words) + 1)
        stream = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.sizes = np.array(sizes, np.int64)
        starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        real = np.ones(len(stream), bool)
        real[starts] = False
        words, self.word_of = np.unique(stream & ~ONE, return_inverse=True)
        pair = mixed(mixed(stream[:-1]) + stream[1:] * np.uint64(3)) | ONE
        pairs, pair_of = np.unique(pair[real[1:]], return_inverse=True)
        self.keys = np.concatenate([words, pairs])
        order = np.argsort(self.keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys = self.keys[order]
        at = np.flatnonzero(real)
        self.token = place[self.word_of[at]]
        self.previous = place[self.word_of[at - 1]]
        self.pair = place[pair_of + len(words)]
        self.started = place[self.word_of[starts]] if len(starts) else starts
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def counts(self, used: np.ndarray) -> np.ndarray:
        """How often the documents marked in used hold each key."""
        own = used[self.doc]
        n = len(self.keys)
        return np.bincount(self.token[own], minlength=n) + np.bincount(self.pair[own], minlength=n) + np.bincount(self.started[used], minlength=n)


def key_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Keys are dealt by their upper bits, so ranges in order hold sorted keys in order."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def pack(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(x.astype(kind).tobytes(), 1)


def unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps: the lower five bytes as they are, the upper three, which are small, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps[:, :5].tobytes() + zlib.compress(np.ascontiguousarray(steps[:, 5:].T).tobytes(), 1)


def unpack_keys(x: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :5] = np.frombuffer(x, np.uint8, 5 * n).reshape(n, 5)
    steps[:, 5:] = np.frombuffer(zlib.decompress(x[5 * n :]), np.uint8).reshape(3, n).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def folded(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text, fold, block."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.cast("int").alias("fold"), block.alias("block")).repartition("block")


def requests(ranges: int):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(list(rows["text"]), WordHashes())
        fold = rows["fold"].to_numpy()
        learned, fitted = block.counts(fold != TESTED), block.counts(fold == FITTED)
        cuts = np.searchsorted(key_range(block.keys, ranges), np.arange(ranges + 1))
        number = int(rows["block"].iloc[0])
        out = []
        for k in range(ranges):  # every range, as each tells the block its share of V and N
            a, b = cuts[k], cuts[k + 1]
            out.append((k, number, pack_keys(block.keys[a:b]), pack(learned[a:b], "<u4"), pack(fitted[a:b], "<u4")))
        return pd.DataFrame(out, columns=["key_range", "block", "keys", "learned", "fitted"])

    return ask


def answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds up the counts of one key range and answers every block; v, n and n_fitted are the range's part of V and of N."""
    counts = [(unpack(learned, "<u4"), unpack(fitted, "<u4")) for learned, fitted in zip(rows["learned"], rows["fitted"], strict=True)]
    keys = [unpack_keys(k, len(c[0])) for k, c in zip(rows["keys"], counts, strict=True)]
    distinct = np.unique(np.concatenate(keys))
    totals = np.zeros((2, len(distinct)), np.int64)
    at = [np.searchsorted(distinct, k) for k in keys]
    for where, (learned, fitted) in zip(at, counts, strict=True):
        totals[0][where] += learned
        totals[1][where] += fitted
    start = np.uint64(WordHashes()[START]) & ~ONE
    words = ((distinct & ONE) == 0) & (distinct != start)
    return pd.DataFrame(
        {
            "key_range": rows["key_range"].array,
            "block": rows["block"].array,
            "learned": [pack(totals[0][w], "<i8") for w in at],
            "fitted": [pack(totals[1][w], "<i8") for w in at],
            "v": int((totals[0][words] > 0).sum()),
            "n": int(totals[0][words].sum()),
            "n_fitted": int(totals[1][words].sum()),
        }
    )


ANSWER = "key_range int, block int, learned binary, fitted binary, v long, n long, n_fitted long"


def totals(rows: pd.DataFrame, name: str) -> np.ndarray:
    """The totals of a block's keys, in the order of the keys."""
    return np.concatenate([unpack(x, "<i8") for x in rows.sort_values("key_range")[name]])


def level(seen: np.ndarray) -> np.ndarray:
    """The bucket of a context: 0 if never seen, else 1 + the binary logarithm of how often."""
    return np.where(seen > 0, 1 + np.floor(np.log2(np.maximum(seen, 1))), 0).astype(np.int64).clip(0, LEVELS - 1)


def estimates(token: np.ndarray, previous: np.ndarray, pair: np.ndarray, n: int, v: int) -> np.ndarray:
    """Orders zero, one and two for every token, from counts."""
    return np.stack([np.full(len(token), 1 / (v + 1)), token / max(n, 1), np.where(previous > 0, pair / np.maximum(previous, 1), 0)])


def ratio_bin(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.clip(np.round(4 * np.log2(np.where(x > 0, x, 1))) + RATIOS // 2, 1, RATIOS - 1), 0).astype(np.int64)


def count_ratios(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """How many held-out tokens of the block have which context level and which ratios of order one and two to zero."""
    names = ["level", "one", "two", "n"]
    held = texts["fold"].to_numpy() == FITTED if len(texts) else np.zeros(0, bool)
    if not held.any() or not len(counts):
        return pd.DataFrame(columns=names)
    block = Block(list(texts["text"]), WordHashes())
    c = totals(counts, "learned") - totals(counts, "fitted")  # deleted: without the held-out documents
    v, n = int(counts["v"].sum()), int(counts["n"].sum() - counts["n_fitted"].sum())
    own = held[block.doc]
    zero, one, two = estimates(c[block.token[own]], c[block.previous[own]], c[block.pair[own]], n, v)
    code = (level(c[block.previous[own]]) * RATIOS + ratio_bin(one / zero)) * RATIOS + ratio_bin(two / zero)
    code, times = np.unique(code, return_counts=True)
    return pd.DataFrame({"level": code // RATIOS**2, "one": code // RATIOS % RATIOS, "two": code % RATIOS, "n": times}, columns=names)


def fit(rows: pd.DataFrame) -> pd.DataFrame:
    """The weights of orders zero, one, two per level, by expectation-maximisation on the counted ratios.
    Every level begins with a small share of all tokens, so that rare levels lean on the rest."""
    weights = np.tile(FIRST_GUESS, (LEVELS, 1))
    ratio = lambda b: np.where(b > 0, 2.0 ** ((b - RATIOS // 2) / 4), 0)
    at = rows["level"].to_numpy()
    n = rows["n"].to_numpy(float)
    like = np.stack([np.ones(len(rows)), ratio(rows["one"].to_numpy()), ratio(rows["two"].to_numpy())], axis=1)
    for _ in range(ROUNDS):
        part = weights[at] * like
        part *= (n / part.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(at, part[:, k], LEVELS) for k in range(3)], axis=1)
        overall = sums.sum(axis=0) / max(sums.sum(), 1)
        sums += overall if sums.sum() else weights
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0] = [weights[0][0], weights[0][1], 0]  # an unseen context says nothing
    weights[0] /= weights[0].sum()
    return pd.DataFrame({"weights": [weights.ravel().tolist()]})


def score_block(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if not len(texts):
        return pd.DataFrame(columns=names)
    block = Block(list(texts["text"]), WordHashes())
    c = totals(counts, "learned")
    v, n = int(counts["v"].sum()), int(counts["n"].sum())
    found = counts["weights"].iloc[0]
    weights = np.tile(FIRST_GUESS, (LEVELS, 1)) if found is None else np.array(found).reshape(LEVELS, 3)
    token, previous = c[block.token], c[block.previous]
    mix = (weights[level(previous)].T * estimates(token, previous, c[block.pair], n, v)).sum(axis=0)
    base = np.log10((token + 0.5) / (n + 0.5 * (v + 1)))
    docs = len(texts)
    out = pd.DataFrame(
        {
            "doc_id": texts["doc_id"].astype("Int64").array,
            "held_out": texts["fold"].to_numpy() == TESTED,
            "n_tokens": block.sizes,
            "n_known": np.bincount(block.doc, token > 0, docs).astype(np.int64),
            "train_tokens": n,
            "base_score": np.bincount(block.doc, base, docs),
            "score": np.bincount(block.doc, np.log10(mix), docs),
        },
        columns=names,
    )
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, ranges = max(16, chars // BLOCK), max(64, chars // RANGE)
    texts = folded(docs, blocks)
    asked = texts.groupBy("block").applyInPandas(requests(ranges), "key_range int, block int, keys binary, learned binary, fitted binary")
    # dealt by block once, for the fit and for the scores
    told = asked.groupBy("key_range").applyInPandas(answers, ANSWER).repartition("block")
    ratios = texts.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(count_ratios, "level int, one int, two int, n long")
    binned = ratios.groupBy("level", "one", "two").agg(F.sum("n").alias("n"))
    weights = binned.groupBy().applyInPandas(fit, "weights array<double>")
    fitted = weights.agg(F.first("weights").alias("weights")).scalar()
    scored = texts.groupBy("block").cogroup(told.withColumn("weights", fitted).groupBy("block"))
    return scored.applyInPandas(score_block, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
