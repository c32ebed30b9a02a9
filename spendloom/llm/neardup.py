"""Near-duplicates by order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number so that all are
distinct. A sketch takes the three shingles that come first under a random order and keeps them in text order, so
two texts agree on it only if they have these shingles in common and in the same order. Texts that agree on one
of SKETCHES sketches are candidates.

Exact copies (equal word sequences) are one node from the start. Every member of a sketch's bucket is compared
with the least and the greatest node of the bucket, so a bucket of g texts gives 2g candidates and not g^2. Pairs
are verified in two rounds: one pair per member, then those whose ends are not connected yet. Verification aligns the
labelled shingles (longest chain of equal shingles in the same order, within the band that the threshold leaves):
similarity = aligned / (n1 + n2 - aligned) >= 0.8. Classes are the connected components.

Most buckets hold one class by then. The members of the others (texts over one long template, say) go through a third
round that splits them by their rarest shingles: two texts of n1 <= n2 shingles can only reach the threshold if, in
one common order of all shingles, the first n1 / 9 + 1 of the one and the first n2 / 5 + 1 of the other share one. The
order is by frequency among these members, so that what a family has in common comes last and brings nobody
together. Only texts of different classes meet there, and only if the parities of their shingles (64 * PARITIES bits,
of which two texts cannot differ in more than in shingles) leave the threshold within reach: first those that all or
any members of two classes have, then those of a text and a class, then those of two texts. So no link is lost between
texts that agree on a sketch.

Two texts of similarity 0.8 agree on a sketch with a chance of about one half, so all 16 miss with 1 in 60,000;
the tests compare with brute force over all pairs, also of families over one template.

Defined cases: texts without words, null too, are exact copies of each other. Texts of fewer than five words are one
shingle. Repeated rows are exact copies; class ids are the least document id of the class, null if there is
none. An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import checkpointed, hash_joins, lean, release, words_of
from spendloom.llm.components import components
from spendloom.llm.hashing import WordHashes, as_long, labelled, mixed, runs

SHINGLE = 5
SKETCHES = 16
TAKEN = 3
#: Similarity at least FOUR / FIVE.
FOUR, FIVE = 4, 5
#: Shingles that are looked at together when a sketch is taken.
SLICE = 20_000
#: Longs with the parities of a text's shingles, which stand for it while pairs are formed.
PARITIES = 8
#: Lengths of similar texts lie in the same or in neighbouring bands (a little wider than FIVE / FOUR).
BAND = 1.26

_random = np.random.default_rng(7)
MASKS = _random.integers(0, 2**63, (SKETCHES, 1), np.uint64)
FACTORS = _random.integers(0, 2**63, (SKETCHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """One hash per sketch of the labelled shingles."""
    found = []
    for low in range(0, len(shingles), SLICE):
        keys = (shingles[low : low + SLICE] ^ MASKS) * FACTORS
        keys ^= keys >> np.uint64(32)
        taken = min(TAKEN, keys.shape[1])
        at = np.argpartition(keys, taken - 1, axis=1)[:, :taken] if taken < keys.shape[1] else np.tile(np.arange(taken), (SKETCHES, 1))
        found.append((np.take_along_axis(keys, at, 1), at + low))
    keys, at = (np.concatenate(x, axis=1) for x in zip(*found, strict=True))
    at = np.sort(np.take_along_axis(at, np.argsort(keys, axis=1, kind="stable")[:, :TAKEN], 1), axis=1)
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    for k in range(at.shape[1]):
        out = mixed(out + shingles[at[:, k]])
    return out


def digest(text: Column) -> Column:
    """128 bits of the word sequence; the same as digest_of in Python."""
    return F.unhex(F.md5(F.array_join(words_of(text), " ")))


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()


def split(text: object) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if isinstance(text, str) else []


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_shingles, sketches for every row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = split(text)
                shingles = labelled(runs(hashes.of(words), SHINGLE))
                out.append((digest_of(words), len(shingles), as_long(sketches(shingles)) if len(shingles) else []))
            rows = pd.DataFrame(out, columns=["digest", "n_shingles", "sketches"])
            rows.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lean(work), "doc_id long, digest binary, n_shingles int, sketches array<long>")


def sequences(docs: DataFrame) -> DataFrame:
    """digest, words (32 bits a word, packed) of every row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = split(text)
                out.append((digest_of(words), hashes.of(words).astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["digest", "words"])

    return docs.select("text").mapInPandas(lean(work), "digest binary, words binary")


def in_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, label) for every node and sketch."""
    exploded = nodes.select("node", F.col("n_shingles").alias("n"), "label", F.posexplode("sketches").alias("k", "sketch"))
    return exploded.select(F.xxhash64("k", "sketch").alias("bucket"), "node", "n", "label")


def candidates(members: DataFrame) -> DataFrame:
    """Distinct (hub, member): every node of a bucket with the bucket's least and greatest node, lengths permitting."""
    members = members.select("bucket", "node", "n")
    ends = [F.min("node").alias("least"), F.min_by("n", "node").alias("least_n"), F.max("node").alias("most"), F.max_by("n", "node").alias("most_n")]
    hubs = checkpointed(members.groupBy("bucket").agg(*ends).filter("least != most"))
    both = F.array(*[F.struct(F.col(end).alias("node"), F.col(f"{end}_n").alias("n")) for end in ("least", "most")])
    met = members.join(hubs, "bucket").select("node", "n", F.explode(both).alias("hub"))
    close = (FOUR * F.greatest("hub.n", "n") <= FIVE * F.least("hub.n", "n")) & (F.col("hub.node") != F.col("node"))
    return met.filter(close).select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()


def unsettled(members: DataFrame) -> DataFrame:
    """Distinct nodes of the members that share a bucket with a member of another label and of similar length."""
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / np.log(BAND)).cast("int"))
    spans = banded.groupBy("bucket", "band").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    around = spans.select("bucket", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "least", "most")
    several = around.groupBy("bucket", "band").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least != most")
    return banded.join(several, ["bucket", "band"], "left_semi").select("node").distinct()


def parities(shingles: np.ndarray) -> np.ndarray:
    """64 * PARITIES bits, each telling whether an odd number of the shingles falls on it: two texts differ in at least
    as many shingles as bits."""
    places = 64 * PARITIES
    odd = np.bincount((mixed(shingles) % np.uint64(places)).astype(np.int64), minlength=places) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingles_of(texts: DataFrame) -> DataFrame:
    """(id, shingles, odd: their parities) of every text (id, words)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingled(words) for words in batch["words"]]
            yield pd.DataFrame({"id": batch["id"], "shingles": [as_long(x) for x in own], "odd": [parities(x) for x in own]})

    texts = texts.select("id", "words")
    return texts.mapInPandas(lean(work), f"id {texts.schema['id'].dataType.simpleString()}, shingles array<long>, odd array<long>")


def by_rare_shingles(nodes: DataFrame, texts: DataFrame, key: str = "digest") -> DataFrame:
    """Distinct pairs (a, b) of nodes of different labels that can be similar by their rarest shingles; key names the
    column that tells the nodes apart."""
    named = nodes.select(F.col(key).alias("id"), F.xxhash64("label").alias("label"))
    found = shingles_of(texts.withColumnRenamed(key, "id")).join(named, "id").withColumn("node", F.monotonically_increasing_id())
    found = checkpointed(found)  # the numbers hold from here on
    rows = found.select("node", F.explode("shingles").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count("*").cast("int").alias("df")).filter("df > 1")
    shared = rows.join(counts, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    # shingles of a single text come first and meet nobody
    lengths = found.select("node", "label", F.size("shingles").alias("n"))
    placed = shared.join(lengths, "node").withColumn("alone", F.col("n") - F.size("shared"))
    leading = F.slice("shared", 1, F.greatest(F.lit(0), F.floor(F.col("n") / FIVE).cast("int") + 1 - F.col("alone")))
    keys = placed.select("node", "n", "label", "alone", F.posexplode(leading).alias("nth", "key"))
    keys = keys.select(F.col("key.shingle").alias("shingle"), "node", "n", "label", (F.col("n") - F.col("alone") - F.col("nth")).alias("rest"))
    keys = checkpointed(keys.withColumn("short", F.col("n") - F.col("rest") <= F.floor(F.col("n") / (FOUR + FIVE))))
    several = keys.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most")
    keys = checkpointed(keys.join(several, "shingle", "left_semi").join(found.select("node", "id", "odd"), "node").drop("node"))
    # labels meet before their members do, so the members of one class are never paired
    spans = [F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.max(F.when(F.col("short"), F.col("n"))).alias("most_short")]
    for name, bits in (("all", F.bit_and), ("any", F.bit_or)):
        spans.append(F.array(*[bits(F.col("odd")[k]) for k in range(PARITIES)]).alias(name))
    held = checkpointed(keys.groupBy("shingle", "label").agg(*spans))
    del found, rows, counts, shared, lengths, placed, several
    release(nodes.sparkSession)
    one, two = (held.select("shingle", *[F.col(c).alias(f"{c}_{end}") for c in held.columns[1:]]) for end in "xy")
    n, total = F.col("most_short_x"), F.col("least_x") + F.col("least_y")
    possible = (F.col("label_x") != F.col("label_y")) & (F.col("least_x") <= F.col("most_y")) & (FOUR * F.col("least_y") <= FIVE * n)
    possible &= reaches(F.col("rest_x"), F.col("rest_y"), total) & differ_little("all_x", "any_x", "all_y", "any_y", n + F.col("most_y"))
    meeting = one.filter("most_short_x is not null").join(two, "shingle").filter(possible).select("shingle", "label_x", *two.columns[1:])
    # then a member and a label, and last two members
    x, y = (keys.select("shingle", *[F.col(c).alias(f"{c}_{end}") for c in ("id", "n", "label", "odd")], F.col("rest").alias(f"own_rest_{end}"), "short") for end in "xy")
    n = F.col("n_x")
    possible = (n <= F.col("most_y")) & (FOUR * F.col("least_y") <= FIVE * n) & reaches(F.col("own_rest_x"), F.col("rest_y"), n + F.greatest(n, "least_y"))
    possible &= differ_little("odd_x", "odd_x", "all_y", "any_y", n + F.col("most_y"))
    met = meeting.join(x.filter("short"), ["shingle", "label_x"]).filter(possible).select("shingle", "label_y", "id_x", "n_x", "odd_x", "own_rest_x")
    total = F.col("n_x") + F.col("n_y")
    ordered = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y")))
    fits = ordered & (FOUR * F.col("n_y") <= FIVE * F.col("n_x")) & reaches(F.col("own_rest_x"), F.col("own_rest_y"), total)
    met = met.join(y, ["shingle", "label_y"]).filter(fits & differ_little("odd_x", "odd_x", "odd_y", "odd_y", total))
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def differ_little(all_x: str, any_x: str, all_y: str, any_y: str, total: Column) -> Column:
    """Whether texts of at most so many shingles together can be similar by their parities; named are the columns with
    the bits that all and that any of one side's texts have. total - 2 * common shingles differ."""

    def bits(k: int) -> Column:
        only_x, only_y = (F.col(one)[k].bitwiseAND(F.bitwise_not(F.col(other)[k])) for one, other in ((all_x, any_y), (all_y, any_x)))
        return F.bit_count(only_x.bitwiseOR(only_y))

    # a plain sum, which Spark compiles: a function over arrays leaves arrays behind for every pair
    return (FOUR + FIVE) * reduce(add, map(bits, range(PARITIES))) <= (FIVE - FOUR) * total


def reaches(rest_x: Column, rest_y: Column, total: Column) -> Column:
    """Whether texts whose first common shingle leaves so many (itself counted) can have enough in common."""
    return (FOUR + FIVE) * F.least(rest_x, rest_y) >= FOUR * total


def shingled(words: bytes) -> np.ndarray:
    return labelled(runs(np.frombuffer(words, "<u4").astype(np.uint64), SHINGLE))


def similar(one: bytes, two: bytes) -> bool:
    """Whether the best banded alignment of the labelled shingles reaches the threshold."""
    a, b = shingled(one), shingled(two)
    total = len(a) + len(b)
    need = -(-FOUR * total // (FOUR + FIVE))
    _, at, other = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = total - 2 * need  # shingles that may stay without partner
    near = np.abs(at - other) <= band
    at, other = at[near], other[near]
    if len(at) < need:
        return False
    other = other[np.argsort(at)]
    if (np.diff(other) > 0).all():
        return True
    ends: list[int] = []  # longest rising chain
    for x in other.tolist():
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends) >= need


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[similar(x, y) for x, y in zip(batch["one"], batch["two"], strict=True)], ["a", "b"]]

    one = texts.select(F.col("node").alias("a"), F.col("words").alias("one"))
    two = texts.select(F.col("node").alias("b"), F.col("words").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInPandas(lean(work), "a long, b long")


def classed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes with the labels of their components, their own numbers for single nodes."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        pairs = pairs.join(known, end, "left")
    return pairs.filter(~F.coalesce(F.col("a_label") == F.col("b_label"), F.lit(False))).select("a", "b")


def linked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of all nodes (digest, node, n_shingles, sketches) that are similar to another one."""
    members = checkpointed(in_buckets(nodes.withColumn("label", F.col("node"))))
    pairs = checkpointed(candidates(members))
    needed = checkpointed(nodes.select("node", "digest").join(unsettled(members), "node", "left_semi"))
    del members
    release(docs.sparkSession)
    texts = sequences(docs).groupBy("digest").agg(F.first("words").alias("words"))
    texts = checkpointed(texts.join(needed, "digest").select("node", "words"))
    first = checkpointed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    edges = checkpointed(verified(first, texts))
    del needed
    release(docs.sparkSession)
    left = checkpointed(apart(pairs.join(first, ["a", "b"], "left_anti"), components(edges)))
    edges = checkpointed(edges.union(verified(left, texts)))
    now = checkpointed(classed(nodes, components(edges)))
    open_nodes = now.join(checkpointed(unsettled(in_buckets(now))), "node", "left_semi")
    open_nodes = checkpointed(open_nodes.select("node", "label"))
    del pairs, first, now
    release(docs.sparkSession)
    pairs = checkpointed(by_rare_shingles(open_nodes, texts, "node").join(left, ["a", "b"], "left_anti"))
    return components(edges.union(checkpointed(verified(pairs, texts))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id, kept for every row. kept: the document with the least id of its class (null ids last);
    rows that repeat it with the same id and words are kept too."""
    with hash_joins(docs.sparkSession):
        rows = checkpointed(sketched(docs))
        first = [F.first(c).alias(c) for c in ("n_shingles", "sketches")]
        nodes = rows.groupBy("digest").agg(*first, F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("least"))
        # numbers stand for the nodes from here on: half the bytes of digests, and folded by hash instead of by sort
        nodes = checkpointed(nodes.sortWithinPartitions("digest").withColumn("node", F.monotonically_increasing_id()))
        labels = linked(docs, nodes.select("digest", "node", "n_shingles", "sketches"))
        found = checkpointed(classed(nodes.select("node", "digest", "least"), labels))
        chosen = found.groupBy("label").agg(F.min(F.struct("least", "digest")).alias("chosen"))
        named = checkpointed(found.join(checkpointed(chosen), "label").select("digest", F.col("chosen.least.doc_id").alias("class_id"), (F.col("digest") == F.col("chosen.digest")).alias("holds")))
    return rows.select("doc_id", "digest").join(named, "digest").select("doc_id", "digest", "class_id", (F.col("holds") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, one per class."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    packed = packed.select("row", digest(F.col("row.text")).alias("digest"))
    same = F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    left = packed.join(checkpointed(kept), same, "left_semi").withColumn("doc_id", F.col("row.doc_id"))
    return left.dropDuplicates(["doc_id", "digest"]).select("row.*")
