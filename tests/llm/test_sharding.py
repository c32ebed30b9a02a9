"""A uniform shuffle into exact shards, against a plain walk through the same draws."""

import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from spendloom.llm import registry, sharding

MASK = 2**64 - 1


def spark_hash(*parts):
    """xxhash64 of numbers (int as 4 bytes, Long as 8) and texts, each seeded with the hash before."""
    seed = 42
    for part in parts:
        raw = part.encode() if isinstance(part, str) else struct.pack("<q" if isinstance(part, Long) else "<i", part)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


class Long(int):
    pass


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def bijection(x, n, *key):
    for r in range(sharding.ROUNDS):
        k = signed(spark_hash(*key, r))
        y = (k % n - x) % n
        if spark_hash(Long(k), Long(max(x, y))) & 1:
            x = y
    return x


def test_places_equal_a_plain_walk(spark, documents):
    docs = documents([(i, f"t{i}") for i in range(700)]).repartition(37)
    n = docs.rdd.glom().map(len).collect()
    sizes = spark.createDataFrame(list(enumerate(n)), "partition long, n long")
    matrix = sorted(map(tuple, sharding.matrix(sizes.filter("n > 0"), 8, 13).select("partition", "n", "counts", "first").collect()))
    capacity = [700 // 8 + (s < 700 % 8) for s in range(8)]
    before = [0] * 8
    for _, size, counts, first in matrix:
        assert sum(counts) == size and first == before
        before = [a + b for a, b in zip(before, counts, strict=True)]
    assert before == capacity

    folder_rows = sharding.placed(docs, 8, 13)
    got = sorted((r["shard"], r["slot"]) for r in folder_rows.collect())
    assert got == [(s, k) for s in range(8) for k in range(capacity[s])]
    expected = {}
    for p, size, counts, first in matrix:
        for i in range(size):
            local, shard = bijection(i, size, 13, "local", Long(p)), 0
            while local >= counts[shard]:
                local, shard = local - counts[shard], shard + 1
            expected[bijection(first[shard] + local, capacity[shard], 13, "shard", shard), shard] = (p, i)
    in_order = [(p, i, r["doc_id"]) for p, rows in enumerate(docs.rdd.glom().collect()) for i, r in enumerate(rows)]
    ids = {(p, i): doc for p, i, doc in in_order}
    for r in folder_rows.collect():
        assert ids[expected[r["slot"], r["shard"]]] == r["row"]["doc_id"]


def probability(x, m, a, n):
    lf = lambda k: math.lgamma(k + 1)
    return math.exp(lf(a) - lf(x) - lf(a - x) + lf(n - a) - lf(m - x) - lf(n - a - m + x) - lf(n) + lf(m) + lf(n - m))


@pytest.mark.parametrize(("m", "a", "n"), [(5, 7, 20), (15, 17, 20), (300, 500, 1500), (1200, 900, 1500)])
def test_numbers_are_hypergeometric(spark, m, a, n):
    rows = 10_000
    whole = [F.lit(x).cast("long") for x in (m, a, n)]
    drawn = spark.range(rows).select(sharding.hypergeometric(*whole, F.col("id")).alias("x")).groupBy("x").count()
    found = {r["x"]: r["count"] for r in drawn.collect()}
    expected = {x: rows * probability(x, m, a, n) for x in range(max(0, m + a - n), min(m, a) + 1)}
    assert set(found) <= set(expected)
    cells = [x for x, e in expected.items() if e > 10]
    distance = sum((found.get(x, 0) - expected[x]) ** 2 / expected[x] for x in cells)
    assert distance < len(cells) + 5 * math.sqrt(2 * len(cells))


def test_sure_numbers(spark):
    rows = spark.createDataFrame([(0, 5, 9, 0), (4, 0, 9, 0), (4, 9, 9, 4), (9, 5, 9, 5), (1, 1, 1, 1), (0, 0, 0, 0)], "m long, a long, n long, x long")
    got = rows.select(sharding.hypergeometric(F.col("m"), F.col("a"), F.col("n"), F.lit(1)).alias("got"), "x").collect()
    assert all(r["got"] == r["x"] for r in got)


def test_a_bijection_is_one_and_spreads(spark):
    for n in (1, 2, 7, 256):
        images = [[r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(k))).collect()] for k in range(6)]
        assert all(sorted(x) == list(range(n)) for x in images)
    fixed = sum(a == b for x in images for b, a in enumerate(x))
    assert fixed < 20 and len(set(map(tuple, images))) == 6


def test_shards_of_the_query(spark, documents, saved):
    texts = [(0, None), (1, ""), (2, "é€"), (None, "x"), *[(i, "copy") for i in range(3, 60)], (60, "a" * 300_000), (61, "dup"), (61, "dup")]
    docs = documents(texts).withColumn("shard", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("total", F.lit(2)).withColumn("at", F.lit(3))
    got = registry.op13_shards(spark, saved(documents=docs)).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    by_shard = Counter(r["shard"] for r in got)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(8) for k in range(by_shard[s])]
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_few_rows_and_none(spark, documents):
    assert sharding.placed(documents([])).count() == 0
    assert sorted((r["shard"], r["slot"]) for r in sharding.placed(documents(["a", "b", "c"])).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_copies_and_neighbours_part(spark, documents):
    """Of rows that come one after the other, as many fall into one shard as of any rows."""
    placed = {r["row"]["doc_id"]: r["shard"] for r in sharding.placed(documents([(i, "same") for i in range(4000)]).repartitionByRange(5, "doc_id")).collect()}
    together = sum(placed[i] == placed[i + 1] for i in range(3999))
    assert abs(together - 500) < 5 * math.sqrt(500)


def test_shards_are_written_in_order(spark, documents, tmp_path):
    found = sharding.placed(documents([f"t{i}" for i in range(100)]), 4)
    sharding.write_shards(found, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {(int(r["shard"]), r["slot"], r["row"]["doc_id"]) for r in back.collect()} == {(r["shard"], r["slot"], r["row"]["doc_id"]) for r in found.collect()}
    for file in (tmp_path / "shards" / "shard=2").glob("*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
