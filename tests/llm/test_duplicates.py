"""Near-duplicates, connected components and substring dedup."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from llm import brute
from spendloom.llm import checks, components, neardup, registry, substrings
from spendloom.llm.common import checkpointed


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def edited(rng, own, n):
    own = list(own)
    for _ in range(n):
        k = rng.randrange(len(own))
        own[k : k + rng.choice((0, 1))] = words(rng, rng.choice((0, 1)))
    return own


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [None, "", " ", "one", "one", "one two three", "one two three four", "w " * 400]
    shared = words(rng, 60)
    for _ in range(25):
        base = words(rng, rng.randint(30, 400))
        texts.append(" ".join(base))
        for n in (0, 1, 3, 8, 30):
            texts.append("  ".join(edited(rng, base, n)))
    hub = words(rng, 300)
    texts += [" ".join(edited(rng, hub, 1)) for _ in range(60)]  # one large group
    texts += [" ".join(words(rng, 40) + shared + words(rng, 40)) for _ in range(40)]  # unrelated but for a passage
    return texts


def classes_of(rows):
    return {r["doc_id"]: r["class_id"] for r in rows}


def test_classes_equal_all_pairs(documents, corpus):
    rows = neardup.near_duplicates(documents(corpus)).collect()
    assert classes_of(rows) == dict(enumerate(brute.classes(corpus)))
    assert [r["doc_id"] for r in rows if r["kept"]] and sum(r["kept"] for r in rows) == len(set(classes_of(rows).values()))


@pytest.mark.parametrize("share", [0.7, 0.8, 0.85, 0.87])
def test_no_pair_is_lost_in_a_family_over_one_template(documents, share):
    """Texts of 200 words that have most of them in common; each has one partner that is nearer."""
    rng = random.Random(5)
    common = words(rng, int(200 * share))
    texts = []
    for _ in range(80):
        own = words(rng, 200 - len(common))
        texts += [" ".join(own + common), " ".join(words(rng, 13) + own[13:] + common)]
    rng.shuffle(texts)
    expected = brute.classes(texts)
    assert len(set(expected)) == 80
    assert classes_of(neardup.near_duplicates(documents(texts)).collect()) == dict(enumerate(expected))


def test_texts_below_the_threshold_form_few_pairs(documents):
    """Texts of a common part and two passages: those with one passage in common are below the threshold."""
    rng = random.Random(6)
    common, first, second = words(rng, 150), [words(rng, 25) for _ in range(10)], [words(rng, 25) for _ in range(10)]
    texts = [" ".join(x + common + y) for x in first for y in second]
    texts += [" ".join(text.split()[:-1]) for text in texts[:5]]
    packed = neardup.sequences(documents(texts))
    pairs = neardup.by_rare_shingles(packed.select("digest", F.col("digest").alias("label")), packed).collect()
    digests = [neardup.digest_of(text.encode().split()) for text in texts]
    found = {frozenset(map(bytes, r)) for r in pairs}
    assert found >= {frozenset((digests[k], digests[100 + k])) for k in range(5)}
    assert len(found) < 300  # 836 if texts meet by rare shingles alone


def test_buckets_are_folded_by_numbers(documents, corpus, monkeypatch):
    """Nodes and pairs travel as longs, which Spark folds by hash; digests were sorted before each fold."""
    seen = []
    monkeypatch.setattr(neardup, "checkpointed", lambda df: seen.append(df) or checkpointed(df))
    docs = documents(corpus)
    found = classes_of(neardup.near_duplicates(docs).collect())
    assert found == dict(enumerate(brute.classes(corpus)))
    pairs = [df for df in seen if df.columns == ["a", "b"]]
    assert pairs and {kind for df in pairs for _, kind in df.dtypes} == {"bigint"}
    buckets = [df for df in seen if "bucket" in df.columns]
    assert buckets and all("binary" not in dict(df.dtypes).values() for df in buckets)
    folded = [df for df in buckets if "least" in df.columns]
    assert folded and "SortAggregate" not in folded[0]._jdf.queryExecution().executedPlan().toString()


def test_joins_of_small_partitions_are_not_sorted(spark, documents, corpus, monkeypatch):
    """Each sort took a page of the heap on either side; the session's own setting comes back."""
    seen, name = [], "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    monkeypatch.setattr(neardup, "checkpointed", lambda df: (df, seen.append(df), checkpointed(df))[-1])
    held = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.autoBroadcastJoinThreshold": "-1", name: "1k"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        found = classes_of(neardup.near_duplicates(documents(corpus)).collect())
        assert spark.conf.get(name) == "1k"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == dict(enumerate(brute.classes(corpus)))
    final = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0] for df in seen]
    hashed, merged = (sum(plan.count(join) for plan in final) for join in ("ShuffledHashJoin", "SortMergeJoin"))
    assert hashed > 3 * merged


def test_bounds_by_parities_are_compiled(documents, corpus):
    packed = neardup.sequences(documents(corpus)).distinct()
    pairs = neardup.by_rare_shingles(packed.select("digest", F.col("digest").alias("label")), packed)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "lambda" not in plan


def test_workers_return_what_they_freed():
    """A worker that lives on would keep the most that it ever took."""
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from spendloom.llm import common
size = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmRSS"))
kept, sizes = [], []
def work(batches):
    for _ in batches:
        rows = [bytearray(3000) for _ in range(50_000)]
        kept.append(rows[-1])
        sizes.append(size())
        del rows
        yield None
list(common.lean(work)(iter([0])))
print((sizes[0] - size()) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code, str(Path(__file__).parents[2])], capture_output=True, check=True, text=True).stdout
    assert int(out) > 100


def test_parities_never_differ_in_more_bits_than_shingles():
    rng = random.Random(8)
    for _ in range(50):
        base = words(rng, rng.randint(5, 900))
        one, two = (neardup.shingled(neardup.WordHashes().of([w.encode() for w in x]).astype("<u4").tobytes()) for x in (base, edited(rng, base, 20)))
        bits = neardup.parities(one) ^ neardup.parities(two)
        assert sum(int(x).bit_count() for x in bits.view("u8")) <= len(set(one.tolist()) ^ set(two.tolist()))


def test_recall_on_given_documents(spark, documents):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).collect()]
    got, expected = classes_of(neardup.near_duplicates(documents(texts)).collect()), brute.classes(texts)
    linked = [k for k, c in enumerate(expected) if c != k]
    found = [k for k in linked if got[k] == expected[k]]
    assert len(found) >= 0.9 * len(linked)
    assert all(got[k] == k for k in range(len(texts)) if expected.count(expected[k]) == 1)


def test_duplicates_of_odd_rows(documents):
    docs = documents([(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (2, ""), (9, "x y"), (9, "z")])
    docs = docs.withColumn("class_id", F.lit("mine")).withColumn("digest", F.lit(0))
    rows = neardup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"], r["kept"]) for r in rows) == [
        (-1, 2, False), (-1, 5, False), (2, 2, True), (5, 5, True), (5, 5, True), (9, 9, True), (9, 9, True),
    ]
    left = neardup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["class_id"]) for r in left.collect()) == [
        (2, "", "mine"), (5, "a b c d e f g", "mine"), (9, "x y", "mine"), (9, "z", "mine"),
    ]
    assert neardup.near_duplicates(documents([])).count() == 0
    assert neardup.deduplicated(documents([])).count() == 0


def test_similar_equals_the_slow_alignment():
    rng = random.Random(3)
    for _ in range(60):
        base = words(rng, rng.randint(1, 80))
        other = edited(rng, base, rng.randint(0, 6)) if rng.random() < 0.8 else base[40:] + base[:40]
        hashes = neardup.WordHashes()
        one, two = (hashes.of([w.encode() for w in x]).astype("<u4").tobytes() for x in (base, other))
        slow = brute.similarity(brute.shingles(" ".join(base)), brute.shingles(" ".join(other)))
        assert neardup.similar(one, two) == (slow >= 0.8)


@pytest.mark.parametrize(("edges", "labels"), [
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(0, i) for i in range(1, 100)], {i: 0 for i in range(100)}),
    ([(5, 4), (4, 5), (9, 7)], {4: 4, 5: 4, 7: 7, 9: 7}),
    ([], {}),
])
def test_components(spark, edges, labels):
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in rows} == labels


def passages(rng):
    common = words(rng, 55)
    texts = [None, "", "short text"]
    for k in range(60):
        own = words(rng, rng.randint(10, 150))
        if k % 2:
            own += common
        texts.append("\t ".join(own + words(rng, rng.randint(0, 40))))
    texts += [texts[5], texts[5] + " tail", "rep eat " * 80, "rep eat " * 30, " ".join(common[:50]), " ".join(common[:49]), "\x1c\x85 é " * 60]
    return texts


@pytest.mark.parametrize("heavy", [300, 5])
def test_substrings_equal_sql(spark, documents, saved, heavy, monkeypatch):
    """Also with a passage so frequent that its windows travel singly."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    docs = documents([*passages(random.Random(2)), (None, " ".join(map(str, range(70)))), (3, " ".join(map(str, range(90)))), (3, " ".join(map(str, range(80))))])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    expected = con.execute(checks.substrings_sql()).fetchall()
    got = registry.op6_substring_dedup(spark, saved(documents=docs)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_substrings_of_nothing(documents):
    assert substrings.deduplicate(documents([])).count() == 0


def test_long_text_has_the_same_windows_as_its_parts(documents):
    rng = random.Random(4)
    long = words(rng, 30_000)
    docs = documents([" ".join(long), " ".join(long[10_000:10_100]), " ".join(long[5:60] + ["x"] * 10)])
    rows = {r["doc_id"]: r for r in substrings.deduplicate(docs).collect()}
    assert [rows[k]["n_removed"] for k in range(3)] == [0, 100, 55]
    assert rows[2]["kept_text"] == " ".join(["x"] * 10)
