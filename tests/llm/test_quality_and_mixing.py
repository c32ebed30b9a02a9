"""Quality rules and source mixing against SQL, and their corner cases."""

import collections

import pytest
from pyspark.sql import functions as F

from spendloom.llm import checks, mixing, quality_rules, registry

GOOD = "The first line of a text has words that end. Another sentence follows here, and it is fine. " * 4
ODD = [
    None, "", "   \n\t ", "one", "a b c d e a b c d e a b c d e", "#### $$$ %%% ***", "x " * 3000, GOOD, GOOD, GOOD.upper() + "!!",
    "line\nline\nline\nline\n", "é à   б", "w" * 50_000, "\r\n\x0b\x0c a\x1cb c",
]


def compare(df, sql, **tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
    assert rows == sorted(map(repr, cursor.fetchall()))


def test_rules_equal_sql(spark, documents, saved):
    docs = documents([*ODD, *[f"{GOOD} number {i}" for i in range(30)], (None, GOOD), (3, None), (3, GOOD)])
    folder = saved(documents=docs)
    compare(registry.op1_quality_rules(spark, folder), checks.quality_rules_sql(), documents=docs)


def test_rules_carry_rows_and_clashing_names(spark, documents):
    docs = documents([GOOD, "bad"]).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1)).withColumn("row", F.lit(0))
    judged = quality_rules.quality_rules(docs)
    assert judged.select("row.*").columns == docs.columns
    assert {r["row"]["n_words"] for r in judged.collect()} == {-1}


def test_rules_over_no_rows(spark, documents):
    assert quality_rules.quality_rules(documents([])).count() == 0


def test_rules_find_labels(spark):
    """On the given tables the posterior agrees with the labels far better than keeping everything."""
    folder = "/root/testdata/sf0.01"
    kept = registry.op1_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    counts = {(r["quality"], r["kept"]): r["count"] for r in kept.groupBy("quality", "kept").count().collect()}
    assert counts[1, True] > 0.95 * (counts[1, True] + counts.get((1, False), 0))
    assert counts[0, False] > 0.35 * (counts[0, False] + counts[0, True])


def test_rules_use_built_in_functions_only(documents):
    plan = quality_rules.quality_rules(documents([GOOD]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_mix_equals_sql(spark, documents):
    rows = [(i, f"text {i}", "big" if i % 10 else "small") for i in range(400)]
    docs = documents([*rows, (None, None, None), (5, "text 5", "big"), (7, "", "rare")])
    mixed = mixing.poisson_mix(docs).select("row.*", "copy", "mix_key")
    compare(mixed, checks.poisson_mix_sql(), documents=docs)


def test_mix_reaches_target_weights(spark, documents):
    docs = documents([(i, f"t{i}", "a" if i < 3000 else "b") for i in range(4000)])
    weights = {"a": 0.5, "b": 0.5}
    mixed = mixing.poisson_mix(docs, weights).collect()
    counts = collections.Counter(r["row"]["source"] for r in mixed)
    assert 1850 < counts["a"] < 2150 and 1850 < counts["b"] < 2150
    again = mixing.poisson_mix(docs, weights).collect()
    assert sorted(map(repr, mixed)) == sorted(map(repr, again))
    assert mixing.poisson_mix(docs, {"a": 1.0, "b": 0.0}).filter("row.source = 'b'").count() == 0


@pytest.mark.parametrize("rate", [0.01, 1.0, 7.5, 900.0])
def test_counts_are_poisson(spark, rate):
    """Mean and variance of the inverted distribution, also where exp(-rate) is 0 in floating point."""
    steps = spark.range(1).select(mixing.cumulated(F.lit(rate)).alias("s")).first()["s"]
    chance = [b - a for a, b in zip([0.0, *steps], steps, strict=False)]
    mean = sum(k * p for k, p in enumerate(chance))
    assert mean == pytest.approx(rate, rel=1e-6)
    assert sum((k - mean) ** 2 * p for k, p in enumerate(chance)) == pytest.approx(rate, rel=1e-6)
    assert steps[-1] == pytest.approx(1.0, abs=1e-9)


def test_mix_of_nothing(documents):
    assert mixing.poisson_mix(documents([])).count() == 0
