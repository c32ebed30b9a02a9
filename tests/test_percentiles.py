"""Exact percentiles by selection against DuckDB and plain sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spendloom.operators import metrics
from spendloom.operators.percentiles import exact_percentile

EVENTS = "/root/testdata/sf0.001/events.parquet"


def plain(values, share):
    ordered = sorted(values, key=lambda x: (math.isnan(x), x))
    place = (len(ordered) - 1) * share
    low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
    return low if math.floor(place) == math.ceil(place) else (math.ceil(place) - place) * low + (place - math.floor(place)) * high


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize(("share", "few"), [(0.37, 1), (0.99, 5), (1.0, 4096)])
def test_percentile_equals_sorting(spark, share, few):
    rng = random.Random(few)
    groups = {
        "even": [rng.uniform(-50, 50) for _ in range(700)],
        "steep": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(300)],
        "copies": [5.0] * 400 + [7.0] * 3,
        "odd": [math.inf, -math.inf, math.nan, math.nan, 1.0, -1.0, 0.0] * 3 + [float(i) for i in range(30)],
        "edges": [1.7976931348623157e308, -1.7976931348623157e308, 5e-324, 0.0, -0.0, 1.0],
        "one": [3.0],
        None: [rng.gauss(0, 1) for _ in range(200)],
    }
    rows = spark.createDataFrame([(k, x) for k, values in groups.items() for x in values] + [("none", None)], "k string, x double")
    folded = rows.groupBy("k", "x").agg(F.count("*").alias("n"))
    got = {r["k"]: r["p"] for r in exact_percentile(folded, ["k"], "x", share, name="p", few=few).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert same(got[k], plain(values, share)), (k, got[k], plain(values, share))


def test_percentiles_of_events_equal_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    expected = dict(duckdb.sql(f"SELECT event_type, quantile_cont(value, 0.99) FROM '{EVENTS}' GROUP BY 1").fetchall())
    folded = spark.read.parquet(EVENTS).groupBy("event_type", "value").agg(F.count("*").alias("n"))
    for few in (40, 4096):
        got = {r[0]: r[1] for r in exact_percentile(folded, ["event_type"], "value", 0.99, few=few).collect()}
        assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], rel_tol=1e-12) for k in got)


def test_a_heavy_group_is_counted_in_parts(spark):
    """Nothing that is collected per group is longer than the number of parts or FEW."""
    rows = spark.range(60_000).select(F.lit("hot").alias("k"), (F.xxhash64("id") / 1e12).alias("x"), F.lit(1).alias("n"))
    row = exact_percentile(rows, ["k"], "x", 0.99, few=100).first()
    assert math.isclose(row["percentile"], rows.agg(F.percentile("x", 0.99)).first()[0], rel_tol=1e-12)


def test_window_metrics_use_it(spark, monkeypatch):
    seen = []
    plain_percentile = metrics.exact_percentile
    monkeypatch.setattr(metrics, "exact_percentile", lambda *a, **b: seen.append(a[1]) or plain_percentile(*a, **b, few=2))
    events = spark.createDataFrame([("2024-01-01 00:00:01", None, float(i)) for i in range(50)] + [("2024-01-01 00:06:00", "m", None)], "t string, m string, v double")
    rows = metrics.call_metrics(events.withColumn("t", F.col("t").cast("timestamp")), "t", "m", F.col("v"), F.lit(False), F.lit(False)).collect()
    assert sorted((r["modelid"] or "", r["invocationcount"], r["invocationlatencyp99"]) for r in rows) == [("", 50, 48.51), ("m", 1, 0.0)]
    assert seen == [["window_start", "region", "modelid"]]
