"""Attribution: literal cases, conservation, skew."""

import random
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from spendloom.operators.attribution import BUCKET, attribute, cost_buckets, newest_buckets, usage_by_user
from spendloom.operators.snapshot import delivery_of, latest_snapshot
from spendloom.plans.reconcile import reconciled_costs

COSTS = "usage_date string, usage_account_id string, region string, model_billing_name string, token_type string, \
cross_region_type string, pricing_unit string, unblended_cost double"
BUCKETS = COSTS.replace("usage_account_id", "account_id").replace("unblended_cost", "bucket_unblended_cost")
USAGE = "usage_date string, account_id string, region string, model_id string, usage_cross string, \
resolved_user_id string, resolved_user_name string, measure string, user_tokens double"


def bucket(cost, model="m", token="input-tokens", cross="none", unit="1K tokens"):
    return ("2025-01-15", "1", "us-east-1", model, token, cross, unit, float(cost))


def user(name, tokens, model="m", cross="none", measure="inputtokens"):
    return ("2025-01-15", "1", "us-east-1", model, cross, name, name, measure, float(tokens))


def run(spark, buckets, users):
    rows = attribute(spark.createDataFrame(buckets, BUCKETS), spark.createDataFrame(users, USAGE)).collect()
    return sorted(rows, key=lambda r: (r["model_id"], r["token_type"], r["cross_region_type"], r["resolved_user_id"]))


@pytest.mark.parametrize(
    ("cost", "tokens", "expected"),
    [
        (15.0, [500], [15.0]),
        (100.0, [700, 300], [70.0, 30.0]),
        (10.0, [100, 100, 100], [3.3333333333, 3.3333333333, 3.3333333334]),
        (0.001, [500, 500], [0.0005, 0.0005]),
        (0.0, [500, 500], [0.0, 0.0]),
        (12.0, [0, 0, 0], [4.0, 4.0, 4.0]),
        (-5.0, [1, 3], [-1.25, -3.75]),
    ],
)
def test_split(spark, cost, tokens, expected):
    users = [user(f"u{i}", n) for i, n in enumerate(tokens)]
    rows = run(spark, [bucket(cost)], users)
    assert [r["attributed_cost"] for r in rows] == expected
    assert {r["reconciliation_status"] for r in rows} == {"reconciled"}
    assert sum(r["proportion"] for r in rows) == pytest.approx(1.0)


def test_no_users_is_one_unmatched_row(spark):
    (row,) = run(spark, [bucket(25.0)], [user("u", 5, model="other")])
    assert (row["resolved_user_id"], row["attributed_cost"], row["proportion"]) == ("UNMATCHED", 25.0, 0.0)
    assert row["reconciliation_status"] == "unmatched"


def test_base_rate_falls_back_to_global_then_geo(spark):
    buckets = [bucket(1, "a"), bucket(2, "b"), bucket(4, "c"), bucket(8, "d", cross="cross-region-geo")]
    users = [
        user("none", 1, "a"), user("glob", 1, "a", "cross-region-global"),
        user("glob", 1, "b", "cross-region-global"), user("geo", 1, "b", "cross-region-geo"),
        user("geo", 1, "c", "cross-region-geo"), user("none", 1, "d"),
    ]
    rows = run(spark, buckets, users)
    assert [r["resolved_user_id"] for r in rows] == ["none", "glob", "geo", "UNMATCHED"]


def test_two_pricing_units_split_by_their_own_measure(spark):
    buckets = [bucket(10, unit="Images"), bucket(20)]
    users = [user("a", 1, measure="imagecount"), user("b", 3, measure="imagecount"), user("c", 9)]
    rows = run(spark, buckets, users)
    assert [(r["resolved_user_id"], r["attributed_cost"]) for r in rows] == [("a", 2.5), ("b", 7.5), ("c", 20.0)]


def test_hot_bucket_is_conserved_and_equals_a_plain_loop(spark):
    """One bucket holds a third of all usage rows; the result is what a loop over sorted users gives."""
    rng = random.Random(7)
    costs = {"hot": 987.654321, **{f"m{i}": round(rng.uniform(0.001, 1000), 6) for i in range(60)}}
    users = [user(f"u{i:04d}", rng.randint(1, 10**7), "hot") for i in range(400)]
    for m in list(costs)[1:]:
        users += [user(f"u{i:04d}", rng.randint(1, 10**6), m) for i in range(rng.randint(0, 25))]
    rows = run(spark, [bucket(c, m) for m, c in costs.items()], users)

    by_model = defaultdict(list)
    for u in users:
        by_model[u[3]].append((u[5], u[8]))
    got = defaultdict(dict)
    for r in rows:
        got[r["model_id"]][r["resolved_user_id"]] = r["attributed_cost"]
    for model, cost in costs.items():
        people = sorted(by_model[model])
        if not people:
            assert got[model] == {"UNMATCHED": cost}
            continue
        whole, given = sum(n for _, n in people), 0.0
        for name, n in people[:-1]:
            share = round(n / whole * cost, 10)
            given += share
            assert got[model][name] == pytest.approx(share, abs=1.1e-10)
        assert got[model][people[-1][0]] == pytest.approx(cost - given, abs=1e-8)
        assert len(got[model]) == len(people)
        assert sum(got[model].values()) == pytest.approx(cost, abs=1e-9)


def test_buckets_that_sum_to_zero_drop_out(spark):
    costs = spark.createDataFrame([bucket(5, "a"), bucket(-5, "a"), bucket(-3, "b")], COSTS)
    assert [(r["model_billing_name"], r["bucket_unblended_cost"]) for r in cost_buckets(costs).collect()] == [("b", -3.0)]
    assert set(BUCKET) <= set(cost_buckets(costs).columns)


CALLS = "usage_date string, accountid string, executionregion string, sourceregion string, modelid string, \
resolvedmodelid string, resolveduserid string, resolvedusername string, inputtokens bigint, outputtokens bigint, \
cachereadinputtokens bigint, cachewriteinputtokens bigint, imagecount int, videodurationseconds double"


def test_usage_keeps_positive_measures_only(spark):
    base = ("2025-01-15", "1", "us-east-1", "us-east-1", "us.m", "m", "u", "u")
    calls = spark.createDataFrame([(*base, 5, 0, None, 2, None, 1.5), (*base, 7, -1, 0, 0, 0, None)], CALLS)
    rows = {r["measure"]: r["user_tokens"] for r in usage_by_user(calls).collect()}
    assert rows == {"inputtokens": 12.0, "cachewriteinputtokens": 2.0, "videodurationseconds": 1.5}
    assert {r["usage_cross"] for r in usage_by_user(calls).collect()} == {"cross-region-geo"}


SNAPSHOTS = f"billing_period string, cur_file_key string, {COSTS}"


def test_latest_snapshot_of_each_period(spark):
    rows = spark.createDataFrame(
        [
            ("2025-01", "x/run-1/a.csv", *bucket(1)), ("2025-01", "x/run-2/a.csv", *bucket(2)),
            ("2025-01", "x/run-2/b.csv", *bucket(4)), ("2025-02", "x/run-1/a.csv", *bucket(8)),
        ],
        SNAPSHOTS,
    )
    total = F.sum("unblended_cost")
    assert latest_snapshot(rows).agg(total).first()[0] == 12.0
    by_run = latest_snapshot(rows, snapshot=delivery_of(F.col("cur_file_key")))
    assert by_run.agg(total).first()[0] == 14.0
    assert latest_snapshot(rows, periods=["2025-02"]).agg(total).first()[0] == 8.0


def test_reconcile_takes_open_months_only(spark):
    costs = spark.createDataFrame(
        [("2025-01", "f", *bucket(100)), ("2024-10", "f", *bucket(7, "old"))], SNAPSHOTS
    )
    base = ("2025-01-15", "1", "us-east-1", "us-east-1", "m", "m")
    calls = spark.createDataFrame(
        [(*base, "a", "a", 700, 0, 0, 0, 0, 0.0), (*base, "b", "b", 300, 0, 0, 0, 0, 0.0)], CALLS
    )
    rows = reconciled_costs(costs, calls, as_of=date(2025, 2, 10)).collect()
    assert sorted((r["resolved_user_id"], r["attributed_cost"]) for r in rows) == [("a", 70.0), ("b", 30.0)]


def test_usage_that_no_bucket_asks_for_is_left_out(spark):
    day = lambda d, user, model="m": (d, "1", "us-east-1", "us-east-1", model, model, user, user)
    calls = spark.createDataFrame(
        [
            (*day("2025-01-15", "a"), 700, 5, 0, 0, 0, 0.0), (*day("2025-01-15", "b"), 300, 5, 0, 0, 0, 0.0),
            (*day("2025-01-16", "a"), 9, 5, 0, 0, 0, 0.0), (*day("2025-01-15", "c", "n"), 9, 5, 0, 0, 0, 0.0),
        ],
        CALLS,
    )
    buckets = spark.createDataFrame([bucket(10)], BUCKETS)
    usage = usage_by_user(calls, buckets)
    assert sorted((r["usage_date"], r["resolved_user_id"], r["measure"]) for r in usage.collect()) == [
        ("2025-01-15", "a", "inputtokens"), ("2025-01-15", "b", "inputtokens")
    ]
    few, all_ = (sorted(map(str, attribute(buckets, u).collect())) for u in (usage, usage_by_user(calls)))
    assert few == all_


def test_matched_usage_is_shuffled_once(spark, tmp_path):
    """The users' shares and the buckets' rests come from one join; its usage side is written once."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in plain}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        calls = spark.createDataFrame([("2025-01-15", "1", "r", "r", "m", "m", "a", "a", 1, 1, 1, 1, 1, 1.0)], CALLS)
        buckets = spark.createDataFrame([("2025-01-15", "1", "r", "m", "input-tokens", "none", "1K tokens", 1.0)], BUCKETS)
        for name, rows in (("calls", calls), ("buckets", buckets)):
            rows.write.parquet(f"{tmp_path}/{name}")
        calls, buckets = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("calls", "buckets"))
        plan = attribute(buckets, usage_by_user(calls))._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    shared = [line.split("]")[0] for line in plan.splitlines() if "ReusedExchange [" in line]
    assert any("user_tokens" in columns and "_key" in columns for columns in shared)


def test_newest_buckets_equal_buckets_of_the_newest_lines(spark):
    rows = spark.createDataFrame(
        [
            ("2025-01", "x/run-1", *bucket(1)), ("2025-01", "x/run-2", *bucket(2)), ("2025-01", "x/run-2", *bucket(4)),
            ("2025-02", "x/run-1", *bucket(8)), ("2025-02", "x/run-1", *bucket(3, "b")), ("2025-02", "x/run-1", *bucket(-3, "b")),
        ],
        SNAPSHOTS,
    )
    for periods in (None, ["2025-02"]):
        expected = cost_buckets(latest_snapshot(rows, periods=periods)).collect()
        assert sorted(newest_buckets(rows, periods).collect()) == sorted(expected)
