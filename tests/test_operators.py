"""Joins, dedup, identities, correlation, reports and checks."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from spendloom import schemas
from spendloom.operators import correlate, dataset, dedup, filters, identities, metrics, quality, reports, security, trend
from spendloom.operators.joins import hashed_join


def test_first_per_key_cuts_groups_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("line"))
    kept = dedup.first_per_key(rows, ["k"], [F.col("line")])
    assert sorted((r["k"], r["line"]) for r in kept.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_drop_known_matches_missing_keys(spark):
    rows = spark.createDataFrame([("a", None), ("b", "1")], "k string, t string")
    ledger = spark.createDataFrame([("a", None)], "k string, t string")
    assert [r["k"] for r in dedup.drop_known(rows, ledger, ["k", "t"]).collect()] == ["b"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hashed_join_equals_a_plain_join(spark, how):
    """Key 0 holds a third of all rows."""
    rows = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    lookup = spark.range(0, 40).select(F.col("id").cast("bigint").alias("k"), (F.col("id") * 2).alias("v"))
    lookup = lookup.unionByName(lookup.where("k = 0").withColumn("v", F.lit(-1).cast("bigint")))
    key = lambda r: (r["k"], r["id"], r["v"] if r["v"] is not None else -9)
    hashed, plain = hashed_join(rows, lookup, ["k"], how), rows.join(lookup, "k", how)
    assert sorted(map(key, hashed.collect())) == sorted(map(key, plain.collect()))


TIMES = [
    ("in", 60_000), ("edge", 300_000), ("out", 300_001), ("before", -300_000), ("far", 10**9),
]


def test_correlation_window_is_inclusive_and_symmetric(spark):
    base = 1_705_329_000_123
    calls = spark.createDataFrame([(k, base) for k, _ in TIMES], "requestid string, ms bigint")
    audit = spark.createDataFrame([(k, base + d) for k, d in TIMES] + [("in", None)], "requestid string, ms bigint")
    calls = calls.select("requestid", F.timestamp_millis("ms").alias("call_time"))
    audit = audit.select("requestid", F.timestamp_millis("ms").alias("audit_time"))
    pairs = sorted(r["requestid"] for r in correlate.correlation_pairs(calls, audit).collect())
    flags = {r["requestid"]: r["is_correlated"] for r in correlate.with_audit_match(calls, audit).collect()}
    assert pairs == ["before", "edge", "in"]
    assert flags == {"in": True, "edge": True, "before": True, "out": False, "far": False}


@pytest.mark.parametrize("window", [0, 1, 1_000, 300_000])
def test_audit_match_equals_brute_force_on_a_hot_key(spark, window):
    import random

    rng = random.Random(window)
    calls = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 10 * window + 5), i) for i in range(120)]
    audit = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 10 * window + 5)) for i in range(60)]
    left = spark.createDataFrame(calls, "requestid string, ms bigint, i int")
    right = spark.createDataFrame(audit, "requestid string, ms bigint")
    left = left.withColumn("call_time", F.timestamp_millis("ms"))
    right = right.select("requestid", F.timestamp_millis("ms").alias("audit_time"))
    expected = {i: any(k == a and abs(t - s) <= window for a, s in audit) for k, t, i in calls}
    got = {r["i"]: r["is_correlated"] for r in correlate.with_audit_match(left, right, window_ms=window).collect()}
    assert got == expected
    pairs = correlate.correlation_pairs(left, right, window_ms=window).count()
    assert pairs == sum(k == a and abs(t - s) <= window for k, t, _ in calls for a, s in audit)


DIRECTORY = [
    ("id-1", "alice", "Alice A", ("Al", "A"), [("first@x", False), ("main@x", True)]),
    ("id-2", "bob", None, ("Bob", "B"), [("only@x", None)]),
    ("id-3", "carl", None, (None, None), None),
]
CACHE = "principalarn string, displayname string, email string, userid string, resolvedat string"


def role(session):
    return f"arn:aws:sts::1:assumed-role/R/{session}"


def test_resolution_order(spark):
    directory = spark.createDataFrame(DIRECTORY, schemas.struct_of(schemas.DIRECTORY_USERS))
    cache = spark.createDataFrame([(role("x"), "Old", "", "1", "2024-01"), (role("x"), "New", "", "1", "2024-02")], CACHE)
    arns = [role("x"), role("alice"), role("bob"), role("id-3"), role("carl"), "arn:aws:iam::1:user/u"]
    people = spark.createDataFrame([(a,) for a in arns], "principalarn string")

    def found(mode):
        rows = identities.resolve_principals(people, cache, directory, mode).collect()
        return {r["principalarn"].split("/")[-1]: r["identity"] for r in rows}

    auto = found("auto")
    assert {k: v["source"] for k, v in auto.items()} == {
        "x": "cache", "alice": "sso", "bob": "sso", "id-3": "sso", "carl": "sso", "u": "iam",
    }
    assert auto["x"]["display_name"] == "New"
    assert (auto["alice"]["display_name"], auto["alice"]["email"]) == ("Alice A", "main@x")
    assert (auto["bob"]["display_name"], auto["bob"]["email"]) == ("Bob B", "only@x")
    assert (auto["id-3"]["display_name"], auto["carl"]["display_name"]) == ("carl", "")
    sso = found("sso")["u"]
    assert (sso["resolved"], sso["reason"], sso["source"]) == (False, "sso_no_match", "placeholder")
    assert found("iam")["alice"]["iam_role_name"] == "R"


def test_session_takes_first_resolved_identity(spark):
    directory = spark.createDataFrame(DIRECTORY, schemas.struct_of(schemas.DIRECTORY_USERS))
    requests = spark.createDataFrame(
        [
            ("1", "t1", role("nobody"), "K", None), ("2", "t2", role("alice"), "K", None), ("3", "t3", role("bob"), "K", None),
            ("4", "t4", role("nobody"), "K", "guard"), ("5", "t5", role("bob"), None, None),
        ],
        "requestid string, timestamp string, principalarn string, accesskeyid string, guardrailid string",
    )
    rows = identities.resolve_requests(requests, None, directory, "sso")
    got = {r["requestid"]: (r["identity"]["user_id"], r["identity"]["source"]) for r in rows.collect()}
    assert got == {
        "1": (None, "placeholder"), "2": ("id-1", "sso"), "3": ("id-1", "sso"), "4": ("id-1", "cache"), "5": ("id-2", "sso"),
    }


CALLS = "requestid string, timestamp string, usage_date string, accountid string, modelid string, resolvedmodelid string, \
resolveduserid string, resolvedusername string, inputtokens bigint, outputtokens bigint, latencyms bigint, imagecount int, \
videodurationseconds double, sourceregion string, executionregion string"
RECONCILED = "usage_date string, account_id string, model_id string, token_type string, resolved_user_id string, \
attributed_cost double, reconciliation_status string"


def sample(spark):
    base = ("2024-01-15T10:00:00Z", "2024-01-15", "1")
    rest = (10, 5, 100, None, None, "r", "r")
    calls = [(f"r{i}", *base, "us.m-1.x", "m-1.x", "u", "", *rest) for i in range(4)]
    calls += [("s", *base, "other", "other", "v", "Vera", *rest)]
    costs = [
        ("2024-01-15", "1", "m-1.x", "input-tokens", "u", 6.0, "reconciled"),
        ("2024-01-15", "1", "m-1.x", "output-tokens", "u", 2.0, "pending"),
        ("2024-01-15", "1", "m-1.x", "input-tokens", "UNMATCHED", 50.0, "unmatched"),
    ]
    return spark.createDataFrame(calls, CALLS), spark.createDataFrame(costs, RECONCILED)


def test_call_dataset_shares_cost_over_calls(spark):
    rows = dataset.call_dataset(*sample(spark)).collect()
    assert len(rows) == 5
    got = {(r["resolvedusername"], r["totalcost"], r["inputcost"], r["outputcost"], r["reconciliation_status"]) for r in rows}
    assert got == {("u", 2.0, 1.5, 0.5, "reconciled"), ("Vera", 0.0, 0.0, 0.0, "pending")}
    assert {r["friendlymodelname"] for r in rows} == {"us m 1 x", "other"}


def test_facts_add_up_to_the_call_dataset(spark):
    calls, reconciled = sample(spark)
    facts = dataset.usage_facts(calls, reconciled)
    (kpis,) = reports.executive_kpis(facts).collect()
    assert (kpis["calls"], kpis["total_cost"], kpis["users"]) == (5, 8.0, 2)
    assert [(r["resolvedusername"], r["total_cost"]) for r in reports.top_users(facts, 1).collect()] == [("u", 8.0)]
    totals = [r for r in reports.user_model_breakdown(facts).collect() if r["resolvedusername"] == reports.TOTAL]
    assert sorted((r["friendlymodelname"], r["calls"]) for r in totals) == [("other", 1), ("us m 1 x", 4)]


def test_error_rate_without_calls_is_zero(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("b", 10, 1)], "m string, invocationcount bigint, errorcount bigint")
    got = {r["m"]: r["error_rate"] for r in reports.error_rate(rows, "m").collect()}
    assert got == {"a": 0.0, "b": 10.0}


def test_growth_uses_seven_row_chunks(spark):
    days = [(date(2024, 1, d), 0 if d <= 7 else d) for d in range(1, 31) if d != 10]
    daily = spark.createDataFrame(days, "day date, tokens bigint")
    weeks = trend.weekly_growth(daily).orderBy("week").collect()
    chunks = [sum(v for _, v in days[i : i + 7]) for i in range(0, len(days), 7)]
    assert [r["tokens"] for r in weeks] == chunks
    assert weeks[0]["growth"] is None and weeks[1]["growth"] == 0.0
    assert weeks[2]["growth"] == pytest.approx((chunks[2] - chunks[1]) / chunks[1])


def test_metric_windows_fold_by_latency(spark):
    events = spark.range(1000).select(
        F.timestamp_seconds(F.col("id") % 600).alias("at"), F.lit("m").alias("model"), (F.col("id") % 100).alias("ms")
    )
    args = ("at", "model", F.col("ms"), F.col("ms") == 1, F.col("ms") == 2)
    exact = metrics.call_metrics(events, *args).orderBy("timestamp").collect()
    assert [(r["invocationcount"], r["throttledcount"]) for r in exact] == [(600, 6), (400, 4)]
    assert exact[0]["invocationlatencyp99"] == pytest.approx(98.0, abs=1)
    sketch = metrics.call_metrics(events, *args, exact=False).orderBy("timestamp").collect()
    assert [r["invocationlatencyavg"] for r in sketch] == [r["invocationlatencyavg"] for r in exact]


def test_activity_filters_differ_on_latency_only_rows(spark):
    names = "invocationcount bigint, invocationlatencyavg double, throttledcount bigint, errorcount bigint"
    rows = spark.createDataFrame([(0, 5.0, 0, 0), (1, 0.0, 0, 0), (0, 0.0, 0, 0)], names)
    assert (filters.active_in_collector(rows).count(), filters.active_in_dataset(rows).count()) == (2, 1)


def test_billing_months_cross_the_year():
    assert filters.billing_months(date(2024, 1, 31)) == ["2024-01", "2023-12"]


def test_restrict_to_keeps_wanted_values(spark):
    rows = spark.createDataFrame([("2024", "01"), ("2024", "02")], "year string, month string")
    wanted = spark.createDataFrame([("2024", "02"), (None, "03")], "year string, month string")
    assert [r["month"] for r in filters.restrict_to(rows, wanted, ["year", "month"]).collect()] == ["02"]


def test_viewer_without_rule_sees_nothing(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "accountid string")
    rules = spark.createDataFrame([("p", "2"), ("p", "2")], "principalarn string, accountid string")
    assert [r["accountid"] for r in security.visible_to(rows, rules, "p").collect()] == ["2"]
    assert security.visible_to(rows, rules, "q").count() == 0


def test_checks(spark):
    none = spark.createDataFrame([], "at timestamp")
    assert quality.reconcile_age(none, "at", "2024-01-01 00:00:00").first()["breached"] is True
    runs = spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS at")
    row = quality.billing_age(runs, "at", "2024-01-03 00:00:00").first()
    assert (row["value"], row["breached"]) == (48.0, False)
    sources = spark.createDataFrame([("cache",), ("iam",)], "source string")
    assert quality.identity_miss_rate(sources, "source").first()["breached"] is False
    days = spark.sql("SELECT explode(sequence(date '2024-01-01', date '2024-06-30')) AS d")
    assert quality.within_retention(days, F.col("d"), date(2024, 6, 30)).count() == 91
