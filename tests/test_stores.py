"""Stored tables of the registered queries: what they hold, and what they leave on the disks."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spendloom.operators import dataset
from spendloom.operators.attribution import MEASURES
from spendloom.operators.joins import may_match
from spendloom.registry import stores


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)

    def rows():
        return spark.range(50_000).groupBy((F.col("id") % 20_000).alias("k")).agg(F.sum("id").alias("n"))

    stored = stores.stored(spark, "nowhere", f"test-{time.time()}", rows)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert stored.count() == 20_000


def test_stored_calls_are_what_is_read_of_them(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("no test tables")
    calls = stores.calls(spark, folder)
    assert {*MEASURES, *dataset.CALL_COLUMNS, "usage_date"} <= set(calls.columns)
    assert not {"rawrequest", "rawresponse", "timestamp"} & set(calls.columns)


def test_may_match_never_misses_and_shuffles_no_row(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).cast("string").alias("a"), F.col("id").alias("b"))
    other = rows.where("b % 50 = 0").select(F.col("a").alias("x"), F.col("b").alias("y"))
    found = may_match(rows, ["a", "b"], other, ["x", "y"])
    assert found.columns == ["a", "b", "_may_match"]
    assert found.where("b % 50 = 0 AND NOT _may_match").isEmpty()
    assert found.where("_may_match").count() < 500
    assert may_match(rows, ["a", "b"], other.limit(0), ["x", "y"]).where("_may_match").isEmpty()
    empty = spark.createDataFrame([(None, None), ("1", None)], "a string, b bigint")
    assert may_match(empty, ["a", "b"], empty).where("_may_match").count() == 2


def test_single_facts_have_the_sums_of_folded_ones(spark):
    call = "requestid string, usage_date string, accountid string, modelid string, resolvedmodelid string, resolveduserid string, \
resolvedusername string, inputtokens bigint, outputtokens bigint, latencyms bigint"
    calls = spark.createDataFrame(
        [
            ("1", "2024-01-01", "a", "us.m", "m", "u", "U", 1, 2, 10), ("2", "2024-01-01", "a", "m", "m", "u", "U", 3, 4, None),
            ("3", "2024-01-01", "a", "m", "m", "v", None, 5, 6, 20), (None, "2024-01-01", "a", "m", "m", "v", None, 7, 8, 30),
            ("5", "2024-01-02", None, "m", None, "v", "", 9, 9, 9),
        ],
        call,
    )
    costs = spark.createDataFrame(
        [("2024-01-01", "a", "m", "input-tokens", "u", 6.0, "reconciled"), ("2024-01-03", "a", "m", "input-tokens", "u", 1.0, "reconciled")],
        "usage_date string, account_id string, model_id string, token_type string, resolved_user_id string, attributed_cost double, reconciliation_status string",
    )
    keys = ["day", "accountid", "modelid", "resolveduserid", "resolvedusername", "reconciliation_status", "modelname", "friendlymodelname"]

    def sums(facts):
        numbers = [c for c in facts.columns if c not in keys]
        return sorted(map(str, facts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers]).collect()))

    folded = dataset.usage_facts(calls, costs)
    single = dataset.usage_facts(calls, costs, folded=False)
    assert folded.dtypes == single.dtypes
    assert folded.count() == 4 and single.count() == 5
    assert sums(folded) == sums(single)
    assert folded.agg(F.sum("totalcost")).first()[0] == 6.0
