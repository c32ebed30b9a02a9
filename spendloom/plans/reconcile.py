"""The reconcile job: newest billing data of the open months, split over users, written by period."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom import schemas
from spendloom.operators.attribution import attribute, cost_buckets, newest_buckets, usage_by_user
from spendloom.operators.filters import billing_months, restrict_to
from spendloom.operators.snapshot import latest_snapshot
from spendloom.session import prepare
from spendloom.sources import readers, versions, writers


def reconciled_costs(costs: DataFrame, calls: DataFrame, as_of: date | None = None) -> DataFrame:
    """`cur_costs` and `invocation_logs` to `reconciled_costs`, as one lazy plan.

    With `as_of` only the current and the previous month are taken.
    """
    periods = billing_months(as_of) if as_of is not None else None
    buckets = newest_buckets(costs, periods)
    return attribute(buckets, usage_by_user(calls, buckets))


def run(spark: SparkSession, costs_path: str, calls_path: str, target: str, as_of: date) -> None:
    """Read both tables, reconcile, and replace the open billing periods of the target.

    A period is replaced as a whole, so days or buckets that a corrected export no longer has
    vanish from the target too; all periods change at once (see `sources.versions`, which also reads the target).  Only the period's partition of the costs is read, and of the calls
    only the day partitions it has costs for.
    """
    prepare(spark)
    costs = readers.read_table(spark, costs_path, schemas.COST_LINES, schemas.PERIOD_PARTITIONS)
    calls = readers.read_table(spark, calls_path, schemas.CALLS, schemas.HOUR_PARTITIONS)
    periods = billing_months(as_of)
    newest = latest_snapshot(costs, periods=periods)
    days = writers.with_day_partitions(newest.select("usage_date").distinct())
    used = restrict_to(calls, days, list(schemas.DAY_PARTITIONS))
    parts = []
    for period in periods:
        # a day billed in two periods is split within each of them
        of_period = newest.where(F.col("billing_period") == period)
        buckets = cost_buckets(of_period)
        rows = attribute(buckets, usage_by_user(used, buckets))
        parts.append(rows.withColumn("billing_period", F.lit(period)))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    scope = spark.createDataFrame([(p,) for p in periods], "billing_period string")
    versions.replace(first, target, schemas.PERIOD_PARTITIONS, scope)


def read(spark: SparkSession, target: str) -> DataFrame | None:
    """The reconciled costs of all periods as they stand now; None before the first run."""
    return versions.read(spark, target, schemas.RECONCILED_COSTS, schemas.PERIOD_PARTITIONS)
