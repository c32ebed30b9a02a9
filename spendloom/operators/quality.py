"""Data-quality checks.  Each returns one row: `check_name, value, threshold, breached`.

The current time is always an argument, so a check gives the same answer when rerun.
"""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.fixed_values import (
    BILLING_AGE_LIMIT_HOURS,
    IDENTITY_MISS_LIMIT_PERCENT,
    METRIC_WINDOW,
    MISMATCH_LIMIT_PERCENT,
    RECONCILE_AGE_LIMIT_HOURS,
    RETENTION_DAYS,
)


def mismatch(reconciled: DataFrame, buckets: DataFrame, limit: float = MISMATCH_LIMIT_PERCENT) -> DataFrame:
    """Difference between attributed and billed cost in percent of the bill.

    UNMATCHED rows carry cost nobody is charged for, so they do not count as attributed.
    """
    attributed = reconciled.where(F.col("reconciliation_status") != "unmatched").select(
        F.col("attributed_cost").alias("attributed"), F.lit(0.0).alias("billed")
    )
    billed = buckets.select(F.lit(0.0).alias("attributed"), F.col("bucket_unblended_cost").alias("billed"))
    sums = attributed.unionByName(billed).agg(F.sum("attributed").alias("a"), F.sum("billed").alias("b"))
    value = F.coalesce(F.try_divide(F.abs(F.col("a") - F.col("b")), F.abs("b")) * 100, F.lit(0.0))
    return _check(sums, "reconciliation_mismatch_percent", value, limit, lambda v: v > limit)


def reconcile_age(runs: DataFrame, time: str, as_of: str, limit: float = RECONCILE_AGE_LIMIT_HOURS) -> DataFrame:
    """Hours since the newest reconciliation; no run at all is a breach."""
    return _age(runs, "reconciliation_age_hours", time, as_of, limit)


def billing_age(costs: DataFrame, time: str, as_of: str, limit: float = BILLING_AGE_LIMIT_HOURS) -> DataFrame:
    """Hours since the newest billing data; no data at all is a breach."""
    return _age(costs, "billing_data_age_hours", time, as_of, limit)


def unmapped_billing_names(missing: DataFrame) -> DataFrame:
    """Number of billing names without a model id, from `records.names_missing_from`."""
    counted = missing.agg(F.count("*").cast("double").alias("v"))
    return _check(counted, "unmapped_billing_names", F.col("v"), 0.0, lambda v: v > 0)


def identity_miss_rate(
    sources: DataFrame, column: str, limit: float = IDENTITY_MISS_LIMIT_PERCENT, weight: Column | None = None
) -> DataFrame:
    """Share of identities not served from the cache, in percent; `weight` counts the requests of a row."""
    weight = F.lit(1) if weight is None else weight
    missed = F.sum(F.when(F.col(column) != "cache", 100.0).otherwise(0.0) * weight)
    rate = sources.agg(F.coalesce(F.try_divide(missed, F.sum(weight)), F.lit(0.0)).alias("v"))
    return _check(rate, "identity_miss_percent", F.col("v"), limit, lambda v: v > limit)


def dead_letters(letters: DataFrame) -> DataFrame:
    counted = letters.agg(F.count("*").cast("double").alias("v"))
    return _check(counted, "dead_letters", F.col("v"), 0.0, lambda v: v > 0)


def error_windows(events: DataFrame, time: str, is_error: Column, limit: int = 1) -> DataFrame:
    """Errors per five-minute window, one row per window that has any."""
    windows = (
        events.where(is_error)
        .groupBy(F.window(F.col(time), METRIC_WINDOW).getField("start").alias("window_start"))
        .agg(F.count("*").cast("double").alias("v"))
    )
    checked = _check(windows, "errors_per_window", F.col("v"), float(limit), lambda v: v >= limit, "window_start")
    return checked


def within_retention(rows: DataFrame, day: Column, as_of: date, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows young enough to keep; on a partition column whole partitions are skipped."""
    return rows.where(day >= F.lit(as_of - timedelta(days=days)))


def _age(rows: DataFrame, name: str, time: str, as_of: str, limit: float) -> DataFrame:
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.max(time))
    aged = rows.agg((seconds / 3600.0).alias("v"))
    return _check(aged, name, F.col("v"), limit, lambda v: F.coalesce(v > limit, F.lit(True)))


def _check(rows: DataFrame, name: str, value: Column, threshold: float, breached, *keep: str) -> DataFrame:
    return rows.select(
        *keep,
        F.lit(name).alias("check_name"),
        value.alias("value"),
        F.lit(float(threshold)).alias("threshold"),
        breached(value).alias("breached"),
    )
