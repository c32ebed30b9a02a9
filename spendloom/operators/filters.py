"""Row filters shared by jobs and reports.  All of them are plain predicates, so they reach the scan."""

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.fixed_values import MODEL_CALL_EVENTS, PRODUCT_CODE
from spendloom.functions.common import iso_to_timestamp


def of_product(rows: DataFrame, column: str = "product_code", code: str = PRODUCT_CODE) -> DataFrame:
    return rows.where(F.col(column) == code)


def model_call_events(events: DataFrame, column: str = "eventName") -> DataFrame:
    """Audit events of the four model-call actions; an absent name is not one of them."""
    return events.where(F.col(column).isin(*MODEL_CALL_EVENTS))


def billing_months(as_of: date) -> list[str]:
    """The month of `as_of` and the one before, as `yyyy-MM`."""
    previous = (as_of.year, as_of.month - 1) if as_of.month > 1 else (as_of.year - 1, 12)
    return [f"{as_of.year:04d}-{as_of.month:02d}", f"{previous[0]:04d}-{previous[1]:02d}"]


def in_billing_months(costs: DataFrame, as_of: date) -> DataFrame:
    return costs.where(F.col("billing_period").isin(*billing_months(as_of)))


def between_days(df: DataFrame, day: Column, start: date, end: date) -> DataFrame:
    """Inclusive day range; rows without a day drop out."""
    return df.where(day.between(F.lit(start), F.lit(end)))


def between_minutes(df: DataFrame, timestamp: Column, start: str, end: str) -> DataFrame:
    """Inclusive range at minute grain: the minute of `end` counts as a whole."""
    last = F.date_trunc("minute", F.lit(end).cast("timestamp")) + F.expr("interval 1 minute")
    first = F.date_trunc("minute", F.lit(start).cast("timestamp"))
    return df.where((timestamp >= first) & (timestamp < last))


def of_models(df: DataFrame, models: Iterable[str] | None, column: str = "modelid") -> DataFrame:
    """Rows of the chosen models; None means all models that have an id."""
    if models is None:
        return df.where(F.col(column).isNotNull())
    return df.where(F.col(column).isin(*models))


def restrict_to(df: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of `df` whose `columns` occur in `wanted`.

    On partition columns the planner prunes: the values found at run time select the folders read.
    """
    values = wanted.select(*columns).where(_all([F.col(c).isNotNull() for c in columns])).distinct()
    return df.join(values, columns, "left_semi")


def active_in_collector(metrics: DataFrame) -> DataFrame:
    """Metric rows with any activity, latency included."""
    names = ("invocationcount", "invocationlatencyavg", "throttledcount", "errorcount")
    return metrics.where(_any([F.col(n) != 0 for n in names]))


def active_in_dataset(metrics: DataFrame) -> DataFrame:
    """Metric rows the reports read: calls, throttles or errors.  Latency alone is not enough."""
    return metrics.where(_any([F.col(n) > 0 for n in ("invocationcount", "throttledcount", "errorcount")]))


def with_event_time(df: DataFrame, text_column: str = "timestamp", name: str = "event_time") -> DataFrame:
    return df.withColumn(name, iso_to_timestamp(F.col(text_column)))


def _all(conditions: list[Column]) -> Column:
    first, *rest = conditions
    for condition in rest:
        first = first & condition
    return first


def _any(conditions: list[Column]) -> Column:
    first, *rest = conditions
    for condition in rest:
        first = first | condition
    return first
