"""Growth over weeks and months."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weekly_growth(daily: DataFrame, value: str = "tokens", day: str = "day") -> DataFrame:
    """Totals of consecutive seven-row chunks from the first day on, and their growth.

    Chunks count days that have data, not calendar weeks.  `daily` has one row per day, so
    the single window below is as long as the calendar.
    """
    index = F.row_number().over(Window.orderBy(day)) - 1
    weeks = (
        daily.withColumn("week", F.floor(index / 7))
        .groupBy("week")
        .agg(F.sum(value).alias(value))
    )
    return _with_growth(weeks, value, "week")


def monthly_growth(daily: DataFrame, value: str = "tokens", day: str = "day") -> DataFrame:
    """Totals of calendar months and their growth."""
    months = daily.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.sum(value).alias(value))
    return _with_growth(months, value, "month")


def with_previous(rows: DataFrame, value: str, period: str) -> DataFrame:
    """Add the value of the period before; `rows` has one row per period."""
    return rows.withColumn("previous", F.lag(value).over(Window.orderBy(period)))


def _with_growth(rows: DataFrame, value: str, period: str) -> DataFrame:
    compared = with_previous(rows, value, period)
    return compared.withColumn("growth", _growth(F.col(value), F.col("previous"))).drop("previous")


def _growth(current: Column, previous: Column) -> Column:
    """Relative change; 0 after a zero, NULL for the first period."""
    return F.when(previous == 0, 0.0).when(previous.isNotNull(), (current - previous) / previous)
