"""Outputs: partitioned Parquet tables, dead letters, report files.

Every partitioned write goes through a rebalance on the partition columns: rows of one
partition land together, so there are few files, and the adaptive planner splits a
partition that grows past its target size, so a hot day or hour never sits in one task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.functions.common import partition_columns
from spendloom.schemas import DAY_PARTITIONS, HOUR_PARTITIONS


def with_hour_partitions(df: DataFrame, timestamp_col: str = "timestamp") -> DataFrame:
    """Add `year, month, day, hour` in UTC from an ISO text column."""
    return df.withColumns(partition_columns(F.col(timestamp_col)))


def with_day_partitions(df: DataFrame, date_col: str = "usage_date") -> DataFrame:
    """Add `year, month, day`; an unreadable date leaves them NULL for the caller to set apart."""
    parts = partition_columns(F.col(date_col))
    return df.withColumns({name: parts[name] for name in DAY_PARTITIONS})


def append_partitioned(df: DataFrame, path: str, partitions: tuple[str, ...] = HOUR_PARTITIONS) -> None:
    """Append to a table; with several regions put `region` in front of the partitions."""
    _balanced(df, partitions).write.mode("append").partitionBy(*partitions).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partitions: tuple[str, ...] = DAY_PARTITIONS) -> None:
    """Replace exactly the partitions present in `df`; running twice leaves one copy."""
    (
        _balanced(df, partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def append_dead_letters(letters: DataFrame, path: str) -> None:
    """JSON lines below `processor=/year=/month=/day=`, so failures can be listed and replayed."""
    parts = partition_columns(F.col("failedAt"))
    rows = letters.withColumns({name: parts[name] for name in DAY_PARTITIONS}).withColumn(
        "processor", F.col("processorName")
    )
    keys = ("processor", *DAY_PARTITIONS)
    _balanced(rows, keys).write.mode("append").partitionBy(*keys).json(path)


def write_report_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def _balanced(df: DataFrame, partitions: tuple[str, ...]) -> DataFrame:
    return df.hint("rebalance", *partitions)
