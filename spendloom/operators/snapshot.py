"""Cumulative billing exports: only the newest delivery of each period counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_snapshot(
    costs: DataFrame,
    period: str = "billing_period",
    snapshot: Column | None = None,
    periods: list[str] | None = None,
    folded: DataFrame | None = None,
) -> DataFrame:
    """Rows of the newest snapshot of each billing period.

    `snapshot` names the delivery a row belongs to, by default its file key; pass
    `delivery_of(...)` when one delivery consists of several part files.

    The list of newest snapshots has one row per period.  With `periods` given it has at most
    that many rows and is broadcast outright, so the cost lines are not shuffled; otherwise the
    planner chooses, and a period with a third of the lines can be split.

    `folded` are aggregates of the lines that keep period and file key; given these, they are returned instead of
    the lines, which then are not shuffled.
    """
    snapshot = F.col("cur_file_key") if snapshot is None else snapshot
    rows = costs.where(F.col(period).isin(*periods)) if periods is not None else costs
    # Counting per delivery hashes; a text maximum over all lines would sort them.
    delivered = rows.groupBy(F.col(period).alias("_period"), snapshot.alias("_snapshot"))
    delivered = delivered.agg(F.count("*").alias("_lines")).where("_lines > 0")
    newest = delivered.groupBy("_period").agg(F.max("_snapshot").alias("_newest"))
    newest = F.broadcast(newest) if periods is not None else newest
    if folded is not None:
        rows = folded.where(F.col(period).isin(*periods)) if periods is not None else folded
    return rows.join(newest, (F.col(period) == F.col("_period")) & (snapshot == F.col("_newest")), "left_semi")


def delivery_of(file_key: Column) -> Column:
    """The folder of a part file, shared by all parts of one delivery."""
    return F.regexp_replace(file_key, "/[^/]*$", "")
