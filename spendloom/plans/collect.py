"""Jobs that fill the metrics table and the table of known identities."""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spendloom import schemas
from spendloom.functions.common import iso_to_timestamp
from spendloom.operators.dedup import drop_known
from spendloom.operators.filters import active_in_collector, between_days
from spendloom.operators.identities import resolve_principals
from spendloom.operators.metrics import call_metrics
from spendloom.session import prepare
from spendloom.sources import readers, writers


def collect_metrics(
    spark: SparkSession,
    calls_path: str,
    target: str,
    start: date,
    end: date,
    is_throttled: Column | None = None,
    is_error: Column | None = None,
) -> None:
    """Five-minute metrics of the calls of whole days, both included; the hours of these days are replaced.

    Only the day partitions of the range are read.  Latencies are whole milliseconds, so the exact percentile
    is taken over few distinct values per window.
    """
    prepare(spark)
    calls = readers.read_table(spark, calls_path, schemas.CALLS, schemas.HOUR_PARTITIONS)
    chosen = between_days(calls, F.to_date(F.concat_ws("-", "year", "month", "day")), start, end)
    timed = chosen.withColumn("_time", iso_to_timestamp(F.col("timestamp")))
    no = F.lit(False)
    rows = call_metrics(
        timed, "_time", "modelid", F.col("latencyms"), no if is_throttled is None else is_throttled,
        no if is_error is None else is_error, region=F.col("executionregion"),
    )
    rows = active_in_collector(rows.drop("window_start"))
    writers.overwrite_partitions(writers.with_hour_partitions(rows), target, schemas.HOUR_PARTITIONS)


def store_identities(
    spark: SparkSession,
    principals: DataFrame,
    target: str,
    resolved_at: str,
    directory: DataFrame | None = None,
    mode: str = "iam",
) -> None:
    """Resolve the principals that `identity_mappings` does not list yet and append those resolved.

    `principals` has `principalarn`, and `sessionname`, `accesskeyid`, `accountid` where known.  A principal is
    stored once, so a rerun adds none.
    """
    prepare(spark)
    for name in ("sessionname", "accesskeyid", "accountid"):
        if name not in principals.columns:
            principals = principals.withColumn(name, F.lit(None).cast("string"))
    new = principals.groupBy("principalarn").agg(*[F.max(n).alias(n) for n in ("sessionname", "accesskeyid", "accountid")])
    try:
        known = readers.read_table(spark, target, schemas.IDENTITY_MAPPINGS).select("principalarn").distinct()
        new = drop_known(new, known, ["principalarn"])
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    found = resolve_principals(new.select("principalarn", "sessionname"), None, directory, mode)
    rows = found.where("identity.resolved").join(new.drop("sessionname"), "principalarn")
    name = F.coalesce("identity.display_name", "identity.iam_user_name", "identity.iam_role_name", "principalarn")
    rows = rows.select(
        "principalarn",
        F.col("identity.source").alias("sourcetype"),
        name.alias("displayname"),
        F.col("identity.email").alias("email"),
        F.col("identity.user_id").alias("userid"),
        "accesskeyid",
        "accountid",
        F.lit(resolved_at).alias("resolvedat"),
    )
    writers.write_parquet(rows, target, mode="append")
