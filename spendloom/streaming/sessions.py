"""Session identities from a stream: the first identity an access key resolved to, whatever batch it came in.

The stream keeps, per access key and day, the least (time, request) that resolved and its identity: an aggregate in the
state store, which forgets a day when the watermark has passed it. Every batch gives out the keys whose first request became
earlier, and they are folded into a table of sessions by the same minimum, so days, batches and reruns may come in any
order. Requests meet the table when they are read; the result equals that of the batch operator over all requests seen.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.fixed_values import DEDUP_MEMORY
from spendloom.functions.common import blank_to_null, iso_to_timestamp
from spendloom.operators import identities
from spendloom.session import intermediate
from spendloom.sources import versions

#: Folders of the table of sessions, by hash of the access key.
BUCKETS = 64
ORDER = ("timestamp", "requestid")
_BUCKET = ("bucket",)
_SESSIONS = """
    accesskeyid string, since struct<timestamp: string, requestid: string>,
    session_identity struct<resolved: boolean, reason: string, display_name: string, email: string, user_id: string,
                            iam_user_name: string, iam_role_name: string, source: string>
    """


def first_identities(
    requests: DataFrame,
    cache: DataFrame | None = None,
    directory: DataFrame | None = None,
    mode: str = "iam",
    memory: str = DEDUP_MEMORY,
) -> DataFrame:
    """(accesskeyid, since, session_identity) per key and day of a stream of requests, for update mode.

    `cache` and `directory` are tables. A request that lags the newest one by more than `memory` is not looked at any more;
    `late.gated` in front of the stream sets such requests apart.
    """
    session = blank_to_null(F.col("sessionname")) if "sessionname" in requests.columns else F.lit(None).cast("string")
    timed = requests.withColumns(
        {
            "principalarn": F.coalesce("principalarn", F.lit("")),
            "sessionname": session,
            "_time": iso_to_timestamp(F.col("timestamp")),
        }
    )
    own = identities.resolve_principals(timed, cache, directory, mode, keep=("accesskeyid", *ORDER, "_time"))
    resolved = own.where(F.col("identity.resolved") & blank_to_null(F.col("accesskeyid")).isNotNull())
    first = F.min(F.struct(F.struct(*ORDER).alias("since"), "identity")).alias("first")
    daily = resolved.withWatermark("_time", memory).groupBy(F.window("_time", "1 day"), "accesskeyid").agg(first)
    return daily.select("accesskeyid", "first.since", F.col("first.identity").alias("session_identity"))


def sessions_batch(table: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function for `first_identities`: folds the batch into the table, reading its buckets only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("accesskeyid"), F.lit(BUCKETS)).cast("string")
        with intermediate(batch.withColumn("bucket", bucket), "first-identities") as new:
            if new.isEmpty():
                return
            stored = versions.read(spark, table, _SESSIONS, _BUCKET, new.select("bucket").distinct())
            rows = new if stored is None else new.unionByName(stored)
            first = F.min(F.struct("since", "session_identity")).alias("first")
            folded = rows.groupBy("bucket", "accesskeyid").agg(first).select("bucket", "accesskeyid", "first.*")
            versions.replace(folded, table, _BUCKET)
            versions.vacuum(spark, table, _BUCKET)

    return write


def read_sessions(spark: SparkSession, table: str) -> DataFrame:
    found = versions.read(spark, table, _SESSIONS, _BUCKET)
    if found is None:
        found = spark.createDataFrame([], _SESSIONS + ", bucket string")
    return found.drop("bucket")


def resolve_with_sessions(
    requests: DataFrame, sessions: DataFrame, cache: DataFrame | None = None, directory: DataFrame | None = None, mode: str = "iam"
) -> DataFrame:
    """As `identities.resolve_requests`, with the sessions a stream has found."""
    return identities.in_sessions(identities.own_identities(requests, cache, directory, mode), sessions, ORDER)
