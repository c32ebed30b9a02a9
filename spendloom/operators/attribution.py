"""Split billed cost over the users who caused it.

cost lines -> buckets (7 keys) -> matched to per-user usage -> shares, without losing a cent.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.fixed_values import (
    CROSS_GEO,
    CROSS_GLOBAL,
    CROSS_NONE,
    MEASURE_BY_PRICING_UNIT,
    MEASURE_BY_TOKEN_TYPE,
    UNMATCHED_USER,
)
from spendloom.functions.billing import measure_for
from spendloom.functions.calls import billing_cross_region, strip_cross_region_prefix
from spendloom.functions.common import round10
from spendloom.operators.records import with_model_ids
from spendloom.operators.joins import fill_keys, hashed_join, may_match
from spendloom.operators.snapshot import latest_snapshot

BUCKET = [
    "usage_date",
    "account_id",
    "region",
    "model_billing_name",
    "token_type",
    "cross_region_type",
    "pricing_unit",
]
USAGE_SCOPE = ["usage_date", "account_id", "region", "model_id", "measure"]
USAGE_KEY = [*USAGE_SCOPE, "usage_cross"]
USER = ["resolved_user_id", "resolved_user_name"]
_CROSS_NAMES = {CROSS_NONE: "none", CROSS_GLOBAL: "global", CROSS_GEO: "geo"}
MEASURES = [*MEASURE_BY_TOKEN_TYPE.values(), *MEASURE_BY_PRICING_UNIT.values()]


def cost_buckets(costs: DataFrame) -> DataFrame:
    """Billed cost per bucket; buckets that sum to 0 drop out, credits stay."""
    keys = [F.col("usage_account_id").alias("account_id") if k == "account_id" else F.col(k) for k in BUCKET]
    return (
        costs.groupBy(*keys)
        .agg(F.sum("unblended_cost").alias("bucket_unblended_cost"))
        .where(F.col("bucket_unblended_cost") != 0)
    )


def newest_buckets(costs: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """`cost_buckets` of the newest delivery of each billing period.

    Lines are summed per delivery first, on the map side, and deliveries chosen among the sums.
    """
    keys = ["usage_account_id" if k == "account_id" else k for k in BUCKET]
    sums = costs.groupBy(*keys, "billing_period", "cur_file_key").agg(F.sum("unblended_cost").alias("unblended_cost"))
    return cost_buckets(latest_snapshot(costs, periods=periods, folded=sums))


def usage_by_user(
    calls: DataFrame, buckets: DataFrame | None = None, billing_names: DataFrame | None = None
) -> DataFrame:
    """Usage per day, account, region, model, cross-region type and user: one row per measure > 0.

    All measures are summed in one pass and unpivoted after the aggregation, on few rows.
    `calls` needs a `usage_date` column or the year, month and day partition columns.

    With `buckets` (see `cost_buckets`), usage that no bucket can be split by is left out before it is shuffled; a few
    such rows may stay.
    """
    day = F.col("usage_date") if "usage_date" in calls.columns else F.concat_ws("-", "year", "month", "day")
    model = F.coalesce(strip_cross_region_prefix(F.col("resolvedmodelid")), F.col("modelid"))
    cross = billing_cross_region(F.col("modelid"), F.col("sourceregion"), F.col("executionregion"))
    sums = [F.sum(F.when(F.col(m) > 0, F.col(m).cast("double"))).alias(m) for m in MEASURES]
    keys = [
        day.alias("usage_date"),
        F.col("accountid").alias("account_id"),
        F.col("executionregion").alias("region"),
        model.alias("model_id"),
        cross.alias("usage_cross"),
        F.col("resolveduserid").alias("resolved_user_id"),
        F.col("resolvedusername").alias("resolved_user_name"),
    ]
    names = ["usage_date", "account_id", "region", "model_id", "usage_cross", *USER]
    rows = fill_keys(calls.select(*keys, *MEASURES), *names)
    if buckets is None:
        return _unpivoted(rows.groupBy(*names).agg(*sums), names)
    scopes = with_usage_scope(buckets, billing_names)
    rows = _asked_for(rows, USAGE_SCOPE[:-1], scopes)
    return _asked_for(_unpivoted(rows.groupBy(*names).agg(*sums), names), USAGE_SCOPE, scopes)


def _unpivoted(usage: DataFrame, names: list[str]) -> DataFrame:
    # an unpivot gets new column ids in every branch of a plan, and its shuffles are not shared then
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("user_tokens")) for m in MEASURES]
    return usage.select(*names, F.inline(F.array(*pairs))).where(F.col("user_tokens") > 0)


def _asked_for(usage: DataFrame, keys: list[str], scopes: DataFrame) -> DataFrame:
    return may_match(usage, keys, scopes).where("_may_match").drop("_may_match")


def usage_totals(usage: DataFrame) -> DataFrame:
    """Total, user count and last user (by id and name) per usage scope, for each cross-region type."""
    aggregates = []
    for cross, name in _CROSS_NAMES.items():
        of_type = F.col("usage_cross") == cross
        aggregates.append(F.sum(F.when(of_type, F.col("user_tokens"))).alias(f"total_{name}"))
        aggregates.append(F.count_if(of_type).alias(f"users_{name}"))
        aggregates.append(F.max(F.when(of_type, F.struct(*USER, "user_tokens"))).alias(f"last_{name}"))
    return usage.groupBy(*USAGE_SCOPE).agg(*aggregates)


def match_buckets(buckets: DataFrame, totals: DataFrame) -> DataFrame:
    """Give each bucket the usage it is split by: `usage_cross`, `total_tokens`, `users`, `last`.

    A bucket takes usage of its own cross-region type.  A `none` bucket without any takes
    global usage, then geo usage.  Both sides are one row per key, and each bucket meets the
    usage of all three types in one row, so the fallback needs no further join.  Without any
    usage the four columns are NULL.
    """
    asked = F.col("cross_region_type")
    parts = ("usage_cross", "total_tokens", "users", "last")
    takes = [(asked == cross, cross) for cross in _CROSS_NAMES]
    takes += [(asked == CROSS_NONE, CROSS_GLOBAL), (asked == CROSS_NONE, CROSS_GEO)]

    def of_type(cross):
        name = _CROSS_NAMES[cross]
        values = [F.lit(cross), F.col(f"total_{name}"), F.col(f"users_{name}"), F.col(f"last_{name}")]
        return F.struct(*[v.alias(part) for v, part in zip(values, parts, strict=True)])

    # picked as one struct, all parts of it are read wherever one is, so that plans which use the result several
    # times share its shuffles
    picked = F.coalesce(*[F.when(ok & (F.col(f"users_{_CROSS_NAMES[c]}") > 0), of_type(c)) for ok, c in takes])
    return (
        hashed_join(buckets, totals, USAGE_SCOPE, "left")
        .withColumn("_picked", picked)
        .withColumns({part: F.col(f"_picked.{part}") for part in parts})
        .drop("_picked", *[f"{kind}_{name}" for kind in ("total", "users", "last") for name in _CROSS_NAMES.values()])
    )


def with_usage_scope(buckets: DataFrame, billing_names: DataFrame | None = None) -> DataFrame:
    """Add the model id (raw name when unknown) and the measure a bucket is split by."""
    named = with_model_ids(fill_keys(buckets, *BUCKET), billing_names)
    return named.withColumns(
        {
            "model_id": F.coalesce("resolved_model_id", "model_billing_name"),
            "measure": measure_for(F.col("pricing_unit"), F.col("token_type")),
        }
    ).drop("resolved_model_id")


def attribute(buckets: DataFrame, usage: DataFrame, billing_names: DataFrame | None = None) -> DataFrame:
    """`reconciled_costs` rows: every bucket's cost, fully split over its users.

    Shares are rounded to ten decimals; the last user of a bucket (by id and name) takes what
    is left, so the rows of a bucket add up to its cost.  With zero usage everyone gets the
    same share.  A bucket nobody used is one UNMATCHED row.

    A bucket may have any number of users.  The last user comes with the totals, the sum of the
    other shares from an aggregate; both combine on the map side, and the join of usage with
    buckets can be split on its usage side, so no task ever has to hold a bucket.  Sums of
    shares are decimal, exact in any order.  The aggregate also brings what a bucket's own row needs,
    so matched usage is shuffled once for the join, whose rows both parts of the result are made of.
    """
    matched = match_buckets(with_usage_scope(buckets, billing_names), usage_totals(usage))
    used = matched.where(F.col("users").isNotNull())
    met = hashed_join(_asked_for(usage, USAGE_KEY, used), used, USAGE_KEY, "inner")
    is_last = F.struct(*USER) == F.struct("last.resolved_user_id", "last.resolved_user_name")
    others = met.where(~is_last).withColumn("attributed_cost", _share())
    given = F.coalesce(F.sum(F.when(~is_last, _share())).cast("decimal(37,10)").cast("double"), F.lit(0.0))
    rest = round10(F.col("bucket_unblended_cost") - F.col("given"))
    lasts = (
        met.groupBy(*_BUCKET_ID, "total_tokens", "users", "last").agg(given.alias("given"))
        .select("*", "last.*")
        .withColumn("attributed_cost", F.when(F.col("total_tokens") == 0, _share().cast("double")).otherwise(rest))
    )
    return _finish(others).unionByName(_finish(lasts)).unionByName(_unmatched(matched.where(F.col("users").isNull())))


_BUCKET_ID = [*BUCKET, "model_id", "measure", "bucket_unblended_cost"]


def _proportion() -> Column:
    total = F.col("total_tokens")
    return F.when(total == 0, 1.0 / F.col("users")).otherwise(F.try_divide("user_tokens", total))


def _share() -> Column:
    return round10(_proportion() * F.col("bucket_unblended_cost")).cast("decimal(28,10)")


def _finish(rows: DataFrame) -> DataFrame:
    """Output columns of users' shares."""
    proportion = F.when(F.col("total_tokens") == 0, _proportion()).otherwise(round10(_proportion()))
    made = {
        "total_tokens_in_bucket": F.col("total_tokens"),
        "proportion": proportion,
        "attributed_cost": F.col("attributed_cost").cast("double"),
        "reconciliation_status": F.lit("reconciled"),
    }
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in _OUTPUT])


def _unmatched(buckets: DataFrame) -> DataFrame:
    """Output columns of buckets nobody used."""
    made = {
        **{name: F.lit(UNMATCHED_USER) for name in USER},
        "user_tokens": F.lit(0.0),
        "total_tokens_in_bucket": F.lit(0.0),
        "proportion": F.lit(0.0),
        "attributed_cost": F.col("bucket_unblended_cost").cast("double"),
        "reconciliation_status": F.lit("unmatched"),
    }
    return buckets.select(*[made[c].alias(c) if c in made else F.col(c) for c in _OUTPUT])


_OUTPUT = [
    "usage_date",
    "account_id",
    "region",
    "model_id",
    "model_billing_name",
    "token_type",
    "cross_region_type",
    *USER,
    "user_tokens",
    "total_tokens_in_bucket",
    "proportion",
    "bucket_unblended_cost",
    "attributed_cost",
    "reconciliation_status",
]
