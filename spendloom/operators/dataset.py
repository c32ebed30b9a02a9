"""Calls with their share of billed cost: per call, and folded to the grain reports need."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.fixed_values import RECONCILIATION_STATUSES
from spendloom.functions.calls import strip_cross_region_prefix
from spendloom.functions.common import display_user, friendly_model_name, iso_to_timestamp, model_name
from spendloom.operators.filters import active_in_dataset
from spendloom.operators.joins import hashed_join, may_match, with_key

COST_KEY = ["accountid", "usage_date", "cost_model", "resolveduserid"]
#: The same key in the reconciled costs.
_KEY_OF_COSTS = ["account_id", "usage_date", "model_id", "resolved_user_id"]
_INPUT_TYPES = ("input-tokens", "cache-read-input-token-count", "cache-write-input-token-count")
_COSTS = ["inputcost", "outputcost", "totalcost"]


def cost_per_key(reconciled: DataFrame) -> DataFrame:
    """Attributed cost per account, day, model and user: total, input part, output part, status.

    The status is the textual maximum; it is taken over ranks so the aggregate can hash.
    """
    return _keyed_cost(reconciled).drop("_key")


def _keyed_cost(reconciled: DataFrame) -> DataFrame:
    """The same with the hash of the key, by which it lies ready for `cost_per_call`."""
    cost, token = F.col("attributed_cost"), F.col("token_type")
    ranked = F.array(*[F.lit(s) for s in sorted(RECONCILIATION_STATUSES)])
    return (
        with_key(reconciled, _KEY_OF_COSTS)
        .groupBy("_key", *[F.col(name).alias(key) for name, key in zip(_KEY_OF_COSTS, COST_KEY, strict=True)])
        .agg(
            F.sum(cost).alias("totalcost"),
            F.sum(F.when(token.isin(*_INPUT_TYPES), cost).otherwise(0.0)).alias("inputcost"),
            F.sum(F.when(token == "output-tokens", cost).otherwise(0.0)).alias("outputcost"),
            F.max(F.array_position(ranked, F.col("reconciliation_status"))).alias("_status"),
        )
        .withColumn("reconciliation_status", F.try_element_at(ranked, F.col("_status").cast("int")))
        .drop("_status")
    )


def with_cost_key(calls: DataFrame) -> DataFrame:
    """Add `usage_date` (when absent) and `cost_model`, the call side of the cost key."""
    if "usage_date" not in calls.columns:
        calls = calls.withColumn("usage_date", F.concat_ws("-", "year", "month", "day"))
    return calls.withColumn("cost_model", strip_cross_region_prefix(F.col("resolvedmodelid")))


def cost_per_call(calls_per_key: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost of one call of each key: the key's cost divided by its number of calls."""
    divided = {name: F.coalesce(F.try_divide(name, "calls"), F.lit(0.0)) for name in _COSTS}
    status = F.coalesce("reconciliation_status", F.lit("pending"))
    return (
        hashed_join(calls_per_key, costs, COST_KEY, "left")
        .withColumns({**divided, "reconciliation_status": status})
    )


def call_dataset(calls: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Every call with its cost, names and totals: the dataset behind the dashboards.

    Calls are counted per key with a map-side combine; cost meets those counts one row to
    one row; only the last join has calls on one side, the left one, which the adaptive
    planner splits where a key is heavy.  Calls whose key has no cost stay out of all shuffles.
    """
    maybe, free = _by_cost(with_cost_key(calls).drop(*_COSTS), reconciled)
    counts = with_key(maybe, COST_KEY).groupBy("_key", *COST_KEY).agg(F.count("*").alias("calls"))
    priced = cost_per_call(counts, _keyed_cost(reconciled)).drop("calls")
    met = hashed_join(maybe, priced, COST_KEY, "left")
    zero = {name: F.coalesce(name, F.lit(0.0)) for name in _COSTS}
    met = met.withColumns(
        {**zero, "reconciliation_status": F.coalesce("reconciliation_status", F.lit("pending"))}
    )
    joined = met.unionByName(_unpriced(free, F.lit(0.0)))
    return joined.select(
        "requestid",
        iso_to_timestamp(F.col("timestamp")).alias("timestamp"),
        "accountid",
        "modelid",
        "inputtokens",
        "outputtokens",
        "latencyms",
        *_COSTS,
        "resolveduserid",
        display_user(F.col("resolvedusername"), F.col("resolveduserid"), F.col("accountid")).alias(
            "resolvedusername"
        ),
        "imagecount",
        "videodurationseconds",
        "sourceregion",
        "executionregion",
        "reconciliation_status",
        "usage_date",
        *[c.alias(n) for n, c in _derived().items()],
    )


def _by_cost(keyed: DataFrame, reconciled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose cost key may have costs, and rows whose key has none."""
    flagged = may_match(keyed, COST_KEY, reconciled, _KEY_OF_COSTS)
    return tuple(flagged.where(hit).drop("_may_match") for hit in (F.col("_may_match"), ~F.col("_may_match")))


def _unpriced(rows: DataFrame, cost: Column) -> DataFrame:
    return rows.withColumns({**{name: cost for name in _COSTS}, "reconciliation_status": F.lit("pending")})


#: What `usage_facts` reads of a call, besides its day.
CALL_COLUMNS = [
    "requestid", "accountid", "modelid", "resolvedmodelid", "resolveduserid", "resolvedusername", "inputtokens",
    "outputtokens", "latencyms",
]
FACT_KEY = ["usage_date", "accountid", "modelid", "cost_model", "resolveduserid", "resolvedusername"]


def usage_facts(
    calls: DataFrame,
    reconciled: DataFrame | None,
    folded: bool = True,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Calls, tokens, latency and cost per day, account, model and user.

    All reports but the minute ones are sums over this grain, so they never need the join of
    single calls with costs: calls are folded first, with a map-side combine, and the cost of
    a key is divided over its facts by their number of calls.  A sum over facts equals the sum
    over calls.  Without `reconciled` all costs are 0 and pending.

    Without `folded`, calls of keys that have no cost are not shuffled but stay rows of their own (one call each),
    for readers that sum anyway.  `keep` may store the folded calls that have costs, so that the shuffle that folds them
    and the one that joins them need not lie on the disks at once.
    """
    keyed = with_cost_key(calls).withColumn(
        "resolvedusername",
        display_user(F.col("resolvedusername"), F.col("resolveduserid"), F.col("accountid")),
    )
    none = F.lit(None).cast("double")
    if reconciled is None:
        joined = _unpriced(_fold(keyed), none)
    else:
        maybe, free = _by_cost(keyed, reconciled)
        # A cost key has one fact per spelling of its model id and user name, a handful; the
        # window shares its partitioning with the join.
        calls_of_key = F.sum("fact_calls").over(Window.partitionBy("_key", *COST_KEY))
        counted = with_key(keep(_fold(maybe)), COST_KEY).withColumn("calls", calls_of_key)
        priced = cost_per_call(counted, _keyed_cost(reconciled)).drop("calls")
        joined = priced.unionByName(_unpriced(_fold(free) if folded else _single(free), none))
    scaled = {n: F.coalesce(F.col(n) * F.col("fact_calls"), F.lit(0.0)) for n in _COSTS}
    return joined.withColumns(scaled).select(
        F.to_date("usage_date").alias("day"),
        "accountid",
        "modelid",
        "resolveduserid",
        "resolvedusername",
        F.col("fact_calls").alias("calls"),
        "inputtokens",
        "outputtokens",
        "latency_sum",
        "latency_count",
        *_COSTS,
        "reconciliation_status",
        *[c.alias(n) for n, c in _derived().items()],
    )


def _fold(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(*FACT_KEY).agg(
        F.count("requestid").alias("fact_calls"),
        F.sum("inputtokens").alias("inputtokens"),
        F.sum("outputtokens").alias("outputtokens"),
        F.sum("latencyms").alias("latency_sum"),
        F.count("latencyms").alias("latency_count"),
    )


def _single(keyed: DataFrame) -> DataFrame:
    """The columns of `_fold` for every call by itself."""
    one = lambda name: F.col(name).isNotNull().cast("bigint")
    return keyed.select(
        *FACT_KEY, one("requestid").alias("fact_calls"), "inputtokens", "outputtokens",
        F.col("latencyms").alias("latency_sum"), one("latencyms").alias("latency_count"),
    )


def _derived():
    return {
        "totaltokens": F.col("inputtokens") + F.col("outputtokens"),
        "modelname": model_name(F.col("modelid")),
        "friendlymodelname": friendly_model_name(F.col("modelid")),
    }


def metrics_dataset(metrics: DataFrame) -> DataFrame:
    """Metric rows with activity and their model names."""
    return active_in_dataset(metrics).withColumns(
        {
            "modelname": model_name(F.col("modelid")),
            "friendlymodelname": friendly_model_name(F.col("modelid")),
        }
    )
