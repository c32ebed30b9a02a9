"""Dashboard reports.

Each takes `usage_facts` (day grain), `metrics_dataset` rows or the call table, and returns a
small table.  Filter the input with `operators.filters` for date ranges and models.  Windows
in here run over already folded rows: models or days, which a catalog and a calendar bound.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.fixed_values import HIGH_COST_LIMIT
from spendloom.functions.common import ratio_or_zero
from spendloom.operators.percentiles import exact_percentile
from spendloom.session import checkpointed

MODEL = "friendlymodelname"
USER = "resolvedusername"
TOTAL = "(total)"
OTHER = "other"


DAYS_OF_MONTH = [f"{day:02d}" for day in range(1, 32)]

def executive_kpis(facts: DataFrame) -> DataFrame:
    """Calls, total cost, distinct users."""
    return facts.agg(
        F.sum("calls").alias("calls"),
        F.sum("totalcost").alias("total_cost"),
        F.countDistinct(USER).alias("users"),
    )


def latency_kpis(metrics: DataFrame) -> DataFrame:
    """Average of window averages and of window p99s, plus the error rate."""
    return metrics.agg(
        F.avg("invocationlatencyavg").alias("avg_latency"),
        F.avg("invocationlatencyp99").alias("avg_p99_latency"),
        _error_rate().alias("error_rate"),
    )


def error_rate(metrics: DataFrame, *keys: str) -> DataFrame:
    """Errors per hundred calls, a ratio of sums, 0 without calls."""
    return metrics.groupBy(*keys).agg(_error_rate().alias("error_rate"))


def true_p99(calls: DataFrame, *keys: str) -> DataFrame:
    """p99 over calls rather than an average of window p99s, exact for groups of any size."""
    folded = checkpointed(calls.groupBy(*keys, "latencyms").agg(F.count("*").alias("n")))
    return exact_percentile(folded, list(keys), "latencyms", 0.99, name="p99_latency")


def daily_trend(facts: DataFrame) -> DataFrame:
    return facts.groupBy("day").agg(
        F.sum("calls").alias("calls"), F.sum("totalcost").alias("total_cost")
    )


def model_mix(facts: DataFrame) -> DataFrame:
    """Calls and cost per model, each with its share of the whole."""
    rows = facts.groupBy(MODEL).agg(F.sum("calls").alias("calls"), F.sum("totalcost").alias("total_cost"))
    # the whole as two numbers, so that no task sees all models
    whole = rows.agg(F.struct(F.sum("calls").alias("calls"), F.sum("total_cost").alias("cost")).alias("whole")).scalar()
    return rows.withColumns(
        {
            "calls_share": ratio_or_zero(F.col("calls"), whole["calls"]),
            "cost_share": ratio_or_zero(F.col("total_cost"), whole["cost"]),
        }
    )


def cost_by_model(facts: DataFrame) -> DataFrame:
    return facts.groupBy(MODEL).agg(
        F.sum("inputcost").alias("input_cost"), F.sum("outputcost").alias("output_cost")
    )


def cost_heat_map(facts: DataFrame) -> DataFrame:
    """Cost per model and day, one row per cell."""
    return facts.groupBy(MODEL, "day").agg(F.sum("totalcost").alias("total_cost"))


def cost_heat_map_wide(facts: DataFrame) -> DataFrame:
    """The heat map with one column per day of the month, `01` to `31`, and one row per model and month.

    The columns are fixed and hold every day of the facts, so a row adds up to the model's cost of its month.
    """
    dated = facts.withColumns({"month": F.date_format("day", "yyyy-MM"), "_day": F.date_format("day", "dd")})
    return dated.groupBy(MODEL, "month").pivot("_day", DAYS_OF_MONTH).agg(F.sum("totalcost"))


def daily_tokens(facts: DataFrame) -> DataFrame:
    return facts.groupBy("day").agg(
        F.sum("inputtokens").alias("input_tokens"), F.sum("outputtokens").alias("output_tokens")
    )


def user_model_breakdown(facts: DataFrame) -> DataFrame:
    """Calls, tokens and cost per user and model, with a total row per model.

    Rows fold to user x model before the totals are added, so the rollup expands few rows.
    """
    leaf = facts.groupBy(USER, MODEL).agg(*_sums("calls", "inputtokens", "outputtokens", "totalcost"))
    rolled = leaf.rollup(MODEL, USER).agg(
        *_sums("calls", "inputtokens", "outputtokens", "totalcost"), F.grouping_id().alias("_level")
    )
    # level 0: a user's row, 1: the total of a model, 3: the total of everything
    label = F.when(F.col("_level") == 1, TOTAL).otherwise(F.col(USER)).alias(USER)
    return rolled.where(F.col("_level") < 3).select(
        label, MODEL, "calls", "inputtokens", "outputtokens", "totalcost"
    )


def user_model_pivot(facts: DataFrame, models: list[str]) -> DataFrame:
    """Cost per user, one column per given model and one for all others, and a last total row."""
    column = F.when(F.col(MODEL).isin(*models), F.col(MODEL)).otherwise(OTHER)
    leaf = facts.groupBy(USER, column.alias(MODEL)).agg(F.sum("totalcost").alias("totalcost"))
    wide = leaf.groupBy(USER).pivot(MODEL, [*models, OTHER]).agg(F.sum("totalcost"))
    names = [c for c in wide.columns if c != USER]
    totals = wide.agg(*[F.sum(f"`{n}`").alias(n) for n in names]).withColumn(USER, F.lit(TOTAL))
    return wide.unionByName(totals)


def cost_by_user(facts: DataFrame) -> DataFrame:
    return facts.groupBy(USER).agg(F.sum("totalcost").alias("total_cost"))


def flag_high_cost(by_user: DataFrame, limit: float = HIGH_COST_LIMIT) -> DataFrame:
    flag = F.when(F.col("total_cost") >= limit, "high").otherwise("normal")
    return by_user.withColumn("cost_flag", flag)


def top_users(facts: DataFrame, n: int = 10) -> DataFrame:
    """The `n` users with the highest cost; equal cost is ordered by name."""
    rows = facts.groupBy(USER).agg(F.sum("calls").alias("calls"), F.sum("totalcost").alias("total_cost"))
    return rows.orderBy(F.desc("total_cost"), USER).limit(n)


def call_status(facts: DataFrame) -> DataFrame:
    """Number of calls by cost status."""
    return facts.groupBy("reconciliation_status").agg(F.sum("calls").alias("calls"))


def reconciliation_status(reconciled: DataFrame) -> DataFrame:
    """Rows and cost by status; unmatched cost is a line of its own."""
    return reconciled.groupBy("reconciliation_status").agg(
        F.count("*").alias("records"), F.sum("attributed_cost").alias("total_cost")
    )


def latency_by_model(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(MODEL).agg(
        F.avg("invocationlatencyavg").alias("avg_latency"), F.avg("invocationlatencyp99").alias("p99_latency")
    )


def daily_throttles(metrics: DataFrame) -> DataFrame:
    """Throttles per day and model, the most first, and a grand total row."""
    leaf = metrics.groupBy(F.to_date("window_start").alias("day"), MODEL).agg(
        F.sum("throttledcount").alias("throttled")
    )
    level = F.grouping_id().alias("_level")
    rolled = leaf.rollup("day", MODEL).agg(F.sum("throttled").alias("throttled"), level)
    kept = rolled.where(F.col("_level").isin(0, 3))
    label = F.when(F.col("_level") == 3, TOTAL).otherwise(F.col(MODEL)).alias(MODEL)
    return kept.select("day", label, "throttled").orderBy(
        F.desc("throttled"), F.asc_nulls_last("day"), MODEL
    )


def latency_vs_tokens(facts: DataFrame) -> DataFrame:
    """Average call latency and total tokens per model."""
    return facts.groupBy(MODEL).agg(
        ratio_or_zero(F.sum("latency_sum"), F.sum("latency_count")).alias("avg_latency"),
        F.sum("totaltokens").alias("total_tokens"),
    )


def quota_token_kpis(facts: DataFrame) -> DataFrame:
    """Total output tokens and tokens per call."""
    return facts.agg(
        F.sum("outputtokens").alias("output_tokens"),
        ratio_or_zero(F.sum("inputtokens"), F.sum("calls")).alias("avg_input_tokens"),
        ratio_or_zero(F.sum("outputtokens"), F.sum("calls")).alias("avg_output_tokens"),
    )


def quota_rate_kpis(metrics: DataFrame) -> DataFrame:
    """Average and highest calls per metric row, shown as steady and peak rates."""
    return metrics.agg(
        F.avg("invocationcount").alias("steady_rate"), F.max("invocationcount").alias("peak_rate")
    )


def per_minute(calls: DataFrame, time: Column) -> DataFrame:
    """Tokens and calls per minute."""
    return calls.groupBy(F.date_trunc("minute", time).alias("minute")).agg(
        F.sum(F.col("inputtokens") + F.col("outputtokens")).alias("tokens"),
        F.count("requestid").alias("calls"),
    )


def per_minute_lines(minutes: DataFrame) -> DataFrame:
    """Average and maximum over the minutes: the two reference lines of that chart."""
    return minutes.agg(
        F.avg("tokens").alias("avg_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.avg("calls").alias("avg_calls"),
        F.max("calls").alias("max_calls"),
    )


def efficiency(facts: DataFrame, *keys: str) -> DataFrame:
    """Tokens per call and cost per token, 0 on a zero divisor."""
    return facts.groupBy(*keys).agg(
        ratio_or_zero(F.sum("totaltokens"), F.sum("calls")).alias("tokens_per_call"),
        ratio_or_zero(F.sum("totalcost"), F.sum("totaltokens")).alias("cost_per_token"),
    )


def user_model_costs(facts: DataFrame) -> DataFrame:
    """Tokens and cost per user and called model, the highest cost first."""
    rows = facts.groupBy(USER, "modelid").agg(
        F.sum("inputtokens").alias("input_tokens"),
        F.sum("outputtokens").alias("output_tokens"),
        F.sum("totalcost").alias("total_cost"),
    )
    return rows.orderBy(F.desc("total_cost"), USER, "modelid")


def daily_model_costs(reconciled: DataFrame) -> DataFrame:
    """Attributed cost per day, model and status, in day order."""
    return (
        reconciled.groupBy("usage_date", "model_id", "reconciliation_status")
        .agg(F.sum("attributed_cost").alias("cost"))
        .orderBy("usage_date", "model_id", "reconciliation_status")
    )


def model_performance(metrics: DataFrame) -> DataFrame:
    """Calls and latency per model over metric rows with calls, the busiest first."""
    return (
        metrics.where(F.col("invocationcount") > 0)
        .groupBy("modelid")
        .agg(
            F.sum("invocationcount").alias("invocations"),
            F.avg("invocationlatencyavg").alias("avg_latency_ms"),
            F.avg("invocationlatencyp99").alias("p99_latency_ms"),
        )
        .orderBy(F.desc("invocations"), "modelid")
    )


def last_refreshed(calls: DataFrame, time: Column) -> DataFrame:
    return calls.agg(F.max(time).alias("last_refreshed"))


def active_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values: active models, days with cost, billing names."""
    return df.select(column).distinct()


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _error_rate() -> Column:
    rate = F.try_divide(F.sum("errorcount"), F.sum("invocationcount")) * 100
    return F.coalesce(rate, F.lit(0.0))
