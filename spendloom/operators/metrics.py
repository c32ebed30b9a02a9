"""Service metrics per model in five-minute windows, from call events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.fixed_values import METRIC_WINDOW
from spendloom.operators.percentiles import exact_percentile
from spendloom.session import checkpointed


def call_metrics(
    events: DataFrame,
    time: str,
    model: str,
    latency: Column,
    is_throttled: Column,
    is_error: Column,
    window: str = METRIC_WINDOW,
    region: Column | None = None,
    exact: bool = True,
) -> DataFrame:
    """`metrics` rows: calls, average and p99 latency, throttles, errors per window and model.

    Calls are first counted per distinct latency, hashed over the cluster; the percentile is taken from these
    counts by `percentiles.exact_percentile`, so no task holds the latencies of a window, however many there are.
    `exact=False` uses a sketch of fixed size.
    """
    region = F.lit("unknown") if region is None else region
    key = [
        F.window(F.col(time), window).getField("start").alias("window_start"),
        region.alias("region"),
        F.col(model).alias("modelid"),
    ]
    counts = [
        F.count("*").alias("n"),
        F.count_if(is_throttled).alias("throttled"),
        F.count_if(is_error).alias("errors"),
    ]
    names = ["window_start", "region", "modelid"]
    if exact:
        folded = checkpointed(events.groupBy(*key, latency.alias("latency")).agg(*counts))
        timed = F.when(F.col("latency").isNotNull(), F.col("n"))
        sums = folded.groupBy(*names).agg(
            F.sum("n").alias("invocationcount"),
            F.try_divide(F.sum(F.col("latency") * F.col("n")), F.sum(timed)).alias("invocationlatencyavg"),
            F.sum("throttled").alias("throttledcount"),
            F.sum("errors").alias("errorcount"),
        )
        p99 = exact_percentile(folded, names, "latency", 0.99, name="invocationlatencyp99")
        named = p99.withColumnsRenamed({c: f"_{c}" for c in names})
        rows = sums.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], "left")
    else:
        n, throttled, errors = counts
        rows = events.groupBy(*key).agg(
            n.alias("invocationcount"),
            F.avg(latency).alias("invocationlatencyavg"),
            F.percentile_approx(latency, 0.99).alias("invocationlatencyp99"),
            throttled.alias("throttledcount"),
            errors.alias("errorcount"),
        )
    return rows.select(
        "window_start",
        F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("timestamp"),
        "region",
        "modelid",
        "invocationcount",
        F.coalesce("invocationlatencyavg", F.lit(0.0)).alias("invocationlatencyavg"),
        F.coalesce(F.col("invocationlatencyp99").cast("double"), F.lit(0.0)).alias("invocationlatencyp99"),
        "throttledcount",
        "errorcount",
    )


def union_regions(parts: list[DataFrame]) -> DataFrame:
    """Metric rows of several regions as one table; a column a region lacks becomes NULL."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def newest_value(df: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Only the newest datapoint of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))
