"""Registered queries for dashboard reports, trends and quality checks (A6-A27, T, Q)."""

from datetime import date

from pyspark.sql import functions as F

from spendloom.functions.common import iso_to_timestamp
from spendloom.operators import dataset, filters, quality, records, reports, trend
from spendloom.registry import tables as t
from spendloom.registry.core import query, r4_sql, rounded
from spendloom.registry.joins import buckets, identity_precedence, newest_costs
from spendloom.registry.stores import facts, reconciled


def free_facts(spark, sf):
    """Usage facts for reports that show no cost: nothing is reconciled for them."""
    return dataset.usage_facts(t.calls(spark, sf), None)


def metric_dataset(spark, sf):
    return dataset.metrics_dataset(t.metric_rows(spark, sf))


_TREND = "SELECT strptime(usage_date, '%Y-%m-%d')::DATE AS day"


@query(
    "a6_executive_kpis",
    f"""SELECT count(*) AS calls, {r4_sql('sum(totalcost)')} AS total_cost,
      count(DISTINCT resolvedusername) AS users FROM priced""",
)
def executive_kpis(spark, sf):
    return rounded(reports.executive_kpis(facts(spark, sf)), "total_cost")


@query(
    "a7_error_rate",
    f"""SELECT friendlymodelname, {r4_sql('sum(errorcount) * 100.0 / sum(invocationcount)')} AS error_rate
      FROM metrics GROUP BY 1""",
)
def error_rate(spark, sf):
    return rounded(reports.error_rate(metric_dataset(spark, sf), reports.MODEL), "error_rate")


@query(
    "a8_daily_trend",
    f"{_TREND}, count(*) AS calls, {r4_sql('sum(totalcost)')} AS total_cost FROM priced GROUP BY 1",
)
def daily_trend(spark, sf):
    return rounded(reports.daily_trend(facts(spark, sf)), "total_cost")


@query(
    "a9_model_mix",
    f"""SELECT friendlymodelname, count(*) AS calls, {r4_sql('sum(totalcost)')} AS total_cost,
      {r4_sql('count(*) * 1.0::DOUBLE / (SELECT count(*) FROM priced)')} AS calls_share,
      {r4_sql('sum(totalcost) / (SELECT sum(totalcost) FROM priced)')} AS cost_share FROM priced GROUP BY 1""",
)
def model_mix(spark, sf):
    return rounded(reports.model_mix(facts(spark, sf)), "total_cost", "calls_share", "cost_share")


@query(
    "a10_cost_by_model",
    f"""SELECT friendlymodelname, {r4_sql('sum(inputcost)')} AS input_cost, {r4_sql('sum(outputcost)')} AS output_cost
      FROM priced GROUP BY 1""",
)
def cost_by_model(spark, sf):
    return rounded(reports.cost_by_model(facts(spark, sf)), "input_cost", "output_cost")


@query(
    "a11_window_metrics",
    f"""SELECT strftime(window_start, '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp, region, modelid, invocationcount,
      {r4_sql('invocationlatencyavg')} AS invocationlatencyavg, {r4_sql('invocationlatencyp99')} AS invocationlatencyp99,
      throttledcount, errorcount FROM metrics""",
)
def window_metrics(spark, sf):
    return rounded(t.metric_rows(spark, sf), "invocationlatencyavg", "invocationlatencyp99").drop("window_start")


@query(
    "s6_metric_pull",
    f"""SELECT modelid, count(*) AS windows, CAST(sum(invocationcount) AS BIGINT) AS calls,
      {r4_sql('max(invocationlatencyp99)')} AS worst_p99, CAST(sum(errorcount) AS BIGINT) AS errors
      FROM metrics WHERE invocationcount > 0 OR invocationlatencyavg > 0 GROUP BY 1""",
)
def metric_pull(spark, sf):
    """The five statistics of every model and window, for windows with activity."""
    rows = filters.active_in_collector(t.metric_rows(spark, sf)).groupBy("modelid")
    pulled = rows.agg(
        F.count("*").alias("windows"),
        F.sum("invocationcount").alias("calls"),
        F.max("invocationlatencyp99").alias("worst_p99"),
        F.sum("errorcount").alias("errors"),
    )
    return rounded(pulled, "worst_p99")


@query(
    "a12_cost_heat_map",
    f"""SELECT friendlymodelname, strptime(usage_date, '%Y-%m-%d')::DATE AS day, {r4_sql('sum(totalcost)')} AS total_cost
      FROM priced GROUP BY 1, 2""",
)
def cost_heat_map(spark, sf):
    return rounded(reports.cost_heat_map(facts(spark, sf)), "total_cost")


_DAYS_SQL = ", ".join(
    f"""{r4_sql(f"sum(totalcost) FILTER (usage_date[9:] = '{day}')")} AS "{day}\"""" for day in reports.DAYS_OF_MONTH
)


@query(
    "a12_cost_heat_map_wide",
    f"SELECT friendlymodelname, usage_date[:7] AS month, {_DAYS_SQL} FROM priced GROUP BY 1, 2",
)
def cost_heat_map_wide(spark, sf):
    """All months, a column per day."""
    return rounded(reports.cost_heat_map_wide(facts(spark, sf)), *reports.DAYS_OF_MONTH)


@query(
    "a13_daily_tokens",
    f"""{_TREND}, CAST(sum(inputtokens) AS BIGINT) AS input_tokens, CAST(sum(outputtokens) AS BIGINT) AS output_tokens
      FROM calls GROUP BY 1""",
)
def daily_tokens(spark, sf):
    return reports.daily_tokens(free_facts(spark, sf))


@query(
    "a14_user_model_breakdown",
    f"""SELECT resolvedusername, friendlymodelname, count(*) AS calls, CAST(sum(inputtokens) AS BIGINT) AS inputtokens,
      CAST(sum(outputtokens) AS BIGINT) AS outputtokens, {r4_sql('sum(totalcost)')} AS totalcost
      FROM priced GROUP BY 1, 2
      UNION ALL SELECT '(total)', friendlymodelname, count(*), CAST(sum(inputtokens) AS BIGINT),
        CAST(sum(outputtokens) AS BIGINT), {r4_sql('sum(totalcost)')} FROM priced GROUP BY 2""",
)
def user_model_breakdown(spark, sf):
    return rounded(reports.user_model_breakdown(facts(spark, sf)), "totalcost")


_CATALOG = [model.replace(".", " ").replace("-", " ") for model in t.MODEL_IDS]
_PIVOT_SQL = ", ".join(
    [f"""{r4_sql(f"sum(totalcost) FILTER (friendlymodelname = '{m}')")} AS "{m}\"""" for m in _CATALOG]
    + [f"""{r4_sql("sum(totalcost) FILTER (friendlymodelname NOT IN ('" + "', '".join(_CATALOG) + "'))")} AS other"""]
)


@query(
    "a14_user_model_pivot",
    f"""SELECT resolvedusername, {_PIVOT_SQL} FROM priced GROUP BY 1
      UNION ALL SELECT '(total)', {_PIVOT_SQL} FROM priced""",
)
def user_model_pivot(spark, sf):
    """A column per model of the catalog and one for all others, so the totals cover every cost."""
    return rounded(reports.user_model_pivot(facts(spark, sf), _CATALOG), *_CATALOG, reports.OTHER)


@query(
    "a15_cost_by_user",
    f"SELECT resolvedusername, {r4_sql('sum(totalcost)')} AS total_cost FROM priced GROUP BY 1",
)
def cost_by_user(spark, sf):
    return rounded(reports.cost_by_user(facts(spark, sf)), "total_cost")


@query(
    "a16_reconciliation_status",
    f"""SELECT reconciliation_status, count(*) AS records, {r4_sql('sum(attributed_cost)')} AS total_cost
      FROM reconciled GROUP BY 1""",
)
def reconciliation_status(spark, sf):
    return rounded(reports.reconciliation_status(reconciled(spark, sf)), "total_cost")


@query(
    "a16_call_status",
    "SELECT reconciliation_status, count(*) AS calls FROM priced GROUP BY 1",
)
def call_status(spark, sf):
    return reports.call_status(facts(spark, sf))


@query(
    "a17_latency_kpis",
    f"""SELECT {r4_sql('avg(invocationlatencyavg)')} AS avg_latency, {r4_sql('avg(invocationlatencyp99)')}
      AS avg_p99_latency, {r4_sql('sum(errorcount) * 100.0 / sum(invocationcount)')} AS error_rate FROM metrics""",
)
def latency_kpis(spark, sf):
    kpis = reports.latency_kpis(metric_dataset(spark, sf))
    return rounded(kpis, "avg_latency", "avg_p99_latency", "error_rate")


@query(
    "a17_true_p99",
    f"SELECT modelid, {r4_sql('quantile_cont(latencyms, 0.99)')} AS p99_latency FROM calls GROUP BY 1",
)
def true_p99(spark, sf):
    return rounded(reports.true_p99(t.calls(spark, sf), "modelid"), "p99_latency")


@query(
    "a18_latency_by_model",
    f"""SELECT friendlymodelname, {r4_sql('avg(invocationlatencyavg)')} AS avg_latency,
      {r4_sql('avg(invocationlatencyp99)')} AS p99_latency FROM metrics GROUP BY 1""",
)
def latency_by_model(spark, sf):
    return rounded(reports.latency_by_model(metric_dataset(spark, sf)), "avg_latency", "p99_latency")


@query(
    "a19_daily_throttles",
    """SELECT window_start::DATE AS day, friendlymodelname, CAST(sum(throttledcount) AS BIGINT) AS throttled
      FROM metrics GROUP BY 1, 2
      UNION ALL SELECT NULL, '(total)', CAST(sum(throttledcount) AS BIGINT) FROM metrics""",
)
def daily_throttles(spark, sf):
    return reports.daily_throttles(metric_dataset(spark, sf))


@query(
    "a20_latency_vs_tokens",
    f"""SELECT friendlymodelname, {r4_sql('avg(latencyms)')} AS avg_latency,
      CAST(sum(inputtokens + outputtokens) AS BIGINT) AS total_tokens FROM calls GROUP BY 1""",
)
def latency_vs_tokens(spark, sf):
    return rounded(reports.latency_vs_tokens(free_facts(spark, sf)), "avg_latency")


@query(
    "a21_quota_token_kpis",
    f"""SELECT CAST(sum(outputtokens) AS BIGINT) AS output_tokens, {r4_sql('avg(inputtokens)')} AS avg_input_tokens,
      {r4_sql('avg(outputtokens)')} AS avg_output_tokens FROM calls""",
)
def quota_token_kpis(spark, sf):
    kpis = reports.quota_token_kpis(free_facts(spark, sf))
    return rounded(kpis, "avg_input_tokens", "avg_output_tokens")


@query(
    "a21_quota_rate_kpis",
    f"SELECT {r4_sql('avg(invocationcount)')} AS steady_rate, max(invocationcount) AS peak_rate FROM metrics",
)
def quota_rate_kpis(spark, sf):
    return rounded(reports.quota_rate_kpis(metric_dataset(spark, sf)), "steady_rate")


def minutes(spark, sf):
    return reports.per_minute(t.calls(spark, sf), iso_to_timestamp(F.col("timestamp")))


@query(
    "a22_per_minute",
    """SELECT strftime(date_trunc('minute', happened), '%Y-%m-%d %H:%M') AS minute,
      CAST(sum(inputtokens + outputtokens) AS BIGINT) AS tokens, count(*) AS calls FROM calls GROUP BY 1""",
)
def per_minute(spark, sf):
    return minutes(spark, sf).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query(
    "a22_per_minute_lines",
    f"""SELECT {r4_sql('avg(tokens)')} AS avg_tokens, max(tokens) AS max_tokens, {r4_sql('avg(calls)')} AS avg_calls,
      max(calls) AS max_calls FROM (SELECT CAST(sum(inputtokens + outputtokens) AS BIGINT) AS tokens, count(*) AS calls
        FROM calls GROUP BY date_trunc('minute', happened))""",
)
def per_minute_lines(spark, sf):
    return rounded(reports.per_minute_lines(minutes(spark, sf)), "avg_tokens", "avg_calls")


def daily(spark, sf):
    return t.calls(spark, sf).groupBy(F.to_date("usage_date").alias("day")).agg(
        F.sum(F.col("inputtokens") + F.col("outputtokens")).alias("tokens")
    )


@query(
    "a23_weekly_growth",
    f"""WITH d AS (SELECT usage_date, sum(inputtokens + outputtokens) AS tokens FROM calls GROUP BY 1),
      w AS (SELECT CAST((SELECT count(*) FROM d e WHERE e.usage_date < d.usage_date) // 7 AS BIGINT) AS week,
              CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY 1)
      SELECT w.week, w.tokens, {r4_sql('CASE WHEN p.tokens = 0 THEN 0 ELSE (w.tokens - p.tokens) / p.tokens END')} AS growth
      FROM w LEFT JOIN w p ON p.week = w.week - 1""",
)
def weekly_growth(spark, sf):
    return rounded(trend.weekly_growth(daily(spark, sf)), "growth")


@query(
    "a23_monthly_growth",
    f"""WITH m AS (SELECT usage_date[:7] AS month, CAST(sum(inputtokens + outputtokens) AS BIGINT) AS tokens
        FROM calls GROUP BY 1)
      SELECT month, tokens, {r4_sql('(tokens - lag(tokens) OVER (ORDER BY month)) / lag(tokens) OVER (ORDER BY month)')}
        AS growth FROM m""",
)
def monthly_growth(spark, sf):
    return rounded(trend.monthly_growth(daily(spark, sf)), "growth")


@query(
    "w6_previous_period",
    """WITH m AS (SELECT usage_date[:7] AS month, CAST(sum(outputtokens) AS BIGINT) AS tokens FROM calls GROUP BY 1)
      SELECT m.month, m.tokens, p.tokens AS previous FROM m
      LEFT JOIN m p ON strptime(p.month, '%Y-%m') = strptime(m.month, '%Y-%m') - INTERVAL 1 MONTH""",
)
def previous_period(spark, sf):
    """Each month beside the one before it."""
    months = t.calls(spark, sf).groupBy(F.substring("usage_date", 1, 7).alias("month"))
    return trend.with_previous(months.agg(F.sum("outputtokens").alias("tokens")), "tokens", "month")


@query(
    "a24_efficiency",
    f"""SELECT resolvedusername, {r4_sql('sum(inputtokens + outputtokens) / count(*)')} AS tokens_per_call,
      {r4_sql('coalesce(sum(totalcost) / nullif(sum(inputtokens + outputtokens), 0), 0) * 1000')} AS cost_per_thousand
      FROM priced GROUP BY 1""",
)
def efficiency(spark, sf):
    rows = reports.efficiency(facts(spark, sf), reports.USER)
    rows = rows.withColumn("cost_per_thousand", F.col("cost_per_token") * 1000).drop("cost_per_token")
    return rounded(rows, "tokens_per_call", "cost_per_thousand")


@query(
    "a25_user_model_costs",
    f"""SELECT resolvedusername, modelid, CAST(sum(inputtokens) AS BIGINT) AS input_tokens,
      CAST(sum(outputtokens) AS BIGINT) AS output_tokens, {r4_sql('sum(totalcost)')} AS total_cost
      FROM priced GROUP BY 1, 2""",
)
def user_model_costs(spark, sf):
    return rounded(reports.user_model_costs(facts(spark, sf)), "total_cost")


@query(
    "a25_daily_model_costs",
    f"""SELECT usage_date, model_id, reconciliation_status, {r4_sql('sum(attributed_cost)')} AS cost
      FROM reconciled GROUP BY 1, 2, 3""",
)
def daily_model_costs(spark, sf):
    return rounded(reports.daily_model_costs(reconciled(spark, sf)), "cost")


@query(
    "a25_model_performance",
    f"""SELECT modelid, CAST(sum(invocationcount) AS BIGINT) AS invocations, {r4_sql('avg(invocationlatencyavg)')}
      AS avg_latency_ms, {r4_sql('avg(invocationlatencyp99)')} AS p99_latency_ms FROM metrics GROUP BY 1""",
)
def model_performance(spark, sf):
    rows = reports.model_performance(t.metric_rows(spark, sf))
    return rounded(rows, "avg_latency_ms", "p99_latency_ms")


@query(
    "a26_distinct_sets",
    """SELECT 'model' AS kind, modelid AS value FROM calls GROUP BY modelid
      UNION ALL SELECT 'day', usage_date FROM lines GROUP BY usage_date
      UNION ALL SELECT 'name', model_billing_name FROM lines GROUP BY model_billing_name""",
)
def distinct_sets(spark, sf):
    costs = newest_costs(spark, sf)
    sets = [("model", t.calls(spark, sf), "modelid"), ("day", costs, "usage_date"), ("name", costs, "model_billing_name")]
    parts = [
        reports.active_values(rows, column).select(F.lit(kind).alias("kind"), F.col(column).alias("value"))
        for kind, rows, column in sets
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a27_last_refreshed", "SELECT strftime(max(happened), '%Y-%m-%d %H:%M:%S') AS last_refreshed FROM calls")
def last_refreshed(spark, sf):
    newest = reports.last_refreshed(t.calls(spark, sf), iso_to_timestamp(F.col("timestamp")))
    return newest.select(F.date_format("last_refreshed", "yyyy-MM-dd HH:mm:ss").alias("last_refreshed"))


# --- sorted and limited reports ---------------------------------------------------------------


@query(
    "t1_top_users",
    f"""SELECT resolvedusername, count(*) AS calls, {r4_sql('sum(totalcost)')} AS total_cost
      FROM priced GROUP BY 1 ORDER BY sum(totalcost) DESC, 1 LIMIT 10""",
)
def top_users(spark, sf):
    return rounded(reports.top_users(facts(spark, sf)), "total_cost")


@query(
    "t2_throttle_table",
    """SELECT friendlymodelname, CAST(sum(throttledcount) AS BIGINT) AS throttled FROM metrics
      GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def throttle_table(spark, sf):
    rows = metric_dataset(spark, sf).groupBy(reports.MODEL).agg(F.sum("throttledcount").alias("throttled"))
    return rows.orderBy(F.desc("throttled"), reports.MODEL)


@query(
    "t3_users_by_cost",
    f"""SELECT resolvedusername, {r4_sql('sum(totalcost)')} AS total_cost FROM priced
      GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def users_by_cost(spark, sf):
    rows = rounded(reports.cost_by_user(facts(spark, sf)), "total_cost")
    return rows.orderBy(F.desc("total_cost"), reports.USER)


@query(
    "t5_high_cost_users",
    f"""SELECT resolvedusername, {r4_sql('sum(totalcost)')} AS total_cost,
      CASE WHEN sum(totalcost) >= 100 THEN 'high' ELSE 'normal' END AS cost_flag FROM priced GROUP BY 1""",
)
def high_cost_users(spark, sf):
    return rounded(reports.flag_high_cost(reports.cost_by_user(facts(spark, sf))), "total_cost")


# --- quality checks -----------------------------------------------------------------------------


@query(
    "q1_mismatch",
    f"""SELECT 'reconciliation_mismatch_percent' AS check_name,
      {r4_sql("abs(sum(CASE WHEN reconciliation_status = 'reconciled' THEN attributed_cost ELSE 0 END) - (SELECT sum(cost) FROM buckets)) / (SELECT sum(cost) FROM buckets) * 100")}
        AS value, 5.0::DOUBLE AS threshold, true AS breached FROM reconciled""",
)
def mismatch(spark, sf):
    """Most of this bill is unmatched, and the check says so."""
    return rounded(quality.mismatch(reconciled(spark, sf), buckets(spark, sf)), "value")


@query(
    "q2_reconcile_age",
    f"""SELECT 'reconciliation_age_hours' AS check_name,
      {r4_sql("(epoch(TIMESTAMP '2001-11-05 12:00:00') - epoch(max(l_shipdate))) / 3600.0")} AS value,
      24.0::DOUBLE AS threshold, true AS breached FROM lineitem""",
)
def reconcile_age(spark, sf):
    runs = t.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("run_at"))
    return rounded(quality.reconcile_age(runs, "run_at", "2001-11-05 12:00:00"), "value")


@query(
    "q3_billing_age",
    f"""SELECT 'billing_data_age_hours' AS check_name,
      {r4_sql("(epoch(TIMESTAMP '2001-08-02 12:00:00') - epoch(max(ordered))) / 3600.0")} AS value,
      48.0::DOUBLE AS threshold, false AS breached FROM lines""",
)
def billing_age(spark, sf):
    costs = newest_costs(spark, sf).withColumn("day", F.col("usage_date").try_cast("timestamp"))
    return rounded(quality.billing_age(costs, "day", "2001-08-02 12:00:00"), "value")


@query(
    "q4_unmapped_names",
    """SELECT 'unmapped_billing_names' AS check_name, CAST(count(DISTINCT model_billing_name) AS DOUBLE) AS value,
      0.0::DOUBLE AS threshold, true AS breached FROM lines WHERE model_id = model_billing_name""",
)
def unmapped_name_count(spark, sf):
    costs = newest_costs(spark, sf)
    return quality.unmapped_billing_names(records.names_missing_from(costs, records.billing_map(costs)))


@query(
    "q5_identity_misses",
    f"""SELECT 'identity_miss_percent' AS check_name, {r4_sql('avg(CASE WHEN s % 3 = 0 THEN 0 ELSE 100.0 END)')} AS value,
      50.0::DOUBLE AS threshold, true AS breached FROM calls""",
)
def identity_misses(spark, sf):
    """Over the resolved principals, each counted as often as it called."""
    return rounded(quality.identity_miss_rate(identity_precedence(spark, sf), "source", weight=F.col("n")), "value")


@query(
    "q6_dead_letters",
    """SELECT 'dead_letters' AS check_name, CAST(count(*) AS DOUBLE) AS value, 0.0::DOUBLE AS threshold,
      true AS breached FROM calls WHERE k % 11 = 0""",
)
def dead_letters(spark, sf):
    parsed = records.parse_call_lines(t.call_lines(spark, sf))
    return quality.dead_letters(records.rejected_lines(parsed, "calls", "2024-01-01T00:00:00Z"))


@query(
    "q7_error_windows",
    """SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start,
      'errors_per_window' AS check_name, CAST(count(*) AS DOUBLE) AS value, 1.0::DOUBLE AS threshold, true AS breached
      FROM events WHERE event_type = 'error' GROUP BY 1""",
)
def error_windows(spark, sf):
    rows = quality.error_windows(t.timed_events(spark, sf), "event_time", F.col("event_type") == "error")
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(
    "q8_retention",
    """SELECT usage_date, count(*) AS n FROM calls WHERE usage_date >= '2001-05-03' GROUP BY 1""",
)
def retention(spark, sf):
    rows = quality.within_retention(t.calls(spark, sf), F.to_date("usage_date"), date(2001, 8, 1))
    return rows.groupBy("usage_date").agg(F.count("*").alias("n"))
