"""Registered queries for sources, sinks and streams (S, K, ST).

They write what they need below the shared folder and read it back, so the files they work on
grow with the given tables.
"""

from pyspark.sql import functions as F

from spendloom import schemas
from spendloom.fixed_values import BILLING_HEADERS
from spendloom.operators import attribution, filters, records
from spendloom.operators.dataset import CALL_COLUMNS
from spendloom.operators.snapshot import delivery_of, latest_snapshot
from spendloom.plans import facts as facts_job
from spendloom.plans import ingest
from spendloom.registry import tables as t
from spendloom.registry.columns import directory
from spendloom.registry.core import CHECKS, query, r4, r4_sql, rounded
from spendloom.registry.joins import newest_costs, session_requests
from spendloom.registry.stores import reconciled
from spendloom.session import release, shared_dir
from spendloom.sources import files, ledger, readers, versions, writers
from spendloom.streaming import jobs, sessions

_FAILED_AT = "2024-01-01T00:00:00Z"
#: The given calls lie days apart, so hour partitions would hold a row each.
_MONTHS = ("year", "month")


# --- sources ----------------------------------------------------------------------------------


def written_call_log(spark, sf):
    path = shared_dir(spark, "call-log")
    t.call_lines(spark, sf).select("value").write.option("compression", "gzip").text(path)
    return path


_LINES_BY_DAY = """SELECT usage_date, count(*) AS n, CAST(sum(inputtokens) AS BIGINT) AS tokens
  FROM calls WHERE k % 11 != 0 GROUP BY 1"""


@query("s1_json_lines", _LINES_BY_DAY)
def json_lines(spark, sf):
    """Gzip JSON lines, read, parsed and counted per day."""
    parsed = records.parse_call_lines(readers.read_call_lines(spark, written_call_log(spark, sf)))
    rows = records.call_rows(parsed).groupBy(F.substring("timestamp", 1, 10).alias("usage_date"))
    return rows.agg(F.count("*").alias("n"), F.sum("inputtokens").alias("tokens"))


@query(
    "s2_audit_documents",
    """SELECT o_orderkey % 6 AS kind, count(*) AS n, count(DISTINCT o_orderkey) AS documents
      FROM orders, (VALUES (1), (2)) AS v(i) WHERE o_orderkey % 13 != 0 AND o_orderkey % 6 < 4 GROUP BY 1""",
)
def audit_documents(spark, sf):
    """Documents of up to a hundred orders, each event twice, as files; every 13th order stands for one without records."""
    found = records.explode_audit(readers.read_audit_files(spark, written_audit(spark, sf)))
    rows = records.audit_rows(filters.model_call_events(found, "event.eventName"))
    key = F.regexp_extract("eventid", r"(\d+)", 1).cast("bigint")
    return rows.groupBy((key % 6).alias("kind")).agg(
        F.count("*").alias("n"), F.countDistinct("eventid").alias("documents")
    )


def written_audit(spark, sf):
    event = F.col("event")
    part = F.floor(F.col("k") / 100).cast("string")
    events = t.audit_events(spark, sf)
    full = events.where("k % 13 != 0").groupBy(part.alias("part")).agg(F.flatten(F.collect_list(F.array(event, event))).alias("Records"))
    texts = full.select(F.to_json(F.struct("Records")).alias("value"), "part")
    empty = events.where("k % 13 = 0").select(F.lit('{"Digest": []}').alias("value"), F.concat(F.lit("empty"), part).alias("part"))
    path = shared_dir(spark, "audit")
    # a file per row: folders of one file each would be made, listed and renamed one by one
    texts.unionByName(empty.distinct()).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def written_export(spark, sf, kind):
    """Both deliveries of the billing export as files; as text, the second one has other headers in another order."""
    path = shared_dir(spark, f"export-{kind}")
    quoted = F.concat("item_description", F.lit(', "list price"'))
    rows = t.billing_export(spark, sf).withColumn("item_description", quoted).drop("_month", "cur_file_key")
    for delivery in ("1", "2"):
        part = rows.where(F.col("delivery") == delivery).drop("delivery")
        if kind == "parquet":
            part.write.parquet(f"{path}/run-{delivery}")
            continue
        if delivery == "2":
            other = {names[0]: names[-1] for names in BILLING_HEADERS.values()} | {"usage_start_date": "lineItem/UsageStartDate"}
            other["usage_account_id"] = other.pop("linked_account_id", "lineItem/UsageAccountId")
            part = part.select(*[F.col(c).alias(other.get(c, c)) for c in reversed(part.columns)])
        part.write.option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{path}/run-{delivery}")
    return path


def newest_delivery(costs):
    """Part files of one delivery lie in one folder."""
    return latest_snapshot(costs, snapshot=delivery_of(F.col("cur_file_key")))


_EXPORT_CHECK = f"""SELECT usage_date, count(*) AS n, {r4_sql('sum(unblended_cost)')} AS cost,
  count(unit_price) AS priced FROM lines GROUP BY 1"""


def _by_day(costs):
    return costs.groupBy("usage_date").agg(
        F.count("*").alias("n"), r4(F.sum("unblended_cost")).alias("cost"), F.count("unit_price").alias("priced")
    )


@query("s3_csv_export", _EXPORT_CHECK)
def csv_export(spark, sf):
    """Gzip CSV with quoted commas and doubled quotes, two deliveries of different layouts in one load."""
    return _by_day(newest_delivery(records.cost_rows(readers.read_billing_csv(spark, written_export(spark, sf, "csv")))))


@query(
    "s4_export_files",
    """SELECT true AS only_exports, count(*) + count(*) FILTER (day(ordered) <= 15) AS n FROM bill0""",
)
def export_files(spark, sf):
    """Only `.csv` and `.csv.gz` files of a folder are read; a manifest beside them is not."""
    path = written_export(spark, sf, "csv")
    t.billing_export(spark, sf).select("usage_type").write.mode("append").text(f"{path}/run-1")
    rows = readers.read_billing_csv(spark, path)
    return rows.groupBy(F.col("cur_file_key").endswith(".csv.gz").alias("only_exports")).agg(F.count("*").alias("n"))


@query(
    "s5_partitioned_scan",
    """SELECT modelid, count(*) AS n, CAST(sum(invocationcount) AS BIGINT) AS calls FROM metrics
      WHERE window_start >= '2024-01-05' AND window_start < '2024-01-08' GROUP BY 1""",
)
def partitioned_scan(spark, sf):
    """Three day partitions of the metrics table."""
    rows = stored_metrics(spark, sf).where("year = '2024' AND month = '01' AND day IN ('05', '06', '07')")
    return rows.groupBy("modelid").agg(F.count("*").alias("n"), F.sum("invocationcount").alias("calls"))


@query("s8_parquet_export", _EXPORT_CHECK)
def parquet_export(spark, sf):
    return _by_day(newest_delivery(records.cost_rows(readers.read_billing_parquet(spark, written_export(spark, sf, "parquet")))))


@query(
    "s9_directory",
    """SELECT c_nationkey % 4 AS part, count(*) AS n FROM customer WHERE c_custkey % 4 = 1 GROUP BY 1""",
)
def directory_users(spark, sf):
    path = shared_dir(spark, "directory")
    directory(spark, sf).drop("c_custkey").write.json(path)
    nation = F.regexp_extract("Name.GivenName", r"(\d+)$", 1).cast("int")
    rows = readers.read_directory(spark, path).where(F.col("Name.GivenName").isNotNull())
    return rows.groupBy((nation % 4).alias("part")).agg(F.count("*").alias("n"))


# --- sinks --------------------------------------------------------------------------------------


def stored_metrics(spark, sf):
    path = shared_dir(spark, "metrics")
    rows = t.metric_rows(spark, sf).drop("window_start")
    writers.append_partitioned(writers.with_hour_partitions(rows), path)
    return readers.read_table(spark, path, schemas.METRICS, schemas.HOUR_PARTITIONS)


@query(
    "k1_hour_partitions",
    """SELECT strftime(window_start, '%Y') AS year, strftime(window_start, '%m') AS month,
      strftime(window_start, '%d') AS day, strftime(window_start, '%H') AS hour, count(*) AS n FROM metrics
      GROUP BY ALL""",
)
def hour_partitions(spark, sf):
    return stored_metrics(spark, sf).groupBy(*schemas.HOUR_PARTITIONS).agg(F.count("*").alias("n"))


@query(
    "k2_day_partitions",
    f"""SELECT CASE WHEN event_id % 50 != 0 THEN strftime(ts, '%d') END AS day, count(*) AS n,
      {r4_sql('sum(value)')} AS cost FROM events GROUP BY 1""",
)
def day_partitions(spark, sf):
    """Rows without a readable day stay in the table, in the default partition."""
    path = shared_dir(spark, "daily")
    day = F.when(F.col("event_id") % 50 == 0, "unknown").otherwise(F.date_format("event_time", "yyyy-MM-dd"))
    rows = t.timed_events(spark, sf).select(day.alias("usage_date"), F.col("value").alias("unblended_cost"))
    writers.append_partitioned(writers.with_day_partitions(rows), path, schemas.DAY_PARTITIONS)
    stored = readers.read_table(spark, path, "usage_date string, unblended_cost double", schemas.DAY_PARTITIONS)
    return stored.groupBy("day").agg(F.count("*").alias("n"), r4(F.sum("unblended_cost")).alias("cost"))


@query(
    "k3_dead_letters",
    """SELECT 'calls' AS processor, CASE k % 55 WHEN 0 THEN 'missing required field: requestId'
        WHEN 11 THEN 'missing required field: modelId' WHEN 44 THEN 'unreadable timestamp'
        ELSE 'not a JSON object of the call log' END AS error, count(*) AS n FROM calls WHERE k % 11 = 0 GROUP BY 2""",
)
def stored_dead_letters(spark, sf):
    path = shared_dir(spark, "dead-letters")
    parsed = records.parse_call_lines(t.call_lines(spark, sf))
    writers.append_dead_letters(records.rejected_lines(parsed, "calls", _FAILED_AT), path)
    stored = spark.read.schema("error string, processor string, year string, month string, day string").json(path)
    return stored.where("year = '2024'").groupBy("processor", "error").agg(F.count("*").alias("n"))


@query(
    "k4_parquet_table",
    f"""SELECT usage_date, count(*) AS n, {r4_sql('sum(unblended_cost)')} AS cost FROM lines GROUP BY 1""",
)
def parquet_table(spark, sf):
    path = shared_dir(spark, "costs")
    writers.write_parquet(newest_costs(spark, sf), path)
    stored = readers.read_table(spark, path, schemas.COST_LINES)
    return stored.groupBy("usage_date").agg(F.count("*").alias("n"), r4(F.sum("unblended_cost")).alias("cost"))


@query(
    "k5_discovered_names",
    """SELECT model_billing_name AS cur_billing_name, '' AS bedrock_model_id, 'auto' AS source,
      max(usage_date) AS last_seen_date FROM lines WHERE model_billing_name = model_id GROUP BY 1""",
)
def discovered_names(spark, sf):
    path = shared_dir(spark, "billing-map")
    writers.write_parquet(records.unmapped_names(newest_costs(spark, sf)), path)
    return readers.read_table(spark, path, schemas.MODEL_BILLING_MAP)


@query(
    "k6_replace_days",
    f"""WITH b AS (SELECT strftime(ts, '%Y-%m-%d') AS usage_date, user_id % 25 AS slot, sum(value) AS cost
          FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
        u AS (SELECT strftime(ts, '%Y-%m-%d') AS usage_date, user_id % 25 AS slot, user_id FROM events
          WHERE event_type != 'purchase' GROUP BY ALL)
      SELECT b.usage_date, CAST(sum(coalesce(n, 1)) AS BIGINT) AS n, {r4_sql('sum(cost)')} AS cost
      FROM b LEFT JOIN (SELECT usage_date, slot, count(*) AS n FROM u GROUP BY ALL) c
        ON c.usage_date = b.usage_date AND c.slot = b.slot GROUP BY 1""",
)
def replace_days(spark, sf):
    """Event costs reconciled and stored twice; the second run replaces the first."""
    rows = attribution.attribute(*event_buckets_and_usage(spark, sf))
    path = shared_dir(spark, "reconciled")
    for _ in range(2):
        writers.overwrite_partitions(writers.with_day_partitions(rows), path)
    stored = readers.read_table(spark, path, schemas.RECONCILED_COSTS, schemas.DAY_PARTITIONS)
    return stored.groupBy("usage_date").agg(F.count("*").alias("n"), r4(F.sum("attributed_cost")).alias("cost"))


@query(
    "k6_replace_periods",
    f"""SELECT billing_period, count(*) AS n, {r4_sql('sum(unblended_cost)')} AS cost FROM lines
      WHERE unit_price IS NOT NULL AND billing_period < '1998' GROUP BY 1""",
)
def replace_periods(spark, sf):
    """Cost lines by billing period; a corrected load without unpriced lines, and without the last months, replaces all at once."""
    path = shared_dir(spark, "periods")
    costs = newest_costs(spark, sf)
    versions.replace(costs, path, schemas.PERIOD_PARTITIONS)
    corrected = costs.where("unit_price IS NOT NULL AND billing_period < '1998'")
    versions.replace(corrected, path, schemas.PERIOD_PARTITIONS, costs.select("billing_period").distinct())
    versions.vacuum(spark, path, schemas.PERIOD_PARTITIONS)
    stored = versions.read(spark, path, schemas.COST_LINES, schemas.PERIOD_PARTITIONS)
    return stored.groupBy("billing_period").agg(F.count("*").alias("n"), r4(F.sum("unblended_cost")).alias("cost"))


@query(
    "j9_seen_keys",
    """SELECT user_id % 7 AS part, count(DISTINCT user_id || event_type) AS n FROM events GROUP BY 1""",
)
def seen_keys(spark, sf):
    """Events stored once per user and kind: in two loads that overlap, and once more as a whole."""
    base = shared_dir(spark, "seen")
    rows = t.timed_events(spark, sf).select("event_id", "user_id", "event_type")
    for load in (rows.where("event_id % 3 < 2"), rows.where("event_id % 3 > 0"), rows):
        ledger.store_once(load, f"{base}/ledger", ["user_id", "event_type"], _FAILED_AT, lambda new: writers.write_parquet(new, f"{base}/rows", "append"))
    stored = spark.read.schema(rows.schema).parquet(f"{base}/rows")
    return stored.groupBy((F.col("user_id") % 7).alias("part")).agg(F.count("*").alias("n"))


@query(
    "q8_drop_days",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events
      WHERE ts::DATE >= (SELECT max(ts)::DATE FROM events) - 12 GROUP BY 1""",
)
def drop_days(spark, sf):
    """Days more than twelve before the last one are dropped as folders."""
    path = shared_dir(spark, "retention")
    rows = t.timed_events(spark, sf).select("event_id", F.date_format("event_time", "yyyy-MM-dd").alias("usage_date"))
    writers.append_partitioned(writers.with_day_partitions(rows), path, schemas.DAY_PARTITIONS)
    cutoff = rows.agg(F.date_sub(F.max(F.to_date("usage_date")), 12).cast("string")).first()[0]
    files.drop_days_before(spark, path, cutoff, schemas.DAY_PARTITIONS)
    stored = readers.read_table(spark, path, "event_id bigint, usage_date string", schemas.DAY_PARTITIONS)
    return stored.groupBy(F.col("usage_date").alias("day")).agg(F.count("*").alias("n"))


@query(
    "a4_facts_kept_current",
    f"""SELECT usage_date[:7] AS month, friendlymodelname, count(*) AS calls, CAST(sum(inputtokens) AS BIGINT) AS inputtokens,
      {r4_sql('sum(totalcost)')} AS totalcost FROM priced GROUP BY 1, 2""",
)
def facts_kept_current(spark, sf):
    """Facts built from the first half of the months, then brought up to date when the rest of the calls has come."""
    base = shared_dir(spark, "facts-job")
    rows = writers.with_hour_partitions(t.calls(spark, sf).select("timestamp", *CALL_COLUMNS)).drop("day", "hour")
    costs = reconciled(spark, sf).withColumn("billing_period", F.substring("usage_date", 1, 7))
    versions.replace(costs, f"{base}/costs", schemas.PERIOD_PARTITIONS)
    release(spark)
    for part in (rows.where("year < '1995'"), rows.where("year >= '1995'")):
        writers.append_partitioned(part, f"{base}/calls", _MONTHS)
        release(spark)
        facts_job.update(spark, f"{base}/calls", f"{base}/costs", f"{base}/facts", _MONTHS, _MONTHS)
    found = facts_job.read(spark, f"{base}/facts", _MONTHS).groupBy(F.date_format("day", "yyyy-MM").alias("month"), "friendlymodelname")
    sums = found.agg(*[F.sum(c).alias(c) for c in ("calls", "inputtokens", "totalcost")])
    return rounded(sums, "totalcost")


def event_buckets_and_usage(spark, sf):
    """Purchases as billed cost, all other events as calls; a day and a model slot make a bucket."""
    events = t.timed_events(spark, sf).withColumn("model_id", t.event_model(F.col("user_id")))
    scope = {
        "usage_date": F.date_format("event_time", "yyyy-MM-dd"),
        "account_id": F.lit("1"),
        "region": F.lit("us-east-1"),
    }
    events = events.withColumns(scope)
    costs = events.where("event_type = 'purchase'").withColumns(
        {
            "usage_account_id": F.col("account_id"),
            "model_billing_name": F.col("model_id"),
            "token_type": F.lit("input-tokens"),
            "cross_region_type": F.lit("none"),
            "pricing_unit": F.lit("1K tokens"),
            "unblended_cost": F.col("value"),
        }
    )
    user = F.col("user_id").cast("string")
    usage = (
        events.where("event_type != 'purchase'")
        .groupBy(*scope, "model_id", user.alias("resolved_user_id"), user.alias("resolved_user_name"))
        .agg(F.sum("value").alias("user_tokens"))
        .withColumns({"measure": F.lit("inputtokens"), "usage_cross": F.lit("none")})
    )
    return attribution.cost_buckets(costs), usage


@query(
    "k7_csv_report",
    """SELECT usage_date[:7] AS month, CAST(count(*) AS VARCHAR) AS calls FROM calls GROUP BY 1""",
)
def csv_report(spark, sf):
    path = shared_dir(spark, "report")
    rows = t.calls(spark, sf).groupBy(F.substring("usage_date", 1, 7).alias("month"))
    writers.write_report_csv(rows.agg(F.count("*").alias("calls")), path)
    return spark.read.option("header", True).csv(path)


# --- streams --------------------------------------------------------------------------------------


def _run(spark, stream, purpose, schema=None):
    path = shared_dir(spark, purpose)
    jobs.run_into_parquet(stream, path, f"{path}-checkpoint")
    return spark.read.schema(schema or stream.schema).parquet(path)


@query("s7_incremental_files", _LINES_BY_DAY)
def incremental_files(spark, sf):
    """A second start of the stream on the same files adds nothing."""
    source = written_call_log(spark, sf)
    table = shared_dir(spark, "stream-calls")
    for _ in range(2):
        parsed = records.parse_call_lines(jobs.call_line_stream(spark, source))
        jobs.run_into_parquet(records.call_rows(parsed), table, f"{table}-checkpoint")
    rows = spark.read.schema(schemas.CALLS).parquet(table)
    return rows.groupBy(F.substring("timestamp", 1, 10).alias("usage_date")).agg(
        F.count("*").alias("n"), F.sum("inputtokens").alias("tokens")
    )


@query(
    "s7_audit_arrival",
    """SELECT o_orderkey % 6 AS kind, count(*) AS n FROM orders WHERE o_orderkey % 13 != 0 AND o_orderkey % 6 < 4 GROUP BY 1""",
)
def audit_arrival(spark, sf):
    """Audit files that arrive as a stream, each event twice in its file; a second stream over them adds nothing."""
    base, source = shared_dir(spark, "stream-audit"), written_audit(spark, sf)
    write = jobs.ingest_audit_batch(f"{base}/events", f"{base}/letters", _FAILED_AT, partitions=_MONTHS)
    for state in ("first", "second"):
        jobs.run_batches(jobs.audit_document_stream(spark, source), write, f"{base}/{state}")
    rows = readers.read_table(spark, f"{base}/events", schemas.AUDIT_EVENTS, _MONTHS)
    key = F.regexp_extract("eventid", r"(\d+)", 1).cast("bigint")
    return rows.groupBy((key % 6).alias("kind")).agg(F.count("*").alias("n"))


@query("s7_billing_arrival", _EXPORT_CHECK)
def billing_arrival(spark, sf):
    """Exports of two layouts that arrive as a stream, loaded once though they arrive twice."""
    base, source = shared_dir(spark, "stream-billing"), written_export(spark, sf, "csv")
    write = jobs.ingest_billing_batch(f"{base}/costs", f"{base}/names")
    for state in ("first", "second"):
        jobs.run_batches(jobs.billing_file_stream(spark, source), write, f"{base}/{state}")
    return _by_day(newest_delivery(readers.read_table(spark, f"{base}/costs", schemas.COST_LINES, schemas.PERIOD_PARTITIONS)))


@query(
    "st1_stream_ingest",
    """SELECT strftime(happened, '%Y') AS year, strftime(happened, '%m') AS month, strftime(happened, '%H') AS hour,
      inferencetier, count(DISTINCT requestid || happened) AS n FROM calls WHERE k % 11 != 0 GROUP BY ALL""",
)
def stream_ingest(spark, sf):
    """Arriving call logs to a partitioned table, each call once though the log arrives twice."""
    base = shared_dir(spark, "stream-ingest")
    write = jobs.ingest_batch(f"{base}/calls", f"{base}/letters", _FAILED_AT, partitions=_MONTHS)
    source = written_call_log(spark, sf)
    for state in ("first", "second"):
        jobs.run_batches(jobs.call_line_stream(spark, source), write, f"{base}/{state}")
    rows = readers.read_table(spark, f"{base}/calls", schemas.CALLS, _MONTHS)
    hour = F.substring("timestamp", 12, 2).alias("hour")
    return rows.groupBy("year", "month", hour, "inferencetier").agg(F.count("*").alias("n"))


def event_stream(spark, sf):
    # a glob, because a stream takes a single file only that way; a folder matches as well
    rows = jobs.parquet_stream(spark, f"{sf}/event[s].parquet", t.SCHEMAS["events"])
    return rows.withColumn("event_time", F.col("ts").cast("timestamp"))


@query(
    "st2_stream_dedup",
    """SELECT user_id, count(DISTINCT event_type || strftime(ts, '%d %H')) AS n FROM events GROUP BY 1""",
)
def stream_dedup(spark, sf):
    """One event per user, kind and hour."""
    stream = event_stream(spark, sf).withColumn("slot", F.date_format("event_time", "dd HH"))
    unique = jobs.dedup(stream, "event_time", ["user_id", "event_type", "slot"])
    rows = _run(spark, unique.select("user_id", "event_type", "slot"), "stream-dedup")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "st3_stream_metrics",
    f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp, event_type AS modelid,
      count(*) AS invocationcount, {r4_sql('avg(value)')} AS invocationlatencyavg,
      {r4_sql('quantile_disc(value, 0.99)')} AS invocationlatencyp99,
      count(*) FILTER (event_type = 'signup') AS throttledcount, count(*) FILTER (event_type = 'error') AS errorcount
      FROM events GROUP BY time_bucket(INTERVAL 5 MINUTE, ts), event_type""",
)
def stream_metrics(spark, sf):
    """All windows, those the watermark has not closed yet too."""
    kind = F.col("event_type")
    stream = jobs.window_metrics(
        event_stream(spark, sf), "event_time", "event_type", F.col("value"), kind == "signup", kind == "error"
    )
    path = shared_dir(spark, "stream-metrics")
    jobs.run_batches(stream, jobs.metrics_batch(path), f"{path}-checkpoint", mode="update")
    rows = jobs.read_window_metrics(spark, path).drop(*schemas.DAY_PARTITIONS)
    return rounded(rows, "invocationlatencyavg", "invocationlatencyp99")


@query(
    "st4_stream_correlation",
    """SELECT c.event_id AS call_id, a.event_id AS audit_id FROM events c JOIN events a ON a.user_id = c.user_id
      WHERE c.event_type = 'click' AND a.event_type = 'purchase'
        AND a.ts BETWEEN c.ts - INTERVAL 300 SECOND AND c.ts + INTERVAL 300 SECOND""",
)
def stream_correlation(spark, sf):
    def side(kind, time, ident):
        rows = event_stream(spark, sf).where(F.col("event_type") == kind)
        return rows.select("user_id", F.col("event_time").alias(time), F.col("event_id").alias(ident))

    pairs = jobs.correlate(
        side("click", "call_time", "call_id"), side("purchase", "audit_time", "audit_id"), "user_id", "call_time",
        "audit_time",
    )
    return _run(spark, pairs.select("call_id", "audit_id"), "stream-pairs")


@query("st5_stream_sessions", CHECKS["st5_session_identity"])
def stream_sessions(spark, sf):
    """Session identities found by a stream that gets the requests in four batches, not in the order of time."""
    base = shared_dir(spark, "stream-sessions")
    rows = session_requests(spark, sf)
    rows.repartition(4, "requestid").write.parquet(f"{base}/requests")
    stored = spark.read.schema(rows.schema).parquet(f"{base}/requests")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/requests")
    users = directory(spark, sf).drop("c_custkey")
    found = sessions.first_identities(stream, directory=users, mode="sso", memory="3650 days")
    jobs.run_batches(found, sessions.sessions_batch(f"{base}/sessions"), f"{base}/checkpoint", mode="update")
    resolved = sessions.resolve_with_sessions(stored, sessions.read_sessions(spark, f"{base}/sessions"), directory=users, mode="sso")
    who = F.coalesce("identity.user_id", F.lit("")).alias("user_id")
    return resolved.groupBy(who, F.col("identity.source").alias("source")).agg(F.count("*").alias("n"))


@query(
    "st6_stream_dead_letters",
    """SELECT 'calls' AS part, count(DISTINCT requestid || happened) AS n FROM calls WHERE k % 11 != 0
      UNION ALL SELECT 'dead letters', count(*) FROM calls WHERE k % 11 = 0""",
)
def stream_dead_letters(spark, sf):
    base = shared_dir(spark, "stream-batches")
    write = jobs.ingest_batch(f"{base}/calls", f"{base}/letters", _FAILED_AT, partitions=_MONTHS)
    jobs.run_batches(jobs.call_line_stream(spark, written_call_log(spark, sf)), write, f"{base}/checkpoint")
    calls = spark.read.schema(schemas.CALLS).parquet(f"{base}/calls")
    letters = spark.read.schema("error string").json(f"{base}/letters")
    count = F.count("*").alias("n")
    return calls.agg(count).select(F.lit("calls").alias("part"), "n").unionByName(
        letters.agg(count).select(F.lit("dead letters").alias("part"), "n")
    )


@query(
    "st6_stream_late_rows",
    """WITH usable AS (SELECT requestid, happened, k % 13 = 0 AS second FROM calls WHERE k % 11 != 0),
        mark AS (SELECT max(happened) - INTERVAL 400 DAY AS passed FROM usable WHERE NOT second)
      SELECT 'calls' AS part, count(DISTINCT requestid || happened) AS n FROM usable, mark WHERE NOT second OR happened > passed
      UNION ALL SELECT 'behind the watermark', count(*) FROM usable, mark WHERE second AND happened <= passed
      UNION ALL SELECT 'unusable', count(*) FROM calls WHERE k % 11 = 0""",
)
def stream_late_rows(spark, sf):
    """Two starts of one stream; every 13th order arrives with the second, much of it behind the watermark by then."""
    base = shared_dir(spark, "stream-late")
    lines = t.call_lines(spark, sf)
    write = jobs.ingest_batch(f"{base}/calls", f"{base}/letters", _FAILED_AT, "400 days", f"{base}/state", _MONTHS)
    for start, arriving in enumerate((lines.where("k % 13 != 0"), lines.where("k % 13 = 0"))):
        arriving.select("value").write.option("compression", "gzip").text(f"{base}/source/{start}")
        jobs.run_batches(jobs.call_line_stream(spark, f"{base}/source"), write, f"{base}/checkpoint")
    calls = spark.read.schema(schemas.CALLS).parquet(f"{base}/calls")
    letters = spark.read.schema("error string").json(f"{base}/letters")
    part = F.when(F.col("error") == ingest.LATE, F.col("error")).otherwise("unusable").alias("part")
    counts = letters.groupBy(part).agg(F.count("*").alias("n"))
    return calls.agg(F.count("*").alias("n")).select(F.lit("calls").alias("part"), "n").unionByName(counts)
