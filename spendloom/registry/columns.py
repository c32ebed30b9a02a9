"""Registered queries for row-level columns and filters (P, F)."""

from datetime import date

from pyspark.sql import functions as F

from spendloom.functions import billing, common, identity
from spendloom.functions import calls as call_columns
from spendloom.operators import filters, records
from spendloom.operators.attribution import cost_buckets, usage_by_user
from spendloom.operators.snapshot import latest_snapshot
from spendloom.registry import tables as t
from spendloom.registry.core import query, r4, r4_sql, rounded
from spendloom.registry.views import MODELS

_TS = "strftime(happened, '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp"


@query(
    "p1_call_record",
    f"""SELECT requestid, {_TS}, accountid, region, modelid, resolvedmodelid, inputtokens, outputtokens,
      latencyms, callerarn, callerarn AS resolveduserid, resolvedusername, 'pending' AS coststatus,
      0.0::DOUBLE AS totalcost, sourceregion, executionregion, inferencetier, cachetype, crossregiontype,
      cachewriteinputtokens, cachereadinputtokens
      FROM calls WHERE k % 11 != 0""",
)
def call_record(spark, sf):
    parsed = records.parse_call_lines(t.call_lines(spark, sf))
    return records.call_rows(parsed).select(
        "requestid", "timestamp", "accountid", "region", "modelid", "resolvedmodelid", "inputtokens",
        "outputtokens", "latencyms", "callerarn", "resolveduserid", "resolvedusername", "coststatus",
        "totalcost", "sourceregion", "executionregion", "inferencetier", "cachetype", "crossregiontype",
        "cachewriteinputtokens", "cachereadinputtokens",
    )


@query(
    "p2_required_fields",
    """SELECT CASE k % 55 WHEN 0 THEN 'missing required field: requestId'
        WHEN 11 THEN 'missing required field: modelId' WHEN 44 THEN 'unreadable timestamp'
        ELSE 'not a JSON object of the call log' END AS error, count(*) AS n
      FROM calls WHERE k % 11 = 0 GROUP BY 1""",
)
def required_fields(spark, sf):
    parsed = records.parse_call_lines(t.call_lines(spark, sf))
    rejected = records.rejected_lines(parsed, "calls", "2024-01-01T00:00:00Z")
    return rejected.groupBy("error").agg(F.count("*").alias("n"))


@query(
    "p3_inference_profile",
    """SELECT modelid, region, resolvedmodelid, sourceregion, executionregion, crossregiontype, count(*) AS n
      FROM calls GROUP BY ALL""",
)
def inference_profile(spark, sf):
    rows = t.call_structs(spark, sf).select("call.modelId", "call.region")
    parts = call_columns.profile_resolution(F.col("modelId"), F.col("region"))
    names = ["modelid", "region", *parts]
    return rows.withColumns(parts).groupBy(*names).agg(F.count("*").alias("n"))


@query("p4_inference_tier", "SELECT inferencetier, count(*) AS n FROM calls GROUP BY 1")
def inference_tier(spark, sf):
    body = F.col("call.input.inputBodyJson")
    rows = t.call_structs(spark, sf).select(call_columns.inference_tier(body).alias("inferencetier"))
    return rows.groupBy("inferencetier").agg(F.count("*").alias("n"))


@query(
    "p5_cache_ttl",
    "SELECT CASE WHEN k % 5 IN (1, 2) THEN '1h' ELSE '5m' END AS ttl, count(*) AS n FROM calls GROUP BY 1",
)
def cache_ttl(spark, sf):
    body = F.coalesce("call.input.inputBodyJson", F.lit(""))
    rows = t.call_structs(spark, sf).select(call_columns.cache_ttl(body).alias("ttl"))
    return rows.groupBy("ttl").agg(F.count("*").alias("n"))


@query(
    "p6_cache_type",
    """SELECT cachetype, count(*) AS n, CAST(sum(cachewriteinputtokens) AS BIGINT) AS written,
      CAST(sum(cachereadinputtokens) AS BIGINT) AS read FROM calls GROUP BY 1""",
)
def cache_type(spark, sf):
    return t.calls(spark, sf).groupBy("cachetype").agg(
        F.count("*").alias("n"),
        F.sum("cachewriteinputtokens").alias("written"),
        F.sum("cachereadinputtokens").alias("read"),
    )


@query("p7_user_name", "SELECT callerarn, resolvedusername, count(*) AS n FROM calls GROUP BY ALL")
def user_name(spark, sf):
    arn = F.col("call.identity.arn")
    rows = t.call_structs(spark, sf).select(
        arn.alias("callerarn"), call_columns.user_name_from_arn(arn).alias("resolvedusername")
    )
    return rows.groupBy("callerarn", "resolvedusername").agg(F.count("*").alias("n"))


@query(
    "p8_latency",
    """SELECT n % 5 = 0 AS from_body, count(*) AS n, CAST(sum(latencyms) AS BIGINT) AS total
      FROM calls GROUP BY 1""",
)
def latency(spark, sf):
    out = F.col("call.output")
    rows = t.call_structs(spark, sf).select(
        (F.col("n") % 5 == 0).alias("from_body"),
        call_columns.latency_ms(out["latencyMs"], out["outputBodyJson"]).alias("latencyms"),
    )
    return rows.groupBy("from_body").agg(F.count("*").alias("n"), F.sum("latencyms").alias("total"))


@query(
    "p9_raw_bodies",
    """SELECT count(*) AS n,
      CAST(sum(length(CASE k % 5 WHEN 0 THEN '{"service_tier":"priority"}'
        WHEN 1 THEN '{"service_tier": "flex", "cachePoint": {"ttl":"1h"}}'
        WHEN 2 THEN '{"service_tier":"reserved","cachePoint":{"ttl": "1h"}}'
        WHEN 3 THEN 'not json' ELSE '' END)) AS BIGINT)
        AS request_chars,
      CAST(sum(CASE WHEN n % 5 = 0 THEN length('{"metrics":{"latencyMs":' || (x % 3000) || '}}') ELSE 0 END)
        AS BIGINT) AS response_chars FROM calls""",
)
def raw_bodies(spark, sf):
    return t.calls(spark, sf).agg(
        F.count("*").alias("n"),
        F.sum(F.length("rawrequest")).alias("request_chars"),
        F.sum(F.length("rawresponse")).alias("response_chars"),
    )


@query(
    "p10_optional_fields",
    """SELECT agentid, guardrailid, CAST(imagecount AS BIGINT) AS imagecount, count(*) AS n,
      coalesce(sum(videodurationseconds), 0.0) AS video_seconds FROM calls GROUP BY 1, 2, 3""",
)
def optional_fields(spark, sf):
    video = F.coalesce(F.sum("videodurationseconds"), F.lit(0.0)).alias("video_seconds")
    image = F.col("imagecount").cast("bigint").alias("imagecount")
    rows = t.calls(spark, sf).groupBy("agentid", "guardrailid", image)
    return rows.agg(F.count("*").alias("n"), video)


@query(
    "p11_audio_seconds",
    f"""SELECT count(*) AS n, count(sec) AS audio_calls, {r4_sql('sum(sec)')} AS seconds
      FROM (SELECT CASE WHEN k % 4 IN (1, 2, 3) AND n % 5 != 0 AND x % 5000 > 0 THEN x % 5000 / 1000.0 END AS sec
            FROM calls)""",
)
def audio_seconds(spark, sf):
    tail = F.element_at(F.array(*[F.lit(v) for v in ("", "-Sonic", "-speech", "-AUDIO")]), (F.col("k") % 4 + 1).cast("int"))
    model = F.concat("call.modelId", tail)
    rows = t.call_structs(spark, sf).select(
        call_columns.audio_seconds(model, F.col("call.output.latencyMs")).alias("sec")
    )
    return rows.agg(F.count("*").alias("n"), F.count("sec").alias("audio_calls"), r4(F.sum("sec")).alias("seconds"))


@query(
    "p12_audit_record",
    f"""SELECT 'ev-' || o_orderkey AS eventid, 'req-' || o_orderkey || '-1' AS requestid,
      strftime(o_orderdate + INTERVAL 1 SECOND * ((o_orderkey * 37 + 1009) % 86400), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
      '{t.ACCOUNT_HEAD}' || (o_custkey % 4) AS accountid,
      ['InvokeModel', 'InvokeModelWithResponseStream', 'Converse', 'ConverseStream'][o_orderkey % 6 + 1] AS eventname,
      CASE o_orderkey % 4 WHEN 0 THEN
          CASE o_custkey % 4 WHEN 0 THEN 'arn:aws:iam::{t.ACCOUNT_HEAD}0:user/u' || o_custkey
            WHEN 1 THEN 'arn:aws:iam::{t.ACCOUNT_HEAD}1:role/r' || o_custkey
            WHEN 2 THEN 'arn:aws:sts::{t.ACCOUNT_HEAD}2:assumed-role/Team/s' || o_custkey
            ELSE 'arn:aws:sts::{t.ACCOUNT_HEAD}3:federated-user/f' || o_custkey END
        WHEN 1 THEN ''
        ELSE 'arn:aws:iam::{t.ACCOUNT_HEAD}' || (o_custkey % 4) || ':role/issuer' || (o_custkey % 10) END AS principalarn,
      CASE WHEN o_orderkey % 3 = 0 THEN 'sdk' ELSE '' END AS useragent,
      {MODELS}[o_custkey % 25 + 1] AS modelid
      FROM orders WHERE o_orderkey % 6 < 4""",
)
def audit_record(spark, sf):
    events = filters.model_call_events(t.audit_events(spark, sf), "event.eventName")
    return records.audit_rows(events).select(
        "eventid", "requestid", "timestamp", "accountid", "eventname", "principalarn", "useragent", "modelid"
    )


@query(
    "p13_usage_type",
    """SELECT CASE WHEN k % 50 != 7 THEN region_code END AS region_code,
      CASE WHEN k % 50 != 7 THEN model_billing_name END AS model_billing_name,
      CASE WHEN k % 50 != 7 THEN token_type END AS token_type,
      CASE WHEN k % 50 != 7 THEN cross_region_type END AS cross_region_type, count(*) AS n
      FROM bill0 GROUP BY 1, 2, 3, 4""",
)
def usage_type(spark, sf):
    rows = latest_snapshot(t.billing_export(spark, sf))
    parts = billing.usage_type_parts(F.col("usage_type"))
    return rows.withColumns(parts).groupBy(*parts).agg(F.count("*").alias("n"))


@query("p14_region_of_code", "SELECT region_code, region, count(*) AS n FROM lines GROUP BY ALL")
def region_of_code(spark, sf):
    costs = latest_snapshot(t.cost_lines(spark, sf))
    return costs.groupBy("region_code", "region").agg(F.count("*").alias("n"))


@query(
    "p15_model_of_name",
    """SELECT model_billing_name, CASE WHEN model_id != model_billing_name THEN model_id END AS resolved_model_id,
      count(*) AS n FROM lines GROUP BY ALL""",
)
def model_of_name(spark, sf):
    costs = latest_snapshot(t.cost_lines(spark, sf))
    return costs.groupBy("model_billing_name", "resolved_model_id").agg(F.count("*").alias("n"))


@query(
    "p16_unit_price",
    "SELECT unit_price, count(*) AS n FROM bill0 GROUP BY 1",
)
def unit_price(spark, sf):
    rows = latest_snapshot(t.billing_export(spark, sf))
    price = billing.unit_price(F.col("item_description")).alias("unit_price")
    return rows.groupBy(price).agg(F.count("*").alias("n"))


@query(
    "p17_cost_record",
    f"""SELECT billing_period, usage_date, account_id AS usage_account_id, region, region_code,
      model_billing_name, token_type, cross_region_type, pricing_unit, usage_amount, unit_price,
      {r4_sql('unblended_cost')} AS unblended_cost,
      'exports/' || billing_period || '/run-' || d || '.csv.gz' AS cur_file_key
      FROM lines, (VALUES (1), (2)) AS v(d) WHERE d = 2 OR day(ordered) <= 15""",
)
def cost_record(spark, sf):
    return rounded(t.cost_lines(spark, sf), "unblended_cost").select(
        "billing_period", "usage_date", "usage_account_id", "region", "region_code", "model_billing_name",
        "token_type", "cross_region_type", "pricing_unit", "usage_amount", "unit_price", "unblended_cost",
        "cur_file_key",
    )


@query(
    "p18_table_columns",
    f"""SELECT usage_date, sum(usage_amount) AS usage_amount, {r4_sql('sum(unblended_cost)')} AS unblended_cost
      FROM lines GROUP BY 1""",
)
def table_columns(spark, sf):
    """Table names of the billing columns: usage_quantity is usage_amount, the file is cur_file_key."""
    costs = latest_snapshot(t.cost_lines(spark, sf))
    sums = costs.groupBy("usage_date").agg(
        F.sum("usage_amount").alias("usage_amount"), F.sum("unblended_cost").alias("unblended_cost")
    )
    return rounded(sums, "unblended_cost")


@query(
    "p19_total_tokens",
    """SELECT modelid, CAST(sum(inputtokens + outputtokens) AS BIGINT) AS totaltokens FROM calls GROUP BY 1""",
)
def total_tokens(spark, sf):
    rows = t.calls(spark, sf).withColumn("totaltokens", F.col("inputtokens") + F.col("outputtokens"))
    return rows.groupBy("modelid").agg(F.sum("totaltokens").alias("totaltokens"))


@query(
    "p20_model_name",
    """SELECT CASE v WHEN 5 THEN 'us.' || mdl WHEN 7 THEN 'global.' || mdl WHEN 6 THEN mdl ELSE modelid END
      AS modelname, count(*) AS n FROM calls GROUP BY 1""",
)
def model_name(spark, sf):
    rows = t.calls(spark, sf).select(common.model_name(F.col("modelid")).alias("modelname"))
    return rows.groupBy("modelname").agg(F.count("*").alias("n"))


@query("p21_friendly_model_name", "SELECT friendlymodelname, count(*) AS n FROM calls GROUP BY 1")
def friendly_model_name(spark, sf):
    rows = t.calls(spark, sf).select(common.friendly_model_name(F.col("modelid")).alias("friendlymodelname"))
    return rows.groupBy("friendlymodelname").agg(F.count("*").alias("n"))


@query(
    "p22_iso_time",
    """SELECT CAST(hour(happened) AS INTEGER) AS hour, count(*) AS n,
      CAST(sum(epoch(happened)) AS BIGINT) AS epoch_sum FROM calls GROUP BY 1""",
)
def iso_time(spark, sf):
    rows = filters.with_event_time(t.calls(spark, sf))
    return rows.groupBy(F.hour("event_time").alias("hour")).agg(
        F.count("*").alias("n"), F.sum(F.unix_timestamp("event_time")).alias("epoch_sum")
    )


@query(
    "p23_display_user",
    """SELECT coalesce(nullif(CASE WHEN s % 3 = 0 THEN '' ELSE resolvedusername END, ''), CASE WHEN s % 9 != 0
      THEN callerarn END, accountid) AS shown, count(*) AS n FROM calls GROUP BY 1""",
)
def display_user(spark, sf):
    user = F.regexp_extract("resolvedusername", r"(\d+)$", 1).cast("int")
    rows = t.calls(spark, sf).select(
        common.display_user(
            F.when(user % 3 == 0, "").otherwise(F.col("resolvedusername")),
            F.when(user % 9 != 0, F.col("resolveduserid")),
            F.col("accountid"),
        ).alias("shown")
    )
    return rows.groupBy("shown").agg(F.count("*").alias("n"))


@query(
    "p24_billing_cross_region",
    """SELECT usage_cross, count(*) AS n, count(*) FILTER (usage_cross = 'none' AND s % 2 = 0) AS moved
      FROM (SELECT s, CASE WHEN usage_cross = 'none' AND s % 2 = 0 AND s % 4 = 0 THEN 'cross-region-global'
            ELSE usage_cross END AS usage_cross FROM calls) GROUP BY 1""",
)
def billing_cross_region(spark, sf):
    """Every fourth user's calls come from another region; an unknown or equal one changes nothing."""
    user = F.regexp_extract("resolvedusername", r"(\d+)$", 1).cast("int")
    source = (
        F.when(user % 4 == 0, F.lit("eu-south-9")).when(user % 2 == 0, F.upper("executionregion")).otherwise("")
    )
    rows = t.calls(spark, sf).select(
        call_columns.billing_cross_region(F.col("modelid"), source, F.col("executionregion")).alias("usage_cross"),
        user.alias("s"),
    )
    moved = F.count_if((F.col("usage_cross") == "none") & (F.col("s") % 2 == 0)).alias("moved")
    return rows.groupBy("usage_cross").agg(F.count("*").alias("n"), moved)


@query("p25_plain_model_id", "SELECT cost_model, count(*) AS n FROM calls GROUP BY 1")
def plain_model_id(spark, sf):
    model = call_columns.strip_cross_region_prefix(F.col("resolvedmodelid")).alias("cost_model")
    return t.calls(spark, sf).groupBy(model).agg(F.count("*").alias("n"))


@query(
    "p26_principal_parts",
    """SELECT callerarn, CASE s % 5 WHEN 0 THEN 'u' || s WHEN 3 THEN 'f' || s END AS iam_user_name,
      CASE s % 5 WHEN 1 THEN 'r' || s WHEN 2 THEN 'Team' END AS iam_role_name,
      CASE s % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'role' WHEN 2 THEN 'assumed-role' WHEN 3 THEN 'federated'
        ELSE 'unknown' END AS principal_type, count(*) AS n FROM calls GROUP BY ALL""",
)
def principal_parts(spark, sf):
    parts = identity.principal_parts(F.col("callerarn"))
    rows = t.calls(spark, sf).withColumns(parts)
    return rows.groupBy("callerarn", *parts).agg(F.count("*").alias("n"))


@query(
    "p27_session_name",
    """SELECT callerarn, CASE s % 5 WHEN 0 THEN 'u' || s WHEN 1 THEN 'r' || s WHEN 2 THEN 's' || s
      WHEN 3 THEN 'f' || s ELSE 'svc-' || s END AS session_name, count(*) AS n FROM calls GROUP BY ALL""",
)
def session_name(spark, sf):
    name = identity.session_name(F.col("callerarn")).alias("session_name")
    return t.calls(spark, sf).groupBy("callerarn", name).agg(F.count("*").alias("n"))


@query(
    "p28_directory_names",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Given' || c_nationkey || ' ' || c_mktsegment
        WHEN 2 THEN c_mktsegment ELSE '' END AS named,
      CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Given' || c_nationkey || ' ' || c_mktsegment
        WHEN 2 THEN c_mktsegment ELSE 'login' || c_custkey END AS numbered,
      CASE c_custkey % 3 WHEN 0 THEN 'main' || c_custkey || '@example.com'
        WHEN 1 THEN 'old' || c_custkey || '@example.com' ELSE '' END AS email FROM customer""",
)
def directory_names(spark, sf):
    user = F.struct(*[F.col(c) for c in ("UserId", "UserName", "DisplayName", "Name", "Emails")])
    rows = directory(spark, sf).withColumn("u", user)
    return rows.select(
        "c_custkey",
        identity.directory_display_name(F.col("u"), found_by_id=False).alias("named"),
        identity.directory_display_name(F.col("u"), found_by_id=True).alias("numbered"),
        identity.directory_email(F.col("u")).alias("email"),
    )


def directory(spark, sf):
    """Directory users from `customer`, with their key."""
    key = F.col("c_custkey")
    address = F.concat(key.cast("string"), F.lit("@example.com"))
    old = F.struct(F.concat(F.lit("old"), address).alias("Value"), F.lit(False).alias("Primary"))
    main = F.struct(F.concat(F.lit("main"), address).alias("Value"), F.lit(True).alias("Primary"))
    return t.table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("id-"), key).alias("UserId"),
        F.concat(F.lit("login"), key).alias("UserName"),
        F.when(key % 4 == 0, F.col("c_name")).alias("DisplayName"),
        F.struct(
            F.when(key % 4 == 1, F.concat(F.lit("Given"), "c_nationkey")).alias("GivenName"),
            F.when((key % 4).isin(1, 2), F.col("c_mktsegment")).alias("FamilyName"),
        ).alias("Name"),
        F.when(key % 3 == 0, F.array(old, main)).when(key % 3 == 1, F.array(old)).alias("Emails"),
    )


@query(
    "p29_round_ten",
    f"""SELECT l_returnflag, {r4_sql('sum(round(l_quantity / l_extendedprice, 10)) * 1000')} AS total
      FROM lineitem GROUP BY 1""",
)
def round_ten(spark, sf):
    line = t.table(spark, sf, "lineitem")
    share = common.round10(F.col("l_quantity") / F.col("l_extendedprice"))
    return line.groupBy("l_returnflag").agg(r4(F.sum(share) * 1000).alias("total"))


@query("p30_measure_of_line", "SELECT pricing_unit, token_type, measure, count(*) AS n FROM buckets GROUP BY ALL")
def measure_of_line(spark, sf):
    costs = latest_snapshot(t.cost_lines(spark, sf))
    measure = billing.measure_for(F.col("pricing_unit"), F.col("token_type")).alias("measure")
    return cost_buckets(costs).groupBy("pricing_unit", "token_type", measure).agg(F.count("*").alias("n"))


@query("p31_usage_date", "SELECT usage_date, count(*) AS n FROM calls GROUP BY 1")
def usage_date(spark, sf):
    parts = common.partition_columns(F.col("timestamp"))
    day = common.usage_date(parts["year"], parts["month"], parts["day"]).alias("usage_date")
    return t.calls(spark, sf).groupBy(day).agg(F.count("*").alias("n"))


@query(
    "p32_decode_key",
    "SELECT 'logs/' || p_name || '/' || p_brand || '.gz' AS key, count(*) AS n FROM part GROUP BY 1",
)
def decode_key(spark, sf):
    encoded = F.concat(F.lit("logs/"), F.url_encode(F.concat_ws("/", "p_name", "p_brand")), F.lit(".gz"))
    part = t.table(spark, sf, "part").select(common.decode_key(encoded).alias("key"))
    return part.groupBy("key").agg(F.count("*").alias("n"))


# --- filters ------------------------------------------------------------------------------


@query("f1_product_lines", "SELECT billing_period, count(*) AS n FROM bill0 WHERE k % 20 != 0 GROUP BY 1")
def product_lines(spark, sf):
    rows = filters.of_product(latest_snapshot(t.billing_export(spark, sf)))
    return rows.groupBy("billing_period").agg(F.count("*").alias("n"))


@query(
    "f2_model_call_events",
    """SELECT ['InvokeModel', 'InvokeModelWithResponseStream', 'Converse', 'ConverseStream'][o_orderkey % 6 + 1]
      AS name, count(*) AS n FROM orders WHERE o_orderkey % 6 < 4 GROUP BY 1""",
)
def model_call_events(spark, sf):
    rows = filters.model_call_events(t.audit_events(spark, sf), "event.eventName")
    return rows.groupBy(F.col("event.eventName").alias("name")).agg(F.count("*").alias("n"))


@query("f3_readable_usage_types", "SELECT usage_date, count(*) AS n FROM lines GROUP BY 1")
def readable_usage_types(spark, sf):
    costs = latest_snapshot(t.cost_lines(spark, sf))
    return costs.groupBy("usage_date").agg(F.count("*").alias("n"))


@query(
    "f4_positive_measures",
    """SELECT measure, count(*) AS n, sum(tokens) AS tokens FROM usage GROUP BY 1""",
)
def positive_measures(spark, sf):
    usage = usage_by_user(t.calls(spark, sf))
    return usage.groupBy("measure").agg(F.count("*").alias("n"), F.sum("user_tokens").alias("tokens"))


@query(
    "f5_days_with_cost",
    """SELECT c.usage_date, count(*) AS n FROM calls c
      WHERE c.usage_date IN (SELECT usage_date FROM lines WHERE model_billing_name = 'NovaPro') GROUP BY 1""",
)
def days_with_cost(spark, sf):
    costs = t.cost_lines(spark, sf).where(F.col("model_billing_name") == "NovaPro")
    calls = filters.restrict_to(t.calls(spark, sf), costs, ["usage_date"])
    return calls.groupBy("usage_date").agg(F.count("*").alias("n"))


@query(
    "f6_open_months",
    f"""SELECT billing_period, {r4_sql('sum(unblended_cost)')} AS cost FROM lines
      WHERE billing_period IN ('1999-12', '2000-01') GROUP BY 1""",
)
def open_months(spark, sf):
    costs = latest_snapshot(t.cost_lines(spark, sf))
    rows = filters.in_billing_months(costs, date(2000, 1, 20))
    return rows.groupBy("billing_period").agg(r4(F.sum("unblended_cost")).alias("cost"))


@query(
    "f7_nonzero_buckets",
    f"""SELECT cost < 0 AS is_credit, count(*) AS n, {r4_sql('sum(cost)')} AS cost FROM buckets GROUP BY 1""",
)
def nonzero_buckets(spark, sf):
    costs = latest_snapshot(t.cost_lines(spark, sf))
    credit = (F.col("bucket_unblended_cost") < 0).alias("is_credit")
    return cost_buckets(costs).groupBy(credit).agg(
        F.count("*").alias("n"), r4(F.sum("bucket_unblended_cost")).alias("cost")
    )


@query(
    "f8_active_metrics",
    f"""SELECT user_id % 25 AS slot, count(*) AS collected, count(*) FILTER (event_type != 'view') AS reported
      FROM events WHERE event_type != 'view' OR value != 0 GROUP BY 1""",
)
def active_metrics(spark, sf):
    """One metric row per event; `view` rows carry a latency only, which the reports do not count."""
    kind = F.col("event_type")
    rows = t.timed_events(spark, sf).select(
        (F.col("user_id") % 25).alias("slot"),
        F.when(kind.isin("view", "error", "signup"), 0).otherwise(1).alias("invocationcount"),
        F.col("value").alias("invocationlatencyavg"),
        F.when(kind == "signup", 1).otherwise(0).alias("throttledcount"),
        F.when(kind == "error", 1).otherwise(0).alias("errorcount"),
    )
    collected = filters.active_in_collector(rows).groupBy("slot").agg(F.count("*").alias("collected"))
    reported = filters.active_in_dataset(rows).groupBy("slot").agg(F.count("*").alias("reported"))
    return collected.join(reported, "slot")


@query(
    "f9_day_range",
    """SELECT usage_date, count(*) AS n FROM calls
      WHERE usage_date >= '1998-03-01' AND usage_date <= '1998-05-31' GROUP BY 1""",
)
def day_range(spark, sf):
    day = F.to_date("usage_date")
    rows = filters.between_days(t.calls(spark, sf), day, date(1998, 3, 1), date(1998, 5, 31))
    return rows.groupBy("usage_date").agg(F.count("*").alias("n"))


@query(
    "f10_minute_range",
    """SELECT event_type, count(*) AS n FROM events
      WHERE date_trunc('minute', ts) BETWEEN TIMESTAMP '2024-01-05 06:10:00' AND TIMESTAMP '2024-01-09 18:45:00'
      GROUP BY 1""",
)
def minute_range(spark, sf):
    rows = filters.between_minutes(
        t.timed_events(spark, sf), F.col("event_time"), "2024-01-05 06:10:30", "2024-01-09 18:45:10"
    )
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "f11_model_list",
    "SELECT modelid, count(*) AS n FROM calls WHERE modelid IN ('amazon.nova-pro-v1:0', 'Custom23') GROUP BY 1",
)
def model_list(spark, sf):
    rows = filters.of_models(t.calls(spark, sf), ["amazon.nova-pro-v1:0", "Custom23"])
    return rows.groupBy("modelid").agg(F.count("*").alias("n"))


@query(
    "f12_clicked_model",
    """SELECT usage_date, CAST(sum(inputtokens) AS BIGINT) AS tokens FROM calls
      WHERE friendlymodelname = 'amazon nova pro v1:0' GROUP BY 1""",
)
def clicked_model(spark, sf):
    """A model picked in one report narrows the others through the same filter."""
    rows = t.calls(spark, sf).withColumn("friendlymodelname", common.friendly_model_name(F.col("modelid")))
    rows = filters.of_models(rows, ["amazon nova pro v1:0"], "friendlymodelname")
    return rows.groupBy("usage_date").agg(F.sum("inputtokens").alias("tokens"))
