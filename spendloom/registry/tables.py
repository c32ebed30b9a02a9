"""The given star-schema tables presented as usage logs, billing exports and metrics.

The operators know nothing of these tables; this module only maps columns.  Calls come from
`lineitem`, billing lines from `orders`, metrics from `events`, identities from `supplier`
and `customer`.  All mappings are narrow projections, so the work grows with the tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.fixed_values import MODEL_BY_BILLING_NAME, PRODUCT_CODE
from spendloom.operators import metrics, records
from spendloom.session import prepare

# 25 model slots: the known names in order, then three names no map lists.
BILLING_NAMES = [*MODEL_BY_BILLING_NAME, "Custom22", "Custom23", "Custom24"]
MODEL_IDS = [MODEL_BY_BILLING_NAME.get(name, name) for name in BILLING_NAMES]
# One of the six region codes is unknown and stands for itself.
REGION_CODES = ["USE1", "USW2", "EUW1", "APN1", "EUC1", "ZZZ1"]
REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "ap-northeast-1", "eu-central-1", "ZZZ1"]
ACCOUNT_HEAD = "10000000000"
VIDEO_SLOT = BILLING_NAMES.index("NovaReel")
IMAGE_SLOT = BILLING_NAMES.index("NovaCanvas")


SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table that is too small to be read by all cores, dealt to them before columns are made of it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.split(F.lit("|".join(values)), r"\|"), (index + 1).cast("int"))


def slot_columns(slot: Column) -> dict[str, Column]:
    """Account, region and model of a model slot."""
    return {
        "account": F.concat(F.lit(ACCOUNT_HEAD), (slot % 4).cast("string")),
        "region": _pick(REGIONS, slot % 6),
        "model": _pick(MODEL_IDS, slot),
    }


def _arn(kind: Column, account: Column, user: Column) -> Column:
    def of(service: str, resource: str) -> Column:
        return F.concat(F.lit(f"arn:aws:{service}::"), account, F.lit(f":{resource}"), user)

    return (
        F.when(kind == 0, of("iam", "user/u"))
        .when(kind == 1, of("iam", "role/r"))
        .when(kind == 2, of("sts", "assumed-role/Team/s"))
        .when(kind == 3, of("sts", "federated-user/f"))
        .otherwise(F.concat(F.lit("svc-"), user))
    )


def call_structs(spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> DataFrame:
    """One `call` struct of the raw log schema per `lineitem` row."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.floor("l_extendedprice").alias("x"),
        F.col("l_shipdate").cast("timestamp").alias("day"),
    )
    line = spread(line) if spread_rows else line
    slot = F.col("p") % 25
    line = line.select("*", slot.alias("slot"), *[c.alias(name) for name, c in slot_columns(slot).items()])
    k, n, s, q, x, slot = (F.col(c) for c in "k n s q x slot".split())
    account, region, model = F.col("account"), F.col("region"), F.col("model")

    def profile(home: str, prefix: str) -> Column:
        return F.concat(
            F.lit(f"arn:aws:bedrock:{home}:"), account, F.lit(f":inference-profile/{prefix}"), model
        )

    variant = k % 8
    model_id = (
        F.when(variant < 3, model)
        .when(variant == 3, F.concat(F.lit("us."), model))
        .when(variant == 4, F.concat(F.lit("global."), model))
        .when(variant == 5, profile("us-east-1", "us."))
        .when(variant == 6, F.concat(F.lit("arn:aws:bedrock:"), region, F.lit("::foundation-model/"), model))
        .otherwise(profile("eu-west-1", "global."))
    )
    time = F.col("day") + F.make_dt_interval(secs=(k * 37 + n * 1009) % 86400)
    body = (
        F.when(k % 5 == 0, '{"service_tier":"priority"}')
        .when(k % 5 == 1, '{"service_tier": "flex", "cachePoint": {"ttl":"1h"}}')
        .when(k % 5 == 2, '{"service_tier":"reserved","cachePoint":{"ttl": "1h"}}')
        .when(k % 5 == 3, "not json")
    )
    # Texts used several times are columns of their own, so that they are built once per row.
    line = line.withColumns(
        {
            "model_id": model_id,
            "body": body,
            "arn": _arn(s % 5, account, s.cast("string")),
            "time": F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'.000Z'"),
        }
    )
    has_latency = n % 5 != 0
    call = F.struct(
        F.concat(F.lit("req-"), k, F.lit("-"), n).alias("requestId"),
        F.col("time").alias("timestamp"),
        account.alias("accountId"),
        region.alias("region"),
        F.col("model_id").alias("modelId"),
        F.struct(
            (q * 10).alias("inputTokenCount"),
            F.col("body").alias("inputBodyJson"),
            F.when(s % 10 == 0, q * 2).alias("cacheWriteInputTokenCount"),
            F.when(s % 7 == 0, x % 500).alias("cacheReadInputTokenCount"),
        ).alias("input"),
        F.struct(
            F.floor(x / 100).alias("outputTokenCount"),
            F.when(~has_latency, F.concat(F.lit('{"metrics":{"latencyMs":'), x % 3000, F.lit("}}"))).alias(
                "outputBodyJson"
            ),
            F.when(has_latency, x % 5000).alias("latencyMs"),
            F.when(slot == IMAGE_SLOT, (k % 4 + 1).cast("int")).alias("imageCount"),
            F.when(slot == IMAGE_SLOT, "1024x1024").alias("imageDimensions"),
            F.when(slot == VIDEO_SLOT, q * 0.5).alias("videoDurationSeconds"),
            F.when(slot == VIDEO_SLOT, "720p").alias("videoResolution"),
        ).alias("output"),
        F.struct("arn").alias("identity"),
        F.when(s % 20 == 3, F.concat(F.lit("agent-"), s)).alias("agentId"),
        F.when(s % 20 == 3, "live").alias("agentAlias"),
        F.when(k % 9 == 0, F.concat(F.lit("guard-"), k % 3)).alias("guardrailId"),
    )
    return line.select(call.alias("call"), F.col("k"), F.col("n"), F.col("p"), F.col("s"), F.col("q"), F.col("x"))


def calls(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """`invocation_logs` rows with their `usage_date`."""
    rows = records.extract_calls(call_structs(spark, sf_dir, spread))
    return rows.withColumn("usage_date", F.substring("timestamp", 1, 10))


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls as JSON text, some lines broken: every 11th order misses a field or is cut off."""
    rows = call_structs(spark, sf_dir)
    text, k = F.to_json("call"), F.col("k")
    value = (
        F.when(k % 55 == 0, F.regexp_replace(text, '"requestId":"[^"]*"', '"requestId":""'))
        .when(k % 55 == 11, F.regexp_replace(text, '"modelId":"[^"]*",', ""))
        .when(k % 55 == 22, F.concat(F.lit("["), text, F.lit("]")))
        .when(k % 55 == 33, F.expr("left(to_json(call), 40)"))
        .when(k % 55 == 44, F.regexp_replace(text, '"timestamp":"[^"]*"', '"timestamp":"yesterday"'))
        .otherwise(text)
    )
    return rows.select(value.alias("value"), "k", "n")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit `event` struct per `orders` row; request ids are those of first lines."""
    order = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderdate").cast("timestamp").alias("day"),
    )
    k, c = F.col("k"), F.col("c")
    account = F.concat(F.lit(ACCOUNT_HEAD), (c % 4).cast("string"))
    names = ["InvokeModel", "InvokeModelWithResponseStream", "Converse", "ConverseStream", "GetObject"]
    name = F.when(k % 6 < 5, _pick(names, k % 6))
    issuer = F.when(k % 4 != 1, F.concat(F.lit("arn:aws:iam::"), account, F.lit(":role/issuer"), c % 10))
    event = F.struct(
        F.concat(F.lit("ev-"), k).alias("eventId"),
        F.concat(F.lit("req-"), k, F.lit("-1")).alias("requestId"),
        F.date_format(
            F.col("day") + F.make_dt_interval(secs=(k * 37 + 1009) % 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        ).alias("eventTime"),
        account.alias("awsAccountId"),
        F.lit("us-east-1").alias("awsRegion"),
        name.alias("eventName"),
        F.struct(
            F.when(k % 4 == 0, _arn(c % 4, account, c.cast("string"))).alias("arn"),
            F.lit("AssumedRole").alias("type"),
            c.cast("string").alias("principalId"),
            F.struct(F.struct(issuer.alias("arn")).alias("sessionIssuer")).alias("sessionContext"),
        ).alias("userIdentity"),
        F.lit("10.0.0.1").alias("sourceIPAddress"),
        F.when(k % 3 == 0, "sdk").alias("userAgent"),
        F.struct(_pick(MODEL_IDS, c % 25).alias("modelId")).alias("requestParameters"),
    )
    return order.select(event.alias("event"), "k")


def billing_export(spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> DataFrame:
    """Export lines, all text, from `orders`.  Every line is delivered in the full export of its
    month; lines of the first half also came in an earlier, cumulative one."""
    order = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").cast("timestamp").alias("day"),
    )
    order = (spread(order) if spread_rows else order).withColumn("slot", F.col("c") % 25)
    k, slot, price = F.col("k"), F.col("slot"), F.col("price")
    token = (
        F.when(k % 6 < 2, "input-tokens")
        .when(k % 6 < 4, "output-tokens")
        .when(k % 6 == 4, "cache-read-input-token-count")
        .otherwise("cache-write-input-token-count")
    )
    step = F.floor(k / 6) % 4
    cross = F.when(step == 2, "-cross-region-global").when(step == 3, "-cross-region-geo").otherwise("")
    usage_type = F.concat(
        _pick(REGION_CODES, slot % 6), F.lit("-"), _pick(BILLING_NAMES, slot), F.lit("-"), token, cross
    )
    date = F.date_format("day", "yyyy-MM-dd")
    unit = F.when((slot == IMAGE_SLOT) & (k % 2 == 0), "Images").when(
        (slot == VIDEO_SLOT) & (k % 2 == 0), "Seconds"
    )
    deliveries = F.when(F.dayofmonth("day") <= 15, F.array(F.lit("1"), F.lit("2"))).otherwise(
        F.array(F.lit("2"))
    )
    return order.select(
        F.when(k % 20 == 0, "OtherService").otherwise(PRODUCT_CODE).alias("product_code"),
        F.when(k % 50 == 7, "DataTransfer-Out-Bytes").otherwise(usage_type).alias("usage_type"),
        F.when(k % 10 == 0, "flat fee")
        .otherwise(F.concat(F.lit("$0.00"), k % 9 + 1, F.lit(" per 1K tokens")))
        .alias("item_description"),
        F.date_format("day", "yyyy-MM").alias("billing_period"),
        F.concat(date, F.lit("T00:00:00Z")).alias("usage_start_date"),
        F.lit("999999999999").alias("payer_account_id"),
        F.concat(F.lit(ACCOUNT_HEAD), (slot % 4).cast("string")).alias("usage_account_id"),
        F.coalesce(unit, F.lit("1K tokens")).alias("pricing_unit"),
        F.when(k % 30 == 0, "n/a").otherwise((k % 1000).cast("string")).alias("usage_quantity"),
        F.when(k % 97 == 0, -price / 1000).otherwise(price / 1000).cast("string").alias("unblended_cost"),
        F.explode(deliveries).alias("delivery"),
        F.date_format("day", "yyyy-MM").alias("_month"),
    ).withColumn("cur_file_key", F.concat(F.lit("exports/"), "_month", F.lit("/run-"), "delivery", F.lit(".csv.gz")))


def cost_lines(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return records.cost_rows(billing_export(spark, sf_dir, spread))


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with a zoned `event_time`, as watermarks need it."""
    return table(spark, sf_dir, "events").withColumn("event_time", F.col("ts").cast("timestamp"))


def event_model(user: Column) -> Column:
    return _pick(MODEL_IDS, user % 25)


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`metrics` rows from `events`: model by user, latency = value in ms, errors and throttles by type."""
    events = timed_events(spark, sf_dir).withColumn("modelid", event_model(F.col("user_id")))
    kind = F.col("event_type")
    return metrics.call_metrics(
        events,
        "event_time",
        "modelid",
        latency=F.col("value"),
        is_throttled=kind == "signup",
        is_error=kind == "error",
        region=_pick(REGIONS, F.col("user_id") % 6),
    )
