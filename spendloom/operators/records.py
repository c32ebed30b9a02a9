"""Raw records to table rows: call log lines, audit records, billing lines.

Each function is one narrow projection, so it runs inside the scan stage.  Rows that cannot
be used keep their original text and a reason, for the dead-letter table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom import schemas
from spendloom.fixed_values import MODEL_BY_BILLING_NAME, REGION_BY_CODE
from spendloom.functions import billing, calls
from spendloom.operators.filters import of_product
from spendloom.sources.readers import CORRUPT


def parse_call_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add `call` (parsed struct) and `error` (why it is unusable, NULL when fine).

    The parsed value passes through a one-element explode: a filter on `error` would else be
    moved below the projection and parse the text again for each field it looks at.
    """
    schema = f"{schemas.RAW_CALL}, {CORRUPT} string"
    parsed = F.from_json(F.col(value), schema, {"columnNameOfCorruptRecord": CORRUPT})
    is_broken = F.col("call").isNull() | F.col(f"call.{CORRUPT}").isNotNull()
    unreadable_time = F.when(
        F.try_to_timestamp(F.col("call.timestamp")).isNull(), "unreadable timestamp"
    )
    error = F.when(is_broken, "not a JSON object of the call log").otherwise(
        F.coalesce(calls.missing_field_error(F.col("call")), unreadable_time)
    )
    return lines.withColumn("call", F.explode(F.array(parsed))).withColumn("error", error)


def call_rows(parsed: DataFrame, default_region: str = "unknown", keep: tuple[str, ...] = ()) -> DataFrame:
    """`invocation_logs` rows from the usable parsed lines; costs start at 0 and `pending`."""
    return extract_calls(parsed.where(F.col("error").isNull()), default_region, keep)


def extract_calls(df: DataFrame, default_region: str = "unknown", keep: tuple[str, ...] = ()) -> DataFrame:
    """Project the `call` struct to the call table."""
    call = F.col("call")
    text = lambda c: F.coalesce(c, F.lit(""))
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))

    arn = text(call["identity"]["arn"])
    request_body = text(call["input"]["inputBodyJson"])
    response_body = text(call["output"]["outputBodyJson"])
    top_latency = call["output"]["latencyMs"]
    written = count(call["input"]["cacheWriteInputTokenCount"])
    read = count(call["input"]["cacheReadInputTokenCount"])
    region = F.coalesce(call["region"], F.lit(default_region))
    profile = calls.profile_resolution(call["modelId"], region)

    columns = {
        "requestid": call["requestId"],
        "timestamp": call["timestamp"],
        "accountid": text(call["accountId"]),
        "region": region,
        "modelid": call["modelId"],
        "resolvedmodelid": profile["resolvedmodelid"],
        "inputtokens": count(call["input"]["inputTokenCount"]),
        "outputtokens": count(call["output"]["outputTokenCount"]),
        "latencyms": calls.latency_ms(top_latency, response_body),
        "callerarn": arn,
        "resolveduserid": arn,
        "resolvedusername": calls.user_name_from_arn(arn),
        "resolveduseremail": F.lit(""),
        "agentid": call["agentId"],
        "agentalias": call["agentAlias"],
        "imagecount": call["output"]["imageCount"],
        "imagedimensions": call["output"]["imageDimensions"],
        "videodurationseconds": call["output"]["videoDurationSeconds"],
        "videoresolution": call["output"]["videoResolution"],
        "guardrailid": call["guardrailId"],
        "inputcost": F.lit(0.0),
        "outputcost": F.lit(0.0),
        "totalcost": F.lit(0.0),
        "coststatus": F.lit("pending"),
        "rawrequest": request_body,
        "rawresponse": response_body,
        "sourceregion": profile["sourceregion"],
        "executionregion": profile["executionregion"],
        "inferencetier": calls.inference_tier(request_body),
        "cachetype": calls.cache_type(written, read, request_body),
        "crossregiontype": profile["crossregiontype"],
        "cachewriteinputtokens": written,
        "cachereadinputtokens": read,
        "audiodurationseconds": calls.audio_seconds(call["modelId"], top_latency),
    }
    return _select(df, columns, keep)


def rejected_lines(parsed: DataFrame, processor: str, failed_at: str, value: str = "value") -> DataFrame:
    """Dead-letter rows of the unusable lines; `failed_at` is the job's own ISO time."""
    columns = {
        "requestId": F.coalesce(F.col("call.requestId"), F.lit("unknown")),
        "timestamp": F.coalesce(F.col("call.timestamp"), F.lit(failed_at)),
        "processorName": F.lit(processor),
        "error": F.col("error"),
        "failedAt": F.lit(failed_at),
        "originalContent": F.col(value),
        "sourceFile": F.col("source_file") if "source_file" in parsed.columns else F.lit(""),
    }
    return _select(parsed.where(F.col("error").isNotNull()), columns)


def explode_audit(documents: DataFrame) -> DataFrame:
    """One row per audit record, as struct `event`; documents without `Records` give none."""
    return documents.select(F.explode("Records").alias("event"), "source_file")


def rejected_documents(documents: DataFrame, processor: str, failed_at: str) -> DataFrame:
    """Dead-letter rows of audit documents without a `Records` array."""
    columns = {
        "requestId": F.col("source_file"),
        "timestamp": F.lit(failed_at),
        "processorName": F.lit(processor),
        "error": F.lit("audit document has no Records array"),
        "failedAt": F.lit(failed_at),
        "originalContent": F.col("value"),
        "sourceFile": F.col("source_file"),
    }
    return _select(documents.where(F.col("Records").isNull()), columns)


def late_events(events: DataFrame, processor: str, failed_at: str, error: str) -> DataFrame:
    """Dead-letter rows of audit events that came too late, each with its own text."""
    columns = {
        "requestId": F.coalesce("event.requestId", "event.eventId", F.lit("unknown")),
        "timestamp": F.coalesce("event.eventTime", F.lit(failed_at)),
        "processorName": F.lit(processor),
        "error": F.lit(error),
        "failedAt": F.lit(failed_at),
        "originalContent": F.to_json("event"),
        "sourceFile": F.col("source_file"),
    }
    return _select(events, columns)


def audit_rows(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`cloudtrail_events` rows; the session issuer stands in for a missing principal ARN."""
    event = F.col("event")
    identity = event["userIdentity"]
    columns = {
        "eventid": event["eventId"],
        "requestid": event["requestId"],
        "timestamp": event["eventTime"],
        "accountid": event["awsAccountId"],
        "region": event["awsRegion"],
        "eventname": event["eventName"],
        "principalarn": F.coalesce(identity["arn"], identity["sessionContext"]["sessionIssuer"]["arn"]),
        "sourceipaddress": event["sourceIPAddress"],
        "useragent": event["userAgent"],
        "modelid": event["requestParameters"]["modelId"],
        "resolveduserid": F.lit(""),
        "resolvedusername": F.lit(""),
        "resolveduseremail": F.lit(""),
    }
    return _select(events, {name: F.coalesce(c, F.lit("")) for name, c in columns.items()}, keep)


def cost_rows(
    export: DataFrame,
    region_codes: DataFrame | None = None,
    billing_names: DataFrame | None = None,
) -> DataFrame:
    """`cur_costs` rows: lines of the product whose usage type can be read."""
    text = {name: billing.header_column(export.columns, name).cast("string") for name in _HEADERS}
    rows = export.select(
        *[c.alias(f"_{name}") for name, c in text.items()],
        F.col("cur_file_key") if "cur_file_key" in export.columns else F.lit("").alias("cur_file_key"),
    )
    rows = of_product(rows, "_product_code")
    rows = rows.withColumns(billing.usage_type_parts(F.col("_usage_type")))
    rows = rows.where(F.col("token_type").isNotNull())
    rows = with_regions(rows, region_codes)
    rows = with_model_ids(rows, billing_names)
    columns = {
        "billing_period": billing.text_prefix_or_unknown(F.col("_billing_period"), 7),
        "usage_date": billing.text_prefix_or_unknown(F.col("_usage_date"), 10),
        "payer_account_id": F.col("_payer_account_id"),
        "usage_account_id": F.col("_usage_account_id"),
        "region": F.col("region"),
        "region_code": F.col("region_code"),
        "model_billing_name": F.col("model_billing_name"),
        "resolved_model_id": F.col("resolved_model_id"),
        "token_type": F.col("token_type"),
        "cross_region_type": F.col("cross_region_type"),
        "usage_type": F.col("_usage_type"),
        "pricing_unit": F.col("_pricing_unit"),
        "usage_amount": billing.number_or_zero(F.col("_usage_quantity")),
        "unblended_cost": billing.number_or_zero(F.col("_unblended_cost")),
        "unit_price": billing.unit_price(F.col("_item_description")),
        "unblended_rate": F.lit(None).cast("double"),
        "item_description": F.col("_item_description"),
        "cur_file_key": F.col("cur_file_key"),
    }
    return _select(rows, columns)


def with_regions(rows: DataFrame, region_codes: DataFrame | None = None) -> DataFrame:
    """Add `region` for `region_code`; an unknown code stands for itself.

    The built-in list has a few rows and is broadcast; a caller's own table is not hinted.
    """
    if region_codes is None:
        region_codes = F.broadcast(_pairs(rows, REGION_BY_CODE, "region_code", "_region"))
    joined = rows.join(region_codes, "region_code", "left")
    return joined.withColumn("region", F.coalesce("_region", "region_code")).drop("_region")


def with_model_ids(rows: DataFrame, billing_names: DataFrame | None = None) -> DataFrame:
    """Add `resolved_model_id` for `model_billing_name`, NULL when the name is unknown.

    `billing_names` may be a `model_billing_map` table; unconfirmed names have an empty id
    there and repeated names are folded, so the join never adds rows.
    """
    if billing_names is None:
        names = F.broadcast(
            _pairs(rows, MODEL_BY_BILLING_NAME, "model_billing_name", "resolved_model_id")
        )
    else:
        names = (
            billing_names.where(F.col("bedrock_model_id") != "")
            .groupBy(F.col("cur_billing_name").alias("model_billing_name"))
            .agg(F.max("bedrock_model_id").alias("resolved_model_id"))
        )
    return rows.join(names, "model_billing_name", "left")


def unmapped_names(costs: DataFrame) -> DataFrame:
    """`model_billing_map` rows for names without a model id, with the last day they were seen."""
    return (
        costs.where(F.col("resolved_model_id").isNull())
        .groupBy(F.col("model_billing_name").alias("cur_billing_name"))
        .agg(F.max("usage_date").alias("last_seen_date"))
        .select(
            "cur_billing_name",
            F.lit("").alias("bedrock_model_id"),
            F.lit("auto").alias("source"),
            "last_seen_date",
        )
    )


def names_missing_from(costs: DataFrame, billing_names: DataFrame) -> DataFrame:
    """Distinct billing names the map does not list."""
    seen = costs.select("model_billing_name").distinct()
    known = billing_names.select(F.col("cur_billing_name").alias("model_billing_name"))
    return seen.join(known, "model_billing_name", "left_anti")


def billing_map(df: DataFrame) -> DataFrame:
    """The built-in billing names as a `model_billing_map` table."""
    pairs = _pairs(df, MODEL_BY_BILLING_NAME, "cur_billing_name", "bedrock_model_id")
    return pairs.withColumns({"source": F.lit("static"), "last_seen_date": F.lit(None).cast("string")})


_HEADERS = (
    "product_code",
    "usage_type",
    "item_description",
    "billing_period",
    "usage_date",
    "payer_account_id",
    "usage_account_id",
    "pricing_unit",
    "usage_quantity",
    "unblended_cost",
)


def _select(df: DataFrame, columns: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns.items()], *keep)


def _pairs(df: DataFrame, values: dict[str, str], key: str, value: str) -> DataFrame:
    """A literal two-column table."""
    rows = ", ".join(f"('{k}', '{v}')" for k, v in values.items())
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t({key}, {value})")
