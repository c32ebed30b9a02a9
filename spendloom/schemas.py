"""One schema per table: the union of what files and catalog declare.

Call, audit and metric tables use the catalog's lower-case names; the billing
tables use snake case.  Times stay text as in the inputs; operators derive typed
columns when they need them.  Specs are DDL text, which readers and `from_json` take as is.
"""

from pyspark.sql import types as T


def struct_of(spec: str) -> T.StructType:
    """Parse one of the table specs below (needs a running session)."""
    return T.StructType.fromDDL(spec)


RAW_CALL = """
    requestId string, timestamp string, accountId string, region string, modelId string,
    input struct<inputTokenCount: bigint, inputBodyJson: string,
                 cacheWriteInputTokenCount: bigint, cacheReadInputTokenCount: bigint>,
    output struct<outputTokenCount: bigint, outputBodyJson: string, latencyMs: bigint,
                  imageCount: int, imageDimensions: string,
                  videoDurationSeconds: double, videoResolution: string>,
    identity struct<arn: string>,
    agentId string, agentAlias string, guardrailId string
    """

RAW_AUDIT_RECORD = """
    eventId string, requestId string, eventTime string, awsAccountId string, awsRegion string,
    eventName string,
    userIdentity struct<arn: string, type: string, principalId: string,
                        sessionContext: struct<sessionIssuer: struct<arn: string>>>,
    sourceIPAddress string, userAgent string,
    requestParameters struct<modelId: string>
    """

CALLS = """
    requestid string, timestamp string, accountid string, region string, modelid string,
    resolvedmodelid string, inputtokens bigint, outputtokens bigint, latencyms bigint,
    callerarn string, resolveduserid string, resolvedusername string, resolveduseremail string,
    agentid string, agentalias string, imagecount int, imagedimensions string,
    videodurationseconds double, videoresolution string, guardrailid string,
    inputcost double, outputcost double, totalcost double, coststatus string,
    rawrequest string, rawresponse string, sourceregion string, executionregion string,
    inferencetier string, cachetype string, crossregiontype string,
    cachewriteinputtokens bigint, cachereadinputtokens bigint, audiodurationseconds double
    """

AUDIT_EVENTS = """
    eventid string, requestid string, timestamp string, accountid string, region string,
    eventname string, principalarn string, sourceipaddress string, useragent string,
    modelid string, resolveduserid string, resolvedusername string, resolveduseremail string
    """

METRICS = """
    timestamp string, region string, modelid string, invocationcount bigint,
    invocationlatencyavg double, invocationlatencyp99 double,
    throttledcount bigint, errorcount bigint
    """

COST_LINES = """
    billing_period string, usage_date string, payer_account_id string, usage_account_id string,
    region string, region_code string, model_billing_name string, resolved_model_id string,
    token_type string, cross_region_type string, usage_type string, pricing_unit string,
    usage_amount double, unblended_cost double, unit_price double, unblended_rate double,
    item_description string, cur_file_key string
    """

RECONCILED_COSTS = """
    usage_date string, account_id string, region string, model_id string,
    model_billing_name string, token_type string, cross_region_type string,
    resolved_user_id string, resolved_user_name string, user_tokens double,
    total_tokens_in_bucket double, proportion double, bucket_unblended_cost double,
    attributed_cost double, reconciliation_status string
    """

MODEL_BILLING_MAP = "cur_billing_name string, bedrock_model_id string, source string, last_seen_date string"

IDENTITY_MAPPINGS = """
    principalarn string, sourcetype string, displayname string, email string,
    userid string, accesskeyid string, accountid string, resolvedat string
    """

DIRECTORY_USERS = """
    UserId string, UserName string, DisplayName string,
    Name struct<GivenName: string, FamilyName: string>,
    Emails array<struct<Value: string, Primary: boolean>>
    """

HOUR_PARTITIONS = ("year", "month", "day", "hour")
DAY_PARTITIONS = ("year", "month", "day")
PERIOD_PARTITIONS = ("billing_period",)

DEAD_LETTERS = """
    requestId string, timestamp string, processorName string, error string, failedAt string,
    originalContent string, sourceFile string
    """
