"""Values the input formats and the billing vendor fix.  They are data, not logic.

Everything here must equal what the exports and logs contain, so it is stated
plainly and in one place.
"""

# --- fixed values: billing export ------------------------------------------

PRODUCT_CODE = "AmazonBedrockService"

REGION_BY_CODE = {
    "USE1": "us-east-1",
    "USE2": "us-east-2",
    "USW1": "us-west-1",
    "USW2": "us-west-2",
    "EUW1": "eu-west-1",
    "EUW2": "eu-west-2",
    "EUW3": "eu-west-3",
    "EUC1": "eu-central-1",
    "EUN1": "eu-north-1",
    "APS1": "ap-south-1",
    "APS2": "ap-southeast-2",
    "APE1": "ap-northeast-1",
    "APN1": "ap-northeast-1",
    "APSE1": "ap-southeast-1",
    "SAE1": "sa-east-1",
    "CAN1": "ca-central-1",
    "MES1": "me-south-1",
}

MODEL_BY_BILLING_NAME = {
    "Claude4.6Opus": "anthropic.claude-opus-4-6-v1",
    "Claude4.6Sonnet": "anthropic.claude-sonnet-4-6",
    "Claude4.5Opus": "anthropic.claude-opus-4-5-20251101-v1:0",
    "Claude4.5Haiku": "anthropic.claude-haiku-4-5-20251001-v1:0",
    "Claude3.7Sonnet": "anthropic.claude-3-7-sonnet-20250219-v1:0",
    "Claude3.5Sonnetv2": "anthropic.claude-3-5-sonnet-20241022-v2:0",
    "Claude3.5Haiku": "anthropic.claude-3-5-haiku-20241022-v1:0",
    "Claude3Haiku": "anthropic.claude-3-haiku-20240307-v1:0",
    "Claude3Sonnet": "anthropic.claude-3-sonnet-20240229-v1:0",
    "Claude3Opus": "anthropic.claude-3-opus-20240229-v1:0",
    "Claude4.5Sonnet": "anthropic.claude-4-5-sonnet-20250514-v1:0",
    "Jamba1-5Large": "ai21.jamba-1-5-large-v1:0",
    "Jamba1-5Mini": "ai21.jamba-1-5-mini-v1:0",
    "NovaPro": "amazon.nova-pro-v1:0",
    "NovaPremier": "amazon.nova-premier-v1:0",
    "NovaLite": "amazon.nova-lite-v1:0",
    "NovaMicro": "amazon.nova-micro-v1:0",
    "NovaReel": "amazon.nova-reel-v1:0",
    "NovaCanvas": "amazon.nova-canvas-v1:0",
    "TitanTextExpress": "amazon.titan-text-express-v1",
    "Llama3.18BInstruct": "meta.llama3-1-8b-instruct-v1:0",
    "Llama3.170BInstruct": "meta.llama3-1-70b-instruct-v1:0",
}

TOKEN_TYPES = (
    "input-tokens",
    "output-tokens",
    "cache-read-input-token-count",
    "cache-write-input-token-count",
)

CROSS_NONE = "none"
CROSS_GLOBAL = "cross-region-global"
CROSS_GEO = "cross-region-geo"

# Usage column a cost line is divided by.  The pricing unit wins over the token type.
MEASURE_BY_PRICING_UNIT = {
    "Images": "imagecount",
    "Seconds": "videodurationseconds",
}
MEASURE_BY_TOKEN_TYPE = {
    "input-tokens": "inputtokens",
    "output-tokens": "outputtokens",
    "cache-read-input-token-count": "cachereadinputtokens",
    "cache-write-input-token-count": "cachewriteinputtokens",
}
DEFAULT_MEASURE = "inputtokens"

# Export columns and the headers they may come under, first present one wins.
BILLING_HEADERS = {
    "product_code": ("product_code", "lineItem/ProductCode"),
    "usage_type": ("usage_type", "lineItem/UsageType"),
    "item_description": ("item_description", "lineItem/LineItemDescription"),
    "billing_period": ("billing_period", "bill/BillingPeriod"),
    "usage_date": ("usage_date", "usage_start_date", "lineItem/UsageStartDate"),
    "payer_account_id": ("payer_account_id", "bill/PayerAccountId"),
    "usage_account_id": ("linked_account_id", "usage_account_id", "lineItem/UsageAccountId"),
    "pricing_unit": ("pricing_unit", "pricing/unit"),
    "usage_quantity": ("usage_quantity", "lineItem/UsageQuantity"),
    "unblended_cost": ("unblended_cost", "lineItem/UnblendedCost"),
}

# --- fixed values: call log, audit log, identities ---------------------------

PROFILE_ARN = r"^arn:aws:bedrock:([^:]+):[^:]*:inference-profile/(.+)$"

MODEL_CALL_EVENTS = (
    "InvokeModel",
    "InvokeModelWithResponseStream",
    "Converse",
    "ConverseStream",
)

RECONCILIATION_STATUSES = ("pending", "estimated", "reconciled", "unmatched")
UNMATCHED_USER = "UNMATCHED"

# --- fixed values: windows and alarm limits ----------------------------------

METRIC_WINDOW = "5 minutes"
CORRELATION_WINDOW_MS = 300_000
DEDUP_MEMORY = "24 hours"
MISMATCH_LIMIT_PERCENT = 5.0
RECONCILE_AGE_LIMIT_HOURS = 24.0
BILLING_AGE_LIMIT_HOURS = 48.0
IDENTITY_MISS_LIMIT_PERCENT = 50.0
RETENTION_DAYS = 90
HIGH_COST_LIMIT = 100.0
