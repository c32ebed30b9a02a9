"""Columns derived from one model-call log record."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendloom.fixed_values import CROSS_GEO, CROSS_GLOBAL, CROSS_NONE, PROFILE_ARN
from spendloom.functions.common import blank_to_null

_GEO_PREFIX = r"^[a-z]{2}\."


def profile_resolution(model_id: Column, region: Column) -> dict[str, Column]:
    """Resolve a cross-region profile id to model, source region, execution region, type.

    Profile ARN: source region comes from the ARN, a two-letter prefix is dropped, the
    type is `geo` with such a prefix and `global` without.  A bare two-letter prefix is
    `geo` as well.  Any other id stays as it is.
    """
    is_arn = model_id.rlike(PROFILE_ARN)
    profile = F.regexp_extract(model_id, PROFILE_ARN, 2)
    is_prefixed = model_id.rlike(_GEO_PREFIX + ".")
    subject = F.when(is_arn, profile).otherwise(model_id)
    return {
        "resolvedmodelid": F.when(
            is_arn | is_prefixed, F.regexp_replace(subject, _GEO_PREFIX, "")
        ).otherwise(model_id),
        "sourceregion": F.when(is_arn, F.regexp_extract(model_id, PROFILE_ARN, 1)).otherwise(region),
        "executionregion": region,
        "crossregiontype": F.when(is_arn & profile.rlike(_GEO_PREFIX), "geo")
        .when(is_arn, "global")
        .when(is_prefixed, "geo")
        .otherwise("none"),
    }


def inference_tier(request_body: Column) -> Column:
    """`priority` and `flex` are kept; anything else, including bad JSON, is `standard`."""
    tier = F.get_json_object(request_body, "$.service_tier")
    return F.when(tier.isin("priority", "flex"), tier).otherwise("standard")


def cache_ttl(request_body: Column) -> Column:
    one_hour = request_body.contains('"ttl":"1h"') | request_body.contains('"ttl": "1h"')
    return F.when(one_hour, "1h").otherwise("5m")


def cache_type(write_tokens: Column, read_tokens: Column, request_body: Column) -> Column:
    """A cache write wins over a cache read; its kind follows the TTL in the body."""
    return (
        F.when(write_tokens > 0, F.concat(F.lit("cacheWrite"), cache_ttl(request_body)))
        .when(read_tokens > 0, "cacheRead")
        .otherwise("none")
    )


def latency_ms(top_level: Column, response_body: Column) -> Column:
    """Top-level latency, else the one inside the response body, else 0."""
    nested = F.get_json_object(response_body, "$.metrics.latencyMs").try_cast("bigint")
    return F.coalesce(F.nullif(top_level, F.lit(0)), nested, F.lit(0)).cast("bigint")


def audio_seconds(model_id: Column, top_level_latency: Column) -> Column:
    is_audio = F.lower(model_id).rlike("sonic|speech|audio")
    return F.when(is_audio & (top_level_latency > 0), top_level_latency / F.lit(1000.0))


def user_name_from_arn(arn: Column) -> Column:
    """Readable caller name: the ARN resource without its `user/`, `role/`, `assumed-role/` head."""
    parts = F.split(arn, ":")
    resource = F.array_join(F.slice(parts, 6, F.greatest(F.size(parts), F.lit(1))), ":")
    name = F.regexp_replace(resource, "^(assumed-role|user|role)/", "")
    # A bare "user/" leaves an empty name on purpose; only an empty resource is unknown.
    return (
        F.when(F.coalesce(arn, F.lit("")) == "", "unknown")
        .when(F.size(parts) < 6, arn)
        .when(resource == "", "unknown")
        .otherwise(name)
    )


def billing_cross_region(model_id: Column, source_region: Column, execution_region: Column) -> Column:
    """Cross-region type in billing terms, from the called id and the two regions."""
    source = F.lower(F.coalesce(source_region, F.lit("")))
    execution = F.lower(F.coalesce(execution_region, F.lit("")))
    return (
        F.when(model_id.contains("/global.") | model_id.startswith("global."), CROSS_GLOBAL)
        .when(model_id.rlike(r"/(us|eu|ap)\.|^(us|eu|ap)\."), CROSS_GEO)
        .when((source != execution) & (source != "") & (execution != ""), CROSS_GLOBAL)
        .otherwise(CROSS_NONE)
    )


def strip_cross_region_prefix(model_id: Column) -> Column:
    return F.regexp_replace(model_id, r"^(global|us|eu|ap)\.", "")


def missing_field_error(parsed: Column) -> Column:
    """Reason a parsed record cannot be used, NULL when it can.  Empty text counts as missing."""
    needed = ("requestId", "timestamp", "modelId")
    checks = [
        F.when(blank_to_null(parsed[name]).isNull(), f"missing required field: {name}") for name in needed
    ]
    return F.coalesce(*checks)
