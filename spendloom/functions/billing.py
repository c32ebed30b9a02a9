"""Columns derived from one billing export line."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendloom.fixed_values import (
    BILLING_HEADERS,
    CROSS_NONE,
    DEFAULT_MEASURE,
    MEASURE_BY_PRICING_UNIT,
    MEASURE_BY_TOKEN_TYPE,
)

# {region code}-{model}-{token type}[-{cross-region suffix}]; the model may hold hyphens.
USAGE_TYPE = (
    r"(?s)^([^-]+)-(.+)-(cache-read-input-token-count|cache-write-input-token-count"
    r"|input-tokens|output-tokens)(?:-(cross-region-global|cross-region-geo))?\z"
)


def usage_type_parts(usage_type: Column) -> dict[str, Column]:
    """Split a usage-type text; every part is NULL when the text has another form."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(usage_type, USAGE_TYPE, i), F.lit(""))

    token_type = part(3)
    return {
        "region_code": part(1),
        "model_billing_name": part(2),
        "token_type": token_type,
        "cross_region_type": F.when(token_type.isNotNull(), F.coalesce(part(4), F.lit(CROSS_NONE))),
    }


def unit_price(description: Column) -> Column:
    text = F.regexp_extract(description, r"\$([0-9.]+) per", 1)
    # A second dot ends the number.
    return F.regexp_extract(text, r"^([0-9]*\.?[0-9]*)", 1).try_cast("double")


def number_or_zero(text: Column) -> Column:
    """Leading number of a text, 0 when there is none."""
    head = F.regexp_extract(text, r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1)
    return F.coalesce(head.try_cast("double"), F.lit(0.0))


def header_column(columns: list[str], name: str, default: str = "") -> Column:
    """First present header variant.  An absent column is skipped, an empty value is not."""
    present = [h for h in BILLING_HEADERS[name] if h in columns]
    return F.coalesce(F.col(f"`{present[0]}`"), F.lit("")) if present else F.lit(default)


def text_prefix_or_unknown(c: Column, length: int) -> Column:
    """First characters of a date-like text: 7 give the period, 10 the day."""
    return F.coalesce(F.nullif(F.substring(c, 1, length), F.lit("")), F.lit("unknown"))


def measure_for(pricing_unit: Column, token_type: Column) -> Column:
    """Name of the usage column a cost line is divided by."""
    by_unit = [(pricing_unit == unit, measure) for unit, measure in MEASURE_BY_PRICING_UNIT.items()]
    by_token = [(token_type == token, measure) for token, measure in MEASURE_BY_TOKEN_TYPE.items()]
    first, *rest = by_unit + by_token
    chain = reduce(lambda acc, case: acc.when(*case), rest, F.when(*first))
    return chain.otherwise(DEFAULT_MEASURE)
