"""Small column expressions shared by several operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def model_name(model_id: Column) -> Column:
    """Second `/` part of an ARN-like id, or the id itself when it has no slash."""
    return F.when(F.instr(model_id, "/") > 0, F.split_part(model_id, F.lit("/"), F.lit(2))).otherwise(
        model_id
    )


def friendly_model_name(model_id: Column) -> Column:
    """Display name: dots and hyphens become spaces; an empty name falls back to the id."""
    name = F.coalesce(blank_to_null(model_name(model_id)), model_id)
    return F.translate(name, ".-", "  ")


def iso_to_timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp; unreadable text becomes NULL instead of failing the job."""
    return F.try_to_timestamp(text)


def display_user(name: Column, user_id: Column, account_id: Column) -> Column:
    return F.coalesce(blank_to_null(name), user_id, account_id)


def usage_date(year: Column, month: Column, day: Column) -> Column:
    """`yyyy-MM-dd` text from the partition columns."""
    return F.concat_ws("-", year, month, day)


def round10(c: Column) -> Column:
    """Money and shares keep ten decimals."""
    return F.round(c, 10)


def decode_key(c: Column) -> Column:
    """Undo the form encoding of object keys in storage notifications."""
    return F.coalesce(F.try_url_decode(c), c)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def partition_columns(text_ts: Column) -> dict[str, Column]:
    """Zero-padded UTC partition values of an ISO timestamp text.

    The values are cut from a UTC rendering, so offsets other than `Z` are honoured.
    """
    ts = iso_to_timestamp(text_ts)
    return {
        "year": F.date_format(ts, "yyyy"),
        "month": F.date_format(ts, "MM"),
        "day": F.date_format(ts, "dd"),
        "hour": F.date_format(ts, "HH"),
    }
