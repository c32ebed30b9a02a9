"""Calls and audit events that belong together: same request id, close in time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.fixed_values import CORRELATION_WINDOW_MS


def correlation_pairs(
    calls: DataFrame,
    audit: DataFrame,
    key: str = "requestid",
    call_time: str = "call_time",
    audit_time: str = "audit_time",
    window_ms: int = CORRELATION_WINDOW_MS,
) -> DataFrame:
    """Pairs whose times differ by at most the window, both ends included.

    The join key is the request id and a time slot one window wide; each audit event is put
    into its own slot and both neighbours.  A key with many rows is thereby cut up along
    time, and only rows of nearby slots are compared.  Unreadable times never match.
    """
    width = max(window_ms, 1)
    sliced_calls = calls.withColumn("_slot", _slot(F.col(call_time), width))
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _slot(F.col(audit_time), width) + d)
    sliced_audit = audit.withColumn("_slot", F.explode(near))
    gap = F.abs(_millis(F.col(call_time)) - _millis(F.col(audit_time)))
    return sliced_calls.join(sliced_audit, [key, "_slot"]).where(gap <= window_ms).drop("_slot")


def with_audit_match(
    calls: DataFrame,
    audit: DataFrame,
    key: str = "requestid",
    call_time: str = "call_time",
    audit_time: str = "audit_time",
    window_ms: int = CORRELATION_WINDOW_MS,
) -> DataFrame:
    """Each call once, with `is_correlated`: is there an audit event within the window?

    No pairs are formed.  Audit events fold to the first and last time per key and slot.  In
    its own slot any event is near enough; in the slot before the last event decides, in the
    slot after the first one.  Rows of one key and slot are combined before the shuffle.
    """
    width = max(window_ms, 1)
    at = _millis(F.col(call_time))
    slots = (
        audit.select(key, _slot(F.col(audit_time), width).alias("_at_slot"), _millis(F.col(audit_time)).alias("_ms"))
        .where(F.col("_ms").isNotNull())
        .groupBy(key, "_at_slot")
        .agg(F.min("_ms").alias("_first"), F.max("_ms").alias("_last"))
    )
    offsets = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    spread = slots.withColumn("_offset", offsets).select(
        key,
        (F.col("_at_slot") + F.col("_offset")).alias("_slot"),
        F.when(F.col("_offset") == 1, F.col("_last")).alias("_before"),
        F.when(F.col("_offset") == 0, F.lit(True)).alias("_within"),
        F.when(F.col("_offset") == -1, F.col("_first")).alias("_after"),
    )
    reach = spread.groupBy(key, "_slot").agg(
        F.max("_before").alias("_before"), F.max("_within").alias("_within"), F.min("_after").alias("_after")
    )
    matched = (
        F.coalesce(F.col("_within"), F.lit(False))
        | F.coalesce(at - F.col("_before") <= window_ms, F.lit(False))
        | F.coalesce(F.col("_after") - at <= window_ms, F.lit(False))
    )
    return (
        calls.withColumn("_slot", _slot(F.col(call_time), width))
        .join(reach, [key, "_slot"], "left")
        .withColumn("is_correlated", matched)
        .drop("_slot", "_before", "_within", "_after")
    )


def with_nearest_audit(
    calls: DataFrame,
    audit: DataFrame,
    key: str = "requestid",
    call_time: str = "call_time",
    audit_time: str = "audit_time",
    window_ms: int = CORRELATION_WINDOW_MS,
    slot_ms: int = 1000,
) -> DataFrame:
    """Each call once, with the time of the last audit event of its key at or before it, of the first one at or
    after it, and of the nearer of both (the earlier one if they are as near), each within the window.

    A sweep in time order, without pairs: calls and events are cut into short slots per key. Within a slot they are
    sorted together and each call looks back and ahead; what a slot can't see comes from the slots before and after, each folded
    to its first and last event. So a task sorts the rows of one slot, and per key one row per slot.
    """
    at, slot = _millis(F.col(call_time)), lambda time: _slot(time, slot_ms)
    events = audit.select(F.col(key).alias("_key"), _millis(F.col(audit_time)).alias("_event")).where(F.col("_event").isNotNull())
    events = events.withColumn("_slot", slot(F.timestamp_millis("_event")))
    packed = calls.select(F.struct(*calls.columns).alias("_row"), F.col(key).alias("_key"), at.alias("_at"))
    packed = packed.withColumn("_slot", slot(F.timestamp_millis("_at")))

    # per key and slot: the last event of earlier slots and the first one of later slots
    seen = events.groupBy("_key", "_slot").agg(F.min("_event").alias("_first"), F.max("_event").alias("_last"))
    asked = packed.where(F.col("_at").isNotNull()).select("_key", "_slot").distinct()
    empty = [F.lit(None).cast("bigint").alias(n) for n in ("_first", "_last")]
    slots = seen.unionByName(asked.select("_key", "_slot", *empty)).groupBy("_key", "_slot")
    slots = slots.agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    in_time = Window.partitionBy("_key").orderBy("_slot")
    earlier = in_time.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_key").orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    around = slots.select(
        F.col("_key").alias("_k"), F.col("_slot").alias("_s"),
        F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"),
        F.last("_first", ignorenulls=True).over(later).alias("_later"),
    )

    # within a slot: calls and events in one order
    both = packed.select("_key", "_slot", F.col("_at").alias("_ms"), "_row", F.lit(None).cast("bigint").alias("_event"))
    no_row = F.lit(None).cast(packed.schema["_row"].dataType).alias("_row")
    both = both.unionByName(events.select("_key", "_slot", F.col("_event").alias("_ms"), no_row, "_event"))
    # ranges, so that events of the very same time count on both sides
    group = Window.partitionBy("_key", "_slot")
    before = group.orderBy("_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = group.orderBy(F.desc("_ms")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumns({"_own_before": F.max("_event").over(before), "_own_after": F.min("_event").over(after)}).where("_row IS NOT NULL")
    met = swept.join(around, swept["_key"].eqNullSafe(around["_k"]) & swept["_slot"].eqNullSafe(around["_s"]), "left")
    has_key = F.coalesce(F.col("_key").cast("string"), F.lit("")) != ""
    reach = lambda ms: F.when(has_key & (F.abs(ms - F.col("_ms")) <= window_ms), ms)
    back, ahead = reach(F.coalesce("_own_before", "_earlier")), reach(F.coalesce("_own_after", "_later"))
    nearest = F.when(ahead.isNull() | (F.col("_ms") - back <= ahead - F.col("_ms")), back).otherwise(ahead)
    return met.select(
        "_row.*", F.timestamp_millis(back).alias("audit_before"), F.timestamp_millis(ahead).alias("audit_after"),
        F.timestamp_millis(nearest).alias("audit_nearest"),
    )


def _millis(time: Column) -> Column:
    return F.unix_millis(time)


def _slot(time: Column, width_ms: int) -> Column:
    return F.floor(_millis(time) / F.lit(width_ms))
