"""What joins share: hashed keys, and missing keys that match.

Per-group numbers (totals, counts, last user) come from `groupBy`, which combines on the map
side, never from a window over a key that callers control.  The small result is joined back by a
plain join with the many rows on the left, which the adaptive planner may split.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bits of the map of hashes that `may_match` broadcasts: at most BITS / 64 rows of two numbers.
BITS = 1 << 24


def with_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add `_key`, the hash that `hashed_join` puts in front of the keys.  Rows grouped by it and the keys
    already lie where the join wants them."""
    return df.withColumn("_key", F.xxhash64(*keys))


def hashed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A plain join with a hash of the keys in front of them.

    Sorting then compares numbers, not texts that all begin with the same date or account.
    """
    left, right = (df if "_key" in df.columns else with_key(df, keys) for df in (left, right))
    return left.join(right, ["_key", *keys], how).drop("_key")


def may_match(rows: DataFrame, keys: list[str], other: DataFrame, other_keys: list[str] | None = None) -> DataFrame:
    """Add `_may_match`: false only if no row of `other` has the keys of this row, without a shuffle of `rows`.

    What is broadcast is a bit map of hashed keys, of fixed size however many keys `other` has.  A true may be wrong, so
    the exact join follows; it then shuffles hardly more rows than find a partner.
    """
    place = lambda names: F.pmod(F.xxhash64(*names), F.lit(BITS))
    bit = lambda at: F.expr(f"shiftleft(1L, cast({at} % 64 as int))")
    asked = other.select(place(other_keys or keys).alias("_at"))
    words = asked.groupBy(F.expr("_at div 64").alias("_word")).agg(F.bit_or(bit("_at")).alias("_bits"))
    placed = rows.withColumn("_place", place(keys)).withColumn("_word", F.expr("_place div 64"))
    found = placed.join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit("_place")) != 0, F.lit(False))
    return found.withColumn("_may_match", hit).drop("_place", "_word", "_bits")


def fill_keys(df: DataFrame, *names: str) -> DataFrame:
    """Missing key text counts as '' so that missing matches missing."""
    return df.withColumns({name: _filled(F.col(name)) for name in names})


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
