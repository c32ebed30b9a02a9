"""Exact percentiles of large groups by distributed selection; no task ever holds a group.

Rows are folded to one per group and distinct value. Groups of few distinct values are answered from these at once. For a
larger group the two order statistics that the percentile lies between are searched: the range that still holds a rank is cut into
BINS parts, the parts are counted over the cluster, and the part the rank falls into, narrowed to the values it
really has, is the next range. What meets per group are counts of parts, at the end up to FEW distinct values.

Every round cuts a range to a BINS-th, first of its magnitudes, then of its values, so a few rounds settle any range of
doubles. NaN and infinite values order as in Spark (NaN last).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.session import checkpointed

#: Distinct values of a group that one task may look at together.
FEW = 4096
BINS = 256

_KIND = "array<struct<v:double,n:bigint>>"


def exact_percentile(
    folded: DataFrame, keys: list[str], value: str, share: float, weight: str = "n", name: str = "percentile", few: int = FEW
) -> DataFrame:
    """(keys, name): the percentile by linear interpolation, per group with a value at all.

    `folded` has one row per group and distinct value with its number of occurrences, and is read several times.
    """
    rows = folded.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_n"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_distinct"), F.sum("_n").alias("_rows"), *_hull())
    large = checkpointed(sizes.where(F.col("_distinct") > few))
    direct = F.percentile("_v", share, F.col("_n")).alias(name)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(direct)
    named = large.select(*_renamed(keys))
    small = rows.join(named, _same(keys), "left_anti").groupBy(*keys).agg(direct)
    return small.unionByName(_selected(rows, large, keys, share, name, few))


def _selected(rows: DataFrame, large: DataFrame, keys: list[str], share: float, name: str, few: int) -> DataFrame:
    place = (F.col("_rows") - 1) * F.lit(share)
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), f(place).cast("long").alias("rank")) for i, f in enumerate((F.floor, F.ceil))]))
    targets = large.select(*keys, "_rows", "_distinct", "_lo", "_hi", "_flo", "_fhi", ranks.alias("_rank")).select("*", "_rank.*").drop("_rank")
    settled = []
    while True:
        done = (F.col("_distinct") <= few) | F.col("_lo").eqNullSafe(F.col("_hi"))
        settled.append(targets.where(done))
        targets = checkpointed(targets.where(~done))
        if targets.isEmpty():
            break
        targets = checkpointed(_narrowed(_within(rows, targets, keys), keys))
    found = reduce(DataFrame.unionByName, settled)
    met = _within(rows, checkpointed(found), keys)
    values = met.groupBy(*keys, "_rows", "which", "rank").agg(F.array_sort(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_n").alias("n")))).alias("values"))
    at = values.withColumn("_v", _value_at(F.col("values"), F.col("rank")))
    ends = at.groupBy(*keys, "_rows").agg(F.max(F.when(F.col("which") == 0, F.col("_v"))).alias("_low"), F.max(F.when(F.col("which") == 1, F.col("_v"))).alias("_high"))
    between = F.when(F.floor(place) == F.ceil(place), F.col("_low")).otherwise(
        (F.ceil(place) - place) * F.col("_low") + (place - F.floor(place)) * F.col("_high")
    )
    return ends.select(*keys, between.alias(name))


def _hull() -> list[Column]:
    """Least and greatest value, and the same of the finite ones."""
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    return [F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min(finite).alias("_flo"), F.max(finite).alias("_fhi")]


def _within(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each target's range.  Rows stand on the left, where the planner may split a heavy key."""
    own = [c for c in targets.columns if c not in keys]
    named = targets.select(*_renamed(keys), *own)
    return rows.join(named, [*_same(keys), F.col("_v").between(F.col("_lo"), F.col("_hi"))]).select(*keys, "_v", "_n", *own)


def _narrowed(met: DataFrame, keys: list[str]) -> DataFrame:
    """The next range of each target: the part in which its rank lies, and the rank within it."""
    least, most = F.col("_flo"), F.col("_fhi")
    # a range of several magnitudes is cut evenly in logarithms, one within a magnitude evenly in values
    steps = _magnitude(most) - _magnitude(least)
    by_size = (_magnitude(F.col("_v")) - _magnitude(least)) / steps
    even = F.when(most > least, (F.col("_v") - least) / (most - least)).otherwise(0.0)
    part = F.floor(F.when(steps > 1, by_size).otherwise(even) * BINS)
    part = F.least(F.greatest(part, F.lit(0)), F.lit(BINS - 1))
    infinite = F.when(F.isnan("_v"), BINS + 1).when(F.col("_v") == float("inf"), BINS).when(F.col("_v") == float("-inf"), -1)
    target = [*keys, "_rows", "which", "rank"]
    counted = met.groupBy(*target, F.coalesce(infinite, part).alias("_part")).agg(F.sum("_n").alias("_in"), F.count("*").alias("_distinct"), *_hull())
    entry = F.struct("_part", F.col("_in").alias("n"), F.struct("_distinct", "_lo", "_hi", "_flo", "_fhi").alias("range"))
    parts = counted.groupBy(*target).agg(F.array_sort(F.collect_list(entry)).alias("parts"))
    kind = "struct<rank:bigint,range:struct<_distinct:bigint,_lo:double,_hi:double,_flo:double,_fhi:double>>"
    start = F.struct(F.col("rank"), F.lit(None).alias("range")).cast(kind)

    def step(state: Column, entry: Column) -> Column:
        here = F.struct(state["rank"].alias("rank"), entry["range"].alias("range"))
        further = F.struct((state["rank"] - entry["n"]).alias("rank"), state["range"].alias("range"))
        return F.when(state["range"].isNotNull(), state).when(state["rank"] < entry["n"], here).otherwise(further)

    hit = parts.select(*keys, "_rows", "which", F.aggregate("parts", start, step).alias("hit"))
    return hit.select(*keys, "_rows", "hit.range.*", "which", "hit.rank")


def _magnitude(v: Column) -> Column:
    """A number that grows with v and by 1 per factor of e; 746 more than the logarithm is positive for all doubles above 0."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746.0))


def _value_at(values: Column, rank: Column) -> Column:
    """The value at a rank among sorted (v, n)."""
    start = F.struct(rank.alias("rank"), F.lit(None).cast("double").alias("v"), F.lit(False).alias("found"))

    def step(state: Column, entry: Column) -> Column:
        here = F.struct(state["rank"].alias("rank"), entry["v"].alias("v"), F.lit(True).alias("found"))
        further = F.struct((state["rank"] - entry["n"]).alias("rank"), state["v"].alias("v"), F.lit(False).alias("found"))
        return F.when(state["found"], state).when(state["rank"] < entry["n"], here).otherwise(further)

    return F.aggregate(values, start, step, lambda state: state["v"])


def _renamed(keys: list[str]) -> list[Column]:
    return [F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)]


def _same(keys: list[str]) -> list[Column]:
    """Equal keys, a missing one too; the other side has them renamed."""
    return [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)]
