"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the mix. Its mean repetition rate is target share / actual share, and
each document is repeated as often as a Poisson variable with that mean says; the variable is found by
inverting the distribution at a number hashed from (seed, id, text), so a rerun gives the same mix and rows do
not depend on each other. The repeated rows are then shuffled globally by another hash.

Only the sizes of the sources are aggregated before the rows are read; nothing is sampled or capped.

Defined cases: a null source is a source of its own. Sources missing in `weights` get rate 1 (left as they
are); a weight of 0 removes a source. Rows with equal id and text (null is a text of its own) are repeated equally
often. An empty table gives an empty mix. Extra columns of any name are carried along in `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a source in the mix: its share in the corpus to this power, scaled to 1 (1 keeps the corpus as it is).
POWER = 0.5
SEED = "mix-1"
#: A table of rates is broadcast up to so many sources; beyond, Spark joins it as it sees fit.
BROADCAST_SOURCES = 10_000
SCALE = 2**52


def hashed(*parts: Column) -> Column:
    """52 bits of the parts' MD5, as a long. (MD5 because other engines have it too.)"""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def cumulated(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of the Poisson distribution, as far as 52 bits can tell it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(log_p.alias("log_p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + F.exp(log_p))).alias("sums"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["sums"])).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER) -> DataFrame:
    """(source, rate, steps) for every source: target share / actual share, shares counted in documents.
    The mix has about as many documents as the corpus."""
    sizes = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("n", F.lit(power)))
    else:
        given = F.lit(None).cast("double")
        for source, weight in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(weight))).otherwise(given)
        sizes = sizes.withColumn("weight", given)
    total = sizes.agg(F.sum(F.when(F.col("weight").isNotNull(), F.col("n"))).alias("n"), F.sum("weight").alias("weight"))
    total = total.select(F.struct("n", "weight").alias("total")).scalar()
    rate = F.coalesce(F.col("weight") / total["weight"] * total["n"] / F.col("n"), F.lit(1.0))
    return sizes.select("source", rate.alias("rate")).withColumn("steps", cumulated(F.col("rate")))


def poisson_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, seed: str = SEED) -> DataFrame:
    """(row, copy, mix_key): the documents, repeated and in random order. mix_key orders the mix."""
    found = rates(docs, weights, power).withColumnRenamed("source", "rate_source")
    if found.count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    key = [F.lit(seed), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("row.text"), F.lit(""))]
    drawn = packed.join(found, F.col("row.source").eqNullSafe(F.col("rate_source"))).withColumn("u", hashed(*key) / F.lit(float(SCALE)))
    copies = F.size(F.filter("steps", lambda p: p <= F.col("u")))
    repeated = drawn.select("row", copies.alias("copies")).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    keyed = repeated.withColumn("mix_key", hashed(*key, F.col("copy").cast("string"), F.lit("order")))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key", "copy")
