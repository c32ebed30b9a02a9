"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows are written once to the shared folder together with the partition they came in and their place there; so
the partitions are fixed, whatever is computed again later. With P partitions of known sizes and shards whose
sizes are at most one apart, a uniform shuffle sends a random number of rows from each partition to each shard. These
numbers are drawn first, exactly as a uniform permutation would have them: by a tree over the partitions
(FANOUT children a node), each node's rows are divided among its children shard by shard, each number being
hypergeometric given those before. Then every row finds its place by itself:

1. permute locally: the place in the partition goes through a keyed bijection of [0, partition size); the
   matrix row cuts that range into one run per shard;
2. exchange: the run of partition p in shard s begins where the runs of the partitions before p end;
3. permute again: the place in the shard goes through a keyed bijection of [0, shard size), which is the slot.

The bijection is swap-or-not (any size, nothing is sorted or kept in memory), so no task holds a partition or a
shard; rows travel once, in chunks of a shard. The matrix has one row per partition; Spark broadcasts it if it is
small enough, else it is joined by partition.

Everything is built of DataFrame functions. Numbers depend on the seed, the partitions and the places only.

Defined cases: the rows themselves are not looked at, so nulls, repeated rows, copies (dealt one by one like all
other rows), long texts and extra columns of any name make no difference; columns travel in `row`. An empty table
gives no rows. With fewer rows than shards the last shards stay empty.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import let, shared_folder

SHARDS = 8
SEED = 13
#: Children of a node of the tree over the partitions.
FANOUT = 32
#: Rounds of a bijection.
ROUNDS = 64
#: Rows of a shard that travel to one place together.
CHUNK = 1024
#: Up to this many possible values a number is found by summing up probabilities, beyond by rejection.
SUMMED = 64
#: Tries of the rejection, each taken with a chance of more than one half.
TRIES = 64

#: ln 0!, ln 1!, ...
_LOG_FACTORIALS = [math.lgamma(k + 1) for k in range(16)]


def uniform(*key: Column) -> Column:
    """A number between 0 and 1, both excluded, from the hash of the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + F.lit(0.5)) / F.lit(float(2**53))


def log_factorial(k: Column) -> Column:
    """ln k!, by Stirling's series from 16 on."""
    series = k * F.ln(k) - k + 0.5 * F.ln(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)
    return F.when(k < 16, F.element_at(F.array(*map(F.lit, _LOG_FACTORIALS)), (k + 1).cast("int"))).otherwise(series)


def hypergeometric(draws: Column, marked: Column, total: Column, *key: Column) -> Column:
    """How many of `marked` among `total` rows are met by `draws` draws without putting back; all are longs."""

    def few(m: Column, a: Column) -> Column:
        """By summing up the probabilities of 0, 1, ..."""
        rest = total - a - m
        first = F.exp(log_factorial((total - a).cast("double")) + log_factorial((total - m).cast("double")) - log_factorial(total.cast("double")) - log_factorial(rest.cast("double")))
        start = F.struct(F.lit(0).cast("long").alias("x"), first.alias("p"), first.alias("sum"))

        def step(state: Column, k: Column) -> Column:
            p = state["p"] * ((a - k + 1) * (m - k + 1) / (k * (rest + k)))
            more = (state["x"] == k - 1) & (state["sum"] <= uniform(*key))
            return F.struct((state["x"] + more.cast("long")).alias("x"), p.alias("p"), (state["sum"] + p).alias("sum"))

        return F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(a, m)), start, step, lambda state: state["x"])

    def many(m: Column, a: Column) -> Column:
        """By rejection under a table mountain hat (ratio of uniforms)."""
        share = a / total
        mean = m * share
        spread = F.sqrt(mean * (1 - share) * (total - m) / (total - 1) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))

        def weight(x: Column) -> Column:
            return -log_factorial(x) - log_factorial(a - x) - log_factorial(m - x) - log_factorial(total - a - m + x)

        mode = F.floor((m + 1) * ((a + 1) / (total + 2))).cast("double")

        def tried(given: Column) -> Column:
            def step(found: Column, t: Column) -> Column:
                def judged(at: Column) -> Column:
                    fits = (at["x"] >= 0) & (at["x"] <= F.least(a, m))
                    return F.when(fits, F.when(2 * F.ln(at["u"]) <= weight(at["x"]) - given["top"], at["x"]).otherwise(-1.0)).otherwise(-1.0)

                def point(u: Column) -> Column:
                    x = F.floor(given["mean"] + 0.5 + given["width"] * (uniform(*key, t, F.lit(1)) - 0.5) / u).cast("double")
                    return let(F.struct(x.alias("x"), u.alias("u")), judged)

                return F.when(found >= 0, found).otherwise(let(uniform(*key, t, F.lit(0)), point))

            found = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(-1.0), step)
            return F.when(found >= 0, found).otherwise(given["mode"]).cast("long")

        return let(F.struct(mean.alias("mean"), width.alias("width"), mode.alias("mode"), weight(mode).alias("top")), tried)

    def reduced(of: Column) -> Column:
        m, a = of["m"], of["a"]
        drawn = F.when(F.least(m, a) <= SUMMED, few(m, a)).otherwise(many(m, a))
        # the rarer kind was counted, in the smaller of what is drawn and what is left
        kind = F.when(marked > total - marked, m - drawn).otherwise(drawn)
        return F.when(draws > total - draws, marked - kind).otherwise(kind)

    smaller = F.struct(F.least(draws, total - draws).alias("m"), F.least(marked, total - marked).alias("a"))
    sure = F.when((draws == 0) | (marked == 0), F.lit(0).cast("long")).when(marked == total, draws).when(draws == total, marked)
    return F.coalesce(sure, let(smaller, reduced))


def divided(size: Column, pool: Column, *key: Column) -> Column:
    """`size` rows drawn from a pool with pool[s] rows of shard s: how many of each shard."""
    start = F.struct(size.alias("left"), F.aggregate(pool, F.lit(0).cast("long"), lambda t, x: t + x).alias("total"), F.array().cast("array<long>").alias("taken"))

    def step(state: Column, of_shard: Column) -> Column:
        drawn = hypergeometric(state["left"], of_shard, state["total"], *key, F.size(state["taken"]))
        return let(
            F.struct(drawn.alias("drawn"), state.alias("state")),
            lambda x: F.struct(
                (x["state"]["left"] - x["drawn"]).alias("left"),
                (x["state"]["total"] - of_shard).alias("total"),
                F.concat(x["state"]["taken"], F.array(x["drawn"])).alias("taken"),
            ),
        )

    return F.aggregate(pool, start, step, lambda state: state["taken"])


def matrix(sizes: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(partition, n, total, counts, first): how many rows of each partition go to each shard, and how many of the
    shard come from partitions before it. sizes: (partition, n)."""
    last = sizes.agg(F.max("partition")).first()[0] or 0
    levels = 1
    while FANOUT**levels <= last:
        levels += 1
    zero = F.lit(0).cast("long")
    total = F.coalesce(F.sum("n"), zero).alias("total")
    shard = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    even = F.transform(shard, lambda s: F.expr(f"total div {shards}") + (s < F.col("total") % shards).cast("long"))
    tree = sizes.agg(total).select("total", zero.alias("node"), even.alias("pool"), F.transform(shard, lambda s: zero).alias("first"))

    def handed_out(level: int):
        def step(state: Column, child: Column) -> Column:
            taken = divided(child["n"], state["pool"], F.lit(seed), F.lit(level), child["child"])
            part = lambda x: F.struct(child["child"].alias("node"), child["n"].alias("n"), x["taken"].alias("pool"), x["state"]["first"].alias("first"))
            return let(
                F.struct(taken.alias("taken"), state.alias("state")),
                lambda x: F.struct(
                    F.zip_with(x["state"]["pool"], x["taken"], lambda a, b: a - b).alias("pool"),
                    F.zip_with(x["state"]["first"], x["taken"], lambda a, b: a + b).alias("first"),
                    F.concat(x["state"]["out"], F.array(part(x))).alias("out"),
                ),
            )

        return step

    for level in reversed(range(levels)):
        nodes = sizes.groupBy(F.expr(f"`partition` div {FANOUT**level}").alias("child")).agg(F.sum("n").alias("n"))
        families = nodes.groupBy(F.expr(f"child div {FANOUT}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("children"))

        kind = "array<struct<node:bigint,n:bigint,pool:array<bigint>,first:array<bigint>>>"
        start = F.struct("pool", "first", F.array().cast(kind).alias("out"))
        split = tree.join(families, "node").select("total", F.explode(F.aggregate("children", start, handed_out(level), lambda state: state["out"])).alias("part"))
        tree = split.select("total", "part.*")
    return tree.select(F.col("node").alias("partition"), "n", "total", F.col("pool").alias("counts"), "first")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The image of x under a bijection of 0, 1, ..., n - 1 that the key selects (swap-or-not)."""

    def step(state: Column, r: Column) -> Column:
        def partner(k: Column) -> Column:
            y = F.pmod(F.pmod(k, n) - state, n)
            return let(y, lambda y: F.when(F.xxhash64(k, F.greatest(state, y)).bitwiseAND(F.lit(1).cast("long")) == 1, y).otherwise(state))

        return let(F.xxhash64(*key, r), partner)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x, step)


def placed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(row, shard, slot) of every row: slots of a shard run from 0 without gaps."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4()}"
    # a partition's number and the place in it, from one id
    docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    part = F.shiftrightunsigned("at", 33).alias("partition")
    matrix(rows.groupBy(part).agg(F.count("*").alias("n")), shards, seed).write.parquet(f"{folder}/matrix")
    drawn = spark.read.parquet(f"{folder}/matrix")

    at = F.col("at").bitwiseAND(F.lit(2**33 - 1))
    met = rows.select("row", part, at.alias("at")).join(drawn, "partition")
    met = met.withColumn("local", permuted(F.col("at"), F.col("n"), F.lit(seed), F.lit("local"), F.col("partition")))
    before = F.struct(F.lit(0).alias("shard"), F.col("local").alias("rest"))

    def walk(state: Column, run: Column) -> Column:
        """Along the runs of the partition, until the place lies within one; the rest is negative from then on."""
        further = F.struct((state["shard"] + (state["rest"] >= run).cast("int")).alias("shard"), (state["rest"] - run).alias("rest"))
        return F.when(state["rest"] < 0, state).otherwise(further)

    met = met.withColumn("run", F.aggregate("counts", before, walk))
    shard = F.col("run.shard")
    start = F.element_at("first", shard + 1) + F.element_at("counts", shard + 1) + F.col("run.rest")
    size = F.expr(f"total div {shards}") + (shard < F.col("total") % shards).cast("long")
    found = met.select("row", shard.alias("shard"), start.alias("start"), size.alias("size"))
    found = found.select("row", "shard", permuted(F.col("start"), F.col("size"), F.lit(seed), F.lit("shard"), F.col("shard")).alias("slot"))
    return found.repartition("shard", F.expr(f"slot div {CHUNK}")).sortWithinPartitions("shard", "slot")


def write_shards(found: DataFrame, path: str) -> None:
    """The rows below `path`/shard=s, each file in the order of slots; a clash with the column names is settled by `row`."""
    found.write.partitionBy("shard").parquet(path)
