"""Usage facts for the dashboards, kept up to date by changed days.

The facts are a table of versioned partitions, by default one per day. A run compares what its sources are made of now with what
they were made of in the last run: per day the files of the calls, per billing period the version of the reconciled
costs. Only days whose calls changed, or that a changed period has or had costs for, are computed again, from
their own partitions, and replace the stored ones at once. The result is what a full rebuild gives.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom import schemas
from spendloom.operators import dataset
from spendloom.plans import reconcile
from spendloom.session import checkpointed, intermediate, prepare, release
from spendloom.sources import files, readers, versions

FACTS = """
    day date, accountid string, modelid string, resolveduserid string, resolvedusername string, calls bigint,
    inputtokens bigint, outputtokens bigint, latency_sum bigint, latency_count bigint,
    inputcost double, outputcost double, totalcost double, reconciliation_status string,
    totaltokens bigint, modelname string, friendlymodelname string
    """
#: What the last run saw: kind `calls` (day, files), `costs` (period, version), `cost-days` (period, day).
_SEEN, _KIND = "part string, mark string", ("kind",)
_FORMS = {"year": "yyyy", "month": "MM", "day": "dd"}


def update(
    spark: SparkSession,
    calls_path: str,
    reconciled: str,
    target: str,
    grain: tuple[str, ...] = schemas.DAY_PARTITIONS,
    partitions: tuple[str, ...] = schemas.HOUR_PARTITIONS,
) -> list[str]:
    """Bring the facts below `target` up to date and return the days (`yyyy-MM-dd`, or what `grain` says) computed again.

    `calls_path` is a call table with `partitions`, `reconciled` a target of the reconcile job.  `grain` are leading
    date columns of both; facts of one grain are replaced together.
    """
    prepare(spark)
    length = 4 + 3 * (len(grain) - 1)
    seen = _seen(spark, target)
    calls_now = checkpointed(_call_marks(spark, calls_path, grain))
    costs_now = _cost_marks(spark, reconciled)
    periods = [r[0] for r in _changed(seen, "costs", costs_now).collect()]  # as many as billing periods
    new_days = _cost_days(spark, reconciled, periods, length)
    old_days = seen.where("kind = 'cost-days'").select("part", "mark")
    of_changed = F.col("part").isin(periods)
    cost_days = checkpointed(old_days.where(~of_changed).unionByName(new_days))
    touched = old_days.where(of_changed).unionByName(new_days).select(F.col("mark").alias("part"))
    days = sorted(r[0] for r in _changed(seen, "calls", calls_now).unionByName(touched).distinct().collect())  # calendar days
    if days:
        # computed first and dealt to partitions afterwards, so that the shuffles of both are not on the disks at once
        with intermediate(_facts(spark, calls_path, reconciled, cost_days, days, grain, partitions, length), "new-facts") as rows:
            release(spark)
            versions.replace(rows, target, _folders(grain), _grains(spark, days, grain))
        release(spark)
    if days or periods:
        marks = [("calls", calls_now), ("costs", costs_now), ("cost-days", cost_days)]
        first, *rest = [rows.withColumn("kind", F.lit(kind)) for kind, rows in marks]
        for rows in rest:
            first = first.unionByName(rows)
        kinds = spark.createDataFrame([(kind,) for kind, _ in marks], "kind string")
        versions.replace(first, f"{target}/sources", _KIND, kinds)
        versions.vacuum(spark, f"{target}/sources", _KIND)
        versions.vacuum(spark, target, _folders(grain))
    return days


def read(spark: SparkSession, target: str, grain: tuple[str, ...] = schemas.DAY_PARTITIONS) -> DataFrame | None:
    """The facts as they stand; None before the first run."""
    found = versions.read(spark, target, FACTS, _folders(grain))
    return None if found is None else found.drop(*_folders(grain))


def _facts(
    spark: SparkSession, calls_path: str, reconciled: str, cost_days: DataFrame, days: list[str],
    grain: tuple[str, ...], partitions: tuple[str, ...], length: int,
) -> DataFrame:
    """Facts of the given days, from their call partitions and from the periods that have costs for them."""
    calls = readers.read_table(spark, calls_path, schemas.CALLS, partitions)
    calls = calls.where(F.concat_ws("-", *grain).isin(days))
    if "day" not in partitions:
        calls = calls.withColumn("usage_date", F.substring("timestamp", 1, 10))
    periods = cost_days.where(F.col("mark").isin(days)).select(F.col("part").alias("billing_period")).distinct()
    costs = versions.read(spark, reconciled, schemas.RECONCILED_COSTS, schemas.PERIOD_PARTITIONS, periods)
    if costs is not None:
        costs = costs.where(F.substring("usage_date", 1, length).isin(days))
    facts = dataset.usage_facts(calls, costs)
    return facts.withColumns({f"fact_{name}": F.date_format("day", form) for name, form in _FORMS.items() if name in grain})


def _folders(grain: tuple[str, ...]) -> tuple[str, ...]:
    """Partition columns of the facts, which have a date `day` already."""
    return tuple(f"fact_{g}" for g in grain)


def _grains(spark: SparkSession, days: list[str], grain: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([tuple(d.split("-")) for d in days], ", ".join(f"{g} string" for g in _folders(grain)))


def _call_marks(spark: SparkSession, path: str, grain: tuple[str, ...]) -> DataFrame:
    """(day, mark of its files): paths, lengths and times; no file is opened."""
    listed = files.listing(spark, path, "*.parquet")
    day = F.concat_ws("-", *[F.regexp_extract("path", f"/{g}=([^/]*)/", 1) for g in grain])
    mark = F.concat_ws("/", F.count("*").cast("string"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).cast("string"))
    return listed.groupBy(day.alias("part")).agg(mark.alias("mark"))


def _cost_marks(spark: SparkSession, reconciled: str) -> DataFrame:
    current = versions.manifest(spark, reconciled, schemas.PERIOD_PARTITIONS)
    if current is None:
        return spark.createDataFrame([], _SEEN)
    return current.select(F.col("billing_period").alias("part"), F.col("version").alias("mark"))


def _cost_days(spark: SparkSession, reconciled: str, periods: list[str], length: int) -> DataFrame:
    """(period, day) of the given periods, those that are gone having none."""
    only = spark.createDataFrame([(p,) for p in periods], "billing_period string")
    costs = versions.read(spark, reconciled, schemas.RECONCILED_COSTS, schemas.PERIOD_PARTITIONS, only) if periods else None
    if costs is None:
        return spark.createDataFrame([], _SEEN)
    day = F.substring("usage_date", 1, length)
    return costs.select(F.col("billing_period").alias("part"), day.alias("mark")).distinct()


def _seen(spark: SparkSession, target: str) -> DataFrame:
    found = versions.read(spark, f"{target}/sources", _SEEN, _KIND)
    return spark.createDataFrame([], f"{_SEEN}, kind string") if found is None else found


def _changed(seen: DataFrame, kind: str, now: DataFrame) -> DataFrame:
    """Parts that are new, gone, or made of something else."""
    before = seen.where(F.col("kind") == kind).select(F.col("part").alias("_part"), F.col("mark").alias("_mark"))
    both = now.join(before, F.col("part") == F.col("_part"), "full")
    return both.where(~F.col("mark").eqNullSafe(F.col("_mark"))).select(F.coalesce("part", "_part").alias("part"))
