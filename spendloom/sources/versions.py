"""Partitioned tables whose partitions are replaced as a whole, at once or not at all.

Every write puts its files into new folders, `data/<partition>/version=<id>`, and then writes a manifest, the list of
the current version of every partition. Readers take the newest complete manifest, so they see all of a
write or nothing of it, and a run that fails half-way leaves the table as it was. Files of versions no longer listed
stay until `vacuum`, for readers that began before.

A manifest has one row per partition; its size follows the number of partitions, not the rows. A table has one writer
at a time.
"""

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spendloom.schemas import struct_of
from spendloom.sources import files

VERSION = "version"
#: Manifests that stay readable.
KEEP = 2


def read(
    spark: SparkSession, path: str, columns: str, partitions: tuple[str, ...], only: DataFrame | None = None
) -> DataFrame | None:
    """The current rows, partition values as text; None if nothing was ever written.

    Only the folders of current versions are listed, with `only` (partition columns) just those of its partitions.
    """
    current = manifest(spark, path, partitions)
    if current is None:
        return None
    if only is not None:
        current = current.join(only, _same(current, only, partitions), "left_semi")
    declared = struct_of(columns).names
    schema = columns + "".join(f", {p} string" for p in (*partitions, VERSION) if p not in declared)
    listed = [_folder(path, row, partitions) for row in current.collect()]
    if not listed:
        return spark.createDataFrame([], schema).drop(VERSION)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*listed).drop(VERSION)


def manifest(spark: SparkSession, path: str, partitions: tuple[str, ...]) -> DataFrame | None:
    """(partition columns, version) of the newest complete write."""
    numbers = _manifests(spark, path)
    if not numbers:
        return None
    return spark.read.schema(_manifest_schema(partitions)).parquet(_manifest_path(path, numbers[-1]))


def replace(rows: DataFrame, path: str, partitions: tuple[str, ...], scope: DataFrame | None = None) -> None:
    """Replace the partitions that occur in `rows`, and those listed in `scope`, which may be empty from now on."""
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    marked = rows.withColumn(VERSION, F.lit(version))
    marked.hint("rebalance", *partitions).write.mode("append").partitionBy(*partitions, VERSION).parquet(f"{path}/data")
    written = spark.read.schema(_manifest_schema(partitions)).parquet(f"{path}/data").where(F.col(VERSION) == version).distinct()
    _switch(spark, path, partitions, written, written if scope is None else written.drop(VERSION).unionByName(scope.select(*partitions)).distinct())


def merge(rows: DataFrame, path: str, columns: str, keys: list[str], partitions: tuple[str, ...]) -> None:
    """Replace the rows of the same keys and add the others; `rows` has one row per key.

    Only the partitions that occur in `rows` are read and written.
    """
    stored = read(rows.sparkSession, path, columns, partitions, rows.select(*partitions).distinct())
    if stored is not None:
        kept = stored.join(rows, _same(stored, rows, (*keys, *partitions)), "left_anti")
        rows = rows.unionByName(kept.select(*rows.columns))
    replace(rows, path, partitions)


def drop(spark: SparkSession, path: str, partitions: tuple[str, ...], condition: Column) -> None:
    """Take the partitions that meet a condition on partition columns out of the table; no row is read."""
    current = manifest(spark, path, partitions)
    if current is not None:
        gone = current.where(condition)
        _switch(spark, path, partitions, gone.limit(0), gone)


def vacuum(spark: SparkSession, path: str, partitions: tuple[str, ...], keep: int = KEEP) -> None:
    """Delete old manifests and the versions that none of the newest `keep` lists."""
    numbers = _manifests(spark, path)
    listed = set()
    for number in numbers[-keep:]:
        rows = spark.read.schema(_manifest_schema(partitions)).parquet(_manifest_path(path, number)).collect()
        listed |= {_folder(path, row, partitions) for row in rows}
    for number in files.folders(spark, f"{path}/manifests"):
        if int(number) not in numbers[-keep:]:
            files.delete(spark, f"{path}/manifests/{number}")
    for folder in _version_folders(spark, f"{path}/data", len(partitions)):
        if folder not in listed:
            files.delete(spark, folder)


def _switch(spark: SparkSession, path: str, partitions: tuple[str, ...], written: DataFrame, replaced: DataFrame) -> None:
    """Write the next manifest; Spark marks it complete when all of it is there."""
    listed = written.select(*partitions, VERSION)
    old = manifest(spark, path, partitions)
    if old is not None:
        listed = listed.unionByName(old.join(replaced, _same(old, replaced, partitions), "left_anti"))
    begun = [int(n) for n in files.folders(spark, f"{path}/manifests")]
    listed.coalesce(1).write.parquet(_manifest_path(path, max(begun, default=0) + 1))


def _same(one: DataFrame, two: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [one[c].eqNullSafe(two[c]) for c in names]


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests; one without a success mark was never finished."""
    return [int(n) for n in files.folders(spark, f"{path}/manifests") if files.exists(spark, f"{path}/manifests/{n}/_SUCCESS")]


def _manifest_path(path: str, number: int) -> str:
    return f"{path}/manifests/{number:010d}"


def _manifest_schema(partitions: tuple[str, ...]) -> str:
    return ", ".join(f"{p} string" for p in (*partitions, VERSION))


def _folder(path: str, row: Row, partitions: tuple[str, ...]) -> str:
    name = SparkSession.active()._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join([f"{path}/data", *(name(p, row[p]) for p in (*partitions, VERSION))])


def _version_folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    if depth < 0:
        return [path]
    return [f for name in files.folders(spark, path) for f in _version_folders(spark, f"{path}/{name}", depth - 1)]
