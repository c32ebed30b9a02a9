"""Tables whose partitions change at once: replace, merge, drop, vacuum, and runs that fail."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spendloom.sources import files, versions

COLUMNS = "k string, v bigint"
KEYS = ("month", "day")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "month string, day string, k string, v bigint")


def content(spark, path):
    return sorted((r["month"], r["day"], r["k"], r["v"]) for r in versions.read(spark, path, COLUMNS, KEYS).collect())


@pytest.fixture
def path(spark, tmp_path):
    target = str(tmp_path / "t")
    versions.replace(rows(spark, ("01", "1", "a", 1), ("01", "2", "b", 2), ("02", "x/y z=%", "c", 3)), target, KEYS)
    return target


def test_partitions_are_replaced_and_emptied(spark, path):
    assert content(spark, path) == [("01", "1", "a", 1), ("01", "2", "b", 2), ("02", "x/y z=%", "c", 3)]
    scope = spark.createDataFrame([("01", "2")], "month string, day string")
    versions.replace(rows(spark, ("01", "1", "d", 4), ("03", "1", "e", 5)), path, KEYS, scope)
    assert content(spark, path) == [("01", "1", "d", 4), ("02", "x/y z=%", "c", 3), ("03", "1", "e", 5)]
    versions.replace(rows(spark).limit(0), path, KEYS, spark.createDataFrame([("01", "1"), ("03", "1"), ("02", "x/y z=%")], "month string, day string"))
    assert content(spark, path) == []


def test_a_run_that_fails_leaves_the_old_version(spark, path):
    before = content(spark, path)
    broken = rows(spark, ("01", "1", "z", 9), ("01", "2", "z", 9)).withColumn("v", F.when(F.col("day") == "2", F.raise_error("stop").cast("bigint")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        versions.replace(broken, path, KEYS)
    assert content(spark, path) == before
    # a manifest that was never completed is not taken, and does not stand in the way
    Path(path, "manifests", "0000000007").mkdir()
    assert content(spark, path) == before
    versions.replace(rows(spark, ("01", "1", "f", 6)), path, KEYS)
    assert ("01", "1", "f", 6) in content(spark, path)


def test_readers_keep_what_they_began_with(spark, path):
    old = versions.read(spark, path, COLUMNS, KEYS)
    versions.replace(rows(spark, ("01", "1", "new", 7)), path, KEYS)
    assert {r["k"] for r in old.collect()} == {"a", "b", "c"}
    versions.vacuum(spark, path, KEYS)
    assert {r["k"] for r in old.collect()} == {"a", "b", "c"}
    versions.replace(rows(spark, ("01", "1", "newer", 8)), path, KEYS)
    versions.vacuum(spark, path, KEYS)
    assert {r["k"] for r in versions.read(spark, path, COLUMNS, KEYS).collect()} == {"newer", "b", "c"}
    assert len(list(Path(path).glob("data/month=01/day=1/*"))) == 2 and len(files.folders(spark, f"{path}/manifests")) == 2


def test_merge_replaces_keys_and_reads_touched_partitions_only(spark, path):
    versions.replace(rows(spark, ("01", "1", "a", 1), ("01", "1", "keep", 2)), path, KEYS)
    untouched = Path(path, "data/month=01/day=2")
    for file in untouched.rglob("*.parquet"):
        file.write_bytes(b"unreadable")
    versions.merge(rows(spark, ("01", "1", "a", 10), ("01", "1", "n", 11), ("09", "1", "m", 12)), path, COLUMNS, ["k"], KEYS)
    now = versions.read(spark, path, COLUMNS, KEYS).where("day = '1'")
    assert sorted((r["month"], r["k"], r["v"]) for r in now.collect()) == [("01", "a", 10), ("01", "keep", 2), ("01", "n", 11), ("09", "m", 12)]


def test_partitions_are_dropped_without_reading(spark, path):
    for file in Path(path).rglob("*.parquet"):
        if "data" in file.parts:
            file.write_bytes(b"unreadable")
    versions.drop(spark, path, KEYS, F.col("month") < "02")
    assert [r["month"] for r in versions.manifest(spark, path, KEYS).collect()] == ["02"]
    versions.vacuum(spark, path, KEYS, keep=1)
    assert sorted(p.name for p in Path(path, "data").glob("month=*/*/*") if p.exists()) == [versions.manifest(spark, path, KEYS).first()["version"].join(["version=", ""])]
    assert versions.read(spark, str(path) + "-none", COLUMNS, KEYS) is None
