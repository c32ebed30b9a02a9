"""Inputs: call logs, audit files, billing exports, processed tables, directories."""

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom import schemas
from spendloom.fixed_values import BILLING_HEADERS
from spendloom.functions.common import decode_key
from spendloom.sources import files

CORRUPT = "_corrupt"
BILLING_FILES = "*.{csv,csv.gz}"


def read_call_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON-lines call logs, plain or `.gz`, one row per non-blank line.

    `source_file`, `block_start` and `line_id` order lines as they stand in the files.
    """
    lines = spark.read.text(paths).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    return lines.where(F.trim("value") != "")


def read_audit_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Audit documents, plain or `.gz`, one row per file: parsed `Records`, text and path.

    A document is one JSON value, so a file is the unit of parallelism here.
    """
    documents = spark.read.text(paths, wholetext=True)
    return parse_audit_documents(
        files.together(documents.select("value", F.col("_metadata.file_path").alias("source_file")))
    )


def parse_audit_documents(documents: DataFrame, value: str = "value") -> DataFrame:
    """Add `Records`, NULL when the text is no JSON object or has no such array."""
    fields = schemas.struct_of(schemas.RAW_AUDIT_RECORD).simpleString()
    parsed = F.from_json(F.col(value), f"Records array<{fields}>")
    return documents.withColumn("Records", parsed["Records"])


def read_billing_csv(spark: SparkSession, paths: str | list[str], multiline: bool = True) -> DataFrame:
    """Billing exports (`.csv`, `.csv.gz` only), all values text, short rows padded with ''.

    Every file is read by its own header: files are grouped by their first line, each group is read by it, and
    the groups are united by column name; a column that a file lacks is '' there, as one that a row lacks.
    `multiline=False` makes plain files splittable where no quoted value holds a line break.
    """
    parts = [
        _billing_files(spark, group, multiline, columns) for columns, group in _by_header(spark, billing_files(spark, paths)).items()
    ]
    if not parts:
        return spark.createDataFrame([], "cur_file_key string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).fillna("")


def billing_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The export files of folders or single files; folders are listed by Spark, nothing is opened."""
    return sorted(r["path"] for path in _as_list(paths) for r in files.listing(spark, path, BILLING_FILES).collect())


def _by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their columns.  One line of each file is read; a file without any is left out."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        line = files.first_line(spark, path).lstrip("\ufeff").strip()
        if line:
            groups.setdefault(tuple(next(csv.reader([line]))), []).append(path)
    return groups


def _billing_files(spark: SparkSession, paths: list[str], multiline: bool, columns: tuple[str, ...]) -> DataFrame:
    # of repeated column names the first one keeps its name
    names = [c if c not in columns[:i] else f"{c}.{i}" for i, c in enumerate(columns)]
    rows = (
        spark.read.schema(", ".join(f"`{c.replace('`', '``')}` string" for c in names))
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(paths)
    )
    # what a file says under another name is said under the first name too, so files of all layouts unite
    for first, *others in BILLING_HEADERS.values():
        present = [h for h in others if h in names]
        if first not in names and present:
            rows = rows.withColumn(first, F.col(f"`{present[0]}`"))
    return with_file_key(rows)


def read_billing_parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Billing exports delivered as Parquet; same columns, any primitive type."""
    return with_file_key(spark.read.option("recursiveFileLookup", True).parquet(*_as_list(paths)))


def with_file_key(rows: DataFrame) -> DataFrame:
    """Add the decoded path of the file a row came from."""
    return rows.withColumn("cur_file_key", decode_key(F.col("_metadata.file_path")))


def read_table(spark: SparkSession, path: str, columns: str, partitions: tuple[str, ...] = ()) -> DataFrame:
    """A processed Parquet table with its declared schema; partition values stay text."""
    declared = schemas.struct_of(columns).names
    parts = "".join(f", {p} string" for p in partitions if p not in declared)
    return spark.read.schema(columns + parts).parquet(path)


def read_directory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Directory users, JSON lines."""
    return spark.read.schema(schemas.DIRECTORY_USERS).json(paths)


def _as_list(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)
