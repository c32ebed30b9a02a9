"""Registered queries against their SQL on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
NAMES = [name for name in entry.registry.QUERIES]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted([cell(row[i]) for i in order] for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    expected = table_of([d[0] for d in cursor.description], cursor.fetchall())
    df = entry.queries()[name](spark, SF_DIR)
    assert table_of(df.columns, df.collect()) == expected


def test_every_query_has_a_check():
    assert set(entry.registry.QUERIES) == set(entry.registry.CHECKS)


def test_every_survey_operator_is_registered():
    ids = {name.split("_")[0] for name in entry.queries()}
    spans = {"s": 9, "k": 7, "p": 32, "f": 12, "j": 11, "a": 27, "w": 6, "t": 5, "u": 2, "st": 6, "q": 8}
    wanted = {f"{kind}{i}" for kind, n in spans.items() for i in range(1, n + 1)}
    assert wanted <= ids
