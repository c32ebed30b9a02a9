"""Registration of queries and the SQL text that checks them."""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query under its operator id; `check` is SQL over the given tables and VIEWS."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = with_views(check)
        return fn

    return add


def with_views(sql: str) -> str:
    """Put the views a statement uses in front of it, in the order they were defined."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    if not needed:
        return sql
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    if sql.lstrip().startswith("WITH "):
        return f"WITH {parts},\n{sql.lstrip()[5:]}"
    return f"WITH {parts}\n{sql}"


def r4(c: Column | str) -> Column:
    """Four decimals for comparison, with the halves of both engines pushed the same way."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e4 + 0.5001) / 1e4


def r4_sql(expr: str) -> str:
    return f"floor(({expr}) * 1e4 + 0.5001) / 1e4"


def r9(c: Column) -> Column:
    """Nine decimals, for shares and proportions."""
    return F.floor(c * 1e9 + 0.5001) / 1e9


def r9_sql(expr: str) -> str:
    return f"floor(({expr}) * 1e9 + 0.5001) / 1e9"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named columns for comparison."""
    return df.withColumns({n: r4(F.col(f"`{n}`")) for n in names})
