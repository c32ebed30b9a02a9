"""Registered queries: every operator run over the given tables, with SQL to check it."""

from spendloom.registry import views  # noqa: F401  (defines the check views)
from spendloom.registry import columns, files, joins, reports  # noqa: F401
from spendloom.registry.core import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
