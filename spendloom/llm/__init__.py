"""Operators for large text corpora: quality, dedup, scans, scoring, search, archives, extraction, packing."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the jobs, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
