"""What the corpus operators share: words, table reading, and checkpoints in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: Joins run by hash if no shuffled partition of one side is larger.
SMALL_PARTITION = "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, split at ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row however often it is used."""
    return F.transform(F.array(value), use)[0]


def removed(text: Column, chars: str) -> Column:
    """How many characters of the text are in chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def needs_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; only a local session may run without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder from now on; Spark cleans the files up
    when the frame is no longer used (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    needs_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles and checkpoints that nothing refers to. It does so when the driver's
    garbage is collected, which may be long after a job of many small steps has filled the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def hash_joins(spark: SparkSession) -> Iterator[None]:
    """While it lasts, joins of small partitions need no sort. A sort takes a whole page of an executor's heap on either
    side (16 MB, say) however few rows it has, so the many joins of small tables fill the heap with empty pages. Spark
    decides by the sizes it has measured; joins with a larger partition are sorted and may spill as before."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, SMALL_PARTITION)
    try:
        yield
    finally:
        spark.conf.set(name, before)


Batches = Iterator[pd.DataFrame]


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """work, which returns freed memory to the system before and after. Python workers live on from task to task and
    from one operator to the next, and each would keep the most that it ever took."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    def run(batches: Batches) -> Batches:
        give_back()
        yield from work(batches)
        give_back()

    return run


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach."""
    needs_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()
