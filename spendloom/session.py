"""Session settings the library relies on, and the shared folder for written results."""

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings; all are session-level and safe to set on a running cluster session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # '01' must stay text in year/month/day/hour partition values.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # state of streams on local disks and in checkpoints, not on the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-node session for tests and the benchmark.  Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spendloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # no Python call sites per column: plans build faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder named in `spark.checkpoint.dir`, which all executors share.

    Only a local session may run without that setting; it gets a folder of its own.
    """
    return f"{_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder from now on; Spark removes the files with the frame
    (`spark.cleaner.referenceTracking.cleanCheckpoints`)."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = context.getConf().get("spark.checkpoint.dir")
        if base is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="spendloom-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir().rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing refers to any more; it looks for them when the driver's
    garbage is collected, which may be long after several large steps have filled the disks.  What the first
    collection hands to the finalizers, which take a moment, the second one frees."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
    spark.sparkContext._jvm.System.gc()


@contextmanager
def intermediate(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """`df` written to the shared folder and read back, for jobs that use it several times.

    It is computed once, survives lost executors, and is deleted when the job leaves the block.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    try:
        # small row groups, so that a single file is read by all cores
        df.write.option("parquet.block.size", 4 << 20).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
