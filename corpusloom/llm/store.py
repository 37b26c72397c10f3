"""Intermediate tables in the cluster's shared folder.

A written table cuts lineage and survives the loss of executors.  The folder
is the one the cluster names in ``spark.checkpoint.dir``; only where that is
unset (tests, a laptop) does ``DEFAULT_DIR`` stand in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_DIR = "/tmp/checkpoints/corpusloom"
HASH_STEPS = 1 << 30
#: tables that a run writes between two collections of the driver's garbage
TABLES_PER_COLLECTION = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; raises ValueError where executors could not share the default one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or DEFAULT_DIR


def smallest_hashes(rows: DataFrame, hash_col: str, about: int) -> DataFrame:
    """About ``about`` rows of distinct hashes, those below a threshold; all rows, if there are no more.

    A count and a filter: no rows are sorted or sent to one task.
    """
    n = rows.count()
    if n <= about:
        return rows
    return rows.where(F.pmod(F.col(hash_col), F.lit(HASH_STEPS)) < int(HASH_STEPS * about / n))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


class Scratch:
    """Tables of one operator run: ``save`` writes and rereads, ``drop`` deletes early.

    Plans, task states and broadcasts of tables that are written are garbage of the driver.  A run of many small jobs
    on many partitions would fill its heap with them before the JVM collects; so it is asked to every few tables,
    which also lets Spark's cleaner delete the shuffle files of finished jobs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.saved = spark, 0
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.saved += 1
        if self.saved % TABLES_PER_COLLECTION == 0:
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches by bytes, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
