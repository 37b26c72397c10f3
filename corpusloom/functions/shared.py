"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DIR = "/tmp/checkpoints/corpusloom-tables"


class Tables:
    """Tables of one run under the folder of ``spark.checkpoint.dir``; a local session without that setting has its own.

    A written table cuts lineage, is computed once and outlives the loss of executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        context = spark.sparkContext
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        self.spark = spark
        self.root = f"{(folder or LOCAL_DIR).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all cores by ``keys`` before work that costs much per row or holds many rows at once.

    A file is read in as many tasks as it has row groups, few at any size; a number of partitions that is asked for is
    not coalesced either.
    """
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches by bytes, so that long rows do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, tables: Tables, most: int, name: str = "large") -> DataFrame:
    """Inner join by ``key``, without a broadcast; a key of more than ``most`` pairs is dealt to several tasks by the left column ``by``.

    ``name`` is that of the table of such keys, one for each join of a run.  Sides are small beside their pairs, so
    partitions are not coalesced by the sides' sizes.
    """
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    ways = F.ceil(F.col("n") * F.col("m") / most).cast("int")
    large = tables.save(count(left, "n").join(count(right, "m").hint("merge"), key).select(key, ways.alias("ways")).where("ways > 1"), name)
    known = F.coalesce("ways", F.lit(1))
    left = left.join(large, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), known).cast("int")).drop("ways")
    right = right.join(large, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), known - 1))).drop("ways")
    return spread(left, key, "salt").join(right.hint("merge"), [key, "salt"]).drop("salt")
