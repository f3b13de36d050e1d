"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenfold.sources.tables import shared_dir

#: Rows of one 64-bit key that may be broadcast (16 MB raw); more go through a shuffle.
BROADCAST_KEYS = 1_000_000


#: Rows of an Arrow batch. Texts can be long, so the session's usual 10,000 rows could take hundreds of MB.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get at most BATCH_ROWS rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables written under one folder of their own, so that lineage is cut and lost executors cost no rework."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lumenfold-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write df and return what was written."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, and let Spark's cleaner find the shuffle files of finished plans.

        The cleaner only sees what the driver's collector has found; by itself that may take as long as the driver has memory left.
        """
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(conf).delete(p, True)
        jvm.System.gc()
