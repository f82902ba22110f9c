"""Reading tables so that all cores get a share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker gets at once: it holds a batch's texts and all that is found in them.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Have Python workers get at most BATCH_ROWS rows at once from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows. One that is read in fewer tasks than there are cores is dealt over all cores.

    A Parquet file is split between row groups only, so one file is often one
    task. Tables of more tasks, and so of many bytes or files, are read as they are.
    """
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
