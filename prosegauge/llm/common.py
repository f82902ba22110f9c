"""What the operators share: where intermediate tables go, and text helpers with fixed byte rules."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The bytes 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: What may be sent to every executor; a larger side takes a shuffle instead.
BROADCAST_BYTES = 64 << 20
#: Parts that the rows of one key are dealt into where they ask a table.
SALTS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (local sessions only) a fresh temporary one; an error on a cluster without one."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-prosegauge-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Python workers get at most so many rows at once from now on: documents are large, and a worker holds a whole batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else kept. lower() does just that where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores before it as it takes to be no column, in upper or lower case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, key: str, table: DataFrame, how: str = "left", by: list[str] | None = None) -> DataFrame:
    """rows joined with table(key, ...), which has each key once, by how (left or inner); a key that very many rows share is no single task's.

    Rows are dealt by their key and a salt taken from `by` (the whole row where
    it isn't given), which tells rows of one key apart. The table's row goes only to the (key, salt) pairs that occur: at most SALTS of a key.
    Small tables are merged too: each broadcast is a thread, and pages of its own, of the driver's.
    """
    (salt,) = unused(rows.columns + table.columns, "salt")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*(by or rows.columns)), F.lit(SALTS)).cast("int"))
    asked = rows.select(key, salt).where(F.col(key).isNotNull()).distinct().join(table.hint("merge"), key)
    return rows.join(asked.hint("merge"), [key, salt], how).drop(salt)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
