"""A fact partitioned by day and batch: adding a batch again replaces it, and only the days that it holds are written.

Counters are kept per batch and summed when read, so an increment needs no read of what is stored. Days that are no
longer kept are folders to be deleted; no row is read or rewritten for it.
"""

from __future__ import annotations

import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def add_batch(rows: DataFrame, path: str, batch: str, day: str = "date") -> None:
    """Write the rows of a batch. A batch that is added again must hold the same days; rows without a day are a day of their own.

    Each day goes to one or, where it is large, several tasks by AQE, so a day of a batch is few files.
    """
    out = rows.withColumn("batch", F.lit(batch)).hint("rebalance", day)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch").parquet(path)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of all batches, with the name of the batch."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(path)


def drop_days_before(spark: SparkSession, path: str, first: datetime.date, day: str = "date") -> list[datetime.date]:
    """Delete the days before `first` and name them; rows without a day stay."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(root):
        name = unquote(s.getPath().getName())
        value = name.removeprefix(f"{day}=")
        if value == name or value == "__HIVE_DEFAULT_PARTITION__":
            continue
        if datetime.date.fromisoformat(value) < first:
            fs.delete(s.getPath(), True)
            gone.append(datetime.date.fromisoformat(value))
    return sorted(gone)
