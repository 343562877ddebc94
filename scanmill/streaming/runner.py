"""Running a streaming plan to the end of its input and reading the result back."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanmill.session import shared_folder as base_folder
from scanmill.sources.tables import SCHEMAS


def shared_folder(spark: SparkSession) -> str:
    """New folder under the one the cluster names for checkpoints."""
    return f"{base_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a file stream; ``sf_dir`` holds one file, a folder of part files or ordered files of that name.

    The name is matched on the entries of ``sf_dir`` alone: part files have names of their own.
    """
    r = spark.readStream.schema(SCHEMAS[name]).option("recursiveFileLookup", "true")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(f"{sf_dir}/{name}*.parquet")


def timed(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Event time with a watermark: rows later than the delay are dropped and counted by the engine."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(df: DataFrame, large: bool = False) -> Iterator[None]:
    """The RocksDB store for plans with transformWithState, which need it, and for ``large`` state, which the default store holds in memory.

    A stream takes the store that is set when it starts.
    """
    spark = df.sparkSession
    if not large and "TransformWithState" not in df._jdf.queryExecution().logical().toString():
        yield
        return
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


_LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


@contextlib.contextmanager
def local_sessions(df: DataFrame) -> Iterator[None]:
    """Sessions are merged inside each input task before the shuffle, so a hot key sends its sessions, not its rows."""
    spark = df.sparkSession
    before = spark.conf.get(_LOCAL_SESSIONS, "false")
    spark.conf.set(_LOCAL_SESSIONS, "true")
    try:
        yield
    finally:
        spark.conf.set(_LOCAL_SESSIONS, before)


def run_append(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Append results of everything available now; ``folder`` (a new one by default) holds them and, in ``_state``, the state."""
    spark = df.sparkSession
    out = folder or shared_folder(spark)
    with rocksdb(df):
        q = (
            df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/_state")
            .trigger(availableNow=True).start(f"{out}/rows")
        )
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def run_update(df: DataFrame, keys: list[str], folder: str | None = None, large: bool = False) -> DataFrame:
    """Latest update of each key after everything available now: batches are written, the newest row per key wins.

    ``large`` keeps the state on disk, for keys that grow with the input.
    """
    spark = df.sparkSession
    out = folder or shared_folder(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a retried batch harmless.
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/rows/b={batch_id}")

    with rocksdb(df, large):
        q = df.writeStream.outputMode("update").option("checkpointLocation", f"{out}/_state").foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    values = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*values), F.col("_batch")).alias("_v")
    return rows.groupBy(*keys).agg(best).select(*keys, "_v.*")
