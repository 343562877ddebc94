"""Rows that a watermark dropped, kept as a table."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query_id string, run_id string, query_name string, batch_id bigint, operator int, dropped bigint"


class DroppedRows(StreamingQueryListener):
    """Writes a row for each batch and stateful operator that dropped rows, in the table's folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = [(i, o.numRowsDroppedByWatermark) for i, o in enumerate(p.stateOperators)]
        rows = [(str(p.id), str(p.runId), p.name, p.batchId, i, n) for i, n in dropped if n]
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextlib.contextmanager
def counting_dropped(spark: SparkSession, folder: str) -> Iterator[None]:
    """Counts dropped rows of all streams that run inside, in the table at ``folder``.

    Progress is reported behind the batches; the bus is drained before the listener goes, so no batch is missed.
    """
    listener = DroppedRows(spark, folder)
    spark.streams.addListener(listener)
    try:
        yield
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(listener)


def dropped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query_name, batch_id, dropped): a batch that ran again counts once."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    once = rows.groupBy("query_id", "query_name", "batch_id", "operator").agg(F.max("dropped").alias("dropped"))
    return once.groupBy("query_id", "query_name", "batch_id").agg(F.sum("dropped").alias("dropped"))
