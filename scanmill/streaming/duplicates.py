"""New hashes checked against registered ones, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.operators.duplicates import earliest_within

HASH_SCHEMA = "h BIGINT, first_id BIGINT"


def match_registered(new: DataFrame, registered: DataFrame, distance: int = 5) -> DataFrame:
    """Earliest registered hash within the distance of each new hash; both sides hold distinct hashes."""
    found = earliest_within(new, registered, distance)
    return found.select(F.col("first_id").alias("id"), F.col("m.id").alias("matching_id"), F.col("m.distance").alias("distance"))


def run_stream_duplicates(hashes: DataFrame, folder: str) -> DataFrame:
    """(id, matching_id, distance) of each arrival (h, id) with an earlier one within the distance: the earliest of them.

    Arrival is by id. A batch is checked against the registry and itself, and only hashes that are new go into the registry,
    so the cut into batches does not change the result. Rewriting the batch's own folders makes a retried batch harmless.
    """
    spark: SparkSession = hashes.sparkSession

    def batch(df: DataFrame, n: int) -> None:
        rows = df.select("id", "h").persist()
        new = rows.groupBy("h").agg(F.min("id").alias("first_id"))
        fresh = pool = new
        if n:
            past = spark.read.schema(HASH_SCHEMA).parquet(*[f"{folder}/registry/b={k}" for k in range(n)])
            fresh = new.join(past, "h", "left_anti")
            pool = past.unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{folder}/registry/b={n}")
        found = earliest_within(new, pool).select("h", "m")
        # Cached rows are taken for their size when packed, which says little of them in a broadcast.
        out = rows.hint("merge").join(found, "h").where("m.id < id").select("id", F.col("m.id").alias("matching_id"), F.col("m.distance").alias("distance"))
        out.write.mode("overwrite").parquet(f"{folder}/matches/b={n}")
        rows.unpersist()

    q = hashes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("id BIGINT, matching_id BIGINT, distance INT").option("recursiveFileLookup", "true").parquet(f"{folder}/matches")
