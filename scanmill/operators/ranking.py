"""Top-k, best-of and merge-by-rank operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_users(df: DataFrame, n: int = 3) -> DataFrame:
    return df.groupBy("user_id").agg(F.count("*").alias("scans")).orderBy(F.desc("scans"), "user_id").limit(n)


def top_k_per(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key; the rank limit is applied before and after the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def candidate_score(text: Column, confidence: Column, seconds: Column) -> Column:
    """Score of a recognised text: confidence, length, character variety and speed."""
    return (
        confidence * 0.4
        + F.least(F.length(text), F.lit(100)).cast("double") / 100.0 * 20.0
        + F.least(F.size(F.array_distinct(F.split(F.lower(text), ""))), F.lit(20)).cast("double") / 20.0 * 20.0
        + F.greatest(F.lit(0.0), 20.0 - seconds) / 20.0 * 20.0
    )


def best_candidate(df: DataFrame, key: str, candidate: str, score: Column) -> DataFrame:
    """Best candidate per key by score; the lower candidate number wins a tie."""
    best = F.max_by(F.struct(candidate, "_s"), F.struct(F.col("_s"), -F.col(candidate)))
    return df.withColumn("_s", score).groupBy(key).agg(best.alias("_b")).select(
        key, F.col(f"_b.{candidate}").alias(candidate), F.col("_b._s").alias("score")
    )


def merge_union(entries: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """First context wins per key."""
    first = F.min_by(F.struct(*values), F.struct(*order))
    return entries.groupBy(*keys).agg(first.alias("_v")).select(*keys, "_v.*")


def merge_weighted(entries: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Highest confidence decayed by the context's age wins; ties keep the earlier context."""
    w = F.col("confidence") * (F.lit(1.0) / (F.lit(1.0) + F.col("age_seconds").cast("double") / 3600.0))
    e = entries.withColumn("_w", w)
    best = F.min_by(F.struct("_w", "source", *values), F.struct(-F.col("_w"), *order))
    return e.groupBy(*keys).agg(best.alias("_v")).select(
        *keys,
        *[F.col(f"_v.{v}").alias(v) for v in values],
        F.col("_v._w").alias("confidence"),
        F.concat(F.lit("merged:"), F.col("_v.source")).alias("source"),
    )
