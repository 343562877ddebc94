"""Windowed streaming aggregations: plans that run unchanged on a stream or on a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.operators.aggregates import mean2
from scanmill.sources.tables import cents


def flat(w: str = "window") -> list[Column]:
    """Window bounds without time zone, as the tables hold them."""
    return [F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"), F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end")]


def window_counts(
    df: DataFrame, ts: str, length: str, slide: str | None = None, keys: Sequence[str] = (), where: Column | None = None
) -> DataFrame:
    """Rows per window and key.

    With a condition, all rows still move the watermark, so a window closes even when no further row
    meets the condition; a filter in front would stop it.
    """
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    n = F.count("*") if where is None else F.count_if(where)
    out = df.groupBy(w.alias("window"), *keys).agg(n.alias("n")).select(*flat(), *keys, "n")
    return out if where is None else out.filter("n > 0")


def sliding_counts(df: DataFrame, ts: str, length: str, slide: str) -> DataFrame:
    """Rows per sliding window, from tumbling counts of the slide: an event is expanded once, not once per window."""
    small = df.groupBy(F.window(ts, slide).alias("w")).agg(F.count("*").alias("n"))
    g = small.groupBy(F.window("w", length, slide).alias("window")).agg(F.sum("n").alias("n"))
    return g.select(*flat(), "n")


def usage_windows(df: DataFrame, ts: str) -> DataFrame:
    """Daily usage per key and endpoint."""
    g = df.groupBy(F.window(ts, "1 day").alias("window"), "api_key_id", "endpoint").agg(
        F.count("*").alias("request_count"),
        F.count_if(F.col("status_code") >= 400).alias("error_count"),
        F.sum(cents("latency_ms")).alias("latency_hundredths"),
    )
    return g.select(F.to_date("window.start").alias("date"), "api_key_id", "endpoint", "request_count", "error_count", "latency_hundredths")


def session_usage(df: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions separated by a gap: start, last activity, duration and documents."""
    g = df.groupBy(key, F.session_window(ts, gap).alias("session")).agg(
        F.count("*").alias("documents"), F.min(ts).alias("start_time"), F.max(ts).alias("end_time")
    )
    return g.select(
        key, F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"),
        F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")).alias("duration_seconds"), "documents",
    )


def sessions_by_slice(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", slice_seconds: int = 86400) -> DataFrame:
    """As :func:`session_usage`, of a table: sessions inside time slices of a key first, then merged over the slices' borders.

    A hot key's rows go to as many tasks as it has slices; the second step sees one row per session and slice, and gives each
    the gap after its last activity, so sessions merge exactly where those of all rows together would. Activity just one
    gap after the last still belongs to the session. Rows without a time are left out; a null key is a key.
    """
    part = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slice_seconds * 1000000))
    t = df.select(key, F.col(ts).cast("timestamp").alias("_ts"), part.alias("_slice")).filter("_ts IS NOT NULL")
    inside = t.groupBy("_slice", key, F.session_window("_ts", gap).alias("_s")).agg(
        F.count("*").alias("_n"), F.min("_ts").alias("_first"), F.max("_ts").alias("_last")
    )
    micros = F.unix_micros("_s.end") - F.unix_micros("_s.start")
    reach = F.make_interval(secs=(micros.cast("decimal(20,0)") / 1000000).cast("decimal(18,6)"))
    slim = inside.select(key, "_n", "_first", "_last", reach.alias("_reach"))
    g = slim.groupBy(key, F.session_window("_first", F.col("_reach")).alias("_s")).agg(
        F.sum("_n").alias("documents"), F.min("_first").alias("start_time"), F.max("_last").alias("end_time")
    )
    return g.select(
        key, F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"),
        F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")).alias("duration_seconds"), "documents",
    )


# Default request limits as (window, most requests).
LIMITS = [("1 minute", 100), ("1 hour", 500), ("1 day", 5000)]


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("limit", F.lit(limit)).withColumn("exceeded", F.col("n") > limit)


def identifier(user: str, api_key: str, ip: str) -> Column:
    """Who a request counts against: user, else API key, else address."""
    return F.coalesce(
        F.concat(F.lit("user:"), F.col(user).cast("string")), F.concat(F.lit("api_key:"), F.col(api_key).cast("string")), F.col(ip)
    )


def latency_quantile_windows(df: DataFrame, ts: str, value: str, length: str, buckets: Sequence[float]) -> DataFrame:
    """Cumulative latency buckets per time window."""
    counts = [F.count_if(F.col(value) <= float(b)).alias(f"b{i}") for i, b in enumerate(buckets)]
    g = df.groupBy(F.window(ts, length).alias("window")).agg(*counts, F.count("*").alias("binf"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("binf").alias("cum")))
    return g.select(*flat(), F.inline(F.array(*pairs)))


def frame_stats(df: DataFrame) -> DataFrame:
    """Per document type: frames, accepted frames, success rate and mean time of accepted frames."""
    ok = F.col("accepted") & (F.col("document_type") != "Other Document")
    g = df.groupBy("document_type").agg(
        F.count("*").alias("frames"), F.count_if("accepted").alias("accepted_frames"), F.count_if(ok).alias("successes"),
        mean2("processing_time", F.col("accepted")).alias("average_processing_time"),
    )
    return g.withColumn("success_rate", F.col("successes").cast("double") / F.col("frames").cast("double") * 100.0)
