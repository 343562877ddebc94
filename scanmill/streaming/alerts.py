"""Alert rules over per-minute samples, compiled from a table of rules and evaluated in one pass.

A rule compares one term, or two, with a threshold. A term reads a series: as a gauge (its last sample within the width), as an
increase or a rate over the width (counters may restart: a smaller sample than the one before counts from zero), or as a
quantile of a histogram whose buckets are counters. Rules are data: all of them meet the samples in one join on the series,
so a rule more is a row more and not a branch of the plan. A rule fires once it has held for its time without a gap.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Term(NamedTuple):
    series: str
    how: str = "gauge"  # gauge, increase, rate, quantile
    width: int = 1
    q: float | None = None


class Rule(NamedTuple):
    """scale * (left [join right]) + offset, compared with the threshold; `join` is '/' or '-'."""

    alert: str
    left: Term
    right: Term | None
    join: str
    scale: float
    offset: float
    op: str
    threshold: float
    hold: int
    severity: str


def rule(alert: str, left: Term, op: str, threshold: float, hold: int, severity: str, right: Term | None = None, join: str = "/", scale: float = 1.0, offset: float = 0.0) -> Rule:
    return Rule(alert, left, right, join, scale, offset, op, threshold, hold, severity)


# The alert rules of the service and of its monitoring, series with their labels.
RULES = [
    rule("OCRScannerDown", Term('up{job="ocr-scanner"}'), "=", 0.0, 1, "critical"),
    rule("HighResponseTime", Term('flask_request_duration_seconds{quantile="0.95"}'), ">", 2.0, 2, "warning"),
    rule("HighErrorRate", Term("flask_request_exceptions_total", "rate", 5), ">", 0.1, 2, "warning"),
    rule("CriticalErrorRate", Term("flask_request_exceptions_total", "rate", 5), ">", 0.5, 1, "critical"),
    rule("DatabaseConnectionFailures", Term("database_connection_failures_total", "increase", 5), ">", 5.0, 1, "critical"),
    rule("PostgreSQLDown", Term('up{job="postgresql"}'), "=", 0.0, 1, "critical"),
    rule("RedisDown", Term('up{job="redis"}'), "=", 0.0, 1, "critical"),
    rule("RedisMemoryHigh", Term("redis_memory_used_bytes"), ">", 0.9, 2, "warning", Term("redis_memory_max_bytes")),
    rule("HighCPUUsage", Term('node_cpu_seconds_total{mode="idle"}', "rate", 1), ">", 80.0, 2, "warning", scale=-100.0, offset=100.0),
    rule("HighMemoryUsage", Term("node_memory_MemAvailable_bytes"), ">", 0.85, 2, "warning", Term("node_memory_MemTotal_bytes"), scale=-1.0, offset=1.0),
    rule("DiskSpaceLow", Term('node_filesystem_avail_bytes{mountpoint="/"}'), "<", 0.2, 1, "warning", Term('node_filesystem_size_bytes{mountpoint="/"}')),
    rule("DiskSpaceCritical", Term('node_filesystem_avail_bytes{mountpoint="/"}'), "<", 0.1, 1, "critical", Term('node_filesystem_size_bytes{mountpoint="/"}')),
    rule("OCRProcessingFailures", Term("ocr_processing_failures_total", "increase", 10), ">", 10.0, 1, "warning"),
    rule("OCRQueueBacklog", Term("ocr_queue_size"), ">", 100.0, 5, "warning"),
    rule("LongProcessingTime", Term('ocr_processing_duration_seconds{quantile="0.95"}'), ">", 30.0, 2, "warning"),
    rule("RateLimitExceeded", Term("rate_limit_exceeded_total", "increase", 5), ">", 50.0, 1, "warning"),
    rule("UnauthorizedRequests", Term('flask_request_exceptions_total{type="401"}', "increase", 5), ">", 20.0, 1, "warning"),
    rule("SecurityValidationFailures", Term("security_validation_failures_total", "increase", 5), ">", 10.0, 1, "critical"),
    rule("HighErrorRatio", Term("ocr_scanner_errors_total", "rate", 5), ">", 0.05, 5, "critical", Term("ocr_scanner_requests_total", "rate", 5)),
    rule("HighOCRLatency", Term("ocr_processing_duration_seconds_bucket", "quantile", 5, 0.95), ">", 60.0, 10, "warning"),
    rule("DiskSpaceLow10", Term('node_filesystem_avail_bytes{mountpoint="/"}'), "<", 0.1, 5, "critical", Term('node_filesystem_size_bytes{mountpoint="/"}')),
    rule("CeleryQueueBacklog", Term("celery_queue_length"), ">", 100.0, 10, "warning"),
    rule("DatabaseConnectionPoolExhausted", Term("sqlalchemy_pool_checkedout"), ">=", 0.0, 5, "critical", Term("sqlalchemy_pool_size"), "-"),
    rule("ServiceDown", Term('up{job="ocr-scanner"}'), "=", 0.0, 2, "critical"),
]

RULE_SCHEMA = "alert string, joins string, scale double, offset double, op string, threshold double, hold int, severity string"
TERM_SCHEMA = "alert string, side string, series string, how string, width int, q double"


def rule_rows(rules: Sequence[Rule]) -> tuple[list[tuple], list[tuple]]:
    """Rules and their terms as rows; a rule without a right term has no join."""
    heads = [(r.alert, r.join if r.right else None, r.scale, r.offset, r.op, r.threshold, r.hold, r.severity) for r in rules]
    terms = [(r.alert, side, *t) for r in rules for side, t in (("left", r.left), ("right", r.right)) if t]
    if len({h[0] for h in heads}) < len(heads):
        raise ValueError("alert names must differ")
    return heads, terms


def increases(samples: DataFrame) -> DataFrame:
    """Samples with `increase` since the sample before; after a restart, since zero. The first sample has none."""
    before = F.lag("value").over(Window.partitionBy("series", "instance", "le").orderBy("minute"))
    up = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return samples.withColumn("increase", up)


def quantile_of(buckets: str, q: str) -> str:
    """SQL of the quantile of an array of (le, cum), in order, the last le infinite.

    Linear within the bucket that holds the rank; in the bucket without a bound, its lower end.
    """
    total = f"element_at({buckets}, -1).cum"
    walked = (
        f"transform({buckets}, (b, i) -> struct(b.le as le, b.cum as cum, if(i = 0, 0D, {buckets}[greatest(i - 1, 0)].le) as low, "
        f"if(i = 0, 0D, {buckets}[greatest(i - 1, 0)].cum) as under))"
    )
    hit = f"element_at(filter({walked}, b -> b.cum >= {q} * {total}), 1)"
    inside = f"{hit}.low + ({q} * {total} - {hit}.under) / ({hit}.cum - {hit}.under) * ({hit}.le - {hit}.low)"
    return f"case when {total} > 0 then case when {hit}.le = double('inf') then {hit}.low when {hit}.cum = {hit}.under then {hit}.le else {inside} end end"


def evaluate(samples: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(alert, severity, instance, pending_from, firing_from, until, peak) of each period in which a rule fires.

    `samples`: (series, instance, le, minute, value), one a minute at most; `le` is a bucket's bound (null: none above) and null elsewhere.
    The rules are a few rows; the samples are one a minute and instance, whatever the number of events behind them.
    """
    spark = samples.sparkSession
    heads, terms = rule_rows(rules)
    wanted = spark.createDataFrame(terms, TERM_SCHEMA)
    seen = increases(samples).join(wanted, "series")
    spread = seen.withColumn("at", F.explode(F.expr("sequence(minute, minute + width - 1)")))
    one = spread.groupBy("alert", "side", "instance", "at", "how", "width", "q", "le").agg(F.sum("increase").alias("up"), F.max_by("value", "minute").alias("last"))
    value = F.expr("case how when 'gauge' then last when 'rate' then up / (width * 60D) else up end")
    buckets = F.array_sort(F.collect_list(F.struct(F.coalesce("le", F.lit(float("inf"))).alias("le"), F.col("value").alias("cum"))))
    sided = one.withColumn("value", value).groupBy("alert", "side", "instance", "at", "how", "q").agg(F.max("value").alias("value"), buckets.alias("buckets"))
    sided = sided.withColumn("value", F.expr(f"if(how = 'quantile', {quantile_of('buckets', 'q')}, value)"))
    both = sided.groupBy("alert", "instance", "at").agg(*(F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("left", "right")))
    # null where the rule has a right term without a value
    joined = "case when joins = '/' then left / nullif(right, 0) when joins = '-' then left - right else left end"
    held = "case op when '>' then v > threshold when '>=' then v >= threshold when '<' then v < threshold when '=' then v = threshold end"
    on = both.join(spark.createDataFrame(heads, RULE_SCHEMA), "alert").withColumn("v", F.expr(f"scale * ({joined}) + offset")).where(held)
    run = F.col("at") - F.row_number().over(Window.partitionBy("alert", "instance").orderBy("at"))
    periods = on.withColumn("run", run).groupBy("alert", "severity", "instance", "hold", "run").agg(
        F.min("at").alias("pending_from"), F.max("at").alias("until"), F.max_by("v", F.expr("if(op = '<', -v, v)")).alias("peak")
    )
    return periods.where("until - pending_from >= hold").selectExpr("alert", "severity", "instance", "pending_from", "pending_from + hold as firing_from", "until", "peak")
