"""Dashboard aggregations over the scan log, batches, API usage and latencies.

Sums run over whole hundredths (BIGINT), so results do not depend on the order tasks finish in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.operators.filters import apply_filters
from scanmill.sources.tables import cents

def ok() -> Column:
    """A scan succeeded when it left no error."""
    return F.col("error_message").isNull()



def ts(literal: str) -> Column:
    return F.lit(literal).cast("timestamp_ntz")


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def mean2(c: str | Column, where: Column | None = None) -> Column:
    """Mean of a two-decimal column from exact sums."""
    v = cents(c)
    if where is not None:
        v = F.when(where, v)
    return F.sum(v).cast("double") / F.count(v).cast("double") / F.lit(100.0)


def pct(part: Column, whole: Column) -> Column:
    """part/whole*100 with a zero guard."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100.0).otherwise(F.lit(0.0))


def overview(df: DataFrame, start: str, end: str) -> DataFrame:
    """Totals of [start, end] and growth against the period of equal length before it, in one scan."""
    s, e = ts(start), ts(end)
    prev = s - (e - s)
    cur = (F.col("created_at") >= s) & (F.col("created_at") <= e)
    a = df.filter((F.col("created_at") >= prev) & (F.col("created_at") <= e)).agg(
        F.count_if(cur).alias("total_scans"),
        F.count_if(cur & ok()).alias("successful_scans"),
        mean2("processing_time", cur).alias("avg_processing_time"),
        F.count_if(F.col("created_at") < s).alias("_prev"),
    )
    return a.select(
        "total_scans",
        "successful_scans",
        pct(F.col("successful_scans"), F.col("total_scans")).alias("success_rate"),
        F.coalesce("avg_processing_time", F.lit(0.0)).alias("avg_processing_time"),
        pct(F.col("total_scans") - F.col("_prev"), F.col("_prev")).alias("growth_rate"),
        F.datediff(e, s).cast("bigint").alias("period_days"),
    )


def summary(df: DataFrame, days: int, as_of: str) -> DataFrame:
    w = df.filter(F.col("created_at") >= days_before(ts(as_of), days))
    return w.agg(
        F.count("*").alias("total"),
        F.count_if(ok()).alias("success"),
        F.count_if(~ok()).alias("failed"),
        pct(F.count_if(ok()), F.count("*")).alias("success_rate"),
        mean2("processing_time", ok()).alias("avg_processing_time"),
        mean2("confidence_score").alias("avg_confidence"),
    )


def daily_trends(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count("*").alias("scans"), mean2("processing_time").alias("avg_processing_time"))
        .orderBy("day")
    )


def hourly_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("scans")).orderBy("hour")


def type_stats(df: DataFrame) -> DataFrame:
    g = df.groupBy(F.coalesce("document_type", F.lit("Unknown")).alias("document_type")).agg(
        F.count("*").alias("scans"), mean2("processing_time").alias("avg_processing_time")
    )
    return g.withColumn("percentage", share_of_total(F.col("scans"))).orderBy(F.desc("scans"), "document_type")


def share_of_total(c: Column) -> Column:
    """Percent of the total over an already aggregated table (one row per group)."""
    total = F.sum(c).over(Window.partitionBy())
    return c.cast("double") / total.cast("double") * 100.0


def perf(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("processing_time").alias("min_time"),
        F.max("processing_time").alias("max_time"),
        mean2("processing_time").alias("avg_time"),
        F.count("processing_time").alias("samples"),
    )


def error_analysis(df: DataFrame) -> DataFrame:
    g = df.groupBy("error_message").agg(F.count("*").alias("occurrences"))
    total = F.sum("occurrences").over(Window.partitionBy())
    return (
        g.withColumn("total_scans", total)
        .withColumn("share", F.col("occurrences").cast("double") / F.col("total_scans").cast("double") * 100.0)
        .filter(F.col("error_message").isNotNull())
        .orderBy(F.desc("occurrences"), "error_message")
    )


def processing_metrics(df: DataFrame) -> DataFrame:
    """Totals, counts by type and counts by error as long rows, from one scan with grouping sets.

    Zero and missing values are left out of the means. Long rows keep free-text error messages
    from piling up in one map value.
    """
    df = df.withColumn("k_ok", ok())  # grouping sets null out the grouped copy of error_message
    t, c = F.col("processing_time"), F.col("confidence_score")
    d, e = F.col("document_type"), F.col("error_message")
    g = df.groupingSets([[], [d], [e]], d, e).agg(
        F.grouping_id().alias("_gid"),
        F.count("*").alias("documents"),
        F.count_if(F.col("k_ok")).alias("successful"),
        F.coalesce(mean2("processing_time", t != 0), F.lit(0.0)).alias("average_processing_time"),
        F.coalesce(mean2("confidence_score", c != 0), F.lit(0.0)).alias("average_confidence"),
    )
    section = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "document_type").otherwise("error_type")
    key = F.when(F.col("_gid") == 1, d).when(F.col("_gid") == 2, e)
    return (
        g.filter((F.col("_gid") == 3) | (key != ""))
        .select(
            section.alias("section"),
            key.alias("key"),
            "documents",
            "successful",
            (F.col("documents") - F.col("successful")).alias("failed"),
            pct(F.col("successful"), F.col("documents")).alias("success_rate"),
            "average_processing_time",
            "average_confidence",
        )
    )


def quality_bands(df: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    return df.filter(q != 0).agg(
        F.coalesce(mean2("quality_score"), F.lit(0.0)).alias("average_quality_score"),
        F.count_if((q >= 0) & (q < 0.3)).alias("poor"),
        F.count_if((q >= 0.3) & (q < 0.6)).alias("fair"),
        F.count_if((q >= 0.6) & (q < 0.8)).alias("good"),
        F.count_if((q >= 0.8) & (q <= 1.0)).alias("excellent"),
        F.count_if(q < 0.5).alias("low_quality_count"),
        F.count_if(q >= 0.8).alias("high_quality_count"),
    )


# Band labels, low to high.
QUALITY_LABELS = ["Very Poor", "Poor", "Fair", "Good", "Excellent"]


def quality_histogram5(df: DataFrame) -> DataFrame:
    band = F.least(F.floor(F.col("quality_score") * 5), F.lit(4)).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in QUALITY_LABELS]), F.col("band") + 1)
    g = df.filter(F.col("quality_score").isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("scans"))
    return g.select("band", label.alias("label"), "scans").orderBy("band")


def sessions(df: DataFrame) -> DataFrame:
    """Usage sessions of the scan log: one row per session id."""
    return df.groupBy("session_id").agg(
        F.min("created_at").alias("start_time"),
        F.max("created_at").alias("end_time"),
        F.first("user_id").alias("user_id"),
        F.count("*").alias("documents"),
    )


def usage(df: DataFrame) -> DataFrame:
    """Session totals, distinct actors, peak hour, busiest weekday and mean duration in whole seconds."""
    s = sessions(df).select(
        "user_id",
        F.hour("start_time").alias("hour"),
        F.date_format("start_time", "EEEE").alias("weekday"),
        F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")).alias("secs"),
    )
    # Grouping by hour and weekday first leaves at most 168 rows for the single final task.
    grid = s.groupBy("hour", "weekday").agg(
        F.count("*").alias("n"), F.sum("secs").alias("secs"), F.count_if(F.col("secs") != 0).alias("timed")
    )
    hours = grid.groupBy("hour").agg(F.sum("n").alias("n"))
    days = grid.groupBy("weekday").agg(F.sum("n").alias("n"))
    top = lambda g, c: g.agg(F.max_by(c, F.struct("n", c)).alias(c))
    totals = grid.agg(
        F.sum("n").alias("total_sessions"),
        F.when(F.sum("timed") > 0, F.sum("secs").cast("double") / F.sum("timed").cast("double"))
        .otherwise(0.0)
        .alias("average_session_duration"),
    )
    # The other figures are single values: scalar subqueries, not joins.
    return totals.select(
        "total_sessions",
        df.agg(F.countDistinct("user_id")).scalar().alias("active_users"),
        F.format_string("%02d:00", top(hours, "hour").scalar()).alias("peak_usage_time"),
        top(days, "weekday").scalar().alias("peak_weekday"),
        "average_session_duration",
    )


def user_activity(df: DataFrame, start: str, end: str) -> DataFrame:
    per_user = df.filter(F.col("created_at") <= ts(end)).groupBy("user_id").agg(
        F.min("created_at").alias("first_seen"), F.count_if(F.col("created_at") >= ts(start)).alias("n")
    )
    return per_user.filter("n > 0").agg(
        F.count("*").alias("active_users"),
        F.count_if(F.col("first_seen") >= ts(start)).alias("new_users"),
        F.count_if(F.col("first_seen") < ts(start)).alias("returning_users"),
        (F.sum("n").cast("double") / F.count("*").cast("double")).alias("avg_scans_per_user"),
    )


# Cost of one document and the recommendation texts.
COST_PER_DOCUMENT = 0.05
RECOMMENDATIONS = {
    "success": "Improve OCR accuracy - success rate below 80%",
    "quality": "Implement image quality guidelines for users",
    "time": "Optimize processing pipeline - average time too high",
    "bands": "Focus on image enhancement algorithms",
    "none": "System performance is optimal",
}


def business_insights(df: DataFrame) -> DataFrame:
    q, t = F.col("quality_score"), F.col("processing_time")
    a = df.agg(
        F.count("*").alias("n"),
        F.count_if(ok()).alias("ok"),
        mean2("processing_time", t != 0).alias("avg_t"),
        mean2("quality_score", q != 0).alias("avg_q"),
        F.count_if((q != 0) & (q < 0.5)).alias("low"),
        F.count_if(q >= 0.8).alias("high"),
    )
    eff = F.col("ok").cast("double") / F.col("n").cast("double")
    rec = F.array_compact(
        F.array(
            F.when(eff * 100.0 < 80, RECOMMENDATIONS["success"]),
            F.when(F.col("avg_q") < 0.6, RECOMMENDATIONS["quality"]),
            F.when(F.col("avg_t") > 10, RECOMMENDATIONS["time"]),
            F.when(F.col("low") > F.col("high"), RECOMMENDATIONS["bands"]),
        )
    )
    cost = F.col("n").cast("double") * F.lit(COST_PER_DOCUMENT)
    return a.select(
        eff.alias("processing_efficiency"),
        cost.alias("total_cost"),
        F.when(F.col("ok") > 0, cost / F.col("ok").cast("double")).otherwise(0.0).alias("cost_per_success"),
        ((F.col("avg_q") + eff) / 2.0).alias("user_satisfaction"),
        F.when(F.size(rec) == 0, RECOMMENDATIONS["none"]).otherwise(F.array_join(rec, "|")).alias("recommendations"),
    )


def type_trends(df: DataFrame) -> DataFrame:
    """Scans by day and type, one row for each that occurs; any type, in one aggregation."""
    return df.groupBy(F.to_date("created_at").alias("day"), "document_type").agg(F.count("*").alias("scans"))


def type_rollup(df: DataFrame) -> DataFrame:
    """Per-type statistics; means over successes only, a missing confidence counts as zero."""
    conf = F.sum(F.when(ok(), F.coalesce(cents("confidence_score"), F.lit(0))))
    qual = F.sum(F.when(ok(), F.coalesce(cents("quality_score"), F.lit(0))))
    tim = F.sum(F.when(ok(), F.coalesce(cents("processing_time"), F.lit(0))))
    n = F.count_if(ok()).cast("double")
    mean = lambda s: F.when(n > 0, s.cast("double") / n / 100.0).otherwise(0.0)
    return df.groupBy("document_type").agg(
        F.count("*").alias("total_scans"),
        F.count_if(ok()).alias("successful_scans"),
        F.count_if(~ok()).alias("failed_scans"),
        mean(conf).alias("average_confidence"),
        mean(qual).alias("average_quality"),
        mean(tim).alias("average_processing_time"),
        F.max("created_at").alias("last_scan_at"),
    )


def batch_job_stats(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    per_job = docs.groupBy("job_id").agg(F.count("*").alias("docs"), F.count_if("success").alias("ok"))
    j = jobs.join(per_job, "job_id", "left")
    docs_n, ok_n = F.sum(F.coalesce("docs", F.lit(0))), F.sum(F.coalesce("ok", F.lit(0)))
    return j.groupBy("user_id").agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "completed").alias("completed_jobs"),
        F.count_if(F.col("status") == "processing").alias("processing_jobs"),
        F.count_if(F.col("status") == "queued").alias("queued_jobs"),
        docs_n.alias("total_documents"),
        ok_n.alias("successful_documents"),
        pct(ok_n, docs_n).alias("success_rate"),
    )


def batch_progress(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """State of each job from its documents: progress, counts, duration and derived status."""
    d = docs.groupBy("job_id").agg(
        F.count("*").alias("processed"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.max("doc_no").cast("bigint").alias("expected"),
        F.datediff(F.max("finished_at"), F.min("finished_at")).cast("bigint").alias("duration_days"),
    )
    progress = F.least(F.floor(F.col("processed") / F.col("expected") * 100), F.lit(100)).cast("bigint")
    status = (
        F.when(F.col("processed") < F.col("expected"), "processing")
        .when(F.col("failed") == 0, "completed")
        .when(F.col("successful") == 0, "failed")
        .otherwise("completed_with_errors")
    )
    return jobs.select("job_id").join(d, "job_id").select(
        "job_id", "processed", "successful", "failed", progress.alias("progress"), "duration_days", status.alias("status")
    )


def batch_result_summary(docs: DataFrame) -> DataFrame:
    """Per job: successes, total, mean quality and confidence with missing taken as zero."""
    n = F.count("*").cast("double")
    return docs.groupBy("job_id").agg(
        F.count_if("success").alias("successful"),
        F.count("*").alias("total"),
        (F.sum(F.coalesce(cents("quality_score"), F.lit(0))).cast("double") / n / 100.0).alias("avg_quality"),
        (F.sum(F.coalesce(cents("confidence"), F.lit(0))).cast("double") / n / 100.0).alias("avg_confidence"),
    )


def manager_stats(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "completed").alias("successful_jobs"),
        F.count_if(F.col("status") == "processing").alias("active_jobs"),
        F.count_if(F.col("status") == "queued").alias("pending_jobs"),
        (F.count_if(F.col("status") == "completed").cast("double") / F.count("*").cast("double")).alias("success_rate"),
    )


def usage_daily(requests: DataFrame) -> DataFrame:
    err = F.col("status_code") >= 400
    g = requests.groupBy("api_key_id", F.to_date("ts").alias("date"), "endpoint").agg(
        F.count("*").alias("request_count"),
        F.count_if(err).alias("error_count"),
        F.sum(cents("latency_ms")).alias("latency_hundredths"),
    )
    return with_rates(g)


def merge_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed upsert of daily usage: add the counters of both sides."""
    cols = ["api_key_id", "date", "endpoint", "request_count", "error_count", "latency_hundredths"]
    return sum_usage(old.select(*cols).unionByName(new.select(*cols)))


def sum_usage(parts: DataFrame) -> DataFrame:
    """Counters of one key, day and endpoint from all parts that hold some."""
    counters = ["request_count", "error_count", "latency_hundredths"]
    return with_rates(parts.groupBy("api_key_id", "date", "endpoint").agg(*[F.sum(c).alias(c) for c in counters]))


def with_rates(g: DataFrame) -> DataFrame:
    """Ratio columns with a zero guard."""
    n = F.col("request_count")
    return g.withColumn(
        "avg_latency_ms",
        F.when(n > 0, F.col("latency_hundredths").cast("double") / n.cast("double") / 100.0).otherwise(0.0),
    ).withColumn("error_rate", pct(F.col("error_count"), n))


def usage_overview(daily: DataFrame) -> DataFrame:
    """Daily sums and the grand total (null date) from one rollup."""
    g = daily.rollup("date").agg(
        F.sum("request_count").alias("requests"),
        F.sum("error_count").alias("errors"),
        F.sum("latency_hundredths").alias("_l"),
    )
    return g.select(
        "date",
        "requests",
        "errors",
        F.when(F.col("requests") > 0, F.col("_l").cast("double") / F.col("requests").cast("double") / 100.0)
        .otherwise(0.0)
        .alias("avg_latency_ms"),
        F.when(
            F.col("requests") > 0, (1.0 - F.col("errors").cast("double") / F.col("requests").cast("double")) * 100.0
        )
        .otherwise(100.0)
        .alias("success_rate"),
    )


def error_rate(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        pct(F.count_if(F.col("status_code") >= 400), F.count("*")).alias("error_rate"),
    )


# Bucket bounds in milliseconds.
LATENCY_BUCKETS = [50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000, 120000]


def latency_histogram(df: DataFrame, value: str, keys: Sequence[str], buckets: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts in long form: one pass, then one row per bucket; le is null for +Inf."""
    counts = [F.count_if(F.col(value) <= float(b)).alias(f"b{i}") for i, b in enumerate(buckets)]
    g = df.groupBy(*keys).agg(*counts, F.count("*").alias("binf"))
    pairs = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(buckets)
    ] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("binf").alias("cum"))]
    return g.select(*keys, F.inline(F.array(*pairs)))


def histogram_quantile(hist: DataFrame, q: float, keys: Sequence[str]) -> DataFrame:
    """Linear interpolation inside the first bucket that reaches q*n; the +Inf bucket gives its lower bound."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("le"))
    h = hist.withColumns(
        {
            "_pl": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
            "_pc": F.coalesce(F.lag("cum").over(w), F.lit(0)),
            "_n": F.max("cum").over(Window.partitionBy(*keys)),
        }
    )
    target = F.lit(float(q)) * F.col("_n").cast("double")
    frac = (target - F.col("_pc").cast("double")) / (F.col("cum") - F.col("_pc")).cast("double")
    est = (
        F.when(F.col("le").isNull(), F.col("_pl"))
        .when(F.col("cum") == F.col("_pc"), F.col("le"))
        .otherwise(F.col("_pl") + frac * (F.col("le") - F.col("_pl")))
    )
    first = F.struct(F.coalesce("le", F.lit(float("inf"))).alias("le"), est.alias("est"))
    return (
        h.filter(F.col("cum").cast("double") >= target)
        .groupBy(*keys)
        .agg(F.min(first).alias("_f"))
        .select(*keys, F.col("_f.est").alias("quantile"))
    )


def hit_rate(df: DataFrame, hit: Column) -> DataFrame:
    return df.agg(
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), pct(F.count_if(hit), F.count("*")).alias("hit_rate")
    )


def stdev2(c: str) -> Column:
    """Sample deviation of a two-decimal column from exact sums of hundredths."""
    v = cents(c).cast("decimal(18,0)")
    n = F.count(v).cast("double")
    s1 = F.sum(v).cast("decimal(28,0)")
    s2 = F.sum((v * v).cast("decimal(28,0)")).cast("double")
    num = n * s2 - s1.cast("double") * s1.cast("double")
    return F.when(n > 1, F.sqrt(num / (n * (n - 1.0))) / 100.0).otherwise(0.0)


def label_stats(df: DataFrame, label: str) -> DataFrame:
    g = df.groupBy(label).agg(F.count("*").alias("samples"))
    w = Window.partitionBy()
    return g.select(
        label, "samples", F.sum("samples").over(w).alias("total_samples"), F.count("*").over(w).alias("unique_labels")
    )


def tag_distribution(mem: DataFrame) -> DataFrame:
    e = mem.select(F.explode("tags").alias("tag"), "importance", "access_count")
    return e.groupBy("tag").agg(
        F.count("*").alias("memories"),
        mean2("importance").alias("avg_importance"),
        F.sum("access_count").alias("accesses"),
    )


# What an analytics query may ask for.
METRICS = {
    "scans_count": lambda: F.count("*"),
    "success_rate": lambda: pct(F.count_if(ok()), F.count("*")),
    "avg_processing_time": lambda: mean2("processing_time"),
    "document_types": lambda: F.countDistinct("document_type"),
    "quality_scores": lambda: mean2("quality_score"),
    "error_rate": lambda: pct(F.count_if(~ok()), F.count("*")),
}
GRANULARITIES = ("hour", "day", "week", "month")
GROUP_KEYS = ("document_type", "user_id", "status", "hour", "day")
MAX_RANGE_DAYS = 90


def analytics_query(df: DataFrame, spec: Mapping) -> DataFrame:
    """One metric over time buckets and up to three group keys; a bad request is an error."""
    import datetime as dt

    metric, gran = spec["metric"], spec.get("granularity", "day")
    groups = list(spec.get("group_by", []))
    if metric not in METRICS or gran not in GRANULARITIES:
        raise ValueError(f"unknown metric or granularity: {metric}, {gran}")
    if len(groups) > 3 or any(g not in GROUP_KEYS for g in groups):
        raise ValueError(f"bad group keys: {groups}")
    start, end = (dt.date.fromisoformat(spec[k]) for k in ("start_date", "end_date"))
    if end < start or (end - start).days > MAX_RANGE_DAYS:
        raise ValueError("date range must be ordered and at most 90 days")
    f = apply_filters(df, spec.get("filters", {})).filter(
        (F.col("created_at") >= ts(str(start))) & (F.col("created_at") < ts(str(end + dt.timedelta(days=1))))
    )
    extra = {"hour": F.hour("created_at"), "day": F.to_date("created_at")}
    keys = [extra.get(g, F.col(g)).alias(g) for g in groups]
    bucket = F.date_trunc(gran, "created_at").cast("timestamp_ntz").alias("bucket")
    return f.groupBy(bucket, *keys).agg(METRICS[metric]().alias("value"))


def health_rollup(checks: DataFrame, critical: Sequence[str], key: str) -> DataFrame:
    """Overall state per key: unhealthy when a critical service fails, degraded when another does."""
    crit = F.col("service").isin(list(critical))
    ok = F.col("status") == "healthy"
    crit_bad, other_bad = F.count_if(crit & ~ok), F.count_if(~crit & ~ok)
    return checks.groupBy(key).agg(
        F.when((crit_bad == 0) & (other_bad == 0), "healthy").when(crit_bad == 0, "degraded").otherwise("unhealthy").alias("overall"),
        F.count("*").alias("checks"),
    )
