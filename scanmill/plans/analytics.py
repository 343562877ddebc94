"""Registered analytics, window and source queries over the scan log, batches and API usage."""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.operators import aggregates as A
from scanmill.operators import ordered as O
from scanmill.operators import sketches as Sk
from scanmill.operators import windows as W
from scanmill.plans.registry import AS_OF, query
from scanmill.session import shared_folder, stored
from scanmill.sources import daily as Da
from scanmill.sources import tables as T

START, END = "2024-01-16 00:00:00", AS_OF


def cents_sql(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


def mean_sql(c: str, where: str = "TRUE") -> str:
    v = f"CASE WHEN {where} THEN {cents_sql(c)} END"
    return f"CAST(sum({v}) AS DOUBLE) / CAST(count({v}) AS DOUBLE) / 100.0"


def pct_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100.0 ELSE 0.0 END"


def with_(view: str, body: str) -> str:
    return f"WITH {view} {body}"


S = T.SCAN_SQL


@query("overview_stats", with_(S, f"""
SELECT count(*) FILTER (cur) AS total_scans, count(*) FILTER (cur AND error_message IS NULL) AS successful_scans,
  {pct_sql('count(*) FILTER (cur AND error_message IS NULL)', 'count(*) FILTER (cur)')} AS success_rate,
  coalesce({mean_sql('processing_time', 'cur')}, 0.0) AS avg_processing_time,
  {pct_sql('(count(*) FILTER (cur) - count(*) FILTER (NOT cur))', 'count(*) FILTER (NOT cur)')} AS growth_rate,
  CAST(15 AS BIGINT) AS period_days
FROM (SELECT *, created_at >= TIMESTAMP '{START}' AS cur FROM scan_history
      WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' AND created_at <= TIMESTAMP '{END}')"""))
def overview_stats(spark, d):
    return A.overview(T.scan_history(spark, d), START, END)


@query("analytics_summary", with_(S, f"""
SELECT count(*) AS total, count(*) FILTER (error_message IS NULL) AS success,
  count(*) FILTER (error_message IS NOT NULL) AS failed,
  {pct_sql('count(*) FILTER (error_message IS NULL)', 'count(*)')} AS success_rate,
  {mean_sql('processing_time', 'error_message IS NULL')} AS avg_processing_time,
  {mean_sql('confidence_score')} AS avg_confidence
FROM scan_history WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"""))
def analytics_summary(spark, d):
    return A.summary(T.scan_history(spark, d), 30, AS_OF)


@query("daily_trends", with_(S, f"""
SELECT CAST(created_at AS DATE) AS day, count(*) AS scans, {mean_sql('processing_time')} AS avg_processing_time
FROM scan_history GROUP BY 1"""))
def daily_trends(spark, d):
    return A.daily_trends(T.scan_history(spark, d))


@query("hourly_distribution", with_(S, """
SELECT CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS scans FROM scan_history GROUP BY 1"""))
def hourly_distribution(spark, d):
    return A.hourly_distribution(T.scan_history(spark, d))


@query("document_type_stats", with_(S, f"""
SELECT coalesce(document_type, 'Unknown') AS document_type, count(*) AS scans,
  {mean_sql('processing_time')} AS avg_processing_time,
  CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0 AS percentage
FROM scan_history GROUP BY 1"""))
def document_type_stats(spark, d):
    return A.type_stats(T.scan_history(spark, d))


@query("performance_metrics", with_(S, f"""
SELECT min(processing_time) AS min_time, max(processing_time) AS max_time, {mean_sql('processing_time')} AS avg_time,
  count(processing_time) AS samples FROM scan_history"""))
def performance_metrics(spark, d):
    return A.perf(T.scan_history(spark, d))


def rank_sql(table: str, value: str, ps, keys=()) -> str:
    """List form of sorted[min(floor(n*p/100), n-1)]."""
    outs = ", ".join(f"v[least(CAST(floor(len(v) * {p} / 100) AS BIGINT), len(v) - 1) + 1] AS p{p}" for p in ps)
    k = "".join(f"{x}, " for x in keys)
    g = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"SELECT {k}{outs} FROM (SELECT {k}list({value} ORDER BY {value}) AS v FROM {table} {g})"


@query("percentiles_rank", with_(S, rank_sql("scan_history", "processing_time", [50, 90, 95, 99])))
def percentiles_rank(spark, d):
    return O.rank_percentiles(T.scan_history(spark, d), "processing_time", [50, 90, 95, 99])


@query("percentiles_rank_by_type",
       with_(S, rank_sql("scan_history", "processing_time", [50, 90, 95, 99], ["document_type"])))
def percentiles_rank_by_type(spark, d):
    return O.rank_percentiles(T.scan_history(spark, d), "processing_time", [50, 90, 95, 99], ["document_type"])


def interp_sql(qs: dict) -> str:
    outs = []
    for n, q in qs.items():
        lo = f"greatest(1, least(CAST(floor((len(v) + 1) * {q}::DOUBLE) AS BIGINT), len(v) - 1))"
        outs.append(f"v[{lo}] + ((len(v) + 1) * {q}::DOUBLE - {lo}) * (v[{lo} + 1] - v[{lo}]) AS {n}")
    return ", ".join(outs)


QS = {"median": 0.5, "p95": 0.95, "p99": 0.99}


@query("percentiles_interp", with_(T.API_SQL, f"""
SELECT endpoint, {interp_sql(QS)}
FROM (SELECT endpoint, list(latency_ms ORDER BY latency_ms) AS v FROM api_requests GROUP BY endpoint)"""))
def percentiles_interp(spark, d):
    return O.interpolated_quantiles(T.api_requests(spark, d), "latency_ms", QS, ["endpoint"])


@query("percentiles_approx")
def percentiles_approx(spark, d):
    """Bounded-memory sketch for dashboards that can take a rank error of 1/10000."""
    ps = [0.5, 0.9, 0.95, 0.99]
    a = T.scan_history(spark, d).groupBy("document_type").agg(
        F.percentile_approx("processing_time", ps, 10000).alias("p")
    )
    return a.select("document_type", *[F.col("p")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(ps)])


@query("percentiles_approx_error", with_(S, "SELECT document_type, TRUE AS within FROM scan_history WHERE processing_time IS NOT NULL GROUP BY 1"))
def percentiles_approx_error(spark, d):
    """Whether the rank of each estimate is within 1/10000 of the rows, and one row, of the wanted rank."""
    rows = T.scan_history(spark, d).select("document_type", "processing_time").filter("processing_time IS NOT NULL")
    joined = rows.join(percentiles_approx(spark, d), "document_type")
    n, ok = F.count("*"), F.lit(True)
    for q in (0.5, 0.9, 0.95, 0.99):
        v, p = F.col("processing_time"), F.col(f"p{int(q * 100)}")
        ok = ok & (F.count_if(v < p) <= (q + 1e-4) * n + 1) & (F.count_if(v <= p) >= (q - 1e-4) * n - 1)
    return joined.groupBy("document_type").agg(ok.alias("within"))


@query("error_analysis", with_(S, """
SELECT * FROM (SELECT error_message, count(*) AS occurrences,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total_scans,
  CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0 AS share
FROM scan_history GROUP BY error_message) WHERE error_message IS NOT NULL"""))
def error_analysis(spark, d):
    return A.error_analysis(T.scan_history(spark, d))


_PM = f"""count(*) AS documents, count(*) FILTER (error_message IS NULL) AS successful,
  count(*) FILTER (error_message IS NOT NULL) AS failed,
  {pct_sql('count(*) FILTER (error_message IS NULL)', 'count(*)')} AS success_rate,
  coalesce({mean_sql('processing_time', 'processing_time <> 0')}, 0.0) AS average_processing_time,
  coalesce({mean_sql('confidence_score', 'confidence_score <> 0')}, 0.0) AS average_confidence
FROM scan_history"""


@query("processing_metrics", with_(S, f"""
SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS key, {_PM}
UNION ALL SELECT 'document_type', document_type, {_PM} WHERE document_type <> '' GROUP BY document_type
UNION ALL SELECT 'error_type', error_message, {_PM} WHERE error_message <> '' GROUP BY error_message"""))
def processing_metrics(spark, d):
    return A.processing_metrics(T.scan_history(spark, d))


@query("quality_bands", with_(S, f"""
SELECT coalesce({mean_sql('quality_score')}, 0.0) AS average_quality_score,
  count(*) FILTER (quality_score >= 0 AND quality_score < 0.3::DOUBLE) AS poor,
  count(*) FILTER (quality_score >= 0.3::DOUBLE AND quality_score < 0.6::DOUBLE) AS fair,
  count(*) FILTER (quality_score >= 0.6::DOUBLE AND quality_score < 0.8::DOUBLE) AS good,
  count(*) FILTER (quality_score >= 0.8::DOUBLE AND quality_score <= 1) AS excellent,
  count(*) FILTER (quality_score < 0.5::DOUBLE) AS low_quality_count,
  count(*) FILTER (quality_score >= 0.8::DOUBLE) AS high_quality_count
FROM scan_history WHERE quality_score <> 0"""))
def quality_bands(spark, d):
    return A.quality_bands(T.scan_history(spark, d))


@query("quality_histogram5", with_(S, """
SELECT CAST(least(floor(quality_score * 5), 4) AS INTEGER) AS band,
  CASE CAST(least(floor(quality_score * 5), 4) AS INTEGER) WHEN 0 THEN 'Very Poor' WHEN 1 THEN 'Poor' WHEN 2 THEN 'Fair'
    WHEN 3 THEN 'Good' ELSE 'Excellent' END AS label, count(*) AS scans
FROM scan_history GROUP BY 1, 2"""))
def quality_histogram5(spark, d):
    return A.quality_histogram5(T.scan_history(spark, d))


@query("usage_metrics", with_(S, """,
s AS (SELECT session_id, min(created_at) AS st, max(created_at) AS en FROM scan_history GROUP BY 1),
g AS (SELECT hour(st) AS h, dayname(st) AS dn, date_sub('second', st, en) AS secs FROM s)
SELECT (SELECT count(*) FROM g) AS total_sessions,
  (SELECT count(DISTINCT user_id) FROM scan_history) AS active_users,
  (SELECT lpad(CAST(h AS VARCHAR), 2, '0') || ':00' FROM g GROUP BY h ORDER BY count(*) DESC, h DESC LIMIT 1) AS peak_usage_time,
  (SELECT dn FROM g GROUP BY dn ORDER BY count(*) DESC, dn DESC LIMIT 1) AS peak_weekday,
  (SELECT CAST(sum(secs) AS DOUBLE) / CAST(count(*) FILTER (secs <> 0) AS DOUBLE) FROM g) AS average_session_duration"""))
def usage_metrics(spark, d):
    return A.usage(T.scan_history(spark, d))


@query("distinct_users_approx_error", with_(S, "SELECT document_type, TRUE AS within FROM scan_history GROUP BY 1"))
def distinct_users_approx_error(spark, d):
    """Whether each estimate is within three standard errors of the exact count."""
    exact = T.scan_history(spark, d).groupBy("document_type").agg(F.countDistinct("user_id").alias("users"))
    both = exact.join(distinct_users_approx(spark, d), "document_type")
    return both.select("document_type", (F.abs(F.col("approx_users") - F.col("users")) <= 3 * 0.02 * F.col("users") + 1).alias("within"))


@query("distinct_users_approx")
def distinct_users_approx(spark, d):
    return T.scan_history(spark, d).groupBy("document_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("approx_users")
    )


_RANGES = {"month": ("2024-01-01", "2024-01-31"), "week": ("2024-01-05", "2024-01-11"), "day": ("2024-01-20", "2024-01-20")}
_RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _sketched(spark, d):
    """The daily sketches are written once; each range reads only them."""
    days = stored(Sk.daily_sketches(T.scan_history(spark, d), "created_at", ["document_type"], "processing_time", "user_id"))
    of_range = lambda name, a, b: Sk.over_days(days, ["document_type"], datetime.date.fromisoformat(a), datetime.date.fromisoformat(b), _RANKS).withColumn("range", F.lit(name))
    return reduce(DataFrame.unionByName, (of_range(n, a, b) for n, (a, b) in _RANGES.items()))


@query("sketched_ranges")
def sketched_ranges(spark, d):
    """Rows, users and latency quantiles of three ranges of days from one table of daily sketches."""
    return _sketched(spark, d)


@query("sketched_ranges_error", with_(S, " UNION ALL ".join(
    f"""(SELECT '{n}' AS "range", document_type, count(*) AS "rows", TRUE AS users_within, TRUE AS quantiles_within FROM scan_history
WHERE CAST(created_at AS DATE) BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY document_type)""" for n, (a, b) in _RANGES.items())))
def sketched_ranges_error(spark, d):
    """Whether merged users are within three standard errors and merged quantiles within 1.5 % of their rank, in each range."""
    got = _sketched(spark, d)
    bounds = F.array(*[F.struct(F.lit(n).alias("range"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, (a, b) in _RANGES.items()])
    scans = T.scan_history(spark, d).select("document_type", "user_id", F.col("processing_time").alias("v"), F.to_date("created_at").alias("day"))
    scans = scans.select("*", F.inline(bounds)).where(F.col("day").between(F.col("a"), F.col("b"))).drop("day", "a", "b")
    at = scans.join(got.drop("rows"), ["range", "document_type"])
    n = F.count("v")
    ranks = [(F.count_if(F.col("v") < F.col(p)) <= (r + 0.015) * n + 1) & (F.count_if(F.col("v") <= F.col(p)) >= (r - 0.015) * n - 1) for p, r in _RANKS.items()]
    users = F.countDistinct("user_id")
    return at.groupBy("range", "document_type").agg(
        F.count("*").alias("rows"), (F.abs(F.first("members") - users) <= 3 * 0.0081 * users + 1).alias("users_within"),
        reduce(lambda x, y: x & y, ranks).alias("quantiles_within"),
    )


@query("user_activity", with_(S, f"""
SELECT count(*) AS active_users, count(*) FILTER (first_seen >= TIMESTAMP '{START}') AS new_users,
  count(*) FILTER (first_seen < TIMESTAMP '{START}') AS returning_users,
  CAST(sum(n) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_scans_per_user
FROM (SELECT user_id, min(created_at) AS first_seen, count(*) FILTER (created_at >= TIMESTAMP '{START}') AS n
      FROM scan_history WHERE created_at <= TIMESTAMP '{END}' GROUP BY user_id) WHERE n > 0"""))
def user_activity(spark, d):
    return A.user_activity(T.scan_history(spark, d), START, END)


@query("business_insights", with_(S, f"""
SELECT eff AS processing_efficiency, CAST(n AS DOUBLE) * 0.05::DOUBLE AS total_cost,
  CASE WHEN ok > 0 THEN CAST(n AS DOUBLE) * 0.05::DOUBLE / CAST(ok AS DOUBLE) ELSE 0.0 END AS cost_per_success,
  (avg_q + eff) / 2.0 AS user_satisfaction,
  CASE WHEN eff * 100.0 >= 80 AND avg_q >= 0.6::DOUBLE AND avg_t <= 10 AND low <= high THEN 'System performance is optimal'
  ELSE concat_ws('|', CASE WHEN eff * 100.0 < 80 THEN 'Improve OCR accuracy - success rate below 80%' END,
    CASE WHEN avg_q < 0.6::DOUBLE THEN 'Implement image quality guidelines for users' END,
    CASE WHEN avg_t > 10 THEN 'Optimize processing pipeline - average time too high' END,
    CASE WHEN low > high THEN 'Focus on image enhancement algorithms' END) END AS recommendations
FROM (SELECT count(*) AS n, count(*) FILTER (error_message IS NULL) AS ok,
  CAST(count(*) FILTER (error_message IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS eff,
  {mean_sql('processing_time', 'processing_time <> 0')} AS avg_t, {mean_sql('quality_score', 'quality_score <> 0')} AS avg_q,
  count(*) FILTER (quality_score <> 0 AND quality_score < 0.5::DOUBLE) AS low,
  count(*) FILTER (quality_score >= 0.8::DOUBLE) AS high FROM scan_history)"""))
def business_insights(spark, d):
    return A.business_insights(T.scan_history(spark, d))


@query("type_trends", with_(S, "SELECT CAST(created_at AS DATE) AS day, document_type, count(*) AS scans FROM scan_history GROUP BY 1, 2"))
def type_trends(spark, d):
    return A.type_trends(T.scan_history(spark, d))


def _roll(c: str) -> str:
    ok = "error_message IS NULL"
    return (f"CASE WHEN count(*) FILTER ({ok}) > 0 THEN CAST(sum(CASE WHEN {ok} THEN coalesce({cents_sql(c)}, 0) END) AS DOUBLE)"
            f" / CAST(count(*) FILTER ({ok}) AS DOUBLE) / 100.0 ELSE 0.0 END")


ROLLUP_SQL = f"""SELECT document_type, count(*) AS total_scans, count(*) FILTER (error_message IS NULL) AS successful_scans,
  count(*) FILTER (error_message IS NOT NULL) AS failed_scans, {_roll('confidence_score')} AS average_confidence,
  {_roll('quality_score')} AS average_quality, {_roll('processing_time')} AS average_processing_time,
  max(created_at) AS last_scan_at FROM scan_history GROUP BY document_type"""


@query("running_type_stats", with_(S, ROLLUP_SQL))
def running_type_stats(spark, d):
    return A.type_rollup(T.scan_history(spark, d))


@query("batch_job_stats", f"""WITH {T.JOBS_SQL}, {T.DOCS_SQL},
p AS (SELECT job_id, count(*) AS docs, count(*) FILTER (success) AS ok FROM batch_documents GROUP BY job_id)
SELECT user_id, count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed_jobs,
  count(*) FILTER (status = 'processing') AS processing_jobs, count(*) FILTER (status = 'queued') AS queued_jobs,
  CAST(sum(coalesce(docs, 0)) AS BIGINT) AS total_documents, CAST(sum(coalesce(ok, 0)) AS BIGINT) AS successful_documents,
  {pct_sql('sum(coalesce(ok, 0))', 'sum(coalesce(docs, 0))')} AS success_rate
FROM batch_jobs LEFT JOIN p USING (job_id) GROUP BY user_id""")
def batch_job_stats(spark, d):
    return A.batch_job_stats(T.batch_jobs(spark, d), T.batch_documents(spark, d))


@query("batch_progress", f"""WITH {T.JOBS_SQL}, {T.DOCS_SQL},
p AS (SELECT job_id, count(*) AS processed, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
  CAST(max(doc_no) AS BIGINT) AS expected,
  date_diff('day', CAST(min(finished_at) AS DATE), CAST(max(finished_at) AS DATE)) AS duration_days
  FROM batch_documents GROUP BY job_id)
SELECT job_id, processed, successful, failed,
  CAST(least(floor(CAST(processed AS DOUBLE) / expected * 100), 100) AS BIGINT) AS progress, duration_days,
  CASE WHEN processed < expected THEN 'processing' WHEN failed = 0 THEN 'completed' WHEN successful = 0 THEN 'failed'
    ELSE 'completed_with_errors' END AS status
FROM p WHERE job_id IN (SELECT job_id FROM batch_jobs)""")
def batch_progress(spark, d):
    return A.batch_progress(T.batch_jobs(spark, d), T.batch_documents(spark, d))


@query("batch_result_summary", with_(T.DOCS_SQL, f"""
SELECT job_id, count(*) FILTER (success) AS successful, count(*) AS total,
  CAST(sum(coalesce({cents_sql('quality_score')}, 0)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 100.0 AS avg_quality,
  CAST(sum(coalesce({cents_sql('confidence')}, 0)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 100.0 AS avg_confidence
FROM batch_documents GROUP BY job_id"""))
def batch_result_summary(spark, d):
    return A.batch_result_summary(T.batch_documents(spark, d))


@query("manager_stats", with_(T.JOBS_SQL, """
SELECT count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS successful_jobs,
  count(*) FILTER (status = 'processing') AS active_jobs, count(*) FILTER (status = 'queued') AS pending_jobs,
  CAST(count(*) FILTER (status = 'completed') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS success_rate FROM batch_jobs"""))
def manager_stats(spark, d):
    return A.manager_stats(T.batch_jobs(spark, d))


DAILY_SQL = f"""daily AS (
  SELECT api_key_id, CAST(ts AS DATE) AS date, endpoint, count(*) AS request_count,
    count(*) FILTER (status_code >= 400) AS error_count, CAST(sum({cents_sql('latency_ms')}) AS BIGINT) AS latency_hundredths
  FROM api_requests GROUP BY ALL)"""
_RATES = f"""CASE WHEN request_count > 0 THEN CAST(latency_hundredths AS DOUBLE) / CAST(request_count AS DOUBLE) / 100.0
  ELSE 0.0 END AS avg_latency_ms, {pct_sql('error_count', 'request_count')} AS error_rate"""


@query("api_usage_daily", f"WITH {T.API_SQL}, {DAILY_SQL} SELECT *, {_RATES} FROM daily")
def api_usage_daily(spark, d):
    r = T.api_requests(spark, d)
    cut = A.ts("2024-01-16 12:00:00")
    # Stored usage and today's increment, merged by key: equal to one rollup of everything.
    return A.merge_usage(A.usage_daily(r.filter(F.col("ts") < cut)), A.usage_daily(r.filter(F.col("ts") >= cut)))


@query("derived_rates", f"WITH {T.API_SQL}, {DAILY_SQL} SELECT api_key_id, date, endpoint, {_RATES} FROM daily")
def derived_rates(spark, d):
    return A.usage_daily(T.api_requests(spark, d)).select("api_key_id", "date", "endpoint", "avg_latency_ms", "error_rate")


@query("api_usage_stored", f"WITH {T.API_SQL}, {DAILY_SQL} SELECT *, {_RATES} FROM daily WHERE date >= DATE '2024-01-08'")
def api_usage_stored(spark, d):
    """Usage kept as a fact by day: two batches, the second added twice, days before the eighth dropped."""
    r = T.api_requests(spark, d)
    cut = A.ts("2024-01-16 12:00:00")
    path = f"{shared_folder(spark)}/usage-{uuid.uuid4().hex}"
    first, second = (A.usage_daily(r.filter(c)).drop("avg_latency_ms", "error_rate") for c in (F.col("ts") < cut, F.col("ts") >= cut))
    for rows, batch in ((first, "a"), (second, "b"), (second, "b")):
        Da.add_batch(rows, path, batch)
    Da.drop_days_before(spark, path, datetime.date(2024, 1, 8))
    return A.sum_usage(Da.read_batches(spark, path, first.schema))


@query("api_usage_overview", f"""WITH {T.API_SQL}, {DAILY_SQL}
SELECT date, CAST(sum(request_count) AS BIGINT) AS requests, CAST(sum(error_count) AS BIGINT) AS errors,
  CAST(sum(latency_hundredths) AS DOUBLE) / CAST(sum(request_count) AS DOUBLE) / 100.0 AS avg_latency_ms,
  (1.0::DOUBLE - CAST(sum(error_count) AS DOUBLE) / CAST(sum(request_count) AS DOUBLE)) * 100.0 AS success_rate
FROM daily GROUP BY ROLLUP (date)""")
def api_usage_overview(spark, d):
    return A.usage_overview(A.usage_daily(T.api_requests(spark, d)))


@query("request_error_rate", with_(T.API_SQL, f"""
SELECT count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors,
  {pct_sql('count(*) FILTER (status_code >= 400)', 'count(*)')} AS error_rate FROM api_requests"""))
def request_error_rate(spark, d):
    return A.error_rate(T.api_requests(spark, d))


@query("load_test_metrics", f"""WITH {T.API_SQL},
b AS (SELECT endpoint, count(*) AS total_requests, count(*) FILTER (status_code < 400) AS successful_requests,
  {pct_sql('count(*) FILTER (status_code < 400)', 'count(*)')} AS success_rate, min(latency_ms) AS min_response_time,
  {mean_sql('latency_ms')} AS avg_response_time, max(latency_ms) AS max_response_time,
  CAST(count(*) AS DOUBLE) / max(latency_ms) AS requests_per_second FROM api_requests GROUP BY endpoint),
p AS ({rank_sql('api_requests', 'latency_ms', [50, 95, 99], ['endpoint'])}),
s AS (SELECT endpoint, string_agg(status_code || '=' || n, '|' ORDER BY status_code) AS status_distribution,
  coalesce(string_agg('HTTP ' || status_code, '|' ORDER BY status_code) FILTER (status_code >= 400), '') AS errors
  FROM (SELECT endpoint, status_code, count(*) AS n FROM api_requests GROUP BY ALL) GROUP BY endpoint)
SELECT * FROM b JOIN p USING (endpoint) JOIN s USING (endpoint)""")
def load_test_metrics(spark, d):
    r = T.api_requests(spark, d)
    base = r.groupBy("endpoint").agg(
        F.count("*").alias("total_requests"),
        F.count_if(F.col("status_code") < 400).alias("successful_requests"),
        A.pct(F.count_if(F.col("status_code") < 400), F.count("*")).alias("success_rate"),
        F.min("latency_ms").alias("min_response_time"),
        A.mean2("latency_ms").alias("avg_response_time"),
        F.max("latency_ms").alias("max_response_time"),
        (F.count("*").cast("double") / F.max("latency_ms")).alias("requests_per_second"),
    )
    # A status code is three digits, so the lists below stay short whatever the traffic.
    by_status = r.groupBy("endpoint", "status_code").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("status_code", "n")))
    dist = by_status.groupBy("endpoint").agg(pairs.alias("_p")).select(
        "endpoint",
        F.array_join(F.transform("_p", lambda x: F.concat_ws("=", x["status_code"].cast("string"), x["n"].cast("string"))), "|").alias("status_distribution"),
        F.array_join(F.transform(F.filter("_p", lambda x: x["status_code"] >= 400), lambda x: F.concat(F.lit("HTTP "), x["status_code"].cast("string"))), "|").alias("errors"),
    )
    return base.join(O.rank_percentiles(r, "latency_ms", [50, 95, 99], ["endpoint"]), "endpoint").join(dist, "endpoint")


@query("bench_summary", f"""WITH {T.API_SQL},
b AS (SELECT endpoint, count(*) AS iterations, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, {mean_sql('latency_ms')} AS mean_ms,
  sqrt((CAST(count(*) AS DOUBLE) * CAST(sum(c * c) AS DOUBLE) - CAST(sum(c) AS DOUBLE) * CAST(sum(c) AS DOUBLE))
    / (CAST(count(*) AS DOUBLE) * (CAST(count(*) AS DOUBLE) - 1.0))) / 100.0 AS stdev_ms
  FROM (SELECT *, {cents_sql('latency_ms')} AS c FROM api_requests) GROUP BY endpoint),
m AS (SELECT endpoint, {interp_sql({'median_ms': 0.5})},
  v[least(CAST(floor(len(v) * 95 / 100) AS BIGINT), len(v) - 1) + 1] AS p95
  FROM (SELECT endpoint, list(latency_ms ORDER BY latency_ms) AS v FROM api_requests GROUP BY endpoint))
SELECT b.*, median_ms, p95 FROM b JOIN m USING (endpoint)""")
def bench_summary(spark, d):
    r = T.api_requests(spark, d)
    base = r.groupBy("endpoint").agg(
        F.count("*").alias("iterations"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        A.mean2("latency_ms").alias("mean_ms"),
        A.stdev2("latency_ms").alias("stdev_ms"),
    )
    return base.join(O.interpolated_quantiles(r, "latency_ms", {"median_ms": 0.5}, ["endpoint"]), "endpoint").join(
        O.rank_percentiles(r, "latency_ms", [95], ["endpoint"]), "endpoint"
    )


_B = A.LATENCY_BUCKETS
HIST_SQL = f"""hist AS (
  SELECT endpoint, b.le, count(*) FILTER (b.le IS NULL OR latency_ms <= b.le) AS cum
  FROM api_requests, (SELECT CAST(unnest([{', '.join(map(str, _B))}]) AS DOUBLE) AS le UNION ALL SELECT NULL) b
  GROUP BY endpoint, b.le)"""


@query("latency_histogram", f"WITH {T.API_SQL}, {HIST_SQL} SELECT * FROM hist")
def latency_histogram(spark, d):
    return A.latency_histogram(T.api_requests(spark, d), "latency_ms", ["endpoint"], _B)


def hq_sql(q: float) -> str:
    return f"""
h AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS pl, coalesce(lag(cum) OVER w, 0) AS pc, max(cum) OVER (PARTITION BY endpoint) AS n
  FROM hist WINDOW w AS (PARTITION BY endpoint ORDER BY le NULLS LAST))
SELECT endpoint, arg_min(CASE WHEN le IS NULL THEN pl WHEN cum = pc THEN le
  ELSE pl + ({q}::DOUBLE * CAST(n AS DOUBLE) - CAST(pc AS DOUBLE)) / CAST(cum - pc AS DOUBLE) * (le - pl) END,
  coalesce(le, 1e308)) AS quantile
FROM h WHERE CAST(cum AS DOUBLE) >= {q}::DOUBLE * CAST(n AS DOUBLE) GROUP BY endpoint"""


@query("histogram_quantile", f"WITH {T.API_SQL}, {HIST_SQL}, {hq_sql(0.95)}")
def histogram_quantile(spark, d):
    return A.histogram_quantile(latency_histogram(spark, d), 0.95, ["endpoint"])


@query("hit_rate", with_(S, f"""
SELECT count(*) FILTER (k >= 50) AS hits, count(*) FILTER (k < 50) AS misses,
  {pct_sql('count(*) FILTER (k >= 50)', 'count(*)')} AS hit_rate FROM scan_history"""))
def hit_rate(spark, d):
    return A.hit_rate(T.scan_history(spark, d), F.col("k") >= 50)


@query("label_distribution", """
SELECT label, count(*) AS samples, CAST(sum(count(*)) OVER () AS BIGINT) AS total_samples, count(*) OVER () AS unique_labels
FROM embeddings GROUP BY label""")
def label_distribution(spark, d):
    return A.label_stats(T.table(spark, d, "embeddings"), "label")


@query("tag_distribution", with_(T.MEM_SQL, f"""
SELECT tag, count(*) AS memories, {mean_sql('importance')} AS avg_importance, CAST(sum(access_count) AS BIGINT) AS accesses
FROM (SELECT unnest([lang, source]) AS tag, importance, access_count FROM memories) GROUP BY tag"""))
def tag_distribution(spark, d):
    return A.tag_distribution(T.memories(spark, d))


@query("analytics_query", with_(S, f"""
SELECT date_trunc('week', created_at)::TIMESTAMP AS bucket, document_type, status, {mean_sql('processing_time')} AS value
FROM scan_history WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-26'
  AND confidence_score >= 0.1::DOUBLE GROUP BY ALL"""))
def analytics_query(spark, d):
    return A.analytics_query(
        T.scan_history(spark, d),
        {
            "metric": "avg_processing_time", "granularity": "week", "start_date": "2024-01-05", "end_date": "2024-01-25",
            "group_by": ["document_type", "status"], "filters": {"confidence_score": {"$gte": 0.1}},
        },
    )


@query("analytics_query_rate", with_(S, f"""
SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, CAST(hour(created_at) AS INTEGER) AS hour,
  {pct_sql('count(*) FILTER (error_message IS NOT NULL)', 'count(*)')} AS value FROM scan_history GROUP BY ALL"""))
def analytics_query_rate(spark, d):
    return A.analytics_query(
        T.scan_history(spark, d),
        {"metric": "error_rate", "start_date": "2024-01-01", "end_date": "2024-01-31", "group_by": ["hour"]},
    )


# Services whose failure makes the whole system unhealthy.
CRITICAL_SERVICES = ["database", "tesseract"]
_SERVICE = {"click": "database", "error": "tesseract", "purchase": "cache", "signup": "celery", "view": "vision_service"}


@query("health_rollup", with_(S, """,
c AS (SELECT date_trunc('hour', created_at)::TIMESTAMP AS hour,
  CASE document_type WHEN 'click' THEN 'database' WHEN 'error' THEN 'tesseract' WHEN 'purchase' THEN 'cache'
    WHEN 'signup' THEN 'celery' ELSE 'vision_service' END AS service,
  CASE WHEN bool_and(error_message IS NULL) THEN 'healthy' ELSE 'unhealthy' END AS status
  FROM scan_history GROUP BY 1, 2)
SELECT hour, CASE WHEN bool_and(status = 'healthy') THEN 'healthy'
  WHEN coalesce(bool_and(status = 'healthy') FILTER (service IN ('database', 'tesseract')), TRUE) THEN 'degraded'
  ELSE 'unhealthy' END AS overall, count(*) AS checks FROM c GROUP BY hour"""))
def health_rollup(spark, d):
    svc = F.create_map(*[F.lit(x) for kv in _SERVICE.items() for x in kv])
    checks = T.scan_history(spark, d).groupBy(
        F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"),
        F.element_at(svc, F.col("document_type")).alias("service"),
    ).agg(F.when(F.bool_and(A.ok()), "healthy").otherwise("unhealthy").alias("status"))
    return A.health_rollup(checks, CRITICAL_SERVICES, "hour")


# ---- windows ----


@query("growth_series", with_(S, """
SELECT period, scans, previous, CASE WHEN previous > 0 THEN CAST(scans - previous AS DOUBLE) / CAST(previous AS DOUBLE) * 100.0
  ELSE 0.0 END AS growth_rate
FROM (SELECT period, scans, lag(scans) OVER (ORDER BY period) AS previous
  FROM (SELECT date_trunc('day', created_at)::TIMESTAMP AS period, count(*) AS scans FROM scan_history GROUP BY 1))"""))
def growth_series(spark, d):
    return W.growth_series(T.scan_history(spark, d), "created_at", "day")


@query("share_of_total", with_(S, """
SELECT status, document_type, count(*) AS scans,
  CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0 AS share FROM scan_history GROUP BY 1, 2"""))
def share_of_total(spark, d):
    g = T.scan_history(spark, d).groupBy("status", "document_type").agg(F.count("*").alias("scans"))
    return g.withColumn("share", A.share_of_total(F.col("scans")))


@query("running_average", with_(S, f"""
SELECT document_type, created_at, id, count(*) OVER w AS running_count,
  CAST(sum({cents_sql('processing_time')}) OVER w AS DOUBLE) / CAST(count(*) OVER w AS DOUBLE) / 100.0 AS running_avg
FROM scan_history WHERE error_message IS NULL
WINDOW w AS (PARTITION BY document_type ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)"""))
def running_average(spark, d):
    return W.running_average(T.scan_history(spark, d), "document_type", "processing_time", ["created_at", "id"], A.ok())


@query("recent_quality_trend", with_(S, f"""
SELECT document_type, created_at, id, quality_score, CAST(rn AS INTEGER) AS rn,
  CAST(sum({cents_sql('quality_score')}) OVER w AS DOUBLE) / CAST(count(*) OVER w AS DOUBLE) / 100.0 AS moving_avg
FROM (SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY created_at DESC, id DESC) AS rn FROM scan_history)
WHERE rn <= 50 WINDOW w AS (PARTITION BY document_type ORDER BY rn DESC ROWS 49 PRECEDING)"""))
def recent_quality_trend(spark, d):
    return W.latest_trend(T.scan_history(spark, d), "document_type", "quality_score", ["created_at", "id"])


@query("failed_attempts_15m", with_(T.LOGIN_SQL, """,
s AS (SELECT email, CAST(floor(epoch(attempted_at)) AS BIGINT) AS second, count(*) AS failures
  FROM login_attempts WHERE NOT success GROUP BY 1, 2)
SELECT email, second, failures, CAST(sum(failures) OVER w AS BIGINT) AS failures_in_window, sum(failures) OVER w >= 5 AS locked
FROM s WINDOW w AS (PARTITION BY email ORDER BY second RANGE BETWEEN 900 PRECEDING AND CURRENT ROW)"""))
def failed_attempts_15m(spark, d):
    return W.failed_attempts(T.login_attempts(spark, d))


@query("sliding_rate_count", with_(T.API_SQL, """,
s AS (SELECT api_key_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS requests FROM api_requests GROUP BY 1, 2)
SELECT api_key_id, second, requests, CAST(sum(requests) OVER w AS BIGINT) AS requests_in_window, sum(requests) OVER w > 2 AS over_limit
FROM s WINDOW w AS (PARTITION BY api_key_id ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)"""))
def sliding_rate_count(spark, d):
    return W.sliding_rate(T.api_requests(spark, d), "api_key_id", "ts", 3600, 2)


@query("lockout_interval_join", with_(T.LOGIN_SQL, """,
a AS (SELECT *, CAST(floor(epoch(attempted_at)) AS BIGINT) AS second FROM login_attempts)
SELECT x.id, x.email, x.success, count(y.id) AS recent_failures, count(y.id) >= 5 AS locked
FROM a x LEFT JOIN a y ON x.email = y.email AND NOT y.success AND y.second BETWEEN x.second - 900 AND x.second
GROUP BY x.id, x.email, x.success"""))
def lockout_interval_join(spark, d):
    return W.lockout_attempts(T.login_attempts(spark, d))


@query("failure_streaks", with_(T.API_SQL, """,
o AS (SELECT endpoint, status_code >= 400 AS bad, CAST(sum(CASE WHEN status_code < 400 THEN 1 ELSE 0 END)
  OVER (PARTITION BY endpoint ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM api_requests),
l AS (SELECT endpoint, run, count(*) AS length FROM o WHERE bad GROUP BY 1, 2)
SELECT endpoint, count(*) AS streaks, max(length) AS longest, count(*) FILTER (length >= 2) AS threshold_hits FROM l GROUP BY 1"""))
def failure_streaks(spark, d):
    return W.failure_streaks(T.api_requests(spark, d), "endpoint", ["ts", "id"], F.col("status_code") >= 400, 2)


@query("retry_schedule", with_(T.DOCS_SQL, """
SELECT job_id, doc_no, finished_at,
  CASE WHEN NOT success AND doc_no < 3 THEN CAST([10, 60, 300][least(doc_no, 3)] AS BIGINT) END AS delay_seconds,
  CASE WHEN NOT success AND doc_no < 3 THEN finished_at + to_seconds([10, 60, 300][least(doc_no, 3)]) END AS next_retry_at
FROM batch_documents"""))
def retry_schedule(spark, d):
    return W.retry_schedule(T.batch_documents(spark, d), ["job_id", "finished_at"], "doc_no", "finished_at", F.col("success"))
