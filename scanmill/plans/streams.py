"""Registered streaming queries. Each runs its stream over everything available and returns the result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.functions import classify as K
from scanmill.operators import aggregates as A
from scanmill.operators import joins as J
from scanmill.operators import windows as W
from scanmill.plans.analytics import ROLLUP_SQL, mean_sql
from scanmill.plans.registry import AS_OF, query
from scanmill.plans.relational import webhook_configs
from scanmill.plans.textual import C, ROUTE_SQL, _cascade_sql, _fields_sql
from scanmill.sources import tables as T
from scanmill.sources.identity import dealt, rendered
from scanmill.streaming import alerts as AL
from scanmill.streaming import duplicates as SD
from scanmill.streaming import limits as SL
from scanmill.streaming import stateful as St
from scanmill.streaming import windows as SW
from scanmill.streaming.frames import extract_frames
from scanmill.streaming.runner import local_sessions, run_append, run_update, shared_folder, stream_table, timed

# Append results are final once the watermark, ten minutes behind the newest event, passes the window end.
FINAL = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
# A second is decided when the watermark has passed its end.
SECOND_FINAL = f"date_trunc('second', ts)::TIMESTAMP + INTERVAL 1 SECOND <= {FINAL}"
MINUTE = "date_trunc('minute', ts)::TIMESTAMP"


def scan_stream(spark, d):
    """Scans as a stream, with the same columns as the table."""
    e = stream_table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        F.col("event_id").alias("id"), "ts", "user_id", F.col("event_type").alias("document_type"), F.col("value").alias("processing_time"), "k",
        (F.col("k") / 100).alias("confidence_score"), (((F.col("k") * 37) % 101) / 100).alias("quality_score"),
        F.when(F.col("k") < 20, F.lit("error")).alias("error_message"),
    )


def api_stream(spark, d):
    k = F.col("k")
    return scan_stream(spark, d).select(
        "id", "ts", F.col("user_id").alias("api_key_id"), F.col("document_type").alias("endpoint"), F.col("processing_time").alias("latency_ms"),
        F.when(k < 3, 500).when(k < 8, 404).otherwise(200).alias("status_code"),
    )


@query("stream_last_hour", f"""WITH w AS (SELECT {MINUTE} - to_minutes(CAST(o AS INTEGER)) AS window_start FROM events, range(60) r(o))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM w GROUP BY 1 HAVING window_start + INTERVAL 1 HOUR <= {FINAL}""")
def stream_last_hour(spark, d):
    return run_append(SW.sliding_counts(timed(scan_stream(spark, d)), "ts", "1 hour", "1 minute"))


@query("stream_type_stats", f"WITH {T.SCAN_SQL} {ROLLUP_SQL}")
def stream_type_stats(spark, d):
    s = scan_stream(spark, d).withColumnRenamed("ts", "created_at")
    return run_update(A.type_rollup(s), ["document_type"])


@query("stream_api_usage", f"""WITH {T.API_SQL} SELECT CAST(ts AS DATE) AS date, api_key_id, endpoint, count(*) AS request_count,
  count(*) FILTER (status_code >= 400) AS error_count, CAST(sum(CAST(round(latency_ms * 100) AS BIGINT)) AS BIGINT) AS latency_hundredths FROM api_requests GROUP BY ALL""")
def stream_api_usage(spark, d):
    return run_update(SW.usage_windows(timed(api_stream(spark, d)), "ts"), ["date", "api_key_id", "endpoint"])


@query("stream_frames", f"""WITH c AS (SELECT *, lower(text) AS low FROM documents), f AS (SELECT {_cascade_sql()}, doc_id % 101 / 100 >= 0.6::DOUBLE AS accepted, n_chars % 1000 / 100 AS processing_time FROM c)
SELECT document_type, count(*) AS frames, count(*) FILTER (accepted) AS accepted_frames, count(*) FILTER (accepted AND document_type <> 'Other Document') AS successes,
  {mean_sql('processing_time', 'accepted')} AS average_processing_time,
  CAST(count(*) FILTER (accepted AND document_type <> 'Other Document') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS success_rate FROM f GROUP BY document_type""")
def stream_frames(spark, d):
    """Gate by quality, classify the text, then running statistics per type."""
    s = stream_table(spark, d, "documents").select("text", (F.col("doc_id") % 101 / 100 >= 0.6).alias("accepted"), (F.col("n_chars") % 1000 / 100).alias("processing_time"))
    return run_update(SW.frame_stats(K.classify_cascade(s)), ["document_type"])


@query("stream_frame_fields", f"""WITH f AS ({_fields_sql(ROUTE_SQL)}), t AS ({C(f"SELECT doc_id, {_cascade_sql()} FROM c")})
SELECT doc_id, document_type, pack, field, value FROM f JOIN t USING (doc_id) WHERE doc_id % 101 / 100 >= 0.6::DOUBLE""")
def stream_frame_fields(spark, d):
    """The fields of each accepted frame of a stream of documents and identity documents."""
    # Frames below the least quality go before documents are dealt and identity documents rendered.
    docs = dealt(stream_table(spark, d, "documents").select("doc_id", "text"))
    frames = docs.unionByName(rendered(stream_table(spark, d, "customer"))).withColumn("quality", F.col("doc_id") % 101 / 100)
    out = extract_frames(frames, F.col("quality"))
    # The outer form keeps the optimiser from evaluating all fields, and the pack for each of them, in a filter of its own.
    rows = out.select("doc_id", "document_type", "pack", F.explode_outer("fields").alias("field", "value"))
    return run_append(rows.filter("value IS NOT NULL"))


@query("stream_quality_history", f"""WITH {T.SCAN_SQL} SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS kept, CAST(sum(CAST(round(quality_score * 100) AS BIGINT)) AS BIGINT) AS hundredths
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS rn FROM scan_history) WHERE rn <= 50 GROUP BY 1""")
def stream_quality_history(spark, d):
    return run_update(St.quality_history(timed(scan_stream(spark, d)), "user_id", "quality_score", "id", "ts", keep=50), ["key"])


def _limits_sql(unit: str, limit: int) -> str:
    w = f"date_trunc('{unit}', ts)::TIMESTAMP"
    return f"SELECT {w} AS window_start, {w} + INTERVAL 1 {unit} AS window_end, user_id, count(*) AS n, {limit} AS limit, count(*) > {limit} AS exceeded FROM events GROUP BY 1, 2, 3 HAVING {w} + INTERVAL 1 {unit} <= {FINAL}"


TEST_LIMITS = [("1 minute", 1), ("1 hour", 2), ("1 day", 5)]


@query("fixed_window_limits", " UNION ALL ".join(_limits_sql(length.split()[1], n) for length, n in TEST_LIMITS))
def fixed_window_limits(spark, d):
    """One stream per limit; limits lowered to the density of the test events."""
    out = None
    for length, n in TEST_LIMITS:
        r = SW.over_limit(run_append(SW.window_counts(timed(scan_stream(spark, d)), "ts", length, keys=["user_id"])), n)
        out = r if out is None else out.unionByName(r)
    return out


# Groups by user, with limits lowered to the density of the test events.
TEST_GROUPS = {"public": "1 per second; 1 per minute, 2 per hour", "user": "2 per hour, 5 per day", "health": "1 per day"}
_GROUP_SQL = "CASE user_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'user' WHEN 2 THEN 'health' ELSE 'unlimited' END"
_GROUP_VALUES = ", ".join(f"('{g}', {s}, {n})" for g, text in TEST_GROUPS.items() for s, n in SL.parse_limits(text))


@query("group_limits", f"""WITH l(limit_group, seconds, most) AS (VALUES {_GROUP_VALUES}), e AS (SELECT *, {_GROUP_SQL} AS limit_group, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT limit_group, user_id, seconds, make_timestamp((s - s % seconds) * 1000000) AS window_start, count(*) AS n, most, count(*) > most AS exceeded
FROM e JOIN l USING (limit_group) GROUP BY limit_group, user_id, seconds, s - s % seconds, most""")
def group_limits(spark, d):
    """All groups and windows in one stream."""
    u = F.col("user_id") % 4
    s = timed(scan_stream(spark, d)).withColumn("g", F.when(u == 0, "public").when(u == 1, "user").when(u == 2, "health").otherwise("unlimited"))
    g = SL.grouped_limits(s.select("ts", "user_id", "g"), SL.limits_table(spark, TEST_GROUPS), "ts", "user_id", "g")
    return run_update(g, ["limit_group", "user_id", "seconds", "window_start"], large=True)


@query("identifier_priority", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'user:' || user_id WHEN user_id % 3 = 1 THEN 'api_key:' || event_type ELSE '10.0.0.' || user_id END AS identifier FROM events""")
def identifier_priority(spark, d):
    e = T.table(spark, d, "events")
    u = F.col("user_id")
    e = e.select("event_id", F.when(u % 3 == 0, u).alias("u"), F.when(u % 3 < 2, F.col("event_type")).alias("k"), F.concat(F.lit("10.0.0."), u.cast("string")).alias("ip"))
    return e.select("event_id", SW.identifier("u", "k", "ip").alias("identifier"))


@query("rate_limiter_stream", f"""WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT)) AS i FROM events WHERE {SECOND_FINAL} GROUP BY user_id, CAST(floor(epoch(ts)) AS BIGINT)),
r AS (SELECT key, second, i, least(n, 3) AS admitted, n - least(n, 3) AS denied, [{{'s': second, 'c': least(n, 3)}}] AS st FROM s WHERE i = 1
  UNION ALL SELECT key, second, i, take, n - take, CASE WHEN take > 0 THEN list_append(kept, {{'s': second, 'c': take}}) ELSE kept END FROM (
    SELECT s.key, s.second, s.i, s.n, list_filter(r.st, lambda x: x.s > s.second - 86400) AS kept,
      least(s.n, greatest(0, 3 - coalesce(list_sum(list_transform(list_filter(r.st, lambda x: x.s > s.second - 86400), lambda x: x.c)), 0)))::BIGINT AS take
    FROM r JOIN s ON s.key = r.key AND s.i = r.i + 1))
SELECT key, second, admitted, denied FROM r""")
def rate_limiter_stream(spark, d):
    """Three requests a day per user, so that the test events meet the limit."""
    return run_append(St.rate_limiter(timed(scan_stream(spark, d)), "user_id", "ts", limit=3, window=86400))


@query("lockout_stream", f"""WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM events WHERE event_type = 'error' AND {SECOND_FINAL} GROUP BY user_id, 2),
c AS (SELECT key, second, CAST(sum(n) OVER (PARTITION BY key ORDER BY second RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM s),
hot AS (SELECT * FROM c WHERE failures >= 2),
r AS (SELECT key, second AS locked_at, failures FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY second) AS i FROM hot) WHERE i = 1
  UNION ALL SELECT key, second, failures FROM (SELECT h.key, h.second, h.failures, row_number() OVER (PARTITION BY h.key, r.locked_at ORDER BY h.second) AS i
    FROM r JOIN hot h ON h.key = r.key AND h.second >= r.locked_at + 86400) WHERE i = 1)
SELECT key, locked_at, locked_at + 86400 AS locked_until, failures FROM r""")
def lockout_stream(spark, d):
    """Two failures within a day, so that the test events meet the limit."""
    bad = F.col("document_type") == "error"
    return run_append(St.lockouts(timed(scan_stream(spark, d)), "user_id", "ts", limit=2, window=86400, failed=bad))


@query("idempotent_events", """WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type AS document_type, CAST(epoch_us(ts) AS BIGINT) AS t FROM events),
r AS (SELECT user_id, document_type, min(t) AS t FROM e GROUP BY ALL
  UNION ALL SELECT user_id, document_type, t FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id, e.document_type ORDER BY e.t) AS i
    FROM r JOIN e ON e.user_id = r.user_id AND e.document_type = r.document_type AND e.t >= r.t + 300000000) WHERE i = 1)
SELECT user_id, document_type, t AS at FROM r""")
def idempotent_events(spark, d):
    s = timed(scan_stream(spark, d), delay="300 seconds")
    return run_append(St.idempotent(s, ["user_id", "document_type"], life=300))


@query("ttl_latest", f"""SELECT CAST(user_id AS VARCHAR) AS key, value, CAST(epoch_us(ts) AS BIGINT) AS at, CAST(epoch_us(ts) + 864000000000 AS BIGINT) AS expires_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS rn FROM events) WHERE rn = 1 AND epoch_us(ts) + 864000000000 > epoch_us(TIMESTAMP '{AS_OF}')""")
def ttl_latest(spark, d):
    """Values alive at the time of reading; expired ones are not seen."""
    s = timed(scan_stream(spark, d))
    latest = run_update(St.ttl_latest(s, "user_id", "processing_time", "ts", ttl=864000), ["key"])
    return latest.filter(F.col("expires_at") > F.unix_micros(F.lit(AS_OF).cast("timestamp")))


SESSION_SQL = """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, date_sub('second', min(ts), max(ts)) AS duration_seconds, count(*) AS documents
FROM s GROUP BY user_id, sid"""


@query("session_usage", f"{SESSION_SQL} HAVING max(ts) + INTERVAL 6 HOUR <= {FINAL}")
def session_usage(spark, d):
    df = SW.session_usage(timed(scan_stream(spark, d)), "user_id", "ts", "6 hours")
    with local_sessions(df):
        return run_append(df)


@query("session_usage_table", SESSION_SQL)
def session_usage_table(spark, d):
    """All sessions of the table, open ones too, over slices of a day."""
    return SW.sessions_by_slice(T.spread(T.table(spark, d, "events")), "user_id", "ts", "6 hours")


_BUCKETS = [5, 10, 25, 50, 100, 250, 500]


# Rules of every kind, with thresholds that fit the test events.
_T = AL.Term
TEST_ALERTS = [
    AL.rule("HighErrorRate", _T("errors_total", "rate", 5), ">", 0.006, 2, "warning"),
    AL.rule("OCRProcessingFailures", _T("errors_total", "increase", 10), ">", 1.0, 1, "warning"),
    AL.rule("HighErrorRatio", _T("errors_total", "rate", 10), ">", 0.5, 5, "critical", _T("requests_total", "rate", 10)),
    AL.rule("HighOCRLatency", _T("duration_bucket", "quantile", 10, 0.95), ">", 200.0, 5, "warning"),
    AL.rule("OCRQueueBacklog", _T("queue_size", "gauge", 5), ">", 90.0, 3, "warning"),
    AL.rule("DiskSpaceLow", _T("disk_avail", "gauge", 5), "<", 0.05, 2, "critical", _T("disk_size", "gauge", 5)),
    AL.rule("PoolExhausted", _T("disk_avail", "gauge", 5), ">=", 0.0, 2, "critical", _T("queue_size", "gauge", 5), "-"),
    AL.rule("HighCPUUsage", _T("disk_avail", "rate", 5), ">", 70.0, 4, "warning", scale=-100.0, offset=100.0),
    AL.rule("ServiceDown", _T("up", "gauge", 1), "=", 0.0, 0, "critical"),
]


def _rows_sql(rows) -> str:
    value = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join(f"({', '.join(map(value, r))})" for r in rows)


_HEADS, _TERMS = map(_rows_sql, AL.rule_rows(TEST_ALERTS))
# Series by the minute: counters restart each day; gauges are the minute's events.
_SERIES = [("errors_total", "errors", True), ("requests_total", "requests", True), ("queue_size", "queue", False), ("disk_avail", "avail", False), ("disk_size", "size", False), ("up", "up", False)]
_GAUGES = {"queue": "max(k)", "avail": "min(k)", "size": "max(100 + k)", "up": "max(int(k < 95))"}

_SAMPLES_SQL = f"""e AS (SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, CAST(user_id % 2 AS VARCHAR) AS instance, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {FINAL}),
m AS (SELECT minute, instance, minute // 1440 AS day, count(*) AS requests, count(*) FILTER (k < 20) AS errors, {', '.join(f"{v.replace('int(k < 95)', 'CAST(k < 95 AS INTEGER)')} AS {c}" for c, v in _GAUGES.items())},
  {', '.join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(_BUCKETS))}, count(*) AS binf FROM e GROUP BY ALL),
samples AS ({' UNION ALL '.join(f"SELECT '{n}' AS series, instance, NULL::DOUBLE AS le, minute, CAST({f'sum({c}) OVER (PARTITION BY instance, day ORDER BY minute)' if counter else c} AS DOUBLE) AS value FROM m" for n, c, counter in _SERIES)}
  {' '.join(f"UNION ALL SELECT 'duration_bucket', instance, {le}, minute, CAST(sum({c}) OVER (PARTITION BY instance, day ORDER BY minute) AS DOUBLE) FROM m" for c, le in [*((f'b{i}', b) for i, b in enumerate(_BUCKETS)), ('binf', 'NULL')])})"""


@query("alert_rules", f"""WITH heads(alert, joins, scale, off, op, threshold, hold, severity) AS (VALUES {_HEADS}), terms(alert, side, series, how, width, q) AS (VALUES {_TERMS}),
{_SAMPLES_SQL},
i AS (SELECT *, lag(value) OVER (PARTITION BY series, instance, le ORDER BY minute) AS b FROM samples),
u AS (SELECT *, CASE WHEN b IS NULL THEN 0 WHEN value >= b THEN value - b ELSE value END AS up FROM i),
o AS (SELECT alert, side, instance, how, width, q, le, minute + unnest(range(width)) AS a, minute, value, up FROM u JOIN terms USING (series)),
g AS (SELECT alert, side, instance, how, width, q, le, a, CASE how WHEN 'gauge' THEN arg_max(value, minute) WHEN 'rate' THEN sum(up) / (width * 60.0::DOUBLE) ELSE sum(up) END AS value FROM o GROUP BY alert, side, instance, how, width, q, le, a),
h AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS pl, coalesce(lag(value) OVER w, 0) AS pc, max(value) OVER (PARTITION BY alert, side, instance, a) AS n FROM g WHERE how = 'quantile' WINDOW w AS (PARTITION BY alert, side, instance, a ORDER BY le NULLS LAST)),
s AS (SELECT alert, side, instance, a, value FROM g WHERE how <> 'quantile' UNION ALL
  SELECT alert, side, instance, a, arg_min(CASE WHEN le IS NULL THEN pl WHEN value = pc THEN le ELSE pl + (q * n - pc) / (value - pc) * (le - pl) END, coalesce(le, 1e308)) FROM h WHERE n > 0 AND value >= q * n GROUP BY ALL),
x AS (SELECT alert, instance, a, max(value) FILTER (side = 'left') AS l, max(value) FILTER (side = 'right') AS r FROM s GROUP BY ALL),
v AS (SELECT alert, severity, instance, a, hold, op, threshold, scale * (CASE joins WHEN '/' THEN l / nullif(r, 0) WHEN '-' THEN l - r ELSE l END) + off AS v FROM x JOIN heads USING (alert)),
y AS (SELECT *, a - row_number() OVER (PARTITION BY alert, instance ORDER BY a) AS run FROM v WHERE CASE op WHEN '>' THEN v > threshold WHEN '>=' THEN v >= threshold WHEN '<' THEN v < threshold ELSE v = threshold END)
SELECT alert, severity, instance, min(a) AS pending_from, min(a) + hold AS firing_from, max(a) AS until, CASE WHEN op = '<' THEN min(v) ELSE max(v) END AS peak
FROM y GROUP BY alert, severity, instance, hold, op, run HAVING max(a) - min(a) >= hold""")
def alert_rules(spark, d):
    """Counts and gauges of each minute and instance from the stream, then all rules over their samples."""
    s = timed(scan_stream(spark, d)).withColumn("instance", (F.col("user_id") % 2).cast("string"))
    counts = [F.count("*").alias("requests"), F.count_if(F.col("k") < 20).alias("errors"), *(F.expr(v).alias(c) for c, v in _GAUGES.items())]
    counts += [F.count_if(F.col("processing_time") <= b).alias(f"b{i}") for i, b in enumerate(_BUCKETS)] + [F.count("*").alias("binf")]
    m = run_append(s.groupBy(F.window("ts", "1 minute").alias("w"), "instance").agg(*counts).withColumn("minute", F.floor(F.unix_seconds("w.start") / 60)).drop("w"))
    so_far = Window.partitionBy("instance", F.floor(F.col("minute") / 1440)).orderBy("minute")
    rows = [(n, None, F.sum(c).over(so_far) if counter else F.col(c)) for n, c, counter in _SERIES]
    rows += [("duration_bucket", float(b), F.sum(f"b{i}").over(so_far)) for i, b in enumerate(_BUCKETS)] + [("duration_bucket", None, F.sum("binf").over(so_far))]
    values = F.array(*(F.struct(F.lit(n).alias("series"), F.lit(le).cast("double").alias("le"), v.cast("double").alias("value")) for n, le, v in rows))
    samples = m.withColumn("values", values).select("minute", "instance", F.inline("values"))
    return AL.evaluate(samples, TEST_ALERTS)


@query("alert_latency_quantile", f"""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, b.le, count(*) FILTER (b.le IS NULL OR value <= b.le) AS cum FROM events,
  (SELECT CAST(unnest({_BUCKETS}) AS DOUBLE) AS le UNION ALL SELECT NULL) b GROUP BY 1, 2 HAVING window_start + INTERVAL 1 HOUR <= {FINAL}),
x AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS pl, coalesce(lag(cum) OVER w, 0) AS pc, max(cum) OVER (PARTITION BY window_start) AS n FROM h WINDOW w AS (PARTITION BY window_start ORDER BY le NULLS LAST)),
q AS (SELECT window_start, arg_min(CASE WHEN le IS NULL THEN pl WHEN cum = pc THEN le ELSE pl + (0.95::DOUBLE * CAST(n AS DOUBLE) - CAST(pc AS DOUBLE)) / CAST(cum - pc AS DOUBLE) * (le - pl) END, coalesce(le, 1e308)) AS quantile
  FROM x WHERE CAST(cum AS DOUBLE) >= 0.95::DOUBLE * CAST(n AS DOUBLE) GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, quantile FROM q WHERE quantile > 60""")
def alert_latency_quantile(spark, d):
    h = run_append(SW.latency_quantile_windows(timed(scan_stream(spark, d)), "ts", "processing_time", "1 hour", _BUCKETS))
    return A.histogram_quantile(h, 0.95, ["window_start", "window_end"]).filter("quantile > 60")


@query("breaker_state", f"""WITH {T.API_SQL}, s AS (SELECT endpoint, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) FILTER (status_code >= 400) AS bad, count(*) FILTER (status_code < 400) AS good FROM api_requests WHERE {SECOND_FINAL} GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(CASE WHEN good > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint ORDER BY second ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM s),
c AS (SELECT *, sum(bad) OVER (PARTITION BY endpoint, run ORDER BY second ROWS UNBOUNDED PRECEDING) AS streak, max(CASE WHEN good > 0 THEN second END) OVER (PARTITION BY endpoint, run) AS ok_at,
  max(CASE WHEN bad > 0 THEN second END) OVER (PARTITION BY endpoint, run ORDER BY second ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_bad FROM o),
b AS (SELECT *, min(CASE WHEN streak >= 2 THEN second END) OVER (PARTITION BY endpoint, run) AS open_at FROM c),
t AS (SELECT DISTINCT endpoint, open_at AS second, 'open' AS state FROM b WHERE open_at IS NOT NULL
  UNION ALL SELECT DISTINCT endpoint, ok_at, 'closed' FROM b WHERE open_at IS NOT NULL AND ok_at IS NOT NULL
  UNION ALL SELECT endpoint, prev_bad + 60, 'half_open' FROM b WHERE open_at IS NOT NULL AND second > open_at AND second - prev_bad >= 60
  UNION ALL SELECT endpoint, second, 'open' FROM b WHERE open_at IS NOT NULL AND second > open_at AND second - prev_bad >= 60 AND bad > 0)
SELECT endpoint AS key, CAST(second AS BIGINT) AS second, state FROM t""")
def breaker_state(spark, d):
    return run_append(St.breaker_transitions(timed(api_stream(spark, d)), "endpoint", "ts", "status_code >= 400", threshold=2, recovery=60))


@query("webhook_dispatch", """WITH e AS (SELECT event_id, ts, user_id, event_type, event_id % 4 + 1 AS attempt FROM events),
c AS (SELECT c_custkey AS config_id, c_custkey % 200 AS user_id, [['click', 'error'], ['purchase'], ['signup', 'click'], ['none']][c_nationkey % 4 + 1] AS events FROM customer WHERE c_acctbal > 0)
SELECT event_id, config_id, attempt, CASE WHEN attempt < 3 THEN CAST([10, 60, 300][attempt] AS BIGINT) END AS delay_seconds
FROM e JOIN c ON e.user_id = c.user_id AND list_contains(events, event_type)""")
def webhook_dispatch(spark, d):
    """Stream of events fanned out to static configurations, with the delay of a failed attempt."""
    e = scan_stream(spark, d).select(F.col("id").alias("event_id"), "ts", "user_id", F.col("document_type").alias("event_type"))
    fan = J.webhook_fanout(e, webhook_configs(spark, d)).withColumn("attempt", F.col("event_id") % 4 + 1).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    sched = W.retry_schedule(fan, ["event_id", "config_id"], "attempt", "at", F.lit(False))
    return run_append(sched.drop("next_retry_at"))


@query("stream_duplicates", f"""WITH {T.HASH_SQL}, x AS (SELECT id, bits FROM image_hashes WHERE id < 2 * {T.RESCAN_OFFSET})
SELECT q.id, min(o.id) AS matching_id, CAST(arg_min(hamming(q.bits, o.bits), o.id) AS INTEGER) AS distance FROM x q JOIN x o ON o.id < q.id AND hamming(q.bits, o.bits) <= 5 GROUP BY q.id""")
def stream_duplicates(spark, d):
    """Scans and rescans arriving as a stream, each checked against all earlier ones."""
    e = stream_table(spark, d, "embeddings")
    rescan = F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 8, -x).otherwise(x))
    both = F.array(F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), F.struct((F.col("vec_id") + T.RESCAN_OFFSET).alias("id"), rescan.alias("v")))
    rows = e.select(F.inline(both))
    bits = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))
    return SD.run_stream_duplicates(rows.select("id", bits.alias("h")), shared_folder(spark))


@query("match_registered", f"""WITH {T.HASH_SQL}, o AS (SELECT bits, min(id) AS id FROM image_hashes WHERE id < 1000000000 GROUP BY bits), n AS (SELECT bits, min(id) AS id FROM image_hashes WHERE id >= 1000000000 GROUP BY bits)
SELECT n.id, min(o.id) AS matching_id, CAST(arg_min(hamming(n.bits, o.bits), o.id) AS INTEGER) AS distance FROM n JOIN o ON hamming(n.bits, o.bits) <= 5 GROUP BY n.id""")
def match_registered(spark, d):
    """The per-batch step of the stream: rescans as a new batch against the registered originals."""
    h = T.image_hashes(spark, d)
    part = lambda c: h.filter(c).groupBy(F.col("phash").alias("h")).agg(F.min("id").alias("first_id"))
    return SD.match_registered(part("id >= 1000000000"), part("id < 1000000000"))
