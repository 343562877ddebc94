"""Registered sources, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.functions import catalogue as C
from scanmill.operators import aggregates as A
from scanmill.operators import duplicates as D
from scanmill.operators import filters as Fi
from scanmill.operators import joins as J
from scanmill.operators import phrases as P
from scanmill.operators import ranking as R
from scanmill.operators import windows as W
from scanmill.plans.registry import AS_OF, query
from scanmill.sources import io as IO
from scanmill.sources import tables as T

S = T.SCAN_SQL


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ---- sources and sinks ----


@query("scan_log_source", f"WITH {S} SELECT * FROM scan_history WHERE processing_time >= 10")
def scan_log_source(spark, d):
    return T.scan_history(spark, d).filter(F.col("processing_time") >= 10)


@query("window_scan", f"""WITH {S} SELECT id, created_at, document_type FROM scan_history
WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def window_scan(spark, d):
    return Fi.last_n_days(T.scan_history(spark, d), "created_at", 7, AS_OF).select("id", "created_at", "document_type")


@query("json_columns", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
CAST(json_extract_string(props, '$.k') AS INTEGER) IN (1, 2, 3) AS flagged FROM events""")
def json_columns(spark, d):
    e = IO.decode_json(T.table(spark, d, "events"), "props", "k INT")
    return e.select("event_id", F.col("props.k").alias("k"), F.array_contains(F.array(*map(F.lit, (1, 2, 3))), F.col("props.k")).alias("flagged"))


def _rules_sql() -> str:
    rows = [
        f"({lit(c)}, {lit(t)}, {lit(kind)}, {lit(p)})"
        for c, t, _, _, kw, nf, ti in C.COUNTRY_RULES
        for kind, ps in (("keyword", kw), ("number_format", nf), ("text_indicator", ti))
        for p in ps
    ]
    return "rules(country, type, kind, pattern) AS (VALUES " + ", ".join(rows) + ")"


@query("rule_catalogue_source", f"""WITH {_rules_sql()}
SELECT country, type, count(*) AS patterns, (SELECT count(*) FROM documents) AS documents FROM rules GROUP BY country, type""")
def rule_catalogue_source(spark, d):
    docs = T.table(spark, d, "documents").agg(F.count("*")).scalar()
    return C.load_rules(spark).groupBy("country", "type").agg(F.count("*").alias("patterns")).withColumn("documents", docs)


@query("document_type_catalogue", f"""WITH t(code, country, display_name) AS (VALUES {', '.join(f'({lit(a)}, {lit(b)}, {lit(c)})' for a, b, c in C.TYPES)})
SELECT t.*, coalesce(n, 0) AS customers FROM t LEFT JOIN (SELECT CAST(c_custkey % 14 AS INTEGER) AS i, count(*) AS n FROM customer GROUP BY 1) c
ON c.i = (SELECT count(*) FROM t u WHERE u.code < t.code)""")
def document_type_catalogue(spark, d):
    order = F.create_map(*[x for i, c in enumerate(sorted(t[0] for t in C.TYPES)) for x in (F.lit(c), F.lit(i))])
    cat = C.supported_types(spark).withColumn("i", F.element_at(order, F.col("code")))
    per = T.table(spark, d, "customer").groupBy((F.col("c_custkey") % 14).cast("int").alias("i")).agg(F.count("*").alias("n"))
    return cat.join(per, "i", "left").select("code", "country", "display_name", F.coalesce("n", F.lit(0)).alias("customers"))


def client_payloads(spark, d):
    """Metric batches rendered from events: one JSON payload per run of 250 event numbers, in event order."""
    e = T.scan_history(spark, d)
    m = F.struct(
        F.element_at(F.array(*map(F.lit, ["api_call", "error", "user_action", "performance", "other"])), F.col("k") % 5 + 1).alias("type"),
        F.when(F.col("k") % 3 > 0, F.col("document_type")).alias("endpoint"),
        F.when(F.col("k") % 2 > 0, F.col("processing_time")).alias("durationMs"),
        F.when(F.col("k") % 7 > 0, F.col("error_message").isNull()).alias("success"),
        F.when(F.col("k") % 4 > 0, F.col("session_id")).alias("component"),
        F.when(F.col("k") % 4 > 1, F.col("status")).alias("action"),
        F.when(F.col("k") % 3 > 1, F.col("processing_time")).alias("valueMs"),
    )
    # Event numbers are unique, so a payload never holds more than 250 metrics.
    g = e.groupBy(F.floor(F.col("id") / 250).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("id", m.alias("m")))).alias("x"))
    return g.select("batch", F.to_json(F.struct(F.transform("x", lambda r: r["m"]).alias("metrics"))).alias("payload"))


@query("client_metrics_ingest", f"""WITH {S},
x AS (SELECT CAST(floor(id / 250) AS BIGINT) AS batch, k, document_type, processing_time, error_message, session_id, status,
  CAST(row_number() OVER (PARTITION BY floor(id / 250) ORDER BY id) - 1 AS INTEGER) AS position,
  ['api_call', 'error', 'user_action', 'performance', 'other'][k % 5 + 1] AS type FROM scan_history)
SELECT batch, position, type,
  CASE WHEN type = 'api_call' THEN CASE WHEN k % 3 > 0 THEN document_type ELSE 'unknown' END END AS endpoint,
  CASE WHEN type = 'api_call' THEN CASE WHEN k % 7 > 0 THEN error_message IS NULL ELSE TRUE END END AS success,
  CASE WHEN type = 'api_call' THEN CASE WHEN k % 2 > 0 THEN processing_time ELSE 0 END
    WHEN type = 'performance' THEN CASE WHEN k % 3 > 1 THEN processing_time ELSE 0 END END AS value_ms,
  CASE WHEN type IN ('error', 'performance') THEN CASE WHEN k % 4 > 0 THEN session_id ELSE 'unknown' END END AS component,
  CASE WHEN type IN ('error', 'user_action') THEN CASE WHEN k % 4 > 1 THEN status ELSE 'unknown' END END AS action
FROM x WHERE type <> 'other'""")
def client_metrics_ingest(spark, d):
    return IO.ingest_client_metrics(client_payloads(spark, d))


@query("file_inventory")
def file_inventory(spark, d):
    return IO.file_inventory(spark, d, query="e", types=[".parquet"]).select("name", "suffix", "bytes")


@query("storage_stats")
def storage_stats(spark, d):
    return IO.storage_stats(IO.file_inventory(spark, d))


@query("magic_bytes_type", """SELECT page_id, ['image/png', 'image/jpeg', 'image/webp', 'image/gif', 'image/tiff', 'image/bmp', 'image/jpeg'][page_id % 7 + 1] AS media_type FROM pages""")
def magic_bytes_type(spark, d):
    """Media type of the rendered page bytes: signatures prefixed to whole page contents."""
    heads = ["89504E470D0A1A0A", "FFD8FFE0", "52494646000000005745425056", "47494638", "49492A00", "424D", "3C21"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % len(heads)).cast("int") + 1)
    content = F.concat(F.unhex(head), F.encode("html", "UTF-8"))
    return T.table(spark, d, "pages").select("page_id", IO.media_type(content).alias("media_type"))


@query("report_export_json", f"""WITH {S}
SELECT '{{"document_type":"' || document_type || '","scans":' || count(*) || ',"failed":' || count(*) FILTER (error_message IS NOT NULL) || '}}' AS json
FROM scan_history GROUP BY document_type""")
def report_export_json(spark, d):
    g = T.scan_history(spark, d).groupBy("document_type").agg(F.count("*").alias("scans"), F.count_if(~A.ok()).alias("failed"))
    return IO.report_json(g)


def nested_results(spark, d):
    return T.batch_documents(spark, d).select(
        F.struct(
            F.concat_ws("-", F.col("job_id").cast("string"), F.col("doc_no").cast("string")).alias("document_id"),
            F.when(F.col("doc_no") != 5, F.col("success")).alias("success"),
            F.when(F.col("success"), F.struct(F.lit("passport").alias("document_type"), F.col("confidence"))).alias("classification"),
            F.col("quality_score"),
            F.when(~F.col("success"), F.lit("OCR failed")).alias("error"),
        ).alias("result")
    )


@query("batch_results_export_csv", f"""WITH {T.DOCS_SQL}
SELECT job_id || '-' || doc_no AS document_id, CASE WHEN doc_no <> 5 THEN success ELSE FALSE END AS success,
  CASE WHEN success THEN 'passport' ELSE '' END AS document_type, coalesce(confidence, 0) AS confidence,
  coalesce(quality_score, 0) AS quality_score, CASE WHEN success THEN '' ELSE 'OCR failed' END AS error FROM batch_documents""")
def batch_results_export_csv(spark, d):
    return IO.batch_results_table(nested_results(spark, d))


@query("copy_insert_if_absent", """SELECT o_orderkey, o_orderstatus FROM orders""")
def copy_insert_if_absent(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    held = o.filter(F.col("o_orderstatus") != "P")
    return J.insert_if_absent(o, held, ["o_orderkey"])


@query("retention_split", f"""WITH {S}
SELECT 'scan_history' AS table_name, count(*) FILTER (created_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS deleted,
  count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AS kept FROM scan_history
UNION ALL SELECT 'batch_jobs', count(*) FILTER (o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 9000 DAY),
  count(*) FILTER (o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 9000 DAY) FROM orders""")
def retention_split(spark, d):
    scans = IO.retention(T.scan_history(spark, d), "created_at", 20, AS_OF)[1].withColumn("table_name", F.lit("scan_history"))
    jobs = IO.retention(T.batch_jobs(spark, d), "created_at", 9000, AS_OF)[1].withColumn("table_name", F.lit("batch_jobs"))
    return scans.unionByName(jobs)


# ---- filters and validation ----


@query("filter_spec", f"""WITH {S} SELECT id, document_type, processing_time FROM scan_history
WHERE processing_time >= 20 AND processing_time < 80 AND document_type IN ('click', 'view') AND status <> 'failed'
  AND user_id NOT IN (1, 2, 3) AND session_id ILIKE '8-20240105' OR (FALSE)
UNION ALL SELECT id, document_type, processing_time FROM scan_history WHERE k > 95 AND k <= 98 AND status = 'completed'""")
def filter_spec(spark, d):
    s = T.scan_history(spark, d)
    a = Fi.apply_filters(s, {
        "processing_time": {"$gte": 20, "$lt": 80}, "document_type": {"$in": ["click", "view"]},
        "status": {"$ne": "failed"}, "user_id": {"$nin": [1, 2, 3]}, "session_id": {"$ilike": "8-20240105"},
    })
    b = Fi.apply_filters(s, {"k": {"$gt": 95, "$lte": 98}, "status": "completed"})
    return a.unionByName(b).select("id", "document_type", "processing_time")


@query("like_literal", """SELECT doc_id, instr(text, '50%_') > 0 AS has_term, starts_with(text, 'The') AS begins
FROM documents WHERE instr(text, '%') > 0 OR starts_with(text, 'The')""")
def like_literal(spark, d):
    x = F.col("text")
    return T.table(spark, d, "documents").filter(Fi.like_literal(x, "%") | Fi.like_literal(x, "The", "start")).select(
        "doc_id", Fi.like_literal(x, "50%_").alias("has_term"), Fi.like_literal(x, "The", "start").alias("begins")
    )


@query("search_scans", f"""WITH {S},
f AS (SELECT * FROM scan_history WHERE (contains(lower(document_type), 'cl') OR contains(lower(status), 'cl'))
  AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-20' AND document_type IN ('click', 'view'))
SELECT id, created_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""")
def search_scans(spark, d):
    return Fi.search(
        T.scan_history(spark, d), "CL", ["document_type", "status"], "2024-01-03", "2024-01-19", ["click", "view"], page=2
    ).select("id", "created_at", "total")


@query("paginate", f"""WITH {T.JOBS_SQL}
SELECT job_id, created_at, (SELECT count(*) FROM batch_jobs) AS total, (SELECT CAST(ceil(count(*) / 25) AS BIGINT) FROM batch_jobs) AS pages,
  TRUE AS has_next, TRUE AS has_prev FROM batch_jobs ORDER BY created_at DESC, job_id LIMIT 25 OFFSET 50""")
def paginate(spark, d):
    j = T.batch_jobs(spark, d).select("job_id", "created_at")
    return Fi.paginate(j, [F.desc("created_at"), F.asc("job_id")], page=3, per_page=25)


@query("quality_gate", f"""WITH {S}
SELECT id, quality_score >= 0.6::DOUBLE AS accepted, concat_ws('|', CASE WHEN quality_score < 0.6::DOUBLE THEN 'quality_too_low' END,
  CASE WHEN confidence_score < 0.3::DOUBLE THEN 'confidence_too_low' END, CASE WHEN error_message IS NOT NULL THEN 'processing_error' END) AS reasons
FROM scan_history""")
def quality_gate(spark, d):
    return Fi.quality_gate(T.scan_history(spark, d), 0.6, 0.3).select("id", "accepted", F.array_join("reasons", "|").alias("reasons"))


def extracted(spark, d):
    """Extracted field maps per customer, some incomplete or empty, over the four validated types and one unknown."""
    k = F.col("c_custkey")
    types = F.array(*map(F.lit, ["passport", "emirates_id", "aadhaar_card", "driving_license", "other"]))
    num = F.element_at(F.array(*map(F.lit, ["passport_number", "id_number", "aadhaar_number", "license_number", "number"])), (k % 5 + 1).cast("int"))
    fields = F.map_filter(
        F.create_map(
            num, F.when(k % 3 > 0, k.cast("string")),
            F.lit("name"), F.when(k % 4 > 0, F.col("c_name")).otherwise(""),
            F.lit("date_of_birth"), F.when(k % 2 > 0, F.lit("01/02/1990")),
            F.lit("expiry_date"), F.element_at(F.array(*map(F.lit, ["01/01/2020", "31/12/2030", "2020-01-01"])), (k % 3 + 1).cast("int")),
        ),
        lambda key, v: v.isNotNull() & (k % 11 > 0),
    )
    return T.table(spark, d, "customer").select("c_custkey", F.element_at(types, (k % 5 + 1).cast("int")).alias("document_type"), fields.alias("fields"))


@query("required_fields_validate", """WITH x AS (SELECT c_custkey AS k, ['passport', 'emirates_id', 'aadhaar_card', 'driving_license', 'other'][c_custkey % 5 + 1] AS t,
  ['passport_number', 'id_number', 'aadhaar_number', 'license_number', 'number'][c_custkey % 5 + 1] AS num FROM customer)
SELECT k AS c_custkey, t AS document_type,
  CASE WHEN k % 11 = 0 THEN 'No data extracted' WHEN t = 'other' THEN '' ELSE concat_ws('|',
    CASE WHEN k % 3 = 0 THEN 'Missing required field: ' || num END,
    CASE WHEN k % 4 = 0 THEN 'Missing required field: name' END,
    CASE WHEN t = 'passport' AND k % 2 = 0 THEN 'Missing required field: date_of_birth' END) END AS errors,
  CASE WHEN k % 11 > 0 AND k % 3 = 0 THEN 'Document appears to be expired' ELSE '' END AS warnings,
  NOT (k % 11 = 0 OR (t <> 'other' AND (k % 3 = 0 OR k % 4 = 0 OR (t = 'passport' AND k % 2 = 0)))) AS is_valid FROM x""")
def required_fields_validate(spark, d):
    v = Fi.validate_fields(extracted(spark, d), AS_OF)
    return v.select("c_custkey", "document_type", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "is_valid")


@query("upload_validate", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN 'EMPTY_FILENAME'
  WHEN l_quantity = 1 THEN 'EMPTY_FILE' WHEN l_linenumber = 6 THEN 'UNSUPPORTED_FORMAT'
  WHEN CAST(l_extendedprice * 200 * (CASE WHEN l_quantity = 1 THEN 0 ELSE 1 END) AS BIGINT) > 10485760 THEN 'FILE_TOO_LARGE'
  WHEN CAST(l_extendedprice * 200 AS BIGINT) < 1000 THEN 'INVALID_IMAGE'
  WHEN l_quantity * 40 < 100 OR l_partkey % 9000 < 100 THEN 'IMAGE_TOO_SMALL'
  WHEN l_quantity * 40 > 8000 OR l_partkey % 9000 > 8000 THEN 'IMAGE_TOO_LARGE' END AS error_code FROM lineitem""")
def upload_validate(spark, d):
    li = T.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    up = li.select(
        "l_orderkey", "l_linenumber",
        F.when((n == 7) & (F.col("l_tax") == 0), " ").when(n == 6, "scan.exe").when(n == 5, "scan").otherwise("scan.v2.JPG").alias("filename"),
        F.when(F.col("l_quantity") == 1, 0).otherwise(F.round(F.col("l_extendedprice") * 200).cast("bigint")).alias("size"),
        (F.col("l_quantity") * 40).alias("width"), (F.col("l_partkey") % 9000).alias("height"),
    )
    return Fi.validate_uploads(up).select("l_orderkey", "l_linenumber", "error_code")


@query("option_range_validate", """SELECT o_orderkey, CASE WHEN o_totalprice / 400000 < 0 OR o_totalprice / 400000 > 1 THEN 'INVALID_THRESHOLD'
  WHEN o_custkey - 5 <= 0 OR o_custkey - 5 > 300 THEN 'INVALID_TIMEOUT' WHEN o_orderkey % 120 > 90 THEN 'INVALID_RANGE' END AS error_code FROM orders""")
def option_range_validate(spark, d):
    o = T.table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 400000).alias("confidence_threshold"), (F.col("o_custkey") - 5).alias("max_processing_time"),
        (F.col("o_orderkey") % 120).alias("range_days"),
    )
    # Option limits as (low, high, low excluded, code).
    rules = {
        "confidence_threshold": (0, 1, False, "INVALID_THRESHOLD"),
        "max_processing_time": (0, 300, True, "INVALID_TIMEOUT"),
        "range_days": (0, 90, False, "INVALID_RANGE"),
    }
    return Fi.validate_ranges(o, rules).select("o_orderkey", "error_code")


# ---- joins ----


@query("scans_with_users", f"WITH {S}, {T.USERS_SQL} SELECT id, user_id, username, role FROM scan_history LEFT JOIN (SELECT * FROM users WHERE role <> 'BUILDING') u USING (user_id)")
def scans_with_users(spark, d):
    u = T.users(spark, d).filter("role <> 'BUILDING'")
    return J.scans_with_users(T.scan_history(spark, d), u).select("id", "user_id", "username", "role")


@query("batch_with_documents", f"WITH {T.JOBS_SQL}, {T.DOCS_SQL} SELECT job_id, status, doc_no, success FROM batch_jobs JOIN batch_documents USING (job_id)")
def batch_with_documents(spark, d):
    return J.batch_with_documents(T.batch_jobs(spark, d), T.batch_documents(spark, d)).select("job_id", "status", "doc_no", "success")


@query("usage_for_user_keys", f"""WITH {T.API_SQL} SELECT api_key_id, count(*) AS requests FROM api_requests
WHERE api_key_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def usage_for_user_keys(spark, d):
    keys = T.users(spark, d).filter("role = 'BUILDING'").select(F.col("user_id").alias("api_key_id"))
    return J.usage_for_keys(T.api_requests(spark, d), keys).groupBy("api_key_id").agg(F.count("*").alias("requests"))


@query("inactive_types", f"""WITH {S} SELECT DISTINCT document_type FROM scan_history WHERE document_type NOT IN
(SELECT document_type FROM scan_history WHERE created_at >= TIMESTAMP '2024-01-30 23:50:00')""")
def inactive_types(spark, d):
    s = T.scan_history(spark, d)
    cut = F.lit("2024-01-30 23:50:00").cast("timestamp_ntz")
    return J.inactive(s.select("document_type").distinct(), s.filter(F.col("created_at") >= cut), "document_type")


def webhook_configs(spark, d):
    c = T.table(spark, d, "customer")
    lists = F.array(*[F.array(*map(F.lit, x)) for x in (["click", "error"], ["purchase"], ["signup", "click"], ["none"])])
    return c.select(
        F.col("c_custkey").alias("config_id"), (F.col("c_custkey") % 200).alias("user_id"),
        F.concat(F.lit("https://hooks.example.com/"), F.col("c_custkey").cast("string")).alias("url"),
        F.element_at(lists, (F.col("c_nationkey") % 4 + 1)).alias("events"), (F.col("c_acctbal") > 0).alias("is_active"),
    )


def webhook_events(spark, d):
    t = F.when(F.col("event_type") == "view", "test").otherwise(F.col("event_type"))
    return T.table(spark, d, "events").select("event_id", "user_id", t.alias("event_type"))


@query("webhook_fanout", """WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'test' ELSE event_type END AS event_type FROM events),
c AS (SELECT c_custkey AS config_id, c_custkey % 200 AS user_id, 'https://hooks.example.com/' || c_custkey AS url,
  [['click', 'error'], ['purchase'], ['signup', 'click'], ['none']][c_nationkey % 4 + 1] AS events FROM customer WHERE c_acctbal > 0)
SELECT e.event_id, e.user_id, e.event_type, config_id, url FROM e JOIN c ON e.user_id = c.user_id
AND (list_contains(events, event_type) OR event_type = 'test')""")
def webhook_fanout(spark, d):
    return J.webhook_fanout(webhook_events(spark, d), webhook_configs(spark, d))


_NAMES = ["Aadhaar Card", " UAE ID ", "british passport", "EU ID CARD", "green card", "library card", "PAN_CARD", "My Number Card", "Driving Licence", "us driver's license"]


@query("alias_to_code", f"""WITH a(name, code) AS (VALUES {', '.join(f'({lit(k)}, {lit(v)})' for k, v in C.aliases().items())}),
n AS (SELECT c_custkey, [{', '.join(map(lit, _NAMES))}][c_custkey % {len(_NAMES)} + 1] AS type_name FROM customer)
SELECT c_custkey, type_name, coalesce(code, 'unknown') AS code FROM n LEFT JOIN a ON lower(trim(type_name)) = name""")
def alias_to_code(spark, d):
    n = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % len(_NAMES) + 1).cast("int"))
    return J.alias_to_code(T.table(spark, d, "customer").select("c_custkey", n.alias("type_name")), "type_name", C.aliases())


_KEYWORDS = {k: t for _, t, _, _, kws, _, ti in C.COUNTRY_RULES for k in [*kws, *ti]} | {"copyright": "license", "password": "secret", "email": "contact", "token": "secret"}


@query("keyword_match_join", f"""WITH k(keyword, kind) AS (VALUES {', '.join(f'({lit(k.lower())}, {lit(v)})' for k, v in _KEYWORDS.items())})
SELECT doc_id, lang, kind, keyword FROM documents JOIN k ON contains(lower(text), keyword)""")
def keyword_match_join(spark, d):
    docs = T.spread(T.table(spark, d, "documents").select("doc_id", "lang", "text"))
    return J.keyword_matches(docs, {k.lower(): v for k, v in _KEYWORDS.items()})


@query("phrase_match_join", r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) AS phrase FROM w)
SELECT doc_id, lang, item_id, phrase FROM documents JOIN p ON contains(lower(text), phrase)""")
def phrase_match_join(spark, d):
    """Documents that contain three successive words of a benchmark item: a rule table that grows with its source."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"))
    # The words are bound once for each item: written in place of `w` they would be found again for each three.
    threes = lambda w: F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " ")))
    items = T.spread(T.table(spark, d, "benchmark"))
    table = items.select("item_id", F.explode(F.transform(F.array(words), threes)[0]).alias("phrase")).distinct()
    return P.phrase_matches(T.spread(T.table(spark, d, "documents").select("doc_id", "lang", "text")), table)


@query("hamming_duplicates", f"""WITH {T.HASH_SQL}, h AS (SELECT bits, min(id) AS id, count(*) AS copies FROM image_hashes GROUP BY bits)
SELECT a.id AS id1, b.id AS id2, CAST(hamming(a.bits, b.bits) AS INTEGER) AS distance, a.copies AS copies1, b.copies AS copies2
FROM h a JOIN h b ON a.id < b.id AND hamming(a.bits, b.bits) <= 5""")
def hamming_duplicates(spark, d):
    h = D.distinct_hashes(T.image_hashes(spark, d), "id", "phash")
    return D.near_pairs(h).select("id1", "id2", "distance", "copies1", "copies2")


@query("first_duplicate_of", f"""WITH {T.HASH_SQL}
SELECT id, matching_id, distance FROM (SELECT a.id, b.id AS matching_id, CAST(hamming(a.bits, b.bits) AS INTEGER) AS distance,
  row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rn
  FROM image_hashes a JOIN image_hashes b ON b.id < a.id AND hamming(a.bits, b.bits) <= 5) WHERE rn = 1""")
def first_duplicate_of(spark, d):
    rows = T.image_hashes(spark, d)
    h = D.distinct_hashes(rows, "id", "phash")
    return D.first_duplicates(rows, h, "id", "phash")


@query("exact_duplicates", """SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark, d):
    return D.exact_duplicates(T.table(spark, d, "documents"), "doc_id", "text")


@query("cooccurring_keys", f"""WITH {S},
x AS (SELECT CAST(created_at AS DATE) AS day, CAST(floor(epoch(created_at)) AS BIGINT) AS s, document_type AS k FROM scan_history),
p AS (SELECT a.k AS key, b.k AS influenced_by FROM x a JOIN (SELECT DISTINCT day, s, k FROM x) b
  ON a.day = b.day AND a.k <> b.k AND b.s > a.s - 60 AND b.s <= a.s GROUP BY a.day, a.s, a.k, b.k, a.rowid_)
SELECT key, influenced_by, count(*) AS times, CAST(count(*) AS DOUBLE) * 0.1::DOUBLE AS influence FROM p GROUP BY ALL""".replace(
    "document_type AS k FROM", "document_type AS k, id AS rowid_ FROM"))
def cooccurring_keys(spark, d):
    s = T.scan_history(spark, d).withColumn("day", F.to_date("created_at"))
    return J.cooccurring_keys(s, "day", "document_type", "created_at")


@query("feedback_accuracy", """SELECT lang, count(*) AS items, count(*) FILTER (CAST(n_chars > 800 AS INTEGER) = quality) AS correct,
  CAST(count(*) FILTER (CAST(n_chars > 800 AS INTEGER) = quality) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS accuracy
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def feedback_accuracy(spark, d):
    p = T.table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 800).cast("int").alias("predicted"))
    return J.feedback_accuracy(p, T.table(spark, d, "labels").select("doc_id", F.col("quality").alias("actual")), "doc_id", "lang")


def _fields(spark, d):
    k = F.col("c_custkey")
    c = T.table(spark, d, "customer")
    first = c.select("c_custkey", F.when(k % 3 > 0, F.col("c_name")).alias("full_name"), F.when(k % 4 > 0, F.col("c_mktsegment")).otherwise(" ").alias("segment"))
    second = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.concat(F.lit("Order-"), F.col("o_orderkey").cast("string"))).alias("full_name"), F.min("o_orderpriority").alias("segment")
    )
    return first, second


@query("fill_gaps_merge", """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS full_name,
  CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM customer),
b AS (SELECT o_custkey AS c_custkey, max('Order-' || o_orderkey) AS full_name, min(o_orderpriority) AS segment FROM orders GROUP BY 1)
SELECT a.c_custkey, coalesce(a.full_name, b.full_name) AS full_name, coalesce(a.segment, b.segment) AS segment,
  (a.full_name IS NULL AND b.full_name IS NOT NULL) OR (a.segment IS NULL AND b.segment IS NOT NULL) AS assisted FROM a LEFT JOIN b USING (c_custkey)""")
def fill_gaps_merge(spark, d):
    first, second = _fields(spark, d)
    return J.fill_gaps(first, second, "c_custkey", ["full_name", "segment"])


@query("apply_corrections", """WITH k AS (SELECT o_custkey AS c_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'full_name' WHEN 1 THEN 'segment' ELSE 'other' END AS field,
  CASE WHEN o_orderkey % 10 > 0 THEN 'C' || o_orderkey ELSE '' END AS corrected, o_orderkey FROM orders),
m AS (SELECT c_custkey, arg_max(corrected, o_orderkey) FILTER (field = 'full_name' AND corrected <> '') AS n,
  arg_max(corrected, o_orderkey) FILTER (field = 'segment' AND corrected <> '') AS s FROM k GROUP BY 1)
SELECT c_custkey, coalesce(n, c_name) AS full_name, coalesce(s, c_mktsegment) AS segment FROM customer LEFT JOIN m USING (c_custkey)""")
def apply_corrections(spark, d):
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey")
    corr = o.select(
        F.col("o_custkey").alias("c_custkey"),
        F.when(k % 3 == 0, "full_name").when(k % 3 == 1, "segment").otherwise("other").alias("field"),
        F.when(k % 10 > 0, F.concat(F.lit("C"), k.cast("string"))).otherwise("").alias("corrected"), "o_orderkey",
    )
    c = T.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment"))
    return J.apply_corrections(c, corr, "c_custkey", ["full_name", "segment"], "o_orderkey")


# ---- sort, top-k, set operations ----


@query("top_users", f"WITH {S} SELECT user_id, count(*) AS scans FROM scan_history GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_users(spark, d):
    return R.top_users(T.scan_history(spark, d))


@query("order_by_spec", f"WITH {T.JOBS_SQL} SELECT job_id, priority, created_at FROM batch_jobs")
def order_by_spec(spark, d):
    return Fi.order_by_spec(T.batch_jobs(spark, d).select("job_id", "priority", "created_at"), "created_at DESC", ["job_id"])


@query("best_candidate", """WITH c AS (SELECT conv_id, turn, 0.4::DOUBLE * (length(text) % 100) + least(length(text), 100)::DOUBLE / 100.0 * 20.0
  + least(len(list_distinct(string_split(lower(text), ''))), 20)::DOUBLE / 20.0 * 20.0 + greatest(0.0, 20.0 - turn::DOUBLE) / 20.0 * 20.0 AS s FROM conversations)
SELECT conv_id, turn, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS rn FROM c) WHERE rn = 1""")
def best_candidate(spark, d):
    c = T.table(spark, d, "conversations")
    s = R.candidate_score(F.col("text"), (F.length("text") % 100).cast("double"), F.col("turn").cast("double"))
    return R.best_candidate(c, "conv_id", "turn", s)


def context_entries(spark, d):
    """Context settings: one context per user and day, one key per document type, latest setting kept."""
    s = T.scan_history(spark, d)
    return s.select(
        F.col("session_id").alias("context_id"),
        F.element_at(F.array(F.lit("immediate"), F.lit("session"), F.lit("historical")), F.col("k") % 3 + 1).alias("layer"),
        F.col("document_type").alias("key"), F.col("processing_time").alias("value"), F.col("confidence_score").alias("confidence"),
        F.lit("scan").alias("source"), F.col("id"),
        F.timestamp_diff("SECOND", F.col("created_at"), F.lit(AS_OF).cast("timestamp_ntz")).alias("age_seconds"),
    )


ENTRY_SQL = f"""entries AS (SELECT session_id AS context_id, ['immediate', 'session', 'historical'][k % 3 + 1] AS layer, document_type AS key,
  processing_time AS value, confidence_score AS confidence, 'scan' AS source, id,
  date_sub('second', created_at, TIMESTAMP '{AS_OF}') AS age_seconds FROM scan_history)"""


@query("merge_contexts_union", f"""WITH {S}, {ENTRY_SQL}
SELECT layer, key, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY layer, key ORDER BY context_id, id) AS rn FROM entries) WHERE rn = 1""")
def merge_contexts_union(spark, d):
    return R.merge_union(context_entries(spark, d), ["layer", "key"], ["context_id", "id"], ["value", "confidence"])


@query("merge_contexts_weighted", f"""WITH {S}, {ENTRY_SQL}, w AS (SELECT *, confidence * (1.0::DOUBLE / (1.0::DOUBLE + CAST(age_seconds AS DOUBLE) / 3600.0)) AS w FROM entries)
SELECT layer, key, value, w AS confidence, 'merged:' || source AS source
FROM (SELECT *, row_number() OVER (PARTITION BY layer, key ORDER BY w DESC, context_id, id) AS rn FROM w) WHERE rn = 1""")
def merge_contexts_weighted(spark, d):
    return R.merge_weighted(context_entries(spark, d), ["layer", "key"], ["context_id", "id"], ["value"])


@query("evict_lowest_20pct", f"""WITH {T.MEM_SQL}, s AS (SELECT memory_id, importance AS score, row_number() OVER (ORDER BY importance, memory_id) AS rank, count(*) OVER () AS n FROM memories)
SELECT memory_id, score, rank FROM s WHERE n > 200 * 0.8 AND rank <= floor(n * 0.2::DOUBLE)""")
def evict_lowest_20pct(spark, d):
    return W.evict_lowest(T.memories(spark, d), F.col("importance"), "memory_id", capacity=200)
