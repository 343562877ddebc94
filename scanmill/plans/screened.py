"""Registered screening, quality and confidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.functions import classify as K
from scanmill.functions import document_info as DI
from scanmill.functions import identifiers as I
from scanmill.functions import quality as Q
from scanmill.functions import screening as X
from scanmill.operators import aggregates as A
from scanmill.plans import rule_sql as R
from scanmill.plans.registry import query
from scanmill.plans.textual import C, _coarse_sql
from scanmill.sources import tables as T
from scanmill.sources.identity import corpus, quote


def listed(*pairs) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN {quote(t)} END" for c, t in pairs) + ")"


def joined(c: str):
    return F.array_join(c, "|").alias(c)


# ---- screening ----


@query("malicious_content_scan", f"""SELECT page_id, concat_ws('|', {', '.join(f"CASE WHEN {R.rx('html', p, True)} THEN '{i}' END" for i, p in enumerate(X.SUSPICIOUS))}) AS hits,
  NOT ({' OR '.join(R.rx('html', p, True) for p in X.SUSPICIOUS)}) AS is_safe FROM pages""")
def malicious_content_scan(spark, d):
    p = X.scan_malicious(T.spread(T.table(spark, d, "pages").select("page_id", "html")), "html")
    return p.select("page_id", F.array_join(F.col("hits").cast("array<string>"), "|").alias("hits"), "is_safe")


def json_pages(spark, d):
    """Pages as JSON payloads: url and nested html are scanned, the image value is not.

    Every 40th page holds its html as often as makes it larger than a payload may be, every 40th next to it is nested too deep.
    """
    p = T.spread(T.table(spark, d, "pages")).withColumn("html", F.coalesce("html", F.lit("")))
    times = F.expr(f"if(page_id % 40 = 7 and html <> '', cast({X.MAX_PAYLOAD} / length(html) + 1 as int), 1)")
    deep = F.expr("if(page_id % 40 = 8, from_json(concat(repeat('[', 12), '1', repeat(']', 12)), 'array<array<array<array<array<array<array<array<array<array<array<array<int>>>>>>>>>>>>'), null)")
    body = F.struct("page_id", "url", F.struct(F.array_repeat("html", times).alias("parts")).alias("meta"), F.col("html").alias("image"), deep.alias("more"))
    return p.select("page_id", F.to_json(body).alias("payload"))


def _hit_count(e: str) -> str:
    return " + ".join(f"CAST({R.rx(e, p, True)} AS INTEGER)" for p in X.SUSPICIOUS)


@query("json_payload_scan", f"""SELECT page_id, NOT too_large AND n = 0 AND depth <= 10 AS is_valid,
  CASE WHEN too_large THEN 'too large' WHEN depth > 10 THEN 'too deep' WHEN n > 0 THEN 'malicious' ELSE 'ok' END AS reason, CAST(n AS INTEGER) AS hits, depth, too_large
FROM (SELECT page_id, page_id % 40 = 7 AND html <> '' AS too_large, CASE WHEN page_id % 40 = 8 THEN 13 ELSE 3 END AS depth,
  {_hit_count('url')} + ({_hit_count('html')}) * CASE WHEN page_id % 40 = 7 AND html <> '' THEN {X.MAX_PAYLOAD} // length(html) + 1 ELSE 1 END AS n FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages))""")
def json_payload_scan(spark, d):
    return X.json_payload_scan(json_pages(spark, d), "payload").drop("payload")


def paths(spark, d):
    """File paths per customer: plain, absolute, drive, encoded and doubly encoded climbs."""
    k = F.col("c_custkey")
    forms = ["docs/file_", "/etc/file_", "c:/file_", "a/../file_", "%2e%2e%2ffile_", "%252e%252e%252ffile_", "..", "x%zz+file_", "a\\..\\file_"]
    return T.table(spark, d, "customer").select(
        "c_custkey", F.concat(F.element_at(F.array(*map(F.lit, forms)), (k % len(forms) + 1).cast("int")), F.when(k % len(forms) == 6, "").otherwise(k.cast("string"))).alias("path")
    )


@query("injection_paths", "SELECT c_custkey, c_custkey % 9 IN (1, 2, 3, 4, 5, 6, 8) AS path_traversal FROM customer")
def injection_paths(spark, d):
    return X.injection_flags(paths(spark, d), "path").select("c_custkey", "path_traversal")


@query("injection_flags", C(f"""SELECT doc_id, {R.rx('text', '|'.join(X.SQL_PATTERNS), True)} AS sql_injection, {R.rx('text', '|'.join(X.XSS_PATTERNS), True)} AS xss FROM c"""))
def injection_flags(spark, d):
    return X.injection_flags(corpus(spark, d), "text").select("doc_id", "sql_injection", "xss")


def _sanitize_sql(e: str) -> str:
    for p in X.REMOVED:
        e = f"regexp_replace({e}, {quote(p)}, '', 'g')"
    ctl = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
    return R.strip(f"regexp_replace({e}, {quote(ctl)}, '', 'g')")


@query("sanitize_text", f"SELECT page_id, sha256({_sanitize_sql('html')}) AS clean_hash, CAST(length({_sanitize_sql('html')}) AS INTEGER) AS clean_length FROM pages")
def sanitize_text(spark, d):
    p = T.spread(T.table(spark, d, "pages").select("page_id", "html")).withColumn("clean", X.sanitize_text(F.col("html")))
    return p.select("page_id", F.sha2("clean", 256).alias("clean_hash"), F.length("clean").alias("clean_length"))


@query("sanitize_filename", """WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url || CASE WHEN page_id % 3 = 0 THEN repeat('x', 300) || '..pdf' ELSE '.' END,
  '[<>:"/\\\\|?*]', '_', 'g'), '\\.+', '.', 'g'), '^\\.+|\\.+$', '', 'g') AS f FROM pages)
SELECT page_id, CASE WHEN length(f) > 255 THEN substr(regexp_replace(f, '\\.[^.]*$', ''), 1, 250) || regexp_extract(f, '(\\.[^.]*)$', 1) ELSE f END AS filename FROM t""")
def sanitize_filename(spark, d):
    raw = F.concat("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.repeat(F.lit("x"), 300), F.lit("..pdf"))).otherwise("."))
    return T.table(spark, d, "pages").select("page_id", X.sanitize_filename(raw).alias("filename"))


@query("email_valid", "SELECT c_custkey, c_custkey % 5 NOT IN (1, 2, 4) AS valid_email, c_custkey % 4 IN (0, 2) AS valid_ip FROM customer")
def email_valid(spark, d):
    k = F.col("c_custkey")
    s = k.cast("string")
    mail = F.element_at(F.array(F.concat(F.lit("u"), s, F.lit("@example.com")), F.concat(F.lit("u"), s, F.lit("@example")), F.concat(F.lit("u "), s, F.lit("@a.io")), F.concat(F.lit("a.b+"), s, F.lit("@x-y.org")), s), (k % 5 + 1).cast("int"))
    ip = F.element_at(F.array(F.concat(F.lit("10.0.0."), (k % 256).cast("string")), F.concat(F.lit("10.0.256."), (k % 256).cast("string")), F.concat(F.lit("fe80::"), F.lower(F.hex(k % 65536))), F.lit("host")), (k % 4 + 1).cast("int"))
    return T.table(spark, d, "customer").select("c_custkey", I.email_valid(mail).alias("valid_email"), I.ip_valid(ip).alias("valid_ip"))


@query("content_fingerprint", C("SELECT doc_id, sha256(text) AS text_hash, CAST(length(text) AS INTEGER) AS text_length FROM c"))
def content_fingerprint(spark, d):
    return X.content_fingerprint(corpus(spark, d), "text").drop("text")


def fraud_input(spark, d):
    """Corpus with a processing time, a confidence and the number of security features per document."""
    k = F.col("doc_id")
    n = (k % 4).cast("int")
    return corpus(spark, d).withColumns(
        {"seconds": (k % 20) / 40.0, "confidence": F.when(k % 6 > 0, (k % 5) / 4.0), "security_features": F.slice(F.array(*map(F.lit, ["hologram", "watermark", "microtext"])), F.lit(1), n)}
    )


_UNUSUAL = "length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))"
FRAUD_SQL = f"""w AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws, doc_id % 4 AS nf FROM c),
i AS (SELECT doc_id, nf, [CASE WHEN text <> '' AND CAST({_UNUSUAL} AS DOUBLE) / length(text) > 0.3::DOUBLE THEN 'font_inconsistency' END,
  CASE WHEN len(ws) >= 2 AND 4 * len(ws) * CAST(list_sum(list_transform(ws, lambda x: length(x) * length(x))) AS BIGINT) > 13 * CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) * CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) THEN 'spacing_irregularity' END,
  CASE WHEN CAST({R.rx('text', '[' + chr(92) + 'x00-' + chr(92) + 'x7F]')} AS INTEGER) + CAST({R.rx('text', K.SCRIPTS['hindi'])} AS INTEGER) + CAST({R.rx('text', K.SCRIPTS['arabic'])} AS INTEGER) > 2 THEN 'language_inconsistency' END,
  CASE WHEN {R.count_hits(X.LAYOUT_WORDS, 'low')} < 2 THEN 'template_mismatch' END,
  CASE WHEN doc_id % 20 / 40 < 0.1::DOUBLE THEN 'suspiciously_fast_processing' END,
  CASE WHEN CASE WHEN doc_id % 6 > 0 THEN doc_id % 5 / 4 ELSE 1 END = 1 THEN 'perfect_confidence_anomaly' END,
  {', '.join(f"CASE WHEN {R.count_hits(ws, 'low')} > 0 THEN 'matches_known_fraud_pattern_{n}' END" for n, ws in X.FRAUD_WORDS.items())}] AS all_i FROM w),
fi AS (SELECT doc_id, nf, list_filter(all_i, lambda x: x IS NOT NULL) AS ind FROM i),
fs AS (SELECT *, least(len(ind) * 0.2::DOUBLE, 1.0) AS fraud_score,
  greatest(0.0, least(1.0, 0.5::DOUBLE + nf * 0.1::DOUBLE - len(ind) * 0.15::DOUBLE)) AS authenticity_score FROM fi),
fr AS (SELECT *, CASE WHEN r < 0.3::DOUBLE THEN 'LOW' WHEN r < 0.6::DOUBLE THEN 'MEDIUM' WHEN r < 0.8::DOUBLE THEN 'HIGH' ELSE 'CRITICAL' END AS fraud_risk_level
  FROM (SELECT *, (fraud_score + (1.0 - authenticity_score)) / 2.0 AS r FROM fs)),
fv AS (SELECT *, fraud_risk_level NOT IN ('HIGH', 'CRITICAL') AND authenticity_score >= 0.4::DOUBLE AS validation_passed FROM fr)"""


@query("fraud_text_indicators", C(f", {FRAUD_SQL} SELECT doc_id, array_to_string(ind, '|') AS indicators FROM fi"))
def fraud_text_indicators(spark, d):
    return X.fraud_indicators(fraud_input(spark, d), "text", "seconds", "confidence").select("doc_id", joined("indicators"))


def scored(spark, d):
    return X.fraud_scores(X.fraud_indicators(fraud_input(spark, d), "text", "seconds", "confidence"))


@query("fraud_scoring", C(f""", {FRAUD_SQL} SELECT doc_id, fraud_score, authenticity_score, fraud_risk_level, validation_passed,
  coalesce(nullif({listed(('authenticity_score < 0.5', X.ADVICE['manual']), ('nf < 2', X.ADVICE['features']), ("list_contains(ind, 'font_inconsistency')", X.ADVICE['tampering']))}, ''), {quote(X.ADVICE['fine'])}) AS advice FROM fv"""))
def fraud_scoring(spark, d):
    return scored(spark, d).select("doc_id", "fraud_score", "authenticity_score", "fraud_risk_level", "validation_passed", joined("advice"))


@query("validation_statistics", C(f""", {FRAUD_SQL} SELECT fraud_risk_level, count(*) AS validations, count(*) FILTER (validation_passed) AS passed,
  CAST(count(*) FILTER (validation_passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS pass_rate,
  CAST(sum(CAST(round(authenticity_score * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 100.0 AS average_authenticity FROM fv GROUP BY ROLLUP (fraud_risk_level)"""))
def validation_statistics(spark, d):
    """Per risk level with a total row (null level)."""
    return scored(spark, d).rollup("fraud_risk_level").agg(
        F.count("*").alias("validations"), F.count_if("validation_passed").alias("passed"),
        A.pct(F.count_if("validation_passed"), F.count("*")).alias("pass_rate"), A.mean2("authenticity_score").alias("average_authenticity"),
    )


# ---- quality ----

_I = Q.ISSUES
_S = Q.SUGGESTIONS


@query("image_metric_score", f"""WITH {T.IMAGE_SQL}, s AS (SELECT *, least(greatest(0.0::DOUBLE + least(blur / 100, 1.0::DOUBLE) * 0.25::DOUBLE
  + (CASE WHEN brightness BETWEEN 80 AND 180 THEN 1.0 ELSE greatest(0.0, 1.0 - least(abs(brightness - 80), abs(brightness - 180)) / 100) END) * 0.15::DOUBLE
  + least(contrast / 50, 1.0::DOUBLE) * 0.20::DOUBLE + greatest(0.0, 1.0::DOUBLE - noise) * 0.15::DOUBLE + greatest(0.0, 1.0::DOUBLE - abs(skew) / 45) * 0.10::DOUBLE
  + resolution / 2000 * 0.10::DOUBLE + text_coverage * 0.05::DOUBLE, 0.0), 1.0) AS score FROM image_metrics)
SELECT l_orderkey, l_linenumber, l_partkey, score, CASE WHEN score >= 0.8::DOUBLE THEN 'high' WHEN score >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS confidence,
  {listed(('blur < 100', _I['blur']), ('brightness < 50', _I['dark']), ('brightness > 200', _I['bright']), ('contrast < 30', _I['contrast']), ('noise > 0.1::DOUBLE', _I['noise']), ('skew > 5', _I['skew']), ('resolution / 2000 < 0.7::DOUBLE', _I['resolution']), ('text_coverage < 0.3::DOUBLE', _I['coverage']))} AS issues,
  {listed(('blur < 50', _S['blur']), ('contrast < 25', _S['contrast']), ('brightness < 60', _S['dark']), ('brightness > 190', _S['bright']), ('noise > 0.08::DOUBLE', _S['noise']), ('skew > 3', _S['skew']), ('text_coverage < 0.4::DOUBLE', _S['coverage']))} AS suggestions FROM s""")
def image_metric_score(spark, d):
    m = T.image_metrics(spark, d).withColumn("resolution", F.col("resolution") / 2000)
    return Q.image_quality(m).select("l_orderkey", "l_linenumber", "l_partkey", "score", "confidence", joined("issues"), joined("suggestions"))


_F = Q.FEEDBACK


@query("stream_quality_score", f"""WITH {T.IMAGE_SQL}, s AS (SELECT *, least(blur / 1000, 1.0::DOUBLE) AS a, 1.0::DOUBLE - abs(brightness - 127) / 127 AS b, least(contrast / 64, 1.0::DOUBLE) AS c,
  greatest(0.0, 1.0::DOUBLE - noise / 20) AS e FROM image_metrics), q AS (SELECT *, (a + b + c + e) / 4 AS overall_quality FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, overall_quality, overall_quality >= 0.6::DOUBLE AS is_acceptable,
  coalesce(nullif({listed(('a < 0.5', _F['sharpness']), ('b < 0.5', _F['brightness']), ('c < 0.5', _F['contrast']), ('e < 0.5', _F['noise']))}, ''), {quote(_F['none'])}) AS feedback,
  CASE WHEN overall_quality >= 0.8::DOUBLE THEN 'Excellent' WHEN overall_quality >= 0.6::DOUBLE THEN 'Good' WHEN overall_quality >= 0.4::DOUBLE THEN 'Fair' ELSE 'Poor' END AS grade FROM q""")
def stream_quality_score(spark, d):
    return Q.live_quality(T.image_metrics(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "overall_quality", "is_acceptable", joined("feedback"), "grade")


@query("text_quality_score", C("""SELECT doc_id, doc_id % 101 / 100 * 0.3::DOUBLE + CASE WHEN trim(text) <> '' THEN (least(length(text)::DOUBLE / 100.0, 1.0::DOUBLE)
  + least(len(list_distinct(string_split(text, '')))::DOUBLE / 50.0, 1.0::DOUBLE)) / 2.0 ELSE 0.0 END * 0.7::DOUBLE AS quality FROM c"""))
def text_quality_score(spark, d):
    return corpus(spark, d).select("doc_id", Q.text_quality(F.col("text"), F.col("doc_id") % 101 / 100).alias("quality"))


@query("preprocess_plan", f"""WITH {T.IMAGE_SQL} SELECT l_orderkey, l_linenumber, l_partkey, {listed(*zip(['TRUE', 'resolution / 2000 < 0.8::DOUBLE', 'noise > 0.1::DOUBLE', 'contrast < 30', '(brightness < 80 OR brightness > 180)', 'blur < 100', 'text_coverage / 5 > 0.1::DOUBLE'], Q.STEPS))} AS steps FROM image_metrics""")
def preprocess_plan(spark, d):
    m = T.image_metrics(spark, d).withColumns({"resolution": F.col("resolution") / 2000, "edge_density": F.col("text_coverage") / 5})
    return Q.preprocess_plan(m).select("l_orderkey", "l_linenumber", "l_partkey", joined("steps"))


def result_fields(spark, d):
    """Field maps per customer with the fields that were corrected and whether the result was validated."""
    k = F.col("c_custkey")
    fields = F.create_map(
        F.lit("full_name"), F.when(k % 3 > 0, F.col("c_name")), F.lit("segment"), F.when(k % 4 > 0, F.col("c_mktsegment")).otherwise(" "),
        F.lit("digit"), (k % 10).cast("string"), F.lit("processor"), F.lit("x"),
    )
    return T.table(spark, d, "customer").select(
        "c_custkey", "c_acctbal", fields.alias("fields"), F.when(k % 5 == 0, F.array(F.lit("full_name"))).otherwise(F.array().cast("array<string>")).alias("corrected"), (k % 2 == 0).alias("validated")
    )


@query("field_confidence", """WITH f AS (SELECT c_custkey AS k, unnest([{'f': 'full_name', 'v': CASE WHEN c_custkey % 3 > 0 THEN c_name END},
  {'f': 'segment', 'v': CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE ' ' END}, {'f': 'digit', 'v': CAST(c_custkey % 10 AS VARCHAR)}]) AS x FROM customer),
g AS (SELECT k, x.f AS field, x.v AS value, coalesce(trim(x.v) <> '', FALSE) AS has, k % 5 = 0 AND x.f = 'full_name' AS fixed FROM f)
SELECT k AS c_custkey, field, value, CASE WHEN has AND fixed THEN 85 WHEN has THEN least(50 + CASE WHEN length(value) > 1 THEN 30 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 15 ELSE 0 END, 100) ELSE 0 END / 100 AS confidence,
  CASE WHEN has AND fixed THEN 'vision_corrected' WHEN has AND k % 2 = 0 THEN 'vision_validated' ELSE 'regex_match' END AS method FROM g""")
def field_confidence(spark, d):
    return Q.field_confidence(result_fields(spark, d), ["c_custkey"])


@query("batch_quality_score", """SELECT c_custkey, (c_custkey % 101 / 100 + CASE WHEN c_custkey % 120 > 1 THEN CAST(c_custkey % 120 AS DOUBLE) / 100 ELSE CAST(c_custkey % 120 AS DOUBLE) END
  + CAST(2 + CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 4 > 0 THEN 1 ELSE 0 END AS DOUBLE) / 4) / 3.0 AS quality FROM customer""")
def batch_quality_score(spark, d):
    k = F.col("c_custkey")
    r = result_fields(spark, d).withColumns({"class_conf": k % 101 / 100, "ocr_conf": (k % 120).cast("double")})
    return Q.batch_quality(r, "class_conf", "ocr_conf", "fields").select("c_custkey", "quality")


# ---- general extraction ----


def _first(name: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {quote(R.probe_pattern(p))}, 1), '')" for p in DI.PROBES[name]) + ")"


@query("extract_document_info", C(f""", k AS (SELECT doc_id, text, low, {_coarse_sql()} AS document_type,
  (contains(low, 'emirates id') OR contains(low, 'هوية إماراتية') OR {R.rx('text', DI.EMIRATES)}) AS is_eid,
  (contains(low, 'driving') OR contains(low, 'license') OR contains(low, 'رخصة قيادة')) AS is_lic FROM c),
e AS (SELECT *, CASE WHEN is_eid THEN nullif(regexp_extract(text, {quote(DI.EMIRATES)}, 1), '') END AS eid FROM k)
SELECT doc_id, document_type, replace(eid, '-', '') AS unified_number, CASE WHEN is_lic THEN {_first('license_number')} END AS license_number,
  CASE {' '.join(f"WHEN {R.rx('text', p)} THEN '{v}'" for p, v in DI.GENDER)} END AS gender FROM e"""))
def extract_document_info(spark, d):
    """Fields with a short SQL form; document_info_full has all of them."""
    i = DI.document_info(corpus(spark, d), I.country_table())
    return i.select("doc_id", "document_type", "unified_number", "license_number", "gender")


@query("document_info_full")
def document_info_full(spark, d):
    return DI.document_info(corpus(spark, d), I.country_table()).drop("text")
