"""Text screening: sanitising, malicious content, injection flags, fraud indicators and scores."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.rules import any_of, hits, let, let_sql, match_any, match_lower, strip
from scanmill.session import stored

# Suspicious content patterns, in report order.
SUSPICIOUS = [
    r"<script.*?>.*?</script>", r"javascript:", r"vbscript:", r"on[\p{L}\p{N}_]+\s*=", r"eval\s*\(", r"exec\s*\(", r"system\s*\(",
    r"union\s+select", r"or\s+1\s*=\s*1", r"drop\s+table", r"delete\s+from", r"[;&|`$]", r"\.\./|\.\.\\",
]
# Keys whose values are images or credentials and are not scanned, and payload limits.
UNSCANNED_KEYS = ["image", "imageData", "base64", "file", "data", "password", "secret", "token", "api_key"]
MAX_PAYLOAD = 1024 * 1024
MAX_DEPTH = 10


def scan_malicious(df: DataFrame, col: str) -> DataFrame:
    """Safe flag and the numbers of the matching patterns."""
    tests = ", ".join(f"CASE WHEN {match_lower('low', p)} THEN {i} END" for i, p in enumerate(SUSPICIOUS))
    hits_ = F.expr(let_sql(f"lower({col})", "low", f"array_compact(array({tests}))"))
    return df.withColumn("hits", hits_).withColumn("is_safe", F.size("hits") == 0)


def _hit_number(low: str) -> str:
    return " + ".join(f"int({match_lower(low, p)})" for p in SUSPICIOUS)


def json_payload_scan(df: DataFrame, col: str) -> DataFrame:
    """Size, syntax, nesting and strings of a JSON payload: is_valid, reason, hits, depth and too_large.

    The payload is parsed once into a variant and opened level by level until no container is left; a level is written to the
    shared folder with the number of matching patterns of each key and string, so that only containers go on to the next.
    Payloads of any size and depth are scanned; size and depth above the limits are findings, in the order too large,
    invalid, too deep, malicious. Values below an unscanned key and inline images are opened, for the depth, but not
    matched. A key that an object holds twice makes it invalid; a null payload has null results.
    """
    spark = df.sparkSession
    base = stored(df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_root", F.try_parse_json(col)))
    nodes = base.where("_root is not null").selectExpr("_id", "0 as depth", "true as by", "cast(null as string) as key", "_root as value")
    skipped = ", ".join(f"'{k}'" for k in UNSCANNED_KEYS)
    levels = []
    while True:
        kinds = nodes.selectExpr("*", "schema_of_variant(value) as kind", f"by and coalesce(key not in ({skipped}), true) as scanned")
        strings = kinds.selectExpr(
            "_id", "depth", "scanned", "kind rlike '^(OBJECT|ARRAY)' as holds", "value", "if(by, lower(key), null) as low_key",
            "if(scanned and kind = 'STRING', lower(variant_get(value, '$', 'string')), null) as low",
        )
        found = f"coalesce({_hit_number('low_key')}, 0) + coalesce(if(low like 'data:image%', 0, {_hit_number('low')}), 0)"
        level = stored(strings.selectExpr("_id", "depth", "scanned", f"{found} as found", "if(holds, value, null) as value"))
        levels.append(level.select("_id", "depth", "found"))
        inside = level.where("value is not null")
        if inside.isEmpty():
            break
        opened = inside.alias("t").lateralJoin(spark.tvf.variant_explode(F.col("t.value").outer()).alias("e"))
        nodes = opened.selectExpr("t._id", "t.depth + 1 as depth", "t.scanned as by", "e.key", "e.value")
    seen = functools.reduce(DataFrame.unionAll, levels).groupBy("_id").agg(F.max("depth").alias("_depth"), F.sum("found").cast("int").alias("_found"))
    given = f"`{col}` is not null"
    reason = f"case when not {given} then null when too_large then 'too large' when depth is null then 'invalid' when depth > {MAX_DEPTH} then 'too deep' when hits > 0 then 'malicious' else 'ok' end"
    joined = base.join(seen, "_id", "left").selectExpr(
        *(f"`{c}`" for c in df.columns), f"if({given}, coalesce(_found, 0), null) as hits", "_depth as depth", f"length(`{col}`) > {MAX_PAYLOAD} as too_large"
    )
    judged = joined.withColumn("reason", F.expr(reason)).withColumn("is_valid", F.expr("reason = 'ok'"))
    return judged.select(*df.columns, "is_valid", "reason", "hits", "depth", "too_large")


# SQL, script and path patterns of the input validator.
SQL_PATTERNS = [
    r"(?:union|select|insert|delete|update|drop|create|alter|exec|execute)", r"(?:or|and)\s+[0-9]+\s*=\s*[0-9]+",
    r"(?:or|and)\s+[\p{L}\p{N}_]+\s*=\s*[\p{L}\p{N}_]+", r"(?:--|#|/\*|\*/)", r"(?:xp_|sp_|fn_)",
]
XSS_PATTERNS = [
    r"<script[^>]*>.*?</script>", r"javascript:", r"vbscript:", r"onload\s*=", r"onerror\s*=", r"onclick\s*=", r"onmouseover\s*=",
    r"<iframe[^>]*>", r"<object[^>]*>", r"<embed[^>]*>",
]
TRAVERSAL = [
    "../", "..\\", "..%2f", "..%5c", "%2e%2e%2f", "%2e%2e%5c", "..%252f", "..%255c", "..%c0%af", "..%c1%9c",
]


def unquote(c: Column) -> Column:
    """Percent-decoding that leaves malformed escapes and ``+`` alone."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), c)


def injection_flags(df: DataFrame, col: str) -> DataFrame:
    """Booleans for SQL injection, script injection and path traversal."""
    c = F.col(col)
    decoded = unquote(unquote(unquote(c)))

    def bad_path(p: Column) -> Column:
        low = F.lower(p)
        return (
            F.exists(F.array(*[F.lit(t) for t in TRAVERSAL]), lambda t: F.contains(low, t))
            | low.startswith("/") | low.startswith("\\") | (F.substring(low, 2, 1) == ":")
            | p.rlike(r"^(?:\./)*\.\.(?:/|$)")
        )

    return df.withColumns(
        {
            "sql_injection": F.expr(let_sql(f"lower({col})", "low", match_any("low", SQL_PATTERNS))),
            "xss": F.expr(let_sql(f"lower({col})", "low", match_any("low", XSS_PATTERNS))),
            "path_traversal": bad_path(c) | let(decoded, bad_path),
        }
    )


# Parts removed from user text.
REMOVED = ["<[^>]*>", "(?i)javascript:", "(?i)vbscript:", "(?i)onload=", "(?i)onerror="]


def sanitize_text(c: Column, max_chars: int | None = None) -> Column:
    """Without tags, script schemes, handlers and control characters; optionally cut to a length."""
    for p in REMOVED:
        c = F.regexp_replace(c, p, "")
    c = strip(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.left(c, F.lit(max_chars)) if max_chars else c


def sanitize_filename(c: Column) -> Column:
    """File name without reserved characters and dot runs, at most 255 long with its suffix kept."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"\.+", "."), r"^\.+|\.+$", "")

    def cut(x: Column) -> Column:
        ext = F.regexp_extract(x, r"(\.[^.]*)$", 1)
        base = F.left(F.regexp_replace(x, r"\.[^.]*$", ""), F.lit(250))
        return F.when(F.length(x) > 255, F.concat(base, ext)).when(x == "", F.lit("unnamed_file")).otherwise(x)

    return F.coalesce(let(t, cut), F.lit("unnamed_file"))


# Words of known frauds, expected layout words and indicator limits.
FRAUD_WORDS = {"common_fraud_1": ["fake", "counterfeit", "specimen"], "template_substitution": ["template", "sample", "example"]}
LAYOUT_WORDS = ["name", "date", "number", "address"]
MAX_UNUSUAL = 0.3
MIN_SECONDS = 0.1


def fraud_indicators(df: DataFrame, text: str, seconds: str, confidence: str) -> DataFrame:
    """Array of indicator names in fixed order, all from one pass over the text."""
    c = F.col(text)
    unusual = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    lengths = F.transform(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0), lambda w: F.length(w).cast("bigint"))
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("q"))
    sums = lambda ls: F.aggregate(ls, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    # deviation > 1.5 * mean, as whole numbers: 4*n*sum(x^2) > 13*sum(x)^2.
    uneven = let(
        lengths,
        lambda ls: (F.size(ls) >= 2) & let(sums(ls), lambda a: F.lit(4) * F.size(ls) * a["q"] > F.lit(13) * a["s"] * a["s"]),
    )
    scripts = (
        c.rlike(r"[\x00-\x7F]").cast("int") + c.rlike(r"[\x{0900}-\x{097F}]").cast("int") + c.rlike(r"[\x{0600}-\x{06FF}]").cast("int")
    )
    known = [F.expr(f"CASE WHEN {any_of(ws, f'lower({text})')} THEN 'matches_known_fraud_pattern_{n}' END") for n, ws in FRAUD_WORDS.items()]
    layout = F.expr(let_sql(f"lower({text})", "low", hits(LAYOUT_WORDS, "low")))
    found = F.array_compact(
        F.array(
            F.when((F.length(c) > 0) & (unusual.cast("double") / F.length(c) > MAX_UNUSUAL), F.lit("font_inconsistency")),
            F.when(uneven, F.lit("spacing_irregularity")),
            F.when(scripts > 2, F.lit("language_inconsistency")),
            F.when(layout < 2, F.lit("template_mismatch")),
            F.when(F.coalesce(F.col(seconds), F.lit(0.0)) < MIN_SECONDS, F.lit("suspiciously_fast_processing")),
            F.when(F.coalesce(F.col(confidence), F.lit(1.0)) == 1.0, F.lit("perfect_confidence_anomaly")),
            *known,
        )
    )
    return df.withColumn("indicators", found)


# Advice texts.
ADVICE = {
    "manual": "Document requires manual verification",
    "features": "Document lacks expected security features",
    "quality": "Image quality is too low for reliable verification",
    "tampering": "Text shows signs of possible tampering",
    "fine": "Document appears authentic",
}


def fraud_scores(df: DataFrame, indicators: str = "indicators", features: str = "security_features") -> DataFrame:
    """Fraud and authenticity scores, risk band, pass rule and advice."""
    n, f = F.size(indicators), F.size(features)
    fraud = F.least(n * F.lit(0.2), F.lit(1.0))
    auth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + f * F.lit(0.1) - n * F.lit(0.15)))
    risk = (F.col("fraud_score") + (F.lit(1.0) - F.col("authenticity_score"))) / 2.0
    level = F.col("fraud_risk_level")
    advice = F.array_compact(
        F.array(
            F.when(F.col("authenticity_score") < 0.5, F.lit(ADVICE["manual"])),
            F.when(f < 2, F.lit(ADVICE["features"])),
            F.when(F.array_contains(indicators, "excessive_compression"), F.lit(ADVICE["quality"])),
            F.when(F.array_contains(indicators, "font_inconsistency"), F.lit(ADVICE["tampering"])),
        )
    )
    return (
        df.withColumns({"fraud_score": fraud, "authenticity_score": auth})
        .withColumn("fraud_risk_level", F.when(risk < 0.3, "LOW").when(risk < 0.6, "MEDIUM").when(risk < 0.8, "HIGH").otherwise("CRITICAL"))
        .withColumn("validation_passed", ~level.isin("HIGH", "CRITICAL") & (F.col("authenticity_score") >= 0.4))
        .withColumn("advice", F.when(F.size(advice) == 0, F.array(F.lit(ADVICE["fine"]))).otherwise(advice))
    )


def content_fingerprint(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("text_hash", F.sha2(text, 256)).withColumn("text_length", F.length(text))
