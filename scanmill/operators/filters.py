"""Projections, filters and row-level validation expressed as Catalyst predicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
    "$like": lambda c, v: c.like(escape_like(str(v))),
    "$ilike": lambda c, v: c.ilike(escape_like(str(v))),
}


def escape_like(s: str) -> str:
    for ch in ("\\", "%", "_"):
        s = s.replace(ch, "\\" + ch)
    return s


def known_column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"unknown column: {name}")
    return F.col(name)


def apply_filters(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """AND of {column: value} or {column: {operator: value}}; unknown names are errors."""
    preds: list[Column] = []
    for name, want in spec.items():
        c = known_column(df, name)
        for op, v in want.items() if isinstance(want, Mapping) else [("$eq", want)]:
            if op not in _OPS:
                raise ValueError(f"unsupported operator: {op}")
            preds.append(_OPS[op](c, v))
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def like_literal(c: Column, s: str, where: str = "both") -> Column:
    """LIKE whose search term is taken literally."""
    e = escape_like(s)
    return c.like({"both": f"%{e}%", "start": f"{e}%", "end": f"%{e}"}[where])


def order_by_spec(df: DataFrame, spec: str, tie: Sequence[str] = (), allowed: Sequence[str] | None = None) -> DataFrame:
    """Sort by a "column DIRECTION" string; further columns make the order total."""
    parts = spec.split()
    name, direction = parts[0], (parts[1].upper() if len(parts) > 1 else "ASC")
    if direction not in ("ASC", "DESC") or len(parts) > 2:
        raise ValueError(f"invalid sort direction: {spec}")
    if allowed is not None and name not in allowed:
        raise ValueError(f"invalid sort field: {name}")
    c = known_column(df, name)
    return df.orderBy(c.desc() if direction == "DESC" else c.asc(), *tie)


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, per_page: int = 20) -> DataFrame:
    """Rows of one page with the page totals; the order must be total. A page or size out of range is an error."""
    if not 1 <= page <= 10000 or not 1 <= per_page <= 100:
        raise ValueError(f"page must be 1 to 10000 and per_page 1 to 100: {page}, {per_page}")
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / per_page).cast("bigint")).withColumns(
        {"has_next": F.col("pages") > page, "has_prev": F.lit(page > 1)}
    )


# Sort whitelist of the scan search.
SORT_FIELDS = ("created_at", "updated_at", "document_type", "confidence_score", "processing_time")


def search(
    df: DataFrame,
    query: str,
    text_columns: Sequence[str],
    date_from: str | None = None,
    date_to: str | None = None,
    types: Sequence[str] = (),
    sort_by: str = "created_at",
    sort_order: str = "desc",
    page: int = 1,
    per_page: int = 20,
) -> DataFrame:
    """Literal text search with date range, type list, whitelisted sort and paging."""
    import re

    if not re.fullmatch(r"[a-zA-Z0-9\s\-_.@]{1,200}", query) or len(types) > 10:
        raise ValueError("search query contains invalid characters or too many types")
    q = query.lower()
    out = df.filter(reduce(lambda a, b: a | b, [F.lower(c).contains(q) for c in text_columns]))
    if date_from:
        out = out.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        out = out.filter(F.col("created_at") < F.lit(date_to).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    if types:
        out = out.filter(F.col("document_type").isin(list(types)))
    if sort_by not in SORT_FIELDS:
        raise ValueError(f"invalid sort field: {sort_by}")
    c = known_column(df, sort_by)
    return paginate(out, [c.desc() if sort_order == "desc" else c.asc(), F.col("id").asc()], page, per_page)


def last_n_days(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    """Rows of the last days, newest first."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(F.col(ts) >= cutoff).orderBy(F.desc(ts))


def quality_gate(df: DataFrame, min_quality: float, min_confidence: float) -> DataFrame:
    """Accept flag and the reasons for rejection, in fixed order."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("quality_score") < min_quality, F.lit("quality_too_low")),
            F.when(F.col("confidence_score") < min_confidence, F.lit("confidence_too_low")),
            F.when(F.col("error_message").isNotNull(), F.lit("processing_error")),
        )
    )
    return df.withColumn("reasons", reasons).withColumn("accepted", F.col("quality_score") >= min_quality)


# Required fields per document type.
REQUIRED_FIELDS = {
    "passport": ["passport_number", "name", "date_of_birth"],
    "emirates_id": ["id_number", "name"],
    "aadhaar_card": ["aadhaar_number", "name"],
    "driving_license": ["license_number", "name"],
}


def validate_fields(
    df: DataFrame, as_of: str, required: Mapping[str, Sequence[str]] = REQUIRED_FIELDS,
    doc_type: str = "document_type", fields: str = "fields",
) -> DataFrame:
    """Check a map column of extracted fields against its type: is_valid, errors[], warnings[].

    An empty map fails; an expiry that does not parse as DD/MM/YYYY gives no warning.
    """
    need = F.create_map(*[x for t, fs in required.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in fs]))])
    wanted = F.coalesce(F.element_at(need, F.col(doc_type)), F.array().cast("array<string>"))
    present = F.map_keys(F.map_filter(fields, lambda _, v: F.coalesce(v != "", F.lit(False))))
    missing = F.transform(F.array_except(wanted, present), lambda f: F.concat(F.lit("Missing required field: "), f))
    empty = F.col(fields).isNull() | (F.size(fields) == 0)
    errors = F.when(empty, F.array(F.lit("No data extracted"))).otherwise(missing)
    expiry = F.try_to_date(F.element_at(fields, F.lit("expiry_date")), "dd/MM/yyyy")
    warn = F.when(
        F.coalesce(expiry < F.lit(as_of).cast("timestamp_ntz"), F.lit(False)) & ~empty,
        F.array(F.lit("Document appears to be expired")),
    ).otherwise(F.array().cast("array<string>"))
    return df.withColumn("errors", errors).withColumn("warnings", warn).withColumn("is_valid", F.size("errors") == 0)


# Upload limits.
MAX_IMAGE_BYTES = 10 * 1024 * 1024
MIN_IMAGE_BYTES = 1000
MIN_DIMENSION = 100
MAX_DIMENSION = 8000
UPLOAD_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "pdf"]


def validate_uploads(df: DataFrame) -> DataFrame:
    """First broken rule per upload (filename, size, width, height), or null when it is acceptable."""
    ext = F.lower(F.element_at(F.split("filename", r"\."), -1))
    rules = [
        (F.coalesce(F.trim("filename"), F.lit("")) == "", "EMPTY_FILENAME"),
        (F.col("size") == 0, "EMPTY_FILE"),
        (F.col("filename").contains(".") & ~ext.isin(UPLOAD_EXTENSIONS), "UNSUPPORTED_FORMAT"),
        (F.col("size") > MAX_IMAGE_BYTES, "FILE_TOO_LARGE"),
        (F.col("size") < MIN_IMAGE_BYTES, "INVALID_IMAGE"),
        ((F.col("width") < MIN_DIMENSION) | (F.col("height") < MIN_DIMENSION), "IMAGE_TOO_SMALL"),
        ((F.col("width") > MAX_DIMENSION) | (F.col("height") > MAX_DIMENSION), "IMAGE_TOO_LARGE"),
    ]
    return df.withColumn("error_code", F.coalesce(*[F.when(p, F.lit(code)) for p, code in rules]))


def validate_ranges(df: DataFrame, rules: Mapping[str, tuple[float, float, bool, str]]) -> DataFrame:
    """Range rules {column: (low, high, low_open, code)}; the first broken one names the row's error."""
    checks = []
    for name, (low, high, low_open, code) in rules.items():
        c = known_column(df, name)
        bad = ((c <= low) if low_open else (c < low)) | (c > high)
        checks.append(F.when(bad, F.lit(code)))
    return df.withColumn("error_code", F.coalesce(*checks))
