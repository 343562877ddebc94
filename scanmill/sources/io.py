"""Source and sink operators: JSON columns, metric batches, file listings, exports, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Typed copy of a JSON text column; text that does not parse becomes null."""
    return df.withColumn(column, F.from_json(column, schema))


METRIC_SCHEMA = (
    "metrics ARRAY<STRUCT<type STRING, endpoint STRING, durationMs DOUBLE, success BOOLEAN, component STRING, "
    "action STRING, metric STRING, valueMs DOUBLE, errorId STRING, message STRING>>, clientTimestamp BIGINT"
)
# Accepted metric types.
METRIC_TYPES = ["api_call", "error", "user_action", "performance"]


def ingest_client_metrics(df: DataFrame, payload: str = "payload", limit: int | None = None) -> DataFrame:
    """One row per accepted metric of a batch. With a limit, `surplus` tells the metrics beyond it; none is dropped."""
    m = df.withColumn("_m", F.from_json(payload, METRIC_SCHEMA))
    keep = [c for c in df.columns if c != payload]
    e = m.select(*keep, F.posexplode("_m.metrics").alias("position", "x"))
    t = F.col("x.type")
    unknown = F.lit("unknown")
    return e.filter(t.isin(METRIC_TYPES)).select(
        *keep,
        "position",
        t.alias("type"),
        F.when(t == "api_call", F.coalesce("x.endpoint", unknown)).alias("endpoint"),
        F.when(t == "api_call", F.coalesce("x.success", F.lit(True))).alias("success"),
        F.when(t == "api_call", F.coalesce("x.durationMs", F.lit(0.0)))
        .when(t == "performance", F.coalesce("x.valueMs", F.lit(0.0)))
        .alias("value_ms"),
        F.when(t.isin("error", "performance"), F.coalesce("x.component", unknown)).alias("component"),
        F.when(t.isin("error", "user_action"), F.coalesce("x.action", unknown)).alias("action"),
        *([] if limit is None else [(F.col("position") >= limit).alias("surplus")]),
    )


def file_inventory(spark: SparkSession, path: str, query: str | None = None, types: Sequence[str] = ()) -> DataFrame:
    """Recursive listing with size, time and suffix; file content is pruned from the scan."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = f.select(
        "path",
        name.alias("name"),
        F.when(name.rlike(r"[^.]\.[^.]+$"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))).otherwise("").alias("suffix"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
    )
    if query:
        out = out.filter(F.lower("name").contains(query.lower()))
    if types:
        out = out.filter(F.col("suffix").isin([t.lower() for t in types]))
    return out


def storage_stats(files: DataFrame) -> DataFrame:
    """Files and bytes per suffix with a total row (null suffix)."""
    return files.rollup("suffix").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).withColumn(
        "megabytes", F.col("bytes").cast("double") / 1048576.0
    )


def media_type(content: Column) -> Column:
    """MIME type from leading bytes; JPEG when nothing matches."""
    h = F.hex(F.substring(content, 1, 12))
    # File signatures.
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("FFD8"), "image/jpeg")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
        .when(h.startswith("474946"), "image/gif")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "image/tiff")
        .when(h.startswith("424D"), "image/bmp")
        .otherwise("image/jpeg")
    )


def report_json(df: DataFrame) -> DataFrame:
    """One JSON document per row, keeping null fields."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def export_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a report with the distributed writers; one file per task."""
    if fmt not in ("json", "csv", "parquet"):
        raise ValueError(f"unsupported report format: {fmt}")
    w = df.write.mode("overwrite")
    w.option("header", "true").csv(path) if fmt == "csv" else w.format(fmt).save(path)


def batch_results_table(df: DataFrame, result: str = "result") -> DataFrame:
    """Six flat columns of a nested batch result, with defaults for missing parts."""
    r = lambda f: F.col(f"{result}.{f}")
    return df.select(
        F.coalesce(r("document_id").cast("string"), F.lit("")).alias("document_id"),
        F.coalesce(r("success"), F.lit(False)).alias("success"),
        F.coalesce(r("classification.document_type"), F.lit("")).alias("document_type"),
        F.coalesce(r("classification.confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(r("quality_score"), F.lit(0.0)).alias("quality_score"),
        F.coalesce(r("error"), F.lit("")).alias("error"),
    )


def export_batch_results(df: DataFrame, path: str, result: str = "result") -> None:
    names = ["Document ID", "Success", "Document Type", "Confidence", "Quality Score", "Error"]
    batch_results_table(df, result).toDF(*names).write.mode("overwrite").option("header", "true").csv(path)


def retention(df: DataFrame, ts: str, days: int, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, deleted/kept counts); rows without a timestamp are kept."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    expired = F.coalesce(F.col(ts) < cutoff, F.lit(False))
    counts = df.agg(F.count_if(expired).alias("deleted"), F.count_if(~expired).alias("kept"))
    return df.filter(~expired), counts
