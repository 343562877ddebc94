"""Given tables with fixed schemas, and the views of the scan domain derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared schemas save a footer-reading job per scan and make type drift an error at the source.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before work that is heavy per row.

    A file with one row group is read by one task. Inputs that already have enough splits, as any
    large table has, are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cents(c: Column | str) -> Column:
    """Two-decimal amount as whole hundredths: sums of BIGINT are exact and order-free. A finer value is an error, not rounded."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.rint(c * 100)
    exact = c.isNull() | (F.abs(c * 100 - whole) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(whole)))
    return F.when(exact, whole).otherwise(F.raise_error(F.lit("amount finer than hundredths"))).cast("bigint")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact table of scans: one row per processed document."""
    k = F.col("k")
    error = (
        F.when(k < 5, "Low Quality Image")
        .when(k < 10, "Unsupported Format")
        .when(k < 15, "Processing Timeout")
        .when(k < 18, "Document Not Detected")
        .when(k < 20, "OCR Engine Error")
    )
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", _k())
        .select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("created_at"),
            "user_id",
            F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
            F.col("event_type").alias("document_type"),
            F.col("value").alias("processing_time"),
            "k",
            (k / 100).alias("confidence_score"),
            (((k * 37) % 101) / 100).alias("quality_score"),
            error.alias("error_message"),
            F.when(k < 20, "failed").otherwise("completed").alias("status"),
        )
    )


SCAN_SQL = """scan_history AS (
  SELECT event_id AS id, ts AS created_at, user_id,
         CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
         event_type AS document_type, value AS processing_time, k,
         k / 100 AS confidence_score, ((k * 37) % 101) / 100 AS quality_score,
         CASE WHEN k < 5 THEN 'Low Quality Image' WHEN k < 10 THEN 'Unsupported Format'
              WHEN k < 15 THEN 'Processing Timeout' WHEN k < 18 THEN 'Document Not Detected'
              WHEN k < 20 THEN 'OCR Engine Error' END AS error_message,
         CASE WHEN k < 20 THEN 'failed' ELSE 'completed' END AS status
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def login_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("email"),
        (F.col("event_type") == "signup").alias("success"),
        F.col("ts").alias("attempted_at"),
    )


LOGIN_SQL = """login_attempts AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS email, event_type = 'signup' AS success, ts AS attempted_at
  FROM events WHERE event_type IN ('signup', 'error'))"""


def api_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", _k())
        .select(
            F.col("event_id").alias("id"),
            "ts",
            F.col("user_id").alias("api_key_id"),
            F.col("event_type").alias("endpoint"),
            F.col("value").alias("latency_ms"),
            F.when(k < 3, 500).when(k < 8, 404).otherwise(200).alias("status_code"),
        )
    )


API_SQL = """api_requests AS (
  SELECT event_id AS id, ts, user_id AS api_key_id, event_type AS endpoint, value AS latency_ms,
         CASE WHEN k < 3 THEN 500 WHEN k < 8 THEN 404 ELSE 200 END AS status_code
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role")
    )


USERS_SQL = """users AS (
  SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS role FROM customer)"""


def batch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(s == "F", "completed").when(s == "O", "processing").otherwise("queued").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
    )


JOBS_SQL = """batch_jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS user_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'queued' END AS status,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS created_at
  FROM orders)"""


def batch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document outcome of a batch; quality and confidence are missing for failed documents."""
    ok = F.col("l_returnflag") != "R"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("doc_no"),
        ok.alias("success"),
        F.when(ok, F.col("l_quantity") / 50).alias("quality_score"),
        F.when(ok, F.col("l_discount") * 10).alias("confidence"),
        F.col("l_shipdate").alias("finished_at"),
    )


DOCS_SQL = """batch_documents AS (
  SELECT l_orderkey AS job_id, l_linenumber AS doc_no, l_returnflag <> 'R' AS success,
         CASE WHEN l_returnflag <> 'R' THEN l_quantity / 50 END AS quality_score,
         CASE WHEN l_returnflag <> 'R' THEN l_discount * 10 END AS confidence,
         l_shipdate AS finished_at
  FROM lineitem)"""


def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") / 500).alias("blur"),
        (F.col("l_quantity") * 5).alias("brightness"),
        (F.col("l_discount") * 1000).alias("contrast"),
        F.col("l_tax").alias("noise"),
        (F.col("l_linenumber") * 3).cast("double").alias("skew"),
        (F.col("l_quantity") * 40).alias("resolution"),
        (F.col("l_quantity") / 50).alias("text_coverage"),
    )


IMAGE_SQL = """image_metrics AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 500 AS blur, l_quantity * 5 AS brightness,
         l_discount * 1000 AS contrast, l_tax AS noise, CAST(l_linenumber * 3 AS DOUBLE) AS skew,
         l_quantity * 40 AS resolution, l_quantity / 50 AS text_coverage
  FROM lineitem)"""


def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit sign hashes: each embedding, a rescan with up to seven flipped signs, and some exact rescans."""
    e = table(spark, sf_dir, "embeddings")
    flips = F.col("vec_id") % 8
    again = e.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i < flips, -x).otherwise(x)))
    again = again.withColumn("vec_id", F.col("vec_id") + RESCAN_OFFSET)
    copies = e.filter(F.col("vec_id") % 5 == 0).withColumn("vec_id", F.col("vec_id") + 2 * RESCAN_OFFSET)
    bits = F.aggregate(
        "embedding",
        F.lit(0).cast("bigint"),
        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")),
    )
    return e.unionByName(again).unionByName(copies).select(
        F.col("vec_id").alias("id"), bits.alias("phash"), F.col("label").alias("document_type")
    )


RESCAN_OFFSET = 1_000_000_000

# The oracle keeps the hash as its 64-character bit string.
HASH_SQL = f"""image_hashes AS (
  SELECT id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits, document_type
  FROM (SELECT vec_id AS id, embedding, label AS document_type FROM embeddings
    UNION ALL SELECT vec_id + {RESCAN_OFFSET},
      list_transform(embedding, lambda x, i: CASE WHEN i <= vec_id % 8 THEN -x ELSE x END), label FROM embeddings
    UNION ALL SELECT vec_id + 2 * {RESCAN_OFFSET}, embedding, label FROM embeddings WHERE vec_id % 5 = 0))"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lb = table(spark, sf_dir, "labels")
    return d.join(lb, "doc_id", "left").select(
        F.col("doc_id").alias("memory_id"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        F.create_map(F.lit("quality"), F.coalesce(F.col("quality").cast("string"), F.lit("none"))).alias("context"),
        ((F.col("n_chars") % 101) / 100).alias("importance"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR").alias("timestamp"),
        (F.col("doc_id") % 7).alias("access_count"),
        F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3) * 864000).alias("ttl"),
    )


MEM_SQL = """memories AS (
  SELECT d.doc_id AS memory_id, text AS content, lang, source, coalesce(CAST(quality AS VARCHAR), 'none') AS quality,
         (n_chars % 101) / 100 AS importance,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) AS timestamp,
         d.doc_id % 7 AS access_count,
         CASE WHEN d.doc_id % 3 > 0 THEN (d.doc_id % 3) * 864000 END AS ttl
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
