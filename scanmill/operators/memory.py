"""Memory, conversation and context ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Importance and accesses that make a memory long-term.
LONG_IMPORTANCE = 0.7
LONG_ACCESSES = 3


def search_memories(
    df: DataFrame, query: str | None = None, tags: Sequence[str] = (), context: Mapping[str, str] | None = None,
    min_importance: float | None = None, limit: int = 10,
) -> DataFrame:
    """Best memories by tag, context and importance filters and, with a query, by match score.

    1 for the content, 0.5 per tag, 0.3 for the context, times importance; else by importance and
    recency.
    """
    out = df
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    for k, v in (context or {}).items():
        out = out.filter(F.element_at("context", F.lit(k)) == v)
    if min_importance is not None:
        out = out.filter(F.col("importance") >= min_importance)
    if query is None:
        out = out.withColumn("score", F.col("importance"))
        return out.orderBy(F.desc("importance"), F.desc("timestamp"), "memory_id").limit(limit)
    q = query.lower()
    tag_hits = F.size(F.filter("tags", lambda t: F.contains(F.lower(t), F.lit(q))))
    match = (
        F.when(F.lower("content").contains(q), 10).otherwise(0)
        + tag_hits * 5
        + F.when(F.lower(F.to_json("context")).contains(q), 3).otherwise(0)
    )
    out = out.withColumn("match", match).filter("match > 0")
    score = F.col("match") / 10 * F.col("importance")
    return out.withColumn("score", score).drop("match").orderBy(F.desc("score"), "memory_id").limit(limit)


def memory_score(as_of: str, boost: float = 0.0) -> Column:
    """Half importance, 0.3 for recency (10 % decay a day), 0.2 for accesses, capped at one.

    A memory dated ten days after ``as_of`` divides by zero: its recency has no bound, as in SQL over doubles.
    """
    age = F.timestamp_diff("SECOND", F.col("timestamp"), F.lit(as_of).cast("timestamp_ntz")).cast("double") / 86400.0
    decay = F.lit(1.0) + age * 0.1
    recency = F.when(decay == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), decay))
    access = F.least(F.lit(1.0), F.col("access_count") * 0.1)
    return F.least(F.lit(1.0), F.col("importance") * 0.5 + recency * 0.3 + access * 0.2 + boost)


def memory_tier() -> Column:
    return F.when((F.col("importance") >= LONG_IMPORTANCE) | (F.col("access_count") >= LONG_ACCESSES), "long_term").otherwise("short_term")


def expire_ttl(df: DataFrame, as_of: str) -> DataFrame:
    """Entries within their time to live; no or zero ttl never expires."""
    age = F.timestamp_diff("SECOND", F.col("timestamp"), F.lit(as_of).cast("timestamp_ntz"))
    return df.filter(~F.coalesce((F.col("ttl") > 0) & (age > F.col("ttl")), F.lit(False)))


def rank_memories(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("importance"), F.desc("timestamp"), "memory_id").limit(limit)


def last_turns(df: DataFrame, n: int = 10) -> DataFrame:
    """Last n turns of a conversation with its number of turns.

    Totals are partial counts; the rank limit runs before the shuffle too, so a very long
    conversation sends n rows per task.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    totals = df.groupBy("conv_id").agg(F.count("*").alias("total_turns"))
    return last.join(totals, "conv_id")


# Words that mark a request or an outcome, and the sizes of a summary.
REQUEST_WORDS = ["please", "can you", "help"]
OUTCOME_WORDS = ["processed", "completed", "found", "created"]
SUMMARY_TURNS, SUMMARY_POINTS, SUMMARY_CHARS = 20, 5, 100


def conversation_summary(df: DataFrame, request: Sequence[str] = REQUEST_WORDS, outcome: Sequence[str] = OUTCOME_WORDS) -> DataFrame:
    """Last five key points of the last twenty turns, as one text per conversation."""
    recent = last_turns(df, SUMMARY_TURNS)
    low = F.lower("text")
    any_in = lambda ws: low.rlike("|".join(ws))
    head = F.concat(F.left("text", F.lit(SUMMARY_CHARS)), F.lit("..."))
    point = F.when((F.col("role") == "user") & (F.col("text").contains("?") | any_in(request)), F.concat(F.lit("User asked: "), head)).when(
        (F.col("role") == "assistant") & any_in(outcome), F.concat(F.lit("Assistant: "), head)
    )
    # At most twenty points of bounded length per conversation are collected.
    pts = F.array_sort(F.collect_list(F.when(point.isNotNull(), F.struct("turn", point.alias("p")))))
    last = F.slice(pts, F.greatest(F.size(pts) - SUMMARY_POINTS + 1, F.lit(1)), F.lit(SUMMARY_POINTS))
    g = recent.groupBy("conv_id").agg(last.alias("_l"), F.max("total_turns").alias("total_turns"))
    return g.select("conv_id", "total_turns", F.array_join(F.transform("_l", lambda x: x["p"]), " | ").alias("summary"))


# Importance of a flagged turn.
TURN_IMPORTANCE = 0.8


def important_turns(df: DataFrame, important: Column) -> DataFrame:
    """Flagged turns as memories tagged with their conversation and role."""
    conv = F.col("conv_id").cast("string")
    return df.filter(important).select(
        F.concat_ws("-", conv, F.col("turn").cast("string")).alias("memory_id"),
        F.col("text").alias("content"),
        F.array(F.lit("conversation"), F.concat(F.lit("conv_"), conv), F.col("role")).alias("tags"),
        F.lit(TURN_IMPORTANCE).alias("importance"),
    )


# Weights of the context layers.
LAYER_WEIGHTS = {
    "immediate": 1.0, "session": 0.8, "historical": 0.6, "domain": 0.7, "behavioral": 0.5, "environmental": 0.4, "global": 0.3,
}
# Recommendation rules as (layer, key, test, action, reason, confidence).
CONTEXT_RULES = [
    ("immediate", "document_type", "= 'passport'", "use_mrz_extraction", "Passport detected", 0.9),
    ("immediate", "image_quality", "< 0.5", "enhance_image_quality", "Low image quality detected", 0.8),
    ("session", "error_count", "> 3", "switch_processing_mode", "Multiple errors in session", 0.7),
    ("session", "avg_processing_time", "> 5", "enable_fast_mode", "Slow processing detected", 0.6),
    ("historical", "success_rate", "< 0.5", "use_alternative_processor", "Low historical success rate", 0.5),
    ("domain", "document_domain", "= 'government_id'", "enable_security_validation", "Government ID requires security checks", 0.9),
    ("behavioral", "preferred_output_format", "IS NOT NULL", "format_output_as_", "User preference", 0.8),
    ("environmental", "cpu_usage", "> 0.8", "use_lightweight_processor", "High CPU usage", 0.7),
]


def context_recommendations(entries: DataFrame) -> DataFrame:
    """One row per entry that meets a rule: action, reason and confidence times layer weight.

    Rules look at one entry each, so no pivot, join or shuffle is needed.
    """
    rows = []
    for layer, key, test, action, reason, conf in CONTEXT_RULES:
        op, _, operand = test.partition(" ")
        value = "value" if test == "IS NOT NULL" or operand.startswith("'") else "try_cast(value AS DOUBLE)"
        act = f"concat('{action}', value)" if action.endswith("_as_") else f"'{action}'"
        rows.append(
            f"WHEN layer = '{layer}' AND key = '{key}' AND {value} {test} THEN named_struct('action', {act}, 'reason', '{reason}', "
            f"'weight', double({conf}) * double({LAYER_WEIGHTS[layer]}))"
        )
    return entries.withColumn("_r", F.expr("CASE " + " ".join(rows) + " END")).filter("_r IS NOT NULL").select("context_id", "layer", "_r.*")


def context_conflicts(entries: DataFrame) -> DataFrame:
    """Conflict and consistency findings per context, from conditional aggregates over its entries."""
    at = lambda layer, key: (F.col("layer") == layer) & (F.col("key") == key)
    pick = lambda layer, key: F.max(F.when(at(layer, key), F.col("value")))
    g = entries.groupBy("context_id").agg(
        pick("immediate", "quality_requirement").alias("q"), pick("session", "speed_requirement").alias("s"),
        pick("immediate", "document_type").alias("t1"), pick("historical", "document_type").alias("t2"), F.count("*").alias("n"),
    )
    kinds = F.size(F.array_distinct(F.array_compact(F.array("t1", "t2"))))
    return g.select(
        "context_id",
        F.when((F.col("q") == "high") & (F.col("s") == "fast"), "quality_vs_speed").alias("conflict"),
        F.when(kinds == 1, F.concat(F.lit("Consistent document type: "), F.coalesce("t1", "t2")))
        .when(kinds > 1, "Multiple document types detected across contexts")
        .alias("insight"),
        (F.col("n") > 100).alias("prune"),
    )
