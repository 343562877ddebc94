"""Registered memory, conversation and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.operators import memory as M
from scanmill.plans.registry import query
from scanmill.sources import tables as T
from scanmill.sources.identity import quote

MEM_AS_OF = "2024-03-01 00:00:00"
MS = T.MEM_SQL
AGE = f"date_sub('second', timestamp, TIMESTAMP '{MEM_AS_OF}')"


@query("search_memories", f"""WITH {MS}, m AS (SELECT *, CASE WHEN contains(lower(content), 'src1') THEN 10 ELSE 0 END
  + CAST(contains(lower(lang), 'src1') AS INTEGER) * 5 + CAST(contains(lower(source), 'src1') AS INTEGER) * 5
  + CASE WHEN contains('{{"quality":"' || quality || '"}}', 'src1') THEN 3 ELSE 0 END AS mt FROM memories WHERE lang IN ('en', 'fr') AND quality = '1' AND importance >= 0.2::DOUBLE)
SELECT memory_id, mt / 10 * importance AS score FROM m WHERE mt > 0 ORDER BY score DESC, memory_id LIMIT 20""")
def search_memories(spark, d):
    r = M.search_memories(T.memories(spark, d), "SRC1", ["en", "fr"], {"quality": "1"}, min_importance=0.2, limit=20)
    return r.select("memory_id", "score")


SCORE_SQL = f"""least(1.0, importance * 0.5::DOUBLE + 1.0 / (1.0::DOUBLE + CAST({AGE} AS DOUBLE) / 86400.0 * 0.1::DOUBLE) * 0.3::DOUBLE
  + least(1.0, access_count * 0.1::DOUBLE) * 0.2::DOUBLE + 0.0::DOUBLE)"""


@query("memory_score", f"WITH {MS} SELECT memory_id, {SCORE_SQL} AS score FROM memories")
def memory_score(spark, d):
    return T.memories(spark, d).select("memory_id", M.memory_score(MEM_AS_OF).alias("score"))


@query("memory_tier", f"WITH {MS} SELECT memory_id, CASE WHEN importance >= 0.7::DOUBLE OR access_count >= 3 THEN 'long_term' ELSE 'short_term' END AS tier FROM memories")
def memory_tier(spark, d):
    return T.memories(spark, d).select("memory_id", M.memory_tier().alias("tier"))


@query("expire_ttl", f"WITH {MS} SELECT memory_id FROM memories WHERE ttl IS NULL OR {AGE} <= ttl")
def expire_ttl(spark, d):
    return M.expire_ttl(T.memories(spark, d), MEM_AS_OF).select("memory_id")


@query("rank_memories", f"WITH {MS} SELECT memory_id, importance FROM memories ORDER BY importance DESC, timestamp DESC, memory_id LIMIT 10")
def rank_memories(spark, d):
    return M.rank_memories(T.memories(spark, d), 10).select("memory_id", "importance")


@query("union_memories", f"WITH {MS} SELECT memory_id, CASE WHEN importance >= 0.7::DOUBLE OR access_count >= 3 THEN 'long_term' ELSE 'short_term' END AS store FROM memories")
def union_memories(spark, d):
    m = T.memories(spark, d).select("memory_id", M.memory_tier().alias("store"))
    return m.filter("store = 'long_term'").unionByName(m.filter("store = 'short_term'"))


LAST_SQL = """l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS total_turns FROM conversations)"""


@query("last_n_turns", f"WITH {LAST_SQL} SELECT conv_id, turn, role, total_turns FROM l WHERE rn <= 4")
def last_n_turns(spark, d):
    return M.last_turns(T.table(spark, d, "conversations"), 4).select("conv_id", "turn", "role", "total_turns")


REQ, OUT = [*M.REQUEST_WORDS, " the "], [*M.OUTCOME_WORDS, " of "]


def _any(ws):
    return "(" + " OR ".join(f"contains(lower(text), {quote(w)})" for w in ws) + ")"


@query("conversation_summary", f"""WITH {LAST_SQL}, p AS (SELECT conv_id, turn, total_turns, CASE WHEN role = 'user' AND (contains(text, '?') OR {_any(REQ)}) THEN 'User asked: ' || substr(text, 1, 100) || '...'
  WHEN role = 'assistant' AND {_any(OUT)} THEN 'Assistant: ' || substr(text, 1, 100) || '...' END AS p FROM l WHERE rn <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN p IS NULL THEN 1 ELSE 0 END, turn DESC) AS k FROM p)
SELECT conv_id, max(total_turns) AS total_turns, coalesce(string_agg(p, ' | ' ORDER BY turn) FILTER (k <= 5 AND p IS NOT NULL), '') AS summary FROM r GROUP BY conv_id""")
def conversation_summary(spark, d):
    return M.conversation_summary(T.table(spark, d, "conversations"), REQ, OUT)


@query("important_turns", """SELECT conv_id || '-' || turn AS memory_id, 'conversation|conv_' || conv_id || '|' || role AS tags, 0.8::DOUBLE AS importance
FROM conversations WHERE role = 'system' OR length(text) > 200""")
def important_turns(spark, d):
    t = M.important_turns(T.table(spark, d, "conversations"), (F.col("role") == "system") | (F.length("text") > 200))
    return t.select("memory_id", F.array_join("tags", "|").alias("tags"), "importance")


def entries(spark, d):
    """Context entries per session from its scans: one entry per scan, layer and key by its hidden number."""
    s = T.scan_history(spark, d)
    k = F.col("k")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), k % len(xs) + 1)
    layer = pick(["immediate", "immediate", "session", "session", "historical", "domain", "behavioral", "environmental", "immediate", "session", "historical", "global"])
    key = pick(["document_type", "image_quality", "error_count", "avg_processing_time", "success_rate", "document_domain", "preferred_output_format", "cpu_usage", "quality_requirement", "speed_requirement", "document_type", "processing_mode"])
    num = F.col("confidence_score").cast("string")
    value = (
        F.when(k % 12 == 0, F.when(F.col("user_id") % 2 == 0, "passport").otherwise("id_card")).when(k % 12 == 2, (k % 7).cast("string"))
        .when(k % 12 == 3, F.col("processing_time").cast("string")).when(k % 12 == 5, F.when(k % 5 > 0, "government_id").otherwise("other"))
        .when(k % 12 == 6, F.when(k % 4 > 0, "json")).when(k % 12 == 8, "high").when(k % 12 == 9, F.when(k % 5 > 0, "fast").otherwise("slow"))
        .when(k % 12 == 10, "passport").when(k % 12 == 11, "standard").otherwise(num)
    )
    return s.select((F.col("user_id")).alias("context_id"), layer.alias("layer"), key.alias("key"), value.alias("value"), "id")


ENTRIES_SQL = f"""{T.SCAN_SQL}, ctx AS (SELECT user_id AS context_id, k, id,
  ['immediate', 'immediate', 'session', 'session', 'historical', 'domain', 'behavioral', 'environmental', 'immediate', 'session', 'historical', 'global'][k % 12 + 1] AS layer,
  ['document_type', 'image_quality', 'error_count', 'avg_processing_time', 'success_rate', 'document_domain', 'preferred_output_format', 'cpu_usage', 'quality_requirement', 'speed_requirement', 'document_type', 'processing_mode'][k % 12 + 1] AS key,
  CASE k % 12 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'passport' ELSE 'id_card' END WHEN 2 THEN CAST(k % 7 AS VARCHAR) WHEN 3 THEN CAST(processing_time AS VARCHAR)
    WHEN 5 THEN CASE WHEN k % 5 > 0 THEN 'government_id' ELSE 'other' END WHEN 6 THEN CASE WHEN k % 4 > 0 THEN 'json' END WHEN 8 THEN 'high'
    WHEN 9 THEN CASE WHEN k % 5 > 0 THEN 'fast' ELSE 'slow' END WHEN 10 THEN 'passport' WHEN 11 THEN 'standard' ELSE CAST(confidence_score AS VARCHAR) END AS value FROM scan_history)"""


def _rules_sql() -> str:
    parts = []
    for layer, key, test, action, reason, conf in M.CONTEXT_RULES:
        value = "value" if test == "IS NOT NULL" or "'" in test else "TRY_CAST(value AS DOUBLE)"
        act = f"'{action}' || value" if action.endswith("_as_") else f"'{action}'"
        parts.append(
            f"SELECT context_id, layer, {act} AS action, '{reason}' AS reason, {conf}::DOUBLE * {M.LAYER_WEIGHTS[layer]}::DOUBLE AS weight FROM ctx WHERE layer = '{layer}' AND key = '{key}' AND {value} {test}"
        )
    return " UNION ALL ".join(parts)


@query("context_recommendations", f"WITH {ENTRIES_SQL} {_rules_sql()}")
def context_recommendations(spark, d):
    return M.context_recommendations(entries(spark, d))


@query("context_conflicts", f"""WITH {ENTRIES_SQL}, g AS (SELECT context_id, max(value) FILTER (layer = 'immediate' AND key = 'quality_requirement') AS q,
  max(value) FILTER (layer = 'session' AND key = 'speed_requirement') AS s, max(value) FILTER (layer = 'immediate' AND key = 'document_type') AS t1,
  max(value) FILTER (layer = 'historical' AND key = 'document_type') AS t2, count(*) AS n FROM ctx GROUP BY 1)
SELECT context_id, CASE WHEN q = 'high' AND s = 'fast' THEN 'quality_vs_speed' END AS conflict,
  CASE WHEN t1 = t2 OR (t1 IS NULL) <> (t2 IS NULL) THEN 'Consistent document type: ' || coalesce(t1, t2) WHEN t1 <> t2 THEN 'Multiple document types detected across contexts' END AS insight,
  n > 100 AS prune FROM g""")
def context_conflicts(spark, d):
    return M.context_conflicts(entries(spark, d))
