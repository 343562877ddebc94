"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.llm import byte_bpe, divergence, filter_audit, gru_lm, jaccard_join, main_text, mixing, ordinal, packing, pii, piece_counts, rp_forest, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Smallest node reachable from each node of `links` (a, b); the closure stays small where components are.
_REACH = """
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM ways UNION SELECT node, b FROM reach JOIN ways ON other = a),
low AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
"""

OP2_SQL = f"""
WITH RECURSIVE
e AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.label = q.label AND len(p.v) = len(q.v) AND p.vec_id < q.vec_id
    WHERE list_cosine_similarity(p.v, q.v) >= 0.93
),
{_REACH},
n AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, low.other) AS component_id, vec_id = least(vec_id, low.other) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN low ON vec_id = node
"""

OP8_SQL = f"""
WITH RECURSIVE
w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
s AS (
    SELECT doc_id, CASE
        WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM w
),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
    SELECT p.doc_id AS a, q.doc_id AS b FROM g p JOIN g q ON p.g = q.g AND p.doc_id < q.doc_id
    GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
),
{_REACH}
SELECT doc_id, len(s) AS n_shingles, least(doc_id, low.other) AS component_id FROM s LEFT JOIN low ON doc_id = node
"""

OP11_SQL = """
WITH
docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+')) AS term
    FROM docs
),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, coalesce(sum(total), 0) AS n, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
sources AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
grid AS (
    SELECT lang, s.source, term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.n + l.v)::HUGEINT AS p
    FROM sources s JOIN langs l USING (lang) JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
        coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM grid x JOIN grid y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
    FROM (SELECT grid.lang, source, term, grid.n, p, 1 + 1000000000 * (total + 1) // (langs.n + v)::HUGEINT AS q FROM grid JOIN kept USING (lang, term) JOIN langs USING (lang))
    WHERE n > 0 AND p > q
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM (SELECT lang, source, part, item, value::BIGINT AS value FROM pairs UNION ALL SELECT lang, source, part, item, value::BIGINT FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP12_SQL = """
WITH
flags AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
w AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
fails AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
    FROM w LEFT JOIN flags USING (doc_id)
),
masks AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, mask
),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
        JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
),
steps AS (
    SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM orders, range(1, 6) r(step)
),
rows AS (
    SELECT part, filter_order, step, bit,
        sum(n) FILTER (mask & (before | bit) = 0) AS kept,
        sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
        sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
        sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost,
        sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
    FROM steps, masks GROUP BY part, filter_order, step, bit
),
filled AS (SELECT part, filter_order, step, bit, coalesce(removed, 0) AS removed, coalesce(kept, 0) AS kept, coalesce(redundant, 0) AS redundant,
    coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost FROM rows)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM filled
"""


@query("op10_source_mix")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


@query("op7_weak_rules")
def op7_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "quality_prob")


@query("op4_ordinal_quality")
def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    graded = ordinal.classify(docs, ordinal.grades(table(spark, sf_dir, "labels")), n_grades=3, wanted=2)
    return graded.select("doc_id", "expected_grade", "tail_prob", "kept")


@query("op5_piece_counts")
def op5_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op8_ngram_join", OP8_SQL)
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op2_vector_neighbours", OP2_SQL)
def op2_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.neighbours(table(spark, sf_dir, "embeddings"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_main_text")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_text.main_text(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_gru_scores")
def op3_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents"))


@query("op1_pii_spans")
def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


@query("op11_source_divergence", OP11_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_filter_interactions", OP12_SQL)
def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_best_fit_packing")
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
