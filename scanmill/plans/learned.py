"""Registered learning queries and the extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanmill.functions import classify as K
from scanmill.functions.extension import register_pack, register_spans
from scanmill.functions.packs import PACKS
from scanmill.functions.rules import Field, Pack, Probe
from scanmill.operators import learning as L
from scanmill.operators.ranking import top_k_per
from scanmill.plans import rule_sql as R
from scanmill.plans.registry import query
from scanmill.plans.textual import C, MERGED_SQL, merged
from scanmill.session import stored
from scanmill.sources import tables as T
from scanmill.sources.identity import corpus, identity_docs

LANGS = ["de", "en", "es", "fr"]


def labelled_vectors(spark, d):
    return L.vectors(T.spread(T.table(spark, d, "embeddings")), "embedding", "label").select("vec_id", "features", "label")


@query("tfidf_features")
def tfidf_features(spark, d):
    docs = T.spread(T.table(spark, d, "documents").select("doc_id", "text"))
    v = L.vector_to_array(F.col("tfidf"))
    out = L.tfidf(docs).transform(L.terms(docs))
    return out.select("doc_id", F.size(F.filter(v, lambda x: x > 0)).alias("terms"), F.round(F.array_max(v), 6).alias("heaviest"))


@query("train_random_forest")
def train_random_forest(spark, d):
    train, test = L.stratified_split(labelled_vectors(spark, d), "label", "vec_id")
    model = L.train_random_forest(train, trees=100)
    return L.accuracy(model.transform(train)).withColumn("part", F.lit("train")).unionByName(
        L.accuracy(model.transform(test)).withColumn("part", F.lit("test"))
    )


@query("train_soft_voting")
def train_soft_voting(spark, d):
    train, test = L.stratified_split(labelled_vectors(spark, d), "label", "vec_id")
    return L.soft_vote(L.train_soft_voting(train, "vec_id", trees=100), test, "vec_id")


@query("stratified_split_sizes", """SELECT CAST(label AS DOUBLE) AS label, (count(*) * 80 + 50) // 100 AS train, count(*) - (count(*) * 80 + 50) // 100 AS test
FROM embeddings WHERE label IS NOT NULL GROUP BY label""")
def stratified_split_sizes(spark, d):
    """Rows of each class in both parts."""
    train, test = L.stratified_split(labelled_vectors(spark, d), "label", "vec_id")
    n = train.select("label", F.lit(1).alias("t")).unionAll(test.select("label", F.lit(0)))
    return n.groupBy("label").agg(F.count_if(F.col("t") == 1).alias("train"), F.count_if(F.col("t") == 0).alias("test"))


@query("calibration_gap", "SELECT CAST(label AS DOUBLE) AS label, TRUE AS calibrated FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def calibration_gap(spark, d):
    """Whether the mean probability of each class is within 0.1 of its share of the test rows."""
    train, test = L.stratified_split(labelled_vectors(spark, d), "label", "vec_id")
    out = L.train_calibrated_margins(train, "vec_id", "features").transform(test)
    p = out.select("label", F.posexplode(L.vector_to_array("probability")).alias("i", "p"))
    own = F.when(F.col("label") == F.col("i"), 1.0).otherwise(0.0)
    return p.groupBy(F.col("i").cast("double").alias("label")).agg((F.abs(F.avg("p") - F.avg(own)) <= 0.1).alias("calibrated"))


@query("classify_chain", C(f""", {MERGED_SQL}, b AS (SELECT doc_id, type, confidence FROM merged WHERE rank = 1)
SELECT c.doc_id, CASE WHEN p > 0.5 THEN 'long_text' ELSE coalesce(type, 'unknown') END AS document_type,
  CASE WHEN p > 0.5 THEN p ELSE coalesce(confidence, 0.0) END AS confidence,
  CASE WHEN p > 0.5 THEN 'model' WHEN type IS NOT NULL THEN 'rules' ELSE 'none' END AS source
FROM (SELECT doc_id, least(length(text), 4000) / 4000 AS p FROM c) c LEFT JOIN b USING (doc_id)"""))
def classify_chain(spark, d):
    """A length score stands for the model's confidence, so that the chain itself can be checked."""
    p = F.least(F.length("text"), F.lit(4000)) / 4000
    model = corpus(spark, d).select("doc_id", p.alias("confidence"), F.lit("long_text").alias("predicted"))
    return L.classify_chain(model, best_types(spark, d), "doc_id")


def chain_model(spark, d):
    """Rules, the classes that they label, and a text model trained on four fifths of each class: (rules, classes, model, test rows)."""
    rules = stored(best_types(spark, d))
    labelled = stored(corpus(spark, d).select("doc_id", "text").join(L.weak_labels(rules, "doc_id"), "doc_id"))
    classes = [r.label for r in labelled.select("label").distinct().orderBy("label").collect()]
    train, test = L.stratified_split(labelled, "label", "doc_id")
    return rules, classes, L.train_text_model(train, classes), test


@query("classify_chain_trained")
def classify_chain_trained(spark, d):
    """A model trained on the rules' sure labels decides first, the rules where it is unsure."""
    rules, classes, model, _ = chain_model(spark, d)
    return L.classify_chain(L.predict_text(model, corpus(spark, d), classes, "doc_id"), rules, "doc_id")


@query("classify_chain_accuracy")
def classify_chain_accuracy(spark, d):
    """Held-out texts of each class, and how many of them the model gives the rules' label."""
    _, classes, model, test = chain_model(spark, d)
    p = L.predict_text(model, test, classes, "doc_id").join(test.select("doc_id", "label"), "doc_id")
    right = F.count_if(F.col("label") == F.col("predicted"))
    return p.groupBy("label").agg(F.count("*").alias("rows"), right.alias("correct"))


def best_types(spark, d):
    return top_k_per(merged(spark, d).drop("rank"), "doc_id", [F.desc("confidence"), F.asc("type")], 1)


@query("weak_labels", C(f", {MERGED_SQL} SELECT doc_id, type AS label, confidence FROM merged WHERE rank = 1 AND confidence >= 0.5"))
def weak_labels(spark, d):
    return L.weak_labels(best_types(spark, d), "doc_id")


@query("model_metrics", """SELECT quality AS actual, CAST(n_chars > 800 AS INTEGER) AS predicted, count(*) AS n,
  CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY quality) AS DOUBLE) AS share FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def model_metrics(spark, d):
    p = T.table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 800).cast("int").alias("predicted"))
    return L.confusion(p.join(T.table(spark, d, "labels").select("doc_id", F.col("quality").alias("actual")), "doc_id"), "actual", "predicted")


@query("detect_language")
def detect_language(spark, d):
    docs = T.spread(T.table(spark, d, "documents").select("doc_id", "text", "lang"))
    train, _ = L.hash_split(docs, "doc_id")
    out = L.detect_language(L.train_language(train, LANGS), docs, LANGS)
    return out.select("doc_id", "lang", "language")


@query("detect_language_accuracy", f"SELECT lang, TRUE AS accurate FROM documents WHERE lang IN ({', '.join(repr(x) for x in LANGS)}) GROUP BY lang")
def detect_language_accuracy(spark, d):
    """Whether at least nine in ten held-out documents of each language are recognised, of those long enough to be judged."""
    docs = T.spread(T.table(spark, d, "documents").select("doc_id", "text", "lang"))
    train, test = L.hash_split(docs, "doc_id")
    out = L.detect_language(L.train_language(train, LANGS), test, LANGS).filter(F.length("text") >= 200)
    codes = F.create_map(*[F.lit(x) for kv in L.LANGUAGE_CODES.items() for x in kv])
    right = F.count_if(F.element_at(codes, F.col("lang")) == F.col("language"))
    return out.filter(F.col("lang").isin(*LANGS)).groupBy("lang").agg((right >= 0.9 * F.count("*")).alias("accurate"))


# A user's own pack: invoices, routed after the built-in packs.
INVOICE = Pack(
    "invoice", "any", ("count", ["invoice", "total due", "ship to"], 2),
    [Field("party", [Probe(r"invoice from ([A-Za-z ]+)")]), Field("due", [Probe(r"total due by ([A-Za-z0-9 ,]+)")])], 0.5,
    [(0.5, "party", "."), (0.5, "due", ".")],
)


@query("register_pack", C(f""", p AS (SELECT doc_id, text FROM c WHERE {R.predicate(INVOICE.detect)})
SELECT doc_id, {R.field_value(INVOICE.fields[0], 'text')} AS party, {R.field_value(INVOICE.fields[1], 'text')} AS due FROM p"""))
def registered_pack(spark, d):
    packs = register_pack(INVOICE, PACKS, position=0)
    docs = K.route_document(corpus(spark, d), packs=packs).filter("pack = 'invoice'")
    return K.extract_fields(docs, "doc_id", INVOICE)


@query("extract_spans")
def extract_spans(spark, d):
    register_spans(spark)
    K.route_document(T.spread(identity_docs(spark, d))).createOrReplaceTempView("routed_documents")
    return spark.sql("SELECT doc_id, s.* FROM routed_documents, LATERAL extract_spans(text, pack) s")
