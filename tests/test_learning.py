"""Learning operators against brute force: split, vocabulary, calibrated margins."""

import collections
import math
import random
import re

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from scanmill.operators import learning as L


def test_each_class_is_split_to_the_row(spark):
    """A class with a third of the rows, classes of one and two rows, and rows without a class."""
    n = {0: 3000, 1: 1999, 2: 7, 3: 2, 4: 1}
    rows = [(i * 10 + c, c) for c, k in n.items() for i in range(k)] + [(-1, None), (None, 1)]
    df = spark.createDataFrame(rows, "id long, label int")
    train, test = L.stratified_split(df, "label", "id")
    count = lambda x: {r.label: r["count"] for r in x.groupBy("label").count().collect()}
    a, b = count(train), count(test)
    n[1] += 1
    assert {c: a.get(c, 0) for c in n} == {c: (k * 80 + 50) // 100 for c, k in n.items()}
    assert {c: a.get(c, 0) + b.get(c, 0) for c in n} == n
    assert train.intersect(test).count() == 0
    assert train.exceptAll(L.stratified_split(df, "label", "id")[0]).count() == 0
    assert L.stratified_split(df.limit(0), "label", "id")[0].count() == 0


def test_vocabulary_is_the_most_frequent_terms(spark):
    rnd = random.Random(3)
    words = ["red", "Blue", "green", "the", "and", "x", "naïve", "42"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(words[: rnd.randrange(3, len(words))]) for _ in range(rnd.randrange(0, 40))) for _ in range(200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    model = L.tfidf(df, vocabulary=100)
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    docs = []
    for t in texts:
        w = [x for x in re.split(r"[\W]+", (t or "").lower()) if len(x) >= 2 and x not in stop]
        docs.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    total = collections.Counter(x for d in docs for x in d)
    want = sorted(total, key=lambda x: (-total[x], x.encode()))[:100]
    assert model.stages[0].vocabulary == want
    df_of = collections.Counter(x for d in docs for x in set(d))
    got = {r.id: r.v for r in model.transform(L.terms(df)).select("id", L.vector_to_array("tfidf").alias("v")).collect()}
    for i, d in enumerate(docs):
        c = collections.Counter(d)
        assert np.allclose(got[i], [c[x] * math.log((len(docs) + 1) / (df_of[x] + 1)) for x in want])


def test_calibrated_margins_tell_probabilities(spark):
    """Three classes on a line, the middle one overlapping: probabilities sum to one and follow the shares."""
    rnd = np.random.default_rng(1)
    rows = [(i, float(i % 3), [float(x) for x in rnd.normal([3.0 * (i % 3 == 1), 3.0 * (i % 3 == 2)], 1.0)]) for i in range(900)]
    df = L.vectors(spark.createDataFrame(rows, "id long, y double, v array<double>"), "v", "y").select("id", "label", "features")
    train, test = L.stratified_split(df, "label", "id")
    out = L.train_calibrated_margins(train, "id", "features").transform(test).select("label", "prediction", L.vector_to_array("probability").alias("p")).collect()
    p = np.array([r.p for r in out])
    y = np.array([r.label for r in out])
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == [r.prediction for r in out]).all()
    assert (p.argmax(axis=1) == y).mean() > 0.85
    assert all(abs(p[:, c].mean() - (y == c).mean()) < 0.05 for c in range(3))
    sure = p.max(axis=1) > 0.8
    assert abs(p.max(axis=1)[sure].mean() - (p.argmax(axis=1) == y)[sure].mean()) < 0.1


def test_a_text_model_finds_the_terms_of_a_text_once(spark):
    """Terms were found again for the vocabulary, the weights and each pass of the fit."""
    passes = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        passes.add(1)
        return text

    rows = [(i, ("red apple tree " if i % 2 else "blue sea wave ") + f"n{i % 7}", "land" if i % 2 else "water") for i in range(60)] + [(60, None, "none")]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    classes = ["land", "water"]
    model = L.train_text_model(df.withColumn("text", seen("text")), classes)
    assert passes.value == len(rows)
    got = {r.id: r.predicted for r in L.predict_text(model, df.filter("id < 60"), classes, "id").collect()}
    assert got == {i: label for i, _, label in rows[:60]}
