"""Supervised document classification and language detection with MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, NGram, RegexTokenizer, StandardScaler, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.session import stored

# Size of the forest, the split and the vocabulary.
TREES, DEPTH, TRAIN_SHARE, VOCABULARY = 100, 10, 80, 1000


def terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Words without English stop words and pairs of neighbours among them, as one array ``terms``; a null text has none."""
    words = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    kept = StopWordsRemover(inputCol="_w", outputCol="_k", stopWords=StopWordsRemover.loadDefaultStopWords("english"))
    out = df.withColumn("_t", F.coalesce(text, F.lit("")))
    for stage in (words, kept, NGram(n=2, inputCol="_k", outputCol="_p")):
        out = stage.transform(out)
    return out.withColumn("terms", F.concat("_k", "_p")).drop("_t", "_w", "_k", "_p")


def tfidf(df: DataFrame, text: str = "text", vocabulary: int = VOCABULARY) -> PipelineModel:
    """Weights of the most frequent terms, words and pairs in one vocabulary; of equally frequent ones the smaller is taken.

    Counts are combined before the shuffle and only the vocabulary reaches the driver. The model reads the column ``terms``.
    """
    return weights(terms(df, text), vocabulary)


def weights(t: DataFrame, vocabulary: int = VOCABULARY) -> PipelineModel:
    """`tfidf` of rows that have their ``terms``, which are read twice."""
    counts = t.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    known = [r.term for r in counts.orderBy(F.desc("n"), "term").limit(vocabulary).collect()]
    if not known:
        raise ValueError("no text has a term")
    count = CountVectorizerModel.from_vocabulary(known, inputCol="terms", outputCol="_c")
    return Pipeline(stages=[count, IDF(inputCol="_c", outputCol="tfidf")]).fit(t)


def hash_split(df: DataFrame, key: str, share: int = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by hash of the key: the same on every run and in every class."""
    part = F.pmod(F.xxhash64(key), F.lit(100))
    return df.filter(part < share), df.filter(part >= share)


def stratified_split(df: DataFrame, label: str, key: str, share: int = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, each class cut at its share to the row, in the order of the key's hash.

    Counts by class and range of hashes find the range in which a class is cut; only the rows of that range, one in
    65,536, are ordered. Both parts are then filters on the hash: no row of the table is shuffled. Rows with one key stay
    together, so a repeated key at the cut may move it by its repeats. Rows without a class are in neither part.
    """
    h = F.xxhash64(key)
    slim = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_class"), h.alias("_h"), F.shiftright(h, 48).alias("_range"))
    counts = slim.groupBy("_class", "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_class")
    upto = counts.withColumn("_upto", F.sum("_n").over(whole.orderBy("_range"))).withColumn("_all", F.sum("_n").over(whole))
    rest = upto.withColumn("_rest", F.expr(f"(_all * {share} + 50) div 100 - (_upto - _n)")).filter("_rest > 0 AND _rest <= _n")
    cut = slim.join(rest.select("_class", "_range", "_rest"), ["_class", "_range"])
    nth = cut.withColumn("_i", F.row_number().over(whole.orderBy("_h"))).filter("_i = _rest").select("_class", F.col("_h").alias("_cut"))
    # a class without a cut has no row in the training part
    marked = df.filter(F.col(label).isNotNull()).join(nth, F.col(label) == F.col("_class"), "left").withColumn("_train", F.coalesce(h <= F.col("_cut"), F.lit(False)))
    return tuple(marked.filter(keep).select(*df.columns) for keep in (F.col("_train"), ~F.col("_train")))


def vectors(df: DataFrame, array_col: str, label: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>"))).withColumn("label", F.col(label).cast("double"))


def train_random_forest(train: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> PipelineModel:
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    forest = RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[scale, forest]).fit(train)


@dataclass
class CalibratedMargins:
    """Linear support vector machines, one for each class, with a sigmoid of each margin as its probability."""

    machines: list[LinearSVCModel]
    slopes: list[float]
    offsets: list[float]

    def margins(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.machines):
            out = m.setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}").transform(out)
        raw = F.array(*[vector_to_array(f"_r{i}")[1] for i in range(len(self.machines))])
        return out.withColumn("margins", raw).drop(*[f"_{c}{i}" for c in "ry" for i in range(len(self.machines))])

    def transform(self, df: DataFrame) -> DataFrame:
        """Probabilities of the classes, scaled to sum to one, and the likeliest class."""
        a, b = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (self.slopes, self.offsets))
        p = F.transform("margins", lambda m, i: 1 / (1 + F.exp(-(F.get(a, i) * m + F.get(b, i)))))
        out = self.margins(df).withColumn("_p", p)
        total = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x)
        out = out.withColumn("_total", total).withColumn("_p", F.transform("_p", lambda x: x / F.col("_total")))
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.withColumn("probability", array_to_vector("_p")).withColumn("prediction", best).drop("_p", "_total", "margins")


def train_calibrated_margins(train: DataFrame, key: str, features: str = "scaled") -> CalibratedMargins:
    """Machines fitted on four fifths of each class, sigmoids on the margins of the rest.

    The sigmoid's targets are drawn in from 0 and 1 by the counts of both sides, so it stays finite where a class is separated.
    The sigmoids of all classes are one logistic regression whose features are the class and its margin.
    """
    fit, held = (stored(x) for x in stratified_split(train.select(key, "label", features), "label", key))
    machines = OneVsRest(classifier=LinearSVC(featuresCol=features, maxIter=20, tol=1e-4), featuresCol=features, parallelism=8).fit(fit).models
    k = len(machines)
    model = CalibratedMargins(machines, [1.0] * k, [0.0] * k)
    rows = model.margins(held).select("label", F.posexplode("margins").alias("_i", "_m")).withColumn("_own", F.col("label") == F.col("_i"))
    sides = rows.groupBy("_i").agg(F.count_if("_own").alias("_pos"), F.count_if(~F.col("_own")).alias("_neg"))
    target = F.when(F.col("_own"), (F.col("_pos") + 1) / (F.col("_pos") + 2)).otherwise(1 / (F.col("_neg") + 2))
    place = F.transform(F.sequence(F.lit(0), F.lit(2 * k - 1)), lambda j: F.when(j == F.col("_i"), F.col("_m")).when(j == F.col("_i") + k, 1.0).otherwise(0.0))
    soft = rows.join(sides, "_i").withColumn("_t", target).select(array_to_vector(place).alias("features"), F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("_t").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("_t")).alias("weight")),
    )))
    both = LogisticRegression(weightCol="weight", fitIntercept=False, maxIter=50).fit(stored(soft)).coefficients.toArray()
    return CalibratedMargins(machines, both[:k].tolist(), both[k:].tolist())


def train_soft_voting(train: DataFrame, key: str, trees: int = TREES, seed: int = 42) -> list[PipelineModel]:
    """Forest, support vector machines with calibrated margins and Gaussian naive Bayes, on scaled features."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
    scaled = scale.transform(train)
    models = [
        RandomForestClassifier(featuresCol="scaled", numTrees=trees, seed=seed).fit(scaled),
        train_calibrated_margins(scaled, key),
        NaiveBayes(featuresCol="scaled", modelType="gaussian").fit(scaled),
    ]
    return [PipelineModel([scale, m]) for m in models]


def soft_vote(models: Sequence[PipelineModel], df: DataFrame, key: str) -> DataFrame:
    """Mean probability of the models; the lower class wins a tie."""
    out = df
    for i, m in enumerate(models):
        out = m.transform(out).withColumn(f"_p{i}", vector_to_array("probability"))
        out = out.drop("scaled", "rawPrediction", "probability", "prediction")
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.col(f"_p{i}") for i in range(len(models))])
    mean = F.transform(total, lambda x: x / len(models))
    scored = out.withColumn("_m", mean).withColumn("confidence", F.array_max("_m"))
    pred = (F.array_position("_m", F.col("confidence")) - 1).cast("double")
    return scored.withColumn("prediction", pred).select(key, "label", "prediction", "confidence")


def accuracy(pred: DataFrame) -> DataFrame:
    right = F.count_if(F.col("label") == F.col("prediction"))
    return pred.agg(F.count("*").alias("rows"), right.alias("correct"), (right.cast("double") / F.count("*").cast("double")).alias("accuracy"))


def confusion(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Long confusion matrix with the share of each cell in its actual class."""
    g = pred.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(actual))
    return g.withColumn("share", F.col("n").cast("double") / total.cast("double"))


def weak_labels(classified: DataFrame, key: str, least: float = 0.5, drop: Sequence[str] = ("unknown", "other")) -> DataFrame:
    """Labels for unlabelled rows from the rule engine's best type, without vague or unsure ones."""
    return classified.filter((F.col("confidence") >= least) & ~F.col("type").isin(list(drop))).select(key, F.col("type").alias("label"), "confidence")


def classify_chain(model: DataFrame, rules: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Model prediction when sure enough, else the rules, with the source kept."""
    j = model.join(rules.select(key, F.col("type").alias("_t"), F.col("confidence").alias("_c")), key, "left")
    sure = F.col("confidence") > least
    return j.select(
        key,
        F.when(sure, F.col("predicted")).otherwise(F.coalesce("_t", F.lit("unknown"))).alias("document_type"),
        F.when(sure, F.col("confidence")).otherwise(F.coalesce("_c", F.lit(0.0))).alias("confidence"),
        F.when(sure, "model").when(F.col("_t").isNotNull(), "rules").otherwise("none").alias("source"),
    )


def train_text_model(labelled: DataFrame, classes: Sequence[str], text: str = "text", label: str = "label") -> PipelineModel:
    """Multinomial logistic regression on weighted terms; labels are positions in the list of classes."""
    train = labelled.withColumn("_y", (F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(label)) - 1).cast("double"))
    # Terms are dear and the fits read their rows many times: terms and weights are written once.
    found = stored(terms(train, text).select("_y", "terms"))
    model = weights(found)
    weighed = stored(model.transform(found.filter("_y >= 0")).select("_y", "tfidf"))
    fit = LogisticRegression(featuresCol="tfidf", labelCol="_y", family="multinomial", regParam=0.001, maxIter=50).fit(weighed)
    return PipelineModel([*model.stages, fit])


def predict_text(model: PipelineModel, df: DataFrame, classes: Sequence[str], key: str, text: str = "text") -> DataFrame:
    """The likeliest class of each text (``predicted``) and its probability (``confidence``)."""
    out = model.transform(terms(df.select(key, text), text)).withColumn("_p", vector_to_array("probability"))
    name = F.element_at(F.array(*[F.lit(x) for x in classes]), (F.col("prediction") + 1).cast("int"))
    return out.select(key, name.alias("predicted"), F.array_max("_p").alias("confidence"))


# Three-letter codes of the two-letter languages, the default and the least length.
LANGUAGE_CODES = {
    "en": "eng", "hi": "hin", "ar": "ara", "fr": "fra", "de": "deu", "es": "spa", "pt": "por", "it": "ita", "ja": "jpn", "ko": "kor",
    "zh-cn": "chi_sim", "zh-tw": "chi_tra", "ru": "rus", "th": "tha", "vi": "vie", "tr": "tur", "pl": "pol", "nl": "nld", "ta": "tam",
    "te": "tel", "kn": "kan", "ml": "mal", "bn": "ben", "gu": "guj", "mr": "mar", "pa": "pan", "ur": "urd",
}
DEFAULT_LANGUAGE, LEAST_CHARS = "eng", 20


def trigrams(text: str) -> Column:
    """Distinct letter triples of the distinct words of a text."""
    return F.expr(
        f"array_distinct(flatten(transform(filter(array_distinct(split(lower({text}), '[^\\\\p{{L}}]+')), w -> length(w) > 2), "
        "w -> transform(sequence(1, length(w) - 2), i -> substring(w, i, 3)))))"
    )


def train_language(df: DataFrame, languages: Sequence[str], text: str = "text", lang: str = "lang") -> PipelineModel:
    """Naive Bayes over hashed letter triples; labels are positions in the language list."""
    index = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(lang)) - 1
    train = df.withColumn("label", index.cast("double")).filter("label >= 0").withColumn("tri", trigrams(text))
    tf = HashingTF(inputCol="tri", outputCol="features", numFeatures=1 << 14, binary=True)
    return Pipeline(stages=[tf, NaiveBayes()]).fit(train.select("tri", "label"))


def detect_language(model: PipelineModel, df: DataFrame, languages: Sequence[str], text: str = "text") -> DataFrame:
    """Language code per text; short and empty texts get the default."""
    codes = F.array(*[F.lit(LANGUAGE_CODES.get(x, DEFAULT_LANGUAGE)) for x in languages])
    out = model.transform(df.withColumn("tri", trigrams(text)))
    code = F.element_at(codes, (F.col("prediction") + 1).cast("int"))
    short = F.coalesce(F.length(F.trim(text)) < LEAST_CHARS, F.lit(True))
    return out.withColumn("language", F.when(short, DEFAULT_LANGUAGE).otherwise(code)).select(*df.columns, "language")
