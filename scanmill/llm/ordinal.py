"""Quality classifier: ordinal regression on graded ratings with a cumulative link.

A text is a set of hashed words and a few shares (words in capitals, with digits, with trailing marks, repeated at once).
One weight vector gives a score, ordered thresholds cut it into grades: P(grade <= k) = sigmoid(threshold_k - score). The
expected grade ranks texts; the probability of at least the wanted grade selects them.

Fitted on the driver from at most `max_rows` rated rows, those with the smallest hash of their id; a word counts as a
feature if `min_rows` of them hold it. Scoring is one narrow pass over all texts.

Defined cases: a null or blank text has no words and is scored by the thresholds alone; a rating with null grade or without its document
is not used; repeated ratings all count; without any rating the probabilities are null and every document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.words import Words, hashes, pieces, split
from scanmill.session import stored

#: Patterns whose share of words is a feature; `repeat` is added to them.
SHAPES = {
    "capitals": r"^\P{Ll}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$",
    "digit": r"\p{Nd}",
    "marks": r"[^\p{L}\p{N}]{2,}$",
    "bare_mark": r"^[^\p{L}\p{N}]+$",
    "stop": r"\p{L}[.?]$",
    "comma": r"\p{L},$",
    "exclaim": r"!$",
    "long": r"^.{16,}$",
}
N_SHAPES = len(SHAPES) + 1
#: A share of one weighs as much as so many words.
SCALE = 8.0


def features(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, word hash) pairs, and the shares by row and shape."""
    n_rows, n_words = len(found.start) - 1, np.maximum(found.counts, 1)
    bare = pc.utf8_lower(pc.utf8_trim(found.words, characters="".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())))
    key, rows = hashes(bare), found.rows
    pairs = np.unique(rows * len(key) + found.codes)
    row, word = pairs // max(len(key), 1), key[pairs % max(len(key), 1)] if len(key) else key
    shares = np.zeros((n_rows, N_SHAPES))
    for k, pattern in enumerate(SHAPES.values()):
        flag = pc.match_substring_regex(found.words, pattern).to_numpy(zero_copy_only=False)
        shares[:, k] = np.bincount(rows, flag[found.codes], n_rows)
    same = (found.codes[1:] == found.codes[:-1]) & (rows[1:] == rows[:-1])
    shares[:, -1] = np.bincount(rows[1:], same, n_rows)
    return row, word, SCALE * shares / n_words[:, None]


@dataclass
class OrdinalModel:
    keys: np.ndarray
    weights: np.ndarray
    shapes: np.ndarray
    thresholds: np.ndarray

    def score(self, found: Words) -> np.ndarray:
        row, word, shares = features(found)
        total = shares @ self.shapes
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, word), len(self.keys) - 1)
            total += np.bincount(row, np.where(self.keys[at] == word, self.weights[at], 0.0), len(total))
        return total

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(grade: np.ndarray, of: np.ndarray, col: np.ndarray, shares: np.ndarray, keys: np.ndarray, n_grades: int, steps: int = 500, rate: float = 0.05, l1: float = 2e-4) -> OrdinalModel:
    """Maximum likelihood with a lasso, by proximal steps of Adam over all rows; row of[i] holds the word keys[col[i]]."""
    n, m = len(grade), len(keys)
    below = np.cumsum(np.bincount(grade, minlength=n_grades))[:-1]
    share = (below + 0.5) / (n + 1)
    first = np.log(share / (1 - share))
    # thresholds: the first one, then logarithms of the gaps, which keeps them in order
    x = np.concatenate([np.zeros(m + N_SHAPES), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    mean, var = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    for t in range(1, steps + 1):
        w, s, gaps = x[:m], x[m : m + N_SHAPES], np.exp(x[m + N_SHAPES + 1 :])
        cut = np.concatenate([[-np.inf], x[m + N_SHAPES] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(of, w[col], n) + shares @ s
        high, low = sigmoid(cut[grade + 1] - score), sigmoid(cut[grade] - score)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        dscore = (dh - dl) / n  # of the negative log-likelihood
        dcut = np.zeros(n_grades + 1)
        np.add.at(dcut, grade + 1, -dh / n)
        np.add.at(dcut, grade, dl / n)
        dcut = dcut[1:-1]
        g = np.concatenate([np.bincount(col, dscore[of], m), shares.T @ dscore, [dcut.sum()], [dcut[k + 1 :].sum() * gaps[k] for k in range(len(gaps))]])
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        step = rate / (np.sqrt(var / (1 - 0.99**t)) + 1e-6)
        x = x - step * mean / (1 - 0.9**t)
        x[:m] = np.sign(x[:m]) * np.maximum(np.abs(x[:m]) - step[:m] * l1, 0)
    w = x[:m]
    used = w != 0
    cut = x[m + N_SHAPES] + np.concatenate([[0], np.cumsum(np.exp(x[m + N_SHAPES + 1 :]))])
    return OrdinalModel(keys[used], w[used], x[m : m + N_SHAPES], cut)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rows: int = 20_000, min_rows: int = 5) -> OrdinalModel | None:
    """Fit on (doc_id, grade) rows, grades 0 to n_grades - 1; None without any. Only words of at least `min_rows` rows reach the driver."""
    rated = ratings.where("doc_id is not null and grade is not null").select("doc_id", "grade")
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rows)  # at most max_rows rows, so small enough to send
    text = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, word, shares = features(split(batch.column("text")))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sets = _lists(word.astype(np.int64), ends)
            order = [xxhash.xxh3_64_intdigest(np.sort(word[a:z]).tobytes()) >> 1 for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("grade").cast(pa.int32()), pa.array(order, pa.int64()), sets, _lists(shares.ravel(), np.arange(batch.num_rows + 1) * N_SHAPES)], names=["grade", "row", "words", "shares"])

    rows = stored(text.mapInArrow(read, "grade int, row long, words array<long>, shares array<double>"))
    frequent = rows.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= min_rows).select("word")
    keys = np.sort(frequent.toArrow().column("word").to_numpy().astype(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            words, offsets = lists.values.to_numpy().astype(np.uint64), lists.offsets.to_numpy()
            at = np.minimum(np.searchsorted(sent.value, words), max(0, len(sent.value) - 1))
            known = sent.value[at] == words if len(sent.value) else np.zeros(len(words), bool)
            ends = np.concatenate([[0], np.cumsum(known)])[offsets]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("row"), _lists(at[known].astype(np.int32), ends - ends[0]), batch.column("shares")], names=["grade", "row", "words", "shares"])

    table = rows.mapInArrow(number, "grade int, row long, words array<int>, shares array<double>").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by([("row", "ascending"), ("grade", "ascending")])  # the order of tasks does not matter
    grade, lists = table.column("grade").to_numpy(), table.column("words").combine_chunks()
    of = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    shares = table.column("shares").combine_chunks().flatten().to_numpy().reshape(-1, N_SHAPES)
    return fit(grade, of, lists.flatten().to_numpy(), shares, keys, n_grades)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def classify(docs: DataFrame, ratings: DataFrame, n_grades: int, wanted: int, least: float = 0.5, max_rows: int = 20_000) -> DataFrame:
    """Every row of `docs` with expected_grade, tail_prob = P(grade >= wanted) and kept = tail_prob >= least."""
    model = train(docs, ratings, n_grades, max_rows)
    docs = docs.drop("expected_grade", "tail_prob", "kept")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail_prob": F.lit(None).cast("double"), "kept": F.lit(True)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            tails = sent.value.tails(sent.value.score(split(batch.column("text"))))
            tail = tails[:, wanted - 1]
            added = {"expected_grade": pa.array(tails.sum(1)), "tail_prob": pa.array(tail), "kept": pa.array(tail >= least)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "expected_grade double, tail_prob double, kept boolean"])
    return docs.mapInArrow(run, schema)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good; null where neither label says."""
    return labels.select("doc_id", F.expr("case when toxic = 1 then 0 when quality = 0 then 1 when quality = 1 then 2 end").cast("int").alias("grade"))
