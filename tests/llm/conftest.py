import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source) rows, with the columns of the table."""

    def of(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA).repartition(3)

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and blank texts, repeated rows, one very long text, and columns whose names operators use."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[(i * 7 + i // 10) % 10] + str(i % 97) for i in range(60_000)) + " " + "x" * 50_000
    rows = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "One two three four five six.", "b"), (4, "One two three four five six.", "b")]
    rows += [(None, "One two three four five six.", "b"), (5, "same " * 40, "b"), (6, long, "c"), (7, "Ünïcode  non-breaking", "c")]
    clash = ["kept", "label", "size", "target", "component_id", "id", "fold", "expected_grade", "mix_size", "_row", "n_words", "spans", "keys"]
    return make(rows).withColumns({c: F.lit("mine") for c in clash})


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def table(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
