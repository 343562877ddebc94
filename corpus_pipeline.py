"""From documents to encoded training rows, in five stages; each writes whole rows that the next one reads.

Every stage but the last returns the columns of documents as they are, extra and clashing ones too. An empty table gives an
empty result in each stage. Nulls: a null text counts as empty in every stage and stays null; rows with a null id
are judged like all others, except that near duplicates are found by id: rows without one stay, equal texts once.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanmill.llm import byte_bpe, jaccard_join, mixing, ordinal, pii
from scanmill.session import shared_folder


def _wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and whole rows beside them: an operator may add columns of any name."""
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier grades as good more likely than not; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = ordinal.classify(_wrapped(docs, "doc_id", "text"), ordinal.grades(labels), n_grades=3, wanted=2)
    return graded.where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of rows that share an id, the smallest text."""
    first = jaccard_join.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    rows = _wrapped(docs, "doc_id", "text")
    kept = rows.join(first, "doc_id", "left_semi").withColumn("_text", F.lit(None).cast("long"))
    without = rows.where("doc_id is null").withColumn("_text", F.xxhash64("text"))
    order = Window.partitionBy("doc_id", "_text").orderBy("text")
    return kept.unionAll(without).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(_wrapped(docs, "doc_id", "source", "text")), ["_row.*"])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row; the digest is that of the bytes the ids decode to."""
    # small pieces and memory: executors still hold what the stages before left in them
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, piece=2 << 20, kept=24 << 20)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("encoding", encoding),
]

#: Learned models and hashed choices are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
