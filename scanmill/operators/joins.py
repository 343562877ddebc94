"""Joins that the document domain needs, as equi-joins or compiled predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.functions.rules import let, literal_rows


def scans_with_users(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Scans keep their row when the user is unknown; broadcast is left to the measured size."""
    return scans.join(users, "user_id", "left")


def batch_with_documents(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    return jobs.join(docs, "job_id")


def usage_for_keys(usage: DataFrame, keys: DataFrame, key: str = "api_key_id") -> DataFrame:
    return usage.join(keys.select(key), key, "left_semi")


def inactive(catalogue: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Catalogue entries without activity."""
    return catalogue.join(used.select(key).distinct(), key, "left_anti")


def webhook_fanout(events: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per event and active configuration of its user that listens for the type; 'test' reaches all."""
    e, c = events.alias("e"), configs.filter("is_active").alias("c")
    hit = F.array_contains("c.events", F.col("e.event_type")) | (F.col("e.event_type") == "test")
    return e.join(c, (F.col("e.user_id") == F.col("c.user_id")) & hit).select(
        "e.event_id", "e.user_id", "e.event_type", F.col("c.config_id"), F.col("c.url")
    )


def alias_to_code(df: DataFrame, name: str, aliases: Mapping[str, str]) -> DataFrame:
    """Canonical code of a free-text type name. The alias table is fixed and small: a map literal, no join."""
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return df.withColumn("code", F.coalesce(F.element_at(m, F.lower(F.trim(name))), F.lit("unknown")))


def keyword_matches(docs: DataFrame, keywords: Mapping[str, str], text: str = "text") -> DataFrame:
    """One row per document and contained keyword, compiled to a filtered array instead of a join."""
    table = literal_rows([(g, k) for k, g in keywords.items()], ["kind", "keyword"])
    hits = let(F.lower(text), lambda t: F.filter(table, lambda k: F.contains(t, k["keyword"])))
    # The outer form keeps the optimiser from testing the array in a filter of its own.
    out = docs.withColumn("_hit", F.explode_outer(hits)).filter("_hit IS NOT NULL")
    return out.select(*[c for c in docs.columns if c != text], "_hit.*")


def cooccurring_keys(entries: DataFrame, context: str, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Influence between keys of a context: +0.1 for each setting of one while another was set in the last minute.

    Settings are counted per (context, second, key), so the window frame does the work of a self-join: it gathers
    the distinct keys of the last minute, and no pairs of settings are formed. Days are blocks with the minute before.
    """
    block = 86400
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    grid = entries.groupBy(context, sec.alias("second"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    grid = grid.withColumn("_home", F.floor(F.col("second") / block)).withColumn(
        "_block", F.explode(F.sequence("_home", F.floor((F.col("second") + seconds) / block)))
    )
    w = Window.partitionBy(context, "_block").orderBy("second").rangeBetween(-(seconds - 1), 0)
    seen = grid.withColumn("_seen", F.collect_set("key").over(w)).filter("_block = _home")
    pairs = seen.select("key", "n", F.explode("_seen").alias("influenced_by")).filter("key <> influenced_by")
    out = pairs.groupBy("key", "influenced_by").agg(F.sum("n").alias("times"))
    return out.withColumn("influence", F.col("times").cast("double") * 0.1)


def feedback_accuracy(pred: DataFrame, actual: DataFrame, key: str, group: str) -> DataFrame:
    j = pred.join(actual, key)
    right = F.count_if(F.col("predicted") == F.col("actual"))
    return j.groupBy(group).agg(
        F.count("*").alias("items"), right.alias("correct"),
        (right.cast("double") / F.count("*").cast("double")).alias("accuracy"),
    )


def blank_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def fill_gaps(first: DataFrame, second: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A second source fills only the empty fields of the first."""
    b = second.select(key, *[F.col(f).alias(f"_2_{f}") for f in fields])
    j = first.join(b, key, "left")
    return j.select(
        key,
        *[F.coalesce(blank_to_null(f), blank_to_null(f"_2_{f}")).alias(f) for f in fields],
        F.coalesce(*[F.when(blank_to_null(f).isNull() & blank_to_null(f"_2_{f}").isNotNull(), F.lit(True)) for f in fields], F.lit(False)).alias("assisted"),
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """Listed fields take the last non-empty correction; unknown fields are ignored."""
    c = corrections.filter(F.col("field").isin(list(fields)) & (F.col("corrected") != ""))
    last = c.groupBy(key).agg(
        *[F.max_by(F.when(F.col("field") == f, F.col("corrected")), F.when(F.col("field") == f, F.col(order))).alias(f"_c_{f}") for f in fields]
    )
    return df.join(last, key, "left").select(
        key, *[F.coalesce(f"_c_{f}", F.col(f)).alias(f) for f in fields]
    )


def insert_if_absent(src: DataFrame, dst: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Destination plus the source rows whose key it lacks."""
    return dst.unionByName(src.join(dst.select(*keys), list(keys), "left_anti").select(*dst.columns))
