"""Mix sources to target weights by fitting each source's word budget as a subset sum.

Sizes are counted in words. A source of S words with target T gets every document floor(T / S) times; the rest
of the budget is filled exactly as far as whole documents allow: documents are counted by length, most of the
budget is shared out in proportion to the counts, and a bounded-knapsack dynamic program over lengths fills the
remainder. Where it misses, it reaches wider, in the end over the whole budget without a proportional share, as long as
`WORK` allows. Within a length the documents with the smallest seeded hashes are taken.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; documents of size 0 add no
words and get the source's whole repeats only; of rows that agree in id, source and text any are taken, as many as fit.
Only `doc_id`, `source` and `text` are looked at; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanmill.session import stored

#: Words of budget left to the dynamic program at first, after the proportional share.
EXACT = 20_000
#: Steps of the program, a word of its reach and an item each, up to which a wider reach is tried.
WORK = 500_000_000
#: Plan rows (a source and a length each, about 40 bytes) up to which the plan is sent to all executors.
SMALL_PLAN = 200_000
_WORD = r"[^\x20\x09-\x0D]+"


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """How many documents to take of each length, at most `counts`, so that the words come as near below `budget` as found."""
    take, worded = np.zeros(len(lengths), np.int64), lengths > 0
    if not worded.all():  # documents without words fill nothing
        take[worded] = fill(lengths[worded], counts[worded], budget, exact)
        return take
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    share = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((share * lengths).sum())
    best, miss = _fit(lengths, counts, share, left, exact)
    reach = exact
    while miss and reach < left:
        reach = min(left, 4 * reach)
        if _work(lengths, counts - share, reach) > WORK:
            break
        wider, more = _fit(lengths, counts, share, left, reach)
        if more < miss:
            best, miss = wider, more
    if miss and _work(lengths, counts, budget) <= WORK:
        best, miss = _fit(lengths, counts, np.zeros_like(share), budget, budget)
    return best


def _work(lengths: np.ndarray, counts: np.ndarray, reach: int) -> float:
    most = np.minimum(counts, reach // lengths)
    return reach * float(np.ceil(np.log2(most + 1.0)).sum())


def _fit(lengths: np.ndarray, counts: np.ndarray, share: np.ndarray, left: int, reach: int) -> tuple[np.ndarray, int]:
    """`share` and as much of the `left` words as found, with the words missed: long documents, then a program over what remains."""
    take = share.copy()
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # long documents first, down to what the program below is to fit
        if left <= reach:
            break
        n = min(int(counts[i] - take[i]), max(0, left - reach) // int(lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    items, first = [], np.full(left + 1, -1, np.int32)  # the item by which each sum is first reached
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    for i in order[::-1]:
        n, size, part = int(counts[i] - take[i]), int(lengths[i]), 1
        if size > left or reached[left]:
            break
        n = min(n, left // size)
        while n > 0 and not reached[left]:
            p = min(part, n)
            new = reached[: left + 1 - p * size] & ~reached[p * size :]
            first[p * size :][new] = len(items)
            reached[p * size :] |= new
            items.append((i, p))
            n -= p
            part *= 2
    at = int(np.flatnonzero(reached)[-1])
    miss = left - at
    while at:
        i, p = items[first[at]]
        take[i] += p
        at -= p * int(lengths[i])
    return take, miss


def with_sizes(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"mix_size": size, "mix_hash": F.xxhash64(F.lit(seed), "doc_id", "source", "text")})


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source of (source, mix_size): its words and target.

    Resharing the excess of capped sources by weight ends at min(cap, level * weight); the level is the largest of those
    obtained when the sources with the lowest cap for their weight are taken as capped one after the other.
    """
    by = sizes.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    # From here on there is one row per source.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    order = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    return (
        by.withColumn("_weight", weight)
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_fill", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_level", level)
        .withColumn("target", F.least("_cap", F.max("_level").over(everything) * F.col("_weight")))
        .select("source", "source_size", "target")
    )


def mix_plan(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """For each (source, mix_size): whole repeats, the largest hash that is taken once more (null: none), its rows and how many of them are taken."""
    hist = sized.groupBy("source", "mix_size").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        whole = int(target // size) if size else 0
        pdf["whole"] = whole
        pdf["extra"] = fill(pdf.mix_size.to_numpy(), pdf.n.to_numpy(), round(target) - whole * size)
        return pdf[["source", "mix_size", "whole", "extra"]]

    joined = hist.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    counts = joined.groupBy("source").applyInPandas(fit, "source string, mix_size long, whole long, extra long")
    # The extra-th smallest hash of each length, by 256 ranges of the hash, so that a frequent length is not one group.
    hashes = sized.select("source", "mix_size", "mix_hash", F.shiftright("mix_hash", 56).alias("_range"))
    ranges = hashes.groupBy("source", "mix_size", "_range").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source", "mix_size").orderBy("_range"))
    c = counts.select(F.col("source").alias("_s"), F.col("mix_size").alias("_m"), "whole", "extra")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("mix_size") == F.col("_m"))
    cut = (
        ranges.withColumn("_upto", upto)
        .join(c.where("extra > 0"), same)
        .where((F.col("_upto") >= F.col("extra")) & (F.col("_upto") - F.col("n") < F.col("extra")))
        .select(F.col("_s"), F.col("_m"), F.col("_range").alias("_r"), (F.col("extra") - F.col("_upto") + F.col("n")).alias("_nth"))
    )
    inside = hashes.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("mix_size") == F.col("_m")) & (F.col("_range") == F.col("_r")))
    each = inside.groupBy("source", "mix_size", "_range", "mix_hash", "_nth").agg(F.count("*").alias("_n"))
    k = F.sum("_n").over(Window.partitionBy("source", "mix_size", "_range").orderBy("mix_hash"))
    last = each.withColumn("_k", k).where("_k >= _nth and _k - _n < _nth")
    last = last.select(F.col("source").alias("_ls"), F.col("mix_size").alias("_lm"), F.col("mix_hash").alias("last_hash"), F.col("_n").alias("last_rows"), F.expr("_nth - _k + _n").alias("last_taken"))
    return c.join(last, F.col("_s").eqNullSafe(F.col("_ls")) & (F.col("_m") == F.col("_lm")), "left").select("_s", "_m", "whole", "last_hash", "last_rows", "last_taken")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """Every row of `docs` with mix_size, source_size, target and mix_copies: how often the mix takes it (0 to `most`)."""
    clash = {"mix_size", "mix_hash", "source_size", "target", "mix_copies", "_s", "_m", "whole", "last_hash", "last_rows", "last_taken", "_gs", "_part", "_nth"} & set(docs.columns)
    docs = docs.drop(*clash)
    sized = stored(with_sizes(docs.select("doc_id", "source", "text"), seed).select("source", "mix_size", "mix_hash"))
    goals = stored(targets(sized, weights, most))
    plan = stored(mix_plan(sized, goals))
    plan = plan.join(goals.withColumnRenamed("source", "_gs"), F.col("_s").eqNullSafe(F.col("_gs"))).drop("_gs")
    tied = not plan.where("last_taken < last_rows").isEmpty()
    if plan.count() <= SMALL_PLAN:
        plan = F.broadcast(plan)
    out = with_sizes(docs, seed).join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("mix_size") == F.col("_m")), "left")
    again = F.when(F.col("mix_hash") <= F.col("last_hash"), 1).otherwise(0)
    if tied:  # equal rows of which some are taken: numbered within the parts they come in
        equal = "coalesce(mix_hash = last_hash and last_taken < last_rows, false)"
        rows = stored(out.where(equal).withColumn("_part", F.spark_partition_id()))
        upto = F.sum("count").over(Window.partitionBy("_s", "_m").orderBy("_part"))
        parts = rows.groupBy("_s", "_m", "_part").count().select(F.col("_s").alias("_ps"), F.col("_m").alias("_pm"), F.col("_part").alias("_pp"), (upto - F.col("count")).alias("_before"))
        same = F.col("_s").eqNullSafe(F.col("_ps")) & (F.col("_m") == F.col("_pm")) & (F.col("_part") == F.col("_pp"))
        nth = F.row_number().over(Window.partitionBy("_s", "_m", "_part").orderBy("mix_hash"))
        rows = rows.withColumn("_nth", nth).join(parts, same).withColumn("_nth", F.col("_nth") + F.col("_before")).drop("_ps", "_pm", "_pp", "_before", "_part")
        out = out.where(f"not {equal}").withColumn("_nth", F.lit(0).cast("long")).unionByName(rows)
        again = F.when(F.col("_nth") > F.col("last_taken"), 0).otherwise(again)
    return out.withColumn("mix_copies", (F.coalesce("whole", F.lit(0)) + again).cast("int")).drop("_s", "_m", "whole", "last_hash", "last_rows", "last_taken", "mix_hash", "_nth")


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.where("mix_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "mix_copies"))).select(*columns)
