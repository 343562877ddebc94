"""Running totals over ordered keys that do not put a whole key into one task.

A window partitioned by a key sorts that key's rows in a single task, which fails once one key
holds a large share of the table. Here rows are range-partitioned by (key, order), so a hot key is
cut into many slices; totals inside a slice are added to the sum of the slices before it. Only one
row per (key, slice) meets in the second step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.session import checkpointed


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Add, per key, the running sum of each expression up to and including the row.

    ``order`` must be unique within a key. Sums must be of whole numbers, so that adding the parts
    gives the same result in any order.
    """
    vals = {f"_v_{n}": e for n, e in sums.items()}
    sliced = (
        df.withColumns(vals)
        .repartitionByRange(*[F.col(c) for c in [*keys, *order]])
        .withColumn("_slice", F.spark_partition_id())
    )
    # Range bounds are sampled: fix them before two branches read the slice number.
    sliced = checkpointed(sliced)
    part = sliced.groupBy(*keys, "_slice").agg(*[F.sum(v).alias(f"_t{v}") for v in vals])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_t{v}").over(before), F.lit(0)).alias(f"_o{v}") for v in vals]
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run = sliced.withColumns({f"_r{v}": F.sum(v).over(inside) for v in vals})
    joined = run.join(offsets, [*keys, "_slice"])
    out = joined.withColumns({n: F.col(f"_r_v_{n}") + F.col(f"_o_v_{n}") for n in sums})
    return out.select(*df.columns, *sums)


def _with_total(run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the number of values per key; one scalar when there is no key, so that nothing is shuffled to one place."""
    if not keys:
        return run.withColumn("_total", run.agg(F.max("_cum")).scalar())
    total = run.groupBy(*keys).agg(F.max("_cum").alias("_total"))
    # One row per key on the right: broadcast when it is measured small, else split by the skew join.
    return run.join(total, list(keys))


def rank_percentiles(
    df: DataFrame, value: str, percents: Sequence[int], keys: Sequence[str] = (), prefix: str = "p"
) -> DataFrame:
    """Exact percentiles by the rule sorted[min(floor(n*p/100), n-1)] (0-based), per key.

    Values are counted first, so a shuffle carries each distinct value once; the position is found
    on running counts over slices of the value range.
    """
    spark_keys = list(keys) or ["_all"]
    base = df.filter(F.col(value).isNotNull())
    if not keys:
        base = base.withColumn("_all", F.lit(0))
    counts = base.groupBy(*spark_keys, value).agg(F.count("*").alias("_n"))
    run = prefix_sums(counts, spark_keys, [value], {"_cum": F.col("_n")})
    hit = _with_total(run, keys)

    def pick(p: int) -> Column:
        target = F.least(F.floor(F.col("_total") * p / 100), F.col("_total") - 1) + 1
        return F.min(F.when(F.col("_cum") >= target, F.col(value))).alias(f"{prefix}{p}")

    return hit.groupBy(*spark_keys).agg(*[pick(p) for p in percents]).select(
        *keys, *[f"{prefix}{p}" for p in percents]
    )


def interpolated_quantiles(
    df: DataFrame, value: str, quantiles: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exclusive-method quantiles: position (n+1)*q, linear between neighbours, clamped to the ends.

    The same counting and slicing as in rank_percentiles; needs at least two values per key.
    """
    spark_keys = list(keys) or ["_all"]
    base = df.filter(F.col(value).isNotNull())
    if not keys:
        base = base.withColumn("_all", F.lit(0))
    counts = base.groupBy(*spark_keys, value).agg(F.count("*").alias("_n"))
    run = prefix_sums(counts, spark_keys, [value], {"_cum": F.col("_n")})
    hit = _with_total(run, keys)
    aggs, outs = [], []
    for name, q in quantiles.items():
        pos = (F.col("_total") + 1) * F.lit(float(q))
        lo = F.greatest(F.lit(1), F.least(F.floor(pos), F.col("_total") - 1))
        aggs += [
            F.min(F.when(F.col("_cum") >= lo, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") >= lo + 1, F.col(value))).alias(f"_hi_{name}"),
        ]
        w = (F.col("_total") + 1) * F.lit(float(q)) - F.greatest(
            F.lit(1), F.least(F.floor((F.col("_total") + 1) * F.lit(float(q))), F.col("_total") - 1)
        )
        outs.append(
            (F.col(f"_lo_{name}") + w * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name)
        )
    g = hit.groupBy(*spark_keys).agg(F.max("_total").alias("_total"), *aggs)
    return g.select(*keys, *outs)
