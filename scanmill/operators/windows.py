"""Running and sliding computations over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.operators.ordered import prefix_sums
from scanmill.sources.tables import cents


def growth_series(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Rows per period and growth against the period before; the window sees one row per period."""
    g = df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("scans"))
    prev = F.lag("scans").over(Window.partitionBy().orderBy("period"))
    return g.withColumn("previous", prev).withColumn(
        "growth_rate",
        F.when(
            F.col("previous") > 0,
            (F.col("scans") - F.col("previous")).cast("double") / F.col("previous").cast("double") * 100.0,
        ).otherwise(0.0),
    )


def running_average(df: DataFrame, key: str, value: str, order: Sequence[str], where: Column) -> DataFrame:
    """Running mean of a two-decimal value per key over qualifying rows, cut into slices for hot keys."""
    narrow = df.filter(where).select(key, *order, cents(value).alias("_c"))
    run = prefix_sums(
        narrow, [key], order, {"_s": F.coalesce("_c", F.lit(0)), "running_count": F.lit(1).cast("bigint")}
    )
    avg = F.col("_s").cast("double") / F.col("running_count").cast("double") / 100.0
    return run.select(key, *order, "running_count", avg.alias("running_avg"))


def latest_trend(df: DataFrame, key: str, value: str, order: Sequence[str], n: int = 50) -> DataFrame:
    """Latest n values per key with their moving mean.

    The rank filter is applied before the shuffle as well (window group limit), so a hot key sends
    at most n rows per task.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    top = df.select(key, *order, value).withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)
    back = Window.partitionBy(key).orderBy(F.desc("rn")).rowsBetween(-(n - 1), 0)
    c = cents(value)
    mean = F.sum(c).over(back).cast("double") / F.count(c).over(back).cast("double") / 100.0
    return top.select(key, *order, value, "rn", mean.alias("moving_avg"))


def counts_in_window(
    df: DataFrame, key: str, ts: str, seconds: int, where: Column | None = None, block: int = 86400
) -> DataFrame:
    """Events of a key in the last ``seconds`` (inclusive), per second in which the key has an event.

    Rows are counted per (key, second) first. Each second then goes to its own time block and, where
    the window reaches into it, to the next; a block of a key has at most ``block`` + ``seconds``
    rows however hot the key is.
    """
    base = df if where is None else df.filter(where)
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    per = base.groupBy(key, sec.alias("second")).agg(F.count("*").alias("n"))
    home = F.floor(F.col("second") / block)
    reach = F.floor((F.col("second") + seconds) / block)
    copies = per.withColumn("_home", home).withColumn("block", F.explode(F.sequence("_home", reach)))
    w = Window.partitionBy(key, "block").orderBy("second").rangeBetween(-seconds, 0)
    return (
        copies.withColumn("in_window", F.sum("n").over(w))
        .filter(F.col("block") == F.col("_home"))
        .select(key, "second", "n", "in_window")
    )


def failed_attempts(df: DataFrame, minutes: int = 15, limit: int = 5) -> DataFrame:
    """Failures of an email in the minutes before, at each second with a failure; locked at the limit."""
    c = counts_in_window(df, "email", "attempted_at", minutes * 60, ~F.col("success"))
    return c.select(
        "email", "second", F.col("n").alias("failures"), F.col("in_window").alias("failures_in_window"),
        (F.col("in_window") >= limit).alias("locked"),
    )


def sliding_rate(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Arrivals of an identifier in the sliding window and whether they exceed the limit."""
    c = counts_in_window(df, key, ts, seconds)
    return c.select(
        key, "second", F.col("n").alias("requests"), F.col("in_window").alias("requests_in_window"),
        (F.col("in_window") > limit).alias("over_limit"),
    )


def lockout_attempts(df: DataFrame, minutes: int = 15, limit: int = 5) -> DataFrame:
    """Every attempt with the failures of its email in the minutes up to it.

    Counts come per (email, second) for all seconds with an attempt; the join back is on that pair,
    so a hot email is spread over its seconds.
    """
    a = df.withColumn("second", F.unix_seconds(F.col("attempted_at").cast("timestamp")))
    sec = a.groupBy("email", "second").agg(F.count_if(~F.col("success")).alias("f"))
    seconds, block = minutes * 60, 86400
    home, reach = F.floor(F.col("second") / block), F.floor((F.col("second") + seconds) / block)
    copies = sec.withColumn("_home", home).withColumn("block", F.explode(F.sequence("_home", reach)))
    w = Window.partitionBy("email", "block").orderBy("second").rangeBetween(-seconds, 0)
    counts = (
        copies.withColumn("recent_failures", F.sum("f").over(w))
        .filter(F.col("block") == F.col("_home"))
        .select("email", "second", "recent_failures")
    )
    return a.join(counts, ["email", "second"]).select(
        "id", "email", "success", "recent_failures", (F.col("recent_failures") >= limit).alias("locked")
    )


def failure_streaks(df: DataFrame, key: str, order: Sequence[str], failed: Column, threshold: int) -> DataFrame:
    """Longest run of consecutive failures per key and whether the threshold was reached.

    A run is numbered by the successes before it, a running sum over slices; run lengths are then
    partial counts.
    """
    narrow = df.select(key, *order, failed.alias("_bad"))
    run = prefix_sums(narrow, [key], order, {"_ok": F.when(F.col("_bad"), 0).otherwise(1).cast("bigint")})
    lengths = run.filter("_bad").groupBy(key, "_ok").agg(F.count("*").alias("length"))
    return lengths.groupBy(key).agg(
        F.count("*").alias("streaks"),
        F.max("length").alias("longest"),
        F.count_if(F.col("length") >= threshold).alias("threshold_hits"),
    )


# Seconds before each retry of a delivery.
RETRY_DELAYS = [10, 60, 300]


def retry_schedule(
    df: DataFrame, id_cols: Sequence[str], attempt: str, ts: str, delivered: Column, delays: Sequence[int] = RETRY_DELAYS
) -> DataFrame:
    """Delay and next retry time of the nth attempt; null once delivered or out of attempts."""
    d = F.element_at(F.array(*[F.lit(int(x)) for x in delays]), F.least(F.col(attempt), F.lit(len(delays))).cast("int"))
    stop = delivered | (F.col(attempt) >= len(delays))
    nxt = F.when(~stop, F.col(ts) + F.make_dt_interval(secs=d))
    return df.select(
        *id_cols, attempt, F.when(~stop, d).cast("bigint").alias("delay_seconds"), nxt.alias("next_retry_at")
    )


def evict_lowest(df: DataFrame, score: Column, key: str, capacity: int, share: float = 0.2, full: float = 0.8) -> DataFrame:
    """Rows to drop: the lowest-scored share, when the table is fuller than ``full`` of its capacity.

    The cut is the exact score at that rank, found by counting scores over slices; ties at the cut
    are taken in key order the same way.
    """
    s = df.select(key, score.alias("score"))
    n = s.agg(F.count("*")).scalar()
    ranked = prefix_sums(s.withColumn("_all", F.lit(0)), ["_all"], ["score", key], {"rank": F.lit(1).cast("bigint")})
    return (
        ranked.withColumn("_n", n)
        .filter((F.col("_n") > capacity * full) & (F.col("rank") <= F.floor(F.col("_n") * share)))
        .select(key, "score", "rank")
    )
