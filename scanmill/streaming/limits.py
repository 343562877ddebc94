"""Request limits by route group: a table of limits, one stream for all of them."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of the route groups, and seconds of the units.
GROUP_LIMITS = {
    "public": "5 per minute, 50 per hour",
    "user": "20 per minute, 200 per hour",
    "premium": "50 per minute, 500 per hour",
    "admin": "100 per minute, 1000 per hour",
    "ocr": "10 per minute, 60 per hour",
    "batch": "5 per minute, 20 per hour",
    "analytics": "30 per minute, 300 per hour",
    "health": "60 per minute",
    "light": "30 per minute",
    "medium": "10 per minute",
    "heavy": "5 per minute",
    "scan": "2 per second; 20 per minute; 100 per hour",
    "batch_route": "1 per second; 5 per minute; 20 per hour",
    "auth": "5 per minute; 20 per hour",
    "analytics_route": "10 per minute; 100 per hour",
}
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_LIMIT = re.compile(r"(\d+)\s*(?:per|/)\s*(second|minute|hour|day)s?")


def parse_limits(text: str) -> list[tuple[int, int]]:
    """(seconds, most) of each part of a limit text; parts are separated by commas or semicolons."""
    out = []
    for part in re.split(r"[;,]", text):
        m = _LIMIT.fullmatch(part.strip())
        if m is None:
            raise ValueError(f"not a limit: {part!r}")
        out.append((UNITS[m[2]], int(m[1])))
    return out


def limits_table(spark: SparkSession, groups: Mapping[str, str] = GROUP_LIMITS) -> DataFrame:
    """One row per group and window: (limit_group, seconds, most)."""
    rows = [(g, s, n) for g, text in groups.items() for s, n in parse_limits(text)]
    return spark.createDataFrame(rows, "limit_group STRING, seconds INT, most INT")


def grouped_limits(df: DataFrame, limits: DataFrame, ts: str, key: str, group: str) -> DataFrame:
    """Requests per key, group and limit window, and whether the limit is exceeded.

    A request counts in every window of its group; one without a key, time or group with limits counts nowhere. All
    windows nest in a day, which is part of the grouping: a day's counts end when the watermark has passed it. Counts
    are combined inside each task before the shuffle, so a hot key sends one row per window and task.
    """
    own = limits.select(F.col("limit_group").alias("_g"), F.col("seconds").alias("_s"), F.col("most").alias("_m"))
    met = df.join(own, F.col(group) == F.col("_g")).filter(F.col(key).isNotNull())
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    start = F.timestamp_seconds(second - F.pmod(second, F.col("_s")))
    g = met.groupBy(F.window(ts, "1 day").alias("_day"), F.col("_g"), F.col(key).alias("_k"), "_s", "_m", start.alias("_start")).agg(F.count("*").alias("n"))
    return g.select(
        F.col("_g").alias("limit_group"), F.col("_k").alias(key), F.col("_s").alias("seconds"),
        F.col("_start").cast("timestamp_ntz").alias("window_start"), "n", F.col("_m").alias("most"), (F.col("n") > F.col("_m")).alias("exceeded"),
    )
