"""Distributed forms against direct computation, including hot keys and full buckets."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.operators import duplicates as D
from scanmill.operators import ordered as O
from scanmill.operators import phrases as P
from scanmill.operators import sketches as Sk
from scanmill.operators import windows as W
from scanmill.sources import daily as Da


def test_prefix_sums_with_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"), "id", (F.col("id") % 11).alias("v"))
    got = O.prefix_sums(df, ["k"], ["id"], {"s": F.col("v")})
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("id")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_rank_percentile_rule(spark):
    r = O.rank_percentiles(spark.range(1, 21).select(F.col("id").cast("double").alias("v")), "v", [50, 95, 99]).collect()[0]
    assert (r["p50"], r["p95"], r["p99"]) == (11.0, 20.0, 20.0)


def test_interpolated_quantiles_follow_the_exclusive_method(spark):
    import statistics

    xs = [random.Random(3).random() * 100 for _ in range(157)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    r = O.interpolated_quantiles(df, "v", {"m": 0.5, "p95": 0.95}).collect()[0]
    assert r["m"] == pytest.approx(statistics.median(xs))
    assert r["p95"] == pytest.approx(statistics.quantiles(xs, n=20)[18])


def clustered():
    """Distinct signed hashes: near ones of forty, and a third of all within a few bits of one."""
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    hs = set(base)
    for h in base:
        for _ in range(4):
            x = h
            for b in rnd.sample(range(64), rnd.randint(1, 7)):
                x ^= 1 << b
            hs.add(x)
    # Many hashes that agree on most bits.
    hs |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)}
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in sorted(hs)]
    rnd.shuffle(signed)
    return signed


@pytest.mark.parametrize("unit", [7, 10_000])
@pytest.mark.parametrize("distance", [5, 2])
def test_near_pairs_equal_brute_force(spark, unit, distance):
    """Small cells cut the keys that many hashes hold."""
    signed = clustered()
    df = spark.createDataFrame([(h, i, 1) for i, h in enumerate(signed)], "h bigint, first_id bigint, copies bigint")
    got = [(r["id1"], r["id2"], r["distance"]) for r in D.near_pairs(df, distance, unit).collect()]
    want = []
    for i, a in enumerate(signed):
        for j in range(i + 1, len(signed)):
            d = ((a ^ signed[j]) & ((1 << 64) - 1)).bit_count()
            if d <= distance:
                want.append((i, j, d))
    assert sorted(got) == sorted(want)
    first = {}
    for i, j, d in sorted(want):
        first.setdefault(j, (i, d))
    stars = D.earliest_within(df, None, distance, unit).collect()
    assert {r["first_id"]: tuple(r["m"]) for r in stars} == first
    old, new = df.where("first_id % 3 = 0"), df.where("first_id % 3 > 0")
    cross = {}
    for i, j, d in sorted(want):
        for a, b in ((i, j), (j, i)):
            if a % 3 == 0 and b % 3 and a < cross.get(b, (1 << 60, 0))[0]:
                cross[b] = (a, d)
    assert {r["first_id"]: tuple(r["m"]) for r in D.earliest_within(new, old, distance, unit).collect()} == cross


def test_near_pairs_start_no_job_while_planned(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    D.near_pairs(spark.range(1000).select((F.col("id") * 99991).alias("h"), F.col("id").alias("first_id"), F.lit(1).alias("copies")))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_keyed_hashes_are_not_broadcast(spark):
    """A hash has 56 keyed rows, which the engine's estimate leaves out: they must not be collected by the driver."""
    h = spark.createDataFrame([(x, i, 1) for i, x in enumerate(clustered())], "h bigint, first_id bigint, copies bigint")
    for df in (D.near_pairs(h), D.earliest_within(h), D.earliest_within(h, h)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_keys_dealt_to_cells_are_not_broadcast(spark):
    """The size of cached hashes is known and small, and that of their cells follows from it without the 56 keys."""
    h = spark.createDataFrame([(x, i, 1) for i, x in enumerate(clustered())], "h bigint, first_id bigint, copies bigint").persist()
    h.count()
    new = h.groupBy("h").agg(F.min("first_id").alias("first_id"), F.min("copies").alias("copies"))
    for df in (D.near_pairs(new), D.earliest_within(new), D.earliest_within(new, new)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    h.unpersist()


def test_counts_in_window_across_blocks(spark):
    rnd = random.Random(1)
    secs = sorted(rnd.randint(0, 4000) for _ in range(300))
    df = spark.createDataFrame([("a", s) for s in secs], "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["second"]: r["in_window"] for r in W.counts_in_window(df, "k", "ts", 900, block=1000).collect()}
    assert got == {s: sum(1 for x in secs if s - 900 <= x <= s) for s in set(secs)}


def test_copies_cost_one_row(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.lit(0x5555555555555555)).otherwise(F.col("id") * 99991).alias("h"))
    h = D.distinct_hashes(df, "id", "h")
    assert h.filter(F.col("h") == 0x5555555555555555).collect()[0]["copies"] == 666
    first = D.first_duplicates(df, h, "id", "h")
    assert first.filter("matching_id = 1 AND distance = 0").count() == 665


def test_phrases_equal_brute_force(spark):
    """Short, long, null, empty and repeated phrases; null, empty, repeated and very long texts; letters beyond the first plane."""
    rnd = random.Random(8)
    words = ["ab", "abc", "invoice", "number", "Total", "due", "\U0001F600x", "\u00e9t\u00e9", "\n"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [make(rnd.randint(0, 12)) for _ in range(80)] + [None, "", make(40_000)] + ["invoice number Total due"] * 40
    phrases = [make(rnd.randint(1, 5)) for _ in range(150)] + ["a", "ab", "\U0001F600", "INVOICE NUMBER", "nowhere to be found", "", None, "a", "%", "_"]
    docs = spark.createDataFrame([(i % 60 if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    table = spark.createDataFrame([(p, i) for i, p in enumerate(phrases)], "phrase string, kind int")
    got = sorted((r["n"], r["kind"]) for r in P.phrase_matches(docs, table).collect())
    want = sorted((i, k) for i, t in enumerate(texts) for k, p in enumerate(phrases) if t is not None and p and p.lower() in t.lower())
    assert got == want
    assert P.phrase_matches(docs.limit(0), table).count() == 0 and P.phrase_matches(docs, table.limit(0)).count() == 0


def test_phrases_meet_by_key(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    table = spark.range(1000).select(F.concat(F.lit("some phrase "), F.col("id")).alias("phrase"))
    plan = P.phrase_matches(docs, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grams_of_texts_are_their_bytes(spark):
    """Every piece of 8 bytes and of a smaller size, none over the end of a text; the texts are not cut into a row for each q-gram."""
    import numpy as np
    import pyarrow as pa

    texts = ["invoice number", "", None, "a\U0001F600b", "short", "é" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped", *texts])], names=["low"]).slice(1)
    got = sorted((int(r), int(g)) for _, row, gram in P.text_grams(iter([batch]), [3]) for r, g in zip(row, gram))
    raw = [(t or "").encode() for t in texts]
    want = [(r, int.from_bytes(b[i : i + 8], "little")) for r, b in enumerate(raw) for i in range(len(b) - 7)]
    want += [(r, int.from_bytes(b[i : i + 3], "little") | 3 << 56) for r, b in enumerate(raw) for i in range(len(b) - 2)]
    assert got == sorted(want)
    bits = np.unpackbits(P.taken_cells(spark.createDataFrame([(0,), (65_535,), (65_536,), (P.CELLS - 1,)], "cell long")), bitorder="little")
    assert np.flatnonzero(bits).tolist() == [0, 65_535, 65_536, P.CELLS - 1]


def test_long_items_give_their_phrases_in_linear_time(spark, tmp_path):
    """An item of 20,000 words: its words were found once for each three of them."""
    import time

    from scanmill.plans import relational as R

    words = [f"w{i}" for i in range(20_000)]
    spark.createDataFrame([(1, " ".join(words)), (2, "one two"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "Xw5 w6 w7x", "en", "s", 10), (2, None, "en", "s", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    assert [tuple(r) for r in R.phrase_match_join(spark, str(tmp_path)).collect()] == [(1, "en", 1, "w5 w6 w7")]
    assert time.monotonic() - start < 60


def test_a_batch_writes_its_days_only(spark, tmp_path):
    path = f"{tmp_path}/fact"
    rows = lambda days: spark.createDataFrame([(k, datetime.date(2024, 1, n) if n else None, 1) for n in days for k in range(5)], "k long, date date, n long")
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*.parquet")}
    a, b = rows([1, 2, 3, 0]), rows([3, 4])
    Da.add_batch(a, path, "a")
    before = files()
    Da.add_batch(b, path, "b")
    assert before.items() <= files().items()
    read = lambda: sorted((r["date"] or datetime.date(1, 1, 1), r["k"], r["n"]) for r in Da.read_batches(spark, path, b.schema).groupBy("date", "k").agg(F.sum("n").alias("n")).collect())
    once = read()
    Da.add_batch(b, path, "b")
    assert read() == once and len(once) == 25 and {x[2] for x in once if x[0].day == 3} == {2}
    changed = {f for f, at in files().items() if before.get(f) != at}
    assert len(changed) == 2 and all("batch=b" in f for f in changed)
    kept = {f: at for f, at in files().items() if "date=2024-01-0" not in f or f.split("date=2024-01-0")[1][0] >= "3"}
    assert Da.drop_days_before(spark, path, datetime.date(2024, 1, 3)) == [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)]
    assert files() == kept and len(read()) == 15


def test_sketches_merge_over_days(spark):
    df = spark.range(60_000).select(
        F.timestamp_seconds(F.col("id") % 6 * 86400).alias("ts"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"),
        F.when(F.col("id") % 10 > 0, F.col("id") * 7919 % 60_000).alias("v"), (F.col("id") % 5000).alias("u"),
    )
    days = Sk.daily_sketches(df.union(spark.createDataFrame([(datetime.datetime(1970, 1, 2), None, None, None)], "ts timestamp, g string, v long, u long")), "ts", ["g"], "v", "u")
    got = {r["g"]: r for r in Sk.over_days(days, ["g"], datetime.date(1970, 1, 2), datetime.date(1970, 1, 4), {"half": 0.5, "most": 0.9}).collect()}
    assert got[None]["rows"] == 1 and got[None]["half"] is None and got[None]["members"] == 0
    kept = df.where(F.to_date("ts").between("1970-01-02", "1970-01-04"))
    for g in ("hot", "cold"):
        vs = sorted(r["v"] for r in kept.where((F.col("g") == g) & F.col("v").isNotNull()).collect())
        for name, rank in (("half", 0.5), ("most", 0.9)):
            assert abs(sum(v <= got[g][name] for v in vs) / len(vs) - rank) < 0.015
        exact = kept.where(F.col("g") == g).agg(F.countDistinct("u")).first()[0]
        assert abs(got[g]["members"] - exact) <= 3 * 0.0081 * exact + 1
    assert not Sk.over_days(days, ["g"], datetime.date(1980, 1, 2), datetime.date(1980, 1, 4), {"half": 0.5}).collect()
