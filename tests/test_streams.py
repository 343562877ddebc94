"""Streams fed in several ordered files give the result of the table."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from scanmill.operators import aggregates as A
from scanmill.sources import tables as T
from scanmill.streaming import alerts as AL
from scanmill.streaming import duplicates as SD
from scanmill.streaming import stateful as St
from scanmill.streaming.dropped import counting_dropped, dropped_rows
from scanmill.streaming.runner import rocksdb, run_append, run_update, stream_table


@pytest.fixture(scope="module")
def split_dir(spark, sf, tmp_path_factory):
    """Events of the smallest tables in three files by time."""
    out = str(tmp_path_factory.mktemp("events"))
    e = T.table(spark, sf, "events")
    for i, (a, b) in enumerate([(1, 10), (11, 20), (21, 31)]):
        part = e.filter(F.dayofmonth("ts").between(a, b)).coalesce(1)
        part.write.parquet(f"{out}/part{i}")
        src = next(f for f in os.listdir(f"{out}/part{i}") if f.endswith(".parquet"))
        os.rename(f"{out}/part{i}/{src}", f"{out}/events{i}.parquet")
        os.utime(f"{out}/events{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return out


def files(spark, d):
    e = spark.readStream.schema(T.SCHEMAS["events"]).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.withWatermark("ts", "10 minutes")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_type_stats_over_batches(spark, sf, split_dir):
    s = files(spark, split_dir).select(
        F.col("event_type").alias("document_type"), F.col("ts").cast("timestamp_ntz").alias("created_at"), F.col("value").alias("processing_time"), (F.col("k") / 100).alias("confidence_score"),
        (((F.col("k") * 37) % 101) / 100).alias("quality_score"), F.when(F.col("k") < 20, "e").alias("error_message"),
    )
    assert same(run_update(A.type_rollup(s), ["document_type"]), A.type_rollup(T.scan_history(spark, sf)))


def test_rate_limiter_keeps_state_over_batches(spark, sf, split_dir):
    got = run_append(St.rate_limiter(files(spark, split_dir), "event_type", "ts", limit=3, window=86400))
    # Plain replay of the rule.
    admitted, want = {}, {}
    last = T.table(spark, sf, "events").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0] - 600_000
    for r in T.table(spark, sf, "events").orderBy("ts").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).collect():
        kept = [x for x in admitted.get(r["event_type"], []) if x > r["s"] - 86400]
        ok = len(kept) < 3
        admitted[r["event_type"]] = kept + ([r["s"]] if ok else [])
        a, b = want.get((r["event_type"], r["s"]), (0, 0))
        want[(r["event_type"], r["s"])] = (a + ok, b + (not ok))
    want = {k: v for k, v in want.items() if (k[1] + 1) * 1000 <= last}
    assert {(r["key"], r["second"]): (r["admitted"], r["denied"]) for r in got.collect()} == want


def test_quality_history_over_batches(spark, sf, split_dir):
    s = files(spark, split_dir).withColumn("q", F.col("k") / 100)
    got = {r["key"]: (r["kept"], r["hundredths"]) for r in run_update(St.quality_history(s, "event_type", "q", "event_id", "ts", keep=20), ["key"]).collect()}
    want = {}
    for r in T.scan_history(spark, sf).orderBy("id").collect():
        want.setdefault(r["document_type"], []).append(r["k"])
    assert got == {k: (len(v[-20:]), sum(v[-20:])) for k, v in want.items()}


def test_stream_duplicates_over_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, 0b1111), (2, 1 << 40)], [(3, 0b0111), (4, -1)], [(5, -2), (6, (1 << 40) | 3)]]):
        spark.createDataFrame(rows, "id bigint, h bigint").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        src = next(f for f in os.listdir(f"{tmp_path}/in{i}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/all", exist_ok=True)
        os.rename(f"{tmp_path}/in{i}/{src}", f"{tmp_path}/all/f{i}.parquet")
        os.utime(f"{tmp_path}/all/f{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    s = spark.readStream.schema("id bigint, h bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    got = SD.run_stream_duplicates(s, f"{tmp_path}/state")
    assert sorted((r["id"], r["matching_id"], r["distance"]) for r in got.collect()) == [(2, 1, 5), (3, 1, 1), (5, 4, 1), (6, 1, 3)]


def test_late_rows_are_dropped(spark, tmp_path):
    """A row older than the watermark adds nothing; the same row in time is counted."""
    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    ordered = [(at(5),), (at(10),), (at(20),), (at(28),)]
    late = [(at(10),), (at(20),), (at(5),), (at(28),)]
    counts = []
    for k, rows in enumerate((ordered, late)):
        s = in_files(spark, rows, "ts timestamp", 4, f"{tmp_path}/l{k}").withWatermark("ts", "10 minutes")
        n = run_append(s.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.dayofmonth("window.start").alias("d"), "n"))
        counts.append({r["d"]: r["n"] for r in n.collect()})
    assert counts == [{5: 1, 10: 1, 20: 1}, {10: 1, 20: 1}]


def in_files(spark, rows, schema, n, path):
    """Rows in n ordered files, read one per micro-batch."""
    size = -(-len(rows) // n)
    os.makedirs(path)
    for i in range(n):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in{i}")
        src = next(f for f in os.listdir(f"{path}/in{i}") if f.endswith(".parquet"))
        os.makedirs(f"{path}/all", exist_ok=True)
        os.rename(f"{path}/in{i}/{src}", f"{path}/all/f{i:02}.parquet")
        os.utime(f"{path}/all/f{i:02}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/all")


def test_results_do_not_depend_on_the_cut_into_files(spark, sf, tmp_path):
    events = [tuple(r) for r in T.scan_history(spark, sf).orderBy("created_at", "id").select(F.col("created_at").alias("ts"), "user_id", "document_type").collect()]
    hashes = [(i, (i * i * 2654435761) % 4096) for i in range(120)]
    kept, matched = [], []
    for n in (1, 3, 10):
        s = in_files(spark, events, "ts timestamp, user_id bigint, document_type string", n, f"{tmp_path}/e{n}").withWatermark("ts", "300 seconds")
        kept.append(sorted(tuple(r) for r in run_append(St.idempotent(s, ["user_id", "document_type"], life=86400)).collect()))
        h = in_files(spark, hashes, "id bigint, h bigint", n, f"{tmp_path}/h{n}")
        matched.append(sorted(tuple(r) for r in SD.run_stream_duplicates(h, f"{tmp_path}/s{n}").collect()))
    assert kept[0] == kept[1] == kept[2] and 0 < len(kept[0]) < len(events)
    assert matched[0] == matched[1] == matched[2] and matched[0]


def state(spark, folder, name):
    return spark.read.format("statestore").option("path", f"{folder}/_state").option("stateVarName", name).load()


def clock(spark, rows, n, path, delay="60 seconds"):
    """(key, ts[, failed]) rows by seconds since an hour, in files of one batch each."""
    start = datetime.datetime(2024, 1, 1)
    made = [(k, start + datetime.timedelta(seconds=s), *rest) for k, s, *rest in rows]
    return in_files(spark, made, "key string, ts timestamp" + (", failed boolean" if len(rows[0]) > 2 else ""), n, path).withWatermark("ts", delay)


BASE = 1704067200


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small streams: a state store and a worker for each partition of each batch cost more than the rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lives_of_many_keys_take_few_calls(spark, tmp_path):
    """Keys share the state rows of their buckets; null and empty keys, large ids and gaps of exactly one life, in files."""
    rnd = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    keys = [(None, "a"), (None, None), (2**60 + 1, ""), (2**60 + 2, None), *((u, "b") for u in range(300))]
    rows = sorted(((start + datetime.timedelta(seconds=rnd.randrange(0, 1500, 100)), *k) for k in keys for _ in range(4)), key=lambda r: r[0])
    want, last = [], {}
    for ts, *k in rows:
        at = round((ts - start).total_seconds())
        if tuple(k) not in last or at >= last[tuple(k)] + 300:
            last[tuple(k)] = at
            want.append((*k, (BASE + at) * 1_000_000))
    for n in (1, 3):
        s = in_files(spark, rows, "ts timestamp, user_id bigint, document_type string", n, f"{tmp_path}/f{n}").withWatermark("ts", "300 seconds")
        got = run_append(St.idempotent(s, ["user_id", "document_type"], life=300, buckets=4), f"{tmp_path}/o{n}")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        assert 0 < spark.read.format("statestore").load(f"{tmp_path}/o{n}/_state").count() <= 4


def test_limiter_decides_by_event_time_whatever_the_files(spark, tmp_path):
    """A second in two files is one row, a late second is decided before those after it."""
    rows = [("a", 10), ("a", 10), ("b", 5), ("a", 10), ("a", 40), ("a", 20), ("b", 30), ("a", 21), ("b", 400), ("a", 500), ("c", 9000), ("c", 9001)]
    want = [("a", 10, 3, 0), ("a", 20, 1, 0), ("a", 21, 0, 1), ("a", 40, 0, 1), ("a", 500, 1, 0), ("b", 5, 1, 0), ("b", 30, 1, 0), ("b", 400, 1, 0)]
    for n in (1, 4):
        s = clock(spark, rows, n, f"{tmp_path}/l{n}")
        got = run_append(St.rate_limiter(s, "key", "ts", limit=4, window=100)).collect()
        assert sorted((r["key"], r["second"] - BASE, r["admitted"], r["denied"]) for r in got) == want


def test_state_of_idle_keys_ends(spark, tmp_path):
    rows = [(k, s, f) for s in range(3) for k, f in (("a", True), ("b", False), ("c", True))] + [("c", 9500, True), ("d", 10_000, False), ("d", 10_001, False)]
    made = {
        "kept": [
            (St.rate_limiter(clock(spark, rows, 4, f"{tmp_path}/r"), "key", "ts", 2, 900), {"c"}),
            (St.lockouts(clock(spark, rows, 4, f"{tmp_path}/l"), "key", "ts", F.col("failed"), 2, 900), {"c"}),
            (St.breaker_transitions(clock(spark, rows, 4, f"{tmp_path}/b"), "key", "ts", "failed", forget=900), {"c"}),
        ],
        "waiting": [(St.rate_limiter(clock(spark, rows, 4, f"{tmp_path}/w"), "key", "ts", 2, 900), {"d"})],
        "values": [(St.quality_history(clock(spark, rows, 4, f"{tmp_path}/h").withColumn("v", F.lit(0.5)).withColumn("o", F.lit(1)), "key", "v", "o", "ts", life=900), {"c", "d"})],
    }
    for name, streams in made.items():
        for i, (stream, alive) in enumerate(streams):
            folder = f"{tmp_path}/{name}{i}"
            run_update(stream, ["key"], folder) if name == "values" else run_append(stream, folder)
            assert {r["key"]["key"] for r in state(spark, folder, name).select("key").collect()} == alive, (name, i)


def test_lock_and_breaker_by_event_time(spark, tmp_path):
    rows = [("a", 100, True), ("a", 101, True), ("a", 400, False), ("a", 50, True), ("a", 51, False), ("a", 1300, True), ("a", 1301, True), ("z", 9000, False), ("z", 9001, False)]
    for n in (1, 3):
        lock = run_append(St.lockouts(clock(spark, rows, n, f"{tmp_path}/k{n}", "400 seconds"), "key", "ts", F.col("failed"), 2, 900)).collect()
        assert sorted((r["key"], r["locked_at"] - BASE, r["locked_until"] - BASE, r["failures"]) for r in lock) == [("a", 100, 1000, 2), ("a", 1301, 2201, 2)]
        turn = run_append(St.breaker_transitions(clock(spark, rows, n, f"{tmp_path}/t{n}", "400 seconds"), "key", "ts", "failed", threshold=2)).collect()
        assert sorted((r["second"] - BASE, r["state"]) for r in turn) == [(101, "open"), (161, "half_open"), (400, "closed"), (1301, "open")]


def test_dropped_rows_are_counted(spark, tmp_path):
    """The one late row of the stream is in the table of dropped rows, with its query and batch."""
    at = lambda day: (datetime.datetime(2024, 1, day),)
    for k, (rows, late) in enumerate([([at(10), at(20), at(5), at(28)], 1), ([at(5), at(10), at(20), at(28)], 0)]):
        s = in_files(spark, rows, "ts timestamp", 4, f"{tmp_path}/d{k}").withWatermark("ts", "10 minutes")
        table = f"{tmp_path}/dropped{k}"
        with counting_dropped(spark, table):
            run_append(s.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.dayofmonth("window.start").alias("d"), "n"))
        assert os.path.exists(table) == bool(late)
        if late:
            assert [(r["batch_id"], r["dropped"]) for r in dropped_rows(spark, table).collect()] == [(2, 1)]


def test_every_kind_of_alert(spark):
    """Each kind of rule against values worked out by hand; a counter that restarts counts from zero."""
    T_ = AL.Term
    rules = [
        AL.rule("rate", T_("errors", "rate", 2), ">", 0.1, 1, "w"), AL.rule("rise", T_("errors", "increase", 3), ">", 20.0, 0, "w"),
        AL.rule("ratio", T_("errors", "rate", 1), ">", 0.5, 0, "c", T_("requests", "rate", 1)), AL.rule("low", T_("avail"), "<", 0.2, 1, "w", T_("size")),
        AL.rule("pool", T_("avail"), ">=", 0.0, 0, "w", T_("floor"), "-"), AL.rule("down", T_("up"), "=", 0.0, 1, "c"),
        AL.rule("busy", T_("idle", "rate", 1), ">", 80.0, 0, "w", scale=-100.0, offset=100.0), AL.rule("slow", T_("b", "quantile", 1, 0.5), ">", 1.0, 0, "w"),
    ]
    series = {
        "errors": [0, 10, 20, 3, 4], "requests": [0, 100, 115, 5, 100], "avail": [50, 10, 15, 30, 5], "size": [100] * 5, "floor": [60, 10, 20, 30, 9],
        "up": [1, 0, 0, 1, 0], "idle": [0, 60, 61, 62, 122],
    }
    rows = [(s, "i", None, m, float(v)) for s, vs in series.items() for m, v in enumerate(vs)]
    rows += [("b", "i", le, m, float(v)) for le, vs in ((1.0, [0, 4, 4]), (2.0, [0, 8, 12]), (None, [0, 8, 13])) for m, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series string, instance string, le double, minute bigint, value double").repartition(3)
    got = {}
    for r in AL.evaluate(df, rules).collect():
        got.setdefault(r["alert"], []).append((r["pending_from"], r["firing_from"], r["until"], round(r["peak"], 4)))
    # errors rise by 0, 10, 10, 3 (restart), 1; requests by 0, 100, 15, 5 (restart), 95
    assert {k: sorted(v) for k, v in got.items()} == {
        "rate": [(2, 3, 3, 0.1667)],
        "rise": [(3, 3, 3, 23.0)],
        "ratio": [(2, 2, 3, 0.6667)],
        "low": [(1, 2, 2, 0.1)],
        "pool": [(1, 1, 1, 0.0), (3, 3, 3, 0.0)],
        "down": [(1, 2, 2, 0.0)],
        "busy": [(0, 0, 0, 100.0), (2, 2, 3, 98.3333)],
        "slow": [(2, 2, 2, 1.625)],
    }


def test_all_alert_rules_compile(spark):
    df = spark.createDataFrame([('up{job="redis"}', "i", None, m, 0.0) for m in range(3)], "series string, instance string, le double, minute bigint, value double")
    assert [r["alert"] for r in AL.evaluate(df).collect()] == ["RedisDown"]
    assert len(AL.RULES) == 24


def test_limit_texts_and_grouped_limits(spark, split_dir, sf):
    from scanmill.streaming import limits as SL

    assert SL.parse_limits("2 per second; 20 per minute, 100 per hour") == [(1, 2), (60, 20), (3600, 100)]
    with pytest.raises(ValueError):
        SL.parse_limits("many per hour")
    limits = SL.limits_table(spark, {"info": "1 per hour, 2 per day"})
    streamed = SL.grouped_limits(files(spark, split_dir), limits, "ts", "user_id", "event_type")
    table = SL.grouped_limits(T.table(spark, sf, "events").withColumn("event_type", F.lit("info")), limits, "ts", "user_id", "event_type")
    assert table.groupBy("seconds").agg(F.sum("n")).collect()[0][1] == T.table(spark, sf, "events").count()
    kinds = T.table(spark, sf, "events").select("event_type").distinct().limit(1).first()[0]
    limits = SL.limits_table(spark, {kinds: "1 per hour, 2 per day"})
    streamed = SL.grouped_limits(files(spark, split_dir), limits, "ts", "user_id", "event_type")
    keys = ["limit_group", "user_id", "seconds", "window_start"]
    assert same(run_update(streamed, keys), SL.grouped_limits(T.table(spark, sf, "events"), limits, "ts", "user_id", "event_type"))


def test_sessions_by_slice_with_a_hot_key(spark):
    """Random times with a hot key over several slices, gaps of exactly the limit, repeats and nulls, against a plain loop."""
    import random

    from scanmill.streaming import windows as SW

    rnd, base = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(rnd.choice([0, 0, rnd.randrange(5)]), base + datetime.timedelta(minutes=10 * rnd.randrange(3000))) for _ in range(1200)]
    rows += rows[:50] + [(7, None), (None, base)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    got = SW.sessions_by_slice(df, "k", "ts", "30 minutes", slice_seconds=7200)
    assert same(got, SW.session_usage(df.withColumn("ts", F.col("ts").cast("timestamp")), "k", "ts", "30 minutes"))
    want, last = [], {}
    for k, t in sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        s = last.get(k)
        if s and t - s[2] <= datetime.timedelta(minutes=30):
            s[2], s[3] = t, s[3] + 1
        else:
            last[k] = s = [k, t, t, 1]
            want.append(s)
    assert sorted((str(r.k), r.start_time, r.end_time, r.documents) for r in got.collect()) == sorted((str(k), a, b, n) for k, a, b, n in want)
    assert SW.sessions_by_slice(spark.createDataFrame([], "k int, ts timestamp_ntz"), "k", "ts").count() == 0


def test_frames_below_the_least_quality_are_left_out(spark):
    from scanmill.streaming.frames import extract_frames

    rows = [(1, 0.9, "Government of India Aadhaar 1234 5678 9012"), (2, 0.5, "Aadhaar 1234 5678 9012"), (3, None, "Aadhaar"), (4, 0.6, None)]
    out = {r.doc_id: r for r in extract_frames(spark.createDataFrame(rows, "doc_id int, q double, text string"), F.col("q")).collect()}
    assert set(out) == {1, 4} and out[1].pack == "aadhaar" and out[4].pack is None


@pytest.mark.parametrize("layout", ["one file", "part files", "named files"])
def test_a_table_streams_from_any_layout(spark, tmp_path, layout):
    """One file, a folder of part files whose names say nothing, or files of the table's name beside each other."""
    spark.range(10).select("id", F.lit("x").alias("x")).coalesce(1).write.parquet(f"{tmp_path}/other.parquet")
    rows = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(20)], T.SCHEMAS["documents"])
    d = f"{tmp_path}/documents.parquet"
    rows.repartition(1 if layout == "one file" else 3).write.parquet(d if layout == "part files" else f"{tmp_path}/made")
    if layout != "part files":
        for i, f in enumerate(sorted(f for f in os.listdir(f"{tmp_path}/made") if f.endswith(".parquet"))):
            os.rename(f"{tmp_path}/made/{f}", d if layout == "one file" else f"{tmp_path}/documents{i}.parquet")
    got = run_append(stream_table(spark, str(tmp_path), "documents"))
    assert same(got, rows)


def test_large_state_is_kept_on_disk(spark, split_dir):
    """The default store holds every key in memory; it is set back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    counts, before = files(spark, split_dir).groupBy("user_id").count(), spark.conf.get(key)
    with rocksdb(counts, large=True):
        assert spark.conf.get(key).endswith("RocksDBStateStoreProvider")
    assert spark.conf.get(key) == before
    assert sum(r["count"] for r in run_update(counts, ["user_id"], large=True).collect()) == T.table(spark, "/root/testdata/sf0.001", "events").count()


def test_fields_of_a_stream_are_found_once(spark, sf, monkeypatch):
    """No filter holds the search for fields again, and the least quality is tested on keys, before frames are dealt or rendered."""
    from scanmill.plans import streams

    monkeypatch.setattr(streams, "run_append", lambda df: df)
    monkeypatch.setattr(streams, "stream_table", T.table)
    plan = streams.stream_frame_fields(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    filters = [i for i, x in enumerate(plan) if x.lstrip(" :|+-").startswith("Filter")]
    assert not any("regexp_extract" in plan[i] for i in filters)
    dealt = [i for i, x in enumerate(plan) if x.lstrip(" :|+-").startswith("Repartition")]
    assert len(dealt) == 2 and all(any("% 101" in plan[i] for i in filters if a < i < b) for a, b in zip(dealt, [*dealt[1:], len(plan)]))
