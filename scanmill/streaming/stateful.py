"""Operators that need state beyond a window: rate limiter, lockout, breaker, value cache, quality history.

Decisions of these operators depend on earlier decisions for the same key, so they follow event time and not arrival. Rows
are combined per (key, second) inside every input task, so a hot key sends seconds, not events. A second waits in list state
until the watermark has passed it; then an event-time timer decides it, once, however many files or batches it was spread
over. What a key remembers is a value of bounded size with a time after which it means nothing; a timer at that time
removes it, so idle keys hold no state. The input needs a watermark; rows later than that are dropped and counted by Spark.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout


def combine_seconds(df: DataFrame, key: str, ts: str, **counts: Column) -> DataFrame:
    """(key, ts, second, counts...) summed inside each task before the shuffle; ts is the second's latest and keeps the watermark."""
    second = F.unix_seconds(F.col(ts).cast("timestamp")).alias("second")
    narrow = df.select(F.col(key).cast("string").alias("key"), ts, second, *(c.cast("bigint").alias(n) for n, c in counts.items()))
    how, names = {ts: "max", **dict.fromkeys(counts, "sum")}, narrow.columns

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.groupby(["key", "second"], as_index=False).agg(how)[names]

    return narrow.mapInPandas(combine, narrow.schema)


class BySecond(StatefulProcessor):
    """Decides the seconds of a key in event time, each when the watermark has passed it.

    Subclasses give `memory` (the schema of what a key remembers), `start`, `columns` of the output, and the two rules:
    `decide` takes what is remembered and a second's counts, `ends` says from which second on the memory is as good as none.
    """

    memory: str
    start: tuple
    columns: Sequence[str]

    def __init__(self, counts: Sequence[str]) -> None:
        self.counts = list(counts)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} bigint" for c in ("second", *self.counts)))
        self.kept = handle.getValueState("kept", self.memory)

    def decide(self, memory: tuple, second: int, *counts: int) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def ends(self, memory: tuple) -> int:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seconds = pd.concat([b.groupby("second")[self.counts].sum() for b in rows]).groupby(level=0).sum()
        self.waiting.appendList([tuple(int(x) for x in r) for r in seconds.itertuples()])
        self.handle.registerTimer((int(seconds.index.min()) + 1) * 1000)
        yield pd.DataFrame([], columns=["key", *self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        seconds: dict[int, list[int]] = {}
        for second, *counts in self.waiting.get():
            seconds[second] = [a + b for a, b in zip(seconds.get(second, [0] * len(counts)), counts, strict=True)]
        memory = tuple(self.kept.get()) if self.kept.exists() else self.start
        final = sorted(s for s in seconds if (s + 1) * 1000 <= now)
        rows = []
        for s in final:
            memory, out = self.decide(memory, s, *seconds.pop(s))
            rows += out
        if final:
            self.waiting.clear()
            if seconds:
                self.waiting.put([(s, *c) for s, c in sorted(seconds.items())])
        end = self.ends(memory) * 1000
        if end <= now:
            self.kept.clear()
        else:
            if final:
                self.kept.update(memory)
            self.handle.registerTimer(end)
        if seconds:
            self.handle.registerTimer((min(seconds) + 1) * 1000)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["key", *self.columns])

    def close(self) -> None:
        pass


def by_second(combined: DataFrame, processor: BySecond, schema: str) -> DataFrame:
    return combined.groupBy("key").transformWithStateInPandas(processor, f"key string, {schema}", "Append", "EventTime")


class _Limiter(BySecond):
    memory, start, columns = "s array<bigint>, c array<bigint>", ([], []), ("second", "admitted", "denied")

    def __init__(self, limit: int, window: int) -> None:
        super().__init__(["n"])
        self.limit, self.window = limit, window

    def decide(self, memory, second, n):
        admitted = [(s, c) for s, c in zip(*memory, strict=True) if s > second - self.window]
        take = min(n, max(0, self.limit - sum(c for _, c in admitted)))
        if take:  # at most `limit` entries: there is one only where something was admitted
            admitted.append((second, take))
        return ([s for s, _ in admitted], [c for _, c in admitted]), [(second, take, n - take)]

    def ends(self, memory):
        return max(memory[0], default=-self.window) + self.window


def rate_limiter(df: DataFrame, key: str, ts: str, limit: int, window: int) -> DataFrame:
    """Admitted and denied requests per key and second; denied requests do not count against the window."""
    return by_second(combine_seconds(df, key, ts, n=F.lit(1)), _Limiter(limit, window), "second bigint, admitted bigint, denied bigint")


class _Lockout(BySecond):
    memory, start, columns = "s array<bigint>, c array<bigint>, u bigint", ([], [], -1), ("locked_at", "locked_until", "failures")

    def __init__(self, limit: int, window: int) -> None:
        super().__init__(["n"])
        self.limit, self.window = limit, window

    def decide(self, memory, second, n):
        recent = [(s, c) for s, c in zip(*memory[:2], strict=True) if s > second - self.window] + ([(second, n)] if n else [])
        until, rows, total = memory[2], [], sum(c for _, c in recent)
        if n and total >= self.limit and second >= until:
            until = second + self.window
            rows.append((second, until, total))
        return ([s for s, _ in recent], [c for _, c in recent], until), rows

    def ends(self, memory):
        return max([memory[2], *(s + self.window for s in memory[0])])


def lockouts(attempts: DataFrame, key: str, ts: str, failed: Column, limit: int = 5, window: int = 900) -> DataFrame:
    """Seconds at which a key with ``limit`` failures in the window becomes locked; a lock lasts one window.

    All attempts move the watermark, so a lock is known without waiting for further failures; a filter in front would not.
    """
    return by_second(combine_seconds(attempts, key, ts, n=F.when(failed, 1).otherwise(0)), _Lockout(limit, window), "locked_at bigint, locked_until bigint, failures bigint")


class _Breaker(BySecond):
    memory, start, columns = "mode string, count bigint, last bigint, seen bigint", ("closed", 0, -1, -1), ("second", "state")

    def __init__(self, threshold: int, recovery: int, forget: int) -> None:
        super().__init__(["bad", "good"])
        self.threshold, self.recovery, self.forget = threshold, recovery, forget

    def decide(self, memory, second, bad, good):
        mode, count, last, _ = memory
        rows = []
        if mode == "open" and second - last >= self.recovery:
            mode = "half_open"
            rows.append((last + self.recovery, mode))
        if bad:
            count, last = count + bad, second
            if count >= self.threshold and mode != "open":
                mode = "open"
                rows.append((second, mode))
        if good:
            count = 0
            if mode != "closed":
                mode = "closed"
                rows.append((second, mode))
        return (mode, count, last, second), rows

    def ends(self, memory):
        mode, count, _, seen = memory
        return -1 if mode == "closed" and not count else seen + self.forget


def breaker_transitions(df: DataFrame, key: str, ts: str, failed: str, threshold: int = 5, recovery: int = 60, forget: int = 7 * 86400) -> DataFrame:
    """State changes of a circuit breaker per service, at second granularity.

    Within one second failures count first, then a success resets. Open at the threshold, half-open once the recovery time
    has passed since the last failure, closed by a success. A service without calls for ``forget`` seconds starts afresh;
    a closed one without failures has no state at all.
    """
    combined = combine_seconds(df, key, ts, bad=F.expr(f"int({failed})"), good=F.expr(f"int(NOT ({failed}))"))
    return by_second(combined, _Breaker(threshold, recovery, forget), "second bigint, state string")


def ttl_latest(df: DataFrame, key: str, value: str, ts: str, ttl: int) -> DataFrame:
    """Latest value of each key with its expiry; a key is forgotten when event time passes the expiry.

    The input needs a watermark. Each task keeps only its newest row per key before the shuffle.
    """
    narrow = df.select(F.col(key).cast("string").alias("key"), ts, F.unix_micros(ts).alias("at"), F.col(value).cast("double").alias("value"))

    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values(["at", "value"]).groupby("key", as_index=False).tail(1)

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        at, val = state.get if state.exists else (-1, 0.0)
        for b in batches:
            i = b.sort_values(["at", "value"]).iloc[-1]
            if (int(i["at"]), float(i["value"])) > (at, val):
                at, val = int(i["at"]), float(i["value"])
        state.update((at, val))
        state.setTimeoutTimestamp(max(at // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], val, at, at + ttl * 1_000_000)], columns=["key", "value", "at", "expires_at"])

    return (
        narrow.mapInPandas(newest, narrow.schema)
        .groupBy("key")
        .applyInPandasWithState(
            step, "key string, value double, at bigint, expires_at bigint", "at bigint, value double", "update", GroupStateTimeout.EventTimeTimeout
        )
    )


class _History(StatefulProcessor):
    """The last values of a key in the order of the events, whenever they arrive; forgotten when the key has been idle for ``life``."""

    def __init__(self, keep: int, life: int) -> None:
        self.keep, self.life = keep, life

    def init(self, handle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "ord bigint, value double")
        self.seen = handle.getValueState("seen", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = pd.DataFrame(list(self.values.get()), columns=["ord", "value"])
        new = pd.concat(list(rows))
        kept = (pd.concat([old, new[["ord", "value"]]]) if len(old) else new).sort_values(["ord", "value"]).tail(self.keep)
        self.values.put([(int(o), float(v)) for o, v in zip(kept["ord"], kept["value"], strict=True)])
        seen = max(self.seen.get()[0] if self.seen.exists() else 0, int(new["ms"].max()))
        self.seen.update((seen,))
        self.handle.registerTimer(seen + self.life * 1000)
        yield pd.DataFrame([(key[0], len(kept), int(round(float(kept["value"].sum()) * 100)))], columns=["key", "kept", "hundredths"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and self.seen.get()[0] + self.life * 1000 <= timerValues.getCurrentWatermarkInMs():
            self.values.clear()
            self.seen.clear()
        yield pd.DataFrame([], columns=["key", "kept", "hundredths"])

    def close(self) -> None:
        pass


def quality_history(df: DataFrame, key: str, value: str, order: str, ts: str, keep: int = 100, life: int = 31 * 86400) -> DataFrame:
    """Mean and number of the last ``keep`` values of a key by ``order``, after each micro-batch.

    Each task passes on only its last ``keep`` values per key: no older one can be among the key's. The input needs a
    watermark; a key's history ends ``life`` seconds after its last event.
    """
    narrow = df.select(
        F.col(key).cast("string").alias("key"), ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(order).cast("bigint").alias("ord"), F.col(value).cast("double").alias("value")
    )

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values(["ord", "value"]).groupby("key", as_index=False).tail(keep)

    grouped = narrow.mapInPandas(tail, narrow.schema).groupBy("key")
    return grouped.transformWithStateInPandas(_History(keep, life), "key string, kept bigint, hundredths bigint", "Update", "EventTime")


def lives(code: np.ndarray, at: np.ndarray, life: int) -> np.ndarray:
    """Which events start a life: `life` after the last that did. Events are in order of key and time.

    An event that is `life` behind the one before it starts one in any case; only the others are decided one by one.
    """
    kept = np.ones(len(at), bool)
    kept[1:] = (code[1:] != code[:-1]) | (at[1:] - at[:-1] >= life)
    last, before = 0, -2
    for i in np.flatnonzero(~kept).tolist():
        if before != i - 1:
            last = int(at[i - 1])
        before, x = i, int(at[i])
        if x - last >= life:
            kept[i], last = True, x
    return kept


def idempotent(df: DataFrame, keys: list[str], ts: str = "ts", life: int = 300, buckets: int = 512) -> DataFrame:
    """Events that start a new life of their key: at least ``life`` seconds after the last one kept.

    A repeat does not renew the life. Events of a key are taken in event time, so the cut into micro-batches of an ordered
    input does not matter; state ends when the watermark of the input passes the life.

    A call of Python costs as much as thousands of events, so keys are called in buckets of their hash: the calls are bounded
    by ``buckets`` a batch, however many keys there are. A bucket's state holds the last event of each of its keys that lives. Keys pass through
    Python as text, so they are of types whose text gives the value back; null is a key.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    names = [f"k{i}" for i in range(len(keys))]
    narrow = df.select(bucket, *(F.col(c).cast("string").alias(n) for c, n in zip(keys, names, strict=True)), ts, F.unix_micros(ts).alias("at"))
    span = life * 1_000_000

    def step(_, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = [pd.DataFrame(pickle.loads(state.get[0]))] if state.exists else []
        n_held = len(held[0]) if held else 0
        rows = pd.concat([*held, *(b[[*names, "at"]] for b in batches)], ignore_index=True)
        if rows["at"].hasnans:
            raise ValueError("an event has no time")
        code = rows.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
        at = rows["at"].to_numpy(np.int64)
        last = np.full(code.max(initial=-1) + 1, np.iinfo(np.int64).min)
        last[code[:n_held]] = at[:n_held]
        # a key's first event may follow no other: the least number is no time
        new = np.arange(n_held, len(rows))
        old = last[code[new]]
        new = new[(old == np.iinfo(np.int64).min) | (at[new] - span >= old)]
        new = new[np.lexsort((at[new], code[new]))]
        new = new[lives(code[new], at[new], span)]
        last[code[new]] = at[new]  # in order of time, so the latest stays
        watermark = state.getCurrentWatermarkMs()
        first = np.unique(code, return_index=True)[1]
        living = first[last // 1000 + life * 1000 >= watermark]
        kept = {c: rows[c].to_numpy()[living].tolist() for c in names} | {"at": last[code[living]].tolist()}
        state.update((pickle.dumps(kept, protocol=4),))
        state.setTimeoutTimestamp(int(max(last.max() // 1000 + life * 1000, watermark + 1)))
        yield rows.loc[new, [*names, "at"]]

    schema = ", ".join([*(f"{n} string" for n in names), "at bigint"])
    out = narrow.groupBy("_bucket").applyInPandasWithState(step, schema, "living binary", "append", GroupStateTimeout.EventTimeTimeout)
    types = dict(df.dtypes)
    return out.select(*(F.col(n).cast(types[c]).alias(c) for c, n in zip(keys, names, strict=True)), "at")
