"""Rate limiters replayed over event logs.

Each limiter is a small state machine per key: ``step`` moves it by one event. The same machines
serve batch replay here and keyed streaming state in ``wiretally.streaming``.

In batch a key's events are replayed in time order within one sorted partition pass, holding one
state, never a group. A key with more than ``hot_rows`` events is cut into time slices that replay
in parallel: every slice is first reduced to a small table that maps the state it may be entered
with to the state it leaves (``summarise``), the tables are chained per key (``advance``), and the
slices then replay from their exact entry states.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.operators.sliced import gap_sessions, running_sums

SECOND = 1_000_000
HOT_ROWS = 5_000_000
HOT_SLICE_SECONDS = 60


def _last_in_chain(nxt: np.ndarray) -> np.ndarray:
    """Index at which following ``nxt`` (which ends at ``len(nxt)``) stops, for every start."""
    n = len(nxt)
    last = np.where(nxt >= n, np.arange(n), nxt)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return last
        last = further


def _merge_runs(times: np.ndarray, *columns: np.ndarray) -> list[list[int]]:
    """Drop entries whose outcome equals the next one's; a lookup of the next later time still hits it."""
    if len(times) == 0:
        return [[] for _ in range(1 + len(columns))]
    same = np.ones(len(times) - 1, dtype=bool)
    for c in columns:
        same &= c[1:] == c[:-1]
    keep = np.append(~same, True)
    return [a[keep].tolist() for a in (times, *columns)]


class WindowLimit:
    """Window anchored at its first event, restarted by the first event later than ``start + width``.

    Serves as burst guard (drop above the threshold) and as fixed-window limit. State: end of
    window, events in it.
    """

    state = ["s_end", "s_n"]
    outputs = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType())])
    unlimited = (True, None)

    def __init__(self, limit: int, width_us: int):
        self.limit, self.width = limit, width_us

    def step(self, state, t, param):
        if state is None or state[0] < t:
            state = (t + self.width, 1)
        else:
            state = (state[0], state[1] + 1)
        return state, (state[1] <= self.limit, max(0, self.limit - state[1]))

    def summarise(self, ts, start, param):
        last = _last_in_chain(np.searchsorted(ts, ts + self.width, side="right"))
        n = len(ts)
        upto = min(n, int(np.searchsorted(ts, start + self.width, side="right")) + 1)
        pick = last[:upto]
        at, end, count = _merge_runs(ts[:upto], ts[pick] + self.width, n - pick)
        return {"rows": [n], "at": at, "a": end, "b": count}

    def advance(self, state, s, param):
        i = 0 if state is None else bisect_right(s["at"], state[0])
        if i < len(s["at"]):
            return (s["a"][i], s["b"][i])
        return (state[0], state[1] + s["rows"][0])


class UserLimit:
    """Allowed events count and restart a ``ttl``; denied ones do neither. The limit is a parameter
    of the key; none or 0 means no limit. State: expiry, count."""

    state = ["s_expiry", "s_n"]
    outputs = T.StructType([T.StructField("allowed", T.BooleanType())])
    unlimited = (True,)

    def __init__(self, ttl_us: int = SECOND):
        self.ttl = ttl_us

    def step(self, state, t, param):
        if param is None or param <= 0:
            return state, (True,)
        count = 0 if state is None or t >= state[0] else state[1]
        if count >= param:
            return state, (False,)
        return (t + self.ttl, count + 1), (True,)

    def _first_fresh(self, ts, gaps, budget, start=0):
        """First event after ``start`` that starts counting anew, given ``budget`` more allowed events."""
        n, end = len(ts), start + budget - 1
        if gaps[start] <= end:
            return int(gaps[start])
        return int(np.searchsorted(ts, ts[end] + self.ttl)) if end < n else n

    def summarise(self, ts, start, param):
        n = len(ts)
        if param is None or param <= 0:
            return {"rows": [n], "at": [], "a": [], "b": [], "c": [], "d": [], "e": []}
        resets = np.flatnonzero(np.diff(ts) >= self.ttl) + 1
        follow = np.searchsorted(resets, np.arange(n), side="right")
        gaps = np.append(resets, n)[follow]
        ends = np.arange(n) + param - 1
        spent = np.where(
            ends < n, np.searchsorted(ts, ts[np.minimum(ends, n - 1)] + self.ttl), n
        )
        last = _last_in_chain(np.where(gaps <= ends, gaps, spent))
        count = np.minimum(param, n - last)
        expiry = ts[last + count - 1] + self.ttl
        upto = min(n, int(np.searchsorted(ts, start + self.ttl)) + 1)
        at, end, kept = _merge_runs(ts[:upto], expiry[:upto], count[:upto])
        c, d, e = [], [], []  # outcome when entered mid-count with 1, 2, ... allowed events left
        for budget in range(1, min(param - 1, n) + 1):
            f = self._first_fresh(ts, gaps, budget)
            fresh = f < n
            c.append(int(expiry[f]) if fresh else int(ts[min(budget, n) - 1]) + self.ttl)
            d.append(int(count[f]) if fresh else min(budget, n))
            e.append(int(fresh))
        return {"rows": [n, int(ts[0]), int(ts[-1])], "at": at, "a": end, "b": kept, "c": c, "d": d, "e": e}

    def advance(self, state, s, param):
        if not s["at"]:
            return state
        n, first, final = s["rows"]
        if state is None or first >= state[0]:
            return (s["a"][0], s["b"][0])
        if state[1] >= param:
            i = bisect_left(s["at"], state[0])
            return (s["a"][i], s["b"][i]) if i < len(s["at"]) else state
        budget = param - state[1]
        if budget <= len(s["c"]):
            i = budget - 1
            return (s["c"][i], s["d"][i] + (0 if s["e"][i] else state[1]))
        # fewer events than the budget: only a gap inside the slice could start anew
        i = len(s["c"]) - 1
        if s["e"][i]:
            return (s["c"][i], s["d"][i])
        return (final + self.ttl, state[1] + n)


class TokenBucket:
    """Tokens refill by whole units only, and only then does the refill time move.

    ``free_first`` lets the event that creates the bucket pass uncharged. State: tokens, last refill.
    """

    state = ["s_tokens", "s_last"]
    outputs = T.StructType(
        [
            T.StructField("allowed", T.BooleanType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("created", T.BooleanType()),
            T.StructField("refilled", T.BooleanType()),
        ]
    )
    unlimited = (True, None, False, False)

    def __init__(self, size: int, rate: int, *, free_first: bool = False):
        self.size, self.rate, self.free_first = size, rate, free_first
        self.unit = -(-SECOND // rate) if rate > 0 else None

    def _gain(self, elapsed: int) -> int:
        return int(elapsed) * self.rate // SECOND

    def step(self, state, t, param):
        if state is None:
            left = self.size if self.free_first else self.size - 1
            return (max(left, 0), t), (self.free_first or self.size >= 1, max(left, 0), True, False)
        tokens, last = state
        gain = self._gain(t - last)
        if gain > 0:
            tokens, last = min(self.size, tokens + gain), t
        allowed = tokens >= 1
        tokens -= allowed
        return (tokens, last), (allowed, tokens, False, gain > 0)

    def summarise(self, ts, start, param):
        n = len(ts)
        unit = self.unit if self.unit is not None else int(ts[-1]) - start + 1
        nxt = np.searchsorted(ts, ts + unit).tolist() if self.rate > 0 else [n] * n
        times = ts.tolist()
        top = self.size + 1
        shift, low, high, last = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):  # tokens in -> tokens out is always a clamped shift
            j, used = nxt[i], nxt[i] - i
            if j >= n:
                shift[i], low[i], high[i], last[i] = -used, 0, max(0, top - used), times[i]
                continue
            gain = self._gain(times[j] - times[i])
            lo, hi = min(self.size, gain), self.size
            clamp = lambda x, k=j: max(low[k], min(high[k], x))
            shift[i] = gain - used + shift[j]
            low[i], high[i], last[i] = clamp(lo + shift[j]), clamp(hi + shift[j]), last[j]
        upto = min(n, int(np.searchsorted(ts, start + unit)) + 1)
        return {
            "rows": [n], "at": times[:upto], "a": shift[:upto], "b": low[:upto], "c": high[:upto], "d": last[:upto],
        }

    def advance(self, state, s, param):
        if state is None:
            return self._leave(0, self.size + (1 if self.free_first else 0), s)
        return self.advance_from(0, state, s)

    def advance_from(self, start, state, s):
        """State after the slice's events from position ``start`` on."""
        tokens, last = state
        i = max(start, bisect_left(s["at"], last + self.unit)) if self.rate > 0 else len(s["at"])
        if i >= len(s["at"]):
            return (max(0, tokens - (s["rows"][0] - start)), last)
        return self._leave(i, min(self.size, max(0, tokens - (i - start)) + self._gain(s["at"][i] - last)), s)

    def _leave(self, i, tokens, s):
        return (max(s["b"][i], min(s["c"][i], tokens + s["a"][i])), s["d"][i])


class AdaptiveBucket:
    """Token bucket that shrinks in an emergency: new ones start at a quarter of the size and half
    the rate, existing ones above size 10 halve on every event. The creating event is free.

    After the first few events of a key the size no longer changes and it is a plain bucket; a
    slice's table therefore is that bucket's, plus the slice's first events for keys still shrinking.
    State: tokens, last refill, size, rate.
    """

    state = ["s_tokens", "s_last", "s_size", "s_rate"]
    outputs = TokenBucket.outputs
    unlimited = TokenBucket.unlimited

    def __init__(self, size: int, rate: int, *, emergency: bool):
        self.size, self.rate, self.emergency = size, rate, emergency
        size, rate, self.shrinking = *self._first(), 1
        while self._shrinks(size):
            size, rate, self.shrinking = size // 2, rate // 2, self.shrinking + 1
        self.settled = TokenBucket(size, rate)

    def _first(self) -> tuple[int, int]:
        return (self.size // 4, self.rate // 2) if self.emergency else (self.size, self.rate)

    def _shrinks(self, size: int) -> bool:
        return self.emergency and size > 10

    def step(self, state, t, param):
        if state is None:
            size, rate = self._first()
            return (size, t, size, rate), (True, size, True, False)
        tokens, last, size, rate = state
        if self._shrinks(size):
            size, rate = size // 2, rate // 2
        gain = (t - last) * rate // SECOND
        if gain > 0:
            tokens, last = min(size, tokens + gain), t
        allowed = tokens >= 1
        tokens -= allowed
        return (tokens, last, size, rate), (allowed, tokens, False, gain > 0)

    def summarise(self, ts, start, param):
        head = ts[: self.shrinking]
        return {**self.settled.summarise(ts, max(start, int(head[-1])), param), "e": head.tolist()}

    def advance(self, state, s, param):
        done, total = 0, s["rows"][0]
        while done < total and (state is None or self._shrinks(state[2])):
            state, _ = self.step(state, s["e"][done], param)
            done += 1
        if done == total:
            return state
        return (*self.settled.advance_from(done, state[:2], s), *state[2:])


# --- batch replay ------------------------------------------------------------------------------------

_PAYLOAD = ["rows", "at", "a", "b", "c", "d", "e"]


def _entry_states(rows: DataFrame, machine, key: str, active: str | None, slice_us: int) -> DataFrame:
    """``key, _slice`` and the state each slice of the hot keys is entered with."""
    used = rows.filter(F.col("_hot"))
    if active is not None:
        used = used.filter(F.col(active))
    key_type = rows.schema[key].dataType.simpleString()
    names = list(machine.state)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(key, number, param, parts):
            found = machine.summarise(np.concatenate(parts), number * slice_us, param)
            return (key, number, param, *[found.get(p, []) for p in _PAYLOAD])

        open_at, param, parts = None, None, []
        for pdf in batches:  # sorted by key, slice, time: a slice is whole when the next one starts
            keys, numbers, times = pdf["k"].to_numpy(), pdf["_slice"].to_numpy(), pdf["_t"].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            out = []
            for start, end in zip([0, *cuts], [*cuts, len(pdf)]):
                here = (keys[start], int(numbers[start]))
                if here != open_at:
                    if open_at is not None:
                        out.append(table(*open_at, param, parts))
                    value = pdf["_param"].iat[start]
                    open_at, param, parts = here, None if pd.isna(value) else int(value), []
                parts.append(times[start:end])
            yield _frame(out, ["k", "slice", "param", *_PAYLOAD], ["param"])
        if open_at is not None:
            yield _frame([table(*open_at, param, parts)], ["k", "slice", "param", *_PAYLOAD], ["param"])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:  # sorted by key, slice
            out = []
            for row in pdf.itertuples(index=False):
                if row.k != at:
                    at, state = row.k, None
                out.append((row.k, row.slice, *(state or (None,) * len(names))))
                payload = {p: getattr(row, p).tolist() for p in _PAYLOAD}
                state = machine.advance(state, payload, None if pd.isna(row.param) else int(row.param))
            yield _frame(out, ["k", "slice", *names], names)

    tables = (
        used.select(F.col(key).alias("k"), "_slice", "_t", "_param")
        .repartition("k", "_slice")
        .sortWithinPartitions("k", "_slice", "_t")
        .mapInPandas(
            summarise,
            f"k {key_type}, slice long, param long, " + ", ".join(f"{p} array<long>" for p in _PAYLOAD),
        )
    )
    return (
        tables.repartition("k")
        .sortWithinPartitions("k", "slice")
        .mapInPandas(chain, f"k {key_type}, slice long, " + ", ".join(f"{n} long" for n in names))
    )


def _frame(rows: list[tuple], columns: list[str], nullable: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({n: "Int64" for n in nullable})


def replay(
    df: DataFrame,
    machine,
    key: str,
    ts: str,
    tie: str,
    *,
    param: str | None = None,
    active: str | None = None,
    hot_rows: int = HOT_ROWS,
    slice_seconds: int = HOT_SLICE_SECONDS,
) -> DataFrame:
    """Add the machine's output columns to every row, in (ts, tie) order per key.

    Rows with a null key, or not ``active``, touch no state: null keys pass, inactive rows get nulls.
    """
    slice_us = slice_seconds * SECOND
    columns, outputs = list(df.columns), machine.outputs
    rows = df.filter(F.col(key).isNotNull()).withColumn("_t", F.unix_micros(ts)).withColumn(
        "_param", (F.col(param) if param else F.lit(None)).cast("long")
    )
    # at most total / hot_rows keys are hot: a bound that makes this side safe to broadcast
    hot = rows.groupBy(F.col(key).alias("_hk")).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > hot_rows)
    rows = (
        rows.join(F.broadcast(hot.select("_hk")), F.col(key) == F.col("_hk"), "left")
        .withColumn("_hot", F.col("_hk").isNotNull())
        .drop("_hk")
    )
    number = F.floor(F.col("_t") / slice_us)
    rows = rows.withColumn("_slice", F.when(F.col("_hot"), number).otherwise(F.lit(0).cast("long")))
    names = list(machine.state)
    entry = _entry_states(rows, machine, key, active, slice_us)
    # entry states travel with the rows, ahead of their slice's first one: one shuffle, no join
    marks = entry.select(
        F.col("k").alias(key), F.col("slice").alias("_slice"), *names, F.lit(True).alias("_mark")
    )
    both = rows.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    ordered = both.repartition(key, "_slice").sortWithinPartitions(
        key, "_slice", F.col("_mark").desc(), "_t", tie
    )
    schema = T.StructType([*df.schema.fields, *outputs.fields])
    out_names = outputs.fieldNames()

    out_types = [pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64() for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        idle = (None,) * len(out_names)
        for batch in batches:  # Arrow keeps the rows' own columns exactly as they came
            read = lambda c: batch.column(c).to_pylist()  # noqa: E731, B023
            marks, times, params = read("_mark"), read("_t"), read("_param")
            live = read(active) if active else None
            entries = list(zip(*[read(n) for n in names])) if any(marks) else None
            results = []
            for i, here in enumerate(zip(read(key), read("_slice"))):
                if here != at:
                    at, state = here, None
                if marks[i]:
                    state = None if entries[i][0] is None else entries[i]
                elif live is not None and not live[i]:
                    results.append(idle)
                else:
                    state, result = machine.step(state, times[i], params[i])
                    results.append(result)
            rows = batch.select(columns).filter(pc.invert(batch.column("_mark")))
            added = [pa.array(v, t) for v, t in zip(zip(*results), out_types)] if results else [
                pa.array([], t) for t in out_types
            ]
            yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*columns, *out_names])

    replayed = ordered.mapInArrow(run, schema)
    passed = df.filter(F.col(key).isNull())
    for name, value in zip(out_names, machine.unlimited):
        passed = passed.withColumn(name, F.lit(value).cast(outputs[name].dataType))
    return replayed.unionByName(passed)


def token_bucket(df: DataFrame, key: str, ts: str, tie: str, *, size: int, rate: int, **how) -> DataFrame:
    return replay(df, TokenBucket(size, rate), key, ts, tie, **how)


def burst_guard(df: DataFrame, key: str, ts: str, tie: str, *, window_ms: int, threshold: int, **how) -> DataFrame:
    """Add ``burst``: the event exceeds the threshold of its window."""
    out = replay(df, WindowLimit(threshold, window_ms * 1000), key, ts, tie, **how)
    return out.withColumn("burst", ~F.col("allowed")).drop("allowed", "remaining")


def window_limit(df: DataFrame, key: str, ts: str, tie: str, *, limit: int, width_seconds: int, **how) -> DataFrame:
    return replay(df, WindowLimit(limit, width_seconds * SECOND), key, ts, tie, **how)


def user_limit(df: DataFrame, key: str, ts: str, tie: str, *, limit: str, **how) -> DataFrame:
    """``limit`` names a column that is constant per key."""
    return replay(df, UserLimit(), key, ts, tie, param=limit, **how)


def connection_limit(df: DataFrame, key: str, ts: str, tie: str, **how) -> DataFrame:
    """New connections to database ports: bucket of 10, one per second, first attempt free."""
    return replay(df, TokenBucket(10, 1, free_first=True), key, ts, tie, **how)


def adaptive_limit(
    df: DataFrame, key: str, ts: str, tie: str, *, size: int, rate: int, emergency: bool, **how
) -> DataFrame:
    return replay(df, AdaptiveBucket(size, rate, emergency=emergency), key, ts, tie, **how)


def gap_limit(df: DataFrame, key: str, ts: str, tie: str, *, limit: int, gap_seconds: int, **how) -> DataFrame:
    """Every event restarts the gap, so the count is the rank in the session; expressions only."""
    ranked = gap_sessions(df, [key], ts, tie, gap_seconds * SECOND, **how)
    return ranked.withColumn("allowed", F.col("session_rank") <= limit)


def aligned_window_limit(
    df: DataFrame, key: str, ts: str, tie: str, *, limit: int, width_seconds: int, **how
) -> DataFrame:
    """Fixed windows on epoch boundaries; windows longer than a slice are counted slice by slice."""
    rows = df.withColumn("_window", F.floor(F.unix_micros(ts) / (width_seconds * SECOND)))
    ranked = running_sums(rows, [key, "_window"], ts, tie, {"window_rank": F.lit(1)}, **how)
    rank = F.col("window_rank").cast("int")
    return (
        ranked.withColumn("window_rank", rank)
        .withColumn("allowed", rank <= limit)
        .withColumn("remaining", F.greatest(F.lit(limit) - rank, F.lit(0)))
        .drop("_window")
    )


def rate_limit(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    *,
    size: int,
    rate: int,
    burst_window_ms: int | None = None,
    burst_threshold: int = 0,
    whitelisted: str | None = None,
    emergency: bool = False,
    **how,
) -> DataFrame:
    """The whole limiter: whitelist, emergency drop of every other microsecond, burst, bucket.

    Adds ``outcome`` (whitelisted, emergency, burst, allowed, limited), ``created``, ``refilled``.
    Events stopped early touch no later state.
    """
    free = F.coalesce(F.col(whitelisted), F.lit(False)) if whitelisted else F.lit(False)
    even = F.pmod(F.unix_micros(ts), F.lit(2)) == 0 if emergency else F.lit(False)
    base = df.withColumn("_early", F.when(free, "whitelisted").when(even, "emergency"))
    base = base.withColumn("_live", F.col("_early").isNull())
    if burst_window_ms is not None:
        base = replay(base, WindowLimit(burst_threshold, burst_window_ms * 1000), key, ts, tie, active="_live", **how)
        base = base.withColumn("_early", F.when(F.col("allowed") == F.lit(False), "burst").otherwise(F.col("_early")))
        base = base.withColumn("_live", F.col("_early").isNull()).drop("allowed", "remaining")
    out = replay(base, TokenBucket(size, rate), key, ts, tie, active="_live", **how)
    decided = F.when(F.col("allowed"), F.lit("allowed")).otherwise(F.lit("limited"))
    return out.withColumn("outcome", F.coalesce(F.col("_early"), decided)).drop("_early", "_live", "allowed", "tokens")


def limit_stats(decisions: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return decisions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(o == "allowed").alias("allowed"),
        F.count_if(o.isin("limited", "burst")).alias("limited"),
        F.count_if(o == "burst").alias("bursts"),
        F.count_if(o == "whitelisted").alias("whitelisted"),
        F.count_if(F.col("created")).alias("buckets_created"),
        F.count_if(F.col("refilled")).alias("refills"),
        F.count_if(o == "emergency").alias("emergency_drops"),
    )
