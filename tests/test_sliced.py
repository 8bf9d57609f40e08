"""Slice-wise windows against plain loops; one key holds most rows, some keys are null."""

import random

import pytest
from pyspark.sql import functions as F

from wiretally.operators import latency as L
from wiretally.operators import sliced as W
from wiretally.operators import tuning as T

US = 1_000_000


def rows(seed=5, n=400):
    rng = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, US, 30 * US, 4000 * US])
        out.append((i, t, rng.choice(["a", "a", "a", "b", "c", None]), rng.random() * 10))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id long, t long, key string, v double").withColumn("ts", F.timestamp_micros("t"))


def per_key(data):
    keys = {}
    for r in sorted(data, key=lambda r: (r[1], r[0])):
        keys.setdefault(r[2], []).append(r)
    return keys


@pytest.mark.parametrize("width", [10, 5000, 10**7])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, width, descending):
    data = rows()
    sums = {"rn": F.lit(1), "total": F.col("v")}
    out = W.running_sums(frame(spark, data), ["key"], "ts", "id", sums, slice_seconds=width, descending=descending)
    got = {r.id: (r.rn, round(r.total, 6)) for r in out.collect()}
    expected = {}
    for series in per_key(data).values():
        total = 0.0
        for n, r in enumerate(reversed(series) if descending else series, 1):
            total += r[3]
            expected[r[0]] = (n, round(total, 6))
    assert got == expected


@pytest.mark.parametrize("width", [10, 5000])
def test_previous_values(spark, width):
    data = rows()
    out = W.previous_values(frame(spark, data), ["key"], "ts", "id", {"p": "v", "pid": "id"}, slice_seconds=width)
    got = {r.id: (r.p, r.pid) for r in out.collect()}
    expected = {}
    for series in per_key(data).values():
        before = (None, None)
        for r in series:
            expected[r[0]] = before
            before = (r[3], r[0])
    assert got == expected


@pytest.mark.parametrize("width", [10, 5000])
@pytest.mark.parametrize("gap", [US, 31 * US, 10**12])
def test_gap_sessions(spark, width, gap):
    data = rows()
    out = W.gap_sessions(frame(spark, data), ["key"], "ts", "id", gap, slice_seconds=width)
    got = {r.id: r.session_rank for r in out.collect()}
    expected = {}
    for series in per_key(data).values():
        last, rank = None, 0
        for r in series:
            rank = 1 if last is None or r[1] - last >= gap else rank + 1
            last = r[1]
            expected[r[0]] = rank
    assert got == expected


@pytest.mark.parametrize("width", [10, 5000])
def test_averages(spark, width):
    data = [r for r in rows() if r[2] is not None]
    df = frame(spark, data)
    final = W.ema_final(df, ["key"], "ts", "id", {"e": F.col("v")}, init={"e": 5.0}, slice_seconds=width)
    got = {r.key: (r.n, round(r.e, 6)) for r in final.collect()}
    series = {r.id: round(r.ema, 6) for r in L.ema_series(df, "key", "ts", "id", "v", slice_seconds=width).collect()}
    halves = {r.key: round(r.running_average, 6) for r in T.halving_average(df, "key", "ts", "id", "v", slice_seconds=width).collect()}
    for key, s in per_key(data).items():
        warm, cold, half = 5.0, 0.0, None
        for r in s:
            warm, cold = 0.1 * r[3] + 0.9 * warm, 0.1 * r[3] + 0.9 * cold
            half = r[3] if half is None else (half + r[3]) / 2
            assert series[r[0]] == round(cold, 6)
        assert got[key] == (len(s), round(warm, 6))
        assert halves[key] == round(half, 6)


def test_rate_resets_and_zero_time(spark):
    data = [(0, 0, "a", 5.0), (1, US, "a", 7.0), (2, US, "a", 9.0), (3, 3 * US, "a", 1.0), (4, 5 * US, "a", 5.0)]
    out = T.counter_rate(frame(spark, data), "key", "ts", "id", "v", slice_seconds=2)
    assert {r.id: r.rate for r in out.collect()} == {0: None, 1: 2.0, 2: None, 3: None, 4: 2.0}


def test_trend_of_a_flat_series_and_short_series(spark):
    data = [(i, i * US, "flat", 3.0) for i in range(12)] + [(i, i * US, "short", i) for i in range(9)]
    data += [(i, i * US, "up", 0.0 if i < 500 else i - 500.0) for i in range(1500)]
    df = frame(spark, [(i, t, k, float(v)) for i, t, k, v in data])
    found = {r.key: r for r in T.trend(df, "key", ["ts", "id"], "v", 1000).collect()}
    assert set(found) == {"flat", "up"}
    assert found["flat"].direction == "stable" and found["flat"].confidence == 1.0
    assert found["up"].n == 1000 and round(found["up"].slope, 6) == 1.0 and found["up"].direction == "increasing"


def test_one_instant_of_one_key_is_cut(spark, monkeypatch):
    """All rows in one second of one key, half of them in one instant: no slice is much above its share, and results stay."""
    monkeypatch.setattr(W, "CROWD", 100)
    data = [(i, "k", 1_700_000_000_000_000 + (0 if i % 2 else (i * 37) % 900_000), (i * 7) % 11) for i in range(4000)]
    df = spark.createDataFrame(data, "id long, key string, us long, v long").withColumn("ts", F.timestamp_micros("us")).repartition(5)
    sizes = [r["count"] for r in W.with_slice(df, ["key"], "ts", "id", 3600).groupBy(W.PLACE).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 200 and len(sizes) > 60
    ordered = sorted(data, key=lambda r: (r[2], r[0]))
    out = {r.id: (r.n, r.s) for r in W.running_sums(df, ["key"], "ts", "id", {"n": F.lit(1), "s": F.col("v")}).collect()}
    total = 0
    for n, (i, _, _, v) in enumerate(ordered):
        total += v
        assert out[i] == (n + 1, total)
    before = {r.id: r.p for r in W.previous_values(df, ["key"], "ts", "id", {"p": "id"}).collect()}
    assert [before[r[0]] for r in ordered] == [None, *(r[0] for r in ordered[:-1])]
    level, want = 0.0, {}
    for i, _, _, v in ordered:
        level = 0.1 * v + 0.9 * level
        want[i] = round(level, 6)
    assert {r.id: round(r.ema, 6) for r in L.ema_series(df, "key", "ts", "id", "v").collect()} == want
    assert round(W.ema_final(df, ["key"], "ts", "id", {"e": F.col("v")}).first().e, 6) == want[ordered[-1][0]]
    ranks = {r.id: r.session_rank for r in W.gap_sessions(df, ["key"], "ts", "id", 400).collect()}
    rank = 0
    for n, (i, _, us, _) in enumerate(ordered):
        rank = 1 if n == 0 or us - ordered[n - 1][2] >= 400 else rank + 1
        assert ranks[i] == rank
