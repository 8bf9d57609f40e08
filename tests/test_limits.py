"""Limiters against plain loops, with and without splitting hot keys, in batch and as streams."""

import random

import pytest
from pyspark.sql import functions as F

from wiretally.operators import limits as R
from wiretally.streaming.limits import limit_stream

US = 1_000_000


def make_events(seed: int, n: int = 400, keys: int = 5, spread: float = 0.2):
    """Half of the events belong to one key; some share a time."""
    rng = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        gap = rng.choice([0, 0.01, spread, spread * 2, spread * 20 if rng.random() < 0.1 else spread])
        t += int(gap * US * rng.random()) if rng.random() < 0.8 else rng.choice([0, US // 2, US])
        key = 0 if rng.random() < 0.5 else rng.randrange(1, keys)
        out.append((i, t, f"k{key}", key % 4))
    return out


def frame(spark, events):
    df = spark.createDataFrame(events, "id long, t long, k string, cap int")
    return df.withColumn("ts", F.timestamp_micros("t")).drop("t")


def by_loop(events, decide):
    """``decide(memory, t, cap)`` per key in (t, id) order."""
    memory, out = {}, {}
    for i, t, k, cap in sorted(events, key=lambda e: (e[1], e[0])):
        out[i] = decide(memory.setdefault(k, {}), t, cap)
    return out


def bucket(size, rate, free_first=False):
    def decide(m, t, cap):
        if not m:
            m.update(tokens=size, last=t)
            if free_first:
                return True
        gain = (t - m["last"]) * rate // US
        if gain > 0:
            m["tokens"], m["last"] = min(size, m["tokens"] + gain), t
        if m["tokens"] >= 1:
            m["tokens"] -= 1
            return True
        return False

    return decide


def window(limit, width):
    def decide(m, t, cap):
        if not m or m["end"] < t:
            m.update(end=t + width, n=1)
        else:
            m["n"] += 1
        return m["n"] <= limit

    return decide


def user(m, t, cap):
    if cap <= 0:
        return True
    if not m or t >= m["expiry"]:
        m.update(n=0, expiry=m.get("expiry", 0))
    if m["n"] >= cap:
        return False
    m["n"] += 1
    m["expiry"] = t + US
    return True


def adaptive(size, rate):
    def decide(m, t, cap):
        if not m:
            m.update(size=size // 4, rate=rate // 2, tokens=size // 4, last=t)
            return True
        if m["size"] > 10:
            m["size"], m["rate"] = m["size"] // 2, m["rate"] // 2
        gain = (t - m["last"]) * m["rate"] // US
        if gain > 0:
            m["tokens"], m["last"] = min(m["size"], m["tokens"] + gain), t
        if m["tokens"] >= 1:
            m["tokens"] -= 1
            return True
        return False

    return decide


CASES = {
    "bucket": (R.TokenBucket(4, 3), None, bucket(4, 3)),
    "bucket_slow": (R.TokenBucket(2, 1), None, bucket(2, 1)),
    "bucket_fast": (R.TokenBucket(50, 7), None, bucket(50, 7)),
    "bucket_odd": (R.TokenBucket(5, 1_000), None, bucket(5, 1_000)),
    "connections": (R.TokenBucket(10, 1, free_first=True), None, bucket(10, 1, True)),
    "no_refill": (R.TokenBucket(30, 0), None, bucket(30, 0)),
    "window": (R.WindowLimit(5, 2 * US), None, window(5, 2 * US)),
    "window_long": (R.WindowLimit(20, 30 * US), None, window(20, 30 * US)),
    "user": (R.UserLimit(), "cap", user),
    "user_big": (R.UserLimit(), "big", lambda m, t, cap: user(m, t, 25)),
    "adaptive": (R.AdaptiveBucket(80, 9, emergency=True), None, adaptive(80, 9)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("hot", [None, (50, 3)])
def test_replay_equals_loop(spark, name, hot):
    machine, param, decide = CASES[name]
    events = make_events(len(name))
    df = frame(spark, events).withColumn("big", F.lit(25))
    how = {} if hot is None else {"hot_rows": hot[0], "slice_seconds": hot[1]}
    got = {r.id: r.allowed for r in R.replay(df, machine, "k", "ts", "id", param=param, **how).collect()}
    assert got == by_loop(events, decide)


@pytest.mark.parametrize("spread", [0.002, 0.05])
def test_dense_hot_key(spark, spread):
    """Events far denser than the refill: entry states differ from slice to slice."""
    events = make_events(7, n=1500, keys=2, spread=spread)
    df = frame(spark, events)
    for machine, decide in ((R.TokenBucket(3, 2), bucket(3, 2)), (R.WindowLimit(9, US), window(9, US))):
        got = {r.id: r.allowed for r in R.replay(df, machine, "k", "ts", "id", hot_rows=100, slice_seconds=1).collect()}
        assert got == by_loop(events, decide)


def test_null_keys_pass_and_inactive_rows_do_nothing(spark):
    rows = [(1, 0, "a", True), (2, 1, "a", False), (3, 2, "a", True), (4, 3, None, True)]
    df = spark.createDataFrame(rows, "id long, t long, k string, live boolean").withColumn("ts", F.timestamp_micros("t"))
    got = {r.id: r.allowed for r in R.replay(df, R.TokenBucket(1, 1), "k", "ts", "id", active="live").collect()}
    assert got == {1: True, 2: None, 3: False, 4: True}


def test_window_edges(spark):
    """The window's end belongs to it (a gap equal to the width does not restart)."""
    rows = [(1, 0, "a", 0), (2, 2 * US, "a", 0), (3, 2 * US + 1, "a", 0)]
    got = {r.id: r.remaining for r in R.window_limit(frame(spark, rows), "k", "ts", "id", limit=5, width_seconds=2).collect()}
    assert got == {1: 4, 2: 3, 3: 4}


def test_gap_edges(spark):
    rows = [(1, 0, "a", 0), (2, US - 1, "a", 0), (3, 2 * US - 1, "a", 0)]
    got = {r.id: r.session_rank for r in R.gap_limit(frame(spark, rows), "k", "ts", "id", limit=1, gap_seconds=1).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_emergency_and_whitelist(spark):
    rows = [(i, i, "a", i % 3) for i in range(12)]
    df = frame(spark, rows).withColumn("ok", F.col("cap") == 0)
    out = R.rate_limit(df, "k", "ts", "id", size=2, rate=1, whitelisted="ok", emergency=True)
    got = {r.id: r.outcome for r in out.collect()}
    assert [got[i] for i in range(6)] == ["whitelisted", "allowed", "emergency", "whitelisted", "emergency", "allowed"]
    assert got[7] == "limited"


@pytest.mark.parametrize("name", ["bucket", "window", "user", "adaptive"])
def test_stream_equals_batch(spark, tmp_path, name):
    machine, param, decide = CASES[name]
    events = make_events(3, n=400)
    ordered = sorted(events, key=lambda e: (e[1], e[0]))
    for part in range(4):  # one file per micro-batch, in time order
        frame(spark, ordered[part * 100 : part * 100 + 100]).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    schema = frame(spark, events[:1]).schema
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(str(tmp_path / "in"))
    )
    out = limit_stream(stream, machine, "k", "ts", "id", param=param)
    running = (
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    running.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    expected = by_loop(events, decide)
    assert not any(r.late for r in rows)
    assert {r.id: r.allowed for r in rows} == expected


def test_rows_come_back_unchanged(spark):
    """Large numbers and nulls in other columns survive the replay, also beside entry states."""
    big = 2**62 + 1
    rows = [(big + i, i * US, "a", None if i % 3 else big) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t long, k string, other long").withColumn("ts", F.timestamp_micros("t"))
    out = R.replay(df, R.WindowLimit(2, 5 * US), "k", "ts", "id", hot_rows=10, slice_seconds=7).drop("allowed", "remaining")
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
