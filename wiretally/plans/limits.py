"""Queries that replay rate limiters over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.operators import limits as R
from wiretally.operators import rollups
from wiretally.plans.inputs import ctes, derive, load
from wiretally.plans.registry import query

HOUR, DAY = 3600, 86_400
US = 1_000_000


def events(spark, sf):
    return load(spark, sf, "events").select("event_id", "ts", "user_id")


def fold_sql(start: str, step: str, columns: list[str], source: str = "events") -> str:
    """State machine as a recursion over each key's event number (aligned across keys).

    ``start`` and ``step`` are select lists for ``columns``; ``step`` sees state ``s`` and event ``e``.
    """
    return f"""ev AS (SELECT event_id, user_id AS k, epoch_us(ts) AS t,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {source}),
    st AS (SELECT event_id, k, rn, t, {start} FROM ev e WHERE rn = 1
      UNION ALL SELECT e.event_id, e.k, e.rn, e.t, {step} FROM st s JOIN ev e ON e.k = s.k AND e.rn = s.rn + 1)"""


BUCKET_SIZE, BUCKET_RATE = 3, 1  # events of one user are hours apart: the queries scale time down


def slow(df, factor: int):
    """Time divided by a factor, so that limits of seconds bite on a thin log."""
    micros = F.floor(F.unix_micros("ts") / factor)
    return df.withColumn("ts", F.timestamp_micros(micros))


SLOW = 40_000
SLOWED = f"slowed AS (SELECT event_id, user_id, make_timestamp(epoch_us(ts) // {SLOW}) AS ts FROM events)"


def bucket_sql(size: int, rate: int, free_first: bool, source: str = "slowed") -> str:
    left = size if free_first else size - 1
    gain = f"((e.t - s.last) * {rate} // {US})"
    refilled = f"CASE WHEN {gain} > 0 THEN least({size}, s.tokens + {gain}) ELSE s.tokens END"
    return fold_sql(
        f"CAST({left} AS BIGINT) AS tokens, t AS last, true AS allowed, true AS created, false AS refilled",
        f"greatest({refilled} - 1, 0), CASE WHEN {gain} > 0 THEN e.t ELSE s.last END, {refilled} >= 1, false, {gain} > 0",
        [], source,
    )


@query(
    "token_bucket",
    f"""WITH RECURSIVE {SLOWED}, {bucket_sql(3, 1, False)} SELECT event_id, allowed, tokens, created, refilled FROM st""",
)
def _(spark, sf):
    df = slow(events(spark, sf), SLOW)
    return R.token_bucket(df, "user_id", "ts", "event_id", size=3, rate=1).drop("ts", "user_id")


@query(
    "token_bucket_hot",
    f"""WITH RECURSIVE {SLOWED}, {bucket_sql(2, 2, False)} SELECT event_id, allowed, tokens FROM st""",
)
def _(spark, sf):
    df = slow(events(spark, sf), SLOW)
    replayed = R.token_bucket(
        df, "user_id", "ts", "event_id", size=2, rate=2, hot_rows=60, slice_seconds=5
    )
    return replayed.select("event_id", "allowed", "tokens")


WINDOW_US = 3 * HOUR * US


def window_sql(width_us: int, limit: int, source: str = "events") -> str:
    return fold_sql(
        f"t + {width_us} AS finish, CAST(1 AS BIGINT) AS n",
        f"CASE WHEN s.finish < e.t THEN e.t + {width_us} ELSE s.finish END, CASE WHEN s.finish < e.t THEN 1 ELSE s.n + 1 END",
        [], source,
    )


@query(
    "burst_guard",
    f"WITH RECURSIVE {window_sql(DAY * US, 4)} SELECT event_id, n > 4 AS burst FROM st",
)
def _(spark, sf):
    out = R.burst_guard(events(spark, sf), "user_id", "ts", "event_id", window_ms=DAY * 1000, threshold=4)
    return out.select("event_id", "burst")


@query(
    "window_limit_anchored",
    f"WITH RECURSIVE {window_sql(2 * DAY * US, 5)} SELECT event_id, n <= 5 AS allowed, greatest(0, 5 - n) AS remaining FROM st",
)
def _(spark, sf):
    out = R.window_limit(
        events(spark, sf), "user_id", "ts", "event_id", limit=5, width_seconds=2 * DAY, hot_rows=70, slice_seconds=3 * DAY
    )
    return out.select("event_id", "allowed", "remaining")


@query(
    "user_limit",
    f"""WITH RECURSIVE {SLOWED}, {fold_sql(
        f"CASE WHEN k % 4 = 0 THEN 0 ELSE t + {US} END AS expiry, CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n, true AS allowed",
        f"CASE WHEN e.k % 4 = 0 OR (e.t < s.expiry AND s.n >= e.k % 4) THEN s.expiry ELSE e.t + {US} END, "
        f"CASE WHEN e.k % 4 = 0 THEN 0 WHEN e.t >= s.expiry THEN 1 WHEN s.n >= e.k % 4 THEN s.n ELSE s.n + 1 END, "
        f"e.k % 4 = 0 OR e.t >= s.expiry OR s.n < e.k % 4",
        [], "slowed")} SELECT event_id, allowed FROM st""",
)
def _(spark, sf):
    df = slow(events(spark, sf), SLOW).withColumn("cap", F.col("user_id") % 4)
    out = R.user_limit(df, "user_id", "ts", "event_id", limit="cap", hot_rows=60, slice_seconds=4)
    return out.select("event_id", "allowed")


@query(
    "connection_limit",
    f"""WITH RECURSIVE {ctes('packets')[5:]}, fresh AS (SELECT event_id, user_id, make_timestamp(epoch_us(ts) // {SLOW * 20}) AS ts FROM packets
      WHERE dest_port IN (3306, 5432, 1433, 27017, 6379) AND syn AND NOT ack),
    {bucket_sql(10, 1, True, 'fresh')} SELECT event_id, allowed FROM st""",
)
def _(spark, sf):
    from wiretally.operators.netblocks import new_connections

    fresh = slow(new_connections(derive(spark, sf, "packets")).select("event_id", "user_id", "ts"), SLOW * 20)
    return R.connection_limit(fresh, "user_id", "ts", "event_id").select("event_id", "allowed")


@query(
    "adaptive_limit",
    f"""WITH RECURSIVE {SLOWED}, {fold_sql(
        "CAST(20 AS BIGINT) AS size, CAST(4 AS BIGINT) AS rate, CAST(20 AS BIGINT) AS tokens, t AS last, true AS allowed",
        "CASE WHEN s.size > 10 THEN s.size // 2 ELSE s.size END, CASE WHEN s.size > 10 THEN s.rate // 2 ELSE s.rate END, "
        + (lambda size, rate: (lambda gain: (lambda now: f"greatest({now} - 1, 0), CASE WHEN {gain} > 0 THEN e.t ELSE s.last END, {now} >= 1")(
            f"CASE WHEN {gain} > 0 THEN least({size}, s.tokens + {gain}) ELSE s.tokens END"))(f"((e.t - s.last) * {rate} // {US * 1}) "))(
            "(CASE WHEN s.size > 10 THEN s.size // 2 ELSE s.size END)", "(CASE WHEN s.size > 10 THEN s.rate // 2 ELSE s.rate END)"),
        [], "slowed")} SELECT event_id, allowed, tokens FROM st""",
)
def _(spark, sf):
    out = R.adaptive_limit(
        slow(events(spark, sf), SLOW), "user_id", "ts", "event_id", size=80, rate=8, emergency=True
    )
    return out.select("event_id", "allowed", "tokens")


GAP = f"""g AS (SELECT event_id, user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {12 * HOUR * US}, true) AS new
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
    r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS session_rank FROM s)"""


@query("gap_limit", f"WITH {GAP} SELECT event_id, session_rank, session_rank <= 3 AS allowed FROM r")
def _(spark, sf):
    out = R.gap_limit(
        events(spark, sf), "user_id", "ts", "event_id", limit=3, gap_seconds=12 * HOUR, slice_seconds=DAY
    )
    return out.select("event_id", "session_rank", "allowed")


@query(
    "cache_admission",
    f"WITH {GAP.replace(str(12 * HOUR * US), str(HOUR * US)).replace('user_id', 'k').replace('event_id, k, ts', 'event_id, user_id % 5 AS k, ts').replace('PARTITION BY k ORDER BY ts, event_id)),', 'PARTITION BY user_id % 5 ORDER BY ts, event_id)),', 1)} SELECT event_id, session_rank > 2 AS admitted FROM r",
)
def _(spark, sf):
    log = events(spark, sf).withColumn("k", F.col("user_id") % 5)
    return rollups.cache_admission(log, "k", "ts", "event_id", 2, slice_seconds=DAY).select("event_id", "admitted")


@query(
    "window_limit_aligned",
    f"""SELECT event_id, r <= 2 AS allowed, greatest(0, 2 - r) AS remaining FROM (SELECT event_id,
      CAST(row_number() OVER (PARTITION BY user_id, epoch_us(ts) // {DAY * US} ORDER BY ts, event_id) AS INT) AS r FROM events)""",
)
def _(spark, sf):
    out = R.aligned_window_limit(events(spark, sf), "user_id", "ts", "event_id", limit=2, width_seconds=DAY, slice_seconds=DAY)
    return out.select("event_id", "allowed", "remaining")


@query(
    "rate_limit_stats",
    f"""WITH RECURSIVE {SLOWED}, open AS (SELECT * FROM slowed WHERE user_id % 9 <> 0 AND epoch_us(ts) % 2 <> 0),
    {window_sql(8 * US, 3, 'open').replace('st AS', 'bursts AS').replace('FROM st s', 'FROM bursts s').replace('ev AS', 'ev0 AS').replace('FROM ev e', 'FROM ev0 e').replace('JOIN ev e', 'JOIN ev0 e')},
    calm AS (SELECT event_id, k AS user_id, make_timestamp(t) AS ts FROM bursts WHERE n <= 3),
    {bucket_sql(2, 1, False, 'calm')}
    SELECT (SELECT count(*) FROM slowed) AS total, count_if(allowed) AS allowed,
      count_if(NOT allowed) + (SELECT count_if(n > 3) FROM bursts) AS limited, (SELECT count_if(n > 3) FROM bursts) AS bursts,
      (SELECT count_if(user_id % 9 = 0) FROM slowed) AS whitelisted, count_if(created) AS buckets_created, count_if(refilled) AS refills,
      (SELECT count_if(user_id % 9 <> 0 AND epoch_us(ts) % 2 = 0) FROM slowed) AS emergency_drops FROM st""",
)
def _(spark, sf):
    df = slow(events(spark, sf), SLOW).withColumn("known", F.col("user_id") % 9 == 0)
    decided = R.rate_limit(
        df, "user_id", "ts", "event_id", size=2, rate=1, burst_window_ms=8000, burst_threshold=3, whitelisted="known",
        emergency=True,
    )
    return R.limit_stats(decided)
