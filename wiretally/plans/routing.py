"""Queries over routing, traffic splits, slots, ramps and environment health."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import keys as K
from wiretally.functions.screening import is_write_query
from wiretally.operators import routing as R
from wiretally.plans.inputs import ctes, derive, load
from wiretally.plans.patterns import mix32_sql
from wiretally.plans.registry import query

STARTED = 1704067200
DAY = 86_400

BACKENDS_SQL = """SELECT s_suppkey AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' ELSE 'redis' END AS db_type,
    'host' || s_suppkey AS host, 3000 + s_suppkey AS port,
    CASE s_suppkey % 3 WHEN 2 THEN 'both' ELSE CASE s_suppkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE '' END END AS role FROM supplier"""


def backends(spark, sf):
    return spark.sql(BACKENDS_SQL.replace("FROM supplier", "FROM {s}"), s=load(spark, sf, "supplier"))


@query(
    "routed_queries",
    f"""{ctes('query_log')}, b AS ({BACKENDS_SQL}), every AS (SELECT db_type, list(host || ':' || port ORDER BY ord) AS a,
        list(host || ':' || port ORDER BY ord) FILTER (WHERE role IN ('read', '')) AS r, list(host || ':' || port ORDER BY ord) FILTER (WHERE role IN ('write', '')) AS w
      FROM b GROUP BY 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY db_type, is_write ORDER BY ts, log_id) AS turn FROM
      (SELECT *, event_type IN ('signup', 'purchase') AS is_write FROM query_log)),
    l AS (SELECT log_id, turn, coalesce(CASE WHEN is_write THEN w ELSE r END, a) AS names FROM t LEFT JOIN every USING (db_type))
    SELECT log_id, turn, names[1 + (turn - 1) % len(names)] AS backend FROM l""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log").withColumn("is_write", is_write_query(F.col("query")))
    return R.route(log, backends(spark, sf), slice_seconds=DAY).select("log_id", "turn", "backend")


def env_backends(spark, sf):
    """Positions numbered without holes per environment."""
    return load(spark, sf, "nation").select(
        (F.col("n_regionkey") + 1).alias("env_id"),
        F.floor(F.col("n_nationkey") / 5).cast("int").alias("position"),
        (F.col("n_nationkey") % 3 != 0).alias("healthy"),
    )


ENVS = """envs AS (SELECT n_regionkey + 1 AS env_id, n_nationkey // 5 AS position, n_nationkey % 3 <> 0 AS healthy FROM nation),
    env AS (SELECT env_id, count(*) AS n, list(healthy ORDER BY position) AS h, min(position) FILTER (WHERE healthy) AS spare FROM envs GROUP BY 1)"""


def split_sql(env: str) -> str:
    return f"SELECT event_id, ip, port, ts, CAST({env} AS INT) AS env_id FROM packets"


SHARE = f"({mix32_sql('ip::BIGINT', f'{STARTED}::BIGINT')} % 100)"
USER = f"({mix32_sql('ip::BIGINT', '305419896::BIGINT')} % 2)"
CANARY = f"({mix32_sql('ip::BIGINT', '((epoch_us(ts) * 1000) & 4294967295)::BIGINT')} % 100)"
PERCENT = f"CASE WHEN {SHARE} < 10 THEN 3 WHEN {SHARE} < 60 THEN 1 ELSE 2 END"


def packets(spark, sf):
    p = derive(spark, sf, "packets")
    return p.withColumn("time_ns", F.unix_micros("ts") * 1000)


def split(spark, sf, strategy):
    return R.split_traffic(
        packets(spark, sf), strategy=strategy, primary=1, secondary=2, canary=3, split_ratio=60, canary_ratio=10,
        started=STARTED,
    )


@query("split_percentage", f"{ctes('packets')} SELECT event_id, env_id FROM ({split_sql(PERCENT)})")
def _(spark, sf):
    return split(spark, sf, "percentage").select("event_id", "env_id")


@query("split_by_user", f"{ctes('packets')} SELECT event_id, env_id FROM ({split_sql(f'CASE WHEN {USER} = 0 THEN 1 ELSE 2 END')})")
def _(spark, sf):
    return split(spark, sf, "user_based").select("event_id", "env_id")


@query("split_canary", f"{ctes('packets')} SELECT event_id, env_id FROM ({split_sql(f'CASE WHEN {CANARY} < 10 THEN 3 ELSE 1 END')})")
def _(spark, sf):
    return split(spark, sf, "canary").select("event_id", "env_id")


HASHED = mix32_sql("ip::BIGINT", "port::BIGINT")
CHOSEN = f"""{ctes('packets')}, {ENVS}, s AS ({split_sql(PERCENT)}), c AS (SELECT s.*,
      s.env_id::BIGINT * 4294967296 + CASE WHEN e.h[1 + {HASHED} % e.n] THEN {HASHED} % e.n ELSE e.spare END AS first,
      2::BIGINT * 4294967296 + CASE WHEN f.h[1 + {HASHED} % f.n] THEN {HASHED} % f.n ELSE f.spare END AS second
    FROM s LEFT JOIN env e ON e.env_id = s.env_id LEFT JOIN env f ON f.env_id = 2),
  d AS (SELECT *, env_id = 1 AND first IS NULL AND second IS NOT NULL AS failed_over,
    CAST(CASE WHEN first IS NULL AND env_id = 1 THEN second ELSE first END AS BIGINT) AS backend_id FROM c)"""


def chosen(spark, sf):
    return R.choose_backend(split(spark, sf, "percentage"), env_backends(spark, sf), primary=1, secondary=2)


@query("chosen_backends", f"{CHOSEN} SELECT event_id, backend_id, failed_over FROM d")
def _(spark, sf):
    return chosen(spark, sf).select("event_id", "backend_id", "failed_over")


STUCK = f"""{CHOSEN}, firsts AS (SELECT ip, event_id % 40 AS p, arg_min(backend_id, (ts, event_id)) AS b, min((ts, event_id)) AS since
    FROM d WHERE backend_id IS NOT NULL GROUP BY 1, 2),
  stuck AS (SELECT d.event_id, env_id, failed_over, coalesce((d.ts, d.event_id) > since AND d.event_id % 40 > 0, false) AS session_hit,
    CASE WHEN coalesce((d.ts, d.event_id) > since AND d.event_id % 40 > 0, false) THEN b ELSE backend_id END AS backend_id
    FROM d LEFT JOIN firsts f ON f.ip = d.ip AND f.p = d.event_id % 40)"""


def stuck(spark, sf):
    routed = chosen(spark, sf).withColumn("port", (F.col("event_id") % 40).cast("int"))
    return R.sticky(routed, tie="event_id")


@query("sticky_sessions", f"{STUCK} SELECT event_id, backend_id, session_hit FROM stuck")
def _(spark, sf):
    return stuck(spark, sf).select("event_id", "backend_id", "session_hit")


@query(
    "split_stats",
    f"""{STUCK} SELECT count(*) AS total, count_if(backend_id IS NOT NULL AND env_id = 1) AS blue,
      count_if(backend_id IS NOT NULL AND env_id = 2) AS green, count_if(backend_id IS NOT NULL AND env_id = 3) AS canary,
      count_if(backend_id IS NULL) AS failed, count_if(failed_over) AS failovers, count_if(session_hit) AS session_hits,
      count_if(NOT session_hit) AS session_misses FROM stuck""",
)
def _(spark, sf):
    return R.split_stats(stuck(spark, sf), primary=1, secondary=2, canary=3)


@query(
    "environment_health",
    f"""WITH {ENVS} SELECT env_id, healthy, total, round(healthy / total, 6) AS ratio,
      CASE WHEN healthy / total >= 0.8 THEN 'healthy' WHEN healthy / total >= 0.5 THEN 'degraded' ELSE 'unhealthy' END AS state
    FROM (SELECT env_id, count_if(healthy) AS healthy, count(*) AS total FROM envs GROUP BY 1)""",
)
def _(spark, sf):
    return R.env_health(env_backends(spark, sf))


@query(
    "supplier_fail_over",
    """SELECT count_if(s_acctbal > 2000) / count(*) < 0.5 AS fail_over FROM supplier WHERE s_nationkey % 3 = 1""",
)
def _(spark, sf):
    fleet = load(spark, sf, "supplier").select(
        (F.col("s_nationkey") % 3).alias("env_id"), (F.col("s_acctbal") > 2000).alias("healthy")
    )
    return R.must_fail_over(R.env_health(fleet), primary=1)


@query(
    "ramp_asof",
    f"""WITH ramps AS (SELECT user_id % 20 AS deployment, min(ts) AS start FROM events GROUP BY 1),
    steps AS (SELECT deployment, start + i * INTERVAL 36 HOURS AS at, i * 10 AS pct FROM ramps, range(0, 11) t(i))
    SELECT event_id, CAST(coalesce(pct, 0) AS INT) AS percentage, {mix32_sql('user_id::BIGINT', '0::BIGINT')} % 100 < coalesce(pct, 0) AS moved
    FROM events e ASOF LEFT JOIN steps s ON e.user_id % 20 = s.deployment AND e.ts >= s.at""",
)
def _(spark, sf):
    log = load(spark, sf, "events").withColumn("deployment", F.col("user_id") % 20)
    ramps = log.groupBy("deployment").agg(F.min("ts").alias("started_at")).withColumn(
        "duration_us", F.lit(15 * DAY * 1_000_000)
    )
    return R.ramp_split(log, ramps, ip="user_id").select("event_id", "percentage", "moved")


# --- slots -------------------------------------------------------------------------------------------------

TOPOLOGY_SQL = """SELECT s_suppkey, 'n' || lpad(CAST(s_suppkey AS VARCHAR(9)), 4, '0') || ' 10.1.' || s_nationkey || '.' || s_suppkey || ':7' || s_suppkey || '@17000 '
      || CASE WHEN s_suppkey % 3 = 0 THEN 'master' ELSE 'slave' END || CASE WHEN s_suppkey % 10 = 4 THEN ',fail' ELSE '' END || ' '
      || CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE 'n' || lpad(CAST(s_suppkey - s_suppkey % 3 AS VARCHAR(9)), 4, '0') END
      || ' 0 1 2 ' || CASE WHEN s_suppkey % 7 = 6 THEN '' ELSE 'connected' END
      || CASE WHEN s_suppkey % 3 = 0 THEN ' ' || (s_suppkey // 3 * 400) || '-' || (s_suppkey // 3 * 400 + 380) || ' ' || (s_suppkey // 3 * 400 + 390) ELSE '' END AS line FROM supplier"""


def topology(spark, sf):
    text = TOPOLOGY_SQL.replace("//", "div").replace("FROM supplier", "FROM {s}")
    return spark.sql(text, s=load(spark, sf, "supplier"))


@query(
    "cluster_nodes",
    """SELECT 'n' || lpad(s_suppkey::VARCHAR, 4, '0') AS node_id, '10.1.' || s_nationkey || '.' || s_suppkey AS host, ('7' || s_suppkey)::INT AS port,
      s_suppkey % 3 = 0 AS is_master, s_suppkey % 10 <> 4 AS healthy,
      CASE WHEN s_suppkey % 3 <> 0 THEN 'n' || lpad((s_suppkey - s_suppkey % 3)::VARCHAR, 4, '0') END AS master_id,
      CAST(CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 7 = 6 THEN 1 ELSE 2 END ELSE 0 END AS INT) AS n_ranges
    FROM supplier WHERE NOT (s_suppkey % 7 = 6 AND s_suppkey % 3 <> 0)""",
)
def _(spark, sf):
    nodes = R.parse_topology(topology(spark, sf))
    return nodes.withColumn("n_ranges", F.size("slots")).drop("slots", "s_suppkey")


@query(
    "routed_slots",
    """WITH nodes AS (SELECT s_suppkey, 'n' || lpad(s_suppkey::VARCHAR, 4, '0') AS id, s_suppkey % 3 = 0 AS master, s_suppkey % 10 <> 4 AS ok,
        s_suppkey % 7 = 6 AS short FROM supplier WHERE NOT (s_suppkey % 7 = 6 AND s_suppkey % 3 <> 0)),
      owners AS (SELECT *, s_suppkey // 3 * 400 AS lo FROM nodes WHERE master),
      reps AS (SELECT s_suppkey - s_suppkey % 3 AS m, min(id) AS rep FROM nodes WHERE NOT master AND ok GROUP BY 1),
      req AS (SELECT event_id, (event_id * 37) % 16384 AS slot, event_type IN ('view', 'click') AS is_read FROM events),
      spare AS (SELECT min(id) AS id FROM nodes WHERE master AND ok)
    SELECT event_id, CAST(slot AS INT) AS slot, coalesce(CASE WHEN o.ok THEN CASE WHEN is_read THEN coalesce(rep, o.id) ELSE o.id END END, (SELECT id FROM spare)) AS node
    FROM req LEFT JOIN owners o ON CASE WHEN o.short THEN slot = lo + 390 ELSE slot BETWEEN lo AND lo + 380 OR slot = lo + 390 END
      LEFT JOIN reps ON m = o.s_suppkey""",
)
def _(spark, sf):
    requests = load(spark, sf, "events").select(
        "event_id", (F.col("event_id") * 37 % K.SLOTS).cast("int").alias("slot"),
        F.col("event_type").isin("view", "click").alias("is_read"),
    )
    return R.route_slot(requests, R.parse_topology(topology(spark, sf))).select("event_id", "slot", "node")


@query(
    "serving_provider",
    """SELECT operation_id, arg_min(provider, (prio, ord)) FILTER (WHERE ok) AS provider FROM (SELECT l_orderkey AS operation_id,
        'prov' || (l_suppkey % 4) AS provider, CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS prio, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS ord,
        l_returnflag <> 'R' AS ok FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber, l_partkey, l_returnflag FROM lineitem)) GROUP BY 1""",
)
def _(spark, sf):
    attempts = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS operation_id", "'prov' || (l_suppkey % 4) AS provider", "l_linenumber = 1 AS is_primary",
        "CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS ord", "l_returnflag <> 'R' AS ok",
    )
    return R.served_by(attempts)
