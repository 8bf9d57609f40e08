"""Queries over counters, caches, multi-writes, providers, backups and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.functions.fingerprint import primary_table, sql_operation
from wiretally.operators import latency as L
from wiretally.operators import matching as M
from wiretally.operators import rollups as A
from wiretally.operators import tuning as T
from wiretally.plans.access import SERVERS_SQL, blocked_ips, servers
from wiretally.plans.inputs import AS_OF, as_of, ctes, derive, load, permissions
from wiretally.plans.patterns import ema_sql
from wiretally.plans.registry import query

DAY = 86_400


def ts(text: str):
    return F.lit(text).cast("timestamp")


# --- control plane -------------------------------------------------------------------------------------------


@query(
    "overview",
    f"""{ctes('permissions')}, s AS ({SERVERS_SQL}) SELECT (SELECT count_if(active) FROM s) AS active_servers,
      (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM permissions) AS permissions,
      (SELECT count_if(p_size > 10) FROM part) AS active_rules, (SELECT count(*) FROM events) AS queries""",
)
def _(spark, sf):
    rules = load(spark, sf, "part").select((F.col("p_size") > 10).alias("active"))
    return A.overview(
        servers(spark, sf), load(spark, sf, "customer"), permissions(spark, sf), rules, load(spark, sf, "events")
    )


@query(
    "servers_by_type",
    f"""WITH s AS ({SERVERS_SQL}), t(type) AS (VALUES ('mysql'), ('postgresql'), ('mssql'), ('mongodb'), ('redis'))
    SELECT type, count(server_id) AS servers FROM t LEFT JOIN (SELECT * FROM s WHERE active) USING (type) GROUP BY 1""",
)
def _(spark, sf):
    return A.servers_by_type(servers(spark, sf))


@query(
    "blocking_stats",
    """WITH r AS (SELECT p_size > 10 AS active, CASE p_partkey % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'username' ELSE 'table' END AS kind FROM part)
    SELECT count(*) AS total, count_if(active) AS active, count_if(active AND kind = 'database') AS active_database,
      count_if(active AND kind = 'username') AS active_username, count_if(active AND kind = 'table') AS active_table FROM r""",
)
def _(spark, sf):
    kind = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'username' ELSE 'table' END")
    return A.blocking_stats(load(spark, sf, "part").select((F.col("p_size") > 10).alias("active"), kind.alias("kind")))


@query(
    "seeded_rules",
    f"""WITH r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'username' END AS kind FROM part)
    SELECT kind, count(*) AS n FROM (SELECT kind FROM r UNION ALL
      SELECT kind FROM (VALUES {', '.join(f"('{k}')" for k, _, _ in packs.DEFAULT_BLOCKED)}) d(kind) WHERE NOT EXISTS (SELECT 1 FROM r)) GROUP BY 1""",
)
def _(spark, sf):
    current = load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "table").otherwise("username").alias("kind"), F.col("p_name").alias("pattern"),
        F.lit("").alias("reason"), F.lit(True).alias("active"),
    )
    return M.seed_rules(current).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


HEALTH_CASE = """CASE user_id % 7 WHEN 0 THEN 'xdp_controller' WHEN 1 THEN 'cache_manager' WHEN 2 THEN 'redis_cluster'
    WHEN 3 THEN 'deployment_manager' ELSE 'other' END"""


@query(
    "system_health",
    f"""WITH l AS (SELECT {HEALTH_CASE} AS component, arg_max(CASE event_type WHEN 'error' THEN 'down' ELSE 'healthy' END, ts) AS status FROM events GROUP BY 1),
      f(component) AS (VALUES {', '.join(f"('{c}')" for c in packs.COMPONENTS)}),
      m AS (SELECT count_if(coalesce(status, 'unknown') <> 'healthy') AS not_healthy, count(*) AS components FROM f LEFT JOIN l USING (component))
    SELECT *, CASE WHEN not_healthy = 0 THEN 'healthy' WHEN not_healthy < components / 2 THEN 'degraded' ELSE 'unhealthy' END AS status FROM m""",
)
def _(spark, sf):
    status = load(spark, sf, "events").select(
        F.expr(HEALTH_CASE).alias("component"), "ts", F.when(F.col("event_type") == "error", "down").otherwise("healthy").alias("status")
    )
    return A.system_health(status)


@query(
    "dashboard",
    f"""{ctes('cache_log')} SELECT (SELECT count(*) FROM events) AS total_requests, round((SELECT count_if(outcome = 'hit') / count(*) FROM cache_log), 6) AS cache_hit_ratio,
      (SELECT count_if(o_orderstatus = 'O') FROM orders) AS active_deployments,
      (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) AS blocked_ips,
      (SELECT count_if(s_acctbal > 0) FROM supplier) AS healthy_nodes, (SELECT count(*) FROM supplier) AS total_nodes""",
)
def _(spark, sf):
    cache = derive(spark, sf, "cache_log").select((F.col("outcome") == "hit").alias("hit"))
    deployments = load(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("done").alias("status")
    )
    nodes = load(spark, sf, "supplier").select((F.col("s_acctbal") > 0).alias("healthy"))
    return A.dashboard(load(spark, sf, "events"), cache, deployments, blocked_ips(spark, sf), nodes)


# --- events --------------------------------------------------------------------------------------------------

BOUNDS = packs.LATENCY_BOUNDS


@query(
    "latency_histogram",
    f"""{ctes('query_log')}, w AS (SELECT db_type, event_type, count(*) AS "count", round(sum(latency), 4) AS "sum",
        [{', '.join(f"{{'le': '{b}', 'n': count(*) FILTER (WHERE latency <= {b})}}" for b in BOUNDS)}, {{'le': '+Inf', 'n': count(*)}}] AS b
      FROM query_log GROUP BY 1, 2)
    SELECT db_type, event_type, u.le, u.n, "count", "sum" FROM (SELECT *, unnest(b) AS u FROM w)""",
)
def _(spark, sf):
    histogram = A.latency_histogram(derive(spark, sf, "query_log"), ["db_type", "event_type"], "latency")
    return histogram.withColumn("sum", F.round("sum", 4))


COUNTER_SQL = """SELECT CASE event_id % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'open' WHEN 2 THEN 'close' WHEN 3 THEN 'auth_failure' WHEN 4 THEN 'injection'
    WHEN 5 THEN 'backend_error' ELSE 'other' END AS event, 'db' || (user_id % 4) AS label FROM events"""


@query(
    "counters",
    f"""WITH e AS ({COUNTER_SQL}) SELECT CASE event WHEN 'open' THEN 'connections' WHEN 'close' THEN 'connections' WHEN 'auth_failure' THEN 'auth_failures'
      WHEN 'injection' THEN 'injection_attempts' ELSE 'backend_errors' END AS counter, label,
      CAST(sum(CASE event WHEN 'close' THEN -1 ELSE 1 END) AS BIGINT) AS value FROM e WHERE event <> 'other' GROUP BY 1, 2""",
)
def _(spark, sf):
    return A.counter_rollup(spark.sql(COUNTER_SQL.replace("FROM events", "FROM {e}"), e=load(spark, sf, "events")))


@query(
    "span_stats",
    f"""{ctes('query_log')}, s AS (SELECT database, split_part(query, ' ', 1) AS operation,
        CASE event_type WHEN 'error' THEN 'users' WHEN 'signup' THEN 'accounts' WHEN 'purchase' THEN 'carts' ELSE 'shop.orders' END AS tab,
        event_type = 'error' AS error, CAST(round(value * 10) AS BIGINT) AS ms FROM query_log)
    SELECT database, operation, tab AS "table", count(*) AS spans, count_if(error) AS errors, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS max_ms FROM s GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    q = F.col("query")
    table = F.when(F.col("event_type") == "purchase", F.lit("carts")).otherwise(primary_table(q))
    spans = derive(spark, sf, "query_log").select(
        "database", sql_operation(q).alias("operation"), table.alias("table"), (F.col("event_type") == "error").alias("error"),
        F.round(F.col("value") * 10).cast("bigint").alias("duration_ms"),
    )
    return A.span_stats(spans).drop("p95_ms")


RANK_ERROR = 0.02  # of a quantile of a sketch


@query(
    "span_percentiles",
    f"""{ctes('query_log')} SELECT database, event_type = 'error' AS faulty, count(*) AS spans, true AS p95_in_place FROM query_log GROUP BY 1, 2""",
)
def _(spark, sf):
    """Whether the 95th percentile of each group's sketch stands within the rank error of its place among the group's spans."""
    spans = derive(spark, sf, "query_log").select(
        "database", F.lit("any").alias("operation"), (F.col("event_type") == "error").alias("table"), (F.col("event_type") == "error").alias("error"),
        (F.col("value") * 10).alias("duration_ms"),
    )
    ranks = A.span_ranks(spans, A.span_stats(spans), "p95_ms")
    fits = (F.col("below") <= 0.95 + RANK_ERROR) & (F.col("upto") >= 0.95 - RANK_ERROR)
    return ranks.select("database", F.col("table").alias("faulty"), "spans", fits.alias("p95_in_place"))


@query("sampled_traces", "SELECT event_id, user_id::VARCHAR AS trace_id FROM events WHERE ('0x' || substr(md5(user_id::VARCHAR), 1, 13))::BIGINT < 0.25 * 4503599627370496")
def _(spark, sf):
    events = load(spark, sf, "events").withColumn("trace_id", F.col("user_id").cast("string"))
    return A.sample_spans(events, 0.25).select("event_id", "trace_id")


SECURITY_SQL = """SELECT 'type' || (event_id % 3) AS type, CASE event_type WHEN 'error' THEN 'critical' ELSE 'warning' END AS level,
    CASE user_id % 2 WHEN 0 THEN 'block' ELSE 'log' END AS action, 'user_' || (user_id % 30) AS username,
    '10.0.0.' || (user_id % 8) AS source_ip, CASE event_id % 5 WHEN 0 THEN 'failure' ELSE 'success' END AS result FROM events"""


def security(spark, sf):
    return spark.sql(SECURITY_SQL.replace("FROM events", "FROM {e}"), e=load(spark, sf, "events"))


@query(
    "security_event_counts",
    f"""WITH e AS ({SECURITY_SQL}) SELECT type, level, action, CAST(grouping(type, level, action) AS BIGINT) AS "grouping", count(*) AS n
    FROM e GROUP BY CUBE (type, level, action)""",
)
def _(spark, sf):
    return A.security_event_counts(security(spark, sf))


@query(
    "auth_attempts",
    f"WITH e AS ({SECURITY_SQL}) SELECT username, source_ip, result, count(*) AS attempts FROM e GROUP BY ALL",
)
def _(spark, sf):
    return A.auth_attempts(security(spark, sf))


FAMILY = """CASE event_id % 8 WHEN 0 THEN 'processed' WHEN 1 THEN 'processed' WHEN 2 THEN 'dropped' WHEN 3 THEN 'passed'
    WHEN 4 THEN 'aborted' WHEN 5 THEN 'redirected' WHEN 6 THEN 'cache_hit' ELSE 'cache_miss' END"""


@query(
    "traffic_rollup",
    f"""WITH p AS (SELECT 'eth' || (user_id % 4) AS interface, {FAMILY} AS family, floor(value) AS value FROM events),
    t AS (SELECT interface, {', '.join(f"coalesce(sum(value) FILTER (WHERE family = '{f}'), 0)::DOUBLE AS {f}" for f in ('processed', 'dropped', 'passed', 'aborted', 'redirected', 'cache_hit', 'cache_miss'))} FROM p GROUP BY 1)
    SELECT *, round(cache_hit / (cache_hit + cache_miss), 6) AS hit_ratio, round((aborted + dropped) / processed, 6) AS error_rate FROM t""",
)
def _(spark, sf):
    points = load(spark, sf, "events").select(
        F.concat(F.lit("eth"), F.col("user_id") % 4).alias("interface"), F.expr(FAMILY).alias("family"),
        F.floor("value").cast("double").alias("value"),
    )
    return A.traffic_rollup(points)


@query(
    "counter_families",
    """WITH p AS (SELECT 'eth' || (user_id % 3) AS interface, event_type || '_' || (event_id % 11) AS family, event_id % 11 < 8 AS counting, ts, value FROM events WHERE event_id % 11 < 10)
    SELECT interface, family, CASE WHEN counting THEN 'counter' ELSE 'gauge' END AS kind, count(*) AS points, round(CASE WHEN counting THEN sum(value) ELSE arg_max(value, (ts, value)) END, 4)::DOUBLE AS value,
      round(CASE WHEN counting THEN sum(value) / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0, 0) END, 9)::DOUBLE AS per_second FROM p GROUP BY interface, family, counting""",
)
def _(spark, sf):
    """Fifty families of counters and gauges that a table names, by interface; points of a fifty-first kind are left out."""
    named = load(spark, sf, "events").select(F.col("event_type"), (F.col("event_id") % 11).alias("k")).distinct().where("k < 10")
    families = named.select(F.concat_ws("_", "event_type", "k").alias("family"), F.when(F.col("k") < 8, "counter").otherwise("gauge").alias("kind"))
    points = load(spark, sf, "events").select(
        F.concat(F.lit("eth"), F.col("user_id") % 3).alias("interface"), F.concat_ws("_", "event_type", F.col("event_id") % 11).alias("family"), "ts", "value"
    )
    found = A.counter_families(points, families, ["interface"])
    return found.withColumn("value", F.round("value", 4)).withColumn("per_second", F.round("per_second", 9))


@query("feature_usage", "SELECT user_id, event_type AS feature, count(*) AS uses FROM events GROUP BY 1, 2")
def _(spark, sf):
    return A.feature_usage(load(spark, sf, "events").withColumnRenamed("event_type", "feature"))


@query(
    "metric_map",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN NULL ELSE NULL END AS number, event_id % 3 <> 2 AS is_json FROM events""",
)
def _(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(
        F.col("event_id") % 3 == 1, F.col("props")
    ).otherwise(F.concat(F.lit("up since "), F.col("event_type")))
    parsed = A.parse_metric_map(load(spark, sf, "events").select("event_id", text.alias("value")))
    return parsed.select("event_id", "number", "is_json")


# --- cache ----------------------------------------------------------------------------------------------------


@query(
    "cache_rollup",
    f"""{ctes('cache_log')} SELECT tier, policy, CAST(grouping(tier, policy) AS BIGINT) AS "grouping", count(*) AS requests, count_if(outcome = 'hit') AS hits,
      count_if(outcome = 'miss') AS misses, count_if(outcome = 'auth_failure') AS auth_failures, round(count_if(outcome = 'hit') / count(*), 6) AS hit_ratio
    FROM cache_log GROUP BY ROLLUP (tier, policy)""",
)
def _(spark, sf):
    return A.cache_stats(derive(spark, sf, "cache_log"))


@query(
    "hot_keys",
    f"""{ctes('cache_log')} SELECT cache_key, epoch_us(max(ts)) AS last_used_us, count(*) AS uses FROM cache_log GROUP BY 1 ORDER BY max(ts) DESC, cache_key LIMIT 10""",
)
def _(spark, sf):
    return A.hot_keys(derive(spark, sf, "cache_log")).select(
        "cache_key", F.unix_micros("last_used").alias("last_used_us"), "uses"
    )


@query(
    "lru_evict",
    f"""{ctes('cache_entries')}, r AS (SELECT entry_id, sum(size) OVER w AS bytes, row_number() OVER w AS rank, sum(size) OVER () AS total FROM cache_entries
      WINDOW w AS (ORDER BY created_at DESC, entry_id DESC ROWS UNBOUNDED PRECEDING))
    SELECT entry_id, (total > 1000000000 AND bytes > 900000000) OR rank >= 4000 AS evicted FROM r""",
)
def _(spark, sf):
    entries = derive(spark, sf, "cache_entries")
    marked = A.evict_lru(
        entries, "created_at", "entry_id", "size", max_bytes=1_000_000_000, max_entries=4000, slice_seconds=30 * DAY
    )
    return marked.select("entry_id", "evicted")


STALE_AT = "1998-06-01 00:00:00"


@query(
    "stale_entries",
    f"""{ctes('cache_entries')}, w AS (SELECT 'table' || (l_partkey % 70) AS "table", max(l_shipdate - to_days(CAST(l_partkey % 70 * 50 AS INT))) AS w FROM lineitem GROUP BY 1)
    SELECT entry_id, coalesce(w > created_at, false) OR epoch_us(TIMESTAMP '{STALE_AT}') - epoch_us(created_at) >= ttl_s * 1000000 AS stale
    FROM cache_entries LEFT JOIN w USING ("table")""",
)
def _(spark, sf):
    earlier = F.expr("l_shipdate - make_dt_interval(CAST(l_partkey % 70 * 50 AS INT))")  # tables differ in how long ago they were written last
    writes = load(spark, sf, "lineitem").select(F.concat(F.lit("table"), F.col("l_partkey") % 70).alias("table"), earlier.alias("written_at"))
    return A.stale_entries(derive(spark, sf, "cache_entries"), writes, ts(STALE_AT)).select("entry_id", "stale")


@query(
    "cache_survivors",
    f"""{ctes('cache_entries')} SELECT entry_id FROM cache_entries WHERE NOT (database = 'db1' OR "table" = 'table7'
      OR regexp_full_match(cache_key, 'k1.*9')) AND NOT (entry_id % 50 = 3)""",
)
def _(spark, sf):
    entries = derive(spark, sf, "cache_entries").withColumn(
        "allowed_users", F.array(F.concat(F.lit("u"), F.col("entry_id") % 50))
    )
    return A.invalidate(entries, user="u3", database="db1", table="table7", pattern="k1*9").select("entry_id")


# --- multi-write ----------------------------------------------------------------------------------------------


@query(
    "write_quorum",
    f"""{ctes('write_results')}, g AS (SELECT request_id, strategy, count_if(enabled) AS clusters, count_if(enabled AND status = 'ok') AS succeeded,
        bool_or(is_primary AND status = 'ok') AS primary_ok FROM write_results WHERE enabled OR is_primary GROUP BY 1, 2)
    SELECT *, CASE strategy WHEN 'sync' THEN succeeded = clusters WHEN 'quorum' THEN succeeded >= clusters // 2 + 1 ELSE primary_ok END AS success FROM g""",
)
def _(spark, sf):
    return A.write_outcome(derive(spark, sf, "write_results"))


@query(
    "write_stats",
    f"""{ctes('write_results')} SELECT strategy, cluster, count(*) AS writes, count_if(status = 'ok') AS successes, count_if(status <> 'ok') AS failures,
      CAST(sum(retries) AS BIGINT) AS retries, epoch_us(max(written_at)) AS last_write_us FROM write_results GROUP BY GROUPING SETS ((strategy), (cluster))""",
)
def _(spark, sf):
    stats = A.write_stats(derive(spark, sf, "write_results"))
    return stats.withColumn("last_write_us", F.unix_micros("last_write")).drop("last_write")


@query(
    "job_stats",
    "SELECT count_if(o_orderstatus = 'F') AS completed, count_if(o_orderstatus = 'P') AS failed FROM orders",
)
def _(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed")
    return A.job_stats(load(spark, sf, "orders").select(status.otherwise("open").alias("status")))


# --- nodes, providers, backups, feeds ---------------------------------------------------------------------------


@query(
    "node_stats",
    """SELECT count(*) AS total, count_if(s_suppkey % 3 = 0) AS masters, count_if(s_suppkey % 3 <> 0) AS replicas, count_if(s_acctbal > 0) AS healthy,
      round(avg(s_acctbal - 500) FILTER (WHERE s_acctbal > 0 AND s_acctbal > 500), 6) AS avg_latency_ms FROM supplier""",
)
def _(spark, sf):
    return A.node_stats(
        load(spark, sf, "supplier").selectExpr("s_suppkey % 3 = 0 AS is_master", "s_acctbal > 0 AS healthy", "s_acctbal - 500 AS latency_ms")
    )


START, END = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


@query(
    "provider_metrics",
    f"""SELECT 'prov' || (user_id % 4) AS provider, event_type AS metric, count(*) AS points, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value
    FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' GROUP BY 1, 2""",
)
def _(spark, sf):
    points = load(spark, sf, "events").select(
        F.concat(F.lit("prov"), F.col("user_id") % 4).alias("provider"), F.col("event_type").alias("metric"), "ts", "value"
    )
    return A.provider_metrics(points, ts(START), ts(END))


@query(
    "provider_costs",
    f"""SELECT provider, service, CAST(grouping(provider, service) AS BIGINT) AS "grouping", round(sum(value), 2) AS cost FROM (
      SELECT 'prov' || (user_id % 4) AS provider, event_type AS service, value FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}')
    GROUP BY ROLLUP (provider, service)""",
)
def _(spark, sf):
    costs = load(spark, sf, "events").select(
        F.concat(F.lit("prov"), F.col("user_id") % 4).alias("provider"), F.col("event_type").alias("service"), "ts",
        F.col("value").alias("cost"),
    )
    return A.provider_costs(costs, ts(START), ts(END))


@query(
    "provider_gaps",
    """WITH inv AS (SELECT DISTINCT 'prov' || (l_suppkey % 4) AS provider, 'db' || l_orderkey AS name FROM lineitem)
    SELECT p.provider, i.name FROM (SELECT DISTINCT provider FROM inv WHERE provider <> 'prov0') p, (SELECT name FROM inv WHERE provider = 'prov0') i
    EXCEPT SELECT provider, name FROM inv""",
)
def _(spark, sf):
    inventory = load(spark, sf, "lineitem").selectExpr(
        "'prov' || (l_suppkey % 4) AS provider", "'db' || l_orderkey AS name"
    )
    return A.provider_gaps(inventory, "prov0")


RUN_SQL = """SELECT o_orderkey AS backup_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
    CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS started_at, 'a' || (o_orderkey % 9000) AS archive_path FROM orders"""


def backup_runs(spark, sf):
    return spark.sql(RUN_SQL.replace("FROM orders", "FROM {o}"), o=load(spark, sf, "orders"))


@query(
    "backup_stats",
    f"""WITH r AS ({RUN_SQL}) SELECT count(*) AS total, count_if(status = 'completed') AS succeeded, count_if(status = 'failed') AS failed,
      CAST(sum(size) FILTER (WHERE status = 'completed') AS BIGINT) AS total_size, round(avg(size) FILTER (WHERE status = 'completed'), 6) AS avg_size,
      arg_max(status, (started_at, backup_id)) AS last_status FROM r""",
)
def _(spark, sf):
    return A.backup_stats(backup_runs(spark, sf))


@query(
    "restore_points",
    f"WITH r AS ({RUN_SQL}) SELECT backup_id FROM r WHERE archive_path IN (SELECT CASE l_returnflag WHEN 'R' THEN 'a' ELSE 'gone/a' END || l_orderkey FROM lineitem)",
)
def _(spark, sf):
    folder = F.when(F.col("l_returnflag") == "R", "a").otherwise("gone/a")
    archives = load(spark, sf, "lineitem").select(F.concat(folder, "l_orderkey").alias("path"))
    return A.restore_points(backup_runs(spark, sf), archives).select("backup_id")


@query(
    "retained_events",
    f"SELECT count(*) AS kept, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS",
)
def _(spark, sf):
    kept = A.apply_retention(load(spark, sf, "events"), "ts", 7, as_of())
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("first_id"))


@query(
    "threat_stats",
    f"""{ctes('indicators')} SELECT count(*) AS total, {', '.join(f"count_if(type = '{k}') AS {k}_count" for k in ('ip', 'domain', 'url', 'hash', 'email'))},
      count(DISTINCT feed) AS active_feeds, max(id) AS last_update FROM indicators""",
)
def _(spark, sf):
    return A.threat_stats(derive(spark, sf, "indicators").withColumn("last_seen", F.col("id")))


FEED_RUNS = """SELECT event_id AS run_id, ts, 'feed' || (user_id % 12) AS feed, event_type <> 'error' AS ok, value / 10.0 AS seconds,
    event_id % 30 AS new_indicators FROM events"""


@query(
    "feed_stats",
    f"""WITH r AS ({FEED_RUNS}), firsts AS (SELECT feed, arg_min(seconds, (ts, run_id)) AS s0 FROM r GROUP BY 1),
      e AS ({ema_sql('r', 'feed', 'seconds', 0.5, 'ts, run_id')})
    SELECT feed, count(*) AS updates, count_if(ok) AS succeeded, count_if(NOT ok) AS failed, round(count_if(NOT ok) / count(*), 6) AS error_rate,
      epoch_us(max(ts)) AS last_update_us, CAST(sum(new_indicators) AS BIGINT) AS new_indicators, round(any_value(ema) + any_value(s0) * pow(0.5, count(*)), 6) AS running_average
    FROM r JOIN firsts USING (feed) JOIN e USING (feed) GROUP BY 1""",
)
def _(spark, sf):
    runs = spark.sql(FEED_RUNS.replace("FROM events", "FROM {e}"), e=load(spark, sf, "events"))
    stats = A.feed_stats(runs, slice_seconds=DAY)
    return stats.withColumn("last_update_us", F.unix_micros("last_update")).withColumn(
        "running_average", F.round("running_average", 6)
    ).drop("last_update")


# --- series, tuner, scaling -------------------------------------------------------------------------------------


@query(
    "metric_trend",
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
    f AS (SELECT user_id, count(*) AS n, regr_slope(value, -r) AS slope, regr_r2(value, -r) AS r2 FROM r GROUP BY 1)
    SELECT user_id, n, round(slope, 6) AS slope, CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction,
      round(greatest(0, r2), 6) AS confidence FROM f WHERE n >= 10""",
)
def _(spark, sf):
    found = T.trend(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")
    return found.withColumn("slope", F.round("slope", 6)).withColumn("confidence", F.round("confidence", 6))


@query(
    "rule_success",
    f"""WITH r AS (SELECT user_id % 10 AS rule, ts, event_id, (event_type <> 'error')::INT AS ok FROM events)
    SELECT rule, n, round(ema, 6) AS success_rate FROM ({ema_sql('r', 'rule', 'ok', 0.1, 'ts, event_id')})""",
)
def _(spark, sf):
    runs = load(spark, sf, "events").withColumn("rule", F.col("user_id") % 10).withColumn("ok", F.col("event_type") != "error")
    rates = T.rule_success(runs, "rule", "ts", "event_id", "ok", slice_seconds=DAY)
    return rates.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "counter_rate",
    """WITH p AS (SELECT event_id, user_id % 6 AS k, ts, event_id * 10 + event_id % 7 * 100 AS v FROM events),
    l AS (SELECT *, lag(ts) OVER w AS pt, lag(v) OVER w AS pv FROM p WINDOW w AS (PARTITION BY k ORDER BY ts, event_id))
    SELECT event_id, round(CASE WHEN v >= pv THEN (v - pv) / nullif((epoch_us(ts) - epoch_us(pt)) / 1000000.0, 0) END, 6) AS rate FROM l""",
)
def _(spark, sf):
    points = load(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 6).alias("k"), "ts", (F.col("event_id") * 10 + F.col("event_id") % 7 * 100).alias("v")
    )
    rates = T.counter_rate(points, "k", "ts", "event_id", "v", slice_seconds=DAY)
    return rates.select("event_id", F.round("rate", 6).alias("rate"))


SNAPSHOTS = """SELECT event_id AS snapshot_id, value / 500.0 AS cache_hit_ratio, (event_id % 100) / 100.0 AS memory_pressure,
    value / 10000.0 AS latency_p95, value / 8000.0 AS latency_p99, (event_id % 9) / 100.0 AS error_rate,
    event_id * 20000.0 AS packets_per_second, (user_id % 10) / 10.0 AS numa_efficiency FROM events"""
METRICS = ["cache_hit_ratio", "memory_pressure", "latency_p95", "latency_p99", "error_rate", "packets_per_second", "numa_efficiency"]


def snapshots(spark, sf):
    return spark.sql(SNAPSHOTS.replace("FROM events", "FROM {e}"), e=load(spark, sf, "events"))


def _share(conditions) -> str:
    total = sum(w for *_, w in conditions)
    ops = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<="}
    met = [f"CASE WHEN {m} {ops[o]} {v} THEN {w} ELSE 0 END" for m, o, v, w in conditions if m in METRICS] or ["0"]
    return f"(({' + '.join(met)})::DOUBLE / {total}::DOUBLE)"


@query(
    "tuner_rules",
    f"""WITH s AS ({SNAPSHOTS}), r AS ({' UNION ALL '.join(f"SELECT snapshot_id, '{name}' AS name, {p} AS priority, {_share(c)} AS share FROM s" for name, p, _, c in packs.TUNING_RULES)})
    SELECT snapshot_id, name, priority, round(share, 6) AS met_share FROM r WHERE share >= 0.7""",
)
def _(spark, sf):
    long = T.snapshot_metrics(snapshots(spark, sf), METRICS)
    return T.applicable_rules(long, T.default_tuning_rules(spark))


@query(
    "safety_gate",
    f"""SELECT event_id AS snapshot_id, greatest((event_id % 10) / 10.0, (user_id % 10) / 10.0) <= 0.85 AND (event_id % 100) / 100.0 <= 0.9
      AND value / 500.0 >= 0.08 * 10 AND value / 60.0 <= 10 AND (event_id % 3) / 200.0 <= 0.01 AS safe FROM events""",
)
def _(spark, sf):
    s = load(spark, sf, "events").select(
        F.col("event_id").alias("snapshot_id"),
        F.create_map(F.lit("c0"), F.col("event_id") % 10 / 10.0, F.lit("c1"), F.col("user_id") % 10 / 10.0).alias("cpu"),
        F.create_map(F.lit("m0"), F.col("event_id") % 100 / 100.0).alias("memory_pressure"),
        (F.col("value") / 500.0).alias("cache_hit_ratio"), (F.col("value") / 60.0).alias("latency_p99_ms"),
        (F.col("event_id") % 3 / 200.0).alias("error_rate"),
    )
    return T.safety_gate(s).select("snapshot_id", "safe")


POINTS_SQL = """SELECT 'i' || (user_id % 40) AS instance_id, CASE event_id % 2 WHEN 0 THEN 'cpu' ELSE 'connections' END AS metric, ts, value FROM events"""
METRICS_SQL = f"""m AS (SELECT instance_id, metric, avg(a) AS value FROM (SELECT instance_id, metric, epoch_us(ts) // 300000000 AS w, avg(value) AS a
    FROM ({POINTS_SQL}) WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTES AND ts < TIMESTAMP '{AS_OF}' GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def instance_points(spark, sf):
    """The log's last days squeezed into the ten minutes before ``as_of``."""
    return spark.sql(POINTS_SQL.replace("FROM events", "FROM {e}"), e=load(spark, sf, "events"))


SQUEEZED = POINTS_SQL.replace(", ts,", ", make_timestamp(epoch_us(TIMESTAMP '2024-01-20 00:00:00') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-20 00:00:00')) // 2000) AS ts,")


def squeezed(spark, sf):
    base = F.unix_micros(as_of())
    moved = F.timestamp_micros(base + F.floor((F.unix_micros("ts") - base) / 2000))
    return instance_points(spark, sf).withColumn("ts", moved)


@query(
    "instance_metrics",
    f"WITH {METRICS_SQL.replace(POINTS_SQL, SQUEEZED)} SELECT instance_id, metric, round(value, 6) AS value FROM m",
)
def _(spark, sf):
    found = T.instance_metrics(squeezed(spark, sf), as_of())
    return found.withColumn("value", F.round("value", 6))


POLICY_SQL = """SELECT s_suppkey AS policy_id, 'i' || (s_suppkey % 45) AS instance_id, CASE s_suppkey % 2 WHEN 0 THEN 'cpu' ELSE 'connections' END AS metric_type,
    50.0 + s_suppkey % 8 AS scale_up_threshold, 42.0 + s_suppkey % 8 AS scale_down_threshold, s_suppkey % 5 <> 0 AS is_active, 300 AS cooldown_s FROM supplier"""
INSTANCE_SQL = """SELECT 'i' || (n_nationkey * 2) AS instance_id, CASE n_regionkey WHEN 0 THEN 'db.t3.micro' WHEN 1 THEN 'db-n1-standard-8' WHEN 2 THEN 'small'
    WHEN 3 THEN 'custom' ELSE 'large' END AS instance_class, CASE WHEN n_nationkey % 6 = 5 THEN 'modifying' ELSE 'available' END AS status FROM nation"""
STEP = {d: " ".join(f"WHEN '{a}' THEN '{b}'" for ladder in packs.INSTANCE_LADDERS for a, b in (zip(ladder, ladder[1:]) if d == "up" else zip(ladder[1:], ladder)))
        for d in ("up", "down")}


@query(
    "scaling_events",
    f"""WITH {METRICS_SQL.replace(POINTS_SQL, SQUEEZED)}, p AS ({POLICY_SQL}), i AS ({INSTANCE_SQL}),
    d AS (SELECT policy_id, instance_id, metric_type, instance_class, value, CASE WHEN value >= scale_up_threshold THEN 'scale_up' WHEN value <= scale_down_threshold THEN 'scale_down' END AS action
      FROM p JOIN i USING (instance_id) LEFT JOIN m ON m.instance_id = p.instance_id AND m.metric = metric_type WHERE is_active AND status = 'available'),
    n AS (SELECT *, CASE action WHEN 'scale_up' THEN CASE instance_class {STEP['up']} ELSE instance_class END ELSE CASE instance_class {STEP['down']} ELSE instance_class END END AS new_class FROM d)
    SELECT instance_id, policy_id, action, instance_class AS old_class, new_class, metric_type AS trigger_metric, round(value, 6) AS trigger_value, 'threshold' AS trigger_type
    FROM n WHERE action IS NOT NULL AND new_class <> instance_class""",
)
def _(spark, sf):
    policies = spark.sql(POLICY_SQL.replace("FROM supplier", "FROM {s}"), s=load(spark, sf, "supplier"))
    instances = spark.sql(INSTANCE_SQL.replace("FROM nation", "FROM {n}"), n=load(spark, sf, "nation"))
    metrics = T.instance_metrics(squeezed(spark, sf), as_of())
    events = T.scaling_events(T.active_policies(policies, instances), metrics)
    return events.withColumn("trigger_value", F.round("trigger_value", 6))


@query(
    "pod_usage",
    """SELECT event_id, round(CASE event_id % 2 WHEN 0 THEN user_id * 1000000.0 / 1000000 ELSE user_id END / 1000 * 100, 6)::DOUBLE AS cpu_percent,
      round(CASE event_id % 3 WHEN 0 THEN event_id * 1024.0 ELSE event_id END / 1073741824.0 * 100, 9)::DOUBLE AS memory_percent FROM events""",
)
def _(spark, sf):
    user, event = F.col("user_id"), F.col("event_id")
    usage = load(spark, sf, "events").select(
        "event_id",
        F.when(event % 2 == 0, F.concat(user * 1_000_000, F.lit("n"))).otherwise(F.concat(user, F.lit("m"))).alias("cpu_usage"),
        F.when(event % 3 == 0, F.concat(event, F.lit("Ki"))).otherwise(event.cast("string")).alias("memory_usage"),
    )
    return T.k8s_usage(usage).select(
        "event_id", F.round("cpu_percent", 6).alias("cpu_percent"), F.round("memory_percent", 9).alias("memory_percent")
    )


@query(
    "latest_status",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
)
def _(spark, sf):
    return L.latest(load(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])

