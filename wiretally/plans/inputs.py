"""The given tables, and tables Spark derives from them (with the same derivation as SQL text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.session import spread

AS_OF = "2024-01-20 00:00:00"
TEXT_TABLES = ("documents", "pages", "conversations")  # little to read, much to compute per row


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-less timestamps read as UTC (the session's zone is set to it)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return spread(df) if name in TEXT_TABLES else df


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# Derivations are written once, in expressions both Spark SQL and DuckDB read the same way.

_QUERY_LOG = """
  SELECT event_id AS log_id, ts, user_id, event_type, value,
    'user_' || user_id AS username,
    '10.0.' || (user_id % 8) || '.' || (user_id % 250 + 1) AS source_ip,
    CASE user_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'orders_backup' ELSE 'shop' END AS database,
    CASE user_id % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' ELSE 'redis' END AS db_type,
    value / 100.0 AS latency,
    CASE event_type
      WHEN 'error' THEN 'SELECT * FROM users WHERE id = ' || event_id || ' OR 1=1'
      WHEN 'signup' THEN 'INSERT INTO accounts (id, name) VALUES (' || event_id || ', ' || chr(39) || 'n' || user_id || chr(39) || ')'
      WHEN 'purchase' THEN 'UPDATE carts SET total = ' || (event_id % 97) || ' WHERE user_id = ' || user_id
      ELSE 'SELECT o.id, count(*) FROM shop.orders o JOIN shop.items i ON i.oid = o.id WHERE o.uid = ' || user_id || ' GROUP BY o.id'
    END AS query
  FROM events
"""

_COMMANDS = """
  SELECT event_id, user_id,
    CASE event_type
      WHEN 'view' THEN 'GET session:' || user_id
      WHEN 'click' THEN '*hset  cart:{' || user_id || '} item ' || event_id
      WHEN 'purchase' THEN 'ZADD totals ' || value || ' u' || user_id
      WHEN 'signup' THEN 'Config SET maxmemory ' || event_id
      ELSE 'FLUSHALL' END AS line,
    CASE event_type
      WHEN 'view' THEN 'db.carts.find({uid: ' || user_id || '})'
      WHEN 'click' THEN 'db.clicks.Insert({uid: ' || user_id || '})'
      WHEN 'purchase' THEN 'db.totals.mapReduce(f, g)'
      WHEN 'signup' THEN 'db.users.createIndex({uid: 1})'
      ELSE 'db.tmp.drop()' END AS message,
    CASE event_type WHEN 'click' THEN 'system.users' ELSE 'carts' END AS collection
  FROM events
"""

_PACKETS = """
  SELECT event_id, ts, user_id,
    167772160 + (user_id % 8) * 256 + (user_id % 250 + 1) AS ip,
    1024 + event_id % 5000 AS port,
    CASE event_id % 7 WHEN 0 THEN 3306 WHEN 1 THEN 5432 WHEN 2 THEN 1433 WHEN 3 THEN 27017
      WHEN 4 THEN 6379 WHEN 5 THEN 80 ELSE 443 END AS dest_port,
    event_id % 3 <> 0 AS syn, event_id % 4 = 0 AS ack
  FROM events
"""

_INDICATORS = """
  SELECT c_custkey AS id,
    CASE c_custkey % 6 WHEN 0 THEN 'ip' WHEN 1 THEN 'email' WHEN 2 THEN 'sql_pattern'
      WHEN 3 THEN 'domain' WHEN 4 THEN 'user_agent' ELSE 'url' END AS type,
    CASE c_custkey % 6 WHEN 0 THEN '10.0.' || (c_custkey % 8) || '.' || (c_custkey % 250 + 1)
      WHEN 1 THEN 'USER_' || (c_custkey * 3) WHEN 2 THEN 'ID = ' || (c_custkey * 4) || ' OR'
      WHEN 3 THEN 'oid' || c_custkey WHEN 4 THEN 'curl' ELSE 'total = ' || c_custkey || ' ' END AS value,
    CASE c_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS threat_level,
    CAST(floor(c_acctbal) AS INT) % 100 / 100.0 AS confidence,
    'feed' || (c_nationkey % 5) AS feed,
    c_custkey % 11 <> 0 AS active
  FROM customer
"""

_USERS = """
  SELECT c_custkey AS user_id, 'user_' || c_custkey AS username,
    'key-' || (c_custkey * 7) AS api_key,
    c_custkey % 13 <> 0 AS enabled,
    CASE WHEN c_custkey % 17 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS expires_at,
    CASE c_custkey % 4 WHEN 0 THEN '10.0.0.0/22' WHEN 1 THEN '10.0.1.1,bad/cidr,10.0.5.0/24' ELSE '' END AS ip_list
  FROM customer
"""

_PERMISSIONS = """
  SELECT c_custkey AS permission_id, c_custkey AS user_id, 'user_' || c_custkey AS username,
    CASE c_custkey % 5 WHEN 0 THEN '*' WHEN 1 THEN 'orders_backup' ELSE 'shop' END AS database,
    CASE c_custkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'carts' ELSE 'orders' END AS table,
    CASE c_nationkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'read,write' ELSE '*' END AS action_list,
    CASE WHEN c_custkey % 19 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS time_limit
  FROM customer
  WHERE c_custkey % 7 <> 0
"""

_ISSUES = """
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS scan_ts,
    CAST(day(ts) AS BIGINT) AS scan_id,
    'srv' || (user_id % 20) AS server, event_id AS issue_id,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'High' WHEN 'signup' THEN 'medium'
      WHEN 'click' THEN 'low' ELSE 'info' END AS severity,
    CASE user_id % 6 WHEN 0 THEN 'tls_issues' WHEN 1 THEN 'version_issues' WHEN 2 THEN 'credential_issues'
      WHEN 3 THEN 'configuration_issues' WHEN 4 THEN 'security_issues' ELSE 'configuration' END AS category,
    CASE event_id % 12 WHEN 0 THEN 'default_credentials' WHEN 1 THEN 'tls_disabled' WHEN 2 THEN 'version_eol'
      WHEN 3 THEN 'no_authentication' ELSE 'type_' || (event_id % 12) END AS type,
    'Title ' || (event_id % 31) AS title
  FROM events
"""

_FINDINGS = """
  SELECT 'F' || (l_suppkey % 4) AS framework, 'C' || (l_partkey % 7) || '.' || (l_linenumber % 5) AS test_id,
    CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'pass' ELSE CASE l_linestatus WHEN 'O' THEN 'skip' ELSE 'error' END END AS status,
    CASE l_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
  FROM lineitem
"""

_WRITE_RESULTS = """
  SELECT l_orderkey AS request_id,
    CASE l_orderkey % 4 WHEN 0 THEN 'sync' WHEN 1 THEN 'async' WHEN 2 THEN 'best_effort' ELSE 'quorum' END AS strategy,
    'cluster' || (l_suppkey % 6) AS cluster,
    CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status,
    l_linenumber = 1 AS is_primary, l_partkey % 9 <> 0 AS enabled,
    l_partkey % 3 AS retries, l_shipdate AS written_at
  FROM lineitem
"""

_CACHE_LOG = """
  SELECT event_id, ts, 'tier' || (user_id % 3) AS tier, 'policy' || (user_id % 4) AS policy,
    'k' || (user_id % 40) AS cache_key,
    CASE event_type WHEN 'view' THEN 'hit' WHEN 'click' THEN 'hit' WHEN 'error' THEN 'auth_failure' ELSE 'miss' END AS outcome
  FROM events
"""

_CACHE_ENTRIES = """
  SELECT o_orderkey AS entry_id, 'k' || o_orderkey AS cache_key, 'table' || (o_custkey % 50) AS table,
    'db' || (o_custkey % 4) AS database,
    o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS size, 86400 * (o_orderkey % 900) AS ttl_s
  FROM orders
"""

DERIVED = {
    "query_log": _QUERY_LOG,
    "commands": _COMMANDS,
    "packets": _PACKETS,
    "indicators": _INDICATORS,
    "users": _USERS,
    "permissions": _PERMISSIONS,
    "issues": _ISSUES,
    "findings": _FINDINGS,
    "write_results": _WRITE_RESULTS,
    "cache_log": _CACHE_LOG,
    "cache_entries": _CACHE_ENTRIES,
}

_SOURCE = {
    "indicators": "customer", "users": "customer", "permissions": "customer", "findings": "lineitem",
    "write_results": "lineitem", "cache_entries": "orders",
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = _SOURCE.get(name, "events")
    text = DERIVED[name].replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", "FROM {source}")
    table = load(spark, sf_dir, source)
    return spark.sql(text, source=spread(table) if name == "query_log" else table)


def ctes(*names: str) -> str:
    """``WITH`` head of a SQL text that defines derived tables."""
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n]})" for n in names)


def lists(column: str) -> str:
    """SQL array of a comma list, empty for the empty text."""
    return f"CASE WHEN {column} = '' THEN [] ELSE string_split({column}, ',') END"


def split_list(column: str):
    return F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "users").withColumn("allowed_ips", split_list("ip_list")).drop("ip_list")


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "permissions").withColumn("actions", split_list("action_list")).drop("action_list")
