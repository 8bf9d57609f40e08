"""Queries over findings, scores, audits, feeds, column quality and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.functions import quality as Q
from wiretally.operators import feeds as D
from wiretally.operators import findings as G
from wiretally.operators import quality as QJ
from wiretally.operators import rollups
from wiretally.operators.nest import nest
from wiretally.plans.inputs import AS_OF, as_of, ctes, derive, load
from wiretally.plans.registry import query
from wiretally.plans.screening import SQL_SEVERITY, sql_in
from wiretally.sources import feeds as S
from wiretally.sources import files as X


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- scans ---------------------------------------------------------------------------------------------------


def issues(spark, sf):
    return derive(spark, sf, "issues")


def checked_servers(spark, sf):
    return load(spark, sf, "events").select(
        F.dayofmonth("ts").cast("bigint").alias("scan_id"), F.concat(F.lit("srv"), F.col("user_id") % 20).alias("server")
    )


def fleet(spark, sf):
    return G.fleet_rollup(issues(spark, sf), checked_servers(spark, sf))


FLEET_SQL = f"""{ctes('issues')}, fleet AS (SELECT scan_id, count(DISTINCT server) AS servers_checked, count(*) AS total_issues,
    count_if(severity = 'critical') AS critical_issues, count_if(severity = 'High') AS high_issues, count_if(severity = 'medium') AS medium_issues,
    count_if(severity IN ('low', 'info')) AS low_issues, {', '.join(f"count_if(category = '{c}') AS {c}" for c in packs.FINDING_CATEGORIES)}
    FROM issues GROUP BY 1)"""


@query("fleet_rollup", f"{FLEET_SQL} SELECT * FROM fleet")
def _(spark, sf):
    return fleet(spark, sf)


@query(
    "fleet_score",
    f"{FLEET_SQL} SELECT scan_id, round(greatest(0, 100 - total_issues / greatest(servers_checked * 20, 1) * 100), 1) AS security_score FROM fleet",
)
def _(spark, sf):
    return G.fleet_score(fleet(spark, sf))


@query(
    "server_scores",
    f"""{ctes('issues')} SELECT server || '/' || scan_id AS server, count(*) AS total_issues, count_if(severity = 'critical') AS critical,
      CAST(greatest(0, 100 - 2 * sum(CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)) AS BIGINT) AS security_score
    FROM issues GROUP BY 1""",
)
def _(spark, sf):
    per_scan = issues(spark, sf).withColumn("server", F.concat_ws("/", "server", "scan_id"))
    return G.server_scores(per_scan)


@query(
    "top_categories",
    f"""{ctes('issues')} SELECT array_to_string(list_transform(string_split(replace(category, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS category, count(*) AS n
    FROM issues GROUP BY 1 ORDER BY n DESC, category LIMIT 5""",
)
def _(spark, sf):
    return G.top_categories(issues(spark, sf))


@query(
    "common_issues",
    f"""{ctes('issues')} SELECT type, count(*) AS n, arg_min(title, (scan_ts, scan_id, issue_id)) AS title, arg_min(severity, (scan_ts, scan_id, issue_id)) AS severity
    FROM issues GROUP BY 1 ORDER BY n DESC, type LIMIT 10""",
)
def _(spark, sf):
    return G.common_issues(issues(spark, sf))


def scans(spark, sf):
    return fleet(spark, sf).withColumn("scan_ts", F.col("scan_id"))


@query(
    "weekly_summary",
    f"""{FLEET_SQL} SELECT count(*) AS total_scans, arg_max(critical_issues, scan_id) AS critical_now, arg_max(high_issues, scan_id) AS high_now,
      arg_max(total_issues, scan_id) AS total_now, arg_max(servers_checked, scan_id) AS servers_monitored, round(avg(critical_issues), 6) AS critical_avg,
      max(critical_issues) AS critical_max, round(avg(high_issues), 6) AS high_avg, round(avg(total_issues), 6) AS total_avg,
      count(*) > 1 AND arg_max(total_issues, scan_id) < arg_min(total_issues, scan_id) AS improving FROM fleet""",
)
def _(spark, sf):
    return G.weekly_summary(scans(spark, sf))


@query(
    "weekly_recommendations",
    f"""{FLEET_SQL}, l AS (SELECT min(total_issues) AS least FROM (SELECT total_issues FROM fleet ORDER BY scan_id DESC LIMIT 3)),
    t AS (SELECT list_filter([CASE WHEN arg_max(critical_issues, scan_id) > 0 THEN 'Address critical security issues immediately' END,
      CASE WHEN arg_max(total_issues, scan_id) > 20 THEN 'Consider implementing automated remediation for common issues' END,
      CASE WHEN count(*) > 3 AND any_value(least) > 5 THEN 'Review and prioritize persistent security issues' END], lambda x: x IS NOT NULL) AS a FROM fleet, l)
    SELECT CAST(unnest(range(len(a))) AS INT) AS ord, unnest(a) AS recommendation FROM t""",
)
def _(spark, sf):
    return G.weekly_recommendations(scans(spark, sf))


@query(
    "notifications",
    f"""{FLEET_SQL} SELECT scan_id, critical_issues > 0 AS critical, critical_issues > 0 OR high_issues > 0 AS high,
      total_issues > 0 AS medium, false AS "none" FROM fleet""",
)
def _(spark, sf):
    marked = fleet(spark, sf)
    for threshold in ("critical", "high", "medium", "none"):
        marked = G.should_notify(marked, threshold).withColumnRenamed("notify", threshold)
    return marked.select("scan_id", "critical", "high", "medium", "none")


@query(
    "remediations",
    f"""{ctes('issues')} SELECT guidance, count(*) AS n FROM (SELECT CASE type {' '.join(f"WHEN '{k}' THEN {_q(v)}" for k, v in packs.GUIDANCE)} ELSE '{packs.GUIDANCE_DEFAULT}' END AS guidance FROM issues) GROUP BY 1""",
)
def _(spark, sf):
    return rollups.count_per(G.with_remediation(issues(spark, sf), G.default_guidance(spark)), "guidance")


@query(
    "remediation_bodies",
    f"""{ctes('issues')}, kb AS (SELECT 'type_' || n_nationkey AS type, n_name AS title, [n_name || ' now', 'then ' || n_regionkey] AS actions, n_regionkey AS level FROM nation WHERE n_nationkey % 2 = 0)
    SELECT coalesce(kb.title, d.title) AS kb_title, array_to_string(coalesce(kb.actions, d.actions), '; ') AS actions, coalesce(level, 9)::BIGINT AS level, count(*) AS n
    FROM issues LEFT JOIN kb USING (type), (SELECT 'Review' AS title, ['look', 'ask'] AS actions) d GROUP BY ALL""",
)
def _(spark, sf):
    """Findings with the whole entries of a knowledge base, and its default entry for other types."""
    known = load(spark, sf, "nation").where("n_nationkey % 2 = 0").select(
        F.concat(F.lit("type_"), "n_nationkey").alias("type"), F.col("n_name").alias("title"),
        F.array(F.concat("n_name", F.lit(" now")), F.concat(F.lit("then "), "n_regionkey")).alias("actions"), F.col("n_regionkey").alias("level"),
    )
    other = known.agg(F.lit("default").alias("type"), F.lit("Review").alias("title"), F.array(F.lit("look"), F.lit("ask")).alias("actions"), F.lit(9).cast("long").alias("level"))
    found = G.with_knowledge(issues(spark, sf), known.unionByName(other))
    return found.groupBy("kb_title", F.concat_ws("; ", "actions").alias("actions"), "level").agg(F.count("*").alias("n"))


@query(
    "nested_scans",
    f"{ctes('issues')} SELECT scan_id, server, count(*) AS n, min(issue_id) AS first_issue FROM issues GROUP BY 1, 2",
)
def _(spark, sf):
    """Scan documents as they are stored (servers, issues nested), opened again."""
    item = F.struct("issue_id", "type", "severity", "category", "title")
    per_server = nest(issues(spark, sf), ["scan_id", "scan_ts", "server"], item, "issues", spread_by="issue_id", parts=3)
    documents = per_server.select(
        "scan_id", "scan_ts", F.array(F.struct(F.col("server").alias("server_name"), "issues")).alias("server_results")
    )
    opened = G.scan_issues(documents)
    return opened.groupBy("scan_id", "server").agg(F.count(F.lit(1)).alias("n"), F.min("issue_id").alias("first_issue"))


# --- compliance ------------------------------------------------------------------------------------------------


def waivers(spark, sf):
    return load(spark, sf, "nation").select(
        F.concat(F.lit("C"), F.col("n_regionkey"), F.lit("."), F.col("n_nationkey")).alias("test_id")
    )


@query(
    "compliance_score",
    f"""{ctes('findings')}, m AS (SELECT *, test_id IN (SELECT 'C' || n_regionkey || '.' || n_nationkey FROM nation) AS waived FROM findings)
    SELECT framework, count(*) AS total, count_if(NOT waived AND status = 'pass') AS passed, count_if(NOT waived AND status IN ('fail', 'error')) AS failed,
      count_if(waived OR status = 'skip') AS skipped, round(count_if(NOT waived AND status = 'pass') / count(*) * 100, 4) AS score FROM m GROUP BY 1""",
)
def _(spark, sf):
    return G.compliance_score(derive(spark, sf, "findings"), waivers(spark, sf))


@query(
    "unwaived_findings",
    f"""{ctes('findings')} SELECT test_id, count(*) AS n FROM findings WHERE test_id NOT IN (SELECT 'C' || n_regionkey || '.' || n_nationkey FROM nation) GROUP BY 1""",
)
def _(spark, sf):
    return rollups.count_per(G.apply_waivers(derive(spark, sf, "findings"), waivers(spark, sf)), "test_id")


@query(
    "compliance_summary",
    f"""{ctes('findings')} SELECT framework, {', '.join(f"count_if(severity = '{s}') AS {s}" for s in packs.SEVERITIES)}, count_if(severity = 'critical') > 0 AS urgent FROM findings GROUP BY 1""",
)
def _(spark, sf):
    return G.compliance_summary(derive(spark, sf, "findings"))


@query(
    "compliance_categories",
    f"{ctes('findings')} SELECT framework, string_split(test_id, '.')[1] AS category, count(*) AS n FROM findings GROUP BY 1, 2",
)
def _(spark, sf):
    return G.compliance_categories(derive(spark, sf, "findings"))


HOST_SQL = """SELECT c_custkey, 'h' || c_custkey AS host, 22 + c_custkey % 4 AS p1, CASE c_custkey % 3 WHEN 0 THEN 443 ELSE 5432 END AS p2,
    CAST(6 + c_custkey % 9 AS INT) AS min_length, c_custkey % 5 <> 0 AS upper, c_custkey % 8 <> 0 AS special FROM customer"""


@query(
    "compliance_tests",
    f"""WITH h AS ({HOST_SQL}), t AS (SELECT host, 'SOC2' AS framework, 'CC1.1' AS test_id, 'high' AS severity,
        CASE WHEN min_length >= 12 AND "upper" AND special THEN 'pass' ELSE 'fail' END AS status, '' AS details FROM h
      UNION ALL SELECT host, 'SOC2', 'CC2.1', 'critical', 'skip', '' FROM h UNION ALL SELECT host, 'NIST', 'ID.AM-1', 'medium', 'skip', '' FROM h
      UNION ALL SELECT host, 'NIST', 'PR.AC-1', 'high', 'skip', '' FROM h UNION ALL SELECT host, 'HIPAA', '164.308(a)(1)(i)', 'high', 'skip', '' FROM h
      UNION ALL SELECT host, 'network', 'NET001', 'high', CASE WHEN p1 = 22 THEN 'pass' ELSE 'fail' END, CASE WHEN p1 = 22 THEN '' ELSE p1::VARCHAR END FROM h)
    SELECT * FROM t""",
)
def _(spark, sf):
    hosts = spark.sql(HOST_SQL.replace("FROM customer", "FROM {c}"), c=load(spark, sf, "customer"))
    inventory = hosts.select(
        "host", F.array(F.col("p1").cast("int"), F.col("p2").cast("int")).alias("open_ports"), "min_length", "upper",
        F.lit(True).alias("lower"), F.lit(True).alias("digits"), "special",
    )
    return G.compliance_tests(inventory)


# --- audits ----------------------------------------------------------------------------------------------------


def finding_sql(engine: str, tests: list[tuple[str, str]], head: str, source: str = "per") -> str:
    rows = []
    for kind, test in tests:
        severity, category = next((s, c) for e, k, s, c, _ in packs.HEALTH_FINDINGS if k == kind and e in (engine, "any"))
        rows.append(f"SELECT server, '{kind}' AS type, '{severity}' AS severity, '{category}' AS category FROM {source} WHERE {test}")
    return head + " " + " UNION ALL ".join(rows)


def short(findings):
    return findings.select("server", "type", "severity", "category")


ACCOUNT_SQL = """SELECT 'srv' || (c_custkey % 90) AS server, CASE c_custkey % 19 WHEN 0 THEN 'root' WHEN 1 THEN 'test' WHEN 2 THEN '' ELSE 'u' || c_custkey END AS user,
    CASE c_custkey % 7 WHEN 0 THEN '%' WHEN 1 THEN 'localhost' ELSE '10.0.0.' || (c_custkey % 200) END AS host,
    CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'short' ELSE repeat('h', 41) END AS auth_string,
    c_custkey % 23 = 5 AS file_priv, c_custkey % 9 = 4 AS super_priv, c_custkey % 10 = 4 AS crud_priv FROM customer"""
SERVER_SQL = "SELECT DISTINCT 'srv' || (c_custkey % 97) AS server FROM customer"
SETTING_SQL = """SELECT 'srv' || (s_suppkey % 95) AS server, CASE s_suppkey % 5 WHEN 0 THEN 'have_ssl' WHEN 1 THEN 'log_bin' WHEN 2 THEN 'general_log' WHEN 3 THEN 'skip_grant_tables' ELSE 'old_passwords' END AS name,
    CASE s_suppkey % 5 WHEN 0 THEN 'YES' WHEN 4 THEN CASE s_nationkey % 2 WHEN 0 THEN '0' ELSE '1' END ELSE CASE s_nationkey % 2 WHEN 0 THEN 'ON' ELSE 'OFF' END END AS value FROM supplier"""


def _over(spark, sf, text, table):
    return spark.sql(text.replace(f"FROM {table}", "FROM {t}"), t=load(spark, sf, table))


def setting(name: str) -> str:
    return f"(SELECT max(value) FROM st WHERE st.server = per.server AND name = '{name}')"


@query(
    "mysql_audit",
    finding_sql(
        "mysql",
        [
            ("default_credentials", "blank > 0"), ("default_databases", "tests > 0"), ("excessive_file_privileges", "files > 0"),
            ("remote_root_access", "remote > 0"), ("wildcard_host_access", "wild > 0"), ("excessive_admin_users", "admins > 2"),
            ("no_password_validation", "true"), ("ssl_not_configured", f"coalesce({setting('have_ssl')}, '') <> 'YES'"),
            ("binary_logging_disabled", f"coalesce({setting('log_bin')}, '') <> 'ON'"), ("general_logging_enabled", f"{setting('general_log')} = 'ON'"),
            ("skip_grant_tables", f"{setting('skip_grant_tables')} = 'ON'"), ("old_password_hashing", f"{setting('old_passwords')} <> '0'"),
            ("anonymous_users", "anon > 0"), ("weak_passwords_detected", "weak > 0"),
        ],
        f"""WITH a AS ({ACCOUNT_SQL}), st AS ({SETTING_SQL}), per AS (SELECT s.server, count_if(auth_string = '' AND "user" IN ('root', 'test')) AS blank,
          (SELECT count(*) FROM nation WHERE 'srv' || n_nationkey = s.server AND n_regionkey = 1) AS tests,
          count_if(file_priv AND "user" <> 'root') AS files, count_if("user" = 'root' AND host <> 'localhost') AS remote, count_if(host = '%') AS wild,
          count_if((super_priv OR crud_priv) AND "user" <> 'root') AS admins, count_if("user" = '') AS anon, count_if(length(auth_string) < 20) AS weak
        FROM ({SERVER_SQL}) s LEFT JOIN a ON a.server = s.server GROUP BY s.server)""",
    ),
)
def _(spark, sf):
    names = load(spark, sf, "nation").select(
        F.concat(F.lit("srv"), "n_nationkey").alias("server"), F.when(F.col("n_regionkey") == 1, "test").otherwise("own").alias("name")
    )
    return short(
        G.audit_mysql(
            _over(spark, sf, SERVER_SQL, "customer"), _over(spark, sf, ACCOUNT_SQL, "customer"), names,
            _over(spark, sf, SETTING_SQL, "supplier"),
        )
    )


ROLE_SQL = """SELECT 'srv' || (c_custkey % 90) AS server, CASE c_custkey % 19 WHEN 0 THEN 'postgres' ELSE 'r' || c_custkey END AS name, c_custkey % 3 = 0 AS can_login,
    c_custkey % 12 <> 0 AS has_password, c_custkey % 38 = 0 AS superuser, c_custkey % 25 = 0 AS createrole, c_custkey % 5 = 0 AS createdb FROM customer"""
PG_SETTING_SQL = """SELECT 'srv' || (s_suppkey % 95) AS server, CASE s_suppkey % 6 WHEN 0 THEN 'password_encryption' WHEN 1 THEN 'log_connections' WHEN 2 THEN 'log_disconnections'
      WHEN 3 THEN 'log_statement' WHEN 4 THEN 'shared_preload_libraries' ELSE 'ssl' END AS name,
    CASE s_suppkey % 6 WHEN 0 THEN 'scram-sha-256' WHEN 3 THEN 'all' WHEN 4 THEN 'Auto_Explain,other' ELSE 'on' END AS value FROM supplier"""


@query(
    "postgres_audit",
    finding_sql(
        "postgresql",
        [
            ("users_no_password", "open > 0"), ("excessive_superuser_accounts", "supers > 0"), ("excessive_createrole_privilege", "creators > 0"),
            ("excessive_createdb_privilege", "dbs > 2"), ("only_default_databases", "own = 0"), ("trust_authentication", "trusted > 0"),
            ("weak_password_encryption", f"coalesce({setting('password_encryption')}, '') <> 'scram-sha-256'"),
            ("connection_logging_disabled", f"coalesce({setting('log_connections')}, '') <> 'on'"),
            ("disconnection_logging_disabled", f"coalesce({setting('log_disconnections')}, '') <> 'on'"),
            ("excessive_statement_logging", f"{setting('log_statement')} = 'all'"),
            ("potentially_dangerous_extensions", f"contains(lower({setting('shared_preload_libraries')}), 'auto_explain')"),
            ("ssl_disabled", f"coalesce({setting('ssl')}, '') <> 'on'"), ("no_row_level_security", "tabs > 0 AND secured = 0"),
            ("public_schema_permissions", "grants > 0"),
        ],
        f"""WITH r AS ({ROLE_SQL}), st AS ({PG_SETTING_SQL}), per AS (SELECT s.server, count_if(can_login AND NOT has_password) AS open,
          count_if(superuser AND name <> 'postgres') AS supers, count_if(createrole AND name <> 'postgres') AS creators, count_if(createdb AND name <> 'postgres') AS dbs,
          (SELECT count(*) FROM nation WHERE 'srv' || n_nationkey = s.server AND n_regionkey <> 2) AS own,
          (SELECT count(*) FROM nation WHERE 'srv' || n_nationkey = s.server AND n_regionkey = 3) AS trusted,
          (SELECT count(*) FROM part WHERE 'srv' || (p_partkey % 80) = s.server AND p_size % 2 = 0) AS tabs,
          (SELECT count(*) FROM part WHERE 'srv' || (p_partkey % 80) = s.server AND p_size = 7) AS secured,
          (SELECT count(*) FROM part WHERE 'srv' || (p_partkey % 80) = s.server AND p_size % 2 = 0 AND p_size = 30) AS grants
        FROM ({SERVER_SQL}) s LEFT JOIN r ON r.server = s.server GROUP BY s.server)""",
    ),
)
def _(spark, sf):
    nation = load(spark, sf, "nation")
    server = F.concat(F.lit("srv"), "n_nationkey").alias("server")
    names = nation.select(
        server, F.when(F.col("n_regionkey") == 2, "postgres").otherwise("own").alias("name"), F.lit(False).alias("is_template")
    )
    hba = nation.select(server, F.when(F.col("n_regionkey") == 3, "trust").otherwise("md5").alias("method"))
    part = load(spark, sf, "part").select(
        F.concat(F.lit("srv"), F.col("p_partkey") % 80).alias("server"),
        F.when(F.col("p_size") % 2 == 0, "public").otherwise("pg_catalog").alias("schema"),
        (F.col("p_size") == 7).alias("row_security"), F.when(F.col("p_size") == 30, "PUBLIC").otherwise("app").alias("grantee"),
    )
    return short(
        G.audit_postgres(
            _over(spark, sf, SERVER_SQL, "customer"), _over(spark, sf, ROLE_SQL, "customer"), names,
            _over(spark, sf, PG_SETTING_SQL, "supplier"), hba, part, part,
        )
    )


KV_SETTING_SQL = """SELECT 'srv' || CAST(floor(c_custkey / 12) AS BIGINT) AS server, CASE c_custkey % 12 WHEN 0 THEN 'requirepass' WHEN 1 THEN 'bind' WHEN 2 THEN 'protected-mode' WHEN 3 THEN 'tls-port'
      WHEN 4 THEN 'notify-keyspace-events' WHEN 5 THEN 'save' WHEN 6 THEN 'appendonly' WHEN 7 THEN 'appendfsync' WHEN 8 THEN 'maxmemory' WHEN 9 THEN 'databases'
      WHEN 10 THEN 'rename-command FLUSHALL' ELSE 'rename-command KEYS' END AS name,
    CASE c_custkey % 12 WHEN 0 THEN CASE c_nationkey % 3 WHEN 0 THEN 'redis' WHEN 1 THEN 'a-very-long-password' ELSE '' END WHEN 1 THEN CASE c_nationkey % 3 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '' ELSE '10.0.0.1' END
      WHEN 2 THEN CASE c_nationkey % 2 WHEN 0 THEN 'no' ELSE 'yes' END WHEN 3 THEN CASE c_nationkey % 2 WHEN 0 THEN '0' ELSE '6380' END WHEN 4 THEN 'KEA' WHEN 5 THEN '900 1' WHEN 6 THEN 'yes' WHEN 7 THEN 'no'
      WHEN 8 THEN CASE c_nationkey % 2 WHEN 0 THEN '0' ELSE '1gb' END WHEN 9 THEN '' || (10 + c_nationkey) ELSE 'hidden' END AS value
  FROM customer"""
OPEN_BIND = f"(contains(coalesce({setting('bind')}, ''), '0.0.0.0') OR coalesce({setting('bind')}, '') = '*')"


def command_sql() -> str:
    values = ", ".join(f"('{c}', '{'critical' if c in packs.KV_CRITICAL_COMMANDS else 'high'}')" for c in packs.KV_DANGEROUS_RENAMES)
    return f""" UNION ALL SELECT server, 'dangerous_commands_enabled', sev, 'security_issues' FROM per, (VALUES {values}) c(cmd, sev)
      WHERE coalesce((SELECT max(value) FROM st WHERE st.server = per.server AND name = 'rename-command ' || cmd), cmd) = cmd"""


@query(
    "redis_audit",
    finding_sql(
        "redis",
        [
            ("no_authentication", f"coalesce({setting('requirepass')}, '') = ''"),
            ("weak_redis_password", f"coalesce({setting('requirepass')}, '') <> '' AND length({setting('requirepass')}) < 12"),
            ("open_bind_address", OPEN_BIND), ("no_bind_restriction", f"NOT {OPEN_BIND} AND coalesce({setting('bind')}, '') = ''"),
            ("protected_mode_disabled", f"{setting('protected-mode')} = 'no'"),
            ("tls_not_configured", f"coalesce({setting('tls-port')}, '') IN ('', '0')"),
            ("no_acl_users", "acl = 1"), ("default_user_no_password", "acl > 1 AND nopass > 0"),
            ("keyspace_notifications_enabled", f"coalesce({setting('notify-keyspace-events')}, '') <> ''"),
            ("no_persistence_configured", f"coalesce({setting('save')}, '') = ''"),
            ("aof_no_sync", f"{setting('appendonly')} = 'yes' AND {setting('appendfsync')} = 'no'"),
            ("no_memory_limit", f"coalesce({setting('maxmemory')}, '') IN ('', '0')"), ("external_client_connections", "ext > 0"),
            ("excessive_databases", f"{setting('databases')}::INT > 16"),
        ],
        f"""WITH st AS ({KV_SETTING_SQL}), per AS (SELECT server, (SELECT count(*) FROM supplier WHERE 'srv' || (s_suppkey % 60) = server) AS acl,
          (SELECT count(*) FROM supplier WHERE 'srv' || (s_suppkey % 60) = server AND s_suppkey % 3 = 0) AS nopass,
          (SELECT count(*) FROM orders WHERE 'srv' || (o_custkey % 40) = server AND o_orderstatus = 'F') AS ext FROM ({SERVER_SQL}))""",
    )
    + command_sql(),
)
def _(spark, sf):
    acl = load(spark, sf, "supplier").select(
        F.concat(F.lit("srv"), F.col("s_suppkey") % 60).alias("server"),
        F.when(F.col("s_suppkey") % 3 == 0, "user default on nopass").otherwise("user app on #hash").alias("line"),
    )
    clients = load(spark, sf, "orders").select(
        F.concat(F.lit("srv"), F.col("o_custkey") % 40).alias("server"),
        F.when(F.col("o_orderstatus") == "F", "addr=10.2.3.4:99").otherwise("addr=127.0.0.1:99").alias("line"),
    )
    return short(
        G.audit_redis(_over(spark, sf, SERVER_SQL, "customer"), _over(spark, sf, KV_SETTING_SQL, "customer"), clients, acl)
    )


@query(
    "mongo_audit",
    """SELECT 'srv' || c_custkey AS server, 'no_authentication' AS type, 'critical' AS severity, 'credential_issues' AS category FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT DISTINCT 'srv' || o_custkey, 'default_databases', 'low', 'configuration_issues' FROM orders WHERE o_orderstatus = 'P'""",
)
def _(spark, sf):
    fleet_servers = load(spark, sf, "customer").select(
        F.concat(F.lit("srv"), "c_custkey").alias("server"), (F.col("c_custkey") % 4 == 0).alias("open_status")
    )
    names = load(spark, sf, "orders").select(
        F.concat(F.lit("srv"), "o_custkey").alias("server"), F.when(F.col("o_orderstatus") == "P", "test").otherwise("own").alias("name")
    )
    return short(G.audit_mongo(fleet_servers, names))


VERSION_SQL = """SELECT 's' || c_custkey AS server, CASE c_custkey % 4 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' WHEN 2 THEN 'redis' ELSE 'mongodb' END AS db_type,
    CASE c_nationkey % 8 WHEN 0 THEN '5.6.40' WHEN 1 THEN '5.7' WHEN 2 THEN '10.3' WHEN 3 THEN '12.1' WHEN 4 THEN '4.0.9' WHEN 5 THEN '9.6.1' WHEN 6 THEN '8.0.0-8.0.16' ELSE '4.2' END AS version,
    c_custkey % 5 <> 0 AS tls_enabled, CASE c_custkey % 3 WHEN 0 THEN 'TLSv1.1' WHEN 1 THEN 'TLSv1.3' END AS tls_version,
    CASE c_custkey % 7 WHEN 0 THEN 'ecdhe-rsa-rc4-md5' WHEN 1 THEN 'AES256-GCM-SHA384' ELSE 'DHE-CAMELLIA' END AS cipher_suite,
    TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL 1 HOUR AS certificate_expires FROM customer"""


@query(
    "eol_findings",
    f"""WITH s AS ({VERSION_SQL}), e(db_type, prefix, eol) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in packs.EOL_VERSIONS)})
    SELECT server, s.db_type, version, min(prefix) AS prefix, arg_min(CASE eol WHEN 'deprecated' THEN 'deprecated' ELSE 'end_of_life' END, prefix) AS status,
      arg_min(CASE eol WHEN 'deprecated' THEN 'critical' ELSE 'high' END, prefix) AS severity, arg_min(eol, prefix) AS eol
    FROM s JOIN e ON e.db_type = s.db_type AND starts_with(version, prefix) AND (eol = 'deprecated' OR try_cast(eol AS TIMESTAMP) < TIMESTAMP '{AS_OF}') GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return G.eol_findings(_over(spark, sf, VERSION_SQL, "customer"), G.default_eol(spark), as_of())


@query(
    "tls_findings",
    finding_sql(
        "any",
        [
            ("tls_disabled", "NOT tls_enabled"), ("weak_tls_version", "tls_enabled AND tls_version < 'TLSv1.2'"),
            ("weak_cipher", " OR ".join(f"contains(upper(cipher_suite), '{c}')" for c in packs.WEAK_CIPHERS)),
            ("certificate_expiring", f"certificate_expires < TIMESTAMP '{AS_OF}' + INTERVAL 30 DAYS"),
        ],
        f"WITH per AS ({VERSION_SQL})",
    ),
)
def _(spark, sf):
    return short(G.tls_findings(_over(spark, sf, VERSION_SQL, "customer"), as_of()))


# --- feeds -----------------------------------------------------------------------------------------------------

STIX_KIND = """CASE page_id % 6 WHEN 0 THEN '[url:value = ' || chr(39) || url || chr(39) || ']' WHEN 1 THEN '[ipv4-addr:value = ' || chr(39) || '10.0.0.' || page_id || chr(39) || ']'
    WHEN 2 THEN '[domain-name:value = ' || chr(39) || 'd' || page_id || '.example' || chr(39) || ']' WHEN 3 THEN '[file:hashes.MD5 = ' || chr(39) || md5(url) || chr(39) || ']' ELSE 'raw ' || url END"""


def stix_entry():
    """A page as an object of a STIX bundle."""
    plain = F.when(F.col("page_id") % 4 == 0, F.array(F.lit("low"), F.lit("Critical")))
    return F.struct(
        F.when(F.col("page_id") % 6 == 5, "malware").otherwise("indicator").alias("type"),
        F.concat(F.lit("Bad "), "page_id").alias("name"), F.lit("seen").alias("description"),
        F.expr(STIX_KIND).alias("pattern"), plain.alias("labels"), F.lit("2024-01-01T00:00:00Z").alias("created"),
        F.lit(None).cast("string").alias("valid_until"),
        F.array(F.struct(F.lit("delivery").alias("phase_name"))).alias("kill_chain_phases"),
    )


def stix_columns(rows):
    kind = F.expr("CASE type WHEN 'url' THEN 0 WHEN 'ip' THEN 1 WHEN 'domain' THEN 2 WHEN 'hash' THEN 3 ELSE CASE confidence WHEN 80 THEN 5 ELSE 4 END END")
    return rows.select(
        kind.cast("bigint").alias("kind"), "type", "value", "threat_level", "confidence", F.concat_ws(",", "tags").alias("tags")
    )


@query(
    "framework_tests",
    """WITH hosts AS (SELECT c_custkey, 'h' || c_custkey AS host, list_distinct([22, 8000 + c_custkey % 3, 8000 + c_nationkey % 2]) AS ports, c_custkey % 20 AS min_length, c_nationkey % 5 <> 0 AS special FROM customer),
    tests AS (SELECT n_nationkey AS k, 'F' || n_regionkey AS framework, 'T' || n_nationkey AS test_id, CASE n_nationkey % 4 WHEN 0 THEN 'network' WHEN 1 THEN 'config' WHEN 2 THEN 'access' ELSE 'crypto' END AS type FROM nation)
    SELECT framework, test_id, CASE type WHEN 'network' THEN CASE WHEN len(list_filter(ports, lambda p: p NOT IN (22, 8000, 8000 + k % 3))) = 0 THEN 'pass' ELSE 'fail' END
      WHEN 'config' THEN CASE WHEN min_length >= 8 + k % 7 AND special THEN 'pass' ELSE 'fail' END
      WHEN 'access' THEN CASE WHEN len(ports) <= 1 + k % 3 THEN 'pass' ELSE 'fail' END ELSE 'skip' END AS status,
      CASE type WHEN 'network' THEN array_to_string(list_sort(list_filter(ports, lambda p: p NOT IN (22, 8000, 8000 + k % 3))), ',') ELSE '' END AS details, count(*) AS hosts
    FROM hosts, tests GROUP BY ALL""",
)
def _(spark, sf):
    """Tests of several frameworks from a table, for every host."""
    key, port = F.col("n_nationkey"), lambda c: (F.lit(8000) + c).cast("int")
    inventory = load(spark, sf, "customer").select(
        F.concat(F.lit("h"), "c_custkey").alias("host"), F.array_distinct(F.array(F.lit(22), port(F.col("c_custkey") % 3), port(F.col("c_nationkey") % 2))).alias("open_ports"),
        (F.col("c_custkey") % 20).alias("min_length"), F.lit(True).alias("upper"), F.lit(True).alias("lower"), F.lit(True).alias("digits"), (F.col("c_nationkey") % 5 != 0).alias("special"),
    )
    told = F.create_map(
        F.lit("ports"), F.concat(F.lit("22,8000,"), (8000 + key % 3).cast("string")), F.lit("min_length"), (8 + key % 7).cast("string"), F.lit("most"), (1 + key % 3).cast("string")
    )
    tests = load(spark, sf, "nation").select(
        F.concat(F.lit("F"), "n_regionkey").alias("framework"), F.concat(F.lit("T"), "n_nationkey").alias("test_id"),
        F.when(key % 4 == 0, "network").when(key % 4 == 1, "config").when(key % 4 == 2, "access").otherwise("crypto").alias("type"),
        F.lit("strong_password_policy").alias("expected"), F.lit("high").alias("severity"), told.alias("parameters"),
    )
    return G.framework_tests(inventory, tests).groupBy("framework", "test_id", "status", "details").agg(F.count("*").alias("hosts"))


@query(
    "stix_indicators",
    """SELECT page_id % 6 AS kind, CASE page_id % 6 WHEN 0 THEN 'url' WHEN 1 THEN 'ip' WHEN 2 THEN 'domain' WHEN 3 THEN 'hash' ELSE 'pattern' END AS type,
      CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '10.0.0.' || page_id WHEN 2 THEN 'd' || page_id || '.example' WHEN 3 THEN md5(url) WHEN 4 THEN 'raw ' || url ELSE 'Bad ' || page_id END AS value,
      CASE WHEN page_id % 6 = 5 THEN 'high' WHEN page_id % 4 = 0 THEN 'critical' ELSE 'medium' END AS threat_level,
      CAST(CASE WHEN page_id % 6 = 5 THEN 80 ELSE 75 END AS INT) AS confidence,
      CASE WHEN page_id % 6 = 5 THEN 'low,Critical,malware' WHEN page_id % 4 = 0 THEN 'low,Critical,delivery' ELSE 'delivery' END AS tags FROM pages""".replace(
        "CASE WHEN page_id % 6 = 5 THEN 'low,Critical,malware'", "CASE WHEN page_id % 6 = 5 THEN CASE page_id % 4 WHEN 0 THEN 'low,Critical,malware' ELSE 'malware' END"
    ),
)
def _(spark, sf):
    rows = S.stix_indicators(load(spark, sf, "pages").select(F.array(stix_entry()).alias("objects")))
    return stix_columns(rows)


@query(
    "misp_indicators",
    """SELECT CASE event_type WHEN 'view' THEN 'ip' WHEN 'click' THEN 'domain' WHEN 'error' THEN 'hash' WHEN 'signup' THEN 'email' ELSE 'pattern' END AS type, 'v' || event_id AS value,
      CASE user_id % 5 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 4 THEN 'low' ELSE 'medium' END AS threat_level,
      CAST(CASE WHEN event_id % 2 = 0 THEN 100 ELSE 50 END AS INT) AS confidence, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id ELSE 'info' END AS description FROM events
    UNION ALL SELECT CASE event_type WHEN 'view' THEN 'ip' WHEN 'click' THEN 'domain' WHEN 'error' THEN 'hash' ELSE 'pattern' END, 'v' || event_id,
      CASE user_id % 5 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 4 THEN 'low' ELSE 'medium' END, 75, 'box: ' || CASE WHEN event_id % 3 = 0 THEN 'c' || event_id ELSE '' END FROM events""",
)
def _(spark, sf):
    kind = F.expr(
        "CASE event_type WHEN 'view' THEN 'ip-src' WHEN 'click' THEN 'hostname' WHEN 'error' THEN 'SHA256' WHEN 'signup' THEN 'email-src' ELSE 'comment' END"
    )
    attribute = F.struct(
        kind.alias("type"), F.concat(F.lit("v"), "event_id").alias("value"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), "event_id")).otherwise("").alias("comment"),
        (F.col("event_id") % 2 == 0).alias("to_ids"), F.lit("1704067200").alias("timestamp"),
    )
    events = load(spark, sf, "events").select(
        F.lit(None).cast(S._struct(S.MISP_SCHEMA)["Event"].dataType).alias("Event"),
        (F.col("user_id") % 5).cast("string").alias("threat_level_id"), F.lit("info").alias("info"),
        F.array(F.struct(F.lit("tlp:green").alias("name"))).alias("Tag"), F.array(attribute).alias("Attribute"),
        F.array(F.struct(F.lit("box").alias("name"), F.array(attribute).alias("Attribute"))).alias("Object"),
    )
    return S.misp_indicators(events).select("type", "value", "threat_level", "confidence", "description")


MAPPING = {"type": "kind", "value": "indicator", "confidence": "score", "severity": "level", "categories": "groups", "tags": "marks", "expires_at": "until"}
RAW_FEED = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' ELSE '' END AS kind,
    CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN ' Host' || c_custkey ELSE '10.0.' || (c_custkey % 8) || '.' || c_custkey % 250 END AS indicator,
    CASE c_custkey % 10 WHEN 0 THEN 'n/a' ELSE '0.' || (50 + c_custkey % 50) END AS score, 'high' AS level,
    CASE c_custkey % 3 WHEN 0 THEN 'botnet,scanner' ELSE 'spam' END AS groups, 'a,b' AS marks,
    CASE c_custkey % 6 WHEN 0 THEN '2024-01-10T00:00:00Z' WHEN 1 THEN '2024-03-01T00:00:00Z' WHEN 2 THEN 'soon' END AS until, c_mktsegment AS segment FROM customer"""
FEED_SQL = f"""raw AS ({RAW_FEED}), fed AS (SELECT c_custkey, 'acme_' || kind || '_' || md5(indicator) AS id, kind AS type, indicator AS value, coalesce(try_cast(score AS DOUBLE), 0) AS confidence,
    CASE groups WHEN 'spam' THEN ['spam'] ELSE ['botnet', 'scanner'] END AS categories, CASE c_custkey % 6 WHEN 0 THEN TIMESTAMP '2024-01-10' WHEN 1 THEN TIMESTAMP '2024-03-01' END AS expires_at, segment
    FROM raw WHERE kind <> '' AND indicator <> '')"""


def fed(spark, sf):
    raw = _over(spark, sf, RAW_FEED, "customer").withColumnRenamed("c_custkey", "_key")
    return S.mapped_indicators(raw, "acme", MAPPING, as_of())


FEED_CONFIG = {
    "transforms": [{"operation": "trim", "field": "value"}, {"operation": "lowercase", "field": "value"}],
    "filters": [
        {"field": "confidence", "operator": "gt", "value": 0.55},
        {"field": "segment", "operator": "contains", "value": "U"},
    ],
    "validation": {"required": ["type", "value", "confidence"], "ip_validation": True, "domain_validation": True},
}


@query(
    "processed_feed",
    f"""WITH {FEED_SQL} SELECT id, type, lower(trim(value)) AS value, round(confidence, 6) AS confidence FROM fed WHERE confidence > 0.55 AND contains(segment, 'U')
      AND (type <> 'ip' OR len(string_split(trim(value), '.')) = 4) AND (type <> 'domain' OR contains(value, '.'))""",
)
def _(spark, sf):
    kept = D.process_feed(fed(spark, sf), FEED_CONFIG)
    return kept.select("id", "type", "value", F.round("confidence", 6).alias("confidence"))


@query(
    "auto_blocks",
    f"""WITH {FEED_SQL} SELECT value AS ip_address, 'Auto-blocked: ' || array_to_string(categories, ',') AS reason, epoch_us(TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR) AS expires_us, round(confidence, 6) AS confidence
    FROM fed WHERE type = 'ip' AND confidence >= 0.9 AND list_contains(categories, 'botnet')""",
)
def _(spark, sf):
    rules = D.auto_block(
        fed(spark, sf), as_of(), threshold=0.7, block_seconds=3600, high_confidence=True, categories=["botnet"],
        excluded_sources=["other"],
    )
    return rules.select(
        "ip_address", "reason", F.unix_micros("expires_at").alias("expires_us"), F.round("confidence", 6).alias("confidence")
    )


@query(
    "purged_indicators",
    f"""WITH {FEED_SQL}, gone AS (SELECT value FROM fed WHERE expires_at <= TIMESTAMP '{AS_OF}')
    SELECT (SELECT count(*) FROM fed WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}') AS indicators, (SELECT count(*) FROM fed WHERE type = 'ip' AND value NOT IN (SELECT value FROM gone)) AS blocks""",
)
def _(spark, sf):
    indicators = fed(spark, sf)
    blocks = indicators.filter("type = 'ip'").select(F.col("value").alias("ip_address"))
    live, kept = D.purge_expired(indicators, blocks, as_of())
    return live.agg(F.count(F.lit(1)).alias("indicators")).crossJoin(kept.agg(F.count(F.lit(1)).alias("blocks")))


@query(
    "known_threats",
    f"""WITH {FEED_SQL} SELECT DISTINCT '10.0.' || (user_id % 8) || '.' || (user_id % 250) AS value FROM events
    WHERE '10.0.' || (user_id % 8) || '.' || (user_id % 250) IN (SELECT value FROM fed WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')""",
)
def _(spark, sf):
    seen = load(spark, sf, "events").selectExpr("'10.0.' || (user_id % 8) || '.' || (user_id % 250) AS value").distinct()
    return D.threat_by_value(fed(spark, sf), seen, as_of())


@query(
    "merged_feed",
    """WITH cur AS (SELECT DISTINCT 'i' || s_suppkey AS id, s_acctbal AS confidence, 'base' AS src FROM supplier),
    upd AS (SELECT 'i' || (c_custkey % 160) AS id, c_custkey AS seq, c_acctbal AS confidence, 'feed' || (c_nationkey % 3) AS src FROM customer),
    srcs AS (SELECT id, string_agg(src, ',' ORDER BY f) AS s FROM (SELECT id, src, min(seq) AS f FROM upd GROUP BY 1, 2) GROUP BY 1),
    firsts AS (SELECT id, arg_min(confidence, seq) AS confidence FROM upd GROUP BY 1)
    SELECT coalesce(c.id, f.id) AS id, coalesce(c.confidence, f.confidence) AS confidence, concat_ws(',', c.src, s) AS sources, f.id IS NOT NULL AS touched
    FROM cur c FULL JOIN firsts f ON f.id = c.id LEFT JOIN srcs ON srcs.id = f.id""",
)
def _(spark, sf):
    stamp = F.lit("2023-01-01 00:00:00").cast("timestamp")
    current = load(spark, sf, "supplier").select(
        F.concat(F.lit("i"), "s_suppkey").alias("id"), F.col("s_acctbal").alias("confidence"),
        F.array(F.lit("base")).alias("sources"), stamp.alias("first_seen"), stamp.alias("last_seen"),
    )
    update = load(spark, sf, "customer").select(
        F.concat(F.lit("i"), F.col("c_custkey") % 160).alias("id"), F.col("c_acctbal").alias("confidence"),
        F.array(F.concat(F.lit("feed"), F.col("c_nationkey") % 3)).alias("sources"), as_of().alias("first_seen"),
        as_of().alias("last_seen"), F.col("c_custkey").alias("seq"),
    )
    merged = D.merge_feed(current, update, as_of())
    return merged.select(
        "id", "confidence", F.concat_ws(",", "sources").alias("sources"), (F.col("last_seen") == as_of()).alias("touched")
    )


UPSERT_SQL = """cur AS (SELECT 'ip' AS type, 'v' || s_suppkey AS value, 'low' AS threat_level, CAST(s_nationkey * 4 AS INT) AS confidence FROM supplier),
  upd AS (SELECT 'ip' AS type, 'v' || (c_custkey % 400) AS value, CASE c_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' END AS threat_level,
    CASE c_nationkey % 5 WHEN 0 THEN NULL ELSE CAST(c_nationkey * 3 AS INT) END AS confidence, c_custkey AS seq FROM customer),
  g AS (SELECT type, value, arg_max(threat_level, seq) FILTER (WHERE threat_level IS NOT NULL) AS lv, max(coalesce(confidence, 50)) AS cf FROM upd GROUP BY 1, 2),
  m AS (SELECT coalesce(c.value, g.value) AS value, CASE WHEN g.value IS NULL THEN c.threat_level ELSE coalesce(lv, c.threat_level, 'medium') END AS threat_level,
    CAST(greatest(c.confidence, cf) AS INT) AS confidence, CASE WHEN c.value IS NULL THEN 'added' WHEN g.value IS NULL THEN 'kept' ELSE 'updated' END AS change FROM cur c FULL JOIN g ON g.value = c.value)"""


def upserted(spark, sf):
    stamp = F.lit("2023-01-01 00:00:00").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    no_tags = F.array().cast("array<string>")
    current = load(spark, sf, "supplier").select(
        F.lit("ip").alias("type"), F.concat(F.lit("v"), "s_suppkey").alias("value"), F.lit("low").alias("threat_level"),
        (F.col("s_nationkey") * 4).cast("int").alias("confidence"), F.lit("").alias("description"), no_tags.alias("tags"),
        stamp.alias("first_seen"), stamp.alias("last_seen"), none.alias("expires"), F.lit(False).alias("active"), F.lit(1).alias("feed_id"),
    )
    batch = load(spark, sf, "customer").select(
        F.lit("ip").alias("type"), F.concat(F.lit("v"), F.col("c_custkey") % 400).alias("value"),
        F.expr("CASE c_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' END").alias("threat_level"),
        F.expr("CASE c_nationkey % 5 WHEN 0 THEN NULL ELSE c_nationkey * 3 END").cast("int").alias("confidence"),
        F.lit("d").alias("description"), no_tags.alias("tags"), none.alias("first_seen"), none.alias("expires"),
        F.col("c_custkey").alias("seq"),
    )
    return D.upsert_indicators(current, batch, as_of(), feed_id=7)


@query("indicator_upsert", f"WITH {UPSERT_SQL} SELECT * FROM m")
def _(spark, sf):
    return upserted(spark, sf).select("value", "threat_level", "confidence", "change")


@query(
    "upsert_report",
    f"WITH {UPSERT_SQL} SELECT count_if(change = 'added') AS added, count_if(change = 'updated') AS updated, count_if(change <> 'kept') AS total FROM m",
)
def _(spark, sf):
    return D.upsert_report(upserted(spark, sf))


@query(
    "changed_files",
    "SELECT page_id FROM pages WHERE NOT (page_id % 3 = 0)",
)
def _(spark, sf):
    pages = load(spark, sf, "pages")
    files = pages.select(F.col("page_id").alias("feed"), F.col("html").alias("content"), "page_id")
    old = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.concat("html", F.lit("x")))
    previous = pages.select(F.col("page_id").alias("feed"), F.md5(old).alias("content_md5"))
    return D.changed_files(files, previous).select("page_id")


# --- column quality ----------------------------------------------------------------------------------------------

WORDS_SQL = "w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS place FROM documents)"


def words(spark, sf):
    """Every word of every document, with its place; of every fourth document also a mail address built of each."""
    docs = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    docs = docs.select("doc_id", "word", (F.col("at") + 1).cast("long").alias("place"))
    mail = F.when(F.col("doc_id") % 4 == 0, F.concat("word", F.lit("@Mail.Example.com "))).otherwise(F.col("word"))
    return docs.withColumn("mail", mail)


EMAIL_RE2 = Q.EMAIL.replace(r"\z", "$")


@query(
    "email_scan",
    f"""WITH {WORDS_SQL}, m AS (SELECT doc_id, place, trim(CASE doc_id % 4 WHEN 0 THEN word || '@Mail.Example.com ' ELSE word END, E' \\t\\n\\r') AS v FROM w),
    r AS (SELECT *, length(v) <= 254 AND length(string_split(v, '@')[1]) <= 64 AND regexp_matches(v, {_q(EMAIL_RE2)}) AS ok FROM m)
    SELECT doc_id, place, ok AS is_valid, CASE WHEN ok THEN lower(v) END AS value, CASE WHEN NOT ok THEN 'Invalid email address' END AS error,
      CASE WHEN regexp_matches(lower(v), '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$') THEN lower(v) END AS cleaned FROM r""",
)
def _(spark, sf):
    mail = F.col("mail")
    return words(spark, sf).withColumn("r", Q.email(mail)).select("doc_id", "place", "r.*", Q.clean_email(mail).alias("cleaned"))


@query(
    "url_quality",
    """WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN 'http://localhost:80/x' WHEN 2 THEN 'http://box/' || page_id WHEN 3 THEN 'JavaScript:' || url ELSE url END AS v FROM pages)
    SELECT page_id, is_valid, CASE WHEN NOT is_valid THEN CASE WHEN page_id % 5 IN (0, 3) THEN 'URL scheme must be one of: http, https' ELSE 'Invalid URL' END END AS error, CASE WHEN page_id % 5 <> 3 THEN v WHEN false THEN v END AS cleaned FROM (
      SELECT *, page_id % 5 IN (1, 4) AS is_valid FROM u)""".replace("CASE WHEN page_id % 5 <> 3 THEN v WHEN false THEN v END", "CASE WHEN page_id % 5 <> 3 AND NOT starts_with(v, 'ftps') THEN v END"),
)
def _(spark, sf):
    v = F.expr(
        "CASE page_id % 5 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN 'http://localhost:80/x' WHEN 2 THEN 'http://box/' || page_id WHEN 3 THEN 'JavaScript:' || url ELSE url END"
    )
    pages = load(spark, sf, "pages").select("page_id", v.alias("v"))
    checked = pages.withColumn("r", Q.url()(F.col("v")))
    return checked.select("page_id", "r.is_valid", "r.error", Q.clean_url(F.col("v")).alias("cleaned"))


WORD_RULES: QJ.Rules = [
    ("word", "not_empty", Q.not_empty), ("word", "length", Q.length(3, 9)), ("word", "alphanumeric", Q.alphanumeric()),
    ("word", "slug", Q.slug), ("word", "match", Q.match("[A-Z]")), ("word", "hostname", Q.hostname()),
    ("mail", "email", Q.email), ("mail", "trimmed", Q.trimmed()), ("word", "one_of", Q.one_of(["der", "THE", "en"], case_sensitive=False)),
]
LABEL = Q.LABEL


@query(
    "column_report",
    f"""WITH {WORDS_SQL}, m AS (SELECT word, CASE doc_id % 4 WHEN 0 THEN word || '@Mail.Example.com ' ELSE word END AS mail FROM w),
    t AS (SELECT count(*) AS rows, [{{'column': 'word', 'rule': 'not_empty', 'valid': count_if(length(trim(word, E' \\t\\n\\r')) > 0)}}, {{'column': 'word', 'rule': 'length', 'valid': count_if(length(word) BETWEEN 3 AND 9)}},
      {{'column': 'word', 'rule': 'alphanumeric', 'valid': count_if(regexp_matches(word, '^[a-zA-Z0-9]+$'))}}, {{'column': 'word', 'rule': 'slug', 'valid': count_if(regexp_matches(word, '^[a-z0-9]+(?:-[a-z0-9]+)*$'))}},
      {{'column': 'word', 'rule': 'match', 'valid': count_if(regexp_matches(word, '^[A-Z]'))}}, {{'column': 'word', 'rule': 'hostname', 'valid': count_if(regexp_matches(lower(trim(word, E' \\t\\n\\r')), {_q(f'^{LABEL}(?:[.]{LABEL})*$')}))}},
      {{'column': 'mail', 'rule': 'email', 'valid': count_if(regexp_matches(trim(mail, E' \\t\\n\\r'), {_q(EMAIL_RE2)}))}}, {{'column': 'mail', 'rule': 'trimmed', 'valid': count_if(length(trim(mail, E' \\t\\n\\r')) > 0)}},
      {{'column': 'word', 'rule': 'one_of', 'valid': count_if(lower(word) IN ('der', 'the', 'en'))}}] AS a FROM m)
    SELECT u."column", u.rule, rows, u.valid, rows - u.valid AS invalid FROM (SELECT rows, unnest(a) AS u FROM t)""",
)
def _(spark, sf):
    return QJ.quality_report(words(spark, sf), WORD_RULES)


@query(
    "quarantined_servers",
    """SELECT c_custkey, concat_ws('; ', CASE WHEN c_custkey % 7 = 0 THEN 'type: Value must be one of: mysql, postgresql, mssql, mongodb, redis' END,
        CASE WHEN c_custkey % 5 = 0 THEN 'port: Value must be an integer' END, CASE WHEN c_custkey % 11 = 0 THEN 'role: Value must be one of: read, write, both' END) AS errors
    FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 11 = 0""",
)
def _(spark, sf):
    rows = load(spark, sf, "customer").selectExpr(
        "c_custkey", "c_name AS name", "CASE c_custkey % 7 WHEN 0 THEN 'oracle' ELSE 'mysql' END AS type", "'h' || c_custkey AS host",
        "CASE c_custkey % 5 WHEN 0 THEN '3306.5' ELSE '3306' END AS port", "CASE c_custkey % 11 WHEN 0 THEN 'none' ELSE 'both' END AS role",
    )
    _, quarantine, _ = QJ.check_columns(rows, QJ.TABLE_RULES["database_server"])
    return quarantine.select("c_custkey", F.concat_ws("; ", "errors").alias("errors"))


@query(
    "number_checks",
    """SELECT event_id, event_id % 4 <> 1 AND event_id % 4 <> 3 AS is_int, event_id % 4 <> 3 AS is_number, event_id % 4 IN (0, 2) AND event_id BETWEEN 100 AND 5000 AS in_range,
      event_id % 4 <> 3 AND event_id > 0 AS positive,
      CASE WHEN event_id % 4 IN (1, 3) THEN 'Value must be an integer' WHEN event_id < 100 THEN 'Value must be at least 100' WHEN event_id > 5000 THEN 'Value must be at most 5000' END AS error
    FROM events""",
)
def _(spark, sf):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, F.concat(e, F.lit(".5"))).when(
        e % 4 == 2, F.concat(F.lit(" "), e)
    ).otherwise(F.concat(e, F.lit("x")))
    df = load(spark, sf, "events").select("event_id", text.alias("t"))
    t, ranged = F.col("t"), Q.int_range(100, 5000)
    return df.select(
        "event_id", Q.integer(t)["is_valid"].alias("is_int"), Q.number(t)["is_valid"].alias("is_number"),
        ranged(t)["is_valid"].alias("in_range"), Q.signed()(t)["is_valid"].alias("positive"), ranged(t)["error"].alias("error"),
    )


@query(
    "date_checks",
    """SELECT o_orderkey, o_orderkey % 3 <> 1 AS is_date, o_orderkey % 3 <> 1 AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AS in_range,
      CASE WHEN o_orderkey % 3 = 1 THEN 'Invalid date format. Expected: %Y-%m-%d' WHEN o_orderdate < DATE '1996-01-01' THEN 'Date must be on or after 1996-01-01'
        WHEN o_orderdate > DATE '1998-12-31' THEN 'Date must be on or before 1998-12-31' END AS error FROM orders""",
)
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(day)
    df = load(spark, sf, "orders").select("o_orderkey", text.alias("d"))
    ranged = Q.date_range("1996-01-01", "1998-12-31")(F.col("d"))
    return df.select(
        "o_orderkey", Q.temporal("date")(F.col("d"))["is_valid"].alias("is_date"), ranged["is_valid"].alias("in_range"),
        ranged["error"].alias("error"),
    )


@query(
    "address_checks",
    """SELECT event_id, event_id % 4 IN (0, 2) AS valid4, event_id % 4 IN (1) AS valid6, event_id % 4 <> 3 AS valid FROM events""",
)
def _(spark, sf):
    e = F.col("event_id")
    text = (
        F.when(e % 4 == 0, F.concat(F.lit("10.0.0."), e % 256)).when(e % 4 == 1, F.concat(F.lit("fe80::"), F.hex(e % 4096)))
        .when(e % 4 == 2, F.lit("255.255.255.0 ")).otherwise(F.concat(F.lit("10.0.0."), e % 256 + 256))
    )
    df = load(spark, sf, "events").select("event_id", text.alias("t"))
    t = F.col("t")
    return df.select(
        "event_id", Q.ip_address(4)(t)["is_valid"].alias("valid4"), Q.ip_address(6)(t)["is_valid"].alias("valid6"),
        Q.ip_address()(t)["is_valid"].alias("valid"),
    )


PASSWORD = "CASE page_id % 4 WHEN 0 THEN 'Abc' || page_id || '!xyz#Long' WHEN 1 THEN 'password' || page_id WHEN 2 THEN 'aaa' || page_id ELSE 'Qz' || md5(url) || '_9' END"


@query(
    "password_checks",
    f"""WITH p AS (SELECT page_id, {PASSWORD} AS w FROM pages), f AS (SELECT *, regexp_matches(w, '[a-z]') AS lo, regexp_matches(w, '[A-Z]') AS up, regexp_matches(w, '[0-9]') AS di, regexp_matches(w, '[^a-zA-Z0-9]') AS sp FROM p)
    SELECT page_id, length(w) >= 12 AND lo AND up AND di AND sp AS is_valid,
      nullif(concat_ws('; ', CASE WHEN length(w) < 12 THEN 'Password must be at least 12 characters' END, CASE WHEN NOT up THEN 'Password must contain at least one uppercase letter' END,
        CASE WHEN NOT sp THEN 'Password must contain at least one special character (!@#$%^&*()...)' END), '') AS error,
      CAST(least(100, least(length(w) * 2, 30) + (lo::INT + up::INT + di::INT + sp::INT) * 10 + floor(len(list_distinct(string_split(w, ''))) / length(w) * 20)
        + CASE WHEN regexp_matches(lower(w), '^123|abc|qwerty|password') OR len(list_filter(range(1, length(w) - 1), lambda i: lower(w)[i] = lower(w)[i + 1] AND lower(w)[i] = lower(w)[i + 2])) > 0 THEN 0 ELSE 10 END) AS INT) AS score FROM f""",
)
def _(spark, sf):
    df = load(spark, sf, "pages").select("page_id", F.expr(PASSWORD).alias("w"))
    checked = df.withColumn("r", Q.password("strong")(F.col("w")))
    return checked.select("page_id", "r.is_valid", "r.error", Q.password_score(F.col("w")).alias("score"))


@query(
    "html_escapes",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;')) AS digest FROM pages""",
)
def _(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(Q.escape_html(F.col("html"))).alias("digest"))


@query(
    "html_strip",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b[^<]*(?:<[^/][^<]*|</[^s][^<]*|<)*?</script>', '', 'g'), '(?i)\son\w+\s*=\s*["''][^"'']*["'']', '', 'g'), '(?i)\son\w+\s*=\s*[^\s>]*', '', 'g'),
      '(?i)javascript:', '', 'g'), '(?i)data:text/html', '', 'g'), '(?is)<iframe\b.*?</iframe>', '', 'g')) AS digest FROM pages""",
)
def _(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(Q.strip_active_html(F.col("html"))).alias("digest"))


@query(
    "sql_token_strip",
    "SELECT doc_id, md5("
    + "".join("regexp_replace(" for _ in Q.SQL_TOKENS)
    + "translate(text, '''\";', '')"
    + "".join(f", '(?i){t}', '', 'g')" for t in Q.SQL_TOKENS)
    + ") AS digest FROM documents",
)
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(Q.strip_sql_tokens(F.col("text"))).alias("digest"))


@query(
    "safe_paths",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/b' || page_id WHEN 1 THEN NULL WHEN 2 THEN 'c' || page_id || '/' ELSE NULL END AS path FROM pages""",
)
def _(spark, sf):
    page = F.col("page_id")
    raw = (
        F.when(page % 4 == 0, F.concat(F.lit("./a//x/../b"), page)).when(page % 4 == 1, F.concat(F.lit("a/../../b"), page))
        .when(page % 4 == 2, F.concat(F.lit("c"), page, F.lit("/./"))).otherwise(F.concat(F.lit("/etc/"), page))
    )
    return load(spark, sf, "pages").select("page_id", Q.safe_path(raw).alias("path"))


@query(
    "paths_within",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/srv/data/a/b' || page_id WHEN 2 THEN '/srv/data/c' || page_id WHEN 4 THEN '/srv/data' END AS path FROM pages""",
)
def _(spark, sf):
    page = F.col("page_id")
    raw = (
        F.when(page % 5 == 0, F.concat(F.lit("./a//x/../b"), page)).when(page % 5 == 1, F.concat(F.lit("a/../../data2/b"), page))
        .when(page % 5 == 2, F.concat(F.lit("c"), page, F.lit("/./"))).when(page % 5 == 3, F.concat(F.lit("/srv/data/"), page)).otherwise("x/..")
    )
    return load(spark, sf, "pages").select("page_id", Q.path_within(raw, "/srv//data/").alias("path"))


# --- scripts ------------------------------------------------------------------------------------------------------


@query(
    "script_catalogue",
    f"""SELECT doc_id, CAST(length(text) AS INT) AS file_size, sha256(text) AS checksum, {SQL_SEVERITY} IN ('low', 'medium') AS security_validated
    FROM (SELECT doc_id, text, lower(text) AS low FROM documents)""",
)
def _(spark, sf):
    described = X.describe_scripts(load(spark, sf, "documents").select("doc_id", "text"), "text")
    return described.select("doc_id", "file_size", "checksum", "security_validated")


@query(
    "config_snapshot",
    f"""{ctes('indicators')} SELECT section, count(*) AS n, min(key) AS first_key FROM (SELECT 'users' AS section, c_name AS key FROM customer
      UNION ALL SELECT 'indicators', type || ':' || value FROM indicators WHERE active UNION ALL SELECT 'databases', s_suppkey::VARCHAR FROM supplier WHERE s_acctbal > 0) GROUP BY 1""",
)
def _(spark, sf):
    rows = X.snapshot_rows(
        {
            "users": (load(spark, sf, "customer"), "c_name"),
            "indicators": (X.indicator_keys(derive(spark, sf, "indicators")), "key"),
            "databases": (load(spark, sf, "supplier").withColumn("active", F.col("s_acctbal") > 0), "s_suppkey"),
        }
    )
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


@query(
    "audit_trail",
    f"""SELECT level, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level FROM events)
    WHERE level IN {sql_in(['WARNING', 'CRITICAL'])} GROUP BY 1""",
)
def _(spark, sf):
    level = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return rollups.count_per(X.filter_audit(load(spark, sf, "events").withColumn("level", level), "WARNING"), "level")


@query(
    "identified_findings",
    f"""WITH per AS ({VERSION_SQL}) SELECT server, 'tls_disabled_' || server || '_' || CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) AS issue_id FROM per WHERE NOT tls_enabled""",
)
def _(spark, sf):
    found = G.tls_findings(_over(spark, sf, VERSION_SQL, "customer"), as_of()).filter("type = 'tls_disabled'")
    return G.with_identity(found, as_of()).select("server", "issue_id")
