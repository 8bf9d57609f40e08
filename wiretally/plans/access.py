"""Queries over rules, indicators, address lists, logins and permissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.functions.fingerprint import primary_table
from wiretally.functions.screening import is_write_query
from wiretally.operators import access as A
from wiretally.operators import matching as M
from wiretally.operators import netblocks as N
from wiretally.operators import rollups, views
from wiretally.plans.inputs import AS_OF, as_of, ctes, derive, lists, load, permissions, users
from wiretally.plans.registry import query


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RULES_SQL = "rules(id, kind, pattern, reason) AS (VALUES " + ", ".join(
    f"({i}, {_q(k)}, {_q(p)}, {_q(r)})" for i, (k, p, r) in enumerate(packs.DEFAULT_BLOCKED)
) + ")"


def rule_sql(kind: str, target: str) -> str:
    return f"""(SELECT min(id) FROM rules WHERE kind = '{kind}' AND {target} <> ''
      AND (regexp_matches(lower({target}), pattern) OR contains(lower({target}), lower(pattern))))"""


@query(
    "blocked_access",
    f"""{ctes('query_log')}, {RULES_SQL}, t AS (SELECT *, CASE event_type WHEN 'error' THEN 'users' WHEN 'signup' THEN 'accounts'
        WHEN 'purchase' THEN 'carts' ELSE 'shop.orders' END AS tab,
        CASE user_id % 29 WHEN 0 THEN 'Admin' WHEN 1 THEN '' ELSE username END AS login FROM query_log),
    keys AS (SELECT DISTINCT database, login, tab FROM t),
    m AS (SELECT *, coalesce({rule_sql('database', 'database')}, {rule_sql('username', 'login')}, {rule_sql('table', 'tab')}) AS rule_id FROM keys)
    SELECT log_id, rule_id IS NOT NULL AS blocked, CAST(rule_id AS BIGINT) AS rule_id, reason
    FROM t JOIN m USING (database, login, tab) LEFT JOIN rules ON rules.id = rule_id""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log")
    log = log.withColumn("tab", F.when(F.col("event_type") == "purchase", F.lit("carts")).otherwise(primary_table(F.col("query"))))
    login = F.when(F.col("user_id") % 29 == 0, "Admin").when(F.col("user_id") % 29 == 1, "").otherwise(F.col("username"))
    checked = M.match_blocked(log.withColumn("login", login), M.default_rules(spark), username="login", table="tab")
    return checked.select("log_id", "blocked", "rule_id", "reason")


POLICY_SQL = "policy(database, checked) AS (VALUES ('test', false), ('shop', true))"


def policy(spark, sf):
    """Databases seen in the log, with threat checks off for one of them."""
    names = derive(spark, sf, "query_log").select("database").distinct().filter(F.col("database") != "orders_backup")
    return names.withColumn("threat_intel_blocks_enabled", F.col("database") != "test")


THREATS_SQL = f"""{ctes('query_log', 'indicators')}, {POLICY_SQL}, live AS (SELECT * FROM indicators WHERE active),
  ip AS (SELECT value, min(id) AS id FROM live WHERE type = 'ip' GROUP BY 1),
  email AS (SELECT lower(value) AS value, min(id) AS id FROM live WHERE type = 'email' GROUP BY 1),
  txt AS (SELECT lower(value) AS value, id FROM live WHERE type IN ('sql_pattern', 'domain', 'url')),
  hit AS (SELECT log_id, min(id) AS id FROM query_log JOIN txt ON contains(lower(query), txt.value) GROUP BY 1),
  m AS (SELECT l.*, CASE WHEN coalesce(checked, true) THEN least(ip.id, email.id, hit.id) END AS indicator_id
    FROM query_log l LEFT JOIN policy USING (database) LEFT JOIN ip ON ip.value = source_ip
    LEFT JOIN email ON email.value = lower(username) LEFT JOIN hit USING (log_id))"""


@query(
    "threat_matches",
    f"""{THREATS_SQL} SELECT log_id, indicator_id, type AS indicator_type, i.value AS indicator_value, threat_level,
      CASE type WHEN 'ip' THEN 'Source IP ' || source_ip || ' matches threat indicator'
        WHEN 'sql_pattern' THEN 'Query contains threat pattern: ' || i.value
        WHEN 'email' THEN 'Username ' || username || ' matches threat indicator'
        WHEN 'domain' THEN 'Query contains threat indicator: ' || i.value
        WHEN 'url' THEN 'Query contains threat indicator: ' || i.value END AS match_reason
    FROM m LEFT JOIN indicators i ON i.id = indicator_id""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log")
    log = log.withColumn("source_ip", F.concat("source_ip", F.lit(":5432")))
    matched = M.match_threats(log, derive(spark, sf, "indicators"), policy(spark, sf))
    return matched.select("log_id", "indicator_id", "indicator_type", "indicator_value", "threat_level", "match_reason")


@query(
    "threat_match_counts",
    f"{THREATS_SQL} SELECT indicator_id, count(*) AS matches FROM m WHERE indicator_id IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    matched = M.match_threats(derive(spark, sf, "query_log"), derive(spark, sf, "indicators"), policy(spark, sf))
    return M.match_counts(matched)


WORD_NEEDLES = """WITH needles AS (SELECT min(doc_id) AS id, w FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents)
    WHERE length(w) > 0 GROUP BY w)"""


def word_needles(spark, sf):
    """Every word of every document, as an indicator with the lowest id of a document that holds it."""
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split(F.lower("text"), " ")).alias("needle"))


@query(
    "url_threats",
    f"""{WORD_NEEDLES} SELECT page_id, min(id) AS indicator_id FROM pages LEFT JOIN needles ON contains(lower(url), w) GROUP BY 1""",
)
def _(spark, sf):
    needles = word_needles(spark, sf)
    pages = load(spark, sf, "pages").select("page_id", F.lower("url").alias("low"))
    return M.substring_first(pages, "low", needles, "indicator_id").drop("low")


@query(
    "url_threats_by_gram",
    f"""{WORD_NEEDLES} SELECT page_id, min(id) AS indicator_id FROM pages LEFT JOIN needles ON contains(lower(html), w) GROUP BY 1""",
)
def _(spark, sf):
    needles = word_needles(spark, sf)
    pages = load(spark, sf, "pages").select("page_id", F.lower("html").alias("low"))
    return M.substring_first(pages, "low", needles, "indicator_id").drop("low")


# --- addresses -------------------------------------------------------------------------------------------

BLOCKS_SQL = """blocked AS (SELECT 167772160 + (c_custkey % 8) * 256 + (c_custkey % 250 + 1) AS ip, CAST(min(c_nationkey % 3) AS INT) AS code
    FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1),
  nets AS (SELECT DISTINCT CASE s_suppkey % 2 WHEN 0 THEN 4294967232 ELSE 4294967280 END AS mask,
    167772160 + (s_suppkey % 8) * 256 + CASE s_suppkey % 2 WHEN 0 THEN (s_suppkey % 4) * 64 ELSE (s_suppkey % 16) * 16 END AS network
    FROM supplier WHERE s_nationkey % 5 = 0)"""


def blocked_ips(spark, sf):
    return load(spark, sf, "customer").selectExpr(
        "167772160 + (c_custkey % 8) * 256 + (c_custkey % 250 + 1) AS ip", "c_nationkey % 3 AS reason_code", "c_custkey % 5 = 0 AS active"
    )


def blocked_nets(spark, sf):
    texts = load(spark, sf, "supplier").selectExpr(
        "s_nationkey % 5 = 0 AS active", "CASE s_suppkey % 2 WHEN 0 THEN '10.0.' || (s_suppkey % 8) || '.' || ((s_suppkey % 4) * 64) || '/26' "
        "ELSE '10.0.' || (s_suppkey % 8) || '.' || ((s_suppkey % 16) * 16) || '/28' END AS cidr"
    )
    return N.parse_cidrs(texts, "cidr")


FILTERED_SQL = f"""{ctes('packets')}, {BLOCKS_SQL}, hits AS (SELECT DISTINCT ip FROM (SELECT DISTINCT ip FROM packets) p
    JOIN nets ON (p.ip & nets.mask) = nets.network),
  decided AS (SELECT p.event_id, CASE WHEN b.ip IS NOT NULL THEN CASE code WHEN 1 THEN 'sql_injection' WHEN 2 THEN 'rate_limit' ELSE 'manual' END
      WHEN h.ip IS NOT NULL THEN 'manual' END AS reason FROM packets p LEFT JOIN blocked b ON b.ip = p.ip LEFT JOIN hits h ON h.ip = p.ip)"""


@query(
    "cidr_blocks",
    f"{FILTERED_SQL} SELECT event_id, reason, CASE WHEN reason IS NULL THEN 'pass' ELSE 'drop' END AS decision FROM decided",
)
def _(spark, sf):
    requests = derive(spark, sf, "packets").select("event_id", F.col("ip").cast("bigint").alias("ip"))
    return N.filter_requests(requests, blocked_ips(spark, sf), blocked_nets(spark, sf)).drop("ip")


@query(
    "filter_stats",
    f"""{FILTERED_SQL} SELECT count(*) AS total, count_if(reason IS NOT NULL) AS blocked, count_if(reason IS NULL) AS allowed,
      count_if(event_id % 10 = 7) AS ipv6, count_if(event_id % 10 = 8) AS non_ip, count_if(reason = 'sql_injection') AS sql_injection,
      count_if(reason = 'rate_limit') AS rate_limit, count_if(reason = 'manual') AS manual FROM decided""",
)
def _(spark, sf):
    family = F.when(F.col("event_id") % 10 == 7, "ipv6").when(F.col("event_id") % 10 == 8, "arp").otherwise("ipv4")
    requests = derive(spark, sf, "packets").select("event_id", F.col("ip").cast("bigint").alias("ip"), family.alias("family"))
    return N.filter_stats(N.filter_requests(requests, blocked_ips(spark, sf), blocked_nets(spark, sf)), family="family")


@query(
    "whitelisted_clients",
    f"""{ctes('packets')}, {BLOCKS_SQL} SELECT ip IN (SELECT ip FROM blocked) AS whitelisted, count(*) AS n FROM packets GROUP BY 1""",
)
def _(spark, sf):
    marked = N.exempt(derive(spark, sf, "packets"), blocked_ips(spark, sf))
    return marked.groupBy("whitelisted").agg(F.count(F.lit(1)).alias("n"))


def sql_ip(text: str) -> str:
    return f"({' + '.join(f'try_cast(string_split({text}, chr(46))[{i}] AS BIGINT) * {256 ** (4 - i)}' for i in range(1, 5))})"


SQL_IN_LIST = f"""len(list_filter(ips, lambda e: CASE WHEN contains(e, '/') THEN coalesce(
    ({sql_ip('source_ip')} >> (32 - try_cast(string_split(e, '/')[2] AS INT))) = ({sql_ip("string_split(e, '/')[1]")} >> (32 - try_cast(string_split(e, '/')[2] AS INT))), false)
  ELSE e = source_ip END)) > 0"""


@query(
    "allowed_addresses",
    f"""{ctes('query_log', 'users')}, u AS (SELECT username, {lists('ip_list')} AS ips FROM users)
    SELECT log_id, CASE WHEN len(ips) > 0 THEN {SQL_IN_LIST} ELSE true END AS ip_allowed
    FROM query_log LEFT JOIN u USING (username)""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log").select("log_id", "username", "source_ip")
    return N.ip_allowed(log, users(spark, sf)).select("log_id", "ip_allowed")


# --- logins and permissions ------------------------------------------------------------------------------


def login_sql(check_ip: bool) -> str:
    address = f"WHEN len(ips) > 0 AND NOT ({SQL_IN_LIST}) THEN 'address not allowed'" if check_ip else ""
    return f"""CASE WHEN u.username IS NULL OR NOT enabled THEN 'user not found or disabled'
      WHEN expires_at < TIMESTAMP '{AS_OF}' THEN 'account expired' {address}
      WHEN p.username IS NULL THEN 'no permission'
      WHEN p.database <> '*' AND p.database <> l.database THEN 'database access denied'
      WHEN time_limit < TIMESTAMP '{AS_OF}' THEN 'database access expired' END"""


@query(
    "authn_decisions",
    f"""{ctes('query_log', 'users', 'permissions')}, u AS (SELECT *, {lists('ip_list')} AS ips FROM users)
    SELECT log_id, deny_reason IS NULL AS allowed, deny_reason FROM (SELECT log_id, {login_sql(True)} AS deny_reason
      FROM query_log l LEFT JOIN u ON u.username = l.username LEFT JOIN permissions p ON p.username = l.username)""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log").select("log_id", "username", "database", "source_ip")
    return A.authenticate(log, users(spark, sf), permissions(spark, sf), as_of()).select("log_id", "allowed", "deny_reason")


@query(
    "authn_by_key",
    f"""{ctes('query_log', 'users', 'permissions')}, l AS (SELECT *, 'key-' || (user_id * 5) AS k FROM query_log)
    SELECT log_id, deny_reason IS NULL AS allowed, deny_reason FROM (SELECT log_id,
      CASE WHEN u.username IS NULL THEN 'unknown api key' ELSE {login_sql(False)} END AS deny_reason
      FROM l LEFT JOIN (SELECT * FROM users WHERE enabled) u ON u.api_key = l.k LEFT JOIN permissions p ON p.username = u.username)""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log").select(
        "log_id", "database", F.concat(F.lit("key-"), F.col("user_id") * 5).alias("api_key")
    )
    decided = A.authenticate_key(log, users(spark, sf), permissions(spark, sf), as_of())
    return decided.select("log_id", "allowed", "deny_reason")


TABLE_OF = "CASE event_type WHEN 'error' THEN '' WHEN 'purchase' THEN 'carts' ELSE 'orders' END"


@query(
    "authz_decisions",
    f"""{ctes('query_log', 'permissions')}, l AS (SELECT *, {TABLE_OF} AS tab, CASE WHEN event_type IN ('signup', 'purchase') THEN 'write' ELSE 'read' END AS act FROM query_log)
    SELECT log_id, coalesce((p.database = '*' OR p.database = l.database) AND (tab = '' OR p.table = '*' OR p.table = tab)
      AND (list_contains(string_split(action_list, ','), act) OR action_list = '*'), false) AS authorized
    FROM l LEFT JOIN permissions p USING (username)""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log").select(
        "log_id", "username", "database", F.expr(TABLE_OF).alias("table"), is_write_query(F.col("query")).alias("is_write")
    )
    return A.authorize(log, permissions(spark, sf)).select("log_id", "authorized")


ENTRY_SQL = """SELECT 'q' || c_custkey AS cache_key, CASE c_custkey % 3 WHEN 0 THEN 'shop' ELSE '' END AS database, '' AS table,
    CASE c_custkey % 4 WHEN 0 THEN 'user_' || c_custkey ELSE '' END AS allowed_list,
    CASE c_custkey % 9 WHEN 0 THEN 'user_' || c_custkey ELSE '' END AS denied_list,
    CASE c_custkey % 5 WHEN 0 THEN 'ops,dba' ELSE '' END AS group_list,
    CASE c_custkey % 7 WHEN 0 THEN 'reader' ELSE '' END AS role_list, '' AS permission_list,
    c_custkey % 11 = 0 AS require_tls, c_custkey % 13 = 0 AS require_api_key FROM customer"""
REQUEST_SQL = """SELECT event_id AS log_id, 'q' || user_id AS cache_key, 'user_' || user_id AS username,
    CASE user_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'orders_backup' ELSE 'shop' END AS database, 'orders' AS table,
    event_id % 2 = 0 AS use_tls, CASE event_id % 3 WHEN 0 THEN 'k' ELSE '' END AS api_key,
    CASE event_id % 4 WHEN 0 THEN 'dba' WHEN 1 THEN 'dev,ops' ELSE '' END AS group_list,
    CASE event_id % 5 WHEN 0 THEN 'reader,writer' ELSE '' END AS role_list, '' AS permission_list,
    event_id % 17 <> 0 AS user_ok FROM events"""


@query(
    "cache_authorization",
    f"""WITH entries AS ({ENTRY_SQL}), requests AS ({REQUEST_SQL})
    SELECT log_id, deny_reason IS NULL AS served, deny_reason FROM (SELECT log_id, nullif(CASE
      WHEN e.cache_key IS NULL THEN 'not cached' WHEN list_contains({lists('denied_list')}, username) THEN 'user denied'
      WHEN list_contains({lists('allowed_list')}, username) THEN '' WHEN require_tls AND NOT use_tls THEN 'tls required'
      WHEN require_api_key AND api_key = '' THEN 'api key required'
      WHEN e.group_list <> '' AND NOT list_has_any({lists('e.group_list')}, {lists('r.group_list')}) THEN 'group missing'
      WHEN e.role_list <> '' AND NOT list_has_any({lists('e.role_list')}, {lists('r.role_list')}) THEN 'role missing'
      WHEN e.database <> '' AND e.database <> r.database THEN 'other database'
      WHEN NOT user_ok THEN 'user access' END, '') AS deny_reason
    FROM requests r LEFT JOIN entries e USING (cache_key))""",
)
def _(spark, sf):
    def arrays(df, names):
        for name in names:
            text = F.col(f"{name}_list")
            target = {"allowed": "allowed_users", "denied": "denied_users"}.get(name, f"{name}s")
            df = df.withColumn(target, F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ",")))
        return df.drop(*[f"{n}_list" for n in names])

    customer, events = load(spark, sf, "customer"), load(spark, sf, "events")
    entries = spark.sql(ENTRY_SQL.replace("FROM customer", "FROM {customer}"), customer=customer)
    requests = spark.sql(REQUEST_SQL.replace("FROM events", "FROM {events}"), events=events)
    decided = A.authorize_cache(
        arrays(requests, ["group", "role", "permission"]),
        arrays(entries, ["allowed", "denied", "group", "role", "permission"]),
    )
    return decided.select("log_id", "served", "deny_reason")


PROFILE_SQL = """SELECT c_custkey AS user_id, 'k' || c_custkey AS api_key, c_custkey % 2 = 0 AS require_tls,
    CAST(c_custkey % 100 AS INT) AS rate_limit, c_custkey % 6 <> 0 AS is_active FROM customer WHERE c_custkey % 3 <> 0"""


def profiles(spark, sf):
    return spark.sql(PROFILE_SQL.replace("FROM customer", "FROM {c}"), c=load(spark, sf, "customer"))


@query(
    "user_nested",
    f"""{ctes('permissions')}, profiles AS ({PROFILE_SQL}), grants AS (SELECT o_custkey AS user_id,
        string_agg('db' || (o_orderkey % 3) || '.' || o_orderstatus || '#' || o_orderkey, ',' ORDER BY 'db' || (o_orderkey % 3), o_orderstatus, o_orderkey) AS grants
      FROM orders GROUP BY 1)
    SELECT c_custkey AS user_id, coalesce(api_key, '') AS api_key, coalesce(require_tls, false) AS require_tls,
      coalesce(rate_limit, 0) AS rate_limit, coalesce(is_active, true) AS is_active, coalesce(grants, '') AS grants
    FROM customer LEFT JOIN profiles p ON p.user_id = c_custkey LEFT JOIN grants g ON g.user_id = c_custkey""",
)
def _(spark, sf):
    people = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    grants = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.concat(F.lit("db"), F.col("o_orderkey") % 3).alias("database"),
        F.col("o_orderstatus").alias("table"), F.col("o_orderkey").alias("permission_id"), F.array(F.lit("read")).alias("actions"),
    )
    nested = A.users_enhanced(people, profiles(spark, sf), grants, parts=4)
    text = lambda p: F.concat(p["database"], F.lit("."), p["table"], F.lit("#"), p["permission_id"])
    whole = nested.groupBy("user_id", "api_key", "require_tls", "rate_limit", "is_active").agg(F.flatten(F.collect_list("permissions")).alias("p"))  # the few rows of a user
    return whole.withColumn("grants", F.concat_ws(",", F.transform(F.sort_array("p"), text))).drop("p")


@query(
    "temporary_access",
    f"""SELECT expired, count(*) AS n FROM (SELECT ts + INTERVAL 2 DAYS < TIMESTAMP '{AS_OF}' AS expired FROM events WHERE event_id % 3 <> 0) GROUP BY 1""",
)
def _(spark, sf):
    grants = load(spark, sf, "events").select(
        (F.col("event_id") % 3 != 0).alias("is_active"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires_at")
    )
    return A.temporary_access(grants, as_of()).groupBy("expired").agg(F.count(F.lit(1)).alias("n"))


# --- staged screening --------------------------------------------------------------------------------------


@query(
    "screened_log",
    f"""{THREATS_SQL}, {RULES_SQL}, perms AS (SELECT * FROM permissions_t),
    keys AS (SELECT DISTINCT database, username FROM query_log),
    blocked AS (SELECT *, coalesce({rule_sql('database', 'database')}, {rule_sql('username', 'username')}) AS rule_id FROM keys),
    s AS (SELECT m.log_id, rule_id, indicator_id, lower(query) AS low, {TABLE_OF.replace("''", "'users'")} AS tab, event_type, m.username, m.database
      FROM m JOIN blocked USING (database, username)),
    staged AS (SELECT log_id, CASE WHEN rule_id IS NOT NULL THEN 'blocked' WHEN regexp_matches(low, 'or\\s+1=1') THEN 'pattern'
      WHEN indicator_id IS NOT NULL THEN 'threat'
      WHEN NOT coalesce((p.database = '*' OR p.database = s.database) AND (p.table = '*' OR p.table = tab)
        AND (list_contains(string_split(action_list, ','), CASE WHEN event_type IN ('signup', 'purchase') THEN 'write' ELSE 'read' END) OR action_list = '*'), false) THEN 'permission'
      END AS stage FROM s LEFT JOIN perms p USING (username))
    SELECT log_id, stage, CASE WHEN stage IS NULL THEN 'allow' ELSE 'deny' END AS decision FROM staged""".replace(
        "SELECT * FROM permissions_t", __import__("wiretally.plans.inputs", fromlist=["DERIVED"]).DERIVED["permissions"]
    ),
)
def _(spark, sf):
    from wiretally.streaming.screening import screen_sql

    log = derive(spark, sf, "query_log").withColumn("table", F.expr(TABLE_OF.replace("''", "'users'")))
    decided = screen_sql(
        log, rules=M.default_rules(spark), indicators=derive(spark, sf, "indicators"), policy=policy(spark, sf),
        permissions=permissions(spark, sf),
    )
    return decided.select("log_id", "stage", "decision")


# --- first matching wildcard rule ----------------------------------------------------------------------------

CACHE_RULES_SQL = """SELECT s_suppkey AS ord, 'p' || (s_suppkey // 5) AS policy, s_suppkey % 6 <> 0 AS enabled,
    CASE s_suppkey % 3 WHEN 0 THEN 'shop' WHEN 1 THEN '*' ELSE 'test' END AS database,
    CASE s_suppkey % 4 WHEN 0 THEN '' ELSE 'table' || (s_suppkey % 9) END AS table,
    CASE s_suppkey % 5 WHEN 0 THEN '*' WHEN 1 THEN 'view' WHEN 2 THEN 'click' ELSE 'error' END AS operation,
    CASE s_suppkey % 2 WHEN 0 THEN '*' ELSE 'user_' || (s_suppkey % 50) END AS user,
    CASE s_suppkey % 3 WHEN 0 THEN 'bypass' ELSE 'cache' END AS action, 'tier' || (s_suppkey % 3) AS tier,
    CAST(CASE s_suppkey % 4 WHEN 0 THEN 0 ELSE s_suppkey * 10 END AS BIGINT) AS ttl_s,
    'rule' || s_suppkey AS name, 'group' || (s_suppkey % 4) AS "group",
    CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'quorum' ELSE 'async' END AS strategy FROM supplier"""
REQ_SQL = """SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'orders_backup' ELSE 'shop' END AS database,
    'table' || (event_id % 9) AS table, event_type AS operation, 'user_' || user_id AS user FROM events"""
WILD_SQL = """(r.database IN ('', '*') OR r.database = q.database) AND (r.table IN ('', '*') OR r.table = q.table)
    AND (r.operation IN ('', '*') OR r.operation = q.operation) AND (r.user IN ('', '*') OR r.user = q.user)"""
FIRST_SQL = f"""WITH rules AS ({CACHE_RULES_SQL}), q AS ({REQ_SQL}),
  first AS (SELECT q.event_id, min(r.ord) AS ord FROM q LEFT JOIN rules r ON enabled AND {WILD_SQL} GROUP BY 1)"""


def wild_rules(spark, sf):
    text = CACHE_RULES_SQL.replace('"group"', "`group`").replace("s_suppkey // 5", "s_suppkey div 5")
    return spark.sql(text.replace("FROM supplier", "FROM {s}"), s=load(spark, sf, "supplier"))


def wild_requests(spark, sf):
    return spark.sql(REQ_SQL.replace("FROM events", "FROM {e}"), e=load(spark, sf, "events"))


@query(
    "policy_first_match",
    f"""{FIRST_SQL} SELECT event_id, policy, action, tier, CASE WHEN ttl_s = 0 THEN 300 ELSE ttl_s END AS ttl_s
    FROM first LEFT JOIN rules USING (ord)""",
)
def _(spark, sf):
    matched = M.match_cache_policy(wild_requests(spark, sf), wild_rules(spark, sf))
    return matched.select("event_id", "policy", "action", "tier", "ttl_s")


@query(
    "write_rule_match",
    f"""{FIRST_SQL} SELECT event_id, name AS rule_name, "group" AS cluster_group,
      CASE WHEN strategy = '' THEN 'sync' ELSE strategy END AS strategy FROM first LEFT JOIN rules USING (ord)""",
)
def _(spark, sf):
    matched = M.match_write_rule(wild_requests(spark, sf), wild_rules(spark, sf))
    return matched.select("event_id", "rule_name", "cluster_group", "strategy")


# --- control-plane pages -----------------------------------------------------------------------------------

AUDIT_SQL = """SELECT event_id AS id, user_id, ts AS timestamp, event_type AS action,
    'audit ' || props || ' ' || repeat('x', CAST(event_id % 150 AS INT)) AS query, event_id % 2500 AS indicator_id FROM events"""


def audit(spark, sf):
    return spark.sql(AUDIT_SQL.replace("FROM events", "FROM {e}"), e=load(spark, sf, "events"))


@query(
    "audit_page",
    f"""WITH log AS ({AUDIT_SQL}) SELECT id, action, substr(query, 1, 100) AS query,
      coalesce(c_name, 'System') AS user, (SELECT count(*) FROM log) AS total
    FROM (SELECT * FROM log ORDER BY timestamp DESC, id DESC LIMIT 100 OFFSET 50)
      LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = user_id""",
)
def _(spark, sf):
    people = load(spark, sf, "customer").filter("c_custkey % 4 <> 0").selectExpr("c_custkey AS user_id", "c_name AS username")
    return views.audit_page(audit(spark, sf), people, limit=100, offset=50).select("id", "action", "query", "user", "total")


@query(
    "indicator_page",
    f"""{ctes('indicators')} SELECT id, type, value, coalesce(n_name, 'Manual') AS feed_name, total FROM (
      SELECT *, (SELECT count(*) FROM indicators WHERE active AND type = 'url' AND threat_level = 'high') AS total,
        substr(feed, 5)::INT AS fid FROM indicators
      WHERE active AND type = 'url' AND threat_level = 'high' ORDER BY id % 97 DESC, id DESC LIMIT 20)
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 3) ON n_nationkey = fid""",
)
def _(spark, sf):
    indicators = derive(spark, sf, "indicators").withColumn("last_seen", F.col("id") % 97).withColumn(
        "feed_id", F.substring("feed", 5, 9).cast("int")
    )
    feeds = load(spark, sf, "nation").filter("n_nationkey < 3").selectExpr("n_nationkey AS feed_id", "n_name AS name")
    page = views.indicator_page(indicators.drop("feed"), feeds, kind="url", level="high", limit=20)
    return page.select("id", "type", "value", F.col("feed").alias("feed_name"), "total")


@query(
    "match_page",
    f"""{ctes('indicators')}, log AS ({AUDIT_SQL}) SELECT l.id, substr(query, 1, 200) AS query, coalesce(type, 'unknown') AS indicator_type,
      coalesce(value, 'unknown') AS indicator_value, coalesce(c_name, 'System') AS user, (SELECT count(*) FROM log) AS total
    FROM (SELECT * FROM log ORDER BY timestamp DESC, id DESC LIMIT 60) l LEFT JOIN indicators i ON i.id = indicator_id
      LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = user_id""",
)
def _(spark, sf):
    people = load(spark, sf, "customer").filter("c_custkey % 4 <> 0").selectExpr("c_custkey AS user_id", "c_name AS username")
    page = views.match_page(audit(spark, sf), derive(spark, sf, "indicators"), people, limit=60)
    return page.select("id", "query", "indicator_type", "indicator_value", "user", "total")


FILES_SQL = """SELECT doc_id AS file_id, doc_id % 150 AS database_id, doc_id % 70 AS executed_by,
    doc_id % 3 = 0 AS executed, n_chars < 4000 AS security_validated FROM documents"""
DATABASES_SQL = """SELECT s_suppkey AS database_id, s_name AS name, s_nationkey + 5 AS server_id, s_acctbal > 0 AS active,
    'db_' || s_suppkey AS database_name FROM supplier"""
SERVERS_SQL = """SELECT n_nationkey AS server_id, n_name AS name, n_regionkey <> 2 AS active,
    CASE n_regionkey WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' WHEN 2 THEN 'redis' ELSE 'mongodb' END AS type FROM nation"""


def files(spark, sf):
    return spark.sql(FILES_SQL.replace("FROM documents", "FROM {d}"), d=load(spark, sf, "documents"))


def databases(spark, sf):
    return spark.sql(DATABASES_SQL.replace("FROM supplier", "FROM {s}"), s=load(spark, sf, "supplier"))


def servers(spark, sf):
    return spark.sql(SERVERS_SQL.replace("FROM nation", "FROM {n}"), n=load(spark, sf, "nation"))


@query(
    "sql_file_view",
    f"""WITH f AS ({FILES_SQL}), d AS ({DATABASES_SQL}) SELECT file_id, coalesce(d.name, 'Unknown') AS database_name, c_name AS executed_by_name
    FROM f LEFT JOIN d USING (database_id) LEFT JOIN customer ON c_custkey = executed_by""",
)
def _(spark, sf):
    people = load(spark, sf, "customer").selectExpr("c_custkey AS user_id", "c_name AS username")
    return views.sql_file_view(files(spark, sf), databases(spark, sf), people).select(
        "file_id", "database_name", "executed_by_name"
    )


@query(
    "managed_databases",
    f"""WITH d AS ({DATABASES_SQL}), s AS ({SERVERS_SQL}) SELECT database_id, s.name AS server_name, s.type AS server_type
    FROM d LEFT JOIN s USING (server_id) WHERE d.active""",
)
def _(spark, sf):
    view = views.managed_db_view(databases(spark, sf), servers(spark, sf))
    return view.select("database_id", "server_name", "server_type")


@query(
    "database_policies",
    f"""WITH d AS ({DATABASES_SQL}) SELECT c_custkey AS config_id, database_name AS database, c_custkey % 2 = 0 AS audit_logging
    FROM customer JOIN d ON database_id = c_custkey % 130""",
)
def _(spark, sf):
    configs = load(spark, sf, "customer").selectExpr(
        "c_custkey AS config_id", "c_custkey % 130 AS database_id", "c_custkey % 2 = 0 AS audit_logging"
    )
    return views.policy_view(configs, databases(spark, sf)).drop("database_id")


@query(
    "runnable_files",
    f"""WITH f AS ({FILES_SQL}), d AS ({DATABASES_SQL}), s AS ({SERVERS_SQL}) SELECT file_id FROM f
    WHERE NOT executed AND security_validated AND database_id IN (SELECT database_id FROM d WHERE server_id IN (SELECT server_id FROM s))""",
)
def _(spark, sf):
    return views.runnable_files(files(spark, sf), databases(spark, sf), servers(spark, sf)).select("file_id")


@query(
    "schema_view",
    """SELECT p_size % 5 AS database_id, p_brand AS table_name, string_agg(p_name || ':' || p_type, ',' ORDER BY p_name, p_type) AS columns
    FROM (SELECT DISTINCT p_size, p_brand, p_name || '#' || p_partkey AS p_name, p_type FROM part) GROUP BY 1, 2""",
)
def _(spark, sf):
    columns = load(spark, sf, "part").select(
        (F.col("p_size") % 5).alias("database_id"), F.col("p_brand").alias("table_name"),
        F.concat("p_name", F.lit("#"), "p_partkey").alias("column_name"), F.col("p_type").alias("data_type"),
        F.lit(True).alias("is_nullable"),
    )
    nested = views.schema_view(columns, parts=3)
    whole = nested.groupBy("database_id", "table_name").agg(F.sort_array(F.flatten(F.collect_list("columns"))).alias("c"))
    text = F.transform("c", lambda c: F.concat(c["column_name"], F.lit(":"), c["data_type"]))
    return whole.withColumn("columns", F.concat_ws(",", text)).drop("c")


# --- counts over decisions -----------------------------------------------------------------------------------


@query(
    "threat_match_levels",
    f"""{THREATS_SQL} SELECT indicator_id, threat_level, count(*) AS matches FROM m JOIN indicators i ON i.id = indicator_id GROUP BY 1, 2""",
)
def _(spark, sf):
    matched = M.match_threats(derive(spark, sf, "query_log"), derive(spark, sf, "indicators"), policy(spark, sf))
    return rollups.match_levels(matched)


@query(
    "packet_actions",
    f"{FILTERED_SQL} SELECT CASE WHEN reason IS NULL THEN 'pass' ELSE 'drop' END AS decision, count(*) AS packets FROM decided GROUP BY 1",
)
def _(spark, sf):
    requests = derive(spark, sf, "packets").select("event_id", F.col("ip").cast("bigint").alias("ip"))
    return rollups.packet_actions(N.filter_requests(requests, blocked_ips(spark, sf), blocked_nets(spark, sf)))


CUSTOM_SQL = """SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey % 3 WHEN 0 THEN 'USER_ID = [0-9]*' || n_nationkey || '$' WHEN 1 THEN 'total = ' || n_nationkey || ' ' ELSE '(' END AS pattern,
    CASE n_regionkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'alert' ELSE 'log' END AS action, CASE n_regionkey % 2 WHEN 0 THEN 'high' ELSE 'low' END AS severity, n_nationkey % 5 <> 4 AS active FROM nation"""


@query(
    "custom_rule_hits",
    f"""{ctes('query_log')}, r AS ({CUSTOM_SQL}), hit AS (SELECT log_id, min(id) AS id FROM query_log JOIN (SELECT * FROM r WHERE active AND pattern <> '(') x
      ON regexp_matches(lower(query), '(?i)' || pattern) GROUP BY 1)
    SELECT log_id, hit.id AS custom_rule, action, severity FROM query_log LEFT JOIN hit USING (log_id) LEFT JOIN r ON r.id = hit.id""",
)
def _(spark, sf):
    rules = spark.sql(CUSTOM_SQL.replace("FROM nation", "FROM {n}"), n=load(spark, sf, "nation"))
    log = derive(spark, sf, "query_log").select("log_id", "query")
    return M.match_security_rules(log, rules).drop("query")
