"""Queries over screening: injection and shell flags, script validation, command classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import commands as C
from wiretally.functions import fingerprint as fp
from wiretally.functions import packs
from wiretally.functions import screening as S
from wiretally.operators import netblocks, rollups, screen
from wiretally.plans.inputs import ctes, derive, load
from wiretally.plans.registry import query


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(column: str, groups: list[list[str]]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_quoted(p)})" for g in groups for p in g) + ")"


def sql_unicode(column: str, pattern: str) -> str:
    r"""A script pattern for RE2, whose own ``\b`` knows ASCII words only."""
    edge_left, edge_right = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    if pattern.startswith(r"\b"):
        pattern = edge_left + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + edge_right
    return f"regexp_matches({column}, {_quoted(pattern)}{', ' + _quoted('m') if pattern.startswith('--') else ''})"


def sql_hits(column: str, pack) -> str:
    return "(" + " OR ".join(sql_unicode(column, p) for p, _ in pack) + ")"


def sql_in(values) -> str:
    return "(" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in values) + ")"


HEURISTICS = """(
  CAST(length(low) - length(replace(low, '''', '')) > 4 AS INT)
  + CAST(length(low) - length(replace(low, '"', '')) > 4 AS INT)
  + CAST(contains(low, '1=1') OR contains(low, '1 = 1') AS INT)
  + CAST(contains(low, ''' or ''') OR contains(low, '" or "') AS INT))"""

SQL_KIND = f"""CASE WHEN {sql_any('low', packs.SHELL_GROUPS)} THEN 'shell_command'
  WHEN {sql_any('low', packs.INJECTION_GROUPS)} THEN 'sql_injection'
  WHEN {HEURISTICS} >= 2 THEN 'heuristic' ELSE '' END"""

SQL_DETAIL = """CASE kind WHEN 'shell_command' THEN 'Shell command execution detected'
  WHEN 'sql_injection' THEN 'SQL injection pattern detected'
  WHEN 'heuristic' THEN 'Multiple suspicious patterns: ' || concat_ws(', ',
    CASE WHEN length(low) - length(replace(low, '''', '')) > 4 THEN 'excessive single quotes' END,
    CASE WHEN length(low) - length(replace(low, '"', '')) > 4 THEN 'excessive double quotes' END,
    CASE WHEN contains(low, '1=1') OR contains(low, '1 = 1') THEN 'always-true condition' END,
    CASE WHEN contains(low, ''' or ''') OR contains(low, '" or "') THEN 'quote-based bypass attempt' END)
  ELSE '' END"""

SQL_HEADS = r"""list_distinct(list_transform(
  list_filter(list_transform(string_split(text, ';'), lambda s: regexp_extract(s, '^\s*(\S+)', 1)), lambda s: s <> ''),
  lambda s: upper(s)))"""

SQL_SEVERITY = f"""CASE WHEN {sql_hits('low', packs.SCRIPT_SHELL)} THEN 'critical'
  WHEN {sql_hits('low', packs.SCRIPT_DANGEROUS)} THEN 'high'
  WHEN {sql_hits('low', packs.SCRIPT_DEFAULTS)} OR len({SQL_HEADS}) > 1 THEN 'medium' ELSE 'low' END"""


@query(
    "screen_severity_by_source",
    f"""SELECT source, {SQL_SEVERITY} AS severity, count(*) AS n
    FROM (SELECT source, text, lower(text) AS low FROM documents) GROUP BY 1, 2""",
)
def _(spark, sf):
    return screen.severity_counts(load(spark, sf, "documents").select("source", "text"), "text", "source")


@query(
    "script_validation",
    f"""SELECT doc_id, n_errors = 0 AS valid, n_errors, severity, n_default, mixed, long_lines, non_ascii
    FROM (SELECT doc_id, {SQL_SEVERITY} AS severity,
      {' + '.join(f'CAST({sql_unicode("low", p)} AS INT)' for p, _ in packs.SCRIPT_DANGEROUS + packs.SCRIPT_SHELL)}
      + CAST(length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) AS INT)
      + CAST((length(text) - length(replace(text, '''', ''))) % 2 <> 0 AS INT) AS n_errors,
      {' + '.join(f'CAST({sql_unicode("low", p)} AS INT)' for p, _ in packs.SCRIPT_DEFAULTS)} AS n_default,
      len({SQL_HEADS}) > 1 AS mixed,
      CAST(len(list_filter(string_split(text, chr(10)), lambda s: length(s) > 1000)) AS INT) AS long_lines,
      regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii
      FROM (SELECT doc_id, text, lower(text) AS low FROM documents))""",
)
def _(spark, sf):
    checked = screen.validate_scripts(load(spark, sf, "documents").select("doc_id", "text"), "text")
    starting = lambda t: F.size(F.filter("warnings", lambda w: w.startswith(t))).cast("int")
    return checked.select(
        "doc_id", "valid", F.size("errors").alias("n_errors"), "severity",
        starting("Potential default/test").alias("n_default"),
        (starting("Multiple different") > 0).alias("mixed"),
        starting("Extremely long line").alias("long_lines"),
        (starting("Non-ASCII") > 0).alias("non_ascii"),
    )


@query(
    "injection_flags",
    f"""{ctes('query_log')} SELECT log_id, {sql_any('low', packs.INJECTION_GROUPS)} OR {HEURISTICS} >= 2 AS injection
    FROM (SELECT log_id, lower(query) AS low FROM query_log)""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log").select("log_id", "query")
    return screen.flag_injections(log).drop("query")


@query(
    "shell_flags",
    f"SELECT conv_id, turn, {sql_any('low', packs.SHELL_GROUPS)} AS shell FROM (SELECT conv_id, turn, lower(text) AS low FROM conversations)",
)
def _(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", S.is_shell_command(F.col("text")).alias("shell"))


@query(
    "classified_queries",
    f"""SELECT doc_id, kind, {SQL_DETAIL} AS detail, kind <> '' AS flagged
    FROM (SELECT doc_id, low, {SQL_KIND} AS kind FROM (SELECT doc_id, lower(text) AS low FROM documents))""",
)
def _(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return screen.classify_queries(docs, "text").drop("text")


@query(
    "screening_totals",
    f"""{ctes('query_log')} SELECT database, count(*) AS total, count_if(kind <> '') AS blocked, count_if(kind = '') AS clean,
      count_if(kind = 'shell_command') AS shell_command, count_if(kind = 'sql_injection') AS sql_injection,
      count_if(kind = 'heuristic') AS heuristic
    FROM (SELECT database, {SQL_KIND} AS kind FROM (SELECT database, lower(query) AS low FROM query_log)) GROUP BY 1""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log").select("database", "query")
    return screen.screening_totals(screen.classify_queries(log), ["database"])


@query(
    "screening_quality",
    f"""SELECT count(*) AS total, count_if(bad) AS malicious, count_if(bad AND hit) AS detected,
      count_if(NOT bad AND hit) AS false_positives,
      round(count_if(bad AND hit) * 100.0 / nullif(count_if(bad), 0), 4) AS detection_rate,
      round(count_if(NOT bad AND hit) * 100.0 / nullif(count_if(NOT bad), 0), 4) AS false_positive_rate
    FROM (SELECT toxic = 1 AS bad, {SQL_KIND} <> '' AS hit
      FROM (SELECT toxic, lower(text) AS low FROM documents JOIN labels USING (doc_id)))""",
)
def _(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text").join(load(spark, sf, "labels"), "doc_id")
    marked = screen.classify_queries(docs, "text").withColumn("bad", F.col("toxic") == 1)
    return screen.screening_quality(marked, "flagged", "bad")


@query(
    "query_classes",
    f"""{ctes('query_log')} SELECT db_type, query_type, operation, table_name, count(*) AS queries FROM (
      SELECT db_type,
        CASE WHEN regexp_matches(upper(trim(query)), '^({'|'.join(packs.WRITE_KEYWORDS)})') THEN 'write' ELSE 'read' END AS query_type,
        CASE WHEN starts_with(query, 'SELECT') THEN 'SELECT' WHEN starts_with(query, 'INSERT') THEN 'INSERT'
          WHEN starts_with(query, 'UPDATE') THEN 'UPDATE' ELSE 'OTHER' END AS operation,
        CASE WHEN contains(lower(query), 'from ') THEN regexp_extract(string_split(lower(query), 'from ')[2], '(\\S+)', 1)
          WHEN contains(lower(query), 'into ') THEN regexp_extract(string_split(lower(query), 'into ')[2], '(\\S+)', 1)
          ELSE regexp_extract(string_split(lower(query), 'update ')[2], '(\\S+)', 1) END AS table_name
      FROM query_log) GROUP BY ALL""",
)
def _(spark, sf):
    q = F.col("query")
    log = derive(spark, sf, "query_log").select(
        "db_type",
        F.when(S.is_write_query(q), "write").otherwise("read").alias("query_type"),
        fp.sql_operation(q).alias("operation"),
        fp.primary_table(q).alias("table_name"),
    )
    return rollups.count_per(log, "db_type", "query_type", "operation", "table_name", out="queries")


@query(
    "query_counts",
    f"""{ctes('query_log')} SELECT db_type,
      CASE WHEN event_type IN ('signup', 'purchase') THEN 'write' ELSE 'read' END AS query_type, count(*) AS queries
    FROM query_log GROUP BY 1, 2""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log")
    kind = F.when(S.is_write_query(F.col("query")), "write").otherwise("read")
    return rollups.query_counts(log.withColumn("query_type", kind))


@query(
    "kv_commands",
    f"""{ctes('commands')}, parsed AS (SELECT event_id, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS w FROM commands),
    named AS (SELECT event_id, w, regexp_replace(w[1], '^\\*', '') AS command FROM parsed)
    SELECT event_id, command, CAST(len(w) - 1 AS INT) AS n_args, coalesce(w[2], '') AS key,
      upper(command) IN {sql_in(packs.KV_READS)} AS is_read,
      upper(command) IN {sql_in(packs.KV_BLOCKED)} AS blocked,
      upper(command) IN {sql_in(packs.KV_BLOCKED_CLUSTER)} AS blocked_cluster,
      upper(command) IN {sql_in(packs.KV_WRITES)} AS is_write FROM named""",
)
def _(spark, sf):
    parsed = derive(spark, sf, "commands").select("event_id", C.parse_kv_command(F.col("line")).alias("c"))
    command = F.col("c.command")
    return parsed.select(
        "event_id", "c.command", F.size("c.args").alias("n_args"), "c.key", "c.is_read",
        C.is_blocked_kv(command).alias("blocked"),
        C.is_blocked_kv(command, cluster=True).alias("blocked_cluster"),
        C.is_write_kv(command).alias("is_write"),
    )


@query(
    "doc_commands",
    f"""{ctes('commands')}, named AS (SELECT event_id, collection,
      CASE {' '.join(f"WHEN contains(lower(message), '{o}') THEN '{o}'" for o in packs.DOC_OPERATIONS)} ELSE 'unknown' END AS operation
      FROM commands)
    SELECT operation, collection,
      operation IN {sql_in(packs.DOC_BLOCKED_OPERATIONS)} OR collection IN {sql_in(packs.DOC_BLOCKED_COLLECTIONS)} AS blocked,
      operation IN {sql_in(packs.DOC_WRITES)} AS is_write, count(*) AS n FROM named GROUP BY ALL""",
)
def _(spark, sf):
    named = derive(spark, sf, "commands").withColumn("operation", C.doc_operation(F.col("message")))
    op = F.col("operation")
    return rollups.count_per(
        named.withColumn("blocked", C.is_blocked_doc(op, F.col("collection"))).withColumn("is_write", C.is_write_doc(op)),
        "operation", "collection", "blocked", "is_write",
    )


@query(
    "db_connections",
    f"""{ctes('packets')} SELECT dest_port, count(*) AS packets, count_if(syn AND NOT ack) AS new_connections
    FROM packets WHERE dest_port IN {sql_in(packs.DB_PORTS)} GROUP BY 1""",
)
def _(spark, sf):
    fresh = C.is_new_connection(F.col("syn"), F.col("ack"))
    return netblocks.db_traffic(derive(spark, sf, "packets")).groupBy("dest_port").agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(fresh).alias("new_connections")
    )


@query(
    "audit_levels",
    """SELECT category, level, count(*) AS n, count_if(level <> 'INFO') AS shown FROM (
      SELECT CASE event_type WHEN 'error' THEN 'SECURITY_EVENT' WHEN 'signup' THEN 'AUTHENTICATION'
          WHEN 'view' THEN 'DATA_ACCESS' WHEN 'click' THEN 'AUTHORIZATION' ELSE 'SYSTEM_EVENT' END AS category,
        CASE WHEN event_type = 'error' THEN 'CRITICAL' WHEN event_type = 'view' THEN 'INFO'
          WHEN 200 + event_id % 4 * 100 < 400 THEN 'INFO' ELSE 'WARNING' END AS level
      FROM events) GROUP BY 1, 2""",
)
def _(spark, sf):
    category = (
        F.when(F.col("event_type") == "error", "SECURITY_EVENT")
        .when(F.col("event_type") == "signup", "AUTHENTICATION")
        .when(F.col("event_type") == "view", "DATA_ACCESS")
        .when(F.col("event_type") == "click", "AUTHORIZATION")
        .otherwise("SYSTEM_EVENT")
    )
    outcome = C.http_outcome(200 + F.col("event_id") % 4 * 100)
    events = load(spark, sf, "events").select(category.alias("category"), outcome["success"].alias("success"))
    leveled = events.withColumn("level", C.audit_level(F.col("category"), F.col("success")))
    return leveled.groupBy("category", "level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(C.level_rank(F.col("level")) >= 1).alias("shown")
    )
