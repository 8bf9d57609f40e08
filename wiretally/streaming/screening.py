"""Staged screening of a log: the same plan serves batch tables and streams.

Rules, indicators, policies and permissions are static tables; each stage adds one candidate
reason by equi-join or folded expression, and the first stage that denies decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions import commands as C
from wiretally.functions.screening import is_write_query
from wiretally.operators.access import authorize
from wiretally.operators.matching import match_blocked, match_threats
from wiretally.operators.screen import classify_queries, first_denial

_TEMPORARY = ("blocked", "rule_id", "reason", "kind", "detail", "flagged", "authorized")


def _decide(df: DataFrame, stages) -> DataFrame:
    guarded = [(n, F.coalesce(c, F.lit(False)), why) for n, c, why in stages]
    stage, reason = first_denial(guarded)
    decided = df.withColumn("stage", stage).withColumn("deny_reason", reason)
    return decided.withColumn("decision", F.when(F.col("stage").isNull(), "allow").otherwise("deny"))


def screen_sql(
    log: DataFrame, *, rules: DataFrame, indicators: DataFrame, permissions: DataFrame, policy: DataFrame | None = None,
    key: str = "log_id",
) -> DataFrame:
    """Blocked resource, then attack pattern, then threat indicator, then permission.

    Adds ``stage, deny_reason, decision``; the log carries ``database, username, table, query,
    source_ip``.
    """
    df = match_threats(log, indicators, policy)  # first, as it may take its input more than once
    df = match_blocked(df, rules)
    df = classify_queries(df)
    df = df.withColumn("is_write", is_write_query(F.col("query")))
    df = authorize(df, permissions)
    decided = _decide(
        df,
        [
            ("blocked", F.col("blocked"), F.col("reason")),
            ("pattern", F.col("flagged"), F.col("detail")),
            ("threat", F.col("indicator_id").isNotNull(), F.col("match_reason")),
            ("permission", ~F.col("authorized"), F.lit("not permitted")),
        ],
    )
    return decided.drop(*_TEMPORARY, "is_write")


def screen_commands(log: DataFrame, *, rules: DataFrame, permissions: DataFrame) -> DataFrame:
    """Key-value traffic (``line``): blocked resource, dangerous command, permission."""
    df = match_blocked(log, rules)
    command = C.parse_kv_command(F.col("line"))["command"]
    df = df.withColumn("_command", command).withColumn("is_write", C.is_write_kv(F.col("_command")))
    df = authorize(df, permissions)
    decided = _decide(
        df,
        [
            ("blocked", F.col("blocked"), F.col("reason")),
            ("command", C.is_blocked_kv(F.col("_command")), F.lit("dangerous command")),
            ("permission", ~F.col("authorized"), F.lit("not permitted")),
        ],
    )
    return decided.drop(*_TEMPORARY, "_command", "is_write")


def screen_documents(log: DataFrame, *, rules: DataFrame, permissions: DataFrame) -> DataFrame:
    """Document-store traffic (``message, collection``): blocked resource, dangerous operation, permission."""
    df = match_blocked(log, rules)
    df = df.withColumn("_op", C.doc_operation(F.col("message"))).withColumn("is_write", C.is_write_doc(F.col("_op")))
    df = authorize(df, permissions)
    decided = _decide(
        df,
        [
            ("blocked", F.col("blocked"), F.col("reason")),
            ("operation", C.is_blocked_doc(F.col("_op"), F.col("collection")), F.lit("dangerous operation")),
            ("permission", ~F.col("authorized"), F.lit("not permitted")),
        ],
    )
    return decided.drop(*_TEMPORARY, "_op", "is_write")
