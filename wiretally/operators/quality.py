"""The column-quality job: valid rows, quarantined rows and a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.functions import quality as Q

Rules = list[tuple[str, str, Q.Rule]]

# --- fixed values: closed sets of the control-plane tables ------------------------------------------

_ENGINE = Q.one_of(packs.DB_TYPES)
TABLE_RULES: dict[str, Rules] = {
    "database_server": [
        ("name", "required", Q.not_empty),
        ("type", "set", _ENGINE),
        ("host", "required", Q.not_empty),
        ("port", "int", Q.integer),
        ("role", "set", Q.one_of(["read", "write", "both"])),
    ],
    "user_permission": [("user_id", "int", Q.integer), ("database_name", "required", Q.not_empty)],
    "security_rule": [
        ("name", "required", Q.not_empty),
        ("pattern", "required", Q.not_empty),
        ("action", "set", Q.one_of(["block", "alert", "log"])),
        ("severity", "set", Q.one_of(["low", "medium", "high", "critical"])),
    ],
    "blocked_database": [
        ("name", "required", Q.not_empty),
        ("type", "set", Q.one_of(["database", "username", "table"])),
        ("pattern", "required", Q.not_empty),
    ],
    "threat_intel_feed": [
        ("name", "required", Q.not_empty),
        ("type", "set", Q.one_of(["stix", "taxii", "openioc", "misp", "custom"])),
    ],
    "threat_intel_indicator": [
        (
            "indicator_type",
            "set",
            Q.one_of(["ip", "domain", "url", "hash", "email", "pattern", "sql_pattern", "user_agent"]),
        ),
        ("value", "required", Q.not_empty),
        ("threat_level", "set", Q.one_of(["info", "low", "medium", "high", "critical"])),
        ("confidence", "int", Q.integer),
    ],
    "cloud_database_instance": [
        ("instance_type", "set", _ENGINE),
        ("status", "set", Q.one_of(["creating", "available", "modifying", "deleting", "failed"])),
    ],
    "scaling_policy": [
        ("metric_type", "set", Q.one_of(["cpu", "memory", "connections", "iops"])),
        ("scale_up_threshold", "float", Q.number),
        ("scale_down_threshold", "float", Q.number),
    ],
    "scaling_event": [
        ("trigger_type", "set", Q.one_of(["threshold", "ai", "manual"])),
        ("action", "set", Q.one_of(["scale_up", "scale_down"])),
        ("status", "set", Q.one_of(["pending", "in_progress", "completed", "failed"])),
    ],
}


def checked(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``_checks``: one struct ``(column, rule, is_valid, value, error)`` per rule."""
    results = [
        F.struct(F.lit(column).alias("column"), F.lit(name).alias("rule"), rule(F.col(column).cast("string")).alias("r"))
        for column, name, rule in rules
    ]
    return df.withColumn("_checks", F.array(*results))


def check_columns(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(valid, quarantine, report)``: rows passing every rule; the others with ``errors``;
    totals per (column, rule)."""
    marked = checked(df, rules)
    ok = F.forall("_checks", lambda c: c["r"]["is_valid"])
    errors = F.transform(
        F.filter("_checks", lambda c: ~c["r"]["is_valid"]),
        lambda c: F.concat_ws(": ", c["column"], c["r"]["error"]),
    )
    valid = marked.filter(ok).drop("_checks")
    quarantine = marked.filter(~ok).withColumn("errors", errors).drop("_checks")
    return valid, quarantine, quality_report(df, rules)


def quality_report(df: DataFrame, rules: Rules) -> DataFrame:
    """Totals per (column, rule) from one pass without exploding rows."""
    tests = [
        (column, name, rule(F.col(column).cast("string"))["is_valid"]) for column, name, rule in rules
    ]
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(t).alias(f"_v{i}") for i, (_, _, t) in enumerate(tests)]
    )
    items = [
        F.struct(F.lit(c).alias("column"), F.lit(n).alias("rule"), F.col(f"_v{i}").alias("valid"))
        for i, (c, n, _) in enumerate(tests)
    ]
    return wide.select("rows", F.explode(F.array(*items)).alias("t")).select(
        "t.column", "t.rule", "rows", "t.valid", (F.col("rows") - F.col("t.valid")).alias("invalid")
    )


def error_counts(df: DataFrame, column: str, rule: Q.Rule) -> DataFrame:
    """How often each error of a rule occurs."""
    result = df.withColumn("_r", rule(F.col(column).cast("string")))
    return result.groupBy(F.coalesce("_r.error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def replaced(df: DataFrame, rules: Rules) -> DataFrame:
    """Columns replaced by their rules' values (null where a rule fails)."""
    return reduce(
        lambda acc, item: acc.withColumn(item[0], item[2](F.col(item[0]).cast("string"))["value"]), rules, df
    )
