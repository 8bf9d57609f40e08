"""Screening of query logs and SQL scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.functions import screening as S
from wiretally.functions.screening import count_of


def flag_injections(log: DataFrame, query: str = "query") -> DataFrame:
    """Add ``injection``; the text is lower-cased once per row, not once per pattern."""
    return (
        log.withColumn("_low", F.lower(query)).withColumn("injection", S.injection_found(F.col("_low"))).drop("_low")
    )


def classify_queries(log: DataFrame, query: str = "query") -> DataFrame:
    """Add ``flagged, kind, detail``; each pattern is evaluated once per row."""
    return (
        log.withColumn("_low", F.lower(query))
        .withColumn("kind", S.query_kind(F.col("_low")))
        .withColumn("detail", S.kind_detail(F.col("kind"), F.col("_low")))
        .withColumn("flagged", F.col("kind") != "")
        .drop("_low")
    )


def validate_scripts(df: DataFrame, script: str) -> DataFrame:
    """Add ``valid, errors, warnings, severity, patterns_checked`` for a column of SQL scripts."""
    text = F.col(script)
    staged = (
        df.withColumn("_low", F.lower(script))
        .withColumn("_danger", S.script_messages(F.col("_low"), packs.SCRIPT_DANGEROUS, "{text}: {pattern}"))
        .withColumn(
            "_shell",
            S.script_messages(F.col("_low"), packs.SCRIPT_SHELL, "Shell command detected - {text}: {pattern}"),
        )
        .withColumn(
            "_default",
            S.script_messages(
                F.col("_low"), packs.SCRIPT_DEFAULTS, "Potential default/test resource access - {text}"
            ),
        )
        .withColumn("_heads", S.statement_heads(text))
    )
    syntax = F.array_compact(
        F.array(
            F.when(count_of(text, "(") != count_of(text, ")"), F.lit("Unmatched parentheses in SQL")),
            F.when(count_of(text, "'") % 2 != 0, F.lit("Unmatched single quotes in SQL")),
        )
    )
    mixed = F.array_compact(
        F.array(
            F.when(
                F.size("_heads") > 1,
                F.concat(
                    F.lit("Multiple different statement types detected: "), F.concat_ws(", ", F.col("_heads"))
                ),
            )
        )
    )
    encoding = F.array_compact(
        F.array(
            F.when(
                text.rlike(r"[^\x00-\x7F]"),
                F.lit("Non-ASCII characters detected - potential encoding attack"),
            )
        )
    )
    severity = (
        F.when(F.size("_shell") > 0, F.lit("critical"))
        .when(F.size("_danger") > 0, F.lit("high"))
        .when((F.size("_default") > 0) | (F.size("_heads") > 1), F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    checked = len(packs.SCRIPT_DANGEROUS) + len(packs.SCRIPT_SHELL) + len(packs.SCRIPT_DEFAULTS)
    return (
        staged.withColumn("errors", F.concat("_danger", "_shell", syntax))
        .withColumn("warnings", F.concat(F.col("_default"), mixed, S.long_line_messages(text), encoding))
        .withColumn("severity", severity)
        .withColumn("valid", F.size("errors") == 0)
        .withColumn("patterns_checked", F.lit(checked))
        .drop("_low", "_danger", "_shell", "_default", "_heads")
    )


def script_severity(df: DataFrame, script: str) -> DataFrame:
    """Add ``severity`` alone: stops at the first pattern that settles it, builds no messages."""
    low, text = F.col("_low"), F.col(script)
    mixed = text.contains(";") & (F.size(S.statement_heads(text)) > 1)
    severity = (
        F.when(S.script_any(low, packs.SCRIPT_SHELL), F.lit("critical"))
        .when(S.script_any(low, packs.SCRIPT_DANGEROUS), F.lit("high"))
        .when(S.script_any(low, packs.SCRIPT_DEFAULTS) | mixed, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return df.withColumn("_low", F.lower(script)).withColumn("severity", severity).drop("_low")


def severity_counts(df: DataFrame, script: str, by: str) -> DataFrame:
    return script_severity(df, script).groupBy(by, "severity").agg(F.count(F.lit(1)).alias("n"))


def screening_quality(labelled: DataFrame, flagged: str, malicious: str) -> DataFrame:
    """One row of totals plus detection and false-positive rates in percent."""
    flag, bad = F.col(flagged), F.col(malicious)
    return labelled.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(bad).alias("malicious"),
        F.count_if(bad & flag).alias("detected"),
        F.count_if(~bad & flag).alias("false_positives"),
    ).select(
        "*",
        F.round(F.try_divide(F.col("detected") * 100.0, F.col("malicious")), 4).alias("detection_rate"),
        F.round(
            F.try_divide(F.col("false_positives") * 100.0, F.col("total") - F.col("malicious")), 4
        ).alias("false_positive_rate"),
    )


def screening_totals(classified: DataFrame, by: list[str]) -> DataFrame:
    """Blocked / clean totals and counts per attack class of classified queries."""
    return classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("kind") != "").alias("blocked"),
        F.count_if(F.col("kind") == "").alias("clean"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("shell_command", "sql_injection", "heuristic")],
    )


def first_denial(stages: list[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """``(stage, reason)`` of the first stage that denies; both null when none does."""
    stage, reason = F, F
    for name, denied, why in stages:
        stage, reason = stage.when(denied, F.lit(name)), reason.when(denied, why)
    return stage.otherwise(F.lit(None)), reason.otherwise(F.lit(None))
