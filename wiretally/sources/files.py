"""Sources and sinks over plain files: SQL corpora, scans, audit trails, exports, reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions.commands import level_rank
from wiretally.operators.screen import validate_scripts

_LEVELS = ["INFO", "WARNING", "CRITICAL"]


# --- SQL files -----------------------------------------------------------------------------------------


def describe_scripts(scripts: DataFrame, content: str = "content") -> DataFrame:
    """Size, digest and validation of scripts; ``security_validated`` for low and medium severity."""
    checked = validate_scripts(scripts, content)
    return (
        checked.withColumn("file_size", F.length(content))
        .withColumn("checksum", F.sha2(F.col(content), 256))
        .withColumn("syntax_validated", F.col("valid"))
        .withColumn("security_validated", F.col("severity").isin("low", "medium"))
        .withColumn("validation_errors", F.to_json("errors"))
        .drop("valid", "errors", "warnings", "patterns_checked")
    )


def scan_sql_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.sql")
    return describe_scripts(
        files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    )


# --- scans ---------------------------------------------------------------------------------------------


def store_scan(scans: DataFrame, path: str, *, batch: int) -> None:
    """Scan documents as JSON, one folder per batch and in it one per day of ``scan_ts``; a batch that is stored again replaces itself."""
    dated = scans.withColumn("scan_date", F.to_date("scan_ts"))
    dated.write.mode("overwrite").partitionBy("scan_date").json(f"{path}/batch={batch}")


def read_scans(spark: SparkSession, path: str, schema, as_of: Column, *, days: int = 7) -> DataFrame:
    """Scans of the last days, oldest first; only the day folders of the range are listed."""
    from pyspark.sql.types import DateType, StructType

    full = StructType([*schema.fields]).add("batch", "long").add("scan_date", DateType())
    start = as_of - F.make_dt_interval(F.lit(days))
    return (
        spark.read.schema(full)
        .json(path)
        .filter((F.col("scan_date") >= F.to_date(start)) & (F.col("scan_date") <= F.to_date(as_of)))
        .filter((F.col("scan_ts") >= start) & (F.col("scan_ts") <= as_of))
        .drop("scan_date", "batch")
        .orderBy("scan_ts")
    )


# --- audit trail and exports ------------------------------------------------------------------------------


def filter_audit(events: DataFrame, min_level: str) -> DataFrame:
    return events.filter(level_rank(F.col("level")) >= _LEVELS.index(min_level))


def packed_lines(lines: DataFrame, max_bytes: int) -> DataFrame:
    """(value, file): each task packs its lines in order into files of at most ``max_bytes`` with their line ends; a longer line has a file alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, filled = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            places = np.empty(len(sizes), np.int64)
            for i, size in enumerate(sizes.tolist()):
                if filled and filled + size > max_bytes:
                    number, filled = number + 1, 0
                filled += size
                places[i] = number
            files = pa.array([f"{part:05d}-{n:05d}" for n in places.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), files], names=["value", "file"])

    sized = lines.select("value", (F.octet_length("value") + 1).cast("long").alias("size"))
    return sized.mapInArrow(run, "value string, file string")


def write_audit(events: DataFrame, path: str, *, batch: int, min_level: str = "INFO", max_bytes: int = 100 << 20) -> None:
    """JSON lines at or above a level, in files of at most ``max_bytes``; a batch that is written again replaces itself."""
    chosen = filter_audit(events, min_level)
    lines = chosen.select(F.to_json(F.struct(*chosen.columns)).alias("value"))
    packed_lines(lines, max_bytes).write.mode("overwrite").partitionBy("file").text(f"{path}/batch={batch}")


def read_audit(spark: SparkSession, path: str, schema) -> DataFrame:
    """The events of all batches, with ``batch`` and ``file``."""
    lines = spark.read.schema("value string, batch long, file string").text(path)
    return lines.select(F.from_json("value", schema).alias("event"), "batch", "file").select("event.*", "batch", "file")


#: Kinds of values, and the shape that JSON gives them.
KV_KINDS = ("string", "hash", "list", "set", "zset")


def export_kv(entries: DataFrame, path: str) -> None:
    """Typed entries (``key, kind, value, ttl``) as gzip JSON lines; ``value`` is a ``VARIANT``: text, object, array, array, or array of [member, score]."""
    lines = entries.where(F.col("kind").isin(*KV_KINDS)).select("key", F.col("kind").alias("type"), "value", "ttl")
    lines.write.mode("overwrite").option("compression", "gzip").json(path)


def import_kv(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an export, whatever their kinds; lines that are no entry are left out."""
    read = spark.read.schema("key string, type string, value variant, ttl long").option("mode", "DROPMALFORMED").json(path)
    return read.select("key", F.col("type").alias("kind"), "value", "ttl").where(F.col("kind").isin(*KV_KINDS))


def record_matches(matches: DataFrame, path: str, as_of: Column, *, batch: int) -> None:
    """Matched rows with time and action, a folder per batch and in it one per day; a batch that is recorded again replaces itself."""
    (
        matches.filter(F.col("indicator_id").isNotNull())
        .withColumn("timestamp", as_of)
        .withColumn("action_taken", F.lit("blocked"))
        .withColumn("match_date", F.to_date("timestamp"))
        .write.mode("overwrite")
        .partitionBy("match_date")
        .parquet(f"{path}/batch={batch}")
    )


def snapshot_indicators(indicators: DataFrame, path: str, as_of: Column) -> None:
    """Dated snapshot of the indicator table; a rerun replaces the day's snapshot."""
    indicators.withColumn("snapshot_date", F.to_date(as_of)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("snapshot_date").parquet(path)


def read_snapshots(spark: SparkSession, path: str, as_of: Column, *, days: int = 7) -> DataFrame:
    """Snapshots still retained at ``as_of``."""
    oldest = F.to_date(as_of - F.make_dt_interval(F.lit(days)))
    return spark.read.parquet(path).filter(F.col("snapshot_date") >= oldest)


def schema_version(as_of: Column) -> Column:
    return F.date_format(as_of, "'v'yyyyMMdd_HHmmss")


def column_catalogue(documents: DataFrame, as_of: Column) -> DataFrame:
    """``database_id, tables array<struct<name, columns array<struct<...>>>>`` to one row per column."""
    tables = documents.select("database_id", F.explode("tables").alias("t"))
    return tables.select(
        "database_id", F.col("t.name").alias("table_name"), F.explode("t.columns").alias("c")
    ).select("database_id", "table_name", "c.*", schema_version(as_of).alias("schema_version"))


def replace_schema(documents: DataFrame, path: str, as_of: Column) -> None:
    """Replace the catalogue of the databases present; other databases' folders stay."""
    column_catalogue(documents, as_of).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("database_id").parquet(path)


# --- config snapshot -----------------------------------------------------------------------------------------


def snapshot_rows(sections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Active rows of each table as ``(section, key, payload)``; tables without ``active`` go whole.

    ``sections`` maps a section to its table and key column. One row per entry: no section is
    gathered into one value.
    """
    parts = []
    for name, (df, key) in sections.items():
        live = df.filter("active") if "active" in df.columns else df
        parts.append(
            live.select(
                F.lit(name).alias("section"),
                F.col(key).cast("string").alias("key"),
                F.to_json(F.struct(*live.columns)).alias("payload"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def indicator_keys(indicators: DataFrame) -> DataFrame:
    return indicators.withColumn("key", F.concat_ws(":", "type", "value"))


def publish_snapshot(sections: dict[str, tuple[DataFrame, str]], path: str) -> None:
    snapshot_rows(sections).write.mode("overwrite").partitionBy("section").json(path)


# --- reports -------------------------------------------------------------------------------------------------


def html_lines(scores: DataFrame, summary: DataFrame, findings: DataFrame) -> DataFrame:
    """Report lines ``(framework, part, ord, line)``: head, one block per finding, foot."""
    from wiretally.functions.quality import escape_html

    head = scores.join(summary, "framework").select(
        "framework",
        F.lit(0).alias("part"),
        F.lit("").alias("ord"),
        F.format_string(
            "<!DOCTYPE html><html><head><title>Compliance Report - %1$s</title></head><body>"
            "<h1>Compliance Report: %1$s</h1><p>Compliance Score: %2$.2f%%</p>"
            "<p>Total Tests: %3$d | Passed: %4$d | Failed: %5$d | Skipped: %6$d</p>"
            "<p>Critical: %7$d | High: %8$d | Medium: %9$d | Low: %10$d</p><h2>Findings</h2>",
            "framework", "score", "total", "passed", "failed", "skipped", "critical", "high", "medium", "low",
        ).alias("line"),
    )
    body = findings.select(
        "framework",
        F.lit(1).alias("part"),
        F.concat_ws("/", "test_id", F.col("host")).alias("ord"),
        F.format_string(
            '<div class="finding %1$s %2$s"><p>Test ID: %3$s</p><p>Severity: %2$s</p><p>Status: %1$s</p>'
            "<p>Details: %4$s</p></div>",
            "status", "severity", escape_html(F.col("test_id")), escape_html(F.coalesce("details", F.lit(""))),
        ).alias("line"),
    )
    foot = scores.select("framework", F.lit(2).alias("part"), F.lit("").alias("ord"), F.lit("</body></html>").alias("line"))
    return head.unionByName(body).unionByName(foot)


def write_report(scores: DataFrame, summary: DataFrame, findings: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per framework. JSON: findings as lines beside scores; HTML: the part files in
    name order are the page, so no framework's findings pass through one task."""
    if fmt == "html":
        (
            html_lines(scores, summary, findings)
            .repartitionByRange("framework", "part", "ord")
            .sortWithinPartitions("framework", "part", "ord")
            .select("framework", F.col("line").alias("value"))
            .write.mode("overwrite")
            .partitionBy("framework")
            .text(path)
        )
        return
    scores.join(summary, "framework").write.mode("overwrite").partitionBy("framework").json(f"{path}/scores")
    findings.write.mode("overwrite").partitionBy("framework").json(f"{path}/findings")
