"""Column functions over key-value and document-store commands and request fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.functions import packs


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def parse_kv_command(line: Column) -> Column:
    """``struct(command, args, key, is_read)``; a leading ``*`` is the array form."""
    words = _words(line)
    command = F.regexp_replace(F.coalesce(F.get(words, F.lit(0)), F.lit("")), r"^\*", "")
    return F.struct(
        command.alias("command"),
        F.when(F.size(words) > 1, F.slice(words, 2, F.size(words) - 1))
        .otherwise(F.array().cast("array<string>"))
        .alias("args"),
        F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("key"),
        F.upper(command).isin(packs.KV_READS).alias("is_read"),
    )


def is_blocked_kv(command: Column, *, cluster: bool = False) -> Column:
    return F.upper(command).isin(packs.KV_BLOCKED_CLUSTER if cluster else packs.KV_BLOCKED)


def is_write_kv(command: Column) -> Column:
    return F.upper(command).isin(packs.KV_WRITES)


def doc_operation(message: Column) -> Column:
    """First listed operation named anywhere in the message."""
    low = F.lower(message)
    return reduce(
        lambda acc, op: F.when(low.contains(op), F.lit(op)).otherwise(acc),
        reversed(packs.DOC_OPERATIONS),
        F.lit("unknown"),
    )


def is_blocked_doc(operation: Column, collection: Column) -> Column:
    return operation.isin(packs.DOC_BLOCKED_OPERATIONS) | collection.isin(packs.DOC_BLOCKED_COLLECTIONS)


def is_write_doc(operation: Column) -> Column:
    return operation.isin(packs.DOC_WRITES)


def is_db_port(port: Column) -> Column:
    return port.isin(packs.DB_PORTS)


def is_new_connection(syn: Column, ack: Column) -> Column:
    return syn & ~ack


def http_outcome(status: Column) -> Column:
    """``struct(success, level)`` of a response status."""
    success = status < 400
    return F.struct(
        success.alias("success"),
        F.when(success, F.lit("INFO")).otherwise(F.lit("WARNING")).alias("level"),
    )


def audit_level(category: Column, success: Column) -> Column:
    """Level the audit trail gives an event of a category."""
    return (
        F.when(category == "SECURITY_EVENT", F.lit("CRITICAL"))
        .when(category.isin("DATA_ACCESS", "DATA_MODIFICATION"), F.lit("INFO"))
        .otherwise(F.when(success, F.lit("INFO")).otherwise(F.lit("WARNING")))
    )


def level_rank(level: Column) -> Column:
    return F.when(level == "INFO", 0).when(level == "WARNING", 1).when(level == "CRITICAL", 2)


def client_ip(forwarded: Column, real_ip: Column, remote: Column) -> Column:
    """First forwarded hop, else the real-ip header, else the remote address without its port."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(
        blank(F.split_part(forwarded, F.lit(","), F.lit(1))),
        blank(real_ip),
        F.regexp_replace(remote, r":\d+$", ""),
        F.lit("unknown"),
    )
