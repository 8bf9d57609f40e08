"""Paged and joined read views over the control-plane tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.fingerprint import truncate
from wiretally.operators.nest import nest


def page(df: DataFrame, order: list[Column], *, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows ``offset .. offset+limit`` of an order; only that many rows leave each task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], *, limit: int = 100, offset: int = 0) -> DataFrame:
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))
    return page(df, order, limit=limit, offset=offset).crossJoin(total)


def _named(df: DataFrame, side: DataFrame, on: str, key: str, name: str, out: str, missing: str) -> DataFrame:
    """Left join one name onto rows, with a stand-in where there is none."""
    lookup = side.select(F.col(key).alias("_k"), F.col(name).alias("_name"))
    joined = df.join(lookup, F.col(on) == F.col("_k"), "left")
    return joined.withColumn(out, F.coalesce("_name", F.lit(missing))).drop("_k", "_name")


def audit_page(log: DataFrame, users: DataFrame, *, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest audit rows with user names (missing: ``System``), query cut to 100 characters.

    The page is taken before the join, so only its rows are joined.
    """
    rows = page_with_total(log, [F.col("timestamp").desc(), F.col("id").desc()], limit=limit, offset=offset)
    named = _named(rows, users, "user_id", "user_id", "username", "user", "System")
    return named.withColumn("query", truncate(F.col("query"), 100))


def list_indicators(indicators: DataFrame, *, kind: str | None = None, level: str | None = None) -> DataFrame:
    df = indicators.filter("active")
    if kind is not None:
        df = df.filter(F.col("type") == kind)
    if level is not None:
        df = df.filter(F.col("threat_level") == level)
    return df


def indicator_page(
    indicators: DataFrame, feeds: DataFrame, *, kind: str | None = None, level: str | None = None,
    limit: int = 100, offset: int = 0,
) -> DataFrame:
    listed = list_indicators(indicators, kind=kind, level=level)
    rows = page_with_total(listed, [F.col("last_seen").desc(), F.col("id").desc()], limit=limit, offset=offset)
    return _named(rows, feeds, "feed_id", "feed_id", "name", "feed", "Manual")


def match_page(matches: DataFrame, indicators: DataFrame, users: DataFrame, *, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = page_with_total(matches, [F.col("timestamp").desc(), F.col("id").desc()], limit=limit, offset=offset)
    side = indicators.select(
        F.col("id").alias("_i"), F.col("type").alias("_type"), F.col("value").alias("_value")
    )
    joined = rows.join(side, F.col("indicator_id") == F.col("_i"), "left")
    joined = joined.withColumn("indicator_type", F.coalesce("_type", F.lit("unknown"))).withColumn(
        "indicator_value", F.coalesce("_value", F.lit("unknown"))
    )
    named = _named(joined.drop("_i", "_type", "_value"), users, "user_id", "user_id", "username", "user", "System")
    return named.withColumn("query", truncate(F.col("query"), 200))


def sql_file_view(files: DataFrame, databases: DataFrame, users: DataFrame, *, database_id: int | None = None) -> DataFrame:
    rows = files if database_id is None else files.filter(F.col("database_id") == database_id)
    named = _named(rows, databases, "database_id", "database_id", "name", "database_name", "Unknown")
    side = users.select(F.col("user_id").alias("_u"), F.col("username").alias("executed_by_name"))
    return named.join(side, F.col("executed_by") == F.col("_u"), "left").drop("_u")


def managed_db_view(databases: DataFrame, servers: DataFrame) -> DataFrame:
    side = servers.select(
        F.col("server_id").alias("_s"), F.col("name").alias("server_name"), F.col("type").alias("server_type")
    )
    return databases.filter("active").join(side, F.col("server_id") == F.col("_s"), "left").drop("_s")


def policy_view(configs: DataFrame, databases: DataFrame) -> DataFrame:
    """Security settings of existing databases, under the database's name."""
    side = databases.select(F.col("database_id").alias("_d"), F.col("database_name").alias("database"))
    return configs.join(side, F.col("database_id") == F.col("_d"), "inner").drop("_d")


def schema_view(columns: DataFrame, database_id: int | None = None, *, parts: int) -> DataFrame:
    """Column descriptions nested by table (in ``parts`` rows each, see ``nest``)."""
    rows = columns if database_id is None else columns.filter(F.col("database_id") == database_id)
    item = F.struct("column_name", "data_type", "is_nullable")
    return nest(rows, ["database_id", "table_name"], item, "columns", spread_by="column_name", parts=parts)


def runnable_files(files: DataFrame, databases: DataFrame, servers: DataFrame) -> DataFrame:
    """Validated, not yet executed files whose database and server exist."""
    ready = files.filter("security_validated AND NOT executed")
    homes = databases.join(
        servers.select(F.col("server_id").alias("_s")), F.col("server_id") == F.col("_s"), "left_semi"
    )
    return ready.join(homes.select(F.col("database_id").alias("_d")), F.col("database_id") == F.col("_d"), "left_semi")
