"""Counters, statistics and dashboards: plain aggregates with partial sums before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.operators.netblocks import in_force


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """``part / whole`` rounded, 0 when there is nothing."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)


def count_per(df: DataFrame, *by: str, out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def over_fixed_list(df: DataFrame, column: str, values: list[str], counts: list[str]) -> DataFrame:
    """Counts for exactly the listed values, zeros kept."""
    fixed = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    joined = F.broadcast(fixed).join(df, column, "left")
    return joined.select(column, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])


# --- control-plane overview ----------------------------------------------------------------------------


def servers_by_type(servers: DataFrame) -> DataFrame:
    counted = count_per(servers.filter("active"), "type", out="servers")
    return over_fixed_list(counted, "type", packs.DB_TYPES, ["servers"])


def overview(servers: DataFrame, users: DataFrame, permissions: DataFrame, rules: DataFrame, log: DataFrame) -> DataFrame:
    """One row of totals; every input is reduced to one row before they meet."""
    parts = [
        servers.agg(F.count_if("active").alias("active_servers")),
        users.agg(F.count(F.lit(1)).alias("users")),
        permissions.agg(F.count(F.lit(1)).alias("permissions")),
        rules.agg(F.count_if("active").alias("active_rules")),
        log.agg(F.count(F.lit(1)).alias("queries")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def blocking_stats(rules: DataFrame) -> DataFrame:
    kinds = ("database", "username", "table")
    return rules.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("active").alias("active"),
        *[F.count_if(F.col("active") & (F.col("kind") == k)).alias(f"active_{k}") for k in kinds],
    )


def system_health(status: DataFrame) -> DataFrame:
    """Overall state of the fixed components; a missing one counts as unknown."""
    latest = status.groupBy("component").agg(F.max_by("status", "ts").alias("status"))
    fixed = status.sparkSession.createDataFrame([(c,) for c in packs.COMPONENTS], "component string")
    merged = F.broadcast(fixed).join(latest, "component", "left")
    bad = F.count_if(F.coalesce(F.col("status"), F.lit("unknown")) != "healthy")
    return merged.agg(bad.alias("not_healthy"), F.count(F.lit(1)).alias("components")).withColumn(
        "status",
        F.when(F.col("not_healthy") == 0, "healthy")
        .when(F.col("not_healthy") < F.col("components") / 2, "degraded")
        .otherwise("unhealthy"),
    )


def dashboard(requests: DataFrame, cache_log: DataFrame, deployments: DataFrame, blocked: DataFrame, nodes: DataFrame) -> DataFrame:
    parts = [
        requests.agg(F.count(F.lit(1)).alias("total_requests")),
        cache_log.agg(ratio(F.count_if(F.col("hit")), F.count(F.lit(1))).alias("cache_hit_ratio")),
        deployments.agg(F.count_if(F.col("status") == "active").alias("active_deployments")),
        in_force(blocked).agg(F.count(F.lit(1)).alias("blocked_ips")),
        nodes.agg(F.count_if("healthy").alias("healthy_nodes"), F.count(F.lit(1)).alias("total_nodes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


# --- queries and events ----------------------------------------------------------------------------------


def query_counts(log: DataFrame) -> DataFrame:
    return count_per(log, "db_type", "query_type", out="queries")


def latency_histogram(log: DataFrame, by: list[str], value: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative buckets ``(le, n)`` per group, with ``+Inf``, sum and count.

    Rows are counted once into their own bucket; the cumulation runs over the few buckets.
    """
    bounds = bounds or packs.LATENCY_BOUNDS
    sums = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = log.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"))
    buckets = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)],
        F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")),
    )
    return wide.select(*by, F.explode(buckets).alias("b"), "count", "sum").select(*by, "b.le", "b.n", "count", "sum")


def counter_rollup(events: DataFrame) -> DataFrame:
    """Process counters by name and label; connections are opens minus closes."""
    kind = F.col("event")
    name = (
        F.when(kind.isin("open", "close"), "connections")
        .when(kind == "auth_failure", "auth_failures")
        .when(kind == "injection", "injection_attempts")
        .when(kind == "backend_error", "backend_errors")
        .when(kind == "reload", "config_reloads")
    )
    step = F.when(kind == "close", -1).otherwise(1)
    return (
        events.withColumn("counter", name)
        .filter(F.col("counter").isNotNull())
        .groupBy("counter", "label")
        .agg(F.sum(step).alias("value"))
    )


SPAN_KEYS = ["database", "operation", "table"]


def span_stats(spans: DataFrame) -> DataFrame:
    """Durations by database, operation and table, with error counts."""
    return spans.groupBy(*SPAN_KEYS).agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if("error").alias("errors"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col("duration_ms").cast("double")), F.lit(0.95)).alias("p95_ms"),
    )


def span_ranks(spans: DataFrame, quantiles: DataFrame, value: str) -> DataFrame:
    """For each group the shares of its spans that are below, and not above, its ``value``: where a quantile of a sketch really stands."""
    side = quantiles.select(*(F.col(k).alias(f"_{k}") for k in SPAN_KEYS), F.col(value).alias("_v"))
    joined = spans.join(side, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in SPAN_KEYS])
    return joined.groupBy(*SPAN_KEYS).agg(
        F.count("*").alias("spans"), F.avg((F.col("duration_ms") < F.col("_v")).cast("double")).alias("below"), F.avg((F.col("duration_ms") <= F.col("_v")).cast("double")).alias("upto")
    )


def sample_spans(spans: DataFrame, rate: float, *, trace: str = "trace_id") -> DataFrame:
    """Keep a share of traces by a hash of their id, so a trace stays whole."""
    digits = 13  # of the hash: 52 bits
    place = F.conv(F.substring(F.md5(F.col(trace)), 1, digits), 16, 10).cast("long")
    return spans.filter(place < int(rate * 16**digits))


def security_event_counts(events: DataFrame) -> DataFrame:
    """Counts by type, level and action, with every subtotal."""
    return events.cube("type", "level", "action").agg(
        F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n")
    )


def auth_attempts(events: DataFrame) -> DataFrame:
    return count_per(events, "username", "source_ip", "result", out="attempts")


def match_levels(matches: DataFrame) -> DataFrame:
    """Threat matches by indicator and level."""
    return count_per(matches.filter(F.col("indicator_id").isNotNull()), "indicator_id", "threat_level", out="matches")


def packet_actions(decisions: DataFrame) -> DataFrame:
    return count_per(decisions, "decision", out="packets")


def counter_families(points: DataFrame, families: DataFrame, by: list[str], *, ts: str = "ts") -> DataFrame:
    """Per ``by`` and family of ``families`` (family, kind): ``points``, ``value`` and ``per_second``.

    A ``counter`` sums its points (family, value) and has a rate over the time between its first and last one; a ``gauge`` shows its newest value. Families are rows, so
    there may be any number; points of other families are left out.
    """
    side = families.select(F.col("family").alias("_f"), "kind")
    seconds = (F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts))) / 1_000_000.0
    counted = points.join(side, F.col("family") == F.col("_f")).groupBy(*by, "family", "kind").agg(
        F.count("*").alias("points"), F.sum("value").alias("_sum"), F.max_by("value", F.struct(ts, "value")).alias("_last"), seconds.alias("_seconds")
    )
    counter = F.col("kind") == "counter"
    return counted.select(
        *by, "family", "kind", "points", F.when(counter, F.col("_sum")).otherwise(F.col("_last")).alias("value"),
        F.when(counter, F.try_divide("_sum", "_seconds")).alias("per_second"),
    )


def traffic_rollup(points: DataFrame, by: str = "interface") -> DataFrame:
    """Packet families per interface with hit ratio and error rate."""
    families = ("processed", "dropped", "passed", "aborted", "redirected", "cache_hit", "cache_miss")
    totals = points.groupBy(by).agg(
        *[F.coalesce(F.sum(F.when(F.col("family") == f, F.col("value"))), F.lit(0.0)).alias(f) for f in families]
    )
    return totals.withColumn("hit_ratio", ratio(F.col("cache_hit"), F.col("cache_hit") + F.col("cache_miss"))).withColumn(
        "error_rate", ratio(F.col("aborted") + F.col("dropped"), F.col("processed"))
    )


def feature_usage(events: DataFrame) -> DataFrame:
    return count_per(events, "user_id", "feature", out="uses")


# --- cache -----------------------------------------------------------------------------------------------


def cache_stats(log: DataFrame) -> DataFrame:
    """Requests, hits, misses, refusals and hit ratio per tier and policy with subtotals."""
    hits = F.count_if(F.col("outcome") == "hit")
    return log.rollup("tier", "policy").agg(
        F.grouping_id().alias("grouping"),
        F.count(F.lit(1)).alias("requests"),
        hits.alias("hits"),
        F.count_if(F.col("outcome") == "miss").alias("misses"),
        F.count_if(F.col("outcome") == "auth_failure").alias("auth_failures"),
        ratio(hits, F.count(F.lit(1))).alias("hit_ratio"),
    )


def cache_admission(log: DataFrame, key: str, ts: str, tie: str, min_hits: int, **how) -> DataFrame:
    """Add ``admitted``: the query was tracked ``min_hits`` times before, each within an hour of the last."""
    from wiretally.operators.sliced import gap_sessions

    ranked = gap_sessions(log, [key], ts, tie, 3_600_000_000, **how)
    return ranked.withColumn("admitted", F.col("session_rank") > min_hits)


def hot_keys(log: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most recently used cache keys."""
    used = log.groupBy("cache_key").agg(F.max("ts").alias("last_used"), F.count(F.lit(1)).alias("uses"))
    return used.orderBy(F.col("last_used").desc(), "cache_key").limit(k)


def evict_lru(
    entries: DataFrame, ts: str, tie: str, size: str, *, max_bytes: int, max_entries: int | None = None, **how
) -> DataFrame:
    """Add ``evicted``: least recently used entries go until memory is at most 90 % of the maximum
    (only once it is exceeded) and fewer than ``max_entries`` remain."""
    from wiretally.operators.sliced import running_sums

    ranked = running_sums(
        entries, [], ts, tie, {"_bytes": F.col(size), "_rank": F.lit(1)}, descending=True, **how
    )
    joined = ranked.withColumn("_total", entries.agg(F.coalesce(F.sum(size), F.lit(0))).scalar())
    target = int(max_bytes * 0.9)
    evicted = (F.col("_total") > max_bytes) & (F.col("_bytes") > target)
    if max_entries is not None:
        evicted = evicted | (F.col("_rank") >= max_entries)
    return joined.withColumn("evicted", evicted).drop("_bytes", "_rank", "_total")


def stale_entries(entries: DataFrame, writes: DataFrame, as_of: Column) -> DataFrame:
    """Add ``stale``: the entry's table was written after it was cached, or its ttl has run out."""
    last = writes.groupBy(F.col("table").alias("_t")).agg(F.max("written_at").alias("_w"))
    joined = entries.join(last, F.col("table") == F.col("_t"), "left")
    age = F.unix_micros(as_of) - F.unix_micros("created_at")
    expired = age >= F.col("ttl_s") * 1_000_000
    written = F.coalesce(F.col("_w") > F.col("created_at"), F.lit(False))
    return joined.withColumn("stale", written | expired).drop("_t", "_w")


def glob_regex(pattern: str) -> str:
    import re

    return "^(?:" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + r")\z"


def invalidate(
    entries: DataFrame,
    *,
    user: str | None = None,
    database: str | None = None,
    table: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Entries that survive an invalidation by user, database, table or key pattern (``*``, ``?``)."""
    gone = F.lit(False)
    if user is not None:
        gone = gone | F.coalesce(F.array_contains("allowed_users", user), F.lit(False))
    if database is not None:
        gone = gone | (F.coalesce(F.col("database"), F.lit("")) == database)
    if table is not None:
        gone = gone | (F.coalesce(F.col("table"), F.lit("")) == table)
    if pattern is not None:
        gone = gone | F.col("cache_key").rlike(glob_regex(pattern))
    return entries.filter(~gone)


# --- multi-write -----------------------------------------------------------------------------------------


def write_outcome(results: DataFrame) -> DataFrame:
    """Per request whether its strategy succeeded over the enabled clusters' results."""
    ok = F.col("status") == "ok"
    per = results.filter(F.col("enabled") | F.col("is_primary")).groupBy("request_id", "strategy").agg(
        F.count_if("enabled").alias("clusters"),
        F.count_if(F.col("enabled") & ok).alias("succeeded"),
        F.bool_or(F.col("is_primary") & ok).alias("primary_ok"),
    )
    decided = (
        F.when(F.col("strategy") == "sync", F.col("succeeded") == F.col("clusters"))
        .when(F.col("strategy").isin("async", "best_effort"), F.col("primary_ok"))
        .when(F.col("strategy") == "quorum", F.col("succeeded") >= F.floor(F.col("clusters") / 2) + 1)
    )
    return per.withColumn("success", F.coalesce(decided, F.lit(False)))


def write_stats(results: DataFrame) -> DataFrame:
    """Writes, successes, failures, retries and last write by strategy and by cluster."""
    ok = F.col("status") == "ok"
    from_sets = results.groupingSets([["strategy"], ["cluster"]], "strategy", "cluster")
    return from_sets.agg(
        F.count(F.lit(1)).alias("writes"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.sum("retries").alias("retries"),
        F.max("written_at").alias("last_write"),
    )


def job_stats(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


# --- nodes, providers, backups, feeds -------------------------------------------------------------------


def node_stats(nodes: DataFrame) -> DataFrame:
    measured = F.when(F.col("healthy") & (F.col("latency_ms") > 0), F.col("latency_ms"))
    return nodes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_master").alias("masters"),
        F.count_if(~F.col("is_master")).alias("replicas"),
        F.count_if("healthy").alias("healthy"),
        F.round(F.avg(measured), 6).alias("avg_latency_ms"),
    )


def in_range(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def provider_points(points: DataFrame, start: Column, end: Column) -> DataFrame:
    """The providers' metric points of a range as one long table (never gathered per metric)."""
    return in_range(points, "ts", start, end).select("provider", "metric", "ts", "value")


def provider_metrics(points: DataFrame, start: Column, end: Column) -> DataFrame:
    return provider_points(points, start, end).groupBy("provider", "metric").agg(
        F.count(F.lit(1)).alias("points"),
        F.round(F.avg("value"), 6).alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def provider_costs(costs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Cost by provider and service with subtotals and the total."""
    return in_range(costs, "ts", start, end).rollup("provider", "service").agg(
        F.grouping_id().alias("grouping"), F.round(F.sum("cost"), 2).alias("cost")
    )


def provider_gaps(inventory: DataFrame, primary: str) -> DataFrame:
    """Databases of the primary provider that each other provider lacks.

    One aggregate per database name: providers are few, names are not.
    """
    others = [
        r.provider
        for r in inventory.filter(F.col("provider") != primary).select("provider").distinct().toLocalIterator()
    ]
    if not others:
        return inventory.select("provider", "name").limit(0)
    held = inventory.groupBy("name").agg(F.collect_set("provider").alias("held"))
    missing = F.array_except(F.array(*[F.lit(o) for o in sorted(others)]), F.col("held"))
    return held.filter(F.array_contains("held", primary)).select(F.explode(missing).alias("provider"), "name")


def backup_stats(runs: DataFrame) -> DataFrame:
    ok = F.col("status") == "completed"
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("total_size"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("size"))), F.lit(0.0)), 6).alias("avg_size"),
        F.max_by("status", F.struct("started_at", "backup_id")).alias("last_status"),
    )


def restore_points(metadata: DataFrame, archives: DataFrame) -> DataFrame:
    """Backups whose archive exists."""
    return metadata.join(archives.select(F.col("path").alias("_p")), F.col("archive_path") == F.col("_p"), "left_semi")


def apply_retention(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def threat_stats(indicators: DataFrame) -> DataFrame:
    kinds = ("ip", "domain", "url", "hash", "email")
    return indicators.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("type") == k).alias(f"{k}_count") for k in kinds],
        F.count_distinct("feed").alias("active_feeds"),
        F.max("last_seen").alias("last_update"),
    )


def feed_stats(runs: DataFrame, *, slice_seconds: int = 3600) -> DataFrame:
    """Per feed: runs, failures, error rate, last run, new indicators, running update time."""
    from wiretally.operators.tuning import halving_average

    base = runs.groupBy("feed").agg(
        F.count(F.lit(1)).alias("updates"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        ratio(F.count_if(~F.col("ok")), F.count(F.lit(1))).alias("error_rate"),
        F.max("ts").alias("last_update"),
        F.sum("new_indicators").alias("new_indicators"),
    )
    timing = halving_average(runs, "feed", "ts", "run_id", "seconds", slice_seconds=slice_seconds).drop("n")
    return base.join(timing, "feed")


def parse_metric_map(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``number, is_json``: JSON texts parsed (numbers as doubles), other texts left as they are."""
    parsed = F.try_parse_json(F.col(value))
    return df.withColumn("is_json", parsed.isNotNull()).withColumn(
        "number", F.try_variant_get(parsed, "$", "double")
    )
