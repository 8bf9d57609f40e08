"""Backend routing, key slots, traffic splits and ramps as set-level decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.keys import SLOTS, USER_SEED, mix32
from wiretally.operators.sliced import DEFAULT_SLICE_SECONDS, running_sums

ENV_BITS = 32  # a backend's id is its environment's id, shifted, and its position there


def backend_lists(backends: DataFrame) -> DataFrame:
    """Per ``db_type`` and direction the ordered candidates: own role or no role, else all."""
    role = F.coalesce(F.col("role"), F.lit(""))
    item = F.struct(F.col("ord"), F.concat_ws(":", "host", F.col("port").cast("string")).alias("name"))
    per_type = backends.groupBy("db_type").agg(
        F.sort_array(F.collect_list(item)).alias("every"),
        F.sort_array(F.collect_list(F.when(role.isin("read", ""), item))).alias("reads"),
        F.sort_array(F.collect_list(F.when(role.isin("write", ""), item))).alias("writes"),
    )
    pick = lambda c: F.transform(F.when(F.size(c) > 0, F.col(c)).otherwise(F.col("every")), lambda b: b["name"])
    return per_type.select("db_type", pick("reads").alias("read_names"), pick("writes").alias("write_names"))


def route(
    requests: DataFrame,
    backends: DataFrame,
    *,
    ts: str = "ts",
    tie: str = "log_id",
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Round robin over the candidates of ``(db_type, is_write)``; adds ``turn, backend``.

    The counter is a running count over time slices, so the few (type, direction) groups do not
    funnel the log into a few tasks.
    """
    counted = running_sums(
        requests, ["db_type", "is_write"], ts, tie, {"turn": F.lit(1)}, slice_seconds=slice_seconds
    )
    lists = backend_lists(backends).withColumnRenamed("db_type", "_dbt")
    names = F.when(F.col("is_write"), F.col("write_names")).otherwise(F.col("read_names"))
    joined = counted.join(lists, F.col("db_type") == F.col("_dbt"), "left").withColumn("_names", names)
    index = F.pmod(F.col("turn") - 1, F.size("_names")).cast("int")
    return joined.withColumn("backend", F.when(F.size("_names") > 0, F.get("_names", index))).drop(
        "_dbt", "read_names", "write_names", "_names"
    )


def parse_topology(lines: DataFrame, line: str = "line") -> DataFrame:
    """Cluster node listing to ``node_id, host, port, is_master, healthy, master_id, slots``.

    Lines with fewer than eight words or a bad address are skipped; ``slots`` is an array of
    ``struct(start, end)`` and empty for replicas. Slots being migrated are ignored.
    """
    w = F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda x: x != "")
    base = lines.withColumn("_w", w).filter(F.size("_w") >= 8)
    address = F.get("_w", F.lit(1))
    port = F.regexp_extract(address, r"^[^:]*:([^:@]*)", 1).try_cast("int")
    ranges = F.transform(
        F.slice("_w", 9, F.greatest(F.size("_w") - 8, F.lit(0))),
        lambda s: F.struct(
            F.split_part(s, F.lit("-"), F.lit(1)).try_cast("int").alias("start"),
            F.when(s.contains("-"), F.split_part(s, F.lit("-"), F.lit(2))).otherwise(s).try_cast("int").alias("end"),
        ),
    )
    master = F.get("_w", F.lit(2)).contains("master")
    good = F.filter(ranges, lambda r: r["start"].isNotNull() & r["end"].isNotNull())
    return (
        base.select(
            F.get("_w", F.lit(0)).alias("node_id"),
            F.regexp_extract(address, r"^([^:]*):", 1).alias("host"),
            port.alias("port"),
            master.alias("is_master"),
            (~F.get("_w", F.lit(2)).contains("fail")).alias("healthy"),
            F.nullif(F.get("_w", F.lit(3)), F.lit("-")).alias("master_id"),
            F.when(master, good).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("slots"),
        )
        .filter(F.col("port").isNotNull() & (F.col("host") != ""))
    )


def slot_map(nodes: DataFrame) -> DataFrame:
    """``slot, master, master_ok, replica`` with the first healthy replica; 16384 rows at most."""
    replicas = (
        nodes.filter(~F.col("is_master") & F.col("healthy") & F.col("master_id").isNotNull())
        .groupBy(F.col("master_id").alias("_m"))
        .agg(F.min("node_id").alias("replica"))
    )
    first, last = F.greatest(F.col("r.start"), F.lit(0)), F.least(F.col("r.end"), F.lit(SLOTS - 1))
    owned = (
        nodes.filter("is_master")
        .select("node_id", "healthy", F.explode("slots").alias("r"))
        .filter(first <= last)  # a sequence would count down
        .select("node_id", "healthy", F.explode(F.sequence(first, last)).alias("slot"))
        .groupBy("slot")
        .agg(F.max(F.struct("node_id", "healthy")).alias("n"))
    )
    return owned.join(replicas, F.col("n.node_id") == F.col("_m"), "left").select(
        "slot", F.col("n.node_id").alias("master"), F.col("n.healthy").alias("master_ok"), "replica"
    )


def route_slot(requests: DataFrame, nodes: DataFrame, *, slot: str = "slot", is_read: str = "is_read") -> DataFrame:
    """Add ``node``: reads prefer a healthy replica of the slot's master, then the master itself,
    then any healthy master (lowest id). The slot map has a fixed size, so it is broadcast."""
    side = slot_map(nodes).withColumnRenamed("slot", "_slot")
    spare = nodes.filter("is_master AND healthy").agg(F.min("node_id").alias("_spare"))
    joined = requests.join(F.broadcast(side), F.col(slot) == F.col("_slot"), "left").crossJoin(F.broadcast(spare))
    node = F.when(
        F.col("master_ok"), F.when(F.col(is_read), F.coalesce("replica", "master")).otherwise(F.col("master"))
    )
    return joined.withColumn("node", F.coalesce(node, F.col("_spare"))).drop(
        "_slot", "master", "master_ok", "replica", "_spare"
    )


def split_traffic(
    requests: DataFrame,
    *,
    strategy: str,
    primary: int,
    secondary: int,
    canary: int = 0,
    split_ratio: int = 50,
    canary_ratio: int = 0,
    started: int = 0,
    ip: str = "ip",
    time_ns: str = "time_ns",
) -> DataFrame:
    """Add ``env_id`` by hash of the address: percentage, user_based / ab_test, canary, or primary.

    Seeds are 32-bit: the deployment start for percentage, the event time for canary.
    """
    ip32 = F.col(ip)
    if strategy == "percentage":
        share = mix32(ip32, F.lit(started & 0xFFFFFFFF)) % 100
        env = F.when(share < split_ratio, F.lit(primary)).otherwise(F.lit(secondary))
        if canary > 0:
            env = F.when(share < canary_ratio, F.lit(canary)).otherwise(env)
    elif strategy in ("user_based", "ab_test"):
        even = mix32(ip32, F.lit(USER_SEED)) % 2 == 0
        env = F.when(even, F.lit(primary)).otherwise(F.lit(secondary))
    elif strategy == "canary" and canary > 0:
        share = mix32(ip32, F.col(time_ns).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))) % 100
        env = F.when(share < canary_ratio, F.lit(canary)).otherwise(F.lit(primary))
    else:
        env = F.lit(primary)
    return requests.withColumn("env_id", env)


def environment_arrays(backends: DataFrame) -> DataFrame:
    """Per environment its backends' health by position and the first healthy one."""
    return backends.groupBy("env_id").agg(
        F.count(F.lit(1)).cast("int").alias("_n"),
        F.sort_array(F.collect_list(F.struct("position", "healthy"))).alias("_b"),
        F.min(F.when(F.col("healthy"), F.col("position"))).alias("_spare"),
    )


def choose_backend(
    requests: DataFrame,
    backends: DataFrame,
    *,
    primary: int,
    secondary: int,
    failover: bool = True,
    ip: str = "ip",
    port: str = "port",
) -> DataFrame:
    """Hash (ip, port) to a backend of ``env_id``; unhealthy: the environment's first healthy one.

    Adds ``backend_id`` (null: request failed) and ``failed_over``. With failover on, requests of
    the primary without a backend try the secondary.
    """
    side = environment_arrays(backends)

    def pick(df: DataFrame, env: Column, out: str) -> DataFrame:
        joined = df.join(side.withColumnRenamed("env_id", "_env"), env == F.col("_env"), "left")
        at = (mix32(F.col(ip), F.col(port)) % F.col("_n")).cast("int")
        place = F.when(F.get("_b", at)["healthy"], at).otherwise(F.col("_spare"))
        return joined.withColumn(out, F.shiftleft(F.col("_env").cast("bigint"), ENV_BITS) + place).drop("_env", "_n", "_b", "_spare")

    df = pick(requests, F.col("env_id"), "_first")
    if failover:
        df = pick(df, F.lit(secondary), "_second")
        second = F.when((F.col("env_id") == primary) & F.col("_first").isNull(), F.col("_second"))
    else:
        second = F.lit(None).cast("bigint")
    df = df.withColumn("failed_over", second.isNotNull()).withColumn(
        "backend_id", F.coalesce(F.col("_first"), second)
    )
    return df.drop("_first", "_second")


def sticky(requests: DataFrame, *, ts: str = "ts", tie: str = "log_id", ip: str = "ip", port: str = "port") -> DataFrame:
    """Session affinity over a routed log: a client keeps the backend of its first routed request.

    Adds ``session_hit`` and replaces ``backend_id``. With one health state per run a session's
    backend cannot change, so one aggregate per client (partial before the shuffle) is enough.
    """
    first = (
        requests.filter(F.col("backend_id").isNotNull())
        .groupBy(F.col(ip).alias("_ip"), F.col(port).alias("_port"))
        .agg(F.min(F.struct(F.col(ts), F.col(tie), F.col("backend_id"))).alias("_s"))
    )
    joined = requests.join(
        first, F.col(ip).eqNullSafe(F.col("_ip")) & F.col(port).eqNullSafe(F.col("_port")), "left"
    )
    later = F.struct(F.col(ts), F.col(tie)) > F.struct(F.col(f"_s.{ts}"), F.col(f"_s.{tie}"))
    hit = F.coalesce(later & (F.col(port) > 0), F.lit(False))
    return (
        joined.withColumn("session_hit", hit)
        .withColumn("backend_id", F.when(hit, F.col("_s.backend_id")).otherwise(F.col("backend_id")))
        .drop("_ip", "_port", "_s")
    )


def split_stats(decisions: DataFrame, *, primary: int, secondary: int, canary: int = -1) -> DataFrame:
    failed = F.col("backend_id").isNull()
    env = F.col("env_id")
    return decisions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~failed & (env == primary)).alias("blue"),
        F.count_if(~failed & (env == secondary)).alias("green"),
        F.count_if(~failed & (env == canary)).alias("canary"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.col("failed_over")).alias("failovers"),
        F.count_if(F.col("session_hit")).alias("session_hits"),
        F.count_if(~F.col("session_hit")).alias("session_misses"),
    )


def ramp_percentage(ts_us: Column, start_us: Column, duration_us: Column, *, steps: int = 10) -> Column:
    """Share of traffic moved at an instant: each of ``steps`` equal steps adds 100/steps percent."""
    done = F.floor((ts_us - start_us) * steps / duration_us)
    return (F.least(F.greatest(done, F.lit(0)), F.lit(steps)) * (100 // steps)).cast("int")


def ramp_split(requests: DataFrame, ramps: DataFrame, *, ts: str = "ts", ip: str = "ip") -> DataFrame:
    """Add ``percentage`` in force at each request and ``moved``; ramps joined on ``deployment``."""
    side = ramps.select(
        F.col("deployment").alias("_d"), F.unix_micros("started_at").alias("_start"), F.col("duration_us").alias("_dur")
    )
    joined = requests.join(side, F.col("deployment") == F.col("_d"), "left")
    percent = F.coalesce(ramp_percentage(F.unix_micros(ts), F.col("_start"), F.col("_dur")), F.lit(0))
    return (
        joined.withColumn("percentage", percent)
        .withColumn("moved", mix32(F.col(ip), F.lit(0)) % 100 < F.col("percentage"))
        .drop("_d", "_start", "_dur")
    )


def served_by(attempts: DataFrame) -> DataFrame:
    """Provider that served each operation: the primary if it succeeded, else the first other
    (by listed order) that did, else null."""
    rank = F.struct((~F.col("is_primary")).cast("int").alias("o"), F.col("ord").alias("n"))
    return attempts.groupBy("operation_id").agg(
        F.min_by(F.when(F.col("ok"), F.col("provider")), F.when(F.col("ok"), rank)).alias("provider")
    )


def env_health(backends: DataFrame) -> DataFrame:
    """Environment state from the healthy share, and whether the primary must fail over."""
    share = F.count_if("healthy") / F.count(F.lit(1))
    return backends.groupBy("env_id").agg(
        F.count_if("healthy").alias("healthy"),
        F.count(F.lit(1)).alias("total"),
        F.round(share, 6).alias("ratio"),
        F.when(share >= 0.8, "healthy").when(share >= 0.5, "degraded").otherwise("unhealthy").alias("state"),
    )


def must_fail_over(health: DataFrame, *, primary: int) -> DataFrame:
    """One row: whether the primary environment is unhealthy."""
    return health.agg(
        F.coalesce(F.bool_or((F.col("env_id") == primary) & (F.col("state") == "unhealthy")), F.lit(False)).alias(
            "fail_over"
        )
    )
