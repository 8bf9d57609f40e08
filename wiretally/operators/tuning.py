"""Performance time series: trends, rates, tuner rules, scaling decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.operators.sliced import DEFAULT_SLICE_SECONDS, ema_final, previous_values, running_sums

MIN_POINTS = 10


def trend(points: DataFrame, key: str, order: list[str], value: str, last: int | None = None, **how) -> DataFrame:
    """Least-squares trend over each key's points (ten at least), newest first; over the ``last`` ones if that is given.

    A point's place comes from running sums over time slices, so a key's points may be in many tasks; with ``last`` the limit is
    pushed below the shuffle instead, and at most so many rows per key and task move.
    """
    if last is None:
        kept = running_sums(points, [key], *order, {"_r": F.lit(1)}, descending=True, **how)
    else:
        newest = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
        kept = points.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= last)
    x, y = -F.col("_r").cast("double"), F.col(value)
    fitted = kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("_r2")
    )
    return (
        fitted.filter(F.col("n") >= MIN_POINTS)
        .withColumn(
            "direction",
            F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable"),
        )
        .withColumn("confidence", F.greatest(F.lit(0.0), F.col("_r2")))
        .drop("_r2")
    )


def rule_success(runs: DataFrame, key: str, ts: str, tie: str, ok: str, **how) -> DataFrame:
    """Success average per rule: times 0.9, plus 0.1 on success."""
    return ema_final(runs, [key], ts, tie, {"success_rate": F.col(ok).cast("double")}, alpha=0.1, **how)


def halving_average(
    runs: DataFrame, key: str, ts: str, tie: str, value: str, *, slice_seconds: int = DEFAULT_SLICE_SECONDS
) -> DataFrame:
    """``(previous + x) / 2`` folded over each key, the first value taken whole."""
    folded = ema_final(runs, [key], ts, tie, {"_half": F.col(value)}, alpha=0.5, slice_seconds=slice_seconds)
    first = runs.groupBy(F.col(key).alias("_k")).agg(F.min_by(value, F.struct(ts, tie)).alias("_first"))
    joined = folded.join(first, F.col(key) == F.col("_k"))
    return joined.select(
        key, "n", (F.col("_half") + F.col("_first") * F.pow(F.lit(0.5), F.col("n"))).alias("running_average")
    )


def counter_rate(
    points: DataFrame, key: str, ts: str, tie: str, value: str, *, slice_seconds: int = DEFAULT_SLICE_SECONDS
) -> DataFrame:
    """Per-second rate of a cumulative counter; null on the first point, after a reset, or in no time."""
    prev = previous_values(points, [key], ts, tie, {"_pt": ts, "_pv": value}, slice_seconds=slice_seconds)
    seconds = (F.unix_micros(ts) - F.unix_micros("_pt")) / 1_000_000.0
    delta = F.col(value) - F.col("_pv")
    return prev.withColumn("rate", F.when(delta >= 0, F.try_divide(delta, seconds))).drop("_pt", "_pv")


# --- tuner -------------------------------------------------------------------------------------------


def default_tuning_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (name, True, priority, cooldown, [list(c) for c in conditions])
        for name, priority, cooldown, conditions in packs.TUNING_RULES
    ]
    return spark.createDataFrame(
        rows,
        "name string, enabled boolean, priority int, cooldown_s long, "
        "conditions array<struct<metric:string, operator:string, value:double, weight:double>>",
    )


def safety_gate(snapshots: DataFrame, *, aggressive: bool = False) -> DataFrame:
    """Add ``safe``. Snapshots hold maps ``cpu`` and ``memory_pressure``, ``cache_hit_ratio``,
    ``latency_p99_ms`` and ``error_rate``."""
    top = 0.95 if aggressive else 0.85
    memory = 0.95 if aggressive else 0.9
    worst = lambda c: F.coalesce(F.array_max(F.map_values(F.col(c))), F.lit(0.0))
    return snapshots.withColumn(
        "safe",
        (worst("cpu") <= top)
        & (worst("memory_pressure") <= memory)
        & (F.col("cache_hit_ratio") >= 0.8)
        & (F.col("latency_p99_ms") <= 10.0)
        & (F.col("error_rate") <= 0.01),
    )


def condition_met(operator: Column, value: Column, bound: Column) -> Column:
    return (
        F.when(operator == "gt", value > bound)
        .when(operator == "lt", value < bound)
        .when(operator == "gte", value >= bound)
        .when(operator == "lte", value <= bound)
        .when(operator == "eq", F.abs(value - bound) < 0.001)
        .otherwise(F.lit(False))
    )


def applicable_rules(
    metrics: DataFrame, rules: DataFrame, *, snapshot: str = "snapshot_id", last_applied: DataFrame | None = None, as_of: Column | None = None
) -> DataFrame:
    """Rules whose met weight is at least 70 % of their total, per snapshot.

    ``metrics`` is long form (snapshot, metric, value). A missing metric adds to the total only.
    Rules in cooldown at ``as_of`` are left out when ``last_applied`` (name, applied_at) is given. The rules' conditions travel with the plan as one value: metrics have few
    names, by which a join would send them to few tasks.
    """
    live = rules.filter("enabled")
    if last_applied is not None:
        side = last_applied.groupBy(F.col("name").alias("_n")).agg(F.max("applied_at").alias("_at"))
        since = F.unix_micros(as_of) - F.unix_micros("_at")
        live = live.join(side, F.col("name") == F.col("_n"), "left").filter(
            F.col("_at").isNull() | (since >= F.col("cooldown_s") * 1_000_000)
        ).drop("_n", "_at")
    parts = live.select("name", "priority", F.explode("conditions").alias("c")).select(
        "name", "priority", "c.metric", "c.operator", F.col("c.value").alias("bound"), "c.weight"
    )
    totals = parts.groupBy("name").agg(F.sum("weight").alias("total_weight"), F.max("priority").alias("priority"))
    listed = parts.agg(F.collect_list(F.struct("metric", "name", "operator", "bound", "weight"))).scalar()
    asked = metrics.withColumn("_asked", listed).select(snapshot, "value", F.explode(F.filter("_asked", lambda c: c["metric"] == F.col("metric"))).alias("c"))
    met = (
        asked.filter(condition_met(F.col("c.operator"), F.col("value"), F.col("c.bound")))
        .groupBy(snapshot, F.col("c.name").alias("name"))
        .agg(F.sum("c.weight").alias("met_weight"))
    )
    return (
        met.join(totals, "name")
        .filter((F.col("total_weight") > 0) & (F.col("met_weight") / F.col("total_weight") >= 0.7))
        .select(snapshot, "name", "priority", F.round(F.col("met_weight") / F.col("total_weight"), 6).alias("met_share"))
    )


def by_priority(rules: DataFrame) -> DataFrame:
    """Order in which applicable rules are applied."""
    return rules.orderBy(F.col("priority").desc(), "name")


def snapshot_metrics(snapshots: DataFrame, columns: list[str], *, snapshot: str = "snapshot_id") -> DataFrame:
    """Wide snapshots to long form, one row per non-null metric."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return snapshots.select(snapshot, F.explode(pairs).alias("m")).select(snapshot, "m.*").filter("value IS NOT NULL")


# --- scaling -----------------------------------------------------------------------------------------


def instance_metrics(points: DataFrame, as_of: Column, *, ts: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """Mean of the five-minute averages of the last ten minutes, per instance and metric."""
    keys = keys or ["instance_id", "metric"]
    recent = points.filter(
        (F.col(ts) >= as_of - F.expr("INTERVAL 10 MINUTES")) & (F.col(ts) < as_of)
    )
    five = recent.groupBy(*keys, F.window(ts, "5 minutes")).agg(F.avg("value").alias("_avg"))
    return five.groupBy(*keys).agg(F.avg("_avg").alias("value"))


def k8s_usage(df: DataFrame, cpu: str = "cpu_usage", memory: str = "memory_usage") -> DataFrame:
    """Pod usage texts to percent of one core and of one GiB."""
    number = lambda c: F.regexp_extract(c, r"^(\d+)", 1).try_cast("double")
    millicores = F.when(F.col(cpu).contains("n"), number(cpu) / 1_000_000).otherwise(number(cpu))
    size = F.when(F.col(memory).contains("Ki"), number(memory) * 1024).otherwise(number(memory))
    return df.withColumn("cpu_percent", millicores / 1000 * 100).withColumn(
        "memory_percent", size / (1024 * 1024 * 1024) * 100
    )


def scaling_decision(value: Column, up: Column, down: Column, *, missing_as_zero: bool = False) -> Column:
    """``scale_up``, ``scale_down`` or null; a missing metric decides nothing unless taken as 0."""
    v = F.coalesce(value, F.lit(0.0)) if missing_as_zero else value
    return F.when(v >= up, F.lit("scale_up")).when(v <= down, F.lit("scale_down"))


def next_class(current: Column, direction: Column) -> Column:
    """Neighbour on the instance ladder; unknown classes and ladder ends stay."""
    up = {a: b for ladder in packs.INSTANCE_LADDERS for a, b in zip(ladder, ladder[1:])}
    down = {b: a for a, b in up.items()}
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    step = F.when(direction == "up", F.try_element_at(pairs(up), current)).otherwise(
        F.try_element_at(pairs(down), current)
    )
    return F.coalesce(step, current)


def active_policies(policies: DataFrame, instances: DataFrame) -> DataFrame:
    side = instances.filter(F.col("status") == "available").select(
        "instance_id", "instance_class"
    )
    return policies.filter("is_active").join(side, "instance_id")


def scaling_events(
    policies: DataFrame, metrics: DataFrame, *, missing_as_zero: bool = False,
    last_events: DataFrame | None = None, as_of: Column | None = None,
) -> DataFrame:
    """Scaling event rows of active policies: decision, neighbouring class, trigger value.

    No row when the class would not change. With ``last_events`` (instance_id, created_at) the
    policies' ``cooldown_s`` is enforced at ``as_of``.
    """
    side = metrics.select(
        F.col("instance_id").alias("_i"), F.col("metric").alias("_m"), F.col("value").alias("trigger_value")
    )
    df = policies.join(
        side, (F.col("instance_id") == F.col("_i")) & (F.col("metric_type") == F.col("_m")), "left"
    ).drop("_i", "_m")
    if last_events is not None:
        last = last_events.groupBy(F.col("instance_id").alias("_i")).agg(F.max("created_at").alias("_at"))
        df = df.join(last, F.col("instance_id") == F.col("_i"), "left").filter(
            F.col("_at").isNull() | (F.unix_micros(as_of) - F.unix_micros("_at") >= F.col("cooldown_s") * 1_000_000)
        ).drop("_i", "_at")
    action = scaling_decision(
        F.col("trigger_value"), F.col("scale_up_threshold"), F.col("scale_down_threshold"), missing_as_zero=missing_as_zero
    )
    direction = F.when(F.col("action") == "scale_up", F.lit("up")).otherwise(F.lit("down"))
    return (
        df.withColumn("action", action)
        .filter(F.col("action").isNotNull())
        .withColumn("new_class", next_class(F.col("instance_class"), direction))
        .filter(F.col("new_class") != F.col("instance_class"))
        .select(
            "instance_id", "policy_id", "action", F.col("instance_class").alias("old_class"), "new_class",
            F.col("metric_type").alias("trigger_metric"),
            F.coalesce("trigger_value", F.lit(0.0)).alias("trigger_value"),
            F.lit("threshold").alias("trigger_type"),
        )
    )

