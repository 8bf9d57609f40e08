"""Query patterns, their latency averages, the latency model and the advice built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.functions import fingerprint as fp
from wiretally.operators.sliced import DEFAULT_SLICE_SECONDS, PLACE, SLICE, ema_final, ema_parts, running_sums, with_slice

ALPHA = 0.1
MIN_SAMPLES = 10
FEATURES = [
    "query_complexity", "table_count", "join_count", "where_clause_complexity", "parameter_count",
    "database_load", "time_of_day", "day_of_week", "historical_avg_latency", "cache_hit_ratio",
]


def with_pattern(log: DataFrame, query: str = "query") -> DataFrame:
    """Add ``template`` and ``pattern_id``."""
    return log.withColumn("template", fp.normalize_sql(F.col(query))).withColumn("pattern_id", F.md5("template"))


def pattern_stats(log: DataFrame, *, ts: str = "ts", query: str = "query") -> DataFrame:
    """Per pattern: executions and last sighting."""
    return (
        with_pattern(log, query)
        .groupBy("pattern_id")
        .agg(F.count(F.lit(1)).alias("frequency"), F.max(ts).alias("last_seen"), F.min("template").alias("template"))
    )


def top_patterns(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy(F.col("frequency").desc(), "pattern_id").limit(k)


def cap_patterns(stats: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` patterns (the older ones are evicted)."""
    return stats.orderBy(F.col("last_seen").desc(), "pattern_id").limit(n)


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Newest row per key by one partial aggregate; no window, so hot keys stay small."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])
    )


def trim_history(df: DataFrame, ts: str, since: Column) -> DataFrame:
    """The rows from ``since`` on; the caller says how far back training looks."""
    return df.filter(F.col(ts) >= since)


def trim_training(df: DataFrame, ts: str, tie: str, cap: int) -> DataFrame:
    """All rows up to twice ``cap``; of more, the newest half (rounded down), equal times by ``tie``. No task sorts the whole."""
    ranked = running_sums(df, [], ts, tie, {"_rank": F.lit(1)}, descending=True).withColumn("_n", df.agg(F.count("*")).scalar())
    return ranked.where((F.col("_n") <= 2 * cap) | (F.col("_rank") <= F.floor(F.col("_n") / 2))).drop("_rank", "_n")


def latency_ema(
    log: DataFrame,
    *,
    key: str = "pattern_id",
    ts: str = "ts",
    tie: str = "log_id",
    latency: str = "latency",
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Per key the latency average (start 0) as ``avg_latency`` and ``n``."""
    return ema_final(
        log, [key], ts, tie, {"avg_latency": F.col(latency)}, alpha=ALPHA, slice_seconds=slice_seconds
    )


def pattern_profile(
    log: DataFrame,
    *,
    ts: str = "ts",
    tie: str = "log_id",
    query: str = "query",
    latency: str = "latency",
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """One row per pattern: shape of the text, executions, latency and complexity averages.

    Text features are computed once per pattern, from its first query text, not per log row.
    """
    marked = with_pattern(log, query)
    averages = ema_final(
        marked,
        ["pattern_id"],
        ts,
        tie,
        {"avg_latency": F.col(latency), "_measured": F.col(latency) / 100.0},
        alpha=ALPHA,
        slice_seconds=slice_seconds,
    )
    texts = marked.groupBy("pattern_id").agg(
        F.min("template").alias("template"),
        F.min_by(query, F.struct(ts, tie)).alias("sample"),
        F.max(ts).alias("last_seen"),
    )
    sample = F.col("sample")
    shaped = (
        averages.join(texts, "pattern_id")
        .withColumn("tables", fp.table_names(sample))
        .withColumn("operations", fp.operations(sample))
        .withColumn("join_count", fp.join_count(sample))
        .withColumn("parameter_count", F.size(fp.parameters(sample)))
        .withColumn("where_count", fp.count_of(F.col("template"), "where"))
        .withColumn("static_complexity", fp.complexity(sample))
    )
    measured = F.col("_measured") + F.col("static_complexity") * F.pow(F.lit(1.0 - ALPHA), F.col("n"))
    return shaped.withColumn("complexity", measured).drop("_measured")


# --- model -------------------------------------------------------------------------------------------


def features(executions: DataFrame, profile: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Ten feature columns per execution; an unknown pattern gives zeros."""
    side = profile.select(
        F.col("pattern_id").alias("_pid"),
        F.col("complexity").alias("_complexity"),
        F.size("tables").alias("_tables"),
        F.col("join_count").alias("_joins"),
        F.col("where_count").alias("_wheres"),
        F.col("parameter_count").alias("_params"),
        F.col("avg_latency").alias("_avg"),
    )
    joined = executions.join(side, F.col("pattern_id") == F.col("_pid"), "left")
    known = F.col("_pid").isNotNull()
    raw: list[tuple[str, Column]] = list(
        zip(
            FEATURES,
            [
                F.col("_complexity"), F.col("_tables"), F.col("_joins"), F.col("_wheres"), F.col("_params"),
                F.col("database_load"), F.hour(ts) / 24.0, (F.dayofweek(ts) - 1) / 7.0, F.col("_avg"),
                F.col("cache_hit_ratio"),
            ],
        )
    )
    return joined.select(
        *executions.columns,
        *[
            F.when(known, F.coalesce(c.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)).alias(f"f_{name}")
            for name, c in raw
        ],
    )


PIVOT = 1e-9  # a feature that leaves less of its spread, after those before it, follows from them and gets no weight


def _solved(products: np.ndarray) -> list[float]:
    """Weights by elimination of (1, features | label) sums of products; the constant comes first, so the rest is centred."""
    m, size = products.copy(), len(products)
    used, spread = [], None
    for k in range(size):
        if k and m[k, k] <= PIVOT * spread[k]:
            continue
        used.append(k)
        row = m[k] / m[k, k]
        m -= np.outer(m[:, k], row)
        m[k] = row
        spread = np.diagonal(m).copy() if spread is None else spread
    return [float(m[k, -1]) if k in used else 0.0 for k in range(size)]


def fit_latency(df: DataFrame, *, label: str = "latency") -> DataFrame:
    """Least squares over the ten features plus bias: one row with ``weights`` (bias first), null below the minimum of samples.

    One aggregate of sums of products over the rows with a label, and a system of eleven equations: nothing runs before the result is asked for.
    """
    terms = [F.lit(1.0), *(F.col(f"f_{n}") for n in FEATURES)]
    targets = [*terms, F.col(label).cast("double")]
    size = len(terms)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(products: pd.Series) -> pd.Series:
        return products.map(lambda p: _solved(np.array(p).reshape(size, size + 1)))

    sums = df.where(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.array(*(F.sum(a * b) for a in terms for b in targets)).alias("products"))
    return sums.where(F.col("n") >= MIN_SAMPLES).select(solve("products").alias("weights"))


def predict_latency(model: DataFrame, df: DataFrame) -> DataFrame:
    """Add ``predicted``; negative predictions become 0.001. Without a model (too few samples) it is null."""
    weighted = df.withColumn("_w", model.scalar())
    y = F.get("_w", F.lit(0))
    for i, name in enumerate(FEATURES):
        y = y + F.get("_w", F.lit(i + 1)) * F.col(f"f_{name}")
    return weighted.withColumn("_y", y).withColumn("predicted", F.when(F.col("_y") < 0, F.lit(0.001)).otherwise(F.col("_y"))).drop("_w", "_y")


def score_weights(df: DataFrame, kind: str, weights: dict[str, float]) -> DataFrame:
    """Score the features with a given weight table: ``linear``, ``relu`` (10 hidden) or ``ensemble``."""
    values = [F.col(f"f_{n}") for n in FEATURES]

    def weighted(names: list[str], inputs: list[Column]) -> Column:
        total = F.lit(0.0)
        for name, x in zip(names, inputs):
            if name in weights:
                total = total + x * weights[name]
        return total

    if kind == "relu":
        hidden = [
            F.greatest(F.lit(0.0), weighted([f"h1_w_{j}_{i}" for j in range(len(values))], values)) for i in range(10)
        ]
        out = weighted([f"out_w_{i}" for i in range(10)], hidden) + weights.get("out_bias", 0.0)
        return df.withColumn("predicted", F.greatest(F.lit(0.001), out))
    if kind == "ensemble":
        out = F.lit(0.0)
        for tree in range(5):
            out = out + weighted([f"tree_{tree}_w_{i}" for i in range(len(values))], values) / 5.0
        return df.withColumn("predicted", F.greatest(F.lit(0.001), out))
    out = weighted(FEATURES, values) + weights.get("bias", 0.0)
    return df.withColumn("predicted", F.when(out < 0, F.lit(0.001)).otherwise(out))


def fit_accuracy(scored: DataFrame, *, label: str = "latency") -> DataFrame:
    error = F.try_divide(F.abs(F.col("predicted") - F.col(label)), F.col(label))
    return scored.agg(F.greatest(F.lit(0.0), F.lit(1.0) - F.avg(error)).alias("accuracy"))


def confidence(n: Column, accuracy: Column, complexity: Column) -> Column:
    raw = F.lit(0.5) + F.least(F.lit(0.3), n / 100.0) + accuracy * 0.2 - complexity * 0.05
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), raw))


def resource_estimate(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    """Expected rows, cpu, memory, disk and network from the predicted time."""
    p = F.col(predicted)
    return df.select(
        "*",
        F.floor(p * 100).cast("bigint").alias("est_rows"),
        (p * 0.8).alias("est_cpu"),
        F.greatest(F.lit(1.0), p * 10).alias("est_memory_mb"),
        F.floor(p * 1000).cast("bigint").alias("est_io"),
        F.floor(p * 500).cast("bigint").alias("est_network"),
    )


# --- advice ------------------------------------------------------------------------------------------


def advice(profile: DataFrame) -> DataFrame:
    """One row per (pattern, advice) for patterns seen at least ten times."""

    def item(test: Column, kind: str, text: Column, gain: float, sure: float) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(kind).alias("kind"), text.alias("suggestion"), F.lit(gain).alias("improvement"), F.lit(sure).alias("confidence")
            ),
        )

    items = F.array(
        item(
            (F.col("avg_latency") > 1.0) & (F.size("tables") > 0),
            "index_suggestion",
            F.concat(
                F.lit("Consider adding index on frequently queried tables: "), F.concat_ws(", ", F.col("tables"))
            ),
            0.3,
            0.7,
        ),
        item(
            F.col("complexity") > 5.0,
            "query_rewrite",
            F.lit("Consider breaking down complex query into simpler parts"),
            0.4,
            0.6,
        ),
        item(F.col("n") > 100, "routing", F.lit("Route to read replica for better performance"), 0.2, 0.8),
    )
    return (
        profile.filter(F.col("n") >= MIN_SAMPLES)
        .select("pattern_id", F.explode(F.array_compact(items)).alias("a"))
        .select("pattern_id", "a.*")
    )


def route_advice(operations: Column, avg_latency: Column, n: Column) -> Column:
    writes = F.arrays_overlap(operations, F.array(*[F.lit(o) for o in ("INSERT", "UPDATE", "DELETE")]))
    return (
        F.when(writes, F.lit("primary"))
        .when((avg_latency > 2.0) | (n > 50), F.lit("read_replica"))
        .otherwise(F.lit("primary"))
    )


def cache_advice(frequency: Column, avg_latency: Column, n: Column) -> Column:
    return (
        F.when((frequency > 10) & (avg_latency > 0.5), F.lit("enable_query_cache"))
        .when(n > 100, F.lit("enable_result_cache"))
        .otherwise(F.lit("no_cache"))
    )


def index_advice(profile: DataFrame) -> DataFrame:
    """One index suggestion per (pattern, table)."""
    return profile.select("pattern_id", F.explode("tables").alias("table_name")).select(
        "*",
        F.array(F.lit("id")).alias("columns"),
        F.lit("btree").alias("kind"),
        F.lit(0.3).alias("benefit"),
        F.lit(0.1).alias("creation_cost"),
        F.lit(0.05).alias("upkeep_cost"),
    )


def rewrite_advice(profile: DataFrame) -> DataFrame:
    """Patterns with more than two joins, with the common-table-expression suggestion."""
    return profile.filter(F.col("join_count") > 2).select(
        "pattern_id",
        F.lit("Break complex joins into common table expressions").alias("description"),
        F.lit(0.25).alias("improvement"),
        F.lit(0.8).alias("safety"),
    )


# --- series ------------------------------------------------------------------------------------------


def ema_series(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    value: str,
    *,
    alpha: float = ALPHA,
    start: float = 0.0,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Running average after every row, as ``ema``; a null value leaves the average as it was.

    Slices carry their entry value from a per-slice closed form; inside a slice rows stream in
    order through one pass that holds a single number.
    """
    keep = 1.0 - alpha
    key_type = df.schema[key].dataType.simpleString()

    def chain(batches):
        at, level = None, start
        for pdf in batches:  # sorted by key, slice
            out = []
            for k, s, n, e in zip(*[pdf[c].tolist() for c in ("k", "s", "n", "e")]):
                if k != at:
                    at, level = k, start
                out.append((k, s, level))
                level = e + level * keep**n
            yield pd.DataFrame(out, columns=["k", "s", "level"])

    place, placed = F.col(PLACE), with_slice(df, [key], ts, tie, slice_seconds)
    entry = (
        ema_parts(df, [key], ts, tie, {"v": F.col(value)}, alpha, slice_seconds, placed=placed)
        .select(place[key].alias("k"), place[SLICE].alias("s"), F.col("_n").alias("n"), F.col("_e_v").alias("e"))
        .repartition("k")
        .sortWithinPartitions("k", "s")
        .mapInPandas(chain, f"k {key_type}, s long, level double")
    )
    # entry values travel with the rows, ahead of their slice's first one: one shuffle, no join
    rows = placed.withColumn(SLICE, place[SLICE]).drop(PLACE)
    entries = entry.select(F.col("k").alias(key), F.col("s").alias(SLICE), F.col("level").alias("_level"))
    both = rows.withColumn("_level", F.lit(None).cast("double")).unionByName(entries, allowMissingColumns=True)
    ordered = both.repartition(key, SLICE).sortWithinPartitions(key, SLICE, F.col("_level").isNull(), ts, tie)
    columns = list(df.columns)

    def run(batches):
        level = start
        for batch in batches:  # Arrow keeps the rows' own columns exactly as they came
            out = []
            for entered, x in zip(batch.column("_level").to_pylist(), batch.column(value).to_pylist()):
                if entered is not None:
                    level = entered
                elif x is not None:
                    level = alpha * x + keep * level
                if entered is None:
                    out.append(level)
            rows = batch.select(columns).filter(pc.is_null(batch.column("_level")))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.float64())], names=[*columns, "ema"])

    return ordered.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("ema", T.DoubleType())]))
