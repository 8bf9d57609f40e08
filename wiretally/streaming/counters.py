"""Windowed live counters and scaling checks over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.operators.tuning import scaling_decision


def live_counts(
    stream: DataFrame, by: list[str], *, ts: str = "ts", window: str = "1 minute", lateness: str = "5 minutes",
    aggregates: list[Column] | None = None,
) -> DataFrame:
    """Counts per window and group; windows close when the watermark passes them."""
    grouped = stream.withWatermark(ts, lateness).groupBy(F.window(ts, window), *by)
    out = grouped.agg(F.count(F.lit(1)).alias("n"), *(aggregates or []))
    return out.select(F.col("window.start").alias("window_start"), *by, *[c for c in out.columns if c not in ("window", *by)])


def live_histogram(
    stream: DataFrame, by: list[str], value: str, *, ts: str = "ts", window: str = "1 minute", lateness: str = "5 minutes"
) -> DataFrame:
    """Latency buckets per window, cumulative as in the batch histogram, one column per bound."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in packs.LATENCY_BOUNDS]
    return live_counts(
        stream, by, ts=ts, window=window, lateness=lateness, aggregates=[*buckets, F.sum(value).alias("sum")]
    )


def live_scaling(points: DataFrame, policies: DataFrame, *, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Every five minutes a decision per policy over the ten minutes before.

    ``points``: ``instance_id, metric, ts, value``; ``policies`` is static.
    """
    averaged = points.withWatermark(ts, lateness).groupBy(
        F.window(ts, "10 minutes", "5 minutes"), "instance_id", "metric"
    ).agg(F.avg("value").alias("value"))
    side = policies.select(
        "policy_id", F.col("instance_id").alias("_i"), F.col("metric_type").alias("_m"), "scale_up_threshold",
        "scale_down_threshold",
    )
    joined = averaged.join(side, (F.col("instance_id") == F.col("_i")) & (F.col("metric") == F.col("_m")))
    action = scaling_decision(F.col("value"), F.col("scale_up_threshold"), F.col("scale_down_threshold"))
    return joined.select(
        F.col("window.end").alias("checked_at"), "policy_id", "instance_id", "metric", "value", action.alias("action")
    ).filter(F.col("action").isNotNull())
