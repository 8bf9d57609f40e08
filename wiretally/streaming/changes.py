"""Tables that streams keep current: rule changes and the tuner's cooldowns.

Each micro-batch writes its own folder ``batch=<id>`` in overwrite mode, so a batch that is run
again after a failure replaces its rows instead of adding them twice. What a batch reads does not grow with the batches before
it: every ``MERGE_EVERY`` batches the changes are merged into a snapshot, and the tuner carries its state from batch to batch. What
a repeated batch may need again is kept, all before it removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.operators.tuning import applicable_rules
from wiretally.sources.folders import numbered, remove

MERGE_EVERY = 10
CHANGE_SCHEMA = (
    "seq long, op string, id long, kind string, pattern string, reason string, active boolean, batch long"
)


def _latest(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame, list[int], list[int]]:
    """The last message per id (removals too) of the newest snapshot and the batches after it; and the numbers of all snapshots and batches."""
    snapshots, batches = numbered(spark, f"{path}/snapshots", "upto"), numbered(spark, path, "batch")
    used = [n for n in snapshots if before is None or n < before]
    since = used[-1] if used else -1
    tail = [n for n in batches if n > since and (before is None or n <= before)]
    read = spark.createDataFrame([], CHANGE_SCHEMA)
    if used:
        read = read.unionByName(spark.read.schema(CHANGE_SCHEMA).parquet(f"{path}/snapshots/upto={since}"))
    if tail:
        parts = spark.read.schema(CHANGE_SCHEMA).option("basePath", path).parquet(*(f"{path}/batch={n}" for n in tail))
        read = read.unionByName(parts)
    columns = [c for c in read.columns if c != "id"]
    last = read.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("batch", "seq")).alias("r")).select("id", "r.*")
    return last.select(*read.columns), snapshots, batches


def record_changes(path: str, *, merge_every: int = MERGE_EVERY) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of rule messages: ``seq, op (add, remove), id, kind, pattern, reason, active``.

    A batch that comes again finds the snapshot and the batches that it merged the first time, and writes the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % merge_every:
            return
        merged, snapshots, batches = _latest(spark, path, before=batch_id)
        merged.write.mode("overwrite").parquet(f"{path}/snapshots/upto={batch_id}")
        kept = max([n for n in snapshots if n < batch_id], default=-1)
        for n in snapshots:
            if n < kept:
                remove(spark, f"{path}/snapshots/upto={n}")
        for n in batches:
            if n <= kept:
                remove(spark, f"{path}/batch={n}")

    return write


def current_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules as of the last message per id; removed ones are left out. Reads one snapshot and the batches after it."""
    latest, _, _ = _latest(spark, path)
    return latest.filter(F.col("op") != "remove").select("id", "kind", "pattern", "reason", "active")


def with_current_rules(
    spark: SparkSession, rules_path: str, screen: Callable[[DataFrame, DataFrame], DataFrame], out_path: str
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that screens each batch under the rules current at that moment."""

    def write(batch: DataFrame, batch_id: int) -> None:
        screen(batch, current_rules(spark, rules_path)).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return write


def tuner_cycle(spark: SparkSession, rules: DataFrame, applied_path: str, as_of: Callable[[int], Column]) -> Callable:
    """``foreachBatch`` writer: rules that apply to the batch's newest snapshot and are not in
    cooldown are recorded as applied at ``as_of(batch_id)``.

    Beside the applied rules of a batch stands, in ``<applied_path>_state``, when each rule was applied last; a batch reads the state before it alone.
    """
    state_path = f"{applied_path}_state"

    def write(metrics: DataFrame, batch_id: int) -> None:
        newest = metrics.agg(F.max("snapshot_id").alias("_s"))
        current = metrics.join(F.broadcast(newest), F.col("snapshot_id") == F.col("_s")).drop("_s")
        before = [n for n in numbered(spark, state_path, "batch") if n < batch_id]
        earlier = spark.createDataFrame([], "name string, applied_at timestamp")
        if before:
            earlier = spark.read.schema(earlier.schema).parquet(f"{state_path}/batch={before[-1]}")
        chosen = applicable_rules(current, rules, last_applied=earlier, as_of=as_of(batch_id))
        chosen.select("name", as_of(batch_id).alias("applied_at")).write.mode("overwrite").parquet(f"{applied_path}/batch={batch_id}")
        applied = spark.read.schema(earlier.schema).parquet(f"{applied_path}/batch={batch_id}")
        state = earlier.unionByName(applied).groupBy("name").agg(F.max("applied_at").alias("applied_at"))
        state.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
        for n in before[:-1]:
            remove(spark, f"{state_path}/batch={n}")

    return write
