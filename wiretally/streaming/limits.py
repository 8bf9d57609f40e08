"""Rate limiters on streams: the batch machines over keyed state.

Each key keeps one small state row. Events older than the key's newest one are passed through
untouched and flagged ``late``; state idle for ``ttl_seconds`` is dropped, which is exact for any
limiter whose state has run out by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the embedded key-value state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class LimiterProcessor(StatefulProcessor):
    """Moves a limiter machine by the key's events of one micro-batch, in (time, tie) order."""

    def __init__(self, machine, columns: list[str], tie: str, ttl_ms: int | None):
        self.machine, self.columns, self.tie, self.ttl_ms = machine, columns, tie, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField(n, T.LongType()) for n in [*self.machine.state, "seen"]]
        self.state = handle.getValueState("limiter", T.StructType(fields), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["event_us", self.tie])
        stored = self.state.get() if self.state.exists() else None
        state = None if stored is None or stored[0] is None else tuple(int(v) for v in stored[:-1])
        seen = None if stored is None else int(stored[-1])
        names = self.machine.outputs.fieldNames()
        results, late = [], []
        params = batch["limiter_param"].tolist()
        for i, t in enumerate(batch["event_us"].tolist()):
            late.append(seen is not None and t < seen)
            if late[-1]:
                results.append(self.machine.unlimited)
                continue
            state, result = self.machine.step(state, t, None if pd.isna(params[i]) else int(params[i]))
            results.append(result)
            seen = t
        self.state.update((*(state or (None,) * len(self.machine.state)), seen))
        out = batch[self.columns].copy()
        for name, values in zip(names, zip(*results)):
            boolean = isinstance(self.machine.outputs[name].dataType, T.BooleanType)
            out[name] = pd.array(values, dtype="boolean" if boolean else "Int64")
        out["late"] = late
        yield out

    def close(self) -> None:
        pass


def limit_stream(
    stream: DataFrame, machine, key: str, ts: str, tie: str, *, param: str | None = None, ttl_seconds: int | None = None
) -> DataFrame:
    """Add the machine's outputs and ``late`` to a stream; rows with a null key must be split off before."""
    columns = list(stream.columns)
    prepared = stream.withColumn("event_us", F.unix_micros(ts)).withColumn(
        "limiter_param", (F.col(param) if param else F.lit(None)).cast("long")
    )
    schema = T.StructType([*stream.schema.fields, *machine.outputs.fields, T.StructField("late", T.BooleanType())])
    processor = LimiterProcessor(machine, columns, tie, None if ttl_seconds is None else ttl_seconds * 1000)
    return prepared.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=schema,
        outputMode="Append",
        timeMode="None" if ttl_seconds is None else "ProcessingTime",
    )


class StickyProcessor(StatefulProcessor):
    """Keeps the backend of a client's first routed request while it stays healthy."""

    def __init__(self, columns: list[str], tie: str, ttl_ms: int | None):
        self.columns, self.tie, self.ttl_ms = columns, tie, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.backend = handle.getValueState(
            "backend", T.StructType([T.StructField("backend_id", T.LongType())]), self.ttl_ms
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["event_us", self.tie])
        held = int(self.backend.get()[0]) if self.backend.exists() else None
        backends, hits = [], []
        for proposed, unhealthy in zip(batch["backend_id"].tolist(), batch["unhealthy_ids"].tolist()):
            bad = set() if unhealthy is None else set(unhealthy)
            hit = held is not None and held not in bad
            hits.append(hit)
            if not hit and not pd.isna(proposed):
                held = int(proposed)
            backends.append(held if hit or not pd.isna(proposed) else None)
        if held is not None:
            self.backend.update((held,))
        out = batch[self.columns].copy()
        out["backend_id"] = pd.array(backends, dtype="Int64")
        out["session_hit"] = hits
        yield out

    def close(self) -> None:
        pass


def sticky_stream(
    stream: DataFrame, ts: str, tie: str, *, ip: str = "ip", port: str = "port", ttl_seconds: int | None = None
) -> DataFrame:
    """Session affinity on a routed stream: ``backend_id`` (long), ``unhealthy_ids`` (ids known to be down)."""
    columns = list(stream.columns)
    prepared = stream.withColumn("event_us", F.unix_micros(ts))
    return prepared.groupBy(ip, port).transformWithStateInPandas(
        statefulProcessor=StickyProcessor(columns, tie, None if ttl_seconds is None else ttl_seconds * 1000),
        outputStructType=T.StructType([*stream.schema.fields, T.StructField("session_hit", T.BooleanType())]),
        outputMode="Append",
        timeMode="None" if ttl_seconds is None else "ProcessingTime",
    )
