"""Expiry of indicators, blocks and cached decisions as time passes: event-time timers over keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class ExpiryProcessor(StatefulProcessor):
    """Holds a key's newest expiry and a timer for it; a later sighting with another expiry moves the timer, one without any removes it."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("seen_us", T.LongType()), T.StructField("expires_us", T.LongType())]
        self.newest = handle.getValueState("newest", T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, expires = self.newest.get() if self.newest.exists() else (None, None)
        before = expires
        for batch in rows:
            for at, until in zip(batch["seen_us"].tolist(), batch["expires_us"].tolist()):
                until = None if pd.isna(until) else int(until)
                # of equal times the later expiry counts, and none is the latest
                if seen is None or at > seen or at == seen and (until is None or expires is not None and until > expires):
                    seen, expires = int(at), until
        if before != expires:
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000))
            if expires is not None:
                self.handle.registerTimer(-(-expires // 1000))
        self.newest.update((seen, expires))
        yield pd.DataFrame({self.key: pd.Series([], dtype=object), "expired_us": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, expires = self.newest.get()
        self.newest.clear()
        yield pd.DataFrame({self.key: [key[0]], "expired_us": [int(expires)]})

    def close(self) -> None:
        pass


def expired_stream(sightings: DataFrame, key: str, ts: str, expires: str, *, lateness: str = "10 minutes") -> DataFrame:
    """(key, expired_us): every key (not null) whose newest sighting has run out, once the watermark has passed its expiry.

    A key that is seen again after it has gone starts anew. A batch that is run again gives the same rows: timers and state belong to the
    batch's checkpoint, and nothing else is written. State is one row a key, and goes with the key.
    """
    prepared = sightings.where(F.col(key).isNotNull()).select(key, ts, F.unix_micros(ts).alias("seen_us"), F.unix_micros(expires).alias("expires_us"))
    schema = T.StructType([sightings.schema[key], T.StructField("expired_us", T.LongType())])
    return prepared.withWatermark(ts, lateness).groupBy(key).transformWithStateInPandas(
        statefulProcessor=ExpiryProcessor(key), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
