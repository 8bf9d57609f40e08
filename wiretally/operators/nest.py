"""Nested lists per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(df: DataFrame, keys: list[str], item: Column, out: str, *, spread_by: str, parts: int) -> DataFrame:
    """``keys, part, out``: the key's items as sorted arrays, one for each ``part`` that has any.

    An item's part is a hash of ``spread_by`` modulo ``parts``, whatever the key's size: the caller says how many rows its largest keys need, and
    every key is laid out alike. Nothing is dropped.
    """
    part = F.pmod(F.xxhash64(spread_by), F.lit(parts)).cast("int").alias("part")
    return df.groupBy(*keys, part).agg(F.sort_array(F.collect_list(item)).alias(out))
