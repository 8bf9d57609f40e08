"""Ordered per-key computations that stay parallel when one key holds most of the rows.

A key's rows are cut into time slices. Rows shuffle once by (key, slice); what a slice must know
about earlier slices is carried by a summary with one row per (key, slice). The only step that
sees a whole key is the chain over those summary rows, whose number is bounded by the time range
over the slice width, not by the row count.

Slices of a key with more than ``CROWD`` rows are cut further, at quantiles of time, and a single instant with so many rows at quantiles of the
tie-break. The cuts are a small table, written once, so that every look at the rows sees the same slices; where no slice of the clock holds so many rows of all keys
together there is nothing to cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wiretally.sources.folders import new_folder

SLICE = "_slice"
PLACE = "_place"  # struct of the keys and the slice: one column to shuffle, join and window by
DEFAULT_SLICE_SECONDS = 3600


CROWD = 4_000_000  # rows of a (key, slice) that are cut further
CUTS = 64  # parts of a crowded slice, and of a crowded instant in it
ROOM = 1024  # numbers kept free for the cuts of a slice, and for those of an instant


def _cuts(rows: DataFrame, at: Column, micros: Column, tie: str) -> DataFrame:
    """(_c, cuts, instants) of the crowded (key, slice) places, at most one for each ``CROWD`` rows of the table."""
    places = rows.select(at.alias("_c"), micros.alias("_t"), F.col(tie).alias("_tie"))
    crowded = places.groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select("_c")
    inside = places.join(F.broadcast(crowded), "_c", "left_semi")
    shares = [i / CUTS for i in range(1, CUTS)]
    cuts = inside.groupBy("_c").agg(F.percentile_approx("_t", shares).alias("cuts"))
    instants = inside.groupBy("_c", "_t").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select("_c", "_t")
    ties = inside.join(F.broadcast(instants), ["_c", "_t"], "left_semi").groupBy("_c", "_t").agg(F.percentile_approx("_tie", shares).alias("ties"))
    listed = ties.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_t", "ties"))).alias("instants"))
    alone = F.flatten(F.transform(F.coalesce("instants", F.array()), lambda i: F.array(i["_t"], i["_t"] + 1)))  # a crowded instant has a part of its own
    return cuts.join(listed, "_c", "left").select("_c", F.array_distinct(F.concat("cuts", alone)).alias("cuts"), "instants")


def with_slice(df: DataFrame, keys: list[str], ts: str, tie: str, slice_seconds: int) -> DataFrame:
    """Add ``_place``. As a struct it equals itself where keys are null, and a join on it leaves the
    rows partitioned the way the windows over it need them. ``tie`` must be a number."""
    micros = F.unix_micros(ts)
    number = F.floor(micros / (slice_seconds * 1_000_000))
    place = lambda n: F.struct(*keys, n.alias(SLICE))
    if not df.groupBy(number).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).limit(1).count():
        return df.withColumn(PLACE, place(number * ROOM * ROOM))
    path = f"{new_folder(df.sparkSession)}/cuts"
    table = _cuts(df, place(number), micros, tie)
    table.write.parquet(path)
    table = df.sparkSession.read.schema(table.schema).parquet(path)
    placed = df.withColumn("_c", place(number)).join(F.broadcast(table.withColumnRenamed("_c", "_cut")), F.col("_c") == F.col("_cut"), "left")
    upto = lambda cuts, value: F.least(F.coalesce(F.size(F.filter(cuts, lambda c: c <= value)), F.lit(0)), F.lit(ROOM - 1))
    here = F.try_element_at(F.filter("instants", lambda i: i["_t"] == micros), F.lit(1))["ties"]
    inner = F.when(F.col("cuts").isNotNull(), upto(F.col("cuts"), micros)).otherwise(0)
    innermost = F.when(here.isNotNull(), upto(here, F.col(tie))).otherwise(0)
    return placed.withColumn(PLACE, place((number * ROOM + inner) * ROOM + innermost)).drop("_c", "_cut", "cuts", "instants")


def _chain(keys: list[str], descending: bool = False):
    """Window over one key's summary rows in slice order."""
    order = F.col(f"{PLACE}.{SLICE}")
    by = [F.col(f"{PLACE}.{k}") for k in keys]
    return W.partitionBy(*by).orderBy(order.desc() if descending else order.asc())


def _attach(rows: DataFrame, summary: DataFrame) -> DataFrame:
    side = summary.withColumnRenamed(PLACE, "_side")
    return rows.join(side, F.col(PLACE) == F.col("_side"), "left").drop("_side")


def _order(ts: str, tie: str, descending: bool = False) -> list[Column]:
    return [F.col(ts).desc(), F.col(tie).desc()] if descending else [F.col(ts).asc(), F.col(tie).asc()]


def _upto(order: list[Column]):
    return W.partitionBy(PLACE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def running_sums(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    sums: dict[str, Column],
    *,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums per key in (ts, tie) order; ``F.lit(1)`` gives a row number."""
    rows = with_slice(df, keys, ts, tie, slice_seconds)
    totals = rows.groupBy(PLACE).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = _chain(keys, descending).rowsBetween(W.unboundedPreceding, -1)
    totals = totals if keys else totals.coalesce(1)  # a row for each slice
    offsets = totals.select(
        PLACE, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    upto = _upto(_order(ts, tie, descending))
    return _attach(rows, offsets).select(
        *df.columns, *[(F.sum(c).over(upto) + F.col(f"_o_{n}")).alias(n) for n, c in sums.items()]
    )


def _with_previous(df: DataFrame, keys: list[str], ts: str, tie: str, values: dict[str, str], slice_seconds: int) -> DataFrame:
    """Rows with ``_place`` and the values of the key's preceding row."""
    rows = with_slice(df, keys, ts, tie, slice_seconds)
    packed = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    last = rows.groupBy(PLACE).agg(F.max_by(packed, F.struct(ts, tie)).alias("_last"))
    carried = last.select(PLACE, F.lag("_last").over(_chain(keys)).alias("_carry"))
    w = W.partitionBy(PLACE).orderBy(*_order(ts, tie))
    first = F.row_number().over(w) == 1
    return _attach(rows, carried).select(
        *df.columns,
        PLACE,
        *[
            F.when(first, F.col(f"_carry.{out}")).otherwise(F.lag(src).over(w)).alias(out)
            for out, src in values.items()
        ],
    )


def previous_values(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    values: dict[str, str],
    *,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Values of the key's preceding row as new columns (null on the first row)."""
    return _with_previous(df, keys, ts, tie, values, slice_seconds).drop(PLACE)


def gap_sessions(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    gap_us: int,
    *,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Rank of each row in its session; a session ends when a gap of ``gap_us`` or more follows.

    Adds ``session_rank`` (1 on a session's first row).
    """
    marked = _with_previous(df, keys, ts, tie, {"_prev_ts": ts}, slice_seconds)
    starts = F.col("_prev_ts").isNull() | (F.unix_micros(ts) - F.unix_micros("_prev_ts") >= gap_us)
    upto = _upto(_order(ts, tie))
    rows = marked.withColumn("_rn", F.count(F.lit(1)).over(upto)).withColumn(
        "_start_rn", F.max(F.when(starts, F.col("_rn"))).over(upto)
    )
    summary = rows.groupBy(PLACE).agg(F.count(F.lit(1)).alias("_n"), F.max("_start_rn").alias("_last_start"))
    chain = _chain(keys)
    through, before = (chain.rowsBetween(W.unboundedPreceding, e) for e in (W.currentRow, -1))
    # rows since the last session start, carried over slices that contain no start
    sized = summary.withColumn("_end", F.sum("_n").over(through)).withColumn(
        "_anchor", F.col("_end") - F.col("_n") + F.col("_last_start") - 1
    )
    carry = sized.select(
        PLACE, (F.col("_end") - F.col("_n") - F.coalesce(F.max("_anchor").over(before), F.lit(0))).alias("_carry")
    )
    rank = F.when(F.col("_start_rn").isNull(), F.col("_carry") + F.col("_rn")).otherwise(
        F.col("_rn") - F.col("_start_rn") + 1
    )
    return _attach(rows, carry).select(*df.columns, rank.alias("session_rank"))


def ema_parts(
    df: DataFrame, keys: list[str], ts: str, tie: str, values: dict[str, Column], alpha: float, slice_seconds: int, placed: DataFrame | None = None
) -> DataFrame:
    """Per (key, slice) the row count ``_n`` and each average's part ``_e_<name>`` from its own rows.

    Weights use the distance from the slice's end, so long series cannot overflow. Rows with a null among the values are left out.
    """
    rows = placed if placed is not None else with_slice(df, keys, ts, tie, slice_seconds)
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in values.values()])
    back = F.count_if(known).over(_upto(_order(ts, tie, True))) - 1
    weight = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("_back"))
    return (
        rows.withColumn("_back", back)
        .groupBy(PLACE)
        .agg(
            F.count_if(known).alias("_n"),
            *[F.coalesce(F.sum(F.when(known, c * weight)), F.lit(0.0)).alias(f"_e_{n}") for n, c in values.items()],
        )
    )


def ema_final(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    values: dict[str, Column],
    *,
    alpha: float = 0.1,
    init: dict[str, float] | None = None,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Final exponential moving average per key, plus ``n`` rows without nulls; start value 0 unless given."""
    keep = F.lit(1.0 - alpha)
    partial = ema_parts(df, keys, ts, tie, values, alpha, slice_seconds)
    later = _chain(keys, descending=True).rowsBetween(W.unboundedPreceding, -1)
    shifted = partial.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    start = init or {}
    return shifted.groupBy(*[F.col(f"{PLACE}.{k}").alias(k) for k in keys]).agg(
        F.sum("_n").alias("n"),
        *[
            (F.sum(F.col(f"_e_{n}") * F.pow(keep, F.col("_after"))) + F.lit(start.get(n, 0.0)) * F.pow(keep, F.sum("_n"))).alias(n)
            for n in values
        ],
    )
