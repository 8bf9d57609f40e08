"""Exact duplicates by deterministic naming of blocks.

Normalised texts are cut into blocks of ``BLOCK`` characters. All blocks are sorted, and each gets an integer name: its place among the
distinct blocks. Then adjacent names are paired, the pairs sorted and named in the same way, and so on until every document has one
name. Documents with equal names after equally many rounds have equal texts, and no others: names stand for contents, not for hashes.

Sorting is by range over a block's first ``LEAD`` characters, a hash of it, and its occurrence, so a block that a third of the documents hold is spread over
many tasks, and Spark's samples for the ranges are short. Within a range whole blocks are compared. Where a run goes across a range's end, a join of neighbouring ends
compares their contents on the executors; the driver sees numbers alone. Should two different blocks agree in their lead, the round is sorted again by whole
blocks. Each round is a written table, and half the size of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import work_folder, written

BLOCK = 4096
LEAD = 16
CARRIED = "row long, at long, n long, doc_id long, sha binary"


def normalised(text: Column) -> Column:
    """Runs of the six ASCII white-space characters become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


ENDS = "part long, local long, first binary, last binary, first_lead binary, last_lead binary, clash boolean"


def sorted_names(rows: DataFrame, keys: list[str], folder: str, name: str, lead: dict[str, Column] | None = None) -> DataFrame:
    """Rows with ``name``, the place of their keys among the distinct keys in sorted order. Keys must not be null.

    Other columns are those of ``CARRIED``; (row, at) tells occurrences apart. The ranges are cut by ``lead``, short columns made from the keys, else by the keys.
    """
    columns, wide = [c.split()[0] for c in CARRIED.split(", ")], lead or {}
    cut = [*wide] or keys
    ranged = rows.withColumns(wide).repartitionByRange(*cut, "row", "at").sortWithinPartitions(*wide, *keys, "row", "at")
    n_keys, n_wide = len(keys), len(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, clash, ends = TaskContext.get().partitionId(), -1, False, None
        spelt = lambda batch, i, to: repr([batch.column(k)[i].as_py() for k in range(to)]).encode()
        out = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            unlike = [pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).to_numpy(zero_copy_only=False) for k in range(n_wide + n_keys)]
            fresh = np.ones(n, bool)
            fresh[1:] = np.logical_or.reduce(unlike)
            here = spelt(batch, 0, n_wide), spelt(batch, 0, n_wide + n_keys)
            if ends is None:
                ends = [*here, *here]
            else:
                fresh[0] = here[1] != ends[3]
                clash |= bool(n_wide) and bool(fresh[0]) and here[0] == ends[2]
            if n_wide:
                clash |= bool((np.logical_or.reduce(unlike[n_wide:]) & ~np.logical_or.reduce(unlike[:n_wide])).any())
            local = seen + np.cumsum(fresh)
            seen, ends[2:] = int(local[-1]), [spelt(batch, n - 1, n_wide), spelt(batch, n - 1, n_wide + n_keys)]
            empty = pa.nulls(n, pa.binary())
            names = [*columns, *(c.split()[0] for c in ENDS.split(", "))]
            carried = batch.columns[n_wide + n_keys :]
            out = pa.RecordBatch.from_arrays([*carried, pa.array(np.full(n, part, np.int64)), pa.array(local.astype(np.int64)), empty, empty, empty, empty, pa.nulls(n, pa.bool_())], names=names)
            yield out
        if out is not None:
            row = [part, seen + 1, ends[1], ends[3], ends[0], ends[2], clash]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in out.columns[: len(columns)]), *(pa.array([v], c.type) for v, c in zip(row, out.columns[len(columns) :]))], names=out.schema.names)

    local = written(ranged.select(*wide, *keys, *columns).mapInArrow(run, f"{CARRIED}, {ENDS}"), folder, name)
    spark, ends = local.sparkSession, local.where("first is not null")
    counts = sorted(map(tuple, ends.select("part", "local", "clash").collect()))  # a row for each range, of numbers
    neighbours = spark.createDataFrame([(b[0], a[0]) for a, b in zip(counts, counts[1:])], "part long, before long")
    before = ends.select(F.col("part").alias("before"), F.col("last").alias("ended"), F.col("last_lead").alias("ended_lead"))
    met = neighbours.join(ends, "part").join(before, "before").select("part", (F.col("first") == F.col("ended")).alias("same"), (F.col("first_lead") == F.col("ended_lead")).alias("alike"))
    met = {part: (same, alike) for part, same, alike in met.collect()}
    if wide and any(clash for _, _, clash in counts) or wide and any(alike and not same for same, alike in met.values()):
        return sorted_names(rows, keys, folder, f"{name}_whole")
    base, bases = 0, []
    for part, count, _ in counts:
        base -= met.get(part, (False, False))[0]
        bases.append((part, base))
        base += count
    offsets = spark.createDataFrame(bases, "part long, base long")
    return local.where("first is null").join(F.broadcast(offsets), "part").select(*columns, (F.col("base") + F.col("local")).alias("name"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) of each row of ``docs``.

    Texts are equal if they are after ``normalised``. Of equal texts the row with the smallest id is kept (null ids come last; of rows with
    one id, the first of the table). ``text_sha256`` is the hash of the normalised text, for the reader: classes do not rest on it. ``row`` is
    ``row_col`` (longs, unique) if given, else a number made here. No rows in, no rows out.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    texts = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    cut = texts.select("row", "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(blocks).alias("blocks"))
    cut = cut.select("row", "doc_id", "sha", F.size("blocks").cast("long").alias("n"), F.posexplode("blocks").alias("at", "block"))
    head = F.col("at") == 0
    cut = cut.select("block", "row", F.col("at").cast("long").alias("at"), "n", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("sha")).alias("sha"))
    names = sorted_names(cut, ["block"], folder, "round0", {"_lead": F.substring("block", 1, LEAD), "_hash": F.xxhash64("block")})
    finished = [names.where("n = 1").withColumn("round", F.lit(0))]
    longest = names.agg(F.max("n")).first()[0] or 0
    level = 0
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        odd = F.col("at") % 2 == 1
        pairs = names.where("n > 1").groupBy("row", F.shiftright("at", 1).alias("place"))
        pairs = pairs.agg(
            F.max(F.when(~odd, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
            F.expr("(max(n) + 1) div 2").alias("n"), F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"),
        )
        names = sorted_names(pairs.withColumnRenamed("place", "at"), ["left", "right"], folder, f"round{level}")
        finished.append(names.where("n = 1").withColumn("round", F.lit(level)))
    one = finished[0]
    for more in finished[1:]:
        one = one.unionByName(more)
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    classes = one.groupBy("round", "name").agg(F.min(rank).alias("least"), F.count("*").alias("group_size"))
    # A table, so that the join has a shuffle on both sides and Spark can split a class that many rows share.
    joined = one.join(written(classes, folder, "classes"), ["round", "name"])
    kept = F.col("row") == F.col("least.row")
    return joined.select("row", "doc_id", F.col("least.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
