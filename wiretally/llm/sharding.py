"""Shards by a tree of weighted hash draws.

A row descends from the root to a region, from there to a rack, and from there to a shard. At each step every child draws
ln(u) / weight, where u in (0, 1) is a hash of the row's key and the child's name, and the largest draw wins; a child wins in proportion to
its weight. A draw depends on nothing but its own child's weight, so when weights change, rows leave only for subtrees that have
grown and come only from subtrees that have shrunk; all others stay. A shard that ``grown`` adds stands in a region of its own: every
other weight stays as it is, and rows move into the new shard alone.

Each row also gets its place within its shard. Rows are sorted by range of (key, size, hash, row number), so that a key that a third of the rows
hold is spread over many tasks; tasks number their rows for each shard in one pass, and a table with a row for each (task, shard) gives
the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import work_folder, written

HEX_DIGITS = 13  # of the hash that make a draw: 52 bits, so that a double holds them


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def planned(shards: int, racks_in_region: int = 2, shards_in_rack: int = 4) -> list[Leaf]:
    """Shards 0 to ``shards`` - 1, filling racks and regions in order."""
    return [Leaf(i // (racks_in_region * shards_in_rack), i // shards_in_rack, i) for i in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a rack and a region of its own."""
    region, rack, shard = (max((getattr(x, level) for x in leaves), default=-1) + 1 for level in ("region", "rack", "shard"))
    return [*leaves, Leaf(region, rack, shard, weight)]


def children(leaves: list[Leaf]) -> dict[str, dict[str, float]]:
    """For each inner node the names and weights of its children; the root is named ``""``, the others by their path."""
    nodes: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        if leaf.weight <= 0:
            continue
        path = ["", f"{leaf.region}", f"{leaf.region}/{leaf.rack}", f"{leaf.region}/{leaf.rack}/{leaf.shard}"]
        for parent, child in zip(path, path[1:]):
            below = nodes.setdefault(parent, {})
            below[child] = below.get(child, 0.0) + leaf.weight
    return nodes


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key (a string) as int. The tree is a literal of the plan: its size is that of the leaves, not of the data."""
    nodes = children(leaves)
    if not nodes:
        raise ValueError("no shard has a weight above 0")
    pairs = []
    for parent, below in nodes.items():
        pairs += [F.lit(parent), F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")) for name, weight in below.items()))]
    tree = F.create_map(*pairs)

    def draw(child: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws("/", key, child["name"])), 1, HEX_DIGITS)
        unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)
        return F.struct((F.ln(unit) / child["weight"]).alias("draw"), child["name"].alias("name"))

    node = F.lit("")
    for _ in ("region", "rack", "shard"):
        node = F.array_max(F.transform(F.element_at(tree, node), draw))["name"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def numbered_within(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: 0, 1, 2 and so on within each value of ``group`` (an int, not null), in ``order``. No task sees a whole group."""
    folder = work_folder(rows.sparkSession)
    schema = rows.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            groups = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            places = np.zeros(len(groups), np.int64)
            for value in np.unique(groups):
                at = np.flatnonzero(groups == value)
                places[at] = seen.get(value, 0) + np.arange(len(at))
                seen[value] = seen.get(value, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(groups), part, np.int32)), pa.array(places)], names=[*batch.schema.names, "_part", out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(ranged.mapInArrow(number, f"{fields}, _part int, `{out}` long"), folder, "numbered")
    counts = local.groupBy("_part", group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    return local.join(counts.select("_part", group, before.alias("_before")), ["_part", group]).select(*schema.names, (F.col("_before") + F.col(out)).alias(out))


def assign(docs: DataFrame, leaves: list[Leaf], id_col: str = "doc_id", text_col: str = "text", weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs``.

    The id and the tree alone decide the shard. ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` the checksum of these bytes; a null
    text has none, like the empty one. Slots count from 0 in each shard, by id (null first), checksum and size; rows equal in all of these share
    a shard and take its slots in any order. ``grown_shard`` is the shard with one more shard of ``weight`` in the tree. Null ids count as the
    empty key. Every row gives one row; other columns are left behind; no rows in, no rows out.
    """
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1).cast("long")).alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, leaves).alias("shard"), shard_of(key, grown(leaves, weight)).alias("grown_shard"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = written(rows, work_folder(docs.sparkSession), "placed")
    slotted = numbered_within(rows, "shard", ["doc_id", "text_crc32", "size", "_row"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
