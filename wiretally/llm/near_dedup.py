"""Similarity join of documents on word shingles with a MinHash LSH forest.

Texts with equal shingle sets are one *text* of the join, stood for by its first row. Each text has ``TREES`` labels of ``DEPTH`` short
min-hashes. Sorted by label, the texts of a tree form a trie: texts that share a node's prefix are near one another. The prefix is the longest
that a pair at the threshold shares with probability ``recall`` in some tree. Texts are first brought together in *groups*, by the share of equal
min-hashes alone; pairs below the threshold by ``MARGIN`` standard errors or less bring their texts together too:

1. at full depth, each text is compared with the first text of its node;
2. at the prefix, in each node that holds several groups, all pairs of texts of different groups are compared.

So any two texts that share a node and may reach the threshold are in one group. Then all pairs of a group have their shingle sets compared
exactly, and only that makes a link. Linked texts become classes (connected components).

Large nodes and groups are dealt into sub-blocks by a hash, and every pair of sub-blocks is a piece of work of its own. A piece gives the
few links that hold its texts together and counts the others, so that rows don't grow with the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import record_batch, work_folder, written
from wiretally.llm.shingles import Shingler

TREES = 24
DEPTH = 8
MARGIN = 6  # standard errors below the threshold at which the share of equal min-hashes drops a pair
BLOCK = 2048  # shingles hashed at a time
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20  # in a sub-block, on average at most


def shortest_depth(similarity: float, recall: float) -> int:
    """The largest prefix that two texts at the threshold share in some tree with probability ``recall`` or more."""
    fitting = [d for d in range(1, DEPTH + 1) if 1 - (1 - similarity**d) ** TREES >= recall]
    if not fitting:
        raise ValueError(f"{TREES} trees can't reach a recall of {recall} at {similarity}")
    return max(fitting)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` min-hashes of 32 bits."""
    random = np.random.default_rng(11)
    count = TREES * DEPTH
    factor = random.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    flip = random.integers(0, 1 << 32, count, dtype=np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), BLOCK):
        hashed = (values[at : at + BLOCK, None] ^ flip) * factor
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, hashed.min(axis=0))
    return least


SIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("set_key", pa.binary()), ("size", pa.int64()), ("labels", pa.list_(pa.binary())), ("bits", pa.binary())])


def signatures(texts: DataFrame, size: int = 5) -> DataFrame:
    """(row, doc_id, set_key, size, labels, bits) of (row, doc_id, text): a hash of the whole shingle set, its size, the labels of the trees, the low bytes of all min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(2).to_pylist():
                found = shingler.set_of(text)
                hashes = min_hashes(found)
                short = (hashes >> np.uint32(8)).astype(">u2").tobytes()
                out[0].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                out[1].append(len(found))
                out[2].append([short[2 * DEPTH * t : 2 * DEPTH * (t + 1)] for t in range(TREES)])
                out[3].append(hashes.astype(np.uint8).tobytes())
            yield record_batch(SIGNED, batch.column(0), batch.column(1), *out)

    return texts.mapInArrow(run, "row long, doc_id long, set_key binary, size long, labels array<binary>, bits binary")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(text, class) of every end of ``edges`` (a, b): the smallest text that it is linked with over any number of links.

    Each pass points every text to its smallest neighbour and goes on with the links between what is pointed at; links inside vanish.
    """
    labels, number = None, 0
    edges = written(edges.select("a", "b"), folder, f"{name}-links")
    while True:
        both = edges.union(edges.select("b", "a"))
        points = both.groupBy(F.col("a").alias("text")).agg(F.min("b").alias("to")).select("text", F.least("text", "to").alias("to"))
        points = written(points, folder, f"{name}-points{number}")
        if labels is None:
            labels = points.select("text", F.col("to").alias("class"))
        else:
            moved = labels.join(points.select(F.col("text").alias("class"), "to"), "class", "left")
            labels = moved.select("text", F.coalesce("to", "class").alias("class"))
        labels = written(labels, folder, f"{name}-labels{number}")
        to = points.select(F.col("text").alias("a"), F.col("to").alias("x")), points.select(F.col("text").alias("b"), F.col("to").alias("y"))
        edges = edges.join(to[0], "a").join(to[1], "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = written(edges, folder, f"{name}-rest{number}")
        number += 1
        if edges.isEmpty():
            return labels


def _least(similarity: float) -> float:
    """The number of equal min-hashes from which on a pair may reach the threshold."""
    count = TREES * DEPTH
    return similarity * count - MARGIN * math.sqrt(similarity * (1 - similarity) * count)


def _likely(pairs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose share of equal min-hashes does not lie far below the threshold; low bytes agree by chance once in 256."""
    count, least = TREES * DEPTH, _least(similarity)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, count) for i in (2, 3))
            close = (left == right).sum(axis=1) >= least
            yield record_batch(schema, batch.column(0).filter(pa.array(close)), batch.column(1).filter(pa.array(close)))

    ends = [bits.select(F.col("text").alias(k), F.col("bits").alias(f"bits_{k}")) for k in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


class Forest:
    """Which of the things seen so far are linked."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def link(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _dealt(rows: DataFrame, keys: list[str], parts: Column) -> DataFrame:
    """Rows (keys, text, ...) with the sub-block ``part`` of ``parts`` that they are in, once for every pair (i, j) of sub-blocks that it is one of; a pair's rows are together."""
    rows = rows.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "other")
    return rows.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def _pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[tuple], list[tuple], bool]]:
    """Of each pair of sub-blocks the rows of either, and whether both are the same one; rows are (keys, i, j, part, ...)."""
    key, rows = None, []

    def split():
        i, j = key[-2:]
        return [r for r in rows if r[keys + 2] == i], [r for r in rows if r[keys + 2] == j], i == j

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[: keys + 2] != key:
                if rows:
                    yield split()
                key, rows = row[: keys + 2], []
            rows.append(row)
    if rows:
        yield split()


def _across(placed: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of groups that share a node of ``placed`` (text, tree, node, class) and hold a likely pair of texts there."""
    count, least = TREES * DEPTH, _least(similarity)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for left, right, same in _pieces(batches, 2):
            if not left or not right:
                continue
            forest = Forest()
            near, classes = np.frombuffer(b"".join(r[7] for r in right), np.uint8).reshape(-1, count), np.array([r[6] for r in right], np.int64)
            for at, row in enumerate(left):
                start = at + 1 if same else 0
                others = start + np.flatnonzero(classes[start:] != row[6])
                if len(others):
                    close = np.count_nonzero(near[others] == np.frombuffer(row[7], np.uint8), axis=1) >= least
                    out += [(row[6], other) for other in np.unique(classes[others[close]]).tolist() if forest.link(row[6], other)]
            if len(out) >= 10_000:
                yield record_batch(schema, *zip(*out, strict=True))
                out = []
        if out:
            yield record_batch(schema, *zip(*out, strict=True))

    mixed = placed.groupBy("tree", "node").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).where("low <> high")
    rows = placed.join(mixed.select("tree", "node", "n"), ["tree", "node"]).join(bits, "text")
    dealt = _dealt(rows, ["tree", "node"], F.ceil(F.col("n") / BLOCK_TEXTS))
    return dealt.select("tree", "node", "i", "j", "part", "text", "class", "bits").mapInArrow(run, "a long, b long").distinct()


def _linked(left: list[tuple], right: list[tuple], same: bool, similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each text of ``left`` with the texts of ``right`` whose shingle sets have the Jaccard similarity asked for, and that figure; a pair comes once."""
    if not left or not right:
        return
    ends = [sorted(((np.frombuffer(r[5], np.uint64), r[4]) for r in rows), key=lambda x: (len(x[0]), x[1])) for rows in (left, right)]
    texts, sizes = np.array([t for _, t in ends[1]], np.int64), np.array([len(x) for x, _ in ends[1]], np.int64)
    words, numbers = np.unique(np.concatenate([x for x, _ in ends[1]]), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(len(words), np.uint8)
    for at, (shingles, text) in enumerate(ends[0]):
        low = int(np.searchsorted(sizes, math.floor(len(shingles) * similarity) - 1))
        high = int(np.searchsorted(sizes, math.ceil(len(shingles) / similarity) + 1, "right"))
        low = max(low, at + 1) if same else low
        if low >= high:
            continue
        places = np.minimum(np.searchsorted(words, shingles), len(words) - 1)
        places = places[words[places] == shingles]
        held[places] = 1
        both = np.add.reduceat(held[numbers[begins[low] : begins[high]]], begins[low:high] - begins[low], dtype=np.int64)
        held[places] = 0
        found = both / (len(shingles) + sizes[low:high] - both)
        kept = np.flatnonzero(found >= similarity)
        if len(kept):
            yield text, texts[low + kept], found[kept]


def _summed_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n): links that hold the linked texts of a piece together, with n null, and the number n of links of text a in a piece, with b null."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for left, right, same in _pieces(batches, 1):
            forest, count = Forest(), defaultdict(int)
            for text, others, _ in _linked(left, right, same, similarity):
                count[text] += len(others)
                for other in others.tolist():
                    count[other] += 1
                    if forest.link(text, other):
                        out.append((text, other, None))
            out += [(text, None, n) for text, n in count.items()]
            if len(out) >= 10_000:
                yield record_batch(schema, *zip(*out, strict=True))
                out = []
        if out:
            yield record_batch(schema, *zip(*out, strict=True))

    return sets.mapInArrow(run, "a long, b long, n long")


def _all_links(sets: DataFrame, similarity: float) -> DataFrame:
    """All links (a, b, similarity), a < b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, same in _pieces(batches, 1):
            for text, others, found in _linked(left, right, same, similarity):
                yield record_batch(schema, np.minimum(others, text), np.maximum(others, text), found)

    return sets.mapInArrow(run, "a long, b long, similarity double")


def similarity_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, size: int = 5, similarity: float = 0.8, recall: float = 0.9999
) -> tuple[DataFrame, DataFrame]:
    """Classes and links of documents whose sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or more.

    The first result has a row for each row of ``docs``: row, doc_id, text (the row that stands for its shingle set), class (the smallest
    text linked with it over any number of links), class_id (doc_id of the class's first row), class_size (rows), n_links (other texts that its
    text is linked with), kept (whether it is the class's first row: smallest doc_id, null ids last, then first in the table). The second has
    all links (a, b, similarity) between texts, a < b; they are as many as the pairs and made when it is read.

    Words are runs of letters, digits and underscores in lower case. A text of fewer words is one shingle; a text without words
    (null, empty) is a class of its own. ``row`` is ``row_col`` (longs, unique, the same at every reading) if given; else rows are
    numbered and written once, as texts are read twice. Shingles are compared as 64-bit hashes.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    texts = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not row_col:
        texts = written(texts, folder, "numbered", compression="zstd")
    signed = written(signatures(texts, size), folder, "signed", compression="none")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    reps = signed.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(rank.alias("rank"), "size", "labels", "bits")).alias("first"))
    reps = written(reps.select("set_key", F.col("first.rank.row").alias("text"), "first.size", "first.labels", "first.bits"), folder, "texts", compression="none")

    depth = shortest_depth(similarity, recall)
    trees = reps.select("text", F.posexplode("labels").alias("tree", "label")).withColumn("node", F.substring("label", 1, 2 * depth))
    shared = trees.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    trees = written(trees.join(shared, ["tree", "node"]), folder, "trees")
    bits = written(reps.join(trees.select("text").distinct(), "text").select("text", "bits"), folder, "bits", compression="none")

    heads = trees.groupBy("tree", "label").agg(F.min("text").alias("head"), F.count("*").alias("n")).where("n > 1")
    pairs = trees.join(heads, ["tree", "label"]).where("text <> head").select(F.col("head").alias("a"), F.col("text").alias("b")).distinct()
    near = written(_likely(pairs, bits, similarity), folder, "near")
    groups = components(near, folder, "near-groups")
    placed = trees.join(groups, "text", "left").select("text", "tree", "node", F.coalesce("class", "text").alias("class"))
    across = written(_across(placed, bits, similarity), folder, "across")
    groups = components(near.union(across), folder, "groups")

    homes = groups.join(reps.select("text", "size"), "text")
    totals = homes.groupBy("class").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("most"))
    homes = written(homes.join(totals, "class").select("text", "class", "most"), folder, "homes")
    shingle_schema = pa.schema([("class", pa.int64()), ("most", pa.int64()), ("text", pa.int64()), ("shingles", pa.binary())])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            yield record_batch(shingle_schema, *(batch.column(i) for i in range(3)), [shingler.set_of(text).tobytes() for text in batch.column(3).to_pylist()])

    sets = texts.select(F.col("row").alias("text"), F.col("text").alias("body")).join(homes, "text").select("class", "most", "text", "body")
    sets = sets.mapInArrow(shingled, "class long, most long, text long, shingles binary")
    sets = _dealt(sets, ["class"], F.col("most")).select("class", "i", "j", "part", "text", "shingles")
    found = written(_summed_links(sets, similarity), folder, "found")
    classes = components(found.where("b is not null"), folder, "classes")
    degrees = found.where("b is null").groupBy(F.col("a").alias("text")).agg(F.sum("n").alias("n_links"))

    members = signed.select("row", "doc_id", "set_key").join(reps.select("set_key", "text"), "set_key", "left")
    members = members.select("row", "doc_id", F.coalesce("text", "row").alias("text"))
    members = members.join(classes, "text", "left").join(degrees, "text", "left")
    members = members.select("row", "doc_id", "text", F.coalesce("class", "text").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    members = written(members, folder, "members")
    sizes = members.groupBy("class").agg(F.min(rank).alias("first"), F.count("*").alias("class_size"))
    out = members.join(sizes, "class").select(
        "row", "doc_id", "text", "class", F.col("first.doc_id").alias("class_id"), "class_size", "n_links", (F.col("row") == F.col("first.row")).alias("kept")
    )
    return out, _all_links(sets, similarity)
