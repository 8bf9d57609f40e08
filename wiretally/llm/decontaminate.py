"""Training passages that copy benchmark items, exactly or edited.

Seeds are word n-grams of the items. A seed is rare if at most ``RARE`` items hold it; an item has all its rare seeds, and where these are fewer than ``LEAST``
the next rarest ones too, so that items made of common phrases are found as well. How many documents hold a seed does not count: a document's matches don't
depend on the rest of the table.

Each text is split into words once. Places where one of its n-grams passes a bit table of fixed size, made from all seeds, become rows, and these meet
the seeds in an equi-join (both sides are dealt over ``SALT`` parts, so that a passage of a third of the documents is in many tasks). Hits on one item that lie
along one another give a passage. A passage that has too few words of the item to reach the threshold is passed over; any other is aligned with the item by
Smith-Waterman on words: ``MATCH`` for equal words, ``MISS`` for others, ``GAP`` for a word left out on either side. The score is the share of the best possible,
so edits lower it word by word. Only texts with hits are shuffled, once each; nothing that grows with either table reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.anchors import mix
from wiretally.llm.common import record_batch, work_folder, written
from wiretally.llm.shingles import PRIME, WORD

SEED = 4
RARE = 16  # items that hold a rare seed, at most
LEAST = 8  # seeds of an item, if it has so many
MATCH, MISS, GAP = 2, -1, -1
THRESHOLD = 0.5
FILTER_BITS = 1 << 25  # 4 MB, whatever the items
SALT = 8
CACHED = 300_000


def split_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Numbers:
    """64-bit numbers of words, kept for the words met lately."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            for i, number in enumerate(found):
                if number is None:
                    found[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return np.array(found, np.uint64)


def seeds_of(numbers: np.ndarray, size: int) -> np.ndarray:
    """A key for each run of ``size`` words."""
    n = len(numbers) - size + 1
    if n < 1 or not size:
        return np.empty(0, np.uint64)
    key = numbers[:n]
    for step in range(1, size):
        key = key * PRIME + numbers[step : step + n]
    return mix(key + np.uint64(size))


def bits_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key in the bit table."""
    return (keys % np.uint64(FILTER_BITS)).astype(np.int64), ((keys >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman score as a share of the best possible, and the first and past-last word of the passage that it spans."""
    n = len(passage)
    slope = -GAP * np.arange(n + 1)
    above, start_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in item:
        straight = above[:-1] + np.where(passage == word, MATCH, MISS)
        down = above[1:] + GAP
        cell = np.concatenate([[0], np.maximum(np.maximum(straight, down), 0)])
        origin = np.concatenate([[0], np.where(straight >= down, start_above[:-1], start_above[1:])])
        origin = np.where(cell > 0, origin, np.arange(n + 1))
        lifted = cell + slope
        reached = np.maximum.accumulate(lifted)
        leader = np.maximum.accumulate(np.where(lifted == reached, np.arange(n + 1), 0))
        above, start_above = reached - slope, origin[leader]
        top = int(above.argmax())
        if above[top] > best:
            best, span = int(above[top]), (int(start_above[top]), top)
    return best / (MATCH * len(item)), *span



def item_seeds(items: DataFrame) -> DataFrame:
    """(item, size, place, key, bit, other): the seeds of each of ``items`` (item, text); an item shorter than a seed is one as a whole."""
    schema = pa.schema([("item", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("key", pa.int64()), ("bit", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = numbers.of(split_words(text))
                size = min(SEED, len(own))
                keys = seeds_of(own, size)
                n = len(keys)
                yield record_batch(schema, np.full(n, item), np.full(n, size, np.int32), np.arange(n, dtype=np.int32), keys.view(np.int64), *bits_of(keys))

    found = items.select("item", "text").mapInArrow(run, "item long, size int, place int, key long, bit long, other long")
    held = found.groupBy("key").agg(F.count_distinct("item").alias("held"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy("held", "place"))
    return found.join(held, "key").withColumn("nth", nth).where((F.col("held") <= RARE) | (F.col("nth") <= LEAST)).select(*schema.names)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A table of bits, those of all keys set; at most a row for each 64 bits reaches the driver."""
    at = seeds.select(F.explode(F.array("bit", "other")).alias("at")).select(F.shiftright("at", 6).alias("word"), (F.col("at") % 64).cast("int").alias("bit"))
    words = at.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def texts_with_hits(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, doc_id, text, keys, places) of those of ``rows`` (row, doc_id, text) with runs of words that pass the filter."""
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most SEED numbers
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(seed_filter(seeds)).tobytes())
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, numbers = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool), Numbers()
        for batch in batches:
            found = []
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = numbers.of(split_words(text))
                keys, places = [], []
                for size in sizes:
                    every = seeds_of(own, size)
                    bit, other = bits_of(every)
                    at = np.flatnonzero(passes[bit] & passes[other])
                    keys.append(every[at].view(np.int64))
                    places.append(at)
                if sum(map(len, keys)):
                    found.append((row, doc_id, text, np.concatenate(keys), np.concatenate(places).astype(np.int32)))
            if found:
                yield record_batch(schema, *zip(*found))

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, text string, keys array<long>, places array<int>")


@lru_cache(1024)
def _item_words(text: str) -> tuple[str, ...]:
    return tuple(split_words(text))


def best_passage(words: np.ndarray, item: np.ndarray, begins: list[int], threshold: float) -> tuple[float, int, int]:
    """The best alignment of an item (its words' numbers) near the places where it may begin, and the words it spans."""
    best, slack = (0.0, 0, 0), len(item) // 2 + SEED
    found = sorted(begins)
    begin = 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i] - found[i - 1] > slack:
            low, high = max(0, found[begin] - slack), min(len(words), found[i - 1] + len(item) + slack)
            if np.isin(item, words[low:high]).sum() >= threshold * len(item) - 1e-9:  # each word of the item can add one MATCH at most
                score, first, last = align(item, words[low:high])
                best = max(best, (score, -(low + first), low + last))
            begin = i
    return best[0], -best[1], best[2]


def row_matches(rows: DataFrame, items: DataFrame, threshold: float = THRESHOLD, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, doc_id, item_id, score, begin, end) of ``rows`` (row long, unique; doc_id long; text) and items whose alignment reaches ``threshold``; begin and end count words of the text.

    Null and empty texts match nothing, null items and those without a word are left out, and without items nothing matches. An item that is in the table
    twice matches once for each id.
    """
    folder = work_folder(rows.sparkSession)
    known = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    known = written(known.withColumn("item", F.monotonically_increasing_id()), folder, "items")
    seeds = written(item_seeds(known), folder, "seeds")
    hits = written(texts_with_hits(rows, seeds), folder, "hits", compression="zstd")
    spots = hits.select("row", F.explode(F.arrays_zip("keys", "places")).alias("hit")).select("row", F.col("hit.keys").alias("key"), F.col("hit.places").alias("at"), F.pmod(F.xxhash64("row"), F.lit(SALT)).alias("salt"))
    dealt = seeds.select("item", "key", "place").withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALT)))))
    pairs = spots.join(dealt, ["key", "salt"]).groupBy("row", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("begins"))
    asked = pairs.join(known, "item").select("row", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "text", "item_id", "begins")
    texts = hits.select("row", F.lit(0).alias("kind"), "doc_id", "text", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("array<int>").alias("begins"))
    together = texts.unionByName(asked).repartition("row").sortWithinPartitions("row", "kind")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, doc_id, words, vocabulary = None, None, None, {}
        for batch in batches:
            found = []
            for row, kind, number, own, item, begins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:  # a text comes before the items that it may hold, and is split if there are any
                    text, doc_id, words = own, number, None
                    continue
                if words is None:
                    vocabulary = {}
                    words = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(text)], np.uint64)
                numbers = np.array([vocabulary.get(w, 0) for w in _item_words(own)], np.uint64)
                score, begin, end = best_passage(words, numbers, begins, threshold)
                if score >= threshold:
                    found.append((row, doc_id, item, score, begin, end))
            if found:
                yield record_batch(schema, *zip(*found))

    return together.mapInArrow(run, "row long, doc_id long, item_id long, score double, begin int, end int")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, begin, end) of every row of ``docs`` and item whose alignment reaches ``threshold``; see ``row_matches``.

    A repeated row gives its matches again. Other columns are left behind.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return row_matches(rows, items, threshold).select("doc_id", "item_id", "score", "begin", "end")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a match."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    rows = written(docs.withColumn(name, F.monotonically_increasing_id()), work_folder(docs.sparkSession), "numbered", compression="zstd")
    found = row_matches(rows.select(F.col(name).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), items, threshold)
    return rows.join(found.select(F.col("row").alias(name)), name, "left_anti").drop(name)
