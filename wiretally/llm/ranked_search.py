"""Ranked lexical search of items in documents, by masks of the terms that are present.

Documents are dealt into blocks. For each block there is a posting row for each term of the items that it holds: which of the block's documents hold
the term, and how often. A group of blocks of some ``BLOCK`` documents meets the items whose terms it holds. There, every term of an item has a bitmap of documents; the
bitmaps, laid side by side and turned, give each document's mask of present terms, and documents with one mask form a group. A mask's greatest
possible score is the sum of the greatest scores that its terms reach in these blocks. Masks are evaluated by descending greatest score until the
k-th score found is above that of the next mask; ties are evaluated too, so the result is exact. The best of all groups of blocks are then ranked.

Items meet documents in blocks on both sides: items are dealt into chunks of some ``CHUNK_TERMS`` terms, and a task holds the postings of one chunk's terms in
one group of blocks. Terms that no item holds are passed over by a bit table of fixed size; the join of postings with items' terms is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import keyed_texts, record_batch, work_folder, written

BLOCK = 8_192  # documents
BLOCK_BYTES = 64 << 20
CHUNK_TERMS = 100_000
FILTER_BITS = 1 << 23  # 1 MB, whatever the items
MASK = 64  # terms in one word of a mask
BATCH = 128  # documents that are evaluated at a time, at least

#: Bytes of UTF-8 that end a term become spaces; A-Z become a-z. All bytes above 7F belong to terms.
SPLIT = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()

POSTINGS = "block long, block_docs long, term binary, docs long, terms long, places binary, counts binary, ids binary, nulls binary"


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(SPLIT).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, repeats): a row for each distinct term of each row of ``items``, rows told apart by ``item``."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("term", pa.binary()), ("repeats", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = Counter(terms(text))
                yield record_batch(schema, [item] * len(found), [item_id] * len(found), list(found), list(found.values()))

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item long, item_id long, term binary, repeats long")


def term_filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each value of crc32 modulo ``FILTER_BITS`` that a wanted term has; at most a row for each 64 bits reaches the driver."""
    at = F.crc32("term") % FILTER_BITS
    words = wanted.select(F.shiftright(at, 6).alias("word"), (at % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for word, bits in words.collect():
        table[word] = bits
    return np.unpackbits(table.view(np.uint8), bitorder="little")


def postings(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The blocks of documents with terms: a row with the ids and numbers of terms of the block's documents, and one for each term that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(term_filter(wanted).astype(bool).tobytes())
    schema = pa.schema([("block", pa.int64()), ("block_docs", pa.int64()), ("term", pa.binary()), ("docs", pa.int64()), ("terms", pa.int64()), *((n, pa.binary()) for n in ("places", "counts", "ids", "nulls"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, number = shared.value, TaskContext.get().partitionId() << 32
        ids, lengths, lists, size = [], [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            n = len(ids)
            header = [[number], [n], [None], [n], [sum(lengths)], [None], [np.array(lengths, np.int64).tobytes()], [np.array([i or 0 for i in ids], np.int64).tobytes()], [np.array([i is None for i in ids]).tobytes()]]
            yield record_batch(schema, *header)
            found = sorted(lists)
            for at in range(0, len(found), 4096):
                some = found[at : at + 4096]
                m = len(some)
                places = [np.array(lists[t][0], np.uint32).tobytes() for t in some]
                counts = [np.array(lists[t][1], np.uint32).tobytes() for t in some]
                yield record_batch(schema, [number] * m, [n] * m, some, [len(lists[t][0]) for t in some], [0] * m, places, counts, [None] * m, [None] * m)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                tokens = raw.translate(SPLIT).split() if raw else None
                if not tokens:
                    continue
                place = len(ids)
                ids.append(doc_id)
                lengths.append(len(tokens))
                size += len(raw)
                for term, n in Counter(tokens).items():
                    if passes[crc32(term) % FILTER_BITS]:
                        known = lists.get(term)
                        if known is None:
                            known = lists[term] = ([], [])
                        known[0].append(place)
                        known[1].append(n)
                if len(ids) >= block or size >= BLOCK_BYTES:
                    yield from flush()
                    ids, lengths, lists, size = [], [], {}, 0
                    number += 1
        if ids:
            yield from flush()

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, POSTINGS)


def masks_of(bitmaps: np.ndarray) -> np.ndarray:
    """For each of the documents (columns of bits) the mask of the at most 64 terms (rows of bits) that it holds."""
    turned = np.packbits(bitmaps, axis=0, bitorder="little")
    wide = np.zeros((8, bitmaps.shape[1]), np.uint8)
    wide[: len(turned)] = turned
    return np.ascontiguousarray(wide.T).view("<u8").ravel()


class Blocks:
    """A few blocks of documents in memory: ids, and postings with scores, a bitmap and the greatest score of each term."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.nulls = ids, nulls
        self.spread = 12 * (100 - 25 + (25 * lengths * n_docs) // n_terms)
        self.places: dict[bytes, np.ndarray] = {}
        self.scores: dict[bytes, np.ndarray] = {}
        self.bitmaps: dict[bytes, np.ndarray] = {}

    def add(self, term: bytes, weight: int, places: np.ndarray, counts: np.ndarray) -> None:
        """``places`` ascend."""
        scores = weight * ((1_000_000_000 * counts) // (1000 * counts + self.spread[places]))
        self.places[term], self.scores[term] = places, scores
        bits = np.zeros(len(self.ids), np.uint8)
        bits[places[scores > 0]] = 1
        self.bitmaps[term] = np.packbits(bits, bitorder="little")

    def best(self, wanted: list[tuple[bytes, int]], k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents for the terms and their repeats; equal scores by ascending id, null ids last."""
        total = np.bitwise_or.reduce([self.bitmaps[t] for t, _ in wanted])
        held = np.flatnonzero(np.unpackbits(total, count=len(self.ids), bitorder="little"))
        if not len(held):
            return []
        limits, group = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        for at in range(0, len(wanted), MASK):
            some = wanted[at : at + MASK]
            bits = np.stack([np.unpackbits(self.bitmaps[t], count=len(self.ids), bitorder="little")[held] for t, _ in some])
            _, first, again = np.unique(masks_of(bits), return_index=True, return_inverse=True)
            limits += (np.array([r * self.scores[t].max() for t, r in some], np.int64) @ bits[:, first].astype(np.int64))[again]
            _, group = np.unique(group * len(first) + again, return_inverse=True)
        order = np.lexsort((group, -limits))
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))  # where the masks begin in this order
        found: list[tuple[int, bool, int, int]] = []
        begin, size = 0, BATCH
        while begin < len(order):
            at = np.searchsorted(starts, begin + size)
            end = int(starts[at]) if at < len(starts) else len(order)
            places = np.sort(held[order[begin:end]])
            scores = np.zeros(len(places), np.int64)
            for term, repeats in wanted:
                own = self.places[term]
                to = np.minimum(np.searchsorted(own, places), len(own) - 1)
                scores += np.where(own[to] == places, repeats * self.scores[term][to], 0)
            some = np.lexsort((self.ids[places], self.nulls[places], -scores))[:k]
            found += [(-int(scores[i]), bool(self.nulls[places[i]]), int(self.ids[places[i]]), int(places[i])) for i in some if scores[i] > 0]
            found = sorted(found)[:k]
            if end < len(order) and len(found) == k and -found[-1][0] > limits[order[end]]:
                break
            begin, size = end, 2 * size
        return [(-score, place) for score, _, _, place in found]


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """(item, item_id, rank, doc_id, score): for each row of ``items`` the ``k`` rows of ``docs`` with the highest scores above 0, ranked from 1.

    The score sums, over the item's terms with repeats, weight * ((10^9 * tf) div (1000 * tf + 12 * m)) in 64-bit integers, where weight is
    floor(1000 * ln((2N + 2) / (2 df + 1))) and m is 75 + (25 * n * N) div L of the document. Equal scores rank by ascending id, null ids last; rows equal in both in any
    order. Null texts have no terms; items without terms or hits give no rows. Repeated rows of either table count each for itself (``item`` tells items apart).
    Empty tables give no rows; other columns are left behind.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    wanted = written(item_terms(items, item_id_col, item_text_col), folder, "wanted")
    index = written(postings(docs, wanted, id_col, text_col, block), folder, "postings", compression="zstd")
    headers, lists = index.where("term is null"), index.where("term is not null")
    small = F.col("block_docs") < block // 2
    n_docs, n_terms, loose = headers.agg(F.sum("docs"), F.sum("terms"), F.sum(F.when(small, F.col("docs")))).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    groups = max(1, 2 * (loose or 0) // block)
    home = F.when(small, -1 - F.pmod(F.xxhash64("block"), F.lit(groups))).otherwise(F.col("block")).alias("home")
    chunks = max(1, wanted.count() // chunk_terms)
    chunk = F.pmod(F.xxhash64("item"), F.lit(chunks)).alias("chunk")
    users = wanted.groupBy(chunk, "term").agg(F.collect_list(F.struct("item", "item_id", "repeats")).alias("users"))
    held = lists.groupBy("term").agg(F.sum("docs").alias("held"))
    weight = F.floor(1000 * F.ln((2.0 * n_docs + 2) / (2.0 * F.col("held") + 1))).cast("long").alias("weight")
    meant = users.join(held, "term").select("chunk", "term", "users", weight).where("weight > 0")
    parts = lists.join(meant, "term").select(home, "chunk", "block", "term", "places", "counts", "weight", "users", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("nulls"))
    nothing = F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<struct<item: bigint, item_id: bigint, repeats: bigint>>").alias("users")
    heads = headers.select(home, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "block", "term", "places", "counts", *nothing, "ids", "nulls")
    out = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def evaluate(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["term"] is not None, r["term"]))
        offsets, at, columns = {}, 0, []
        for row in rows:
            if row["term"] is None:
                columns.append([np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["counts"], np.int64)])
                offsets[row["block"]] = at
                at += len(columns[-1][0])
        blocks = Blocks(*map(np.concatenate, zip(*columns)), n_docs, n_terms)
        by_term: dict[bytes, list[dict]] = {}
        for row in rows:
            if row["term"] is not None:
                by_term.setdefault(row["term"], []).append(row)
        by_item: dict[tuple, list] = {}
        for term, some in by_term.items():
            places = np.concatenate([np.frombuffer(r["places"], np.uint32).astype(np.int64) + offsets[r["block"]] for r in some])
            blocks.add(term, some[0]["weight"], places, np.concatenate([np.frombuffer(r["counts"], np.uint32).astype(np.int64) for r in some]))
            for user in some[0]["users"]:
                by_item.setdefault((user["item"], user["item_id"]), []).append((term, user["repeats"]))
        found = [(item, item_id, None if blocks.nulls[p] else int(blocks.ids[p]), score) for (item, item_id), own in by_item.items() for score, p in blocks.best(own, k)]
        return pa.Table.from_batches([record_batch(out, *(zip(*found) if found else ([], [], [], [])))])

    near = heads.unionByName(parts).groupBy("home", "chunk").applyInArrow(evaluate, "item long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "item_id", "rank", "doc_id", "score")
