"""Token ids in files of directly addressable codes.

An id is cut into chunks of ``CHUNK`` bits, low chunk first, as many as it needs. Level k holds the k-th chunk of every id that has
one, a bit for each that tells whether the id goes on, and a rank directory with the number of set bits before every ``STEP``-th
bit. The place of an id's next chunk is the rank of its bit, so any id is read with one look at each level, and a run of ids with
one slice of each level; nothing else is decoded.

A file is a Parquet file of blocks, each of whole documents in ascending order of ids; files of a folder follow one another by
``part``. Spark writes and reads them, so any store that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm.bpe import Vocabulary, byte_letters, in_small_batches
from wiretally.llm.common import keyed_texts, record_batch, texts_of

CHUNK = 8
STEP = 512  # bits for each entry of a rank directory
BLOCK_TOKENS = 1 << 16  # a block ends with the document that reaches so many

LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("ends", pa.binary()), ("levels", pa.list_(LEVEL))])
BLOCK_TYPE = "part int, block int, before long, n_tokens long, ids binary, nulls binary, ends binary, levels array<struct<chunks binary, more binary, ranks binary>>"


class LibraryVocabulary(Vocabulary):
    """The same cuts and caches, with new words merged by the library's own model."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model, self.letters = tokenizers.Tokenizer.from_file(path).model, byte_letters()

    def merge_word(self, raw: bytes) -> list[int]:
        letters = self.letters
        return [token.id for token in self.model.tokenize("".join([letters[b] for b in raw]))]


@lru_cache(maxsize=1)
def library_vocabulary(path: str) -> LibraryVocabulary:
    """One for all tasks of a worker, which thus find its bounded caches filled."""
    return LibraryVocabulary(path)


def encode_levels(tokens: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of unsigned 32-bit ids; ids of any size below 2**32."""
    levels, rest = [], tokens
    while len(rest) or not levels:
        high = rest >> CHUNK
        goes_on = high > 0
        more = np.packbits(goes_on, bitorder="little")
        filled = np.add.reduceat(goes_on, np.arange(0, len(rest), STEP), dtype=np.uint32) if len(rest) else np.empty(0, np.uint32)
        ranks = np.cumsum(filled, dtype=np.uint32) - filled
        levels.append({"chunks": (rest & ((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), "more": more.tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        rest = high[goes_on]
    return levels


class Block:
    """Random access to the ids of one block."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def _rank(self, level: int, at: int) -> int:
        """Set bits before bit ``at``."""
        chunks, more, ranks = self.levels[level]
        entry = min(at // STEP, len(ranks) - 1) if len(ranks) else -1
        if entry < 0:
            return 0
        bits = more[entry * STEP // 8 : -(-at // 8)]
        if not len(bits):
            return int(ranks[entry])
        return int(ranks[entry]) + int(np.bitwise_count(bits).sum()) - (int(bits[-1] >> (at % 8)).bit_count() if at % 8 else 0)

    def token(self, at: int) -> int:
        """The id at one place."""
        value = 0
        for level, (chunks, more, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (CHUNK * level)
            if not more[at // 8] >> (at % 8) & 1:
                break
            at = self._rank(level, at)
        return value

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to before ``end``."""
        out = np.zeros(end - begin, np.uint32)
        where = np.arange(end - begin)
        for level, (chunks, more, _) in enumerate(self.levels):
            out[where] |= chunks[begin:end].astype(np.uint32) << np.uint32(CHUNK * level)
            bits = np.unpackbits(more[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 : begin % 8 + end - begin].astype(bool)
            where = where[bits]
            if not len(where):
                break
            begin = self._rank(level, begin)
            end = begin + len(where)
        return out


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the ids below ``folder`` in ascending order of ids of rows.

    Null and empty texts have the end id alone. Null ids come first. Rows with equal ids are ordered by their text, and many of
    them are spread over files. Each task sorts and writes its own range; a lost task writes its file again.
    """
    texts = keyed_texts(docs, id_col, text_col).withColumn("salt", F.xxhash64("text"))
    ranged = texts.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt", "text").drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, part, number, before = library_vocabulary(path), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()

        def block(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(texts), "<u4")
            ends = np.cumsum([len(t) // 4 for t in texts], dtype=np.int64)
            numbers = np.array([i or 0 for i in ids], np.int64)
            nulls = np.array([i is None for i in ids])
            return record_batch(BLOCK, [part], [number], [before], [len(tokens)], [numbers.tobytes()], [nulls.tobytes()], [ends.tobytes()], [encode_levels(tokens)])

        ids, rows, size = [], [], 0
        for batch in batches:
            for doc_id, text in texts_of(batch):
                ids.append(doc_id)
                rows.append(vocabulary.encode(text) + end)
                size += len(rows[-1]) // 4
                if size >= BLOCK_TOKENS:
                    yield block(ids, rows)
                    ids, rows, before, size, number = [], [], before + size, 0, number + 1
        if ids:
            yield block(ids, rows)

    blocks = ranged.mapInArrow(run, BLOCK_TYPE)
    blocks.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(folder)


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of each document in the files: the number of ids before it, and its ids as little-endian 32 bits.

    A block knows how many ids of its part come before it; the parts' sums (one row for each file) are broadcast.
    """
    blocks = spark.read.parquet(folder)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    bases = parts.selectExpr("part", "sum(size) OVER (ORDER BY part) - size AS base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_small_batches((row for batch in batches for i in range(batch.num_rows) for row in documents({n: batch.column(n)[i].as_py() for n in batch.schema.names})), READ)

    def documents(row: dict) -> Iterator[tuple]:
        numbers, nulls, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["ends"], np.int64)
        start, begin = row["base"] + row["before"], 0
        tokens = Block(row["levels"]).tokens(0, row["n_tokens"]).astype("<u4").tobytes()
        for doc_id, null, end in zip(numbers.tolist(), nulls.tolist(), ends.tolist(), strict=True):
            yield None if null else doc_id, start + begin, tokens[4 * begin : 4 * end]
            begin = end

    return blocks.join(F.broadcast(bases), "part").mapInArrow(run, "doc_id long, start long, ids binary")
