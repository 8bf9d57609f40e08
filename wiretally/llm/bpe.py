"""Byte-level BPE with word ends: texts to token ids and back, as the ``tokenizers`` library does with the same JSON file.

Each task loads the vocabulary from its path. A text is normalised, cut at white space, and each piece looked up in a bounded
cache of the worker; a piece not yet seen is cut by the file's own pattern into words, and each new word is merged.

A word's merges run on contiguous arrays: part ids, and beside them the rank of each adjacent pair. The least rank is found by a
scan, its boundary deleted, and the two neighbouring ranks looked up again. Words of more than ``LONG`` parts, where scans would
be quadratic, take the same merges in the same order from a heap.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from wiretally.llm.common import keyed_texts, record_batch, texts_of

LONG = 200
CACHED = 500_000  # pieces in each of two generations that a worker keeps
CACHED_WORDS = 300_000  # words, likewise
CACHED_BYTES = 96 << 20  # of a generation of pieces, however long they are; ordinary ones reach their number first
CACHED_WORD_BYTES = 48 << 20  # of a generation of words, likewise
ENTRY = 48  # bytes for an entry's place in a dictionary, about
OUT_BYTES = 8 << 20
NONE = 1 << 40

# The white space of Unicode, inside a bracket; the printable stand-ins of the 256 bytes follow from it by rule.
SPACE = r"\t-\r \x85\xa0  -     　"


#: Inside a bracket: characters that all versions of Unicode treat alike, and that no normal form reorders. ASCII and Latin-1, Latin Extended-A, Greek and Cyrillic letters,
#: punctuation, kana without sound marks, Han and Hangul syllables as of Unicode 1.1 to 3.0.
SURE = "\x00-\xff\u0100-\u017f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u2010-\u2027\u2030-\u203a\u3001-\u3003\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Encoder and decoder of one JSON file; one per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError(f"{path} is not a lower-casing byte-level BPE file without a decoder")
        ids = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = [ids[a + b] for a, b in pairs]
        self.ranks = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        end = spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner, self.final = [ids[x] for x in letters], [ids[x + end] for x in letters]
        self.tokens = {number: token for token, number in (ids | special).items()}
        self.special = special
        self.cut = re.compile("|".join(f"({re.escape(x)})" for x in sorted(special, key=len, reverse=True))) if special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE))
        self.spaces = re.compile(f"[{SPACE}]+")
        self.unsure = re.compile(f"[^{SURE}]")
        self.path, self.library = path, None
        self.pieces, self.old_pieces, self.piece_bytes = {}, {}, 0
        self.seen, self.old_seen, self.seen_bytes = {}, {}, 0

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit integers."""
        if self.cut and "<" in text and self.cut.search(text):
            out = []
            for part in self.cut.split(text):
                if part:
                    out.append(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part))
            return b"".join(out)
        return self._plain(text)

    def _by_library(self, text: str) -> bytes:
        """Text with characters on which Unicode versions differ: normalised and cut by the library with the file's own steps, merged here."""
        if self.library is None:
            self.library = tokenizers.Tokenizer.from_file(self.path)
            self.byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join([array("I", self.merge_word(bytes(map(self.byte_of.__getitem__, word)))).tobytes() for word, _ in words])

    def _plain(self, text: str) -> bytes:
        if text.isascii() or is_latin(text):  # no two characters of Latin-1 compose
            text = text.lower()
        elif self.unsure.search(text):
            return self._by_library(text)
        else:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        pieces = [x for x in self.spaces.split(text) if x] if odd else text.split()
        found = list(map(self.pieces.get, pieces))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    found[i] = self._piece(pieces[i])
        return b"".join(found)

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that the younger cache lacks; what the older one holds moves over."""
        ids = self.pieces.get(piece) or self.old_pieces.get(piece)
        if ids is None:
            words = (piece,) if piece.isalpha() else self.words.findall(piece)
            ids = b"".join([self.seen.get(word) or self._word(word) for word in words])
        if len(piece) <= LONG:
            if len(self.pieces) >= CACHED or self.piece_bytes >= CACHED_BYTES:
                self.pieces, self.old_pieces, self.piece_bytes = {}, self.pieces, 0
            self.pieces[piece] = ids
            self.piece_bytes += getsizeof(piece) + getsizeof(ids) + ENTRY
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.old_seen.get(word)
        if ids is None:
            ids = array("I", self.merge_word(word.encode())).tobytes()
        if len(word) <= LONG:
            if len(self.seen) >= CACHED_WORDS or self.seen_bytes >= CACHED_WORD_BYTES:
                self.seen, self.old_seen, self.seen_bytes = {}, self.seen, 0
            self.seen[word] = ids
            self.seen_bytes += getsizeof(word) + getsizeof(ids) + ENTRY
        return ids

    def merge_word(self, raw: bytes) -> list[int]:
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        return self.merge(parts) if len(parts) <= LONG else self.merge_long(parts)

    def merge(self, ids: list[int]) -> list[int]:
        look, merged = self.ranks.get, self.merged
        ranks = [look(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            ids[at] = joined = merged[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = look(joined << 20 | ids[at + 1], NONE)
            if at:
                ranks[at - 1] = look(ids[at - 1] << 20 | joined, NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        look = self.ranks.get
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank, at) for at in range(len(ids) - 1) if (rank := look(ids[at] << 20 | ids[at + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            other = after[at]
            if ids[at] < 0 or other >= len(ids) or look(ids[at] << 20 | ids[other]) != rank:
                continue
            ids[at], ids[other] = self.merged[rank], -1
            after[at] = after[other]
            if after[at] < len(ids):
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < len(ids) and (fresh := look(ids[left] << 20 | ids[after[left]])) is not None:
                    heapq.heappush(heap, (fresh, left))
        return [x for x in ids if x >= 0]

    def decode(self, ids: bytes) -> str:
        """Known tokens joined by spaces: what the library gives for a file without a decoder."""
        return " ".join([self.tokens[i] for i in array("I", ids) if i in self.tokens])


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def in_small_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``OUT_BYTES``; the second field and those after it that have a length count."""
    columns, size = tuple([] for _ in schema), 0
    for row in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
            if isinstance(value, bytes | str):
                size += len(value)
        if size >= OUT_BYTES or len(columns[0]) >= 10_000:
            yield record_batch(schema, *columns)
            columns, size = tuple([] for _ in schema), 0
    if columns[0]:
        yield record_batch(schema, *columns)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row: the tokens of the whole text as little-endian 32-bit integers, without added tokens.

    Null and empty texts have no tokens. Every row gives one row, repeated ones and null ids too; ids of rows are not read, other
    columns are left behind. Memory holds one text and the bounded caches. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        yield from in_small_batches(((doc_id, vocabulary.encode(text)) for batch in batches for doc_id, text in texts_of(batch)), ENCODED)

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows with tokens: the tokens' strings joined by spaces; ids that the file lacks give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        rows = ((doc_id, ids, vocabulary.decode(ids)) for b in batches for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from in_small_batches(rows, DECODED)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass of each text through Python, with the same results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        rows = ((doc_id, ids := vocabulary.encode(text), vocabulary.decode(ids)) for batch in batches for doc_id, text in texts_of(batch))
        yield from in_small_batches(rows, DECODED)

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")
