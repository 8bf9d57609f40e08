"""Spelling variants: words one edit apart, found in a bidirectional FM-index of the delimited vocabulary.

Two words one edit apart agree in the first half of either or in its second half. So one search matches a word's first half exactly and
extends to the right over the second, allowing one error there; the other matches the second half and extends to the left. Both keep the
interval of suffix ranks of the matched string in the text and in the reversed text, and extend either way; a match from delimiter to delimiter has
the rank of its word among all words.

Words have at least six characters, so halves have at least three: the first search meets only words with the same three first characters, the second only
those with the same three last ones. Each such side is cut by these characters into homes of some ``HOME`` words with an index each. A prefix that
more words share is cut into parts, and every part of its words is searched in every other part's index, so no task holds more than two parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import keyed_texts, record_batch, work_folder, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_TIMES = 5  # a form occurs at least so many times as often
HOME = 40_000
HELD = 500_000  # words whose counts a task holds before it hands them on
QUERIES = 4_096  # words searched at a time
WORD_BYTES = 8 << 20  # of words searched at a time, with padding

#: Latin-1 bytes of letters, A-Z in lower case; all others become spaces.
LETTERS = bytes(b if b >= 0xC0 or chr(b).isascii() and chr(b).isalpha() else 32 for b in range(256)).lower()


def spoilt(word: bytes, start: int) -> bytes:
    """The word (Latin-1) after the noise of its document, whose id and colon have the checksum ``start``."""
    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts. Null texts have none; a null id counts as the empty text before the colon."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return record_batch(schema, [w.decode("latin-1") for w in counts], list(counts.values()))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [w for w in (text or "").encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= least_length]
                if not found:
                    continue
                start = crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(found).items():
                    word = spoilt(word, start)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > HELD:
                    yield flush()
                    counts.clear()
        yield flush()

    counted = keyed_texts(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Ranks:
    """How often each symbol, and how often any smaller one, stands before a place of a sequence: bits of 64 places with a count before each."""

    def __init__(self, symbols: np.ndarray, size: int):
        words = len(symbols) // 64 + 1
        padded = np.full(words * 64, 255, np.uint8)
        padded[: len(symbols)] = symbols

        def table(test) -> tuple[np.ndarray, np.ndarray]:
            bits = np.stack([np.packbits(test(c), bitorder="little").view("<u8") for c in range(size)])
            ones = np.bitwise_count(bits).astype(np.int32)
            return bits.ravel(), (np.cumsum(ones, axis=1, dtype=np.int32) - ones).ravel()

        self.words = words
        self.own, self.own_before = table(lambda c: padded == c)
        self.less, self.less_before = table(lambda c: padded < c)

    def _count(self, bits: np.ndarray, before: np.ndarray, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = symbol * self.words + (place >> 6)
        return before[at] + np.bitwise_count(bits[at] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))

    def equal(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._count(self.own, self.own_before, symbol, place)

    def smaller(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._count(self.less, self.less_before, symbol, place)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a text in sorted order, by doubling the length that is compared; the last symbol must be the only 0."""
    n, length = len(text), 8
    key = np.zeros(n, np.int64)
    for i in range(length):  # symbols are below 128
        key = key * 128
        key[: n - i] += text[i:]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1
        key, length = rank * (n + 1) + after, 2 * length


DELIMITER = 1


class Index:
    """A bidirectional FM-index of distinct words; a state is (low, low in the reversed text, size), arrays of one length.

    Symbols are 1 for the delimiter and 2 and more for the letters in code-point order. The words are numbered in sorted order.
    """

    def __init__(self, words: list[bytes]):
        self.words = sorted(set(words))
        joined = np.frombuffer(b" " + b" ".join(self.words) + b" ", np.uint8)
        letters = np.unique(joined)
        self.codes = np.zeros(256, np.int64)
        self.codes[letters] = np.arange(len(letters)) + DELIMITER  # the space is the smallest
        self.size = len(letters) + 1
        text = self.codes[joined]
        self.starts = np.concatenate([[0, 1], 1 + np.cumsum(np.bincount(text, minlength=self.size)[1:])])
        self.right = self._ranks(text[::-1])
        self.left = self._ranks(text)

    def _ranks(self, text: np.ndarray) -> Ranks:
        ended = np.append(text, 0)
        return Ranks(ended[suffix_order(ended) - 1].astype(np.uint8), self.size)

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The state of a delimiter, n times."""
        low = np.full(n, self.starts[DELIMITER], np.int64)
        return low, low.copy(), np.full(n, len(self.words) + 1, np.int64)

    def extend(self, state: tuple, symbol: np.ndarray, rightwards: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states with a symbol more at the right or left end; size 0 where it does not occur there."""
        ranks = self.right if rightwards else self.left
        here, there, size = (state[1], state[0], state[2]) if rightwards else state
        before = ranks.equal(symbol, here)
        grown = self.starts[symbol] + before
        mirrored = there + ranks.smaller(symbol, here + size) - ranks.smaller(symbol, here)
        count = ranks.equal(symbol, here + size) - before
        return (mirrored, grown, count) if rightwards else (grown, mirrored, count)

    def near(self, words: list[bytes], rightwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, number of a word) one edit apart, with the first half of the former exact if ``rightwards``, else the second.

        The words searched for need not be in the index. A pair may come more than once.
        """
        n = len(words)
        lengths = np.array([len(w) for w in words])
        symbols = np.zeros((n, lengths.max(initial=0) + 1), np.int64)
        for i, word in enumerate(words):
            own = self.codes[np.frombuffer(word if rightwards else word[::-1], np.uint8)]
            symbols[i, : len(own)] = own
        symbols[symbols == 0] = self.size  # unknown letters, and what follows the end, match nothing
        half = lengths // 2 if rightwards else lengths - lengths // 2
        letters = np.arange(DELIMITER + 1, self.size)
        exact, who = self.start(n), np.arange(n)
        nobody = np.empty(0, np.int64)
        wrong, whose = (nobody, nobody, nobody), nobody
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def stepped(state: tuple, whose: np.ndarray, at: int) -> tuple[tuple, np.ndarray]:
            """States whose next symbol is that of their word, without those that end or match nothing."""
            go = np.flatnonzero((lengths[whose] > at) & (symbols[whose, at] < self.size))
            after = self.extend(tuple(x[go] for x in state), symbols[whose[go], at], rightwards)
            alive = np.flatnonzero(after[2])
            return tuple(x[alive] for x in after), whose[go][alive]

        for at in range(lengths.max(initial=0) + 1):
            inside = np.flatnonzero((half[who] <= at) & (lengths[who] >= at))
            base, owner = tuple(x[inside] for x in exact), who[inside]
            many = tuple(np.repeat(x, len(letters)) for x in base)
            tried, owners = np.tile(letters, len(owner)), np.repeat(owner, len(letters))
            fresh = self.extend(many, tried, rightwards)
            alive = np.flatnonzero(fresh[2])
            fresh, owners, tried = tuple(x[alive] for x in fresh), owners[alive], tried[alive]
            # A letter too many in the index: the word's place stays.
            wrong, whose = tuple(np.concatenate(x) for x in zip(wrong, fresh)), np.concatenate([whose, owners])
            done = np.flatnonzero(lengths[whose] == at)
            ended = self.extend(tuple(x[done] for x in wrong), np.full(len(done), DELIMITER), rightwards)
            whole = np.flatnonzero(ended[2])
            found.append((whose[done][whole], ended[0][whole] - self.starts[DELIMITER] - 1))
            wrong, whose = stepped(wrong, whose, at)
            # Another letter in its place, and none.
            other = np.flatnonzero((lengths[owners] > at) & (tried != symbols[owners, at]))
            skipped = np.flatnonzero(lengths[owner] > at)
            wrong = tuple(np.concatenate([x, y[other], z[skipped]]) for x, y, z in zip(wrong, fresh, base))
            whose = np.concatenate([whose, owners[other], owner[skipped]])
            exact, who = stepped(exact, who, at)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _batches(words: list[bytes]) -> Iterator[list[int]]:
    """Places of words of like lengths, as many at a time as ``QUERIES`` and ``WORD_BYTES`` allow."""
    order, some = sorted(range(len(words)), key=lambda i: len(words[i])), []
    for i in order:
        if some and (len(some) >= QUERIES or (len(some) + 1) * len(words[i]) * 8 > WORD_BYTES):
            yield some
            some = []
        some.append(i)
    if some:
        yield some


NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def neighbours(words: DataFrame, home: int = HOME) -> DataFrame:
    """(word, n, n_near, form_n, form) of each row of ``words`` (word, n), words distinct and of at least six letters of Latin-1.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them (the smallest of equals), ``form_n`` how often it occurs.
    """
    total = words.count()
    homes = max(1, total // home)
    letters = F.explode(F.array(F.struct(F.lit(True).alias("first"), F.substring("word", 1, 3).alias("key")), F.struct(F.lit(False).alias("first"), F.substring("word", -3, 3).alias("key")))).alias("side")
    sided = words.select("word", "n", letters).select("word", "n", "side.first", "side.key")
    large = sided.groupBy("first", "key").agg(F.ceil(F.count("*") / home).cast("int").alias("parts")).where("parts > 1")
    sided = sided.join(large, ["first", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sided = sided.withColumn("home", F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(homes)).cast("string")))
    own, every = F.pmod(F.hash("word"), F.col("parts")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    held = sided.select("first", "home", own.alias("i"), every.alias("j"), F.lit(True).alias("held"), "word", "n")
    asked = sided.select("first", "home", every.alias("i"), own.alias("j"), F.lit(False).alias("held"), "word", "n")

    def search(table: pa.Table) -> pa.Table:
        rightwards = table.column("first")[0].as_py()
        held = table.column("held").to_numpy()
        words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        counts = table.column("n").to_numpy()
        asked, counts_of = [(w, n) for w, h, n in zip(words, held, counts, strict=True) if not h], {w: n for w, h, n in zip(words, held, counts, strict=True) if h}
        out = pa.Table.from_batches([], NEAR)
        if not counts_of or not asked:
            return out
        index = Index(list(counts_of))
        n_of = np.array([counts_of[w] for w in index.words])
        results = []
        for some in _batches([w for w, _ in asked]):
            queries = [asked[i][0] for i in some]
            who, other = index.near(queries, rightwards)
            who, other = np.divmod(np.unique(who * len(n_of) + other), len(n_of))
            if not rightwards:  # the first search finds those with the first half exact
                keep = np.array([not index.words[t].startswith(queries[q][: len(queries[q]) // 2]) for q, t in zip(who, other, strict=True)], bool)
                who, other = who[keep], other[keep]
            order = np.lexsort((other, -n_of[other], who))
            who, other = who[order], other[order]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            n_near = np.diff(np.append(first, len(who)))
            results.append(record_batch(
                NEAR, [queries[q].decode("latin-1") for q in who[first]], [int(asked[some[q]][1]) for q in who[first]], n_near,
                n_of[other[first]], [index.words[t].decode("latin-1") for t in other[first]],
            ))
        return pa.Table.from_batches(results, NEAR)

    pairs = held.unionByName(asked).groupBy("first", "home", "i", "j").applyInArrow(search, "word string, n long, n_near long, form_n long, form string")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    merged = pairs.unionByName(none).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", home: int = HOME) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the texts of ``docs``.

    Words are the runs of letters of Latin-1 (A-Z lower-cased) of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences, after the noise of ``spoilt``. ``form`` is the most
    frequent word one edit away (ties: the smallest), if that occurs at least ``FORM_TIMES`` times as often as the word; ``root`` is where the forms lead to, the word itself if it
    has none. Forms are ever more frequent, so no path is a circle, and paths halve in each round. Null and empty texts have no words; repeated rows count each; other
    columns are left behind; no rows in, no rows out.
    """
    folder = work_folder(docs.sparkSession)
    words = written(vocabulary(docs, id_col, text_col), folder, "words")
    formed = F.col("form_n") >= FORM_TIMES * F.col("n")
    near = neighbours(words, home).select("word", "n", "n_near", F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"))
    near = written(near, folder, "near")
    paths, level = near.where("form is not null").select("word", F.col("form").alias("root")), 0
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        paths = written(paths.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder, f"paths{level}")
        if not paths.where("moved").limit(1).count():
            break
        paths, level = paths.drop("moved"), level + 1
    return near.join(paths.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
