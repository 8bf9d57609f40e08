"""Token counts of whole texts under a piece model, from the counts of their pre-tokens.

No piece of the model holds a space after another character, so a cut before each run of spaces never parts a piece, and the same
holds for a cut before a line end, which no piece holds. The count of a text is the sum of its pre-tokens' counts, whatever
they are, and two tiers supply these:

1. A compact table of the pre-tokens that are frequent in the corpus, encoded once and broadcast: at most ``TABLE_ROWS`` rows of
   at most ``LONGEST`` characters each. It comes from bounded summaries: each task keeps the pre-tokens it meets most
   (space saving by decrements) and reports at most ``SUMMARY`` of them. Pre-tokens of texts are never shuffled.
2. A cache in each worker for what the table misses, filled by the library.

The table only saves time; counts do not depend on it. The model is checked for the property above when it is loaded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import keyed_texts, record_batch, texts_of

TABLE_ROWS = 65_536
SUMMARY = 4_096
COUNTERS = 16_384
LONGEST = 64
CACHED = 250_000
MARK = "▁"  # the model's stand-in for a space
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or MARK in piece.lstrip(MARK):
            raise ValueError(f"a piece of {path} goes across a space or line end")
    if model.encode("a  b ", out_type=str)[0] != MARK + "a" or len(model.encode(" ")) != len(model.encode("  ")):
        raise ValueError(f"{path} adds no leading space, or drops spaces")
    return model


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text: with a space before it, cut before each run of spaces and each line end.

    A single leading space is left out, so that ``word`` stands for a space and the word.
    """
    if "  " in text or " \n" in text or text[:1] == " " or text[-1:] == " ":
        return [x[1:] if x[0] == " " else x for x in PRE_TOKEN.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def sizes(model: sentencepiece.SentencePieceProcessor, tokens: list[str]) -> list[int]:
    """Counts of pre-tokens. The library puts a space first; before a line end it stands alone as one token, which is taken off.

    The empty pre-token is a lone space, one token; the library gives none for an empty text.
    """
    return [len(ids) - (token[:1] == "\n") if token else 1 for token, ids in zip(tokens, model.encode(tokens, num_threads=1), strict=True)]


def frequent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, n) of the pre-tokens that tasks report as frequent, most frequent first, at most ``TABLE_ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for _, text in texts_of(batch):
                counts.update(pre_tokens(text))
                if len(counts) > 8 * COUNTERS:
                    least = sorted(counts.values(), reverse=True)[COUNTERS]
                    counts = Counter({token: n - least for token, n in counts.items() if n > least})
        top = [(token, n) for token, n in counts.most_common(SUMMARY) if len(token) <= LONGEST]
        yield record_batch(pa.schema([("token", pa.string()), ("n", pa.int64())]), [t for t, _ in top], [n for _, n in top])

    summaries = keyed_texts(docs, id_col, text_col).mapInArrow(run, "token string, n long")
    return summaries.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(TABLE_ROWS)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row: UTF-8 bytes, and tokens without begin or end tokens.

    Null and empty texts have none of either. Every row gives one row, repeated ones and null ids too; other columns are left
    behind. Texts that hold the model's stand-in for a space are encoded whole.
    """
    spark, model = docs.sparkSession, load(path)
    tokens = [row[0] for row in frequent(docs, id_col, text_col).select("token").collect()]
    shared = spark.sparkContext.broadcast((tokens, np.array(sizes(model, tokens), np.uint16)))  # a token for each of at most four bytes a character, and one
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        words, lengths = shared.value
        table = dict(zip(words, lengths.tolist(), strict=True))
        cache: dict[str, int] = {}

        def count(text: str) -> int:
            if MARK in text or not text:
                return len(model.encode(text))
            found = pre_tokens(text)
            counts = list(map(table.get, found))
            if None in counts:
                missed = [token for token, n in zip(found, counts, strict=True) if n is None]
                counts = [n for n in counts if n is not None]
                fresh = list({token for token in missed if token not in cache})
                if len(cache) > CACHED:
                    cache.clear()
                    fresh = list(set(missed))
                cache.update(zip(fresh, sizes(model, fresh), strict=True))
                counts.extend(map(cache.__getitem__, missed))
            return sum(counts)

        for batch in batches:
            ids, texts = zip(*texts_of(batch), strict=True) if batch.num_rows else ((), ())
            yield record_batch(schema, batch.column(0), [len(t.encode("utf-8", "replace")) for t in texts], [count(t) for t in texts])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
