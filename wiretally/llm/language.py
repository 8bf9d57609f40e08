"""Language identification by rank order of letter n-grams.

A profile is the list of a language's most frequent n-grams (one to three letters, word edges marked) in order of frequency. A text's
own list is compared with each profile: every n-gram adds how far out of place it is, or the full list length if the profile lacks
it. The language with the smallest sum is the answer.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretally.llm.common import held_out, keyed_texts, record_batch

TOP = 300  # n-grams in a profile, and at most as many of a text
EDGE = 1  # stands for a word edge; letters are larger
FLUSH = 500_000  # distinct n-grams that a task holds before it reports them
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text's words in lower case, as integers of 21 bits for each character; empty if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    code[~_letters()[code]] = EDGE
    code = np.concatenate([[EDGE], code, [EDGE]])
    code = code[np.append(True, (code[1:] != EDGE) | (code[:-1] != EDGE))]
    if len(code) < 3:
        return np.empty(0, np.int64)
    pairs = code[:-1] << 21 | code[1:]
    triples = (pairs[:-1] << 21 | code[2:])[code[1:-1] != EDGE]
    return np.concatenate([code[code != EDGE], pairs, triples])


def ranked(grams: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts in order of the n-gram."""
    values, counts = np.unique(grams, return_counts=True)
    if len(values) > TOP:
        least = -np.partition(-counts, TOP - 1)[TOP - 1]
        some = counts >= least
        values, counts = values[some], counts[some]
    return values[np.argsort(-counts, kind="stable")][:TOP]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank): the profile of every non-null ``lang``, from all rows that ``held_out`` does not hold out.

    Null texts and texts without letters add nothing. Counts are summed in each task before the shuffle.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def report() -> Iterator[pa.RecordBatch]:
            for lang, (grams, n) in counts.items():
                yield record_batch(schema, [lang] * len(grams), grams, n)
            counts.clear()

        for batch in batches:
            parts = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts[lang].append(text)
            for lang, texts in parts.items():
                while texts:
                    some, size = [], 0
                    while texts and size < 1 << 20:
                        some.append(texts.pop())
                        size += len(some[-1])
                    grams, n = np.unique(ngrams(" ".join(some)), return_counts=True)
                    if lang in counts:
                        old, had = counts[lang]
                        grams, place = np.unique(np.concatenate([old, grams]), return_inverse=True)
                        n = np.bincount(place, np.concatenate([had, n]), len(grams)).astype(np.int64)
                    counts[lang] = grams, n
                    if sum(len(g) for g, _ in counts.values()) > FLUSH:
                        yield from report()
        yield from report()

    counted = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = summed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)  # so written, tasks keep their own first ones alone
    return first.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def predictor(spark: SparkSession, profiles: DataFrame):
    """A function from a text column to (lang_pred, score). Profiles are broadcast: ``TOP`` rows for each language."""
    found = sorted(map(tuple, profiles.select("lang", "gram", "rank").collect()))
    langs = sorted({lang for lang, _, _ in found})
    grams = np.array(sorted({gram for _, gram, _ in found}), np.int64)
    ranks = np.full((len(grams), len(langs)), -1, np.int32)
    for lang, gram, rank in found:
        ranks[np.searchsorted(grams, gram), langs.index(lang)] = rank
    shared = spark.sparkContext.broadcast((langs, grams, ranks))

    def answer(text: str | None) -> tuple[str, float]:
        langs, grams, ranks = shared.value
        own = ranked(ngrams(text or ""))
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        place = ranks[at]
        known = (grams[at] == own)[:, None] & (place >= 0)
        apart = np.where(known, np.abs(place - np.arange(len(own))[:, None]), TOP).sum(axis=0)
        best = int(np.argmin(apart))
        return langs[best], float(1 - apart[best] / (TOP * len(own)))

    @F.pandas_udf("lang_pred string, score double")
    def answers(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([answer(text) for text in texts], columns=["lang_pred", "score"])

    return answers


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row from its whole text alone.

    The score is 1 less the sum of out-of-place distances as a share of the largest possible. Null texts, texts without a letter, and all
    texts if there are no profiles, are ``und`` with score 0; equal sums go to the first language in order of name. Every row gives one
    row; other columns are left behind.
    """
    answers = predictor(docs.sparkSession, profiles)
    return keyed_texts(docs, id_col, text_col).select("doc_id", answers(F.col("text")).alias("found")).select("doc_id", "found.*")
