"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words in lower case and their beginnings of ``STEMS`` characters, hashed to ``BUCKETS`` places; whether a
term occurs counts, not how often. The score is the logistic function of

    bias + sum of the terms' weights + sum over all pairs of terms of the dot product of their factors / (``WIDTH`` * distinct words),

so a pair of terms may weigh more than both alone, and the many harmless pairs of a long text do not drown the rest. The pair sum is computed from the factors'
sum and the sum of their squares. Every place that a learned text holds has a weight and factors; a proximal step sets those to zero that tell nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import held_out, keyed_texts, record_batch

BUCKETS = 1 << 20
STEMS = (4, 5, 6)
SAMPLE = 8_192  # labelled rows that a fit takes: those with the smallest hashes of their ids
FACTORS = 4
WIDTH = 4  # places that a word has, at most
STEPS = 320  # of a fit, whatever the number of rows
MIXED = 256  # rows in a step
RATE, SPARSE = 3.0, 40.0  # step size and threshold of the weights
PAIR_RATE, PAIR_SPARSE = 1.0, 0.005  # of the factors
CACHED = 300_000
WORD = re.compile(r"\w+")


def buckets(word: str) -> set[int]:
    """The places of a word and its beginnings; a beginning differs from a word of the same letters."""
    return {crc32(word.encode()) % BUCKETS, *(crc32(b"^" + word[:n].encode()) % BUCKETS for n in STEMS if len(word) >= n)}


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Machine:
    terms: np.ndarray  # the places with a weight or factor other than zero, in order
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, known: list[int], size: int | None = None) -> float:
        """``known`` are indexes into ``terms``, each once; ``size`` divides the pair sum, and is their number if not given."""
        factors = self.factors[known]
        pairs = 0.5 * ((factors.sum(axis=0) ** 2).sum() - (factors**2).sum()) / max(1, len(known) if size is None else size)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[known].sum() + pairs, -30, 30))))


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of at most ``rows`` ids to learn from: no held-out ids, null ids or null labels; the largest of several labels."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine for the labels of a sample of at most ``rows`` labelled documents, read as whole texts.

    The sample's ids are broadcast (bounded by ``rows``); texts are never shuffled. The distinct places of each text of the sample reach the driver, at most
    ``rows`` times. Without labelled rows the score is 0 everywhere, with one label alone it is that label. Of several labels of an id the largest counts;
    repeated rows of an id count each.
    """
    spark = docs.sparkSession
    sample = {row[0]: row[1] for row in sample_labels(labels, id_col, label_col, rows).collect()}
    none = Machine(np.empty(0, np.int64), -30.0, np.empty(0), np.empty((0, FACTORS)))
    if not sample:
        return none
    chosen = spark.createDataFrame(list(sample.items()), "doc_id long, label int")
    texts = keyed_texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "label")
    schema = pa.schema([("label", pa.int32()), ("size", pa.int32()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words(text) for text in batch.column(0).to_pylist()]
            places = [np.array(sorted(set().union(*map(buckets, some))), np.uint32).tobytes() for some in own]
            yield record_batch(schema, batch.column(1), [WIDTH * len(some) for some in own], places)

    learned = texts.mapInArrow(run, "label int, size int, places binary").collect()
    if not learned:
        return none
    learned.sort()
    labels_of = np.array([row[0] for row in learned], np.float64)
    if labels_of.min() == labels_of.max():
        return Machine(none.terms, 30.0 if labels_of[0] else -30.0, none.weights, none.factors)
    found = [np.frombuffer(row[2], np.uint32) for row in learned]
    terms, flat = np.unique(np.concatenate(found), return_inverse=True)
    ends = np.cumsum([len(x) for x in found])
    whole = train(terms, np.split(flat, ends[:-1]), labels_of, sizes=np.array([row[1] for row in learned]))
    kept = np.flatnonzero((whole.weights != 0) | (whole.factors != 0).any(axis=1))
    return Machine(terms[kept].astype(np.int64), whole.bias, whole.weights[kept], whole.factors[kept])


def train(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, sizes: np.ndarray | None = None, seed: int = 7) -> Machine:
    """Log loss over mixed batches of rows (indexes into ``terms``, each once): adaptive steps, each followed by a threshold that sets to zero."""
    random, n_terms = np.random.default_rng(seed), len(terms)
    lengths = np.array([len(r) for r in rows])
    starts, flat = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(rows).astype(np.int64)
    scale = 1 / np.maximum(1, lengths if sizes is None else sizes)
    mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    bias, bias_sum = np.log(mean / (1 - mean)), 1.0
    weights, pulled, weight_sums = np.zeros(n_terms), np.zeros(n_terms), np.zeros(n_terms)
    factors, factor_sums = random.normal(0, 0.01, (FACTORS, n_terms)), np.zeros((FACTORS, n_terms))
    order, at = random.permutation(len(rows)), 0
    for _ in range(STEPS):
        if at >= len(order):
            order, at = random.permutation(len(rows)), 0
        some = order[at : at + MIXED]
        at += MIXED
        known, row = np.concatenate([flat[starts[i] : starts[i + 1]] for i in some]), np.repeat(np.arange(len(some)), lengths[some])
        own = factors[:, known]
        sums = np.stack([np.bincount(row, f, len(some)) for f in own])
        pairs = 0.5 * scale[some] * ((sums**2).sum(axis=0) - np.bincount(row, (own**2).sum(axis=0), len(some)))
        raw = bias + np.bincount(row, weights[known], len(some)) + pairs
        slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]
        step = np.bincount(known, slope[row], n_terms)
        grown = weight_sums + step**2
        pulled += step - (np.sqrt(grown) - np.sqrt(weight_sums)) / RATE * weights
        weight_sums = grown
        weights = -np.sign(pulled) * np.maximum(np.abs(pulled) - SPARSE, 0) * RATE / (1 + np.sqrt(weight_sums))
        shared = (slope * scale[some])[row]
        for f in range(FACTORS):
            step = np.bincount(known, shared * (sums[f][row] - own[f]), n_terms)
            factor_sums[f] += step**2
            rate = PAIR_RATE / (1 + np.sqrt(factor_sums[f]))
            moved = factors[f] - rate * step
            factors[f] = np.sign(moved) * np.maximum(np.abs(moved) - rate * PAIR_SPARSE, 0)
        bias_sum += slope.sum() ** 2
        bias -= 0.1 * slope.sum() / np.sqrt(bias_sum)
    return Machine(terms, float(bias), weights, factors.T.copy())


def _finder(place: dict[int, int]):
    """A function from a text to the indexes of its known terms and the size that divides its pair sum; the words' terms are kept, up to ``CACHED`` of them."""
    cache: dict[str, tuple[int, ...]] = {}

    def find(text: str | None) -> tuple[list[int], int]:
        nonlocal cache
        own = words(text)
        if len(cache) > CACHED:
            cache = {}
        found = set()
        for word, places in zip(own, map(cache.get, own), strict=True):
            if places is None:
                places = cache[word] = tuple(place[b] for b in buckets(word) if b in place)
            if places:
                found.update(places)
        return sorted(found), WIDTH * len(own)

    return find


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row from its whole text alone; null and empty texts get the score of no terms.

    Every row gives one row, repeated ones too. The machine is broadcast: at most ``BUCKETS`` weights and factors, those that are not zero.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        find = _finder({int(t): i for i, t in enumerate(machine.terms)})
        for batch in batches:
            yield record_batch(schema, batch.column(0), [machine.score(*find(text)) for text in batch.column(1).to_pylist()])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
