"""Texts met by more tests than a row can hold: the join on pieces."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wiretally.operators import matching as M
from wiretally.operators import pieces as P
from wiretally.operators import textmatch as X
from wiretally.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joined(monkeypatch):
    monkeypatch.setattr(X, "INDEX_BYTES", 0)


def test_needles_of_all_lengths(spark, joined):
    """Short, long and very long needles, some with a common begin, some beyond what the join is on, in ASCII and not."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abé€𝒳 ") for _ in range(n))
    stem = word(400)
    needles = [word(n) for n in (1, 2, 3, 4, 5, 8, 9, 13, 30, 64, 100, 255, 256, 257, 300, 900)] + [stem[:300] + "x", stem[:300] + "y", stem, "never"]
    rng.shuffle(needles)
    needles = [*enumerate(needles), (len(needles), "a" * 40)]
    texts = [None, "", "a" * 39, "a" * 41]
    for _, needle in needles:
        texts += [word(20) + needle + word(20), needle, needle[:-1], needle[1:]]
    texts += texts[:20]
    log = spark.createDataFrame(list(enumerate(texts)), "log_id int, low string")
    got = {r.log_id: r.hit for r in M.substring_first(log, "low", spark.createDataFrame(needles, "id long, needle string"), "hit").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == (None if text is None else min((n for n, w in needles if w in text), default=None)), text


def test_least_of_ids_with_nulls(spark, joined):
    """A null id is the least one, on texts and among equal needles, as it is in the row."""
    log = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "c")], "log_id int, low string")
    needles = spark.createDataFrame([(5, "a"), (None, "a"), (3, "b"), (4, "b")], "id long, needle string")
    assert {r.log_id: r.hit for r in M.substring_first(log, "low", needles, "hit").collect()} == {1: None, 2: 3, 3: None}


def test_a_long_text_does_not_travel_with_its_grams(spark, joined):
    rng = random.Random(2)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(150_000))
    log = spark.createDataFrame([(1, text + "end"), (2, "x")], "log_id int, low string")
    needles = spark.createDataFrame([(7, "end"), (8, text[500:508]), (9, "x")], "id long, needle string")
    found = M.substring_first(log, "low", needles, "hit")
    assert {r.log_id: r.hit for r in found.collect()} == {1: 7, 2: 9}
    assert "hashpartitioning(gram" not in plan(found)


def test_places_of_texts_cut_anywhere(monkeypatch):
    """However many places are taken at a time, stretches are those of whole texts and none crosses from one text to the next."""
    texts = ["", "abcabcabcd", "x", "", "bcdabca", "abcab", "cd"]
    table = np.full(1 << (P.BITS - 3), 255, np.uint8)  # lets everything pass
    for places in (1, 3, 1 << 18):
        monkeypatch.setattr(P, "PLACES", places)
        data, ends = P.text_bytes(pa.array(texts))
        found = []
        for rows, begins, sizes in P.Marks(table, (1, 4, 6), False).places(data, ends):
            found += zip(rows.tolist(), P.stretches(data, begins, sizes).to_pylist())
        assert sorted(found) == sorted((i, t[a : a + n].encode()) for i, t in enumerate(texts) for n in (1, 4, 6) for a in range(len(t) - n + 1))


@pytest.mark.parametrize("name", ["threat_matches", "threat_match_counts", "threat_match_levels", "screened_log"])
def test_more_indicators_than_a_row_holds(spark, monkeypatch, name):
    """Grams of the log's texts are not shuffled, and the rows are those of the look in the row."""
    rows = sorted(catalog.QUERIES[name](spark, SF).collect(), key=str)
    monkeypatch.setattr(X, "INDEX_BYTES", 0)
    met = catalog.QUERIES[name](spark, SF)
    assert "hashpartitioning(gram" not in plan(met)
    assert sorted(met.collect(), key=str) == rows


def test_stream_of_more_indicators_than_a_row_holds(spark, monkeypatch):
    rows = sorted(catalog.QUERIES["screened_log"](spark, SF).collect())
    monkeypatch.setattr(X, "INDEX_BYTES", 0)
    assert sorted(catalog.QUERIES["screened_stream"](spark, SF).collect()) == rows


def test_words_are_summed_up_without_a_sort(spark, joined):
    assert "SortAggregate" not in plan(catalog.QUERIES["url_threats"](spark, SF))


@pytest.mark.parametrize("spare, looks_in_row", [(0, True), (-1, False)])
def test_sizes_are_summed_no_further_than_needed(spark, monkeypatch, spare, looks_in_row):
    needles = spark.createDataFrame([(i, f"n{i % 10}") for i in range(500)], "id long, needle string")
    tests = X.substring_tests(needles, F.col("needle"), F.struct("id"))
    monkeypatch.setattr(X, "INDEX_BYTES", tests.sizes.agg(F.sum("bytes")).first()[0] + spare)
    found = X.first_hit(spark.createDataFrame([("n3",)], "low string"), F.col("low"), tests, "hit")
    assert ("piece" not in plan(found)) == looks_in_row
    assert found.first().hit.id == 3
