"""More tests than a row can hold: texts are settled by the tests of the least hits, and meet the others only if none of those passes."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wiretally.operators import matching as M
from wiretally.operators import pieces as P
from wiretally.operators import textmatch as X
from wiretally.sources.folders import names


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(seed, number, longest, letters="abcdé€"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(number)]


def met(spark, texts, needles):
    log = spark.createDataFrame(list(enumerate(texts)), "log_id int, low string")
    return M.substring_first(log, "low", spark.createDataFrame(needles, "id long, needle string"), "hit")


def brute(texts, needles):
    return {i: None if t is None else min((n for n, w in needles if w in t), default=None) for i, t in enumerate(texts)}


def rows(found):
    return {r.log_id: r.hit for r in found.collect()}


def test_stretches_of_settled_texts_are_not_shuffled(spark, monkeypatch):
    """Each text holds hundreds of needles, one of the least ones too: rows stay where they are and nothing is cut out of the texts."""
    monkeypatch.setattr(X, "INDEX_BYTES", 40_000)
    needles = list(enumerate(words(5, 3000, 7)))
    texts = ["".join(words(i, 40, 9)) + needles[i % 20][1] for i in range(50)] + ["", None]
    found = met(spark, texts, needles)
    assert "Exchange" not in plan(found) and "Join" not in plan(found)
    assert rows(found) == brute(texts, needles)


@pytest.mark.parametrize("index_bytes, rows_among", [(300, 1 << 20), (4000, 40)])
@pytest.mark.parametrize("slice_of, worth", [(70, 8), (1 << 22, 8), (1 << 22, 0)])
def test_texts_meet_slices_until_they_have_a_hit(spark, monkeypatch, index_bytes, rows_among, slice_of, worth):
    """First tests, slices and the rest together give the least hit; many ids are alike, and texts repeat."""
    made, new = [], X.new_folder
    for name, value in (("INDEX_BYTES", index_bytes), ("FIRST", 20), ("FIRST_ROWS", rows_among), ("SLICE", slice_of), ("SEEN", 3), ("WORTH", worth)):
        monkeypatch.setattr(X, name, value)
    monkeypatch.setattr(X, "new_folder", lambda spark: made.append(new(spark)) or made[-1])
    needles = [(i // 3, w) for i, w in enumerate(words(9, 240, 9))] + [(70, "f" * 400)]
    texts = [None, "", "zz", "z" * 500, "f" * 399, "yf" + "f" * 400] + words(1, 40, 14) + [w[:-1] + "x" + w[1:] for _, w in needles[::9]]
    texts += texts[:25]
    assert rows(met(spark, texts, needles)) == brute(texts, needles)
    assert bool(made) == (slice_of == 70)
    assert all(name.startswith("hits") for folder in made for name in names(spark, folder))


@pytest.mark.parametrize("index_bytes", [200, 0])
def test_no_id_among_the_least_and_in_slices(spark, monkeypatch, index_bytes):
    for name, value in (("INDEX_BYTES", index_bytes), ("FIRST", 2), ("SLICE", 12)):
        monkeypatch.setattr(X, name, value)
    needles = [(None, "a"), (5, "a"), *((i, f"n{i}") for i in range(10, 40)), (None, "n39"), (3, "b")]
    assert rows(met(spark, ["a b", "b", "c", "n12", "n20 n31", "n39 n12"], needles)) == {0: None, 1: 3, 2: None, 3: 12, 4: 20, 5: None}
    only = [(None, f"m{i}") for i in range(20)]
    found = X.first_hit(spark.createDataFrame([(1, "m7"), (2, "m")], "k int, low string"), F.col("low"), X.substring_tests(spark.createDataFrame(only, "id long, needle string"), F.col("needle"), F.struct("id")), "hit")
    assert {r.k: r.hit is not None for r in found.collect()} == {1: True, 2: False}


@pytest.mark.parametrize("worth, slice_of", [(1 << 30, 1 << 22), (8, 15)])
def test_a_pattern_may_come_before_the_first_needle(spark, monkeypatch, worth, slice_of):
    """Hits of several fields; patterns and needles with ids among each other give the rows that the look in the row gives."""
    rng = random.Random(4)
    kinds = ["sql_pattern", "pattern", "domain"]
    values = {"pattern": lambda w: rng.choice([f"{w}+{w[0]}", f"^{w}", f"({w}|q{w})x?", "(", "[ab]b"])}
    table = [(i, kind, values.get(kind, str)(w), rng.choice(["low", "high"]), True) for i, w in enumerate(words(6, 120, 6, "abcd")) for kind in [rng.choice(kinds)]]
    indicators = spark.createDataFrame(table[10:] + [(7, "ip", "10.0.0.1", "low", True)], "id long, type string, value string, threat_level string, active boolean")
    log = spark.createDataFrame([(i, f"10.0.0.{i % 9}", "u", t) for i, t in enumerate([*words(2, 60, 30, "abcd e"), None, "", "e e"])], "log_id int, source_ip string, username string, query string")
    want = sorted(M.match_threats(log, indicators).collect(), key=str)
    for name, value in (("INDEX_BYTES", 2500), ("FIRST", 9), ("SLICE", slice_of), ("WORTH", worth)):
        monkeypatch.setattr(X, name, value)
    assert sorted(M.match_threats(log, indicators).collect(), key=str) == want


def test_marks_at_hand_equal_those_of_a_table(spark):
    needles = [w.encode() for w in set(words(8, 500, 40))]
    table = spark.createDataFrame([(bytearray(w), False) for w in needles], "piece binary, look boolean")
    at_hand, made = P.marks_of(pa.array(needles, pa.binary())), P.piece_marks(table)
    assert at_hand.sizes == made.sizes and len(at_hand.table) < len(made.table)
    data, ends = P.text_bytes(pa.array(needles + [w + b"!" for w in needles]))
    for marks in (at_hand, made):
        whole = {(row, size) for rows_, begins, sizes in marks.places(data, ends) for row, begin, size in zip(rows_, begins, sizes, strict=True) if begin == (ends[row - 1] if row else 0)}
        assert whole >= {(i + n * len(needles), len(w)) for i, w in enumerate(needles) for n in (0, 1)}


@pytest.mark.parametrize("texts, looks", [(["a" * 30] * 3 + ["n700 "], True), (["a"] + ["n700 " * 9] * 9, False)])
def test_first_tests_are_looked_at_where_they_settle_much(spark, monkeypatch, texts, looks):
    for name, value in (("INDEX_BYTES", 3000), ("FIRST", 9)):
        monkeypatch.setattr(X, name, value)
    needles = [(i, w) for i, w in enumerate(["a", *(f"n{k:03d}" for k in range(1, 900))])]
    found = met(spark, texts, needles)
    assert ("piece_hit" in plan(found)) == looks
    assert rows(found) == brute(texts, needles)
