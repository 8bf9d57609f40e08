"""First of many substrings and regular expressions that a text holds.

Tests are rows (kind, needle, regex, hit): a text of their kind passes if it contains the needle and, where there is one, matches the regex. The needle of a
regex is a literal that each of its matches must contain. Every needle is anchored on the one of its 4-grams that is rarest among all needles. A text looks up
its own 4-grams among the anchors; only tests found so are tried. Of those passed, the least hit (a struct that begins with an id) is the answer.

Anchors of up to ``INDEX_BYTES`` are one value, an array of hash buckets, which each row looks into: no shuffle, no join, and streams take it as tables do.
Of more tests, those of the least hits (``FIRST``, in as many bytes) are one list that every row looks into: a text that passes one of them has its least hit, as
all other tests have greater ones. Texts that pass none meet the others, slice after slice by ascending hits, until they pass one: stretches of them that a bit table
of fixed size lets pass (``pieces``) are joined with whole needles; no text travels with them. All ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.operators.pieces import marks_of, piece_marks, stretches, text_bytes
from wiretally.sources.folders import new_folder, remove

try:  # the parser of the standard library, by its place in this Python
    from re import _constants as ops
    from re import _parser as parser
except ImportError:
    import sre_constants as ops
    import sre_parse as parser

GRAM = 4
INDEX_BYTES = 16 << 20
BUCKETS = 1 << 13
TEST_BYTES = 64  # that a test takes beside its text and hit
WHOLE = 256  # characters of a needle that its join is on
KEY_BYTES = 16  # of a text's SHA-256
FIRST = 1 << 16  # tests of the least hits that a row looks into, at most
FIRST_ROWS = 1 << 20  # rows of tests, repeated ones too, among which these are looked for
HALVED = 40  # times that the rows of tests may be halved to come down to those
WORTH = 8  # of all texts' bytes, the part that the first tests must settle for rows to look into them, where one join does without
SLICE = 1 << 22  # tests that meet texts at once; of them the bit table is filled to about a quarter
SEEN = 1 << 18  # keys of texts that a task keeps, so repeated texts give their stretches once
CHOICES = 16  # literals of which a regex needs one, at most; beyond it, it is tried on every text


def java_regex(pattern: Column) -> Column:
    """RE2-style patterns for Java: ``$`` only at the very end, ``.`` stops at newlines only."""
    return F.concat(F.lit("(?d)"), F.regexp_replace(pattern, r"(?<!\\)\$", r"\\z"))


def compiles(regex: Column) -> Column:
    """Whether Java takes the regex; false for null."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), regex).isNotNull()


def _needed(tree) -> list[str]:
    """Literals of which every match of a parsed regex holds one; none if that can't be told."""
    best: list[str] = []

    def offer(choices: list[str]) -> None:
        nonlocal best
        if choices and all(choices) and len(choices) <= CHOICES and (not best or min(map(len, choices)) > min(map(len, best))):
            best = choices

    run = ""
    for op, value in tree:
        if op is ops.LITERAL:
            run += chr(value)
            continue
        offer([run])
        run = ""
        if op is ops.SUBPATTERN:
            offer(_needed(value[-1]))
        elif op is ops.BRANCH:
            each = [_needed(branch) for branch in value[1]]
            offer([x for some in each for x in some] if all(each) else [])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] >= 1:
            offer(_needed(value[2]))
    offer([run])
    return best


def needed_literals(pattern: str | None) -> list[str]:
    """Literals of which every match holds one, or the empty one. Patterns that this parser reads otherwise than Java does are not read."""
    if pattern is None or re.search(r"\\[QEpPhHRXkGNcexu0]|&&|\(\?\w*x|\[[^\]]*\[", pattern):
        return [""]
    try:
        return sorted(set(_needed(parser.parse(pattern)))) or [""]
    except (re.error, OverflowError, RecursionError):
        return [""]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(needed_literals)


@dataclass(frozen=True)
class Tests:
    """``rows`` (kind, needle, regex, hit) and, a row for each that they were made from, ``sizes`` (bytes, the most that its tests take)."""

    rows: DataFrame
    sizes: DataFrame

    def __add__(self, other: Tests) -> Tests:
        return Tests(self.rows.unionByName(other.rows), self.sizes.unionByName(other.sizes))


def _size(text: Column, hit: Column, copies: int) -> Column:
    return (copies * (2 * F.octet_length(text) + F.octet_length(F.to_json(hit)) + TEST_BYTES)).cast("long").alias("bytes")


def substring_tests(needles: DataFrame, needle: Column, hit: Column, kind: Column | None = None) -> Tests:
    kind = F.lit("") if kind is None else kind
    rows = needles.select(kind.alias("kind"), needle.alias("needle"), F.lit(None).cast("string").alias("regex"), hit.alias("hit")).where(F.length("needle") > 0)
    return Tests(rows, needles.select(_size(needle, hit, 1)))


def regex_tests(patterns: DataFrame, pattern: Column, hit: Column, kind: Column | None = None, flags: str = "") -> Tests:
    """Tests for texts in lower case. Null patterns and those that Java does not take give none."""
    regex, kind = F.concat(F.lit(flags), java_regex(pattern)), F.lit("") if kind is None else kind
    valid = patterns.select(kind.alias("kind"), pattern.alias("pattern"), regex.alias("regex"), hit.alias("hit")).where(F.col("pattern").isNotNull() & compiles(F.col("regex")))
    rows = valid.select("kind", F.explode(F.transform(_literals("pattern"), F.lower)).alias("needle"), "regex", "hit")
    return Tests(rows, patterns.select(_size(pattern, hit, 2)))


def anchored(tests: DataFrame) -> DataFrame:
    """(gram, kind, needle, regex, hit): each test with the rarest 4-gram of its needle, or the whole of a shorter one."""
    test = ["kind", "needle", "regex"]
    every = F.array_distinct(F.regexp_extract_all("needle", F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1)))
    short = F.length("needle") <= GRAM
    tests = tests.groupBy(*test).agg(F.min("hit").alias("hit"))
    grams = tests.select(*test, "hit", F.explode(F.when(short, F.array("needle")).otherwise(every)).alias("gram"))
    counted = grams.join(grams.groupBy("gram").agg(F.count("*").alias("f")), "gram")
    return counted.groupBy(*test, "hit").agg(F.min_by("gram", F.struct("f", "gram")).alias("gram"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _grams(text: Column) -> Column:
    """The 4-grams of a text and the shorter ones at its end."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{GRAM}}}))."), F.lit(1)))


def _beginnings(grams: Column, lengths: Column) -> Column:
    """All grams of the given lengths, from those of ``_grams``."""
    return F.flatten(F.transform(lengths, lambda k: F.array_distinct(F.transform(F.array_append(grams, F.lit("")), lambda g: F.substring(g, F.lit(1), k)))))


def _passes(text: Column, kind: Column, test: Column) -> Column:
    return (test["kind"] == kind) & F.contains(text, test["needle"]) & (test["regex"].isNull() | F.rlike(text, test["regex"]))


def _index(tests: DataFrame) -> Column:
    """As one value: the lengths of the anchors, and ``BUCKETS`` arrays of tests by the hash of their anchors. The tests are few: one task does it."""
    test = F.struct("gram", "kind", "needle", "regex", "hit").alias("test")
    few = tests.coalesce(1)
    filled = anchored(few).select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).alias("id"), test)
    every = filled.unionByName(few.sparkSession.range(0, BUCKETS, 1, 1), allowMissingColumns=True).coalesce(1)
    every = every.groupBy("id").agg(F.collect_list("test").alias("tests"), F.collect_set(F.length("test.gram")).alias("lengths"))
    lengths = F.array_distinct(F.flatten(F.collect_list("lengths"))).alias("lengths")
    buckets = F.transform(F.array_sort(F.collect_list(F.struct("id", "tests"))), lambda r: r["tests"]).alias("buckets")
    return every.agg(F.struct(lengths, buckets)).scalar()


def _in_row(targets: list[tuple[str, Column]], index: Column) -> Column:
    """The least hit of each target, as an array."""

    def look(bound: Column) -> Column:
        def tried(gram: Column, target: Column) -> Column:
            bucket = F.get(bound["index"]["buckets"], F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int"))
            return F.filter(bucket, lambda t: (t["gram"] == gram) & _passes(target["low"], target["kind"], t))

        def hits(target: Column) -> Column:
            return F.flatten(F.transform(_beginnings(target["grams"], bound["index"]["lengths"]), lambda gram: tried(gram, target)))

        return F.transform(bound["targets"], lambda target: F.when(target["low"].isNotNull(), F.array_min(F.transform(hits(target), lambda t: t["hit"]))))

    texts = [F.struct(F.lit(kind).alias("kind"), text.alias("low"), _grams(text).alias("grams")) for kind, text in targets]
    return _let(F.struct(F.array(*texts).alias("targets"), index.alias("index")), look)


def _least(hits: DataFrame, hit: str = "hit") -> Column:
    """The least hit of a group; of ids alone by a sum that needs no sort. A null id is the least one."""
    if len(hits.schema[hit].dataType) > 1:
        return F.min(hit)
    number = F.col(f"{hit}.id")
    return F.struct(F.when(F.bool_and(number.isNotNull()), F.min(number)).alias("id"))


def _own(tests: DataFrame) -> DataFrame:
    """One row for tests that differ by their hits only."""
    return tests.groupBy("needle", "regex").agg(_least(tests).alias("hit"))


def _look() -> Column:
    """Whether a text is needed to tell if a test passes, as a stretch does not tell all."""
    return F.col("regex").isNotNull() | (F.length("needle") > WHOLE)


def _up_to(greatest: int | None) -> Column:
    """Tests of hits with this id at most; a null id is the least one."""
    return F.lit(True) if greatest is None else F.col("hit.id").isNull() | (F.col("hit.id") <= greatest)


def _counted(tests: DataFrame) -> dict[tuple[str, bool], tuple[int, list]]:
    """For each kind, of tests that need a text and of those that do not: how many rows, and the id that a half, a quarter, ... of them do not exceed."""
    halves = F.percentile_approx("hit.id", [0.5**k for k in range(HALVED)])
    rows = tests.groupBy("kind", _look().alias("look")).agg(F.count("*").alias("n"), halves.alias("ids")).collect()
    return {(row["kind"], row["look"]): (row["n"], row["ids"] or [None] * HALVED) for row in rows}


def _first(tests: DataFrame, count: int, ids: list) -> tuple[pa.Table, bool]:
    """Of tests that stretches settle, those of the least hits, ascending (needle, hit), and whether these are all. All others have hits as great or greater."""
    halved = next((k for k in range(HALVED) if count <= FIRST_ROWS << k), HALVED - 1)
    few = tests.where(_up_to(ids[halved] if halved else None))
    few = few.groupBy("needle").agg(_least(few).alias("hit"))
    distinct, most = few.agg(F.count("*"), F.max(F.octet_length("needle") + F.octet_length(F.to_json("hit")) + TEST_BYTES)).first()
    taken = max(0, min(FIRST, INDEX_BYTES // (most or 1)))
    least = few.orderBy("hit").limit(taken).select(F.col("needle").cast("binary").alias("needle"), "hit")
    return least.toArrow(), not halved and distinct <= taken


def _first_hit(spark, first: pa.Table, hit: T.DataType) -> Callable[[Column], Column]:
    """The hit of the first of the listed needles that a text (bytes) holds."""
    needles, hits = (first[name].combine_chunks() for name in ("needle", "hit"))
    shared = spark.sparkContext.broadcast((marks_of(needles), needles, hits))

    @F.arrow_udf(hit)
    def piece_hit(texts: pa.Array) -> pa.Array:
        marks, needles, hits = shared.value
        least, (data, ends) = np.full(len(texts), len(needles)), text_bytes(texts)
        for rows, begins, sizes in marks.places(data, ends):
            found = pc.index_in(stretches(data, begins, sizes), value_set=needles)
            np.minimum.at(least, rows, found.fill_null(len(needles)).to_numpy())
        return hits.take(pa.array(least, mask=least == len(needles)))

    return piece_hit.asNondeterministic()  # so it is not computed once more for a filter


def _hits(texts: DataFrame, kind: str, tests: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(key, hit) of the texts (key, bytes), and a test of bytes: a text without it has no hit.

    Stretches of texts that may be needles meet them in an equi-join. Texts are taken once more only for tests that a needle does not settle.
    """
    tests = _own(tests).withColumn("piece", F.substring("needle", 1, WHOLE).cast("binary"))
    marks = piece_marks(tests.select("piece", _look().alias("look")))
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        found = np.zeros(len(texts), bool)
        for rows, _, _ in shared.value.places(*text_bytes(texts)):
            found[rows] = True
        return pa.array(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = [i for i, key in enumerate(batch.column(0).to_pylist()) if not (key in seen or seen.add(key))]
            if len(seen) > SEEN:
                seen.clear()
            if len(fresh) < batch.num_rows:
                batch = batch.take(pa.array(fresh, pa.int64()))
            keys, (data, ends) = batch.column(0), text_bytes(batch.column(1))
            for rows, begins, sizes in shared.value.places(data, ends):
                once = pa.table([rows, stretches(data, begins, sizes)], ["row", "piece"]).group_by(["row", "piece"], use_threads=False).aggregate([])
                yield pa.RecordBatch.from_arrays([keys.take(once["row"].combine_chunks()), once["piece"].combine_chunks()], ["key", "piece"])

    found = texts.mapInArrow(cut, "key binary, piece binary")
    hits = (found.distinct() if marks.look else found).join(tests, "piece")
    if marks.look:
        again = texts.join(hits.where(_look()).select("key").distinct(), "key", "left_semi").distinct().select("key", F.col("bytes").cast("string").alias("low"))
        passes = _passes(F.col("low"), F.lit(kind), F.struct(F.lit(kind).alias("kind"), "needle", "regex"))
        hits = hits.join(again, "key", "left").where(~_look() | passes)
    return hits.groupBy("key").agg(_least(hits).alias("hit")), holds


def _sliced_hits(texts: DataFrame, kind: str, tests: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """As ``_hits``, of more tests: slice after slice by ascending ids, each for the texts that have no hit yet. The hits are a work table."""
    spark, folder = texts.sparkSession, new_folder(texts.sparkSession)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    tests = written(_own(tests), "tests")
    count, rank, ranks = tests.count(), 4 * FIRST, []
    while rank < count:
        ranks.append(rank / count)
        rank += min(3 * rank, SLICE)
    ends = tests.agg(F.percentile_approx("hit.id", ranks, 100_000)).first()[0] if ranks else None
    ends, found, before = [*sorted(set(ends or [])), None], [], F.lit(False)
    for i, end in enumerate(ends):
        hits, _ = _hits(texts, kind, tests.where(_up_to(end) & ~before))
        found.append(written(hits, f"hits{i}"))
        if end is None:
            break
        before = _up_to(end)
        texts = written(texts.join(found[-1], "key", "left_anti"), f"texts{i}")
        if texts.isEmpty():
            break
    for name in ("tests", *(f"texts{i}" for i in range(len(ends)))):
        remove(spark, f"{folder}/{name}")
    return reduce(DataFrame.unionByName, found), lambda data: F.lit(True)


def _by_join(log: DataFrame, targets: dict[str, tuple[str, Column]], tests: DataFrame) -> DataFrame:
    """Rows of texts that may have a hit beyond the first tests meet their text's by its hash; all others stay where they are."""
    kept, hit, some, met = log.columns, tests.schema["hit"].dataType, F.lit(False), {}
    for i, (_, text) in enumerate(targets.values()):
        log = log.withColumn(f"_bytes{i}", text.cast("binary"))
    marked, counted = log, _counted(tests)
    for i, (kind, _) in enumerate(targets.values()):
        data, first, settled = F.col(f"_bytes{i}"), F.col(f"_first{i}"), False
        key = F.substring(F.unhex(F.sha2(data, 256)), 1, KEY_BYTES)
        texts = left = log.where(data.isNotNull()).select(key.alias("key"), data.alias("bytes"))
        own = tests.where(F.col("kind") == kind).select("needle", "regex", "hit")
        plain, look = own.where(~_look()), own.where(_look())
        found = F.lit(None).cast(hit)
        if (kind, False) in counted and INDEX_BYTES >= TEST_BYTES:
            listed, settled = _first(plain, *counted[kind, False])
            if listed.num_rows:
                listed, size = _first_hit(log.sparkSession, listed, hit), F.octet_length("bytes")
                looked = texts.select(size.alias("n"), listed(F.col("bytes")).isNull().alias("open"))
                every, unsettled = (n or 0 for n in looked.agg(F.sum("n"), F.sum(F.when(F.col("open"), F.col("n")))).first())
                settled = settled or not unsettled
                if settled or counted[kind, False][0] > SLICE or (every - unsettled) * WORTH >= every:
                    found, left = listed(data), texts.where(size > 0).where(listed(F.col("bytes")).isNull())
        marked, parts = marked.withColumn(f"_first{i}", found), []
        for asked, others, needs, wanted in ((left, plain, False, first.isNull()), (texts, look, True, F.lit(True))):
            if (kind, needs) in counted and (needs or not settled):
                hits, holds = (_hits if counted[kind, needs][0] <= SLICE else _sliced_hits)(asked, kind, others)
                parts.append(hits)
                some = some | (wanted & data.isNotNull() & holds(F.when(wanted, data)))
        if parts:
            hits = reduce(DataFrame.unionByName, parts)
            met[i] = key, hits.groupBy(F.col("key").alias(f"_hit_key{i}")).agg(_least(hits).alias(f"_hit{i}"))
    firsts = [F.col(f"_first{i}").alias(out) for i, out in enumerate(targets)]
    if not met:
        return marked.select(*kept, *firsts)
    marked = marked.withColumn("_some", some)
    joined = marked.where("_some").select(*kept, *(f"_first{i}" for i in range(len(targets))), *(key.alias(f"_key{i}") for i, (key, _) in met.items()))
    for i, (_, hits) in met.items():
        joined = joined.join(hits, F.col(f"_key{i}") == F.col(f"_hit_key{i}"), "left")
    least = [F.least(f"_first{i}", f"_hit{i}").alias(out) if i in met else F.col(f"_first{i}").alias(out) for i, out in enumerate(targets)]
    return joined.select(*kept, *least).unionByName(marked.where("NOT _some").select(*kept, *firsts))


def first_hits(log: DataFrame, targets: dict[str, tuple[str, Column]], tests: Tests) -> DataFrame:
    """``log`` with a column for each entry ``out: (kind, text)``: the least hit of the kind's tests that the text (in lower case) passes, null if none.

    Rows may repeat; null texts pass none.
    """
    enough = tests.sizes.limit(max(INDEX_BYTES, 0) // TEST_BYTES + 1)  # so many take more than INDEX_BYTES, whatever the rest
    if (enough.agg(F.sum("bytes")).first()[0] or 0) > INDEX_BYTES:
        if log.isStreaming:
            raise ValueError("more tests than a stream's rows can hold; call this from foreachBatch")
        return _by_join(log, targets, tests.rows)
    # A subquery may not stand in a lambda; as a column that is used once it is put there by the optimizer.
    kept = log.columns
    found = log.withColumn("_index", _index(tests.rows)).select(*kept, _in_row(list(targets.values()), F.col("_index")).alias("_found"))
    return found.select(*kept, *(F.get("_found", F.lit(i)).alias(out) for i, out in enumerate(targets)))


def first_hit(log: DataFrame, text: Column, tests: Tests, out: str) -> DataFrame:
    """``first_hits`` for one text and tests without a kind."""
    return first_hits(log, {out: ("", text)}, tests)
