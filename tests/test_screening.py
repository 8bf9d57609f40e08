"""Screening functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from wiretally.functions import commands as C
from wiretally.functions import fingerprint as fp
from wiretally.functions import keys as K
from wiretally.functions import packs
from wiretally.functions import screening as S
from wiretally.operators import screen


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


INJECTIONS = [
    "SELECT a FROM t UNION SELECT b FROM u", "x; DROP TABLE t", "id = 1 or 1=1", "a -- b", "exec ('x')", "XP_CMDSHELL",
    "waitfor   delay '0'", "select * from information_schema.tables", "load_file ('x')", "0xDEADbeef", "cat /etc/passwd",
    "grep -r x", "wget http", "rm -rf x", "tar -x", "a | sh", "a && sh", "`id`", "$(id)", "reg add x", "sc stop x",
    "net user x", "test", "master.x", "root", "mysql.user", "select concat(char(1))",
]
CLEAN = [
    "SELECT name FROM people WHERE age > 30", "INSERT INTO orders (a) VALUES (1)", "update carts set total = 5 where user_id = 2",
    "select tested, contest from attestations", "select shell from shores", "écmd", "cmdé_x",
]


def test_injection(spark):
    assert column(spark, INJECTIONS, S.is_sql_injection) == [True] * len(INJECTIONS)
    flags = column(spark, CLEAN, S.is_sql_injection)
    assert flags[:5] == [False] * 5
    assert flags[5:] == [True, True]  # word edges are ASCII: é is no word character


def test_heuristics_need_two_hits(spark):
    texts = ["a'b'c'd'e'f 1=1", "a'b'c'd'e'f", "x ' or ' y 1 = 1"]
    assert column(spark, texts, S.is_sql_injection) == [True, False, True]


def test_shell_words(spark):
    texts = ["run bash now", "bashful", "/usr/bin/x", "eval", "sudo x", "pseudo", "system (1)", "cmd.exe", "x|sh"]
    assert column(spark, texts, S.is_shell_command) == [True, False, True, True, True, False, True, True, True]


def test_classification_order(spark):
    df = spark.createDataFrame([(0, "bash -- x"), (1, "a -- b"), (2, "q ' or ' z 1=1"), (3, "plain")], "i int, query string")
    rows = screen.classify_queries(df).orderBy("i").collect()
    assert [r.kind for r in rows] == ["shell_command", "sql_injection", "heuristic", ""]
    assert rows[2].detail == "Multiple suspicious patterns: always-true condition, quote-based bypass attempt"
    assert [r.flagged for r in rows] == [True, True, True, False]


def test_validation_messages(spark):
    scripts = ["select 1", "exec (x", "sh", "select * from test", "select 1; drop table x;", "x" * 1001 + "\ny", "é", "it's"]
    df = spark.createDataFrame(list(enumerate(scripts)), "i int, s string")
    rows = {r.i: r for r in screen.validate_scripts(df, "s").collect()}
    assert rows[0].valid and rows[0].severity == "low" and rows[0].patterns_checked == 36
    assert rows[1].errors == [r"Potentially dangerous EXEC statement: exec\s*\(", "Unmatched parentheses in SQL"]
    assert rows[1].severity == "high" and not rows[1].valid
    assert rows[2].severity == "critical"
    assert rows[3].severity == "medium" and rows[3].valid
    assert rows[3].warnings == ["Potential default/test resource access - Test database access"]
    assert rows[4].severity == "high"
    assert rows[4].warnings == ["Multiple different statement types detected: SELECT, DROP"]
    assert rows[5].warnings == ["Extremely long line detected (line 1): 1001 characters"]
    assert rows[6].warnings == ["Non-ASCII characters detected - potential encoding attack"]
    assert rows[7].errors == ["Unmatched single quotes in SQL"]


def test_severity_alone_agrees_with_validation(spark):
    texts = INJECTIONS + CLEAN + ["a;b", "a;a", ";;", "--", "-- x\r", "/* x */", "/* x\n*/", "sa", "é sh", "ésh", "sh é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    full = screen.validate_scripts(df, "t").select("t", "severity")
    quick = screen.script_severity(df, "t").select("t", "severity")
    assert sorted(full.collect()) == sorted(quick.collect())


def test_packs_have_the_known_sizes():
    assert len(packs.INJECTION_GROUPS) == 43 and len(packs.SHELL_GROUPS) == 7
    assert len(packs.WRITE_KEYWORDS) == 21 and len(packs.KV_BLOCKED) == 22 and len(packs.KV_BLOCKED_CLUSTER) == 15
    assert [sum(k == kind for k, _, _ in packs.DEFAULT_BLOCKED) for kind in ("database", "username", "table")] == [25, 17, 7]


@pytest.mark.parametrize("pattern", [p for g in packs.INJECTION_GROUPS + packs.SHELL_GROUPS for p in g])
def test_literal_runs_are_needed(pattern):
    """The text tests in front of a pattern never reject what the pattern accepts."""
    import re

    sample = re.sub(r"\\b", "", pattern)
    for find, put in ((r"\\s[+*]", " "), (r"\\d\+", "1"), (r"\[0-9a-f\]\+", "f"), (r"\.\*", " "), (r"\\(.)", r"\1")):
        sample = re.sub(find, put, sample)
    assert all(run in sample for run in S.literal_runs(pattern))


def test_write_class(spark):
    texts = ["insert x", "  CREATE y", "select 1", "settle", "START", "explain"]
    assert column(spark, texts, S.is_write_query) == [True, True, False, True, True, False]


def test_kv_and_document_commands(spark):
    rows = column(spark, ["GET a b", "*set k", "", "  flushall "], C.parse_kv_command)
    assert [(r.command, r.args, r.key, r.is_read) for r in rows] == [
        ("GET", ["a", "b"], "a", True), ("set", ["k"], "k", False), ("", [], "", False), ("flushall", [], "", False),
    ]
    assert column(spark, ["x.FIND()", "dropEval", "mapReduce", "noop"], C.doc_operation) == ["find", "drop", "mapreduce", "unknown"]


def test_fingerprints(spark):
    texts = ["  SELECT  a FROM T WHERE x = 12 AND y='b 7' AND z=\"q\"", "select discount from A.b join c on 1=1 join a.b", "col1 x1 1x"]
    assert column(spark, texts, fp.normalize_sql) == [
        "select a from t where x = ? and y=? and z=?", "select discount from a.b join c on ?=? join a.b", "col1 x1 1x",
    ]
    assert column(spark, texts, fp.table_names) == [["t"], ["b", "c"], []]
    assert column(spark, texts, fp.join_count) == [0, 2, 0]
    assert [round(v, 6) for v in column(spark, texts, fp.complexity)] == [1.0, 2.3, 0.0]
    assert column(spark, ["delete from  x", "insert into y (a)", "update z set", "nothing", "from "], fp.primary_table) == [
        "x", "y", "z", "unknown", "unknown",
    ]


def test_key_slots(spark):
    def slot(key: str) -> int:
        at = key.find("{")
        if at >= 0 and (end := key.find("}", at + 1)) >= 0:
            key = key[at + 1 : end]
        crc = 0
        for byte in key.encode():
            crc ^= byte << 8
            for _ in range(8):
                crc = ((crc << 1) ^ 0x1021) & 0xFFFF if crc & 0x8000 else (crc << 1) & 0xFFFF
        return crc % 16384

    keys = ["foo", "", "{}", "a{b}c", "{x}{y}", "{open", "é{ü}", "k" * 50, "}{", "a}b{c}"]
    assert column(spark, keys, K.key_slot) == [slot(k) for k in keys]
    assert slot("foo") == 12182


def test_mix32(spark):
    def mix(value: int, seed: int) -> int:
        h = (seed ^ value) & 0xFFFFFFFF
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        h = h * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    values = [0, 1, 0xFFFFFFFF, 167772161, 0x80000000, 12345]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for seed in (0, 0x12345678, 0xFFFFFFFF):
        got = [r.h for r in df.select(K.mix32(F.col("v"), F.lit(seed)).alias("h")).collect()]
        assert got == [mix(v, seed) for v in values]


def test_addresses(spark):
    assert column(spark, ["10.0.0.1", "256.1.1.1", "1.2.3", "x", "255.255.255.255"], K.ip_to_long) == [
        167772161, None, None, None, 4294967295,
    ]


def test_digest_numbers(spark):
    import hashlib

    texts = ["a", "users", "é", ""]
    whole = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8]) for t in texts]
    assert [int(v) for v in column(spark, texts, K.hash_u64)] == whole
    assert column(spark, texts, K.hash_u32) == [w >> 32 for w in whole]
