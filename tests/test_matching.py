"""First-match joins: every path gives the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from wiretally.operators import access as A
from wiretally.operators import matching as M
from wiretally.operators import netblocks as N
from wiretally.operators import textmatch as X


def brute_rule(rules, kind, target):
    import re

    if not target:
        return None
    for rid, k, pattern, active in rules:
        if not active or k != kind:
            continue
        low = target.lower()
        if pattern is None:
            continue
        try:
            hit = re.search(re.sub(r"(?<!\\)\$", r"\\Z", pattern), low)
        except re.error:
            hit = None
        if hit or pattern.lower() in low:
            return rid
    return None


RULES = [
    (12, "database", None, True), (3, "database", "^test$", True), (1, "database", "^test_.*", True), (2, "database", ".*_old$", True), (4, "username", "^$", True),
    (5, "username", ".*admin.*", True), (6, "table", r"^mysql\.user$", True), (7, "database", "(", True), (8, "database", "^off$", False),
    (9, "database", "^Shop$", True), (10, "table", "^users$", True),
]
TARGETS = [
    ("Test", "root", "users"), ("test_x", "", "mysql.user"), ("a_old", "SuperAdmin", "mysqlxuser"), ("f(x)", None, ""), ("off", "a", None),
    ("shop", "u", "t"), ("x^test$y", "u", "USERS"), ("a_old\n", "u", "users\n"), ("", "", ""), ("^shop$", "u", "t"),
]


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_rule_paths(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(X, "INDEX_BYTES", index_bytes)
    rules = sorted(RULES)
    table = spark.createDataFrame([(*r, "why") for r in RULES], "id long, kind string, pattern string, active boolean, reason string")
    log = spark.createDataFrame([(i, *t) for i, t in enumerate(TARGETS)], "log_id int, database string, username string, tab string")
    got = {r.log_id: (r.rule_id, r.blocked) for r in M.match_blocked(log, table, table="tab").collect()}
    for i, (database, username, tab) in enumerate(TARGETS):
        hits = [brute_rule(rules, k, t) for k, t in (("database", database), ("username", username), ("table", tab))]
        first = next((h for h in hits if h is not None), None)
        assert got[i] == (first, first is not None), TARGETS[i]


@pytest.mark.parametrize("count, index_bytes", [(80, 1 << 20), (80, 0), (1, 1 << 20), (1, 0), (0, 1 << 20), (0, -1)])
def test_substrings(spark, monkeypatch, count, index_bytes):
    monkeypatch.setattr(X, "INDEX_BYTES", index_bytes)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [word(rng.randrange(0, 60)) for _ in range(150)] + [None]
    texts += texts[:30]
    needles = [(i + 1, word(rng.randrange(1, 9))) for i in range(count)]
    log = spark.createDataFrame(list(enumerate(texts)), "log_id int, low string")
    table = spark.createDataFrame(needles, "id long, needle string")
    got = {r.log_id: r.hit for r in M.substring_first(log, "low", table, "hit").collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else min((n for n, w in needles if w in t), default=None))


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_threat_types(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(X, "INDEX_BYTES", index_bytes)
    indicators = spark.createDataFrame(
        [
            (1, "user_agent", "curl", "low", True), (2, "ip", "10.0.0.1", "high", True), (3, "email", "Bob@X.org", "low", True),
            (4, "sql_pattern", "DROP", "high", True), (5, "pattern", r"a+b\b", "low", True), (6, "pattern", "(", "low", True),
            (7, "domain", "Evil.org", "low", True), (8, "sql_pattern", "never", "low", False), (9, "ip", "10.0.0.1", "low", True),
        ],
        "id long, type string, value string, threat_level string, active boolean",
    )
    log = spark.createDataFrame(
        [
            (1, "shop", "10.0.0.1:5432", "u", "x"), (2, "shop", "1.1.1.1:9", "bob@x.ORG", "x"), (3, "shop", "1.1.1.1", "u", "drop it"),
            (4, "shop", "1.1.1.1", "u", "xaab y"), (5, "shop", "1.1.1.1", "u", "get EVIL.ORG/x curl never"), (6, "shop", "1.1.1.1", "u", "("),
            (7, "off", "10.0.0.1", "u", "drop"), (8, "shop", "10.0.0.1", "u", "drop"),
        ],
        "log_id long, database string, source_ip string, username string, query string",
    )
    policy = spark.createDataFrame([("off", False)], "database string, threat_intel_blocks_enabled boolean")
    rows = {r.log_id: r for r in M.match_threats(log, indicators, policy).collect()}
    assert {i: r.indicator_id for i, r in rows.items()} == {1: 2, 2: 3, 3: 4, 4: 5, 5: 7, 6: None, 7: None, 8: 2}
    assert rows[1].match_reason == "Source IP 10.0.0.1 matches threat indicator"
    assert rows[5].match_reason == "Query contains threat indicator: Evil.org"


def test_wildcard_rules_against_loop(spark):
    rng = random.Random(9)
    pick = lambda *xs: rng.choice(xs)
    rules = [(i, pick("", "*", "a", "b"), pick("", "x", "y"), pick("*", "r", "w")) for i in range(25)]
    requests = [(i, pick("a", "b", "c", None), pick("x", "y", "z"), pick("r", "w")) for i in range(120)]
    out = M.wildcard_first(
        spark.createDataFrame(requests, "rid int, d string, t string, o string"),
        spark.createDataFrame(rules, "n int, d string, t string, o string"), ["d", "t", "o"], "n", "hit",
    )
    fits = lambda rule, req: all(r in ("", "*") or r == q for r, q in zip(rule[1:], req[1:]))
    for r in out.collect():
        assert r.hit == min((rule[0] for rule in rules if fits(rule, (r.rid, r.d, r.t, r.o))), default=None)


def test_cidr_joins(spark):
    cidrs = N.parse_cidrs(spark.createDataFrame([("10.0.0.0/8",), ("1.2.3.4/32",), ("bad",), ("9.9.9.9/99",), ("7.7.7.7/0x",)], "c string"), "c")
    requests = spark.createDataFrame([("10.1.1.1",), ("1.2.3.4",), ("1.2.3.5",), ("11.0.0.1",)], "s string")
    requests = requests.withColumn("ip", N.ip_to_long(F.col("s")))
    assert {r.s: r.cidr_hit for r in N.match_cidr(requests, cidrs).collect()} == {
        "10.1.1.1": True, "1.2.3.4": True, "1.2.3.5": False, "11.0.0.1": False,
    }


def test_allowed_list_skips_bad_entries(spark):
    users = spark.createDataFrame([("u", ["x/y", "10.0.0.0/99", "10.0.0.0/30"]), ("v", []), ("w", ["1.1.1.1"])], "username string, allowed_ips array<string>")
    log = spark.createDataFrame([("u", "10.0.0.3"), ("u", "10.0.0.4"), ("v", "9.9.9.9"), ("w", "1.1.1.1"), ("w", "1.1.1.2"), ("n", "x")], "username string, source_ip string")
    got = {(r.username, r.source_ip): r.ip_allowed for r in N.ip_allowed(log, users).collect()}
    assert list(got.values()).count(True) == 4 and not got[("u", "10.0.0.4")] and not got[("w", "1.1.1.2")]


def test_login_needs_address_only_when_given(spark):
    users = spark.createDataFrame([("u", True, None, ["10.0.0.1"])], "username string, enabled boolean, expires_at timestamp, allowed_ips array<string>")
    perms = spark.createDataFrame([("u", "*", "*", ["*"], None)], "username string, database string, table string, actions array<string>, time_limit timestamp")
    log = spark.createDataFrame([(1, "u", "d", ""), (2, "u", "d", "10.0.0.1:99"), (3, "u", "d", "10.0.0.2"), (4, "x", "d", None)], "i int, username string, database string, source_ip string")
    got = {r.i: r.deny_reason for r in A.authenticate(log, users, perms, F.current_timestamp()).collect()}
    assert got == {1: None, 2: None, 3: "address not allowed", 4: "user not found or disabled"}


def test_custom_rules(spark):
    rules = spark.createDataFrame(
        [(2, "drop\\s+table", "block", "high", True), (1, "(", "log", "low", True), (3, "X{2}$", "alert", "low", True), (0, "a", "log", "low", False)],
        "id long, pattern string, action string, severity string, active boolean",
    )
    log = spark.createDataFrame([(1, "DROP  TABLE a xx"), (2, "axx"), (3, "axx\n")], "i int, query string")
    got = {r.i: (r.custom_rule, r.action) for r in M.match_security_rules(log, rules).collect()}
    assert got == {1: (2, "block"), 2: (3, "alert"), 3: (None, None)}


def test_nested_lists_in_parts(spark):
    from wiretally.operators.nest import nest

    rows = [(("a" if i % 3 else None), i) for i in range(90)] + [("b", 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = nest(df, ["k"], F.col("v"), "items", spread_by="v", parts=4).collect()
    found = {}
    for r in got:
        found.setdefault(r.k, []).extend(r["items"])
    assert {k: sorted(v) for k, v in found.items()} == {
        "a": [i for i in range(90) if i % 3], None: [i for i in range(90) if not i % 3], "b": [1],
    }
    assert len([r for r in got if r.k == "a"]) == 4 and len([r for r in got if r.k == "b"]) == 1


def test_short_and_long_needles_share_one_plan(spark):
    texts = ["abc", "xaby", "", "zz\nq", "a" * 40, None, "abc"]
    words = ["a", "ab", "z\nq", "aaaaa", "y", "missing", ""]
    log = spark.createDataFrame([(t,) for t in texts], "low string")
    needles = spark.createDataFrame([(9 - i, w) for i, w in enumerate(words)], "id long, needle string")
    got = sorted((r.low or "", r.hit or 0) for r in M.substring_first(log, "low", needles, "hit").collect())
    want = sorted((t or "", min((9 - i for i, w in enumerate(words) if w and t and w in t), default=0)) for t in texts)
    assert got == want


def test_needed_literals():
    assert X.needed_literals(r"union\s+select") == ["select"] and X.needed_literals("^name$") == ["name"]
    assert X.needed_literals("(?:drop|delete) x") == ["elete", "rop"] and X.needed_literals("(ab|c*)") == [""]
    assert X.needed_literals("a?b{0,3}c+") == ["c"] and X.needed_literals(r"\Qa.b\E") == [""] and X.needed_literals("(") == [""]
    assert X.needed_literals("(?i)DROP") == ["DROP"] and X.needed_literals(None) == [""]


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_patterns_against_every_pair(spark, monkeypatch, index_bytes):
    """Candidates by literals lose no match of any pattern."""
    import re

    monkeypatch.setattr(X, "INDEX_BYTES", index_bytes)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shapes = [
        lambda: word(3) + r"\s+" + word(2), lambda: f"({word(2)}|{word(3)}){word(1)}", lambda: f"{word(2)}+{word(1)}?{word(2)}", lambda: f"[{word(2)}]{{3}}\\d",
        lambda: f"^{word(2)}", lambda: f"{word(1)}$", lambda: f"(?:{word(2)}){{2,}}", lambda: f"{word(2)}.*{word(2)}", lambda: f"(?i){word(4).upper()}", lambda: "(" + word(2),
    ]
    patterns = [(i, rng.choice(shapes)()) for i in range(120)]
    texts = ["".join(rng.choice("abcd 1") for _ in range(rng.randrange(25))) for _ in range(200)] + [None, ""]
    rules = spark.createDataFrame([(*p, "a", "s", True) for p in patterns] + [(999, None, "a", "s", True)], "id long, pattern string, action string, severity string, active boolean")
    log = spark.createDataFrame(list(enumerate(texts)), "i int, query string")
    got = {r.i: r.custom_rule for r in M.match_security_rules(log, rules).collect()}

    def first(text):
        for i, p in patterns:
            try:
                if text is not None and re.search(p, text, re.I):
                    return i
            except re.error:
                pass

    assert got == {i: first(t) for i, t in enumerate(texts)}


def test_hundred_thousand_rules(spark):
    """Rules in one value; the plan holds none of them, and the log is not shuffled."""
    n = 100_000
    rules = spark.range(n).select("id", F.lit("database").alias("kind"), F.concat(F.lit("^srv"), "id", F.lit("\\..*")).alias("pattern"), F.lit("why").alias("reason"), F.lit(True).alias("active"))
    log = spark.range(300).select(F.concat(F.lit("SRV"), F.col("id") * 400, F.lit(".shop")).alias("database"), F.lit("u").alias("username"), F.col("id").alias("log_id"))
    out = M.match_blocked(log, rules)
    assert {(r.log_id, r.rule_id) for r in out.collect()} == {(i, i * 400 if i * 400 < n else None) for i in range(300)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


@pytest.mark.parametrize("empty", [True, False])
def test_seeded_rules_only_into_an_empty_table(spark, empty):
    rules = M.default_rules(spark)
    table = rules.limit(0) if empty else rules.limit(3)
    assert M.seed_rules(table).count() == (rules.count() if empty else 3)
