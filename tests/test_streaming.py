"""Streams give what the batch operators give on the same rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wiretally.operators import matching as M
from wiretally.operators import routing as R
from wiretally.operators import tuning as T
from wiretally.plans import inputs
from wiretally.streaming import changes, counters
from wiretally.streaming.limits import sticky_stream
from wiretally.streaming.screening import screen_commands, screen_documents, screen_sql

SF = "/root/testdata/sf0.001"


def as_stream(spark, df, path, parts=3, order="ts"):
    """The table as files in time order, one per micro-batch."""
    total = df.count()
    ranked = df.orderBy(order).limit(total).toPandas()
    schema = df.schema
    for i in range(parts):
        piece = ranked.iloc[i * total // parts : (i + 1) * total // parts]
        spark.createDataFrame(piece, schema).coalesce(1).write.parquet(f"{path}/p{i}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    )


def run(out, tmp_path, mode="append"):
    q = (
        out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    q.awaitTermination()
    return out.sparkSession.read.parquet(str(tmp_path / "out"))


def test_live_counts(spark, tmp_path):
    events = inputs.load(spark, SF, "events").select("ts", "event_type", "value")
    stream = as_stream(spark, events, tmp_path / "in")
    got = run(counters.live_counts(stream, ["event_type"], window="1 day", lateness="1 hour"), tmp_path)
    closed = events.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("w")).first().w
    expected = (
        events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("w.end") <= F.lit(closed)).select(F.col("w.start").alias("window_start"), "event_type", "n")
    )
    assert sorted(got.collect()) == sorted(expected.collect()) and got.count() > 100


def test_live_histogram_columns(spark, tmp_path):
    events = inputs.load(spark, SF, "events").select("ts", "event_type", "value")
    stream = as_stream(spark, events, tmp_path / "in", parts=2)
    got = run(counters.live_histogram(stream, ["event_type"], "value", window="7 days", lateness="1 hour"), tmp_path)
    row = got.first()
    assert row.le_0_005 <= row.le_10_0 <= row.n and row["sum"] > 0


def test_live_scaling(spark, tmp_path):
    rows = [("i1", "cpu", datetime(2024, 1, 1, 0, m), float(v)) for m, v in [(0, 90), (4, 80), (6, 85), (11, 10), (16, 5), (40, 50)]]
    points = spark.createDataFrame(rows, "instance_id string, metric string, ts timestamp, value double")
    policies = spark.createDataFrame([(1, "i1", "cpu", 80.0, 20.0)], "policy_id int, instance_id string, metric_type string, scale_up_threshold double, scale_down_threshold double")
    got = run(counters.live_scaling(as_stream(spark, points, tmp_path / "in", parts=2), policies, lateness="1 minute"), tmp_path)
    found = {r.checked_at.minute: (r.value, r.action) for r in got.collect()}
    assert found[5] == (85.0, "scale_up") and found[10] == (85.0, "scale_up") and found[20] == (7.5, "scale_down") and 15 not in found


def test_screening_stream(spark, tmp_path):
    log = inputs.derive(spark, SF, "query_log").withColumn("table", F.lit("orders"))
    how = dict(
        rules=M.default_rules(spark), indicators=inputs.derive(spark, SF, "indicators"), permissions=inputs.permissions(spark, SF),
    )
    got = run(screen_sql(as_stream(spark, log, tmp_path / "in"), **how).select("log_id", "stage", "decision"), tmp_path)
    expected = screen_sql(log, **how).select("log_id", "stage", "decision")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert {r.stage for r in got.collect()} >= {"blocked", "pattern", None}


def test_command_and_document_screening(spark):
    rules, perms = M.default_rules(spark), spark.createDataFrame(
        [("u", "*", "*", ["read"], None)], "username string, database string, table string, actions array<string>, time_limit timestamp"
    )
    rows = [("db", "u", "", "GET a"), ("db", "u", "", "FLUSHALL"), ("db", "u", "", "SET a b"), ("test", "u", "", "GET a"), ("db", "x", "", "GET a")]
    log = spark.createDataFrame(rows, "database string, username string, table string, line string")
    assert [r.stage for r in screen_commands(log, rules=rules, permissions=perms).collect()] == [None, "command", "permission", "blocked", "permission"]
    docs = [("db", "u", "c", "db.c.find()"), ("db", "u", "c", "eval"), ("db", "u", "system.users", "find"), ("db", "u", "c", "insert")]
    log = spark.createDataFrame(docs, "database string, username string, collection string, message string").withColumn("table", F.col("collection"))
    assert [r.stage for r in screen_documents(log, rules=rules, permissions=perms).collect()] == [None, "operation", "operation", "permission"]


def test_rule_changes_take_effect(spark, tmp_path):
    ddl = "seq long, op string, id long, kind string, pattern string, reason string, active boolean"
    writer = changes.record_changes(str(tmp_path / "rules"))
    writer(spark.createDataFrame([(1, "add", 1, "database", "^a$", "r", True), (2, "add", 2, "database", "^b$", "r", True)], ddl), 0)
    second = spark.createDataFrame([(1, "remove", 1, None, None, None, None), (2, "add", 3, "username", "^z$", "r", True)], ddl)
    writer(second, 1)
    writer(second, 1)  # a batch that runs again replaces itself
    assert sorted(r.id for r in changes.current_rules(spark, str(tmp_path / "rules")).collect()) == [2, 3]
    log = spark.createDataFrame([(1, "a", "u"), (2, "b", "u"), (3, "c", "Z")], "log_id int, database string, username string")
    screen = changes.with_current_rules(spark, str(tmp_path / "rules"), M.match_blocked, str(tmp_path / "out"))
    screen(log, 0)
    assert sorted((r.log_id, r.blocked) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, False), (2, True), (3, True)]


def test_tuner_cooldown(spark, tmp_path):
    rules = T.default_tuning_rules(spark)
    metrics = spark.createDataFrame(
        [(1, "cache_hit_ratio", 0.99), (2, "cache_hit_ratio", 0.5), (2, "memory_pressure", 0.1), (2, "latency_p99", 0.03), (2, "error_rate", 0.06)],
        "snapshot_id long, metric string, value double",
    )
    at = lambda batch: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * batch))
    cycle = changes.tuner_cycle(spark, rules, str(tmp_path / "applied"), at)
    names = lambda b: {r.name for r in spark.read.parquet(f"{tmp_path}/applied/batch={b}").collect()}
    cycle(metrics, 0)
    assert names(0) == {"xdp_cache_size_optimization", "emergency_performance_mode"}
    cycle(metrics, 1)  # a minute later: only the rule with the short cooldown
    assert names(1) == {"emergency_performance_mode"}
    cycle(metrics, 6)
    assert names(6) == {"xdp_cache_size_optimization", "emergency_performance_mode"}


def test_sticky_stream(spark, tmp_path):
    packets = inputs.derive(spark, SF, "packets").withColumn("time_ns", F.unix_micros("ts") * 1000)
    split = R.split_traffic(packets, strategy="canary", primary=1, secondary=2, canary=3, canary_ratio=30)
    routed = split.select(
        "event_id", "ts", "ip", (F.col("event_id") % 20 + 1).alias("port"), (F.col("env_id") * 32).cast("long").alias("backend_id"),
    )
    stream = as_stream(spark, routed, tmp_path / "in").withColumn("unhealthy_ids", F.lit(None).cast("array<long>"))
    got = run(sticky_stream(stream, "ts", "event_id"), tmp_path).select("event_id", "backend_id", "session_hit")
    expected = R.sticky(routed, tie="event_id").select("event_id", "backend_id", "session_hit")
    assert sorted(got.collect()) == sorted(expected.collect())


def test_sticky_leaves_unhealthy_backend(spark, tmp_path):
    rows = [(1, 10, [], 1), (2, 11, [], 2), (3, 12, [10], 3), (4, 13, [10], 4)]
    df = spark.createDataFrame(rows, "event_id long, backend_id long, unhealthy_ids array<long>, s int").select(
        "*", F.lit(1).alias("ip"), F.lit(9).alias("port"), F.timestamp_seconds("s").alias("ts")
    )
    got = run(sticky_stream(as_stream(spark, df, tmp_path / "in", parts=2), "ts", "event_id"), tmp_path)
    assert [(r.backend_id, r.session_hit) for r in sorted(got.collect(), key=lambda r: r.event_id)] == [
        (10, False), (10, True), (12, False), (12, True),
    ]


@pytest.mark.parametrize("late", [False, True])
def test_late_rows_pass_flagged(spark, tmp_path, late):
    from wiretally.operators.limits import TokenBucket
    from wiretally.streaming.limits import limit_stream

    times = [5, 1] if late else [1, 5]
    for i, s in enumerate(times):
        spark.createDataFrame([(i, "a", s)], "id long, k string, s long").select(
            "id", "k", F.timestamp_seconds("s").alias("ts")
        ).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/p0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = run(limit_stream(stream, TokenBucket(1, 0), "k", "ts", "id"), tmp_path)
    rows = {r.id: (r.allowed, r.late) for r in got.collect()}
    assert rows[0] == (True, False) and rows[1] == ((True, True) if late else (False, False))


def test_expiry_follows_the_newest_sighting(spark, tmp_path):
    """A later sighting moves or lifts an expiry; an earlier one that comes late does not."""
    from wiretally.streaming.expiry import expired_stream

    rows = [("a", 0, 10), ("b", 0, 20), ("c", 3, 15), ("a", 5, 60), ("b", 6, None), ("c", 1, 300), (None, 1, 2), ("z", 900, None)]
    minutes = lambda c: F.timestamp_seconds(1_700_000_000 + F.col(c) * 60)
    for i, part in enumerate((rows[:3], rows[3:7], rows[7:])):
        df = spark.createDataFrame(part, "key string, m long, e long").select("key", minutes("m").alias("ts"), F.when(F.col("e").isNotNull(), minutes("e")).alias("expires_at"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = expired_stream(stream, "key", "ts", "expires_at", lateness="30 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.key, (r.expired_us // 1_000_000 - 1_700_000_000) // 60) for r in got) == [("a", 60), ("c", 15)]


def test_more_tests_than_a_stream_holds(spark, tmp_path, monkeypatch):
    from wiretally.operators import textmatch

    monkeypatch.setattr(textmatch, "INDEX_BYTES", 0)
    log = spark.createDataFrame([("shop", "root")], "database string, username string")
    with pytest.raises(ValueError, match="foreachBatch"):
        M.match_blocked(as_stream(spark, log, tmp_path / "in", order="database"), M.default_rules(spark))


def test_merged_rule_changes_equal_all_of_them(spark, tmp_path):
    """What a batch reads stays the same: one snapshot and the batches since; a merging batch that runs again changes nothing."""
    from wiretally.sources.folders import numbered

    ddl = "seq long, op string, id long, kind string, pattern string, reason string, active boolean"
    path, state = str(tmp_path / "rules"), {}
    writer = changes.record_changes(path, merge_every=3)
    for n in range(10):
        batch = [(k, "remove" if (n + k) % 4 == 0 else "add", (n * 3 + k) % 7, "database", f"p{n}-{k}", "r", True) for k in range(4)]
        for _, op, i, _, pattern, _, _ in batch:
            state[i] = None if op == "remove" else pattern
        for _ in range(2 if n in (4, 5, 8) else 1):
            writer(spark.createDataFrame(batch, ddl), n)
        assert {r.id: r.pattern for r in changes.current_rules(spark, path).collect()} == {i: p for i, p in state.items() if p}
        assert len(numbered(spark, path, "batch")) <= 6 and len(numbered(spark, f"{path}/snapshots", "upto")) <= 2
