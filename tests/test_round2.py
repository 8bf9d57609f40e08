"""Cases on both sides of thresholds that once changed results."""

import pytest
from pyspark.sql import functions as F

from wiretally.operators import access, findings, latency, rollups, routing, tuning


def test_many_backends_keep_their_environment(spark):
    rows = [(1, p, p >= 9) for p in range(40)] + [(2, p, True) for p in range(40)]
    backends = spark.createDataFrame(rows, "env_id int, position int, healthy boolean")
    requests = spark.range(2000).select(F.col("id").alias("ip"), (F.col("id") % 50).cast("int").alias("port"), F.lit(1).alias("env_id"))
    got = routing.choose_backend(requests, backends, primary=1, secondary=2).select("backend_id", "failed_over").distinct().collect()
    assert {(r.backend_id >> 32, r.failed_over) for r in got} == {(1, False)}
    assert {r.backend_id & 0xFFFFFFFF for r in got} == set(range(9, 40))


@pytest.mark.parametrize("maximum,evicted", [(100, []), (99, [1, 2]), (80, [1, 2, 3])])
def test_eviction_starts_above_the_maximum(spark, maximum, evicted):
    rows = [(i, i, 10) for i in range(1, 11)]
    entries = spark.createDataFrame(rows, "entry_id long, s long, size long").withColumn("ts", F.timestamp_seconds("s"))
    got = rollups.evict_lru(entries, "ts", "entry_id", "size", max_bytes=maximum)
    assert sorted(r.entry_id for r in got.where("evicted").collect()) == evicted


def test_tests_without_input_are_skipped(spark):
    host = spark.createDataFrame([("h", [22], 12, True, True, True, True)], "host string, open_ports array<int>, min_length int, upper boolean, lower boolean, digits boolean, special boolean")
    assert {r.test_id: r.status for r in findings.compliance_tests(host).collect()}["PR.AC-1"] == "skip"


def test_averages_skip_nulls(spark):
    values = [1.0, None, 3.0, None, None, 2.0]
    df = spark.createDataFrame([("k", i, i * 7_000, v) for i, v in enumerate(values)], "k string, log_id long, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    level, want = 0.0, []
    for v in values:
        level = level if v is None else 0.1 * v + 0.9 * level
        want.append(level)
    series = latency.ema_series(df, "k", "ts", "log_id", "v", alpha=0.1, slice_seconds=10_000)
    assert [r.ema for r in series.orderBy("log_id").collect()] == pytest.approx(want)
    final = latency.ema_final(df, ["k"], "ts", "log_id", {"avg": F.col("v")}, alpha=0.1, slice_seconds=10_000).first()
    assert (final.n, final.avg) == (3, pytest.approx(want[-1]))


def test_too_few_samples_predict_null(spark):
    columns = ", ".join(f"f_{n} double" for n in latency.FEATURES)
    df = spark.createDataFrame([tuple(1.0 for _ in latency.FEATURES)] * 3, columns).withColumn("latency", F.lit(1.0))
    scored = latency.predict_latency(latency.fit_latency(df), df)
    assert [r.predicted for r in scored.collect()] == [None] * 3


def test_two_permissions_do_not_multiply_requests(spark):
    permissions = spark.createDataFrame([("a", "db", "*", ["read"], None), ("a", "zz", "*", ["write"], None)], "username string, database string, table string, actions array<string>, time_limit timestamp")
    requests = spark.createDataFrame([("a", "db", "t", False)], "username string, database string, table string, is_write boolean")
    assert [r.authorized for r in access.authorize(requests, permissions).collect()] == [True]


@pytest.mark.parametrize("last,n", [(None, 2500), (1000, 1000)])
def test_trends_use_all_points_unless_told(spark, last, n):
    points = spark.range(2500).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 900).alias("ts"), "id", (F.col("id") * 2.0).alias("v"))
    got = tuning.trend(points, "key", ["ts", "id"], "v", last).first()
    assert (got.n, got.slope, got.direction) == (n, pytest.approx(2.0), "increasing")


def test_two_users_of_one_name_do_not_multiply_requests(spark):
    ddl = "username string, enabled boolean, expires_at timestamp, allowed_ips array<string>"
    early, late = (F.lit(t).cast("timestamp") for t in ("2024-01-01", "2024-03-01"))
    users = spark.createDataFrame([("a", False, None, None), ("a", True, None, None), ("b", True, None, None)], ddl)
    users = users.withColumn("expires_at", F.when(F.col("username") == "a", F.when(F.col("enabled"), late)).otherwise(early))
    permissions = spark.createDataFrame([("a", "*", "*", ["read"], None), ("b", "*", "*", ["read"], None)], "username string, database string, table string, actions array<string>, time_limit timestamp")
    requests = spark.createDataFrame([("a", "db", "1.1.1.1"), ("b", "db", "1.1.1.1"), (None, "db", "1.1.1.1")], "username string, database string, source_ip string")
    got = access.authenticate(requests, users, permissions, F.lit("2024-02-01").cast("timestamp")).collect()
    assert sorted((r.username or "", r.allowed, r.deny_reason) for r in got) == [("", False, "user not found or disabled"), ("a", True, None), ("b", False, "account expired")]
