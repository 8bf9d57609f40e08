"""Queries over what readers, sinks and streams leave behind: the given tables are landed in a new folder in some format, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.operators import feeds as D
from wiretally.operators import matching as M
from wiretally.plans import access, reports
from wiretally.plans.inputs import AS_OF, as_of, ctes, derive, load, permissions
from wiretally.plans.registry import ORACLES, query
from wiretally.sources import feeds as S
from wiretally.sources import files as X
from wiretally.sources.folders import new_folder
from wiretally.streaming import changes, counters
from wiretally.streaming.expiry import expired_stream
from wiretally.streaming.limits import use_keyed_state
from wiretally.streaming.screening import screen_sql

IN_FILE = 500  # pages of a landed document


def land_documents(documents: DataFrame, text, path: str) -> str:
    """Each row's text as a file of its own."""
    documents.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def grouped_pages(spark, sf, *entries):
    pages = load(spark, sf, "pages").withColumn("g", F.floor(F.col("page_id") / IN_FILE))
    return pages.groupBy("g").agg(*(F.collect_list(e).alias(n) for n, e in entries))


def land_taxii(spark, sf) -> str:
    return land_documents(grouped_pages(spark, sf, ("objects", reports.stix_entry())), F.to_json(F.struct("objects")), f"{new_folder(spark)}/taxii")


IOC_ITEM = """CASE page_id % 4 WHEN 0 THEN 'Network/RemoteIP' WHEN 1 THEN 'FileItem/Md5sum' WHEN 2 THEN 'DnsEntryItem/Host' ELSE 'Registry/Key' END"""
IOC_VALUE = """CASE page_id % 4 WHEN 0 THEN '10.0.0.' || page_id WHEN 1 THEN md5(url) WHEN 2 THEN 'd' || page_id || '.example' ELSE 'k' || page_id END"""


def land_openioc(spark, sf) -> str:
    item = F.format_string('<IndicatorItem><Context search="%s" type="mir"/><Content type="string">%s</Content></IndicatorItem>', F.expr(IOC_ITEM), F.expr(IOC_VALUE))
    head = F.format_string(
        '<OpenIOC xmlns="http://openioc.org/schemas/OpenIOC_1.1" id="ioc-%1$d"><metadata><short_description>Pages %1$d</short_description>'
        '<links><link rel="category">part%1$d</link><link rel="other">no</link></links></metadata><criteria><Indicator operator="OR">', "g",
    )
    text = F.concat(head, F.array_join("items", ""), F.lit("</Indicator></criteria></OpenIOC>"))
    return land_documents(grouped_pages(spark, sf, ("items", item)), text, f"{new_folder(spark)}/openioc")


def land_misp(spark, sf) -> str:
    attribute = F.struct(F.lit("url").alias("type"), F.col("url").alias("value"))
    return land_documents(grouped_pages(spark, sf, ("Attribute", attribute)), F.to_json(F.struct("Attribute")), f"{new_folder(spark)}/misp")


MAPPING = {"type": "kind", "value": "ind", "confidence": "score"}


def feed_rows(spark, sf):
    return derive(spark, sf, "indicators").select(F.col("type").alias("kind"), F.col("value").alias("ind"), F.col("confidence").alias("score"))


def land_csv(spark, sf) -> str:
    path = f"{new_folder(spark)}/csv"
    feed_rows(spark, sf).write.option("header", True).csv(path)
    return path


def land_json(spark, sf) -> str:
    rows = feed_rows(spark, sf).withColumn("g", F.pmod(F.hash("ind"), F.lit(8))).groupBy("g").agg(F.collect_list(F.struct("kind", "ind", "score")).alias("rows"))
    return land_documents(rows, F.to_json("rows"), f"{new_folder(spark)}/json")


# --- readers -------------------------------------------------------------------------------------------------


@query("taxii_indicators", ORACLES["stix_indicators"])
def _(spark, sf):
    return reports.stix_columns(S.read_feed(spark, "taxii", land_taxii(spark, sf)))


@query(
    "openioc_indicators",
    f"""SELECT CASE page_id % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'hash' WHEN 2 THEN 'domain' ELSE 'pattern' END AS type, {IOC_VALUE} AS value,
      'Pages ' || (page_id // {IN_FILE}) || ' (IOC: ioc-' || (page_id // {IN_FILE}) || ')' AS description, 'openioc,part' || (page_id // {IN_FILE}) AS tags FROM pages""",
)
def _(spark, sf):
    rows = S.read_feed(spark, "openioc", land_openioc(spark, sf))
    return rows.select("type", "value", "description", F.concat_ws(",", "tags").alias("tags"))


@query(
    "csv_indicators",
    f"""{ctes('indicators')} SELECT 'feed7_' || type || '_' || md5(trim(value)) AS id, type, trim(value) AS value, round(confidence, 6)::DOUBLE AS confidence FROM indicators""",
)
def _(spark, sf):
    rows = S.read_feed(spark, "csv", land_csv(spark, sf), feed_id="feed7", mapping=MAPPING, as_of=as_of())
    return rows.select("id", "type", "value", F.round("confidence", 6).alias("confidence"))


@query(
    "feed_readers",
    f"""{ctes('indicators')} SELECT 'json' AS reader, type, count(*) AS n FROM indicators GROUP BY 2
    UNION ALL SELECT 'csv', type, count(*) FROM indicators GROUP BY 2
    UNION ALL SELECT 'taxii', type, count(*) FROM ({ORACLES['stix_indicators']}) GROUP BY 2
    UNION ALL SELECT 'openioc', CASE page_id % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'hash' WHEN 2 THEN 'domain' ELSE 'pattern' END, count(*) FROM pages GROUP BY 2
    UNION ALL SELECT 'misp', 'url', count(*) FROM pages""",
)
def _(spark, sf):
    """Every kind of feed through the one reader."""
    mapped = {"feed_id": "f", "mapping": MAPPING, "as_of": as_of()}
    landed = {"json": (land_json, mapped), "csv": (land_csv, mapped), "taxii": (land_taxii, {}), "openioc": (land_openioc, {}), "misp": (land_misp, {})}
    parts = [S.read_feed(spark, kind, land(spark, sf), **how).select(F.lit(kind).alias("reader"), "type") for kind, (land, how) in landed.items()]
    read = parts[0]
    for part in parts[1:]:
        read = read.unionByName(part)
    return read.groupBy("reader", "type").agg(F.count("*").alias("n"))


@query(
    "manual_import",
    f"""{ctes('indicators')} SELECT feed_id, type, coalesce(threat_level, 'medium') AS threat_level, count(*) AS n, sum(confidence)::BIGINT AS confidence, count_if(active) AS active,
      count_if(last_seen = TIMESTAMP '{AS_OF}') AS seen_now FROM (
      SELECT 1::BIGINT AS feed_id, type, threat_level, CAST(round(confidence * 100) AS INT) AS confidence, active, TIMESTAMP '2024-01-01 00:00:00' AS last_seen FROM indicators
      UNION ALL SELECT 9, type, threat_level, confidence, true, TIMESTAMP '{AS_OF}' FROM ({ORACLES['stix_indicators']})) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    seen = F.lit("2024-01-01 00:00:00").cast("timestamp")
    current = derive(spark, sf, "indicators").select(
        "type", "value", F.lit("").alias("description"), "threat_level", F.round(F.col("confidence") * 100).cast("int").alias("confidence"),
        F.array().cast("array<string>").alias("tags"), seen.alias("first_seen"), seen.alias("last_seen"), "active", F.lit(1).cast("long").alias("feed_id"),
    )
    imported = D.import_indicators(current, S.read_feed(spark, "taxii", land_taxii(spark, sf)), as_of(), 9)
    return imported.groupBy(F.col("feed_id").cast("long").alias("feed_id"), "type", "threat_level").agg(
        F.count("*").alias("n"), F.sum("confidence").cast("long").alias("confidence"), F.count_if("active").alias("active"),
        F.count_if(F.col("last_seen") == as_of()).alias("seen_now"),
    )


# --- sinks, read back ----------------------------------------------------------------------------------------

AUDIT_BYTES = 100_000
LEVEL = "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END"


@query(
    "audit_files",
    f"""SELECT event_id % 2 AS batch, level, count(*) AS n, sum(user_id)::BIGINT AS users, true AS bounded FROM (SELECT *, {LEVEL} AS level FROM events)
    WHERE level <> 'INFO' OR event_id % 2 = 1 GROUP BY 1, 2""",
)
def _(spark, sf):
    """Two batches at two levels, one of them written twice; no file is above its size."""
    path = f"{new_folder(spark)}/audit"
    events = load(spark, sf, "events").select("event_id", "user_id", F.expr(LEVEL).alias("level"))
    for batch, level in ((0, "WARNING"), (1, "INFO"), (0, "WARNING")):
        X.write_audit(events.where(F.col("event_id") % 2 == batch), path, batch=batch, min_level=level, max_bytes=AUDIT_BYTES)
    largest = spark.read.text(path).agg(F.max("_metadata.file_size")).scalar()
    back = X.read_audit(spark, path, events.schema)
    return back.groupBy("batch", "level").agg(F.count("*").alias("n"), F.sum("user_id").alias("users")).withColumn("bounded", largest <= AUDIT_BYTES)


KV_VALUE = """CASE c_custkey % 5 WHEN 0 THEN '"' || c_name || '"' WHEN 1 THEN '{"id":' || c_custkey || ',"name":"' || c_name || '"}' WHEN 2 THEN '[' || c_custkey || ',' || c_nationkey || ']'
    WHEN 3 THEN '["m' || c_custkey || '"]' ELSE '[["m",' || c_nationkey || '.5]]' END"""
KV_KIND = "CASE c_custkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'hash' WHEN 2 THEN 'list' WHEN 3 THEN 'set' ELSE 'zset' END"


@query("kv_export", f"SELECT 'k' || c_custkey AS key, {KV_KIND} AS kind, {KV_VALUE} AS value, c_custkey % 100 AS ttl FROM customer")
def _(spark, sf):
    path = f"{new_folder(spark)}/kv"
    entries = load(spark, sf, "customer").select(
        F.concat(F.lit("k"), "c_custkey").alias("key"), F.expr(KV_KIND).alias("kind"), F.parse_json(F.expr(KV_VALUE)).alias("value"), (F.col("c_custkey") % 100).alias("ttl")
    )
    X.export_kv(entries, path)
    return X.import_kv(spark, path).withColumn("value", F.to_json("value"))


@query(
    "stored_scans",
    f"""{ctes('issues')} SELECT scan_id, count(*) AS n FROM issues WHERE scan_ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}' GROUP BY 1""",
)
def _(spark, sf):
    path = f"{new_folder(spark)}/scans"
    scans = derive(spark, sf, "issues").select("scan_id", "scan_ts", "issue_id")
    for batch in (0, 1, 1):
        X.store_scan(scans.where(F.col("scan_id") % 2 == batch), path, batch=batch)
    return X.read_scans(spark, path, scans.schema, as_of()).groupBy("scan_id").agg(F.count("*").alias("n"))


STATUS = "CASE user_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'passed' END"


@query(
    "report_files",
    f"""SELECT framework, count(*) + 2 AS lines, count_if(status = 'failed') AS failed_blocks, count(*) AS findings, round(count_if(status = 'passed') * 100.0 / count(*), 2)::DOUBLE AS score
    FROM (SELECT 'frame' || (event_id % 3) AS framework, {STATUS} AS status FROM events) GROUP BY 1""",
)
def _(spark, sf):
    """Findings as pages and as JSON, one folder per framework, both read back."""
    folder = new_folder(spark)
    findings = load(spark, sf, "events").select(
        F.concat(F.lit("frame"), F.col("event_id") % 3).alias("framework"), F.concat(F.lit("t<"), "event_id").alias("test_id"), F.concat(F.lit("h"), F.col("user_id") % 9).alias("host"),
        F.expr(STATUS).alias("status"), F.lit("high").alias("severity"), F.col("event_type").alias("details"),
    )
    count = lambda status: F.count_if(F.col("status") == status).alias(status)
    none = [F.lit(0).cast("long").alias(c) for c in ("critical", "medium", "low")]
    summary = findings.groupBy("framework").agg(F.count("*").alias("total"), count("passed"), count("failed"), count("skipped"), F.count("*").alias("high")).select("*", *none)
    scores = summary.select("framework", F.round(F.col("passed") * 100.0 / F.col("total"), 2).alias("score"))
    for fmt in ("html", "json"):
        X.write_report(scores, summary, findings, f"{folder}/{fmt}", fmt)
    pages = spark.read.text(f"{folder}/html").groupBy("framework").agg(
        F.count("*").alias("lines"), F.count_if(F.col("value").startswith('<div class="finding failed high"><p>Test ID: t&lt;')).alias("failed_blocks")
    )
    found = spark.read.schema("framework string").json(f"{folder}/json/findings").groupBy("framework").agg(F.count("*").alias("findings"))
    kept = spark.read.schema("framework string, score double").json(f"{folder}/json/scores")
    return pages.join(found, "framework").join(kept, "framework")


@query(
    "recorded_matches",
    f"""SELECT event_id % 2 AS batch, count(*) AS n, sum(event_id)::BIGINT AS ids, 'blocked' AS action_taken, epoch_us(TIMESTAMP '{AS_OF}') AS at_us FROM events WHERE event_id % 3 = 0 GROUP BY 1""",
)
def _(spark, sf):
    path = f"{new_folder(spark)}/matches"
    matches = load(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("indicator_id"))
    for batch in (0, 1, 1):
        X.record_matches(matches.where(F.col("event_id") % 2 == batch), path, as_of(), batch=batch)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("batch").cast("long").alias("batch"), "action_taken", F.unix_micros("timestamp").alias("at_us")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids")
    )


@query(
    "schema_catalogue",
    """SELECT c_nationkey::BIGINT AS database_id, 't' || (c_custkey % 20) AS table_name, 'c' || c_custkey AS column_name, CASE WHEN c_nationkey % 2 = 0 THEN 'text' ELSE 'bigint' END AS data_type,
      CASE WHEN c_nationkey % 2 = 0 THEN 'v20240120_000000' ELSE 'v20240110_000000' END AS schema_version FROM customer""",
)
def _(spark, sf):
    """Catalogues of all databases, then those of half of them again with other types."""
    path = f"{new_folder(spark)}/catalogue"
    columns = load(spark, sf, "customer")

    def documents(rows, data_type):
        column = F.struct(F.concat(F.lit("c"), "c_custkey").alias("column_name"), F.lit(data_type).alias("data_type"))
        tables = rows.groupBy(F.col("c_nationkey").alias("database_id"), F.concat(F.lit("t"), F.col("c_custkey") % 20).alias("name")).agg(F.collect_list(column).alias("columns"))
        return tables.select("database_id", F.array(F.struct("name", "columns")).alias("tables"))

    X.replace_schema(documents(columns, "bigint"), path, F.lit("2024-01-10 00:00:00").cast("timestamp"))
    X.replace_schema(documents(columns.where(F.col("c_nationkey") % 2 == 0), "text"), path, as_of())
    return spark.read.parquet(path).select(F.col("database_id").cast("long").alias("database_id"), "table_name", "column_name", "data_type", "schema_version")


@query(
    "indicator_snapshots",
    f"""{ctes('indicators')}, days AS (SELECT unnest([0, 3, 10]) AS back) SELECT epoch_us((TIMESTAMP '{AS_OF}' - to_days(back::INT))::DATE::TIMESTAMP) AS day_us, type, count(*) AS n
    FROM indicators, days WHERE back <= 7 AND (back > 0 OR active) GROUP BY 1, 2""",
)
def _(spark, sf):
    """Snapshots of three days, one of them replaced by a later run of the day; the oldest is past its time."""
    path, table = f"{new_folder(spark)}/snapshots", derive(spark, sf, "indicators")
    for back, rows in ((10, table), (3, table), (0, table), (0, table.where("active"))):
        X.snapshot_indicators(rows, path, as_of() - F.make_dt_interval(F.lit(back)))
    kept = X.read_snapshots(spark, path, as_of())
    return kept.groupBy(F.unix_micros(F.col("snapshot_date").cast("timestamp")).alias("day_us"), "type").agg(F.count("*").alias("n"))


# --- streams -------------------------------------------------------------------------------------------------


def drained(steps: list[DataFrame], schema, start: Callable, folder: str) -> None:
    """Lands one step after the other, and runs the stream over what is new each time, from where its checkpoint stands."""
    spark = steps[0].sparkSession
    for number, step in enumerate(steps):
        step.write.parquet(f"{folder}/in/step{number}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        start(stream).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query("screened_stream", ORACLES["screened_log"])
def _(spark, sf):
    """The screened log, as a stream in two runs; each batch is screened as a table, so there may be more indicators than a stream's rows can hold."""
    folder = new_folder(spark)
    log = derive(spark, sf, "query_log").withColumn("table", F.expr(access.TABLE_OF.replace("''", "'users'")))

    def write(batch, batch_id):
        decided = screen_sql(
            batch, rules=M.default_rules(spark), indicators=derive(spark, sf, "indicators"), policy=access.policy(spark, sf), permissions=permissions(spark, sf)
        )
        decided.select("log_id", "stage", "decision").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    drained([log.where("log_id % 2 = 0"), log.where("log_id % 2 = 1")], log.schema, lambda stream: stream.writeStream.foreachBatch(write), folder)
    return spark.read.parquet(f"{folder}/out").select("log_id", "stage", "decision")


@query(
    "live_rules",
    """SELECT c_custkey AS id, 'database' AS kind, CASE WHEN c_custkey % 6 = 0 THEN '^again' ELSE '^db' END || c_custkey || '$' AS pattern FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 6 = 0""",
)
def _(spark, sf):
    """Rule messages in four batches with a merge after each second one: added, added, some removed, some of these added again."""
    folder = new_folder(spark)
    keys = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))

    def messages(rows, op, prefix):
        pattern = F.concat(F.lit(prefix), "id", F.lit("$"))
        return rows.select(F.col("id").alias("seq"), F.lit(op).alias("op"), "id", F.lit("database").alias("kind"), pattern.alias("pattern"), F.lit("why").alias("reason"), F.lit(True).alias("active"))

    steps = [messages(keys.where("id % 2 = 0"), "add", "^db"), messages(keys.where("id % 2 = 1"), "add", "^db"), messages(keys.where("id % 3 = 0"), "remove", ""), messages(keys.where("id % 6 = 0"), "add", "^again")]
    write = changes.record_changes(f"{folder}/rules", merge_every=2)
    drained(steps, steps[0].schema, lambda stream: stream.writeStream.foreachBatch(write), folder)
    return changes.current_rules(spark, f"{folder}/rules").select("id", "kind", "pattern")


BOUNDS = [(str(b).replace(".", "_"), b) for b in packs.LATENCY_BOUNDS]


@query(
    "live_latency",
    f"""SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n, {', '.join(f"count_if(value / 100.0 <= {b}) AS le_{name}" for name, b in BOUNDS)}, round(sum(value / 100.0), 4)::DOUBLE AS total
    FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    """Latency buckets a day, kept by a stream whose later run changes windows of the first; of each window the last row counts."""
    folder = new_folder(spark)
    points = load(spark, sf, "events").select("ts", "event_type", (F.col("value") / 100.0).alias("latency"), "event_id")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    def start(stream):
        return counters.live_histogram(stream, ["event_type"], "latency", window="1 day", lateness="90 days").writeStream.outputMode("update").foreachBatch(write)

    drained([points.where("event_id % 2 = 0"), points.where("event_id % 2 = 1")], points.schema, start, folder)
    changed = spark.read.parquet(f"{folder}/out")
    values = [c for c in changed.columns if c not in ("window_start", "event_type", "batch")]
    last = changed.groupBy(F.unix_micros("window_start").alias("day_us"), "event_type").agg(F.max_by(F.struct(*values), "batch").alias("r")).select("day_us", "event_type", "r.*")
    return last.withColumn("total", F.round("sum", 4)).drop("sum")


SCALED_AT = "(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC')"


@query(
    "live_scaling",
    f"""WITH e AS (SELECT ts, 'i' || (user_id % 10) AS instance_id, value FROM events),
    ends AS (SELECT instance_id, value, epoch_us({SCALED_AT}) + unnest([300000000, 600000000]) AS checked_us FROM e),
    a AS (SELECT instance_id, checked_us, avg(value) AS value FROM ends GROUP BY 1, 2),
    p AS (SELECT n_nationkey AS policy_id, 'i' || (n_nationkey % 10) AS instance_id, 50.0 + n_nationkey AS up, 10.0 + n_nationkey % 5 AS down FROM nation)
    SELECT checked_us, policy_id, instance_id, round(value, 6)::DOUBLE AS value, CASE WHEN value >= up THEN 'scale_up' ELSE 'scale_down' END AS action FROM a JOIN p USING (instance_id) WHERE value >= up OR value <= down""",
)
def _(spark, sf):
    """Decisions every five minutes, from a stream in time order; a last point far ahead closes all windows."""
    folder = new_folder(spark)
    points = load(spark, sf, "events").select(F.concat(F.lit("i"), F.col("user_id") % 10).alias("instance_id"), F.lit("cpu").alias("metric"), "ts", F.col("value").cast("double").alias("value"))
    nations = load(spark, sf, "nation")
    policies = nations.select(
        F.col("n_nationkey").alias("policy_id"), F.concat(F.lit("i"), F.col("n_nationkey") % 10).alias("instance_id"), F.lit("cpu").alias("metric_type"),
        (50.0 + F.col("n_nationkey")).alias("scale_up_threshold"), (10.0 + F.col("n_nationkey") % 5).alias("scale_down_threshold"),
    )
    half = points.agg(F.timestamp_micros(F.expr("(unix_micros(min(ts)) + unix_micros(max(ts))) div 2"))).scalar()
    flush = points.agg((F.max("ts") + F.make_dt_interval(F.lit(30))).alias("ts")).select(F.lit("none").alias("instance_id"), F.lit("cpu").alias("metric"), "ts", F.lit(0.0).alias("value"))
    steps = [points.where(F.col("ts") < half), points.where(F.col("ts") >= half), flush]

    def start(stream):
        return counters.live_scaling(stream, policies, lateness="10 minutes").writeStream.format("parquet").option("path", f"{folder}/out")

    drained(steps, points.schema, start, folder)
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.unix_micros("checked_at").alias("checked_us"), "policy_id", "instance_id", F.round("value", 6).alias("value"), "action")


@query(
    "tuner_batches",
    """WITH RECURSIVE m AS (SELECT event_id % 4 AS k, event_id % 3 AS j, avg(value) AS value FROM events GROUP BY 1, 2),
    met AS (SELECT n_nationkey AS r, k, value > n_nationkey * 4.0 AS met FROM nation JOIN m ON j = n_nationkey % 3),
    walk AS (SELECT n_nationkey AS r, -1::BIGINT AS k, NULL::BIGINT AS last, false AS applied FROM nation
      UNION ALL SELECT r, k, CASE WHEN ok THEN k ELSE last END, ok FROM (
        SELECT walk.r, walk.k + 1 AS k, last, met.met AND (last IS NULL OR (walk.k + 1 - last) * 60 >= walk.r * 10) AS ok FROM walk JOIN met ON met.r = walk.r AND met.k = walk.k + 1))
    SELECT k AS batch, 'rule' || r AS name FROM walk WHERE applied""",
)
def _(spark, sf):
    """The tuner over four snapshots, a minute apart, under rules with different cooldowns."""
    folder = new_folder(spark)
    condition = F.struct(
        F.concat(F.lit("m"), F.col("n_nationkey") % 3).alias("metric"), F.lit("gt").alias("operator"), (F.col("n_nationkey") * 4.0).alias("value"), F.lit(1.0).alias("weight")
    )
    rules = load(spark, sf, "nation").select(
        F.concat(F.lit("rule"), "n_nationkey").alias("name"), F.lit(True).alias("enabled"), F.lit(1).alias("priority"), (F.col("n_nationkey") * 10).alias("cooldown_s"), F.array(condition).alias("conditions")
    )
    event = F.col("event_id")
    metrics = load(spark, sf, "events").groupBy((event % 4).alias("snapshot_id"), F.concat(F.lit("m"), event % 3).alias("metric")).agg(F.avg("value").alias("value"))
    write = changes.tuner_cycle(spark, rules, f"{folder}/applied", lambda batch: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * batch)))
    steps = [metrics.where(F.col("snapshot_id") == k) for k in range(4)]
    drained(steps, metrics.schema, lambda stream: stream.writeStream.foreachBatch(write), folder)
    applied = spark.read.schema("name string, applied_at timestamp, batch long").parquet(f"{folder}/applied")
    return applied.select("batch", "name")


@query(
    "live_expiry",
    """SELECT 'v' || (user_id % 70) AS value, epoch_us(max(ts)) + 86400000000 * (1 + user_id % 70 % 3) AS expired_us FROM events GROUP BY user_id % 70""",
)
def _(spark, sf):
    """Indicators that run out one to three days after they were last seen; a last sighting far ahead lets time pass."""
    use_keyed_state(spark)
    folder = new_folder(spark)
    kind = F.col("user_id") % 70
    seen = load(spark, sf, "events").select(
        F.concat(F.lit("v"), kind).alias("value"), "ts", (F.col("ts") + F.make_dt_interval(F.lit(1) + (kind % 3).cast("int"))).alias("expires_at")
    )
    last = seen.agg((F.max("ts") + F.make_dt_interval(F.lit(30))).alias("ts")).select(F.lit("later").alias("value"), "ts", F.lit(None).cast("timestamp").alias("expires_at"))

    def start(stream):
        return expired_stream(stream, "value", "ts", "expires_at", lateness="60 days").writeStream.format("parquet").option("path", f"{folder}/out")

    ahead = last.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(60)))
    drained([seen.where("value < 'v4'"), seen.where("value >= 'v4'"), ahead], seen.schema, start, folder)
    return spark.read.parquet(f"{folder}/out")
