"""Feed readers on hand-made files, feed processing, merges, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from wiretally.operators import feeds as D
from wiretally.operators import findings as G
from wiretally.operators import quality as QJ
from wiretally.functions import quality as Q
from wiretally.sources import feeds as S
from wiretally.sources import files as X

def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


BUNDLE = {
    "type": "bundle",
    "objects": [
        {"type": "indicator", "pattern": "[ipv4-addr:value = '1.2.3.4']", "labels": ["bad", "High"], "created": "2024-01-01T00:00:00Z"},
        {"type": "indicator", "pattern": "[domain-name:value = 'x.org']", "labels": ["low"], "kill_chain_phases": [{"phase_name": "critical"}]},
        {"type": "indicator", "pattern": "[url:value = 'http://x/y']", "kill_chain_phases": [{"phase_name": "high"}]},
        {"type": "indicator", "pattern": "[file:hashes.MD5 = 'abc']", "valid_until": "2025-01-01T00:00:00Z", "description": "d"},
        {"type": "indicator", "pattern": "[url:value = broken"},
        {"type": "malware", "name": "worm", "labels": ["x"], "description": "eats"},
        {"type": "threat-actor", "description": "who"},
        {"type": "relationship"},
    ],
}


def test_stix(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(BUNDLE, indent=1))
    rows = S.read_stix(spark, str(tmp_path / "b.json")).collect()
    got = {(r.type, r.value): (r.threat_level, r.confidence, r.tags) for r in rows}
    assert got == {
        ("ip", "1.2.3.4"): ("high", 75, ["bad", "High"]),
        ("domain", "x.org"): ("critical", 75, ["low", "critical"]),
        ("url", "http://x/y"): ("medium", 75, ["high"]),
        ("hash", "abc"): ("medium", 75, []),
        ("pattern", "[url:value = broken"): ("medium", 75, []),
        ("pattern", "worm"): ("high", 80, ["x", "malware"]),
        ("pattern", "unknown"): ("high", 70, ["threat-actor"]),
    }
    by_value = {r.value: r for r in rows}
    assert by_value["worm"].description == "Malware: eats"
    assert str(by_value["abc"].expires) == "2025-01-01 00:00:00" and by_value["worm"].expires is None


def test_taxii_envelopes(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "a.json").write_text(json.dumps(BUNDLE))
    (tmp_path / "b.json").write_text(json.dumps({"objects": BUNDLE["objects"][:1]}))
    (tmp_path / "root.json").write_text(json.dumps({"collections": [{"id": "1"}]}))
    assert S.read_taxii(spark, str(tmp_path)).count() == 8


IOC = """<?xml version="1.0"?>
<OpenIOC xmlns="http://openioc.org/schemas/OpenIOC_1.1" id="ioc-1">
 <metadata><short_description>Short</short_description><description>Long</description>
  <links><link rel="category">apt</link><link rel="other">no</link><link rel="category">rat</link></links></metadata>
 <criteria><Indicator operator="OR">
  <IndicatorItem><Context search="Network/RemoteIP" type="mir"/><Content type="IP">1.1.1.1</Content></IndicatorItem>
  <Indicator operator="AND">
   <IndicatorItem><Context search="FileItem/Md5sum"/><Content type="md5">aa</Content></IndicatorItem>
   <IndicatorItem><Context search="UrlHistoryItem/URL"/><Content type="string">http://z</Content></IndicatorItem>
   <IndicatorItem><Context search="Email/From"/><Content type="string"></Content></IndicatorItem>
   <IndicatorItem><Context search="Email/From"/><Content type="string">a@b.c</Content></IndicatorItem>
   <IndicatorItem><Context search="Sql/Query"/><Content type="string">drop</Content></IndicatorItem>
   <IndicatorItem><Context search="Browser/UserAgent"/><Content type="string">curl</Content></IndicatorItem>
   <IndicatorItem><Context search="DnsEntryItem/Host"/><Content type="string">h.org</Content></IndicatorItem>
   <IndicatorItem><Context search="Registry/Key"/><Content type="string">k</Content></IndicatorItem>
  </Indicator></Indicator></criteria>
</OpenIOC>"""


def test_openioc(spark, tmp_path):
    (tmp_path / "i.ioc").write_text(IOC)
    rows = S.read_openioc(spark, str(tmp_path / "i.ioc")).collect()
    assert {(r.type, r.value) for r in rows} == {
        ("ip", "1.1.1.1"), ("hash", "aa"), ("url", "http://z"), ("email", "a@b.c"), ("sql_pattern", "drop"), ("user_agent", "curl"),
        ("domain", "h.org"), ("pattern", "k"),
    }
    assert {tuple(r.tags) for r in rows} == {("openioc", "apt", "rat")}
    assert {(r.description, r.threat_level, r.confidence) for r in rows} == {("Short (IOC: ioc-1)", "medium", 60)}


def test_misp(spark, tmp_path):
    event = {
        "Event": {
            "threat_level_id": 2, "info": "inf", "Tag": [{"name": "t1"}],
            "Attribute": [
                {"type": "ip-src", "value": "1.1.1.1", "to_ids": True, "comment": "c", "timestamp": "1704067200"},
                {"type": "email-src", "value": "a@b"}, {"type": "comment", "value": "x"}, {"type": "url", "value": ""},
            ],
            "Object": [{"name": "file", "Attribute": [{"type": "sha256", "value": "ff"}, {"type": "email", "value": "q@r", "comment": "k"}]}],
        }
    }
    (tmp_path / "m.json").write_text(json.dumps(event))
    (tmp_path / "n.json").write_text(json.dumps({"Attribute": [{"type": "Domain", "value": "d.org"}]}))
    got = {r.value: (r.type, r.confidence, r.threat_level, r.description, r.tags) for r in S.read_misp(spark, str(tmp_path)).collect()}
    assert got == {
        "1.1.1.1": ("ip", 100, "high", "c", ["t1", "ip-src", "misp"]),
        "a@b": ("email", 50, "high", "inf", ["t1", "email-src", "misp"]),
        "x": ("pattern", 50, "high", "inf", ["t1", "comment", "misp"]),
        "ff": ("hash", 75, "high", "file: ", ["t1", "sha256", "misp", "file"]),
        "q@r": ("pattern", 75, "high", "file: k", ["t1", "email", "misp", "file"]),
        "d.org": ("domain", 50, "medium", "", ["domain", "misp"]),
    }


def test_mapped_json_and_csv(spark, tmp_path):
    mapping = {"type": "kind", "value": "ind", "confidence": "score", "severity": "sev", "categories": "cats", "tags": "tags", "expires_at": "until"}
    items = [
        {"kind": "ip", "ind": "1.1.1.1", "score": 0.9, "sev": "high", "cats": "a,b", "until": "2024-07-01T00:00:00Z", "_x": 1, "extra": {"n": 1}},
        {"kind": "", "ind": "x"}, {"kind": "url", "ind": None}, {"kind": "domain", "ind": "d.org", "until": "bad"},
    ]
    (tmp_path / "f.json").write_text(json.dumps(items))
    rows = {r.value: r for r in S.read_json_feed(spark, str(tmp_path / "f.json"), "f1", mapping, as_of()).collect()}
    assert set(rows) == {"1.1.1.1", "d.org"}
    first = rows["1.1.1.1"]
    assert first.id == "f1_ip_" + __import__("hashlib").md5(b"1.1.1.1").hexdigest()
    assert (first.confidence, first.categories, first.tlp, first.sources) == (0.9, ["a", "b"], "amber", ["f1"])
    assert "_x" not in first.metadata and first.metadata["extra"] == '{"n":1}'
    assert rows["d.org"].expires_at is None and rows["d.org"].confidence == 0.0
    (tmp_path / "f.csv").write_text("kind,ind, score\nip , 2.2.2.2 ,0.5\nshort,row\nurl,http://a,0.7,extra\ndomain,,1\nhash,ff,x\n")
    got = {r.value: (r.type, r.confidence) for r in S.read_csv_feed(spark, str(tmp_path / "f.csv"), "f2", mapping, as_of()).collect()}
    assert got == {"2.2.2.2": ("ip", 0.5), "ff": ("hash", 0.0)}


def test_reader_registry(spark, tmp_path):
    with pytest.raises(ValueError):
        S.read_feed(spark, "rss", str(tmp_path))


def test_filters_mismatch_is_false(spark):
    df = spark.createDataFrame([("ip", "v", 0.5, "high", {"n": "3", "s": "abc"})], "type string, value string, confidence double, severity string, metadata map<string,string>")
    keep = lambda **f: D.apply_filters(df, [f]).count()
    assert keep(field="type", operator="equals", value="ip") == 1
    assert keep(field="confidence", operator="equals", value=0.5) == 1
    assert keep(field="confidence", operator="contains", value="5") == 0
    assert keep(field="type", operator="gt", value=1.0) == 0
    assert keep(field="n", operator="gt", value=2.0) == 1
    assert keep(field="s", operator="contains", value="bc") == 1
    assert keep(field="missing", operator="equals", value="x") == 0
    assert keep(field="type", operator="like", value="ip") == 0


def test_import_keeps_duplicates(spark):
    current = spark.createDataFrame([], "type string, value string, threat_level string, confidence int, description string, tags array<string>, first_seen timestamp, last_seen timestamp, expires timestamp, active boolean, feed_id int")
    parsed = spark.createDataFrame([("ip", "a", None, None, None, None, None)] * 2, "type string, value string, threat_level string, confidence int, description string, tags array<string>, expires timestamp")
    rows = D.import_indicators(current, parsed.withColumn("first_seen", F.lit(None).cast("timestamp")), as_of(), 4).collect()
    assert len(rows) == 2 and rows[0].threat_level == "medium" and rows[0].confidence == 50 and rows[0].feed_id == 4 and rows[0].active


def test_custom_indicator_gets_manual_source(spark):
    columns = "id string, confidence double, sources array<string>, first_seen timestamp, last_seen timestamp"
    current = spark.createDataFrame([("a", 0.1, ["f"], None, None)], columns)
    manual = spark.createDataFrame([("a", 0.9, [], None, None, 1), ("b", 0.8, None, None, None, 2)], columns + ", seq long")
    got = {r.id: (r.confidence, r.sources) for r in D.add_custom(current, manual, as_of()).collect()}
    assert got == {"a": (0.1, ["f", "manual"]), "b": (0.8, ["manual"])}


# --- files -------------------------------------------------------------------------------------------


def test_sql_files(spark, tmp_path):
    (tmp_path / "good.sql").write_text("select\n 1")
    (tmp_path / "bad.sql").write_text("exec(x")
    (tmp_path / "note.txt").write_text("x")
    rows = {r.name: r for r in X.scan_sql_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"good.sql", "bad.sql"}
    assert rows["good.sql"].security_validated and rows["good.sql"].file_size == 9 and rows["good.sql"].validation_errors == "[]"
    assert not rows["bad.sql"].security_validated and not rows["bad.sql"].syntax_validated


def test_scans_of_the_last_days(spark, tmp_path):
    scans = spark.createDataFrame([(i, f"2024-05-{20 + i:02d} 12:00:00") for i in range(11)], "scan_id long, d string")
    scans = scans.select("scan_id", F.col("d").cast("timestamp").alias("scan_ts"))
    for batch in (0, 0):  # a batch that is stored again replaces itself
        X.store_scan(scans, str(tmp_path / "scans"), batch=batch)
    back = X.read_scans(spark, str(tmp_path / "scans"), scans.schema, as_of())
    assert [r.scan_id for r in back.collect()] == [5, 6, 7, 8, 9, 10]
    assert "PartitionFilters: [isnotnull(scan_date" in back._jdf.queryExecution().toString()


def test_audit_export_and_snapshots(spark, tmp_path):
    events = spark.createDataFrame([(i, lv) for i, lv in enumerate(["INFO", "WARNING", "CRITICAL", "INFO"])], "i int, level string")
    X.write_audit(events, str(tmp_path / "audit"), batch=0, min_level="WARNING", max_bytes=1)
    assert spark.read.text(str(tmp_path / "audit")).count() == 2
    assert sorted(r.i for r in X.read_audit(spark, str(tmp_path / "audit"), events.schema).collect()) == [1, 2]
    X.export_kv(spark.createDataFrame([("k", "string", "v", 5)], "key string, kind string, value string, ttl int"), str(tmp_path / "kv"))
    assert spark.read.json(str(tmp_path / "kv")).first().type == "string"
    assert any(p.name.endswith(".json.gz") for p in (tmp_path / "kv").iterdir())
    table = spark.createDataFrame([("ip", "v")], "type string, value string")
    for day in ("2024-05-20", "2024-05-30", "2024-05-30"):
        X.snapshot_indicators(table, str(tmp_path / "snap"), F.lit(day).cast("timestamp"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2
    assert X.read_snapshots(spark, str(tmp_path / "snap"), as_of()).count() == 1
    matches = spark.createDataFrame([(1, 5), (2, None)], "log_id int, indicator_id int")
    for _ in range(2):
        X.record_matches(matches, str(tmp_path / "matches"), as_of(), batch=3)
    assert spark.read.parquet(str(tmp_path / "matches")).count() == 1
    assert spark.read.parquet(str(tmp_path / "matches")).first().action_taken == "blocked"


def test_schema_replacement_leaves_other_databases(spark, tmp_path):
    ddl = "database_id int, tables array<struct<name:string, columns:array<struct<column_name:string, data_type:string>>>>"
    first = spark.createDataFrame([(1, [("t", [("a", "int"), ("b", "int")])]), (2, [("u", [("c", "int")])])], ddl)
    second = spark.createDataFrame([(1, [("t", [("z", "int")])])], ddl)
    X.replace_schema(first, str(tmp_path / "cat"), as_of())
    X.replace_schema(second, str(tmp_path / "cat"), as_of())
    rows = spark.read.parquet(str(tmp_path / "cat")).collect()
    assert {(r.database_id, r.column_name) for r in rows} == {(1, "z"), (2, "c")}
    assert {r.schema_version for r in rows} == {"v20240601_000000"}


def test_published_snapshot(spark, tmp_path):
    rules = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, pattern string, active boolean")
    X.publish_snapshot({"rules": (rules, "id")}, str(tmp_path / "conf"))
    rows = spark.read.json(str(tmp_path / "conf")).collect()
    assert [(r.section, r.key) for r in rows] == [("rules", "1")]


def test_reports(spark, tmp_path):
    inventory = spark.createDataFrame([("h<1>", [22, 23], 12, True, True, True, True)], "host string, open_ports array<int>, min_length int, upper boolean, lower boolean, digits boolean, special boolean")
    found = G.compliance_tests(inventory)
    scores, summary = G.compliance_score(found), G.compliance_summary(found)
    X.write_report(scores, summary, found, str(tmp_path / "html"), "html")
    folder = tmp_path / "html" / "framework=network"
    page = "".join(p.read_text() for p in sorted(folder.iterdir()) if p.name.startswith("part-"))
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</html>")
    assert "Details: 23" in page and 'class="finding fail high"' in page
    X.write_report(scores, summary, found, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "scores")).count() == 4


# --- column quality -------------------------------------------------------------------------------------


def results(spark, values, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [(r.r.is_valid, r.r.value, r.r.error) for r in df.select("i", rule(F.col("v")).alias("r")).orderBy("i").collect()]


def valid(spark, values, rule):
    return [r[0] for r in results(spark, values, rule)]


def test_rules(spark):
    assert valid(spark, [" x ", "  ", None], Q.not_empty) == [True, False, False]
    assert valid(spark, ["ab", "abc", "abcdef"], Q.length(3, 5)) == [False, True, False]
    assert valid(spark, ["a_b", "a-b", "ab\n", ""], Q.alphanumeric(underscore=True)) == [True, False, False, False]
    assert valid(spark, ["a-b", "A-b", "a--b", "-a"], Q.slug) == [True, False, False, False]
    assert valid(spark, ["5", "+5", "5.0", "1e3", " 7 ", "x", ""], Q.integer) == [True, True, False, False, True, False, False]
    assert valid(spark, ["5", "1.5", "1e3", "x"], Q.number) == [True, True, True, False]
    assert valid(spark, ["0", "1", "-1"], Q.signed(False, True)) == [True, False, True]
    assert valid(spark, ["12:30:00", "25:00:00", "12:30"], Q.temporal("time")) == [True, False, False]
    assert valid(spark, ["2024-02-30", "2024-02-29", "24-1-1"], Q.temporal()) == [False, True, False]
    assert valid(spark, ["A@b.co", "a@b", "@b.co", "a" * 65 + "@b.co", " a@b.co "], Q.email) == [True, False, False, False, True]
    assert valid(spark, ["http://a.b", "ftp://a.b", "http://box", "http://localhost:1/x", "http:///x", "x"], Q.url()) == [True, False, False, True, False, False]
    assert valid(spark, ["::1", "1.2.3.4", "01.2.3.4", "1::2::3", "fe80::1"], Q.ip_address()) == [True, True, False, False, True]
    assert valid(spark, ["a.b", "-a", "a..b", "x" * 64, "a"], Q.hostname(require_tld=True)) == [True, False, False, False, False]
    assert results(spark, ["abc"], Q.password("moderate"))[0][2] == (
        "Password must be at least 8 characters; Password must contain at least one uppercase letter; Password must contain at least one digit"
    )
    assert results(spark, ["  Ab  "], Q.chain(Q.trimmed(), Q.length(3)))[0] == (False, None, "Value must be at least 3 characters")
    assert results(spark, ["  Abc "], Q.chain(Q.trimmed(), Q.length(3)))[0] == (True, "Abc", None)


def test_password_scores(spark):
    df = spark.createDataFrame([("password",), ("Ab1!xyzw",), ("",), ("aaaa",)], "v string")
    assert [r.s for r in df.select(Q.password_score(F.col("v")).alias("s")).collect()] == [43, 86, 10, 23]


def test_sanitizers(spark):
    def apply(fn, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]

    assert apply(Q.escape_html, "<a href='x'>&\"</a>") == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;&lt;&#x2F;a&gt;"]
    html = "a<script>if (1<2) x('</p>')</script>b<p onclick=\"x\" class=c onload=y>JavaScript:z<iframe src=q><b></b></iframe><object><i></i></object>"
    assert apply(Q.strip_active_html, html) == ["ab<p class=c>z"]
    assert apply(Q.strip_sql_tokens, "SELSELECTECT 'a'; -- DROP", "exec execute") == ["SELECT a  ", " "]
    assert apply(Q.safe_path, "a/./b", "a/../b", "../a", "/a", "a..b", "a/..", "x//y/") == ["a/b", "b", None, None, None, ".", "x/y/"]
    assert apply(Q.clean_url, " https://a ", "javascript:x", "/a", "foo", "mailto:a") == ["https://a", None, "/a", None, "mailto:a"]
    assert apply(Q.clean_email, " A@B.co ", "a@b") == ["a@b.co", None]


def test_quality_job(spark):
    rows = spark.createDataFrame([("n", "mysql", "h", "1", "both"), ("", "x", "h", "p", "both")], "name string, type string, host string, port string, role string")
    good, bad, report = QJ.check_columns(rows, QJ.TABLE_RULES["database_server"])
    assert good.count() == 1 and good.columns == rows.columns
    assert [e.split(":")[0] for e in bad.first().errors] == ["name", "type", "port"]
    assert {(r.column, r.invalid) for r in report.collect()} == {("name", 1), ("type", 1), ("host", 0), ("port", 1), ("role", 0)}


def test_audit_files_are_packed_by_bytes(spark, tmp_path):
    events = spark.range(500).select(F.col("id").alias("i"), F.repeat(F.lit("é"), (F.col("id") % 40).cast("int")).alias("text"), F.lit("INFO").alias("level")).coalesce(2)
    for _ in range(2):
        X.write_audit(events, str(tmp_path / "audit"), batch=7, max_bytes=600)
    sizes = [p.stat().st_size for p in (tmp_path / "audit").rglob("part-*")]
    assert max(sizes) <= 600 and sum(sizes) > 600 * (len(sizes) - 2) * 0.8
    back = X.read_audit(spark, str(tmp_path / "audit"), events.schema)
    assert sorted(r.i for r in back.collect()) == list(range(500)) and {r.batch for r in back.collect()} == {7}
    X.write_audit(spark.createDataFrame([(1, "x" * 900, "INFO")], "i long, text string, level string"), str(tmp_path / "one"), batch=0, max_bytes=600)
    assert X.read_audit(spark, str(tmp_path / "one"), events.schema).count() == 1


def test_typed_values_survive_export(spark, tmp_path):
    values = {"string": '"a\\"b\\u00e9"', "hash": '{"f":"v","g":null}', "list": '["x","x"]', "set": "[]", "zset": '[["m",1.5],["n",-2]]'}
    rows = spark.createDataFrame([(f"k-{k}", k, v, 5) for k, v in values.items()] + [("k", "stream", "1", None)], "key string, kind string, text string, ttl long")
    X.export_kv(rows.select("key", "kind", F.parse_json("text").alias("value"), "ttl"), str(tmp_path / "kv"))
    back = X.import_kv(spark, str(tmp_path / "kv")).select("kind", F.to_json("value").alias("text"), F.schema_of_variant("value").alias("shape")).collect()
    assert {r.kind: json.loads(r.text) for r in back} == {k: json.loads(v) for k, v in values.items()}
    assert {r.kind: r["shape"].split("<")[0] for r in back}["zset"] == "ARRAY"
