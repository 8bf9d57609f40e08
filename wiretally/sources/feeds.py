"""Readers for threat-feed files: STIX, TAXII envelopes, OpenIOC, MISP, mapped JSON and CSV.

Each gives ``type, value, description, threat_level, confidence, tags, first_seen, expires``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STIX_SCHEMA = (
    "objects array<struct<type:string, name:string, description:string, pattern:string, "
    "labels:array<string>, created:string, valid_until:string, "
    "kill_chain_phases:array<struct<phase_name:string>>>>"
)
_MISP_ATTRIBUTE = "struct<type:string, value:string, comment:string, to_ids:boolean, timestamp:string>"
_MISP_EVENT = (
    "threat_level_id:string, info:string, Tag:array<struct<name:string>>, "
    f"Attribute:array<{_MISP_ATTRIBUTE}>, Object:array<struct<name:string, Attribute:array<{_MISP_ATTRIBUTE}>>>"
)
MISP_SCHEMA = f"struct<Event:struct<{_MISP_EVENT}>, {_MISP_EVENT}>"

# --- fixed values: severity names and type maps -------------------------------------------------------

LEVELS = ["low", "medium", "high", "critical"]
STIX_PATTERNS = [
    ("[ipv4-addr:value =", r"\[ipv4-addr:value = '([^']+)'\]", "ip"),
    ("[domain-name:value =", r"\[domain-name:value = '([^']+)'\]", "domain"),
    ("[url:value =", r"\[url:value = '([^']+)'\]", "url"),
    ("[file:hashes.", r"\[file:hashes\.\w+\s*=\s*'([^']+)'\]", "hash"),
]
IOC_TYPES = [
    (["ipv4", "remoteip"], "ip"),
    (["hostname", "dns"], "domain"),
    (["url", "uri"], "url"),
    (["md5", "sha", "hash"], "hash"),
    (["email"], "email"),
    (["useragent"], "user_agent"),
    (["sql", "query"], "sql_pattern"),
]
MISP_LEVELS = {"1": "critical", "2": "high", "3": "medium", "4": "low"}
MISP_OBJECT_TYPES = {
    "ip": ["ip-src", "ip-dst", "ip"],
    "domain": ["domain", "hostname"],
    "url": ["url", "uri"],
    "hash": ["md5", "sha1", "sha256", "sha512"],
}
MISP_TYPES = {
    **MISP_OBJECT_TYPES,
    "hash": ["md5", "sha1", "sha256", "sha512", "hash"],
    "email": ["email", "email-src", "email-dst"],
    "user_agent": ["user-agent"],
}

_NO_TEXTS = "array<string>"


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NO_TEXTS))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stix_indicators(bundles: DataFrame) -> DataFrame:
    """``indicator``, ``malware`` and ``threat-actor`` objects of STIX 2 bundles (``objects`` column)."""
    o = bundles.select(F.explode("objects").alias("o")).select("o.*")
    o = o.filter(F.col("type").isin("indicator", "malware", "threat-actor"))
    is_indicator, is_malware = F.col("type") == "indicator", F.col("type") == "malware"
    pattern, labels = _or_empty(F.col("pattern")), _texts(F.col("labels"))
    phases = F.transform(
        F.coalesce(F.col("kill_chain_phases"), F.array().cast("array<struct<phase_name:string>>")),
        lambda p: _or_empty(p["phase_name"]),
    )
    kind, value = F.lit("pattern"), pattern
    for mark, regex, name in reversed(STIX_PATTERNS):
        got = F.regexp_extract(pattern, regex, 1)
        here = pattern.contains(mark)
        kind = F.when(here, F.when(got != "", F.lit(name)).otherwise(F.lit("pattern"))).otherwise(kind)
        value = F.when(here, F.when(got != "", got).otherwise(pattern)).otherwise(value)
    # phase names take part in the level only where the object carries labels at all
    named = F.filter(
        F.transform(F.when(F.col("labels").isNotNull(), F.concat(labels, phases)).otherwise(labels), F.lower),
        lambda x: x.isin(LEVELS),
    )
    level = F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("medium"))
    name = F.coalesce(F.col("name"), F.lit("unknown"))
    about = _or_empty(F.col("description"))
    return o.select(
        F.when(is_indicator, kind).otherwise(F.lit("pattern")).alias("type"),
        F.when(is_indicator, value).otherwise(name).alias("value"),
        F.when(is_indicator, about)
        .when(is_malware, F.concat(F.lit("Malware: "), about))
        .otherwise(F.concat(F.lit("Threat Actor: "), about))
        .alias("description"),
        F.when(is_indicator, level).otherwise(F.lit("high")).alias("threat_level"),
        F.when(is_indicator, 75).when(is_malware, 80).otherwise(70).alias("confidence"),
        F.when(is_indicator, F.concat(labels, phases))
        .otherwise(F.concat(labels, F.array(F.col("type"))))
        .alias("tags"),
        F.col("created").try_cast("timestamp").alias("first_seen"),
        F.when(is_indicator, F.col("valid_until").try_cast("timestamp")).alias("expires"),
    )


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    return stix_indicators(spark.read.schema(STIX_SCHEMA).option("multiLine", True).json(path))


def read_taxii(spark: SparkSession, folder: str) -> DataFrame:
    """Landed TAXII 2 envelopes, one file per collection; envelopes without objects add nothing."""
    files = spark.read.schema(STIX_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
    return stix_indicators(files.json(folder))


def read_openioc(spark: SparkSession, path: str) -> DataFrame:
    """IndicatorItem elements at any depth; document facts are joined by file."""
    items = (
        spark.read.format("xml")
        .option("rowTag", "IndicatorItem")
        .option("ignoreNamespace", True)
        .schema("Context struct<_search:string>, Content struct<_VALUE:string, _type:string>")
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.lower(_or_empty(F.col("Context._search"))).alias("search"),
            F.col("Content._VALUE").alias("value"),
            F.col("Context").isNotNull().alias("has_context"),
        )
        .filter(F.col("has_context") & (_or_empty(F.col("value")) != ""))
    )
    local = lambda name: f"//*[local-name()='{name}']"
    text = spark.read.text(path, wholetext=True)
    first = lambda name: F.xpath_string("value", F.lit(f"({local(name)})[1]"))
    documents = text.select(
        F.col("_metadata.file_path").alias("_file"),
        F.xpath_string("value", F.lit("/*/@id")).alias("ioc_id"),
        F.coalesce(F.nullif(first("short_description"), F.lit("")), first("description")).alias("about"),
        F.xpath("value", F.lit(f"{local('link')}[@rel='category']/text()")).alias("categories"),
    )
    kind = F.lit("pattern")
    for parts, name in reversed(IOC_TYPES):
        hit = reduce(lambda a, b: a | b, [F.col("search").contains(p) for p in parts])
        kind = F.when(hit, F.lit(name)).otherwise(kind)
    ioc_id = F.coalesce(F.nullif(F.col("ioc_id"), F.lit("")), F.lit("unknown"))
    return items.join(documents, F.col("file") == F.col("_file")).select(
        kind.alias("type"),
        "value",
        F.concat(_or_empty(F.col("about")), F.lit(" (IOC: "), ioc_id, F.lit(")")).alias("description"),
        F.lit("medium").alias("threat_level"),
        F.lit(60).alias("confidence"),
        F.concat(F.array(F.lit("openioc")), F.col("categories")).alias("tags"),
        F.lit(None).cast("timestamp").alias("first_seen"),
        F.lit(None).cast("timestamp").alias("expires"),
    )


def _misp_type(attribute: Column, types: dict[str, list[str]]) -> Column:
    out = F.lit("pattern")
    for name, sources in types.items():
        out = F.when(attribute.isin(sources), F.lit(name)).otherwise(out)
    return out


def misp_indicators(events: DataFrame) -> DataFrame:
    """Attributes and object attributes of MISP events."""
    event = F.coalesce(
        F.col("Event"), F.struct(*[F.col(c) for c in ("threat_level_id", "info", "Tag", "Attribute", "Object")])
    )
    e = events.select(event.alias("e")).select("e.*")
    level = reduce(
        lambda acc, kv: F.when(F.coalesce(F.col("threat_level_id"), F.lit("3")) == kv[0], F.lit(kv[1])).otherwise(acc),
        MISP_LEVELS.items(),
        F.lit("medium"),
    )
    tags = F.transform(
        F.coalesce(F.col("Tag"), F.array().cast("array<struct<name:string>>")), lambda t: _or_empty(t["name"])
    )
    head = e.withColumn("level", level).withColumn("event_tags", tags)
    direct = head.select("level", "event_tags", "info", F.explode("Attribute").alias("a"))
    objects = head.select("level", "event_tags", F.explode("Object").alias("o")).select(
        "level", "event_tags", F.col("o.name").alias("object"), F.explode("o.Attribute").alias("a")
    )
    kind = F.lower(_or_empty(F.col("a.type")))
    seen = F.coalesce(
        F.timestamp_seconds(F.col("a.timestamp").try_cast("bigint")), F.col("a.timestamp").try_cast("timestamp")
    )
    common = lambda types: [_misp_type(kind, types).alias("type"), F.col("a.value").alias("value")]
    dates = [seen.alias("first_seen"), F.lit(None).cast("timestamp").alias("expires")]
    first = direct.select(
        *common(MISP_TYPES),
        F.coalesce(F.nullif(F.col("a.comment"), F.lit("")), _or_empty(F.col("info"))).alias("description"),
        F.col("level").alias("threat_level"),
        F.when(F.col("a.to_ids"), 100).otherwise(50).alias("confidence"),
        F.concat("event_tags", F.array(kind, F.lit("misp"))).alias("tags"),
        *dates,
    )
    second = objects.select(
        *common(MISP_OBJECT_TYPES),
        F.concat(
            F.coalesce(F.col("object"), F.lit("Object")), F.lit(": "), _or_empty(F.col("a.comment"))
        ).alias("description"),
        F.col("level").alias("threat_level"),
        F.lit(75).alias("confidence"),
        F.concat("event_tags", F.array(kind, F.lit("misp"), _or_empty(F.col("object")))).alias("tags"),
        *dates,
    )
    return first.unionByName(second).filter(_or_empty(F.col("value")) != "")


def _struct(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


def read_misp(spark: SparkSession, path: str) -> DataFrame:
    return misp_indicators(spark.read.schema(_struct(MISP_SCHEMA)).option("multiLine", True).json(path))


def mapped_indicators(rows: DataFrame, feed_id: str, mapping: dict[str, str], as_of: Column) -> DataFrame:
    """Rows of any shape to indicators, by configured field names (``type, value, confidence,
    severity, categories, tags, expires_at``). Rows without type or value are dropped."""

    def text(name: str) -> Column:
        source = mapping.get(name)
        return F.col(f"`{source}`").cast("string") if source in rows.columns else F.lit(None).cast("string")

    def plain(c: str) -> Column:
        simple = not rows.schema[c].dataType.simpleString().startswith(("struct", "array", "map"))
        return F.col(f"`{c}`").cast("string") if simple else F.to_json(F.col(f"`{c}`"))

    public = [c for c in rows.columns if not c.startswith("_")]
    metadata = F.map_filter(
        F.create_map(*[x for c in public for x in (F.lit(c), plain(c))]), lambda k, v: v.isNotNull()
    )
    listed = lambda name: F.when(text(name).isNotNull(), F.split(text(name), ","))
    return rows.filter((_or_empty(text("type")) != "") & (_or_empty(text("value")) != "")).select(
        F.concat_ws("_", F.lit(feed_id), text("type"), F.md5(text("value"))).alias("id"),
        text("type").alias("type"),
        text("value").alias("value"),
        F.coalesce(text("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        _or_empty(text("severity")).alias("severity"),
        _texts(listed("categories")).alias("categories"),
        _texts(listed("tags")).alias("tags"),
        F.array(F.lit(feed_id)).alias("sources"),
        F.lit("amber").alias("tlp"),
        as_of.alias("first_seen"),
        as_of.alias("last_seen"),
        text("expires_at").try_cast("timestamp").alias("expires_at"),
        metadata.alias("metadata"),
    )


def read_json_feed(spark: SparkSession, path: str, feed_id: str, mapping: dict[str, str], as_of: Column) -> DataFrame:
    return mapped_indicators(spark.read.option("multiLine", True).json(path), feed_id, mapping, as_of)


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Header and text cells; rows with another number of fields than the header are dropped."""
    rows = spark.read.options(header=True, mode="DROPMALFORMED", inferSchema=False, columnPruning=False).csv(path)
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in rows.columns])


def read_csv_feed(spark: SparkSession, path: str, feed_id: str, mapping: dict[str, str], as_of: Column) -> DataFrame:
    return mapped_indicators(read_csv_rows(spark, path).na.fill(""), feed_id, mapping, as_of)


READERS = {"stix": read_stix, "taxii": read_taxii, "openioc": read_openioc, "misp": read_misp, "json": read_json_feed, "csv": read_csv_feed}


def read_feed(spark: SparkSession, kind: str, path: str, **how) -> DataFrame:
    """Reader by feed type; add to ``READERS`` for further ones. ``how``: what the reader takes besides, such as ``feed_id``, ``mapping`` and ``as_of``."""
    if kind not in READERS:
        raise ValueError(f"unknown feed type: {kind}")
    return READERS[kind](spark, path, **how)
