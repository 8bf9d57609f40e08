"""Threat feeds: transforms, filters, validation, merge into the indicator table, auto-blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSFORMS = {"lowercase": F.lower, "uppercase": F.upper, "trim": F.trim}


def apply_transforms(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Value transforms in the given order; other fields and unknown operations are left alone."""
    for spec in specs:
        change = TRANSFORMS.get(spec["operation"])
        if change is not None and spec["field"] == "value":
            df = df.withColumn("value", change("value"))
    return df


def _filter_test(spec: dict) -> Column:
    field, operator, want = spec["field"], spec["operator"], spec["value"]
    known = {"type": "string", "severity": "string", "confidence": "double"}
    column = F.col(field) if field in known else F.try_element_at("metadata", F.lit(field))
    number = isinstance(want, (int, float)) and not isinstance(want, bool)
    is_number_field = known.get(field) == "double"
    if operator == "equals":
        if is_number_field != number and field in known:
            return F.lit(False)
        return column.try_cast("double") == float(want) if number else column == str(want)
    if operator == "contains" and isinstance(want, str) and not is_number_field:
        return column.contains(want)
    if operator in ("gt", "lt") and number and known.get(field) != "string":
        value = column.try_cast("double")
        return value > float(want) if operator == "gt" else value < float(want)
    return F.lit(False)


def apply_filters(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Rows for which every filter holds; a type mismatch or unknown operator holds for none."""
    for spec in specs:
        df = df.filter(F.coalesce(_filter_test(spec), F.lit(False)))
    return df


def validate_indicators(
    df: DataFrame, *, required: list[str] = (), ip_validation: bool = False, domain_validation: bool = False
) -> DataFrame:
    for field in required:
        if field in ("type", "value"):
            df = df.filter(F.coalesce(F.col(field), F.lit("")) != "")
        elif field == "confidence":
            df = df.filter(F.coalesce(F.col(field), F.lit(0.0)) != 0)
    if ip_validation:
        df = df.filter((F.col("type") != "ip") | (F.size(F.split("value", r"\.")) == 4))
    if domain_validation:
        df = df.filter((F.col("type") != "domain") | F.col("value").contains("."))
    return df


def process_feed(df: DataFrame, config: dict) -> DataFrame:
    """Transforms, then filters, then validation of one feed's configuration."""
    return (
        df.transform(apply_transforms, config.get("transforms", []))
        .transform(apply_filters, config.get("filters", []))
        .transform(lambda d: validate_indicators(d, **config.get("validation", {})))
    )


def auto_block(
    indicators: DataFrame,
    as_of: Column,
    *,
    threshold: float,
    block_seconds: int,
    enabled: bool = True,
    high_confidence: bool = False,
    categories: list[str] = (),
    excluded_sources: list[str] = (),
) -> DataFrame:
    """Block rules for address indicators that qualify, expiring after ``block_seconds``."""
    if not enabled:
        indicators = indicators.limit(0)
    test = (F.col("type") == "ip") & (F.col("confidence") >= threshold)
    if high_confidence:
        test = test & (F.col("confidence") >= 0.9)
    if categories:
        test = test & F.coalesce(
            F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])), F.lit(False)
        )
    if excluded_sources:
        test = test & ~F.coalesce(
            F.arrays_overlap("sources", F.array(*[F.lit(s) for s in excluded_sources])), F.lit(False)
        )
    return indicators.filter(test).select(
        F.col("value").alias("ip_address"),
        F.concat(F.lit("Auto-blocked: "), F.concat_ws(",", "categories")).alias("reason"),
        as_of.alias("blocked_at"),
        (as_of + F.make_dt_interval(secs=F.lit(block_seconds))).alias("expires_at"),
        F.lit("auto").alias("rule_type"),
        "confidence",
        F.concat_ws(",", "sources").alias("sources"),
    )


def live_only(indicators: DataFrame, as_of: Column, expires: str = "expires_at") -> DataFrame:
    return indicators.filter(F.col(expires).isNull() | (F.col(expires) > as_of))


def purge_expired(indicators: DataFrame, blocks: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Indicators still valid, and blocks without those of expired indicators."""
    expired = indicators.filter(F.col("expires_at") <= as_of).select(F.col("value").alias("_gone"))
    kept_blocks = blocks.join(expired, F.col("ip_address") == F.col("_gone"), "left_anti")
    return live_only(indicators, as_of), kept_blocks


def threat_by_value(indicators: DataFrame, values: DataFrame, as_of: Column) -> DataFrame:
    """Values (``value``) that are known and unexpired threats."""
    live = live_only(indicators, as_of).select(F.col("value").alias("_v"))
    return values.join(live, F.col("value") == F.col("_v"), "left_semi")



def merge_feed(current: DataFrame, update: DataFrame, as_of: Column) -> DataFrame:
    """Merge an update by indicator id: known ids keep their fields, take ``as_of`` as last seen and
    the ordered union of sources; new ids come in whole.

    ``update`` carries ``seq``, its order within the feed; the first row of an id is the one stored,
    later rows of the same id only add their sources.
    """
    columns = [c for c in current.columns]
    firsts = update.groupBy(F.col("id").alias("_id")).agg(
        F.min_by(F.struct(*[c for c in columns if c != "id"]), "seq").alias("_first")
    )
    named = update.select("id", "seq", F.posexplode("sources").alias("at", "source"))
    distinct = named.groupBy("id", "source").agg(F.min(F.struct("seq", "at")).alias("first_at"))
    unions = distinct.groupBy(F.col("id").alias("_sid")).agg(
        F.array_sort(F.collect_list(F.struct("first_at", "source"))).alias("_parts")
    )
    sources = F.coalesce(F.transform("_parts", lambda p: p["source"]), F.array().cast("array<string>"))
    side = firsts.join(unions, F.col("_id") == F.col("_sid"), "left").select("_id", "_first", sources.alias("_sources"))
    joined = current.join(side, F.col("id") == F.col("_id"), "full_outer")
    known, touched = F.col("id").isNotNull(), F.col("_id").isNotNull()
    out = []
    for c in columns:
        if c == "id":
            out.append(F.coalesce("id", "_id").alias("id"))
        elif c == "last_seen":
            out.append(F.when(touched, as_of).otherwise(F.col(c)).alias(c))
        elif c == "first_seen":
            out.append(F.when(known, F.col(c)).otherwise(as_of).alias(c))
        elif c == "sources":
            merged = F.array_distinct(F.concat(F.coalesce(F.col(c), F.array().cast("array<string>")), "_sources"))
            out.append(F.when(known & touched, merged).when(touched, F.col("_sources")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(known, F.col(c)).otherwise(F.col(f"_first.{c}")).alias(c))
    return joined.select(*out)


def add_custom(current: DataFrame, manual: DataFrame, as_of: Column) -> DataFrame:
    """Manual indicators: the same merge with the source ``manual`` added."""
    marked = manual.withColumn(
        "sources", F.concat(F.coalesce(F.col("sources"), F.array().cast("array<string>")), F.array(F.lit("manual")))
    )
    return merge_feed(current, marked, as_of)


def upsert_indicators(current: DataFrame, batch: DataFrame, as_of: Column, *, feed_id: int | None = None) -> DataFrame:
    """Upsert by (value, type). Known rows: last seen, incoming level, larger confidence, active.
    New rows: defaults for what is missing. Adds ``change`` (added, updated, kept).

    ``batch``: ``type, value, threat_level, confidence, description, tags, first_seen, expires,
    seq``. Several rows of one key act in order, as if written one after the other.
    """
    level = F.max_by("threat_level", F.when(F.col("threat_level").isNotNull(), F.col("seq")))
    grouped = batch.groupBy("type", "value").agg(
        level.alias("_level"),
        F.max(F.coalesce(F.col("confidence"), F.lit(50))).alias("_confidence"),
        F.min_by(F.struct("description", "tags", "first_seen", "expires"), "seq").alias("_first"),
    )
    side = grouped.select(F.col("type").alias("_type"), F.col("value").alias("_value"), "_level", "_confidence", "_first")
    joined = current.join(side, (F.col("type") == F.col("_type")) & (F.col("value") == F.col("_value")), "full_outer")
    known, touched = F.col("value").isNotNull(), F.col("_value").isNotNull()
    pick = lambda old, new: F.when(known, old).otherwise(new)
    changes = {
        "type": F.coalesce("type", "_type"),
        "value": F.coalesce("value", "_value"),
        "threat_level": F.when(touched, F.coalesce("_level", "threat_level", F.lit("medium"))).otherwise(F.col("threat_level")),
        "confidence": F.when(touched, F.greatest("confidence", "_confidence")).otherwise(F.col("confidence")),
        "description": pick(F.col("description"), F.coalesce(F.col("_first.description"), F.lit(""))),
        "tags": pick(F.col("tags"), F.coalesce(F.col("_first.tags"), F.array().cast("array<string>"))),
        "first_seen": pick(F.col("first_seen"), F.coalesce(F.col("_first.first_seen"), as_of)),
        "last_seen": F.when(touched, as_of).otherwise(F.col("last_seen")),
        "expires": pick(F.col("expires"), F.col("_first.expires")),
        "active": F.when(touched, F.lit(True)).otherwise(F.col("active")),
        "feed_id": pick(F.col("feed_id"), F.lit(feed_id).cast("int")) if "feed_id" in current.columns else None,
    }
    out = [changes[c].alias(c) if changes.get(c) is not None else F.col(c) for c in current.columns]
    change = F.when(known & touched, "updated").when(touched, "added").otherwise("kept")
    return joined.select(*out, change.alias("change"))


def upsert_report(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.count_if(F.col("change") != "kept").alias("total"),
    )


def import_indicators(current: DataFrame, parsed: DataFrame, as_of: Column, feed_id: int) -> DataFrame:
    """Manual import under a new feed: everything is inserted, nothing merged."""
    defaults = {
        "threat_level": F.coalesce("threat_level", F.lit("medium")),
        "confidence": F.coalesce("confidence", F.lit(50)),
        "description": F.coalesce("description", F.lit("")),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "first_seen": F.coalesce("first_seen", as_of),
        "last_seen": as_of,
        "active": F.lit(True),
        "feed_id": F.lit(feed_id),
    }
    cols = [
        defaults[c].alias(c) if c in defaults else (F.col(c) if c in parsed.columns else F.lit(None).alias(c))
        for c in current.columns
    ]
    parsed = parsed if "first_seen" in parsed.columns else parsed.withColumn("first_seen", F.lit(None).cast("timestamp"))
    return current.unionByName(parsed.select(*cols))


def changed_files(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Feed contents whose digest differs from every one recorded for the feed."""
    hashed = files.withColumn("content_md5", F.md5("content"))
    seen = previous.select(F.col("feed").alias("_f"), F.col("content_md5").alias("_h"))
    return hashed.join(seen, (F.col("feed") == F.col("_f")) & (F.col("content_md5") == F.col("_h")), "left_anti")
