"""First-match joins of a log against rules and threat indicators.

No join here is a nested loop and none emits several rows per log row: each kind of rule or indicator gives
at most one candidate per log row, the lowest id wins, and a candidate brings its reason with it. Texts meet
substrings and patterns in ``textmatch``; addresses and names meet theirs by equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions import packs
from wiretally.functions.keys import strip_port
from wiretally.operators.textmatch import first_hit, first_hits, regex_tests, substring_tests


# --- rules -----------------------------------------------------------------------------------------


def default_rules(spark: SparkSession) -> DataFrame:
    """Built-in blocked databases, users and tables; ids give the match order."""
    rows = [(i, kind, pattern, reason, True) for i, (kind, pattern, reason) in enumerate(packs.DEFAULT_BLOCKED)]
    return spark.createDataFrame(rows, "id long, kind string, pattern string, reason string, active boolean")


def seed_rules(current: DataFrame) -> DataFrame:
    """The built-in rules when the table holds none, else the table itself."""
    spark = current.sparkSession
    present = current.limit(1).select(F.lit(1).alias("_present"))
    seeds = default_rules(spark).join(F.broadcast(present), how="left_anti", on=F.lit(True))
    return current.unionByName(seeds.select(*current.columns))


def least_id(candidates: list[Column]) -> Column:
    found = [c for c in candidates if c is not None]
    if not found:
        return F.lit(None).cast("bigint")
    return found[0] if len(found) == 1 else F.least(*found)


def lookup_first(df: DataFrame, key: Column, table: DataFrame, key_col: str, hit: Column, out: str) -> DataFrame:
    """Left equi-join giving the least hit per key value; never multiplies rows."""
    side = table.groupBy(F.col(key_col).alias("_k")).agg(F.min(hit).alias(out))
    return df.withColumn("_key", key).join(side, F.col("_key") == F.col("_k"), "left").drop("_key", "_k")


def _hit(*details: str) -> Column:
    return F.struct(F.col("id").cast("bigint").alias("id"), *details)


def rule_match(log: DataFrame, rules: DataFrame, targets: dict[str, tuple[str, str]]) -> DataFrame:
    """Add one column per entry ``out: (kind, target column)``: id and reason of the first active rule that hits.

    A rule hits when its pattern is found in the lower-cased target, or the target contains the
    pattern's own text; an invalid pattern only has the latter, a null one hits nothing. Empty targets never match.
    """
    kinds = {out: (kind, F.when(F.col(target) != "", F.lower(target))) for out, (kind, target) in targets.items()}
    own = rules.filter("active").filter(F.col("kind").isin([kind for kind, _ in kinds.values()]))
    pattern, hit = F.col("pattern"), _hit("reason")
    tests = substring_tests(own, F.lower(pattern), hit, F.col("kind")) + regex_tests(own, pattern, hit, F.col("kind"))
    return first_hits(log, kinds, tests)


def match_blocked(
    log: DataFrame,
    rules: DataFrame,
    *,
    database: str = "database",
    username: str = "username",
    table: str | None = None,
) -> DataFrame:
    """Connection check: database, then user, then table. Adds ``blocked, rule_id, reason``."""
    targets = {"_db_rule": ("database", database), "_user_rule": ("username", username)}
    if table is not None:
        targets["_table_rule"] = ("table", table)
    df = rule_match(log, rules, targets).withColumn("_rule", F.coalesce(*targets))
    df = df.withColumn("rule_id", F.col("_rule.id")).withColumn("reason", F.col("_rule.reason"))
    return df.withColumn("blocked", F.col("rule_id").isNotNull()).drop("_rule", *targets)


def match_security_rules(log: DataFrame, rules: DataFrame, *, query: str = "query") -> DataFrame:
    """Custom rules (``id, pattern, action, severity, active``) on query text, case-insensitively:
    adds ``custom_rule, action, severity`` of the first that hits. Invalid patterns are skipped."""
    tests = regex_tests(rules.filter("active"), F.col("pattern"), _hit("action", "severity"), flags="(?i)")
    df = first_hit(log, F.lower(query), tests, "_rule")
    return df.select(*log.columns, F.col("_rule.id").alias("custom_rule"), "_rule.action", "_rule.severity")


# --- substrings ------------------------------------------------------------------------------------


def substring_first(log: DataFrame, text: str, needles: DataFrame, out: str) -> DataFrame:
    """Add ``out``: lowest id of the needles (``id, needle``, lower case) that a text (lower case) contains."""
    df = first_hit(log, F.col(text), substring_tests(needles, F.col("needle"), _hit()), "_needle")
    return df.withColumn(out, F.col("_needle.id")).drop("_needle")


# --- threat indicators -----------------------------------------------------------------------------

SUBSTRING_TYPES = ["sql_pattern", "domain", "url"]


def match_threats(
    log: DataFrame,
    indicators: DataFrame,
    policy: DataFrame | None = None,
    *,
    source_ip: str = "source_ip",
    username: str = "username",
    query: str = "query",
) -> DataFrame:
    """First indicator each log row matches; adds ``indicator_id, indicator_type,
    indicator_value, threat_level, match_reason`` (null when nothing matches).

    ``indicators``: ``id, type, value, threat_level, active``. ``policy``: ``database,
    threat_intel_blocks_enabled``; databases without a row are checked.
    """
    live = indicators.filter(F.coalesce(F.col("active"), F.lit(True)))
    of_type = lambda *types: live.filter(F.col("type").isin(*types))
    hit = _hit("type", "value", "threat_level")
    df = log
    if policy is not None:
        side = policy.select(
            F.col("database").alias("_pdb"), F.col("threat_intel_blocks_enabled").alias("_checked")
        )
        df = df.join(side, F.col("database") == F.col("_pdb"), "left").drop("_pdb")
        df = df.withColumn("_checked", F.coalesce("_checked", F.lit(True)))
    else:
        df = df.withColumn("_checked", F.lit(True))
    tests = substring_tests(of_type(*SUBSTRING_TYPES), F.lower("value"), hit) + regex_tests(of_type("pattern"), F.col("value"), hit)
    df = first_hit(df, F.when(F.col("_checked"), F.lower(query)), tests, "_text")
    df = lookup_first(df, strip_port(F.col(source_ip)), of_type("ip"), "value", hit, "_ip")
    df = lookup_first(df, F.lower(username), of_type("email").withColumn("_low", F.lower("value")), "_low", hit, "_email")
    df = df.withColumn("_best", F.when(F.col("_checked"), F.least("_ip", "_email", "_text")))
    kind, value = F.col("_best.type"), F.col("_best.value")
    reason = (
        F.when(kind == "ip", F.concat(F.lit("Source IP "), strip_port(F.col(source_ip)), F.lit(" matches threat indicator")))
        .when(kind == "sql_pattern", F.concat(F.lit("Query contains threat pattern: "), value))
        .when(kind == "pattern", F.concat(F.lit("Query matches threat pattern: "), value))
        .when(kind.isin("domain", "url"), F.concat(F.lit("Query contains threat indicator: "), value))
        .when(kind == "email", F.concat(F.lit("Username "), F.col(username), F.lit(" matches threat indicator")))
    )
    found = F.col("_best.id").alias("indicator_id"), kind.alias("indicator_type"), value.alias("indicator_value"), F.col("_best.threat_level").alias("threat_level")
    return df.select(*log.columns, *found, reason.alias("match_reason"))


def match_counts(matches: DataFrame) -> DataFrame:
    return (
        matches.filter(F.col("indicator_id").isNotNull())
        .groupBy("indicator_id")
        .agg(F.count(F.lit(1)).alias("matches"))
    )


# --- wildcard rules --------------------------------------------------------------------------------


def wildcard_first(requests: DataFrame, rules: DataFrame, columns: list[str], order: str, out: str) -> DataFrame:
    """Add ``out``: lowest ``order`` among rules whose non-wild columns all equal the request's.

    Empty or ``*`` is wild. One equi-join per combination of wild columns that occurs
    (at most two to the number of columns), so any number of rules works without a nested loop.
    """
    norm = rules.select(
        F.col(order).cast("bigint").alias("_order"),
        *[
            F.when((F.coalesce(F.col(c), F.lit("")) != "") & (F.col(c) != "*"), F.col(c)).alias(f"_r_{c}")
            for c in columns
        ],
    ).withColumn("_mask", F.concat(*[F.col(f"_r_{c}").isNotNull().cast("int").cast("string") for c in columns]))
    masks = sorted(r._mask for r in norm.select("_mask").distinct().collect())
    df, found = requests, []
    for mask in masks:
        fixed = [c for c, bit in zip(columns, mask) if bit == "1"]
        subset = norm.filter(F.col("_mask") == mask)
        if not fixed:
            found.append(F.lit(subset.agg(F.min("_order")).first()[0]).cast("bigint"))
            continue
        name = f"_m_{mask}"
        side = subset.groupBy(*[F.col(f"_r_{c}").alias(f"_s_{c}") for c in fixed]).agg(
            F.min("_order").alias(name)
        )
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_s_{c}") for c in fixed])
        df = df.join(side, on, "left").drop(*[f"_s_{c}" for c in fixed])
        found.append(F.col(name))
    return df.withColumn(out, least_id(found)).drop(*[f"_m_{m}" for m in masks])


def match_cache_policy(requests: DataFrame, rules: DataFrame, *, default_ttl: int = 300) -> DataFrame:
    """First rule of the first enabled policy: adds ``policy, action, tier, ttl_s`` (null: none).

    ``rules``: ``ord`` (list order), ``policy, enabled, database, table, operation, user, action,
    tier, ttl_s``; a rule ttl of 0 or null takes the default.
    """
    live = rules.filter("enabled")
    df = wildcard_first(requests, live, ["database", "table", "operation", "user"], "ord", "_ord")
    side = live.select(
        F.col("ord").cast("bigint").alias("_o"),
        "policy",
        "action",
        "tier",
        F.when(F.coalesce(F.col("ttl_s"), F.lit(0)) == 0, F.lit(default_ttl))
        .otherwise(F.col("ttl_s"))
        .cast("bigint")
        .alias("ttl_s"),
    )
    return df.join(side, F.col("_ord") == F.col("_o"), "left").drop("_ord", "_o")


def match_write_rule(requests: DataFrame, rules: DataFrame, *, default_strategy: str = "sync") -> DataFrame:
    """First enabled write rule in list order: adds ``rule_name, cluster_group, strategy``."""
    live = rules.filter("enabled")
    df = wildcard_first(requests, live, ["database", "table", "operation", "user"], "ord", "_ord")
    side = live.select(
        F.col("ord").cast("bigint").alias("_o"),
        F.col("name").alias("rule_name"),
        F.col("group").alias("cluster_group"),
        F.when(F.coalesce(F.col("strategy"), F.lit("")) == "", F.lit(default_strategy))
        .otherwise(F.col("strategy"))
        .alias("strategy"),
    )
    return df.join(side, F.col("_ord") == F.col("_o"), "left").drop("_ord", "_o")
