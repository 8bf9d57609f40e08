"""IP and CIDR blocklists, whitelists and allowed-IP lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.commands import is_db_port, is_new_connection
from wiretally.functions.keys import ip_to_long, prefix_mask


def reason_class(code: Column) -> Column:
    return (
        F.when(code == 1, F.lit("sql_injection")).when(code == 2, F.lit("rate_limit")).otherwise(F.lit("manual"))
    )


def in_force(blocks: DataFrame) -> DataFrame:
    """The blocks whose ``active`` is true, all where they have no such column."""
    return blocks.filter("active") if "active" in blocks.columns else blocks


def match_ip_block(requests: DataFrame, blocked_ips: DataFrame, *, ip: str = "ip") -> DataFrame:
    """Add ``ip_reason`` for addresses (longs) listed one by one; the lowest code wins."""
    side = in_force(blocked_ips).groupBy(F.col("ip").alias("_bip")).agg(F.min("reason_code").alias("_code"))
    joined = requests.join(side, F.col(ip) == F.col("_bip"), "left")
    return joined.withColumn(
        "ip_reason", F.when(F.col("_bip").isNotNull(), reason_class(F.col("_code")))
    ).drop("_bip", "_code")


def parse_cidrs(df: DataFrame, cidr: str) -> DataFrame:
    """``network, mask`` (longs) of CIDR texts; texts that do not parse are dropped."""
    base = ip_to_long(F.split_part(F.col(cidr), F.lit("/"), F.lit(1)))
    prefix = F.split_part(F.col(cidr), F.lit("/"), F.lit(2)).try_cast("int")
    parsed = df.withColumn("_base", base).withColumn("_prefix", prefix)
    parsed = parsed.filter(F.col("_base").isNotNull() & F.col("_prefix").between(0, 32))
    mask = prefix_mask(F.col("_prefix"))
    return (
        parsed.withColumn("mask", mask)
        .withColumn("network", F.col("_base").bitwiseAND(F.col("mask")))
        .drop("_base", "_prefix")
    )


def match_cidr(requests: DataFrame, cidrs: DataFrame, *, ip: str = "ip") -> DataFrame:
    """Add ``cidr_hit``: one equi-join on ``ip & mask`` per distinct mask (33 at most)."""
    cidrs = in_force(cidrs)
    masks = sorted(r.mask for r in cidrs.select("mask").distinct().collect())
    df, hits = requests, []
    for mask in masks:
        name = f"_net_{mask}"
        side = cidrs.filter(F.col("mask") == mask).select(F.col("network").alias(name)).distinct()
        df = df.join(side, F.col(ip).bitwiseAND(F.lit(mask).cast("bigint")) == F.col(name), "left")
        hits.append(F.col(name).isNotNull())
    hit = F.lit(False)
    for h in hits:
        hit = hit | h
    return df.withColumn("cidr_hit", hit).drop(*[f"_net_{m}" for m in masks])


def filter_requests(requests: DataFrame, blocked_ips: DataFrame, cidrs: DataFrame, *, ip: str = "ip") -> DataFrame:
    """Exact block, then CIDR block (always counted as manual); adds ``decision, reason``."""
    df = match_cidr(match_ip_block(requests, blocked_ips, ip=ip), cidrs, ip=ip)
    reason = F.coalesce(F.col("ip_reason"), F.when(F.col("cidr_hit"), F.lit("manual")))
    return (
        df.withColumn("reason", reason)
        .withColumn("decision", F.when(F.col("reason").isNotNull(), F.lit("drop")).otherwise(F.lit("pass")))
        .drop("ip_reason", "cidr_hit")
    )


def filter_stats(decisions: DataFrame, *, family: str | None = None) -> DataFrame:
    """Totals of the address filter; ``family`` names a column with ipv4 / ipv6 / other."""
    kind = F.col(family) if family else F.lit("ipv4")
    drop, reason = F.col("decision") == "drop", F.col("reason")
    return decisions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(drop).alias("blocked"),
        F.count_if(~drop).alias("allowed"),
        F.count_if(kind == "ipv6").alias("ipv6"),
        F.count_if(~kind.isin("ipv4", "ipv6")).alias("non_ip"),
        F.count_if(drop & (reason == "sql_injection")).alias("sql_injection"),
        F.count_if(drop & (reason == "rate_limit")).alias("rate_limit"),
        F.count_if(drop & (reason == "manual")).alias("manual"),
    )


def exempt(requests: DataFrame, whitelist: DataFrame, *, ip: str = "ip") -> DataFrame:
    """Add ``whitelisted``: the address is on the limiter's exemption list."""
    side = in_force(whitelist).select(F.col("ip").alias("_wip")).distinct()
    joined = requests.join(side, F.col(ip) == F.col("_wip"), "left")
    return joined.withColumn("whitelisted", F.col("_wip").isNotNull()).drop("_wip")


def ip_in_list(ip: Column, allowed: Column) -> Column:
    """Literal match or CIDR containment against an array of texts; bad CIDRs never match."""
    value = ip_to_long(ip)

    def hit(entry: Column) -> Column:
        base = ip_to_long(F.split_part(entry, F.lit("/"), F.lit(1)))
        prefix = F.split_part(entry, F.lit("/"), F.lit(2)).try_cast("int")
        mask = prefix_mask(prefix)
        inside = prefix.between(0, 32) & (value.bitwiseAND(mask) == base.bitwiseAND(mask))
        return F.when(entry.contains("/"), F.coalesce(inside, F.lit(False))).otherwise(entry == ip)

    return F.exists(allowed, hit)


def ip_allowed(requests: DataFrame, users: DataFrame, *, username: str = "username", ip: str = "source_ip") -> DataFrame:
    """Add ``ip_allowed``: the user's list holds the address (true when there is no list)."""
    side = users.select(F.col("username").alias("_u"), F.col("allowed_ips").alias("_allowed"))
    listed = F.size(F.coalesce(F.col("_allowed"), F.array().cast("array<string>"))) > 0
    joined = requests.join(side, F.col(username) == F.col("_u"), "left")
    return joined.withColumn(
        "ip_allowed", F.when(listed, ip_in_list(F.col(ip), F.col("_allowed"))).otherwise(F.lit(True))
    ).drop("_u", "_allowed")


def db_traffic(packets: DataFrame, *, port: str = "dest_port") -> DataFrame:
    return packets.filter(is_db_port(F.col(port)))


def new_connections(packets: DataFrame, *, port: str = "dest_port") -> DataFrame:
    return db_traffic(packets, port=port).filter(is_new_connection(F.col("syn"), F.col("ack")))
