"""Who may do what: authentication, authorization, cached-result access, user views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.keys import strip_port
from wiretally.operators.nest import nest
from wiretally.operators.netblocks import ip_in_list
from wiretally.operators.screen import first_denial


def _user_side(users: DataFrame) -> DataFrame:
    """One user per name, so that no request is multiplied: of several an enabled one, then the one that expires last (never is later), then by list and key."""
    keys = [F.col("api_key").alias("key")] if "api_key" in users.columns else []
    order = [(~F.coalesce("enabled", F.lit(False))).alias("off"), F.col("expires_at").isNotNull().alias("ends"), (-F.unix_micros("expires_at")).alias("less")]
    first = users.groupBy(F.col("username").alias("_u")).agg(F.min(F.struct(*order, "enabled", "expires_at", F.col("allowed_ips").alias("ips"), *keys)).alias("_f"))
    return first.where("_u IS NOT NULL").select(
        "_u",
        F.col("_f.enabled").alias("_u_enabled"),
        F.col("_f.expires_at").alias("_u_expires"),
        F.col("_f.ips").alias("_u_ips"),
        *([F.col("_f.key").alias("_u_key")] if keys else []),
    )


def _permission_side(permissions: DataFrame) -> DataFrame:
    """One permission per user, so that no request is multiplied: of several the first by database, table, actions, limit."""
    row = F.struct("database", "table", "actions", "time_limit")
    first = permissions.groupBy(F.col("username").alias("_p")).agg(F.min(row).alias("_first"))
    return first.select(
        "_p",
        F.col("_first.database").alias("_p_db"),
        F.col("_first.table").alias("_p_table"),
        F.col("_first.actions").alias("_p_actions"),
        F.col("_first.time_limit").alias("_p_until"),
    )


def _login_stages(username: Column, database: Column, as_of: Column, ip: Column | None):
    """Ordered reasons to refuse a login; ``username`` is the joined user's name, null if absent."""
    stages = [
        ("user", username.isNull() | ~F.coalesce(F.col("_u_enabled"), F.lit(False)), "user not found or disabled"),
        ("account", F.col("_u_expires").isNotNull() & (as_of > F.col("_u_expires")), "account expired"),
    ]
    if ip is not None:
        listed = F.size(F.coalesce(F.col("_u_ips"), F.array().cast("array<string>"))) > 0
        given = F.coalesce(ip, F.lit("")) != ""
        stages.append(("address", listed & given & ~ip_in_list(strip_port(ip), F.col("_u_ips")), "address not allowed"))
    stages += [
        ("permission", F.col("_p").isNull(), "no permission"),
        ("database", (F.col("_p_db") != "*") & (F.col("_p_db") != database), "database access denied"),
        ("time", F.col("_p_until").isNotNull() & (as_of > F.col("_p_until")), "database access expired"),
    ]
    return [(n, F.coalesce(c, F.lit(False)), F.lit(why)) for n, c, why in stages]


def authenticate(
    requests: DataFrame,
    users: DataFrame,
    permissions: DataFrame,
    as_of: Column,
    *,
    check_ip: bool = True,
) -> DataFrame:
    """Add ``allowed, deny_reason``. Of several permissions of a user the first counts, and of several users of a name one (see ``_user_side``)."""
    df = requests.join(_user_side(users), F.col("username") == F.col("_u"), "left")
    df = df.join(_permission_side(permissions), F.col("username") == F.col("_p"), "left")
    ip = F.col("source_ip") if check_ip else None
    _, reason = first_denial(_login_stages(F.col("_u"), F.col("database"), as_of, ip))
    return (
        df.withColumn("deny_reason", reason)
        .withColumn("allowed", F.col("deny_reason").isNull())
        .drop(*[c for c in df.columns if c.startswith(("_u", "_p"))])
    )


def authenticate_key(
    requests: DataFrame, users: DataFrame, permissions: DataFrame, as_of: Column
) -> DataFrame:
    """Login by ``api_key``: the enabled user with that key, then the login rules without address."""
    owners = (
        users.filter(F.col("enabled") & (F.coalesce(F.col("api_key"), F.lit("")) != ""))
        .groupBy(F.col("api_key").alias("_key"))
        .agg(F.min("username").alias("username"))
    )
    known = requests.join(owners, F.col("api_key") == F.col("_key"), "left").drop("_key")
    decided = authenticate(known, users, permissions, as_of, check_ip=False)
    return decided.withColumn(
        "deny_reason", F.when(F.col("username").isNull(), F.lit("unknown api key")).otherwise(F.col("deny_reason"))
    )


def authorize(requests: DataFrame, permissions: DataFrame, *, is_write: str = "is_write") -> DataFrame:
    """Add ``authorized``: database, table (when given), then the action or ``*``."""
    df = requests.join(_permission_side(permissions), F.col("username") == F.col("_p"), "left")
    action = F.when(F.col(is_write), F.lit("write")).otherwise(F.lit("read"))
    table = F.coalesce(F.col("table"), F.lit(""))
    allowed = (
        F.col("_p").isNotNull()
        & ((F.col("_p_db") == "*") | (F.col("_p_db") == F.col("database")))
        & ((table == "") | (F.col("_p_table") == "*") | (F.col("_p_table") == table))
        & (F.array_contains("_p_actions", action) | F.array_contains("_p_actions", F.lit("*")))
    )
    return df.withColumn("authorized", F.coalesce(allowed, F.lit(False))).drop(
        "_p", "_p_db", "_p_table", "_p_actions", "_p_until"
    )


def authorize_cache(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Whether each request may read the cached entry of its ``cache_key``.

    ``requests``: ``cache_key, username, use_tls, api_key, groups, roles, permissions, database,
    table`` plus ``user_ok`` (outcome of the user's own database, table and address checks).
    Adds ``served`` and ``deny_reason``; an entry's allowed user passes without further checks.
    """
    side = entries.select(
        F.col("cache_key").alias("_k"),
        *[
            F.col(c).alias(f"_e_{c}")
            for c in (
                "database", "table", "allowed_users", "denied_users", "groups", "roles", "permissions",
                "require_tls", "require_api_key",
            )
        ],
    )
    df = requests.join(side, F.col("cache_key") == F.col("_k"), "left")
    user = F.col("username")

    def lacks(name: str) -> Column:
        need = F.coalesce(F.col(f"_e_{name}"), F.array().cast("array<string>"))
        have = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return (F.size(need) > 0) & ~F.arrays_overlap(need, have)

    def differs(name: str) -> Column:
        want = F.coalesce(F.col(f"_e_{name}"), F.lit(""))
        return (want != "") & (want != F.coalesce(F.col(name), F.lit("")))

    stages = [
        ("entry", F.col("_k").isNull(), F.lit("not cached")),
        ("denied", F.array_contains("_e_denied_users", user), F.lit("user denied")),
        ("allowed", F.array_contains("_e_allowed_users", user), F.lit("")),
        ("tls", F.col("_e_require_tls") & ~F.col("use_tls"), F.lit("tls required")),
        ("key", F.col("_e_require_api_key") & (F.coalesce(F.col("api_key"), F.lit("")) == ""), F.lit("api key required")),
        ("groups", lacks("groups"), F.lit("group missing")),
        ("roles", lacks("roles"), F.lit("role missing")),
        ("permissions", lacks("permissions"), F.lit("permission missing")),
        ("database", differs("database"), F.lit("other database")),
        ("table", differs("table"), F.lit("other table")),
        ("user", ~F.col("user_ok"), F.lit("user access")),
    ]
    _, reason = first_denial([(n, F.coalesce(c, F.lit(False)), why) for n, c, why in stages])
    return (
        df.withColumn("deny_reason", F.nullif(reason, F.lit("")))
        .withColumn("served", F.col("deny_reason").isNull())
        .drop(*side.columns)
    )


def user_view(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Users with profile flags; defaults where the profile is missing."""
    side = profiles.withColumnRenamed("user_id", "_uid")
    return users.join(side, F.col("user_id") == F.col("_uid"), "left").select(
        *users.columns,
        F.coalesce(F.col("api_key"), F.lit("")).alias("api_key"),
        F.coalesce(F.col("require_tls"), F.lit(False)).alias("require_tls"),
        F.coalesce(F.col("rate_limit"), F.lit(0)).alias("rate_limit"),
        F.coalesce(F.col("is_active"), F.lit(True)).alias("is_active"),
    )


def users_enhanced(
    users: DataFrame, profiles: DataFrame, permissions: DataFrame, *, parts: int
) -> DataFrame:
    """``user_view`` with each user's permissions nested, ordered by database, table, id.

    Each user has a row for each of ``parts`` (see ``nest``) that holds permissions, and one without any else.
    """
    item = F.struct("database", "table", "permission_id", "actions")
    nested = nest(permissions, ["user_id"], item, "permissions", spread_by="permission_id", parts=parts)
    nested = nested.withColumnRenamed("user_id", "_uid")
    empty = F.array().cast(nested.schema["permissions"].dataType)
    return (
        user_view(users, profiles)
        .join(nested, F.col("user_id") == F.col("_uid"), "left")
        .drop("_uid")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("permissions", F.coalesce(F.col("permissions"), empty))
    )


def temporary_access(grants: DataFrame, as_of: Column) -> DataFrame:
    """Active temporary grants with a computed ``expired``."""
    return grants.filter("is_active").withColumn("expired", F.col("expires_at") < as_of)
