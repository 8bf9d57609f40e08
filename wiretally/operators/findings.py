"""Health findings: audits over collected inventory tables, scores, weekly and compliance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions import packs

WEIGHTS = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# --- audits ----------------------------------------------------------------------------------------------


def finding(test: Column, engine: str, kind: str, evidence: Column | None = None, severity: Column | None = None) -> Column:
    """A finding struct where the test holds, else null."""
    level, category, title = next(
        (s, c, t) for e, k, s, c, t in packs.HEALTH_FINDINGS if k == kind and e in (engine, "any")
    )
    return F.when(
        test,
        F.struct(
            F.lit(kind).alias("type"),
            (severity if severity is not None else F.lit(level)).alias("severity"),
            F.lit(category).alias("category"),
            F.lit(title).alias("title"),
            (evidence if evidence is not None else F.lit("{}")).alias("evidence"),
        ),
    )


def with_identity(findings: DataFrame, detected_at: Column) -> DataFrame:
    """Add ``detected_at`` and ``issue_id``: type, server and detection time."""
    seconds = F.unix_timestamp(detected_at).cast("string")
    return findings.withColumn("detected_at", detected_at).withColumn(
        "issue_id", F.concat_ws("_", "type", "server", seconds)
    )


def _spread(df: DataFrame, keys: list[str], items: list[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.array_compact(F.array(*items))).alias("f")).select(*keys, "f.*")


def _count_json(name: str, count: str) -> Column:
    return F.to_json(F.struct(F.col(count).alias(name)))


def _settings(settings: DataFrame, names: list[str]) -> DataFrame:
    """One row per server with the named settings as columns ``s_<name>``."""
    wanted = settings.filter(F.col("name").isin(names))
    return wanted.groupBy("server").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias("s_" + n.replace("-", "_")) for n in names]
    )


def _per_server(servers: DataFrame, *parts: DataFrame) -> DataFrame:
    out = servers.select("server").distinct()
    for p in parts:
        out = out.join(p, "server", "left")
    return out


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def audit_mysql(servers: DataFrame, accounts: DataFrame, databases: DataFrame, settings: DataFrame) -> DataFrame:
    """Account and variable checks. ``accounts``: ``server, user, host, auth_string, file_priv,
    super_priv, crud_priv`` (all six table privileges); ``settings`` long form, plugins as
    ``plugin:<name>``. Each input is reduced to one row per server in one aggregate."""
    user, host, secret = F.col("user"), F.col("host"), F.coalesce(F.col("auth_string"), F.lit(""))
    per_account = accounts.groupBy("server").agg(
        F.count_if((secret == "") & user.isin("root", "admin", "test", "mysql")).alias("blank"),
        F.count_if(F.col("file_priv") & (user != "root")).alias("file_users"),
        F.count_if((user == "root") & ~host.isin("localhost", "127.0.0.1", "::1")).alias("remote_root"),
        F.count_if(host.contains("%") | host.contains("_")).alias("wildcards"),
        F.count_if((F.col("super_priv") | F.col("crud_priv")) & (user != "root")).alias("admins"),
        F.count_if(user == "").alias("anonymous"),
        F.count_if(F.length(secret) < 20).alias("weak"),
    )
    default_dbs = databases.groupBy("server").agg(F.count_if(F.col("name") == "test").alias("test_dbs"))
    known = _settings(
        settings,
        ["have_ssl", "log_bin", "general_log", "skip_grant_tables", "old_passwords", "plugin:validate_password"],
    )
    df = _per_server(servers, per_account, default_dbs, known)
    item = lambda test, kind, ev=None: finding(test, "mysql", kind, ev)
    return _spread(
        df,
        ["server"],
        [
            item(_zero("blank") > 0, "default_credentials", _count_json("weak_users", "blank")),
            item(_zero("test_dbs") > 0, "default_databases"),
            item(_zero("file_users") > 0, "excessive_file_privileges", _count_json("users_with_file_priv", "file_users")),
            item(_zero("remote_root") > 0, "remote_root_access", _count_json("remote_hosts", "remote_root")),
            item(_zero("wildcards") > 0, "wildcard_host_access", _count_json("wildcard_users", "wildcards")),
            item(_zero("admins") > 2, "excessive_admin_users", _count_json("admin_users", "admins")),
            item(F.col("s_plugin:validate_password").isNull(), "no_password_validation"),
            item(F.coalesce(F.col("s_have_ssl"), F.lit("")) != "YES", "ssl_not_configured"),
            item(F.coalesce(F.col("s_log_bin"), F.lit("")) != "ON", "binary_logging_disabled"),
            item(F.col("s_general_log") == "ON", "general_logging_enabled"),
            item(F.col("s_skip_grant_tables") == "ON", "skip_grant_tables"),
            item(F.col("s_old_passwords") != "0", "old_password_hashing"),
            item(_zero("anonymous") > 0, "anonymous_users", _count_json("anonymous_hosts", "anonymous")),
            item(_zero("weak") > 0, "weak_passwords_detected", _count_json("users", "weak")),
        ],
    )


def audit_postgres(
    servers: DataFrame, roles: DataFrame, databases: DataFrame, settings: DataFrame, hba: DataFrame,
    tables: DataFrame, grants: DataFrame,
) -> DataFrame:
    """Role, database, authentication, logging and schema checks, one aggregate per input.

    ``roles``: ``server, name, can_login, has_password, superuser, createrole, createdb``;
    ``databases``: ``server, name, is_template``; ``hba``: ``server, method``; ``tables``:
    ``server, schema, row_security``; ``grants``: ``server, schema, grantee``.
    """
    other = F.col("name") != "postgres"
    per_role = roles.groupBy("server").agg(
        F.count_if(F.col("can_login") & ~F.col("has_password")).alias("open_roles"),
        F.count_if(F.col("superuser") & other).alias("supers"),
        F.count_if(F.col("createrole") & other).alias("creators"),
        F.count_if(F.col("createdb") & other).alias("db_creators"),
    )
    own = ~F.col("is_template") & ~F.col("name").isin("template0", "template1", "postgres")
    per_db = databases.groupBy("server").agg(F.count_if(own).alias("own_dbs"))
    per_hba = hba.groupBy("server").agg(F.count_if(F.col("method") == "trust").alias("trusted"))
    user_schema = ~F.col("schema").isin("information_schema", "pg_catalog")
    per_table = tables.groupBy("server").agg(
        F.count_if(user_schema).alias("user_tables"), F.count_if("row_security").alias("secured")
    )
    per_grant = grants.groupBy("server").agg(
        F.count_if((F.col("schema") == "public") & (F.col("grantee") == "PUBLIC")).alias("public_grants")
    )
    known = _settings(
        settings,
        ["password_encryption", "log_connections", "log_disconnections", "log_statement", "shared_preload_libraries", "ssl"],
    )
    df = _per_server(servers, per_role, per_db, per_hba, per_table, per_grant, known)
    noisy = F.lit(False)
    for lib in packs.PG_NOISY_LIBRARIES:
        noisy = noisy | F.lower("s_shared_preload_libraries").contains(lib)
    item = lambda test, kind, ev=None: finding(test, "postgresql", kind, ev)
    unless = lambda name, want: F.coalesce(F.col(name), F.lit("")) != want
    return _spread(
        df,
        ["server"],
        [
            item(_zero("open_roles") > 0, "users_no_password", _count_json("users", "open_roles")),
            item(_zero("supers") > 0, "excessive_superuser_accounts", _count_json("superusers", "supers")),
            item(_zero("creators") > 0, "excessive_createrole_privilege", _count_json("users", "creators")),
            item(_zero("db_creators") > 2, "excessive_createdb_privilege", _count_json("users", "db_creators")),
            item(_zero("own_dbs") == 0, "only_default_databases"),
            item(_zero("trusted") > 0, "trust_authentication", _count_json("trust_entries", "trusted")),
            item(unless("s_password_encryption", "scram-sha-256"), "weak_password_encryption"),
            item(unless("s_log_connections", "on"), "connection_logging_disabled"),
            item(unless("s_log_disconnections", "on"), "disconnection_logging_disabled"),
            item(F.col("s_log_statement") == "all", "excessive_statement_logging"),
            item(noisy, "potentially_dangerous_extensions"),
            item(unless("s_ssl", "on"), "ssl_disabled"),
            item((_zero("user_tables") > 0) & (_zero("secured") == 0), "no_row_level_security"),
            item(_zero("public_grants") > 0, "public_schema_permissions"),
        ],
    )


def audit_redis(servers: DataFrame, settings: DataFrame, clients: DataFrame, acl: DataFrame) -> DataFrame:
    """Configuration, client and access-list checks. A renamed command is a setting
    ``rename-command <NAME>``; ``clients``: ``server, line``; ``acl``: ``server, line``."""
    renames = [f"rename-command {c}" for c in packs.KV_DANGEROUS_RENAMES]
    known = _settings(
        settings,
        ["requirepass", "bind", "protected-mode", "tls-port", "notify-keyspace-events", "save", "appendonly",
         "appendfsync", "maxmemory", "databases", *renames],
    )
    line = F.col("line")
    per_client = clients.groupBy("server").agg(
        F.count_if((F.trim(line) != "") & ~line.contains("127.0.0.1") & ~line.contains("localhost")).alias("external")
    )
    per_acl = acl.groupBy("server").agg(
        F.count(F.lit(1)).alias("acl_users"),
        F.count_if(line.contains("user default") & line.contains("nopass")).alias("open_default"),
    )
    df = _per_server(servers, known, per_client, per_acl)
    blank = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    secret, bind = F.coalesce(F.col("s_requirepass"), F.lit("")), F.coalesce(F.col("s_bind"), F.lit(""))
    open_bind = bind.contains("0.0.0.0") | (bind == "*")
    item = lambda test, kind, ev=None, sev=None: finding(test, "redis", kind, ev, sev)
    commands = [
        item(
            F.coalesce(F.col(f"s_rename_command {c}"), F.lit(c)) == c,
            "dangerous_commands_enabled",
            F.to_json(F.struct(F.lit(c).alias("command"))),
            F.lit("critical" if c in packs.KV_CRITICAL_COMMANDS else "high"),
        )
        for c in packs.KV_DANGEROUS_RENAMES
    ]
    return _spread(
        df,
        ["server"],
        [
            item(secret == "", "no_authentication"),
            item(
                (secret != "") & ((F.length(secret) < 12) | secret.isin(packs.KV_COMMON_PASSWORDS)),
                "weak_redis_password",
                F.to_json(F.struct(F.length(secret).alias("password_length"))),
            ),
            *commands,
            item(open_bind, "open_bind_address"),
            item(~open_bind & (bind == ""), "no_bind_restriction"),
            item(F.col("s_protected_mode") == "no", "protected_mode_disabled"),
            item(blank("s_tls_port") | (F.col("s_tls_port") == "0"), "tls_not_configured"),
            item(F.col("acl_users") <= 1, "no_acl_users"),
            item((F.col("acl_users") > 1) & (F.col("open_default") > 0), "default_user_no_password"),
            item(~blank("s_notify_keyspace_events"), "keyspace_notifications_enabled"),
            item(blank("s_save"), "no_persistence_configured"),
            item((F.col("s_appendonly") == "yes") & (F.col("s_appendfsync") == "no"), "aof_no_sync"),
            item(blank("s_maxmemory") | (F.col("s_maxmemory") == "0"), "no_memory_limit"),
            item(_zero("external") > 0, "external_client_connections", _count_json("external_clients", "external")),
            item(F.col("s_databases").try_cast("int") > 16, "excessive_databases"),
        ],
    )


def audit_mongo(servers: DataFrame, databases: DataFrame) -> DataFrame:
    """``servers`` carries ``open_status``: the status command answered without a login."""
    found = databases.groupBy("server").agg(F.count_if(F.col("name") == "test").alias("test_dbs"))
    df = servers.select("server", "open_status").join(found, "server", "left")
    return _spread(
        df,
        ["server"],
        [
            finding(F.col("open_status"), "mongodb", "no_authentication"),
            finding(_zero("test_dbs") > 0, "mongodb", "default_databases"),
        ],
    )


def default_eol(spark) -> DataFrame:
    return spark.createDataFrame(packs.EOL_VERSIONS, "db_type string, prefix string, eol string")


def eol_findings(servers: DataFrame, eol: DataFrame, as_of: Column) -> DataFrame:
    """Shortest listed prefix of each server's version that is deprecated (critical) or past its
    end of life (high). Dates that do not parse are skipped.

    Every prefix of the version is an equi-join key, so the version table may have any size.
    """
    listed = eol.withColumn("_date", F.try_to_timestamp("eol", F.lit("yyyy-MM-dd"))).filter(
        (F.col("eol") == "deprecated") | (F.col("_date") < as_of)
    )
    side = listed.select(
        F.col("db_type").alias("_t"),
        F.col("prefix").alias("_p"),
        F.when(F.col("eol") == "deprecated", "deprecated").otherwise("end_of_life").alias("status"),
        F.when(F.col("eol") == "deprecated", "critical").otherwise("high").alias("severity"),
        "eol",
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.length("version")), lambda n: F.substring(F.col("version"), F.lit(1), n)
    )
    tried = servers.filter(F.length("version") > 0).select("server", "db_type", "version", F.explode(prefixes).alias("_try"))
    return (
        tried.join(side, (F.col("db_type") == F.col("_t")) & (F.col("_try") == F.col("_p")))
        .groupBy("server", "db_type", "version")
        .agg(F.min(F.struct("_p", "status", "severity", "eol")).alias("m"))
        .select("server", "db_type", "version", F.col("m._p").alias("prefix"), "m.status", "m.severity", "m.eol")
    )


def tls_findings(servers: DataFrame, as_of: Column, *, ciphers: list[str] | None = None) -> DataFrame:
    """TLS off, version below 1.2, first weak cipher named in the suite, certificate within 30 days.

    ``servers``: ``server, tls_enabled, tls_version, cipher_suite, certificate_expires``.
    """
    suite = F.upper("cipher_suite")
    weak = F.filter(F.array(*[F.lit(c) for c in ciphers or packs.WEAK_CIPHERS]), lambda c: F.contains(suite, c))
    named = servers.withColumn("_weak", F.get(weak, F.lit(0)))
    soon = F.col("certificate_expires") < as_of + F.expr("INTERVAL 30 DAYS")
    old = F.col("tls_enabled") & F.col("tls_version").isNotNull() & (F.col("tls_version") < "TLSv1.2")
    return _spread(
        named,
        ["server"],
        [
            finding(~F.col("tls_enabled"), "any", "tls_disabled"),
            finding(old, "any", "weak_tls_version"),
            finding(F.col("_weak").isNotNull(), "any", "weak_cipher", F.to_json(F.struct(F.col("_weak").alias("cipher")))),
            finding(F.coalesce(soon, F.lit(False)), "any", "certificate_expiring"),
        ],
    )


def default_guidance(spark) -> DataFrame:
    return spark.createDataFrame(packs.GUIDANCE, "type string, guidance string")


def with_remediation(findings: DataFrame, guidance: DataFrame) -> DataFrame:
    side = guidance.select(F.col("type").alias("_g"), F.col("guidance").alias("_text"))
    joined = findings.join(side, F.col("type") == F.col("_g"), "left")
    return joined.withColumn("guidance", F.coalesce("_text", F.lit(packs.GUIDANCE_DEFAULT))).drop("_g", "_text")


def with_knowledge(findings: DataFrame, knowledge: DataFrame, *, default: str = "default") -> DataFrame:
    """``findings`` with all columns of a knowledge base (``type`` and whatever else: title, description, lists of actions, maps of controls).

    Types that it lacks get the entry of the type ``default``, if there is one. Names that findings have already get the prefix ``kb_``.
    """
    details = [c for c in knowledge.columns if c != "type"]
    entry = F.struct(*details)
    side = knowledge.groupBy(F.col("type").alias("_type")).agg(F.min_by(entry, F.xxhash64(F.to_json(entry))).alias("_entry"))
    other = knowledge.where(F.col("type") == default).agg(F.min_by(entry, F.xxhash64(F.to_json(entry)))).scalar()
    joined = findings.join(side, F.col("type") == F.col("_type"), "left").withColumn("_entry", F.coalesce("_entry", other))
    return joined.select(*findings.columns, *(F.col(f"_entry.{c}").alias(f"kb_{c}" if c in findings.columns else c) for c in details))


# --- scans and scores --------------------------------------------------------------------------------------


def scan_issues(scans: DataFrame) -> DataFrame:
    """Nested scan documents to one row per issue (servers without issues are dropped)."""
    servers = scans.select("scan_id", "scan_ts", F.explode("server_results").alias("s"))
    return servers.select(
        "scan_id", "scan_ts", F.col("s.server_name").alias("server"), F.explode("s.issues").alias("i")
    ).select("scan_id", "scan_ts", "server", "i.*")


def _severity(column: str = "severity") -> Column:
    low = F.lower(F.coalesce(F.col(column), F.lit("medium")))
    return F.when(low.isin("critical", "high", "medium"), low).otherwise("low")


def fleet_rollup(issues: DataFrame, servers_checked: DataFrame) -> DataFrame:
    """Per scan: totals by severity (unknown counts as low) and by the five categories.

    ``servers_checked``: ``scan_id, server``; scans without issues keep their zeros.
    """
    checked = servers_checked.groupBy("scan_id").agg(F.count_distinct("server").alias("servers_checked"))
    sums = issues.groupBy(F.col("scan_id").alias("_s")).agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(_severity() == s).alias(f"{s}_issues") for s in packs.SEVERITIES],
        *[F.count_if(F.col("category") == c).alias(c) for c in packs.FINDING_CATEGORIES],
    )
    joined = checked.join(sums, F.col("scan_id") == F.col("_s"), "left").drop("_s")
    return joined.na.fill(0)


def fleet_score(rollup: DataFrame) -> DataFrame:
    possible = F.greatest(F.col("servers_checked") * 20, F.lit(1))
    score = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("total_issues") / possible * 100)
    return rollup.select("scan_id", F.round(score, 1).alias("security_score"))


def server_scores(issues: DataFrame) -> DataFrame:
    """Weighted score per server, worst first: most critical, then most issues."""
    weight = sum(
        (F.when(F.lower("severity") == s, w).otherwise(0) for s, w in WEIGHTS.items()), F.lit(0)
    )
    return (
        issues.groupBy("server")
        .agg(
            F.count(F.lit(1)).alias("total_issues"),
            F.count_if(F.lower("severity") == "critical").alias("critical"),
            F.sum(weight).alias("_w"),
        )
        .select("server", "total_issues", "critical", F.greatest(F.lit(0), 100 - 2 * F.col("_w")).alias("security_score"))
        .orderBy(F.col("critical").desc(), F.col("total_issues").desc(), "server")
    )


def top_categories(issues: DataFrame, k: int = 5) -> DataFrame:
    name = F.initcap(F.replace(F.coalesce(F.col("category"), F.lit("other")), F.lit("_"), F.lit(" ")))
    counted = issues.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "category").limit(k)


def common_issues(issues: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent issue types; title and severity as first seen."""
    first = F.min_by(F.struct("title", "severity"), F.struct("scan_ts", "scan_id", "issue_id"))
    counted = issues.groupBy("type").agg(F.count(F.lit(1)).alias("n"), first.alias("_f"))
    return counted.select("type", "n", "_f.title", "_f.severity").orderBy(F.col("n").desc(), "type").limit(k)


def weekly_summary(scans: DataFrame) -> DataFrame:
    """One row over the scans of a week (``scan_id, scan_ts`` and issue totals)."""
    order = F.struct("scan_ts", "scan_id")
    last, first = (lambda c: F.max_by(c, order)), (lambda c: F.min_by(c, order))
    return scans.agg(
        F.count(F.lit(1)).alias("total_scans"),
        last("critical_issues").alias("critical_now"),
        last("high_issues").alias("high_now"),
        last("total_issues").alias("total_now"),
        last("servers_checked").alias("servers_monitored"),
        F.round(F.avg("critical_issues"), 6).alias("critical_avg"),
        F.max("critical_issues").alias("critical_max"),
        F.round(F.avg("high_issues"), 6).alias("high_avg"),
        F.round(F.avg("total_issues"), 6).alias("total_avg"),
        ((F.count(F.lit(1)) > 1) & (last("total_issues") < first("total_issues"))).alias("improving"),
    )


def weekly_recommendations(scans: DataFrame) -> DataFrame:
    """Recommendation texts of a week; the last three scans are found without a global sort."""
    last3 = scans.orderBy(F.col("scan_ts").desc(), F.col("scan_id").desc()).limit(3)
    tail = last3.agg(F.min("total_issues").alias("least"))
    order = F.struct("scan_ts", "scan_id")
    facts = scans.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("critical_issues", order).alias("critical"),
        F.max_by("total_issues", order).alias("total"),
    ).crossJoin(F.broadcast(tail))
    texts = F.array_compact(
        F.array(
            F.when(F.col("critical") > 0, F.lit("Address critical security issues immediately")),
            F.when(F.col("total") > 20, F.lit("Consider implementing automated remediation for common issues")),
            F.when((F.col("n") > 3) & (F.col("least") > 5), F.lit("Review and prioritize persistent security issues")),
        )
    )
    chosen = F.when(F.size(texts) > 0, texts).otherwise(
        F.array(F.lit("Continue monitoring for new security issues"))
    )
    return facts.filter("n > 0").select(F.posexplode(chosen).alias("ord", "recommendation"))


def should_notify(df: DataFrame, threshold: str) -> DataFrame:
    critical, high = F.col("critical_issues") > 0, F.col("high_issues") > 0
    rule = {
        "critical": critical,
        "high": critical | high,
        "medium": F.col("total_issues") > 0,
        "low": F.lit(True),
        "none": F.lit(False),
    }.get(threshold, critical)
    return df.withColumn("notify", rule)


# --- compliance ----------------------------------------------------------------------------------------------


def apply_waivers(tests: DataFrame, waivers: DataFrame) -> DataFrame:
    """Tests that are not waived."""
    return tests.join(waivers.select(F.col("test_id").alias("_w")), F.col("test_id") == F.col("_w"), "left_anti")


def compliance_score(findings: DataFrame, waivers: DataFrame | None = None) -> DataFrame:
    """Per framework: tests, passed, failed (errors fail), skipped (waived and other) and score.

    The total counts waived tests too.
    """
    if waivers is not None:
        side = waivers.select(F.col("test_id").alias("_w")).distinct()
        findings = findings.join(side, F.col("test_id") == F.col("_w"), "left")
        waived = F.col("_w").isNotNull()
    else:
        waived = F.lit(False)
    status = F.col("status")
    return findings.groupBy("framework").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~waived & (status == "pass")).alias("passed"),
        F.count_if(~waived & status.isin("fail", "error")).alias("failed"),
        F.count_if(waived | ~status.isin("pass", "fail", "error")).alias("skipped"),
        F.round(F.count_if(~waived & (status == "pass")) / F.count(F.lit(1)) * 100.0, 4).alias("score"),
    )


def compliance_summary(findings: DataFrame) -> DataFrame:
    """Per framework findings by severity, passes included, and whether criticals need action."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in packs.SEVERITIES]
    return findings.groupBy("framework").agg(*counts).withColumn("urgent", F.col("critical") > 0)


def compliance_categories(findings: DataFrame) -> DataFrame:
    category = F.split_part("test_id", F.lit("."), F.lit(1)).alias("category")
    return findings.groupBy("framework", category).agg(F.count(F.lit(1)).alias("n"))


def compliance_tests(inventory: DataFrame, *, allowed_ports: list[int] | None = None) -> DataFrame:
    """Open-port and password-policy tests per host; other tests are skipped.

    ``inventory``: ``host, open_ports array<int>, min_length, upper, lower, digits, special``.
    """
    allowed = F.array(*[F.lit(p) for p in allowed_ports or packs.ALLOWED_PORTS])
    extra = F.sort_array(F.array_except("open_ports", allowed))
    strong = (F.col("min_length") >= 12) & F.col("upper") & F.col("lower") & F.col("digits") & F.col("special")
    tests = []
    for framework, test_id, expected, severity in packs.COMPLIANCE_TESTS:
        status = F.when(strong, "pass").otherwise("fail") if expected == "strong_password_policy" else F.lit("skip")
        tests.append((framework, test_id, severity, status, F.lit("")))
    ports = F.when(F.size(extra) > 0, "fail").otherwise("pass")
    tests.append(("network", "NET001", "high", ports, F.concat_ws(",", extra.cast("array<string>"))))
    items = [
        F.struct(
            F.lit(f).alias("framework"), F.lit(t).alias("test_id"), F.lit(s).alias("severity"), st.alias("status"),
            d.alias("details"),
        )
        for f, t, s, st, d in tests
    ]
    return inventory.select("host", F.explode(F.array(*items)).alias("t")).select("host", "t.*")


def framework_tests(inventory: DataFrame, tests: DataFrame) -> DataFrame:
    """(host, framework, test_id, severity, status, details): every test of a table of frameworks for every host.

    ``tests``: ``framework, test_id, type, expected, severity, parameters map<string,string>``. A ``network`` test fails on open ports beyond the parameter ``ports`` (a list with
    commas), a ``config`` test that expects ``strong_password_policy`` on a weaker one than 12 characters (or ``min_length``) of all kinds, an ``access`` test on more open ports than
    ``most``; other tests are skipped. The tests travel with the plan as one value, the hosts are not shuffled.
    """
    listed = tests.agg(F.array_sort(F.collect_list(F.struct("framework", "test_id", "type", "expected", "severity", F.map_entries("parameters").alias("parameters"))))).scalar()
    rows = inventory.withColumn("_tests", listed).select("*", F.explode("_tests").alias("t"))
    told = lambda name: F.map_from_entries("t.parameters")[name]
    extra = F.sort_array(F.array_except("open_ports", F.transform(F.split(F.coalesce(told("ports"), F.lit("")), ","), lambda p: p.try_cast("int"))))
    strong = (F.col("min_length") >= F.coalesce(told("min_length").try_cast("int"), F.lit(12))) & F.col("upper") & F.col("lower") & F.col("digits") & F.col("special")
    verdict = lambda ok: F.when(ok, "pass").otherwise("fail")
    kind = F.col("t.type")
    status = (
        F.when(kind == "network", verdict(F.size(extra) == 0))
        .when((kind == "config") & (F.col("t.expected") == "strong_password_policy"), verdict(strong))
        .when(kind == "access", verdict(F.size("open_ports") <= F.coalesce(told("most").try_cast("int"), F.lit(0))))
        .otherwise("skip")
    )
    details = F.when(kind == "network", F.concat_ws(",", extra.cast("array<string>"))).otherwise("")
    return rows.select("host", "t.framework", "t.test_id", "t.severity", status.alias("status"), details.alias("details"))
