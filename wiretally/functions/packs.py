"""Word lists, patterns and lookup tables the results depend on.

Patterns are written with ``\\b`` as an ASCII word boundary unless a list says otherwise.
Every entry of a pattern list is a group of alternatives; a group hits when one of them is found.
"""

# --- fixed values: injection pattern groups, matched on lower-cased text -------------------------

INJECTION_GROUPS = [
    [r"\bunion\b.*\bselect\b", r"\bselect\b.*\bunion\b"],
    [r";\s*drop\s+", r";\s*delete\s+", r";\s*truncate\s+", r";\s*alter\s+"],
    [r"\bor\b\s*\d+\s*=\s*\d+", r"\band\b\s*\d+\s*=\s*\d+"],
    [r"--", r"#", r"/\*", r"\*/"],
    [r"\bexec\s*\(", r"\bexecute\s*\("],
    [r"\bxp_cmdshell\b", r"\bcmd\.exe\b"],
    [r"\bwaitfor\s+delay\b", r"\bsleep\s*\("],
    [r"\bbenchmark\s*\(", r"\bpg_sleep\s*\("],
    [r"\binformation_schema\b", r"\bsys\.tables\b", r"\bsyscolumns\b"],
    [r"\bload_file\s*\(", r"\binto\s+outfile\b", r"\binto\s+dumpfile\b"],
    [r"\bupdatexml\s*\(", r"\bextractvalue\s*\("],
    [r"0x[0-9a-f]+", r"\bhex\s*\(", r"\bunhex\s*\("],
    [r"\bconcat\s*\(.*\bchar\s*\(", r"\bchar\s*\(.*\bconcat\s*\("],
    [r"\bhaving\b.*\bselect\b", r"\bhaving\b.*\bunion\b",
     r"\bgroup\s+by\b.*\bselect\b", r"\bgroup\s+by\b.*\bunion\b"],
    [r"\bsystem\s*\(", r"\bshell_exec\s*\(", r"\bpassthru\s*\("],
    [r"\bproc_open\s*\(", r"\bpopen\s*\("],
    [r"\bcmd\b", r"\bpowershell\b", r"\bbash\b", r"\bsh\b"],
    [r"/bin/", r"/usr/bin/", r"/sbin/", r"/usr/sbin/"],
    [r"\bchmod\b", r"\bchown\b", r"\bsu\b", r"\bsudo\b"],
    [r"\bkill\b", r"\bkillall\b", r"\bps\b", r"\btop\b"],
    [r"\bcat\b\s+/", r"\btail\b\s+/", r"\bhead\b\s+/"],
    [r"\bls\b\s+/", r"\bfind\b\s+/", r"\bgrep\b\s+-r"],
    [r"\bwget\b", r"\bcurl\b", r"\bnc\b", r"\bnetcat\b"],
    [r"\bmkdir\b", r"\brmdir\b", r"\brm\b\s+-rf"],
    [r"\bcp\b\s+/", r"\bmv\b\s+/", r"\btar\b\s+-"],
    [r"\bawk\b", r"\bsed\b", r"\bperl\b", r"\bpython\b"],
    [r"\bvi\b", r"\bvim\b", r"\bnano\b", r"\bemacs\b"],
    [r"\b\|\s*sh\b", r"\b\|\s*bash\b", r"\b&&\s*sh\b"],
    [r"\$\(.*\)", r"`.*`", r"\beval\b"],
    [r"\bsp_oacreate\b", r"\bsp_oamethod\b", r"\bsp_oadestroy\b"],
    [r"\bopenrowset\b", r"\bopendatasource\b", r"\blinkedserver\b"],
    [r"\bbulk\s+insert\b", r"\bbcp\b", r"\bsqlcmd\b"],
    [r"\bcreate\s+function\b", r"\bcreate\s+procedure\b"],
    [r"\bgrant\s+execute\b", r"\bgrant\s+all\b"],
    [r"\breg\s+add\b", r"\breg\s+delete\b", r"\breg\s+query\b"],
    [r"\bhkey_local_machine\b", r"\bhkey_current_user\b"],
    [r"\bsc\s+create\b", r"\bsc\s+start\b", r"\bsc\s+stop\b"],
    [r"\bnet\s+user\b", r"\bnet\s+localgroup\b"],
    [r"\bwmic\b", r"\brundll32\b", r"\bregsvr32\b"],
    [r"\btest\b", r"\bsample\b", r"\bdemo\b", r"\bexample\b"],
    [r"\bmaster\.", r"\bmsdb\.", r"\btempdb\.", r"\bmodel\."],
    [r"\broot\b", r"\bsa\b", r"\badmin\b", r"\bguest\b"],
    [r"\bmysql\.user\b", r"\bmysql\.db\b", r"\bpg_user\b"],
]

# --- fixed values: shell pattern groups, matched on lower-cased text -----------------------------

SHELL_GROUPS = [
    [r"\bsystem\s*\(", r"\bshell_exec\s*\(", r"\bpassthru\s*\("],
    [r"\bcmd\b", r"\bpowershell\b", r"\bbash\b", r"\bsh\b"],
    [r"/bin/", r"/usr/bin/", r"/sbin/", r"/usr/sbin/"],
    [r"\bchmod\b", r"\bchown\b", r"\bsu\b", r"\bsudo\b"],
    [r"\$\(.*\)", r"`.*`", r"\beval\b"],
    [r"\b\|\s*sh\b", r"\b\|\s*bash\b", r"\b&&\s*sh\b"],
    [r"\bxp_cmdshell\b", r"\bcmd\.exe\b"],
]

# --- fixed values: script validation; (pattern, message), Unicode word boundaries ----------------

SCRIPT_DANGEROUS = [
    (r"exec\s*\(", "Potentially dangerous EXEC statement"),
    (r"xp_cmdshell", "System command execution detected"),
    (r"sp_oacreate", "OLE automation detected"),
    (r"openrowset", "External data source access"),
    (r"opendatasource", "External data source access"),
    (r"bulk\s+insert", "Bulk insert operation"),
    (r"into\s+outfile", "File write operation detected"),
    (r"load_file\s*\(", "File read operation detected"),
    (r"@@version", "System information disclosure"),
    (r"information_schema", "Schema introspection detected"),
    (r"sys\.", "System table access"),
    (r"master\.", "Master database access"),
    (r"msdb\.", "MSDB database access"),
    (r"tempdb\.", "TempDB access"),
    (r"--\s*[^\r\n]*(\r?\n|$)", "SQL comments detected"),
    (r"/\*.*?\*/", "Block comments detected"),
    (r"\bor\s+1\s*=\s*1\b", "Classic SQL injection pattern"),
    (r"\bunion\s+select\b", "Union-based injection pattern"),
    (r";\s*(drop|truncate|delete)\s+", "Destructive operations in sequence"),
]

SCRIPT_SHELL = [
    (r"\bcmd\b", "Command shell reference"),
    (r"\bpowershell\b", "PowerShell reference"),
    (r"\bbash\b", "Bash shell reference"),
    (r"\bsh\b", "Shell reference"),
    (r"/bin/", "Unix binary path"),
    (r"system\s*\(", "System call"),
    (r"shell_exec", "Shell execution"),
    (r"passthru", "Command execution"),
    (r"proc_open", "Process execution"),
]

SCRIPT_DEFAULTS = [
    (r"\btest\b", "Test database access"),
    (r"\bsample\b", "Sample database access"),
    (r"\bdemo\b", "Demo database access"),
    (r"\bexample\b", "Example database access"),
    (r"\bsa\b", "Default 'sa' user detected"),
    (r"\broot\b", "Root user access"),
    (r"\badmin\b", "Admin user access"),
    (r"\bguest\b", "Guest user access"),
]

# --- fixed values: statement and command classes -------------------------------------------------

WRITE_KEYWORDS = [
    "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "TRUNCATE", "RENAME", "REPLACE",
    "MERGE", "CALL", "LOCK", "GRANT", "REVOKE", "SET", "BEGIN", "COMMIT", "ROLLBACK",
    "SAVEPOINT", "RELEASE", "START",
]

KV_BLOCKED = [
    "FLUSHDB", "FLUSHALL", "SHUTDOWN", "DEBUG", "CONFIG", "CLIENT", "MONITOR", "SYNC", "PSYNC",
    "REPLCONF", "EVAL", "EVALSHA", "SCRIPT", "MIGRATE", "RESTORE", "DUMP", "CLUSTER", "MODULE",
    "ACL", "INFO", "SLOWLOG", "LATENCY",
]

KV_BLOCKED_CLUSTER = [
    "FLUSHDB", "FLUSHALL", "SHUTDOWN", "DEBUG", "CONFIG", "EVAL", "EVALSHA", "SCRIPT", "CLIENT",
    "MONITOR", "SYNC", "PSYNC", "CLUSTER", "MODULE", "ACL",
]

KV_READS = [
    "GET", "MGET", "HGET", "HGETALL", "HMGET", "LLEN", "LRANGE", "SMEMBERS", "SCARD", "ZRANGE",
    "ZCARD", "EXISTS", "TTL", "TYPE",
]

KV_WRITES = [
    "SET", "SETNX", "SETEX", "PSETEX", "MSET", "MSETNX", "APPEND", "INCR", "INCRBY",
    "INCRBYFLOAT", "DECR", "DECRBY", "DEL", "UNLINK", "EXPIRE", "EXPIREAT", "PEXPIRE",
    "PEXPIREAT", "PERSIST", "RENAME", "RENAMENX", "HSET", "HSETNX", "HMSET", "HINCRBY",
    "HINCRBYFLOAT", "HDEL", "LPUSH", "LPUSHX", "RPUSH", "RPUSHX", "LPOP", "RPOP", "LREM", "LSET",
    "LTRIM", "LINSERT", "RPOPLPUSH", "BRPOPLPUSH", "SADD", "SREM", "SPOP", "SMOVE", "ZADD",
    "ZREM", "ZINCRBY", "ZREMRANGEBYSCORE", "ZREMRANGEBYRANK", "ZREMRANGEBYLEX", "XADD", "XDEL",
    "XTRIM", "FLUSHDB", "FLUSHALL", "SELECT", "SWAPDB", "MULTI", "EXEC", "DISCARD", "WATCH",
    "UNWATCH", "PUBLISH", "EVAL", "EVALSHA",
]

DOC_OPERATIONS = ["find", "insert", "update", "delete", "drop", "eval", "mapreduce"]

DOC_BLOCKED_OPERATIONS = [
    "eval", "mapreduce", "group", "where", "copydb", "clone", "shutdown", "killop", "fsync",
    "dropDatabase",
]

DOC_BLOCKED_COLLECTIONS = [
    "system.users", "system.roles", "system.version", "system.replset", "system.indexBuilds",
]

DOC_WRITES = [
    "insert", "update", "delete", "remove", "save", "drop", "dropDatabase", "createIndex",
    "dropIndex", "dropIndexes", "create", "convertToCapped", "emptycapped", "renameCollection",
]

DB_PORTS = [3306, 5432, 1433, 27017, 6379]

DB_TYPES = ["mysql", "postgresql", "mssql", "mongodb", "redis"]

# --- fixed values: default blocked resources; (kind, pattern, reason), in match order ------------

DEFAULT_BLOCKED = [
    ("database", "^test$", "Default test database"),
    ("database", "^sample$", "Default sample database"),
    ("database", "^demo$", "Default demo database"),
    ("database", "^example$", "Default example database"),
    ("database", "^temp$", "Temporary database"),
    ("database", "^tmp$", "Temporary database"),
    ("database", "^master$", "SQL Server system database"),
    ("database", "^msdb$", "SQL Server system database"),
    ("database", "^tempdb$", "SQL Server system database"),
    ("database", "^model$", "SQL Server system database"),
    ("database", "^mysql$", "MySQL system database"),
    ("database", "^sys$", "MySQL system database"),
    ("database", "^information_schema$", "MySQL information schema"),
    ("database", "^performance_schema$", "MySQL performance schema"),
    ("database", "^postgres$", "PostgreSQL default database"),
    ("database", "^template0$", "PostgreSQL template database"),
    ("database", "^template1$", "PostgreSQL template database"),
    ("database", "^admin$", "MongoDB admin database"),
    ("database", "^local$", "MongoDB local database"),
    ("database", "^config$", "MongoDB config database"),
    ("database", "^test_.*", "Test database pattern"),
    ("database", "^sample_.*", "Sample database pattern"),
    ("database", "^demo_.*", "Demo database pattern"),
    ("database", ".*_backup$", "Backup database pattern"),
    ("database", ".*_old$", "Old database pattern"),
    ("username", "^sa$", "SQL Server default admin account"),
    ("username", "^root$", "Default root account"),
    ("username", "^admin$", "Default admin account"),
    ("username", "^administrator$", "Default administrator account"),
    ("username", "^guest$", "Default guest account"),
    ("username", "^test$", "Test user account"),
    ("username", "^demo$", "Demo user account"),
    ("username", "^sample$", "Sample user account"),
    ("username", "^user$", "Generic user account"),
    ("username", "^mysql$", "MySQL service account"),
    ("username", "^postgres$", "PostgreSQL default account"),
    ("username", "^oracle$", "Oracle default account"),
    ("username", "^sqlserver$", "SQL Server service account"),
    ("username", "^$", "Empty/anonymous username"),
    ("username", "^anonymous$", "Anonymous user account"),
    ("username", "^test_.*", "Test user pattern"),
    ("username", ".*admin.*", "Admin user pattern"),
    ("table", "^user$", "System user table"),
    ("table", "^users$", "System users table"),
    ("table", r"^mysql\.user$", "MySQL user table"),
    ("table", "^pg_user$", "PostgreSQL user table"),
    ("table", "^sysusers$", "SQL Server system users"),
    ("table", "^sysobjects$", "SQL Server system objects"),
    ("table", r"^information_schema\..*", "Information schema tables"),
]

# --- fixed values: versions, ciphers and command lists of the health rules -----------------------

EOL_VERSIONS = [
    ("mysql", "5.6", "2021-02-05"),
    ("mysql", "5.7", "2023-10-31"),
    ("mysql", "8.0.0-8.0.16", "deprecated"),
    ("postgresql", "9.6", "2021-11-11"),
    ("postgresql", "10", "2022-11-10"),
    ("postgresql", "11", "2023-11-09"),
    ("postgresql", "12", "2024-11-14"),
    ("redis", "4.0", "2021-07-01"),
    ("redis", "5.0", "2022-04-01"),
    ("redis", "6.0.0-6.0.8", "critical_vulnerabilities"),
    ("mongodb", "3.6", "2021-04-30"),
    ("mongodb", "4.0", "2022-04-30"),
    ("mongodb", "4.2", "2023-04-30"),
]

WEAK_CIPHERS = [
    "RC4", "DES", "MD5", "SHA1", "NULL", "aNULL", "eNULL", "EXPORT", "DES+MD5", "RC4+MD5",
    "RC4+SHA", "SEED", "IDEA", "CAMELLIA",
]

KV_DANGEROUS_RENAMES = [
    "FLUSHALL", "FLUSHDB", "CONFIG", "DEBUG", "EVAL", "SHUTDOWN", "SCRIPT", "KEYS", "MONITOR",
    "CLIENT", "SLOWLOG", "LASTSAVE", "SAVE", "BGSAVE", "BGREWRITEAOF",
]

FINDING_CATEGORIES = [
    "tls_issues", "version_issues", "credential_issues", "configuration_issues", "security_issues",
]

SEVERITIES = ["critical", "high", "medium", "low"]

COMPONENTS = [
    "xdp_controller", "cache_manager", "redis_cluster", "deployment_manager", "multiwrite_manager",
]

INSTANCE_LADDERS = [
    ["db.t3.micro", "db.t3.small", "db.t3.medium", "db.t3.large", "db.t3.xlarge", "db.t3.2xlarge"],
    ["db-f1-micro", "db-g1-small", "db-n1-standard-1", "db-n1-standard-2", "db-n1-standard-4",
     "db-n1-standard-8"],
    ["small", "medium", "large", "xlarge", "2xlarge"],
]

# name, priority, cooldown seconds, [(metric, operator, value, weight)]
TUNING_RULES = [
    ("xdp_cache_size_optimization", 1, 300,
     [("cache_hit_ratio", "lt", 0.9, 1.0), ("memory_pressure", "lt", 0.7, 0.8)]),
    ("numa_worker_rebalancing", 2, 600,
     [("numa_efficiency", "lt", 0.9, 1.0), ("cross_numa_traffic", "gt", 0.1, 0.9)]),
    ("xdp_rate_limit_adjustment", 3, 120,
     [("packets_per_second", "gt", 50000000.0, 1.0), ("drop_rate", "gt", 0.001, 0.8)]),
    ("connection_pool_scaling", 4, 900,
     [("connection_utilization", "gt", 0.8, 1.0), ("latency_p95", "gt", 0.005, 0.7)]),
    ("afxdp_batch_size_optimization", 5, 180,
     [("afxdp_ring_utilization", "gt", 0.7, 1.0), ("batch_efficiency", "lt", 0.8, 0.9)]),
    ("emergency_performance_mode", 10, 30,
     [("latency_p99", "gt", 0.02, 1.0), ("error_rate", "gt", 0.05, 1.0)]),
]

# Prometheus default bucket bounds, seconds
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# --- fixed values: health findings; (engine, type, severity, category, title) --------------------

HEALTH_FINDINGS = [
    ("any", "version_eol", "high", "version_issues", "End-of-Life Database Version"),
    ("any", "tls_disabled", "high", "tls_issues", "TLS Not Enabled"),
    ("any", "weak_tls_version", "high", "tls_issues", "Weak TLS Version"),
    ("any", "weak_cipher", "medium", "tls_issues", "Weak Cipher Suite"),
    ("any", "certificate_expiring", "medium", "tls_issues", "TLS Certificate Expiring Soon"),
    ("mysql", "default_credentials", "critical", "credential_issues", "Default/Empty Passwords Detected"),
    ("mysql", "default_databases", "medium", "configuration_issues", "Default Test Databases Present"),
    ("mysql", "excessive_file_privileges", "high", "security_issues", "Excessive File Privileges"),
    ("mysql", "remote_root_access", "critical", "security_issues", "Remote Root Access Enabled"),
    ("mysql", "wildcard_host_access", "high", "security_issues", "Wildcard Host Access"),
    ("mysql", "excessive_admin_users", "medium", "security_issues", "Too Many Administrative Users"),
    ("mysql", "no_password_validation", "medium", "security_issues", "Password Validation Plugin Not Enabled"),
    ("mysql", "ssl_not_configured", "high", "tls_issues", "SSL/TLS Not Properly Configured"),
    ("mysql", "binary_logging_disabled", "medium", "configuration_issues", "Binary Logging Disabled"),
    ("mysql", "general_logging_enabled", "low", "configuration_issues", "General Logging Enabled"),
    ("mysql", "skip_grant_tables", "critical", "security_issues", "Grant Tables Bypassed"),
    ("mysql", "old_password_hashing", "high", "security_issues", "Old Password Hashing Enabled"),
    ("mysql", "anonymous_users", "high", "security_issues", "Anonymous Users Present"),
    ("mysql", "weak_passwords_detected", "critical", "credential_issues", "Weak Passwords Detected"),
    ("postgresql", "users_no_password", "critical", "credential_issues", "Users Without Passwords"),
    ("postgresql", "excessive_superuser_accounts", "high", "security_issues", "Excessive Superuser Accounts"),
    ("postgresql", "excessive_createrole_privilege", "medium", "security_issues", "Excessive CREATEROLE Privileges"),
    ("postgresql", "excessive_createdb_privilege", "medium", "security_issues", "Excessive CREATEDB Privileges"),
    ("postgresql", "only_default_databases", "low", "configuration_issues", "Only Default Databases Present"),
    ("postgresql", "trust_authentication", "critical", "security_issues", "Trust Authentication Enabled"),
    ("postgresql", "weak_password_encryption", "medium", "security_issues", "Weak Password Encryption"),
    ("postgresql", "connection_logging_disabled", "medium", "configuration_issues", "Connection Logging Disabled"),
    ("postgresql", "disconnection_logging_disabled", "low", "configuration_issues", "Disconnection Logging Disabled"),
    ("postgresql", "excessive_statement_logging", "medium", "configuration_issues", "Excessive Statement Logging"),
    ("postgresql", "potentially_dangerous_extensions", "low", "configuration_issues",
     "Performance Monitoring Extensions Loaded"),
    ("postgresql", "ssl_disabled", "high", "tls_issues", "SSL Not Enabled"),
    ("postgresql", "no_row_level_security", "low", "security_issues", "Row-Level Security Not Used"),
    ("postgresql", "public_schema_permissions", "medium", "security_issues", "Public Schema Has Public Permissions"),
    ("redis", "no_authentication", "critical", "credential_issues", "No Authentication Required"),
    ("redis", "weak_redis_password", "high", "credential_issues", "Weak Redis Password"),
    ("redis", "dangerous_commands_enabled", "high", "security_issues", "Dangerous Command Available"),
    ("redis", "open_bind_address", "high", "configuration_issues", "Redis Bound to All Interfaces"),
    ("redis", "no_bind_restriction", "medium", "configuration_issues", "No Bind Restriction Configured"),
    ("redis", "protected_mode_disabled", "high", "security_issues", "Protected Mode Disabled"),
    ("redis", "tls_not_configured", "medium", "tls_issues", "TLS Not Configured"),
    ("redis", "no_acl_users", "medium", "security_issues", "No ACL Users Configured"),
    ("redis", "default_user_no_password", "critical", "credential_issues", "Default User Has No Password"),
    ("redis", "keyspace_notifications_enabled", "low", "configuration_issues", "Keyspace Notifications Enabled"),
    ("redis", "no_persistence_configured", "medium", "configuration_issues", "No Persistence Configured"),
    ("redis", "aof_no_sync", "medium", "configuration_issues", "AOF No Sync Policy"),
    ("redis", "no_memory_limit", "low", "configuration_issues", "No Memory Limit Configured"),
    ("redis", "external_client_connections", "low", "security_issues", "External Client Connections Detected"),
    ("redis", "excessive_databases", "low", "configuration_issues", "Too Many Databases Configured"),
    ("mongodb", "no_authentication", "critical", "credential_issues", "No Authentication Required"),
    ("mongodb", "default_databases", "low", "configuration_issues", "Default Test Databases Present"),
]

KV_CRITICAL_COMMANDS = ["FLUSHALL", "FLUSHDB", "SHUTDOWN"]
KV_COMMON_PASSWORDS = ["password", "redis", "123456", "admin"]
PG_NOISY_LIBRARIES = ["auto_explain", "pg_stat_statements"]

# issue type and the title of its guidance
GUIDANCE = [
    ("default_credentials", "Default or Weak Credentials"),
    ("tls_disabled", "TLS/SSL Not Enabled"),
    ("weak_tls_version", "Weak TLS Version"),
    ("version_eol", "End-of-Life Database Version"),
    ("excessive_privileges", "Excessive User Privileges"),
    ("no_authentication", "Authentication Disabled"),
    ("dangerous_commands_enabled", "Dangerous Commands Enabled"),
    ("open_bind_address", "Database Bound to All Interfaces"),
]
GUIDANCE_DEFAULT = "Unknown Issue Type"

ALLOWED_PORTS = [22, 80, 443, 3306, 5432, 6379]

# framework, test id, expectation, severity
COMPLIANCE_TESTS = [
    ("SOC2", "CC1.1", "strong_password_policy", "high"),
    ("SOC2", "CC2.1", "tls_1_2_minimum", "critical"),
    ("NIST", "ID.AM-1", "device_inventory_maintained", "medium"),
    ("NIST", "PR.AC-1", "access_control_implemented", "high"),
    ("HIPAA", "164.308(a)(1)(i)", "security_officer_assigned", "high"),
]
