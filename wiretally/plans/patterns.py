"""Queries over fingerprints, latency averages, the latency model, advice, hashes and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import commands as C
from wiretally.functions import fingerprint as fp
from wiretally.functions import keys as K
from wiretally.operators import latency as L
from wiretally.plans.inputs import AS_OF, as_of, ctes, derive, load
from wiretally.plans.registry import query

DAY = 86_400  # slice width the queries use: the given log is thin

SQL_TEMPLATE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(query)),
  '\b\d+\b', '?', 'g'), '''[^'']*''', '?', 'g'), '"[^"]*"', '?', 'g'), '\s+', ' ', 'g')"""


def ordered_distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


SQL_REFS = (
    "list_transform(regexp_extract_all(query, "
    r"'(?i)\b(?:from|join)\s+([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)?)', 1), "
    "lambda r: lower(string_split(r, '.')[-1]))"
)

PATTERNED = f"""{ctes('query_log')}, marked AS (SELECT *, md5(template) AS pattern_id FROM (SELECT *, {SQL_TEMPLATE} AS template FROM query_log))"""


def sql_count(text: str, needle: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{needle}', ''))) / {len(needle)} AS INT)"


SQL_COMPLEXITY = (
    "("
    + " + ".join(
        f"CASE WHEN contains(lower(query), '{w}') THEN {p} ELSE 0.0 END"
        for w, p in [("select", 1.0), ("insert", 1.5), ("update", 2.0), ("delete", 2.0)]
        + [(a, 0.3) for a in fp.AGGREGATES]
        + [("order by", 0.2), ("group by", 0.3), ("having", 0.4)]
    )
    + r" + len(regexp_extract_all(query, '(?i)\bjoin\b')) * 0.5"
    + f" + greatest({sql_count('lower(query)', 'select')} - 1, 0) + {sql_count('lower(query)', 'union')} * 0.5)::DOUBLE"
)


def ema_sql(source: str, key: str, value: str, alpha: float = 0.1, order: str = "ts, log_id") -> str:
    """Weighted sum from the end of each series."""
    desc = ", ".join(f"{c.strip()} DESC" for c in order.split(","))
    return f"""SELECT {key}, count(*) AS n, sum({alpha} * {value} * pow({1 - alpha}, back)) AS ema FROM (
      SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY {desc}) - 1 AS back FROM {source}) GROUP BY 1"""


@query(
    "pattern_top10",
    f"""{PATTERNED} SELECT pattern_id, min(template) AS template, count(*) AS frequency FROM marked GROUP BY 1
    ORDER BY frequency DESC, pattern_id LIMIT 10""",
)
def _(spark, sf):
    return L.top_patterns(L.pattern_stats(derive(spark, sf, "query_log"))).drop("last_seen")


@query(
    "text_templates",
    f"""SELECT template, count(*) AS n FROM (SELECT {SQL_TEMPLATE.replace('query', 'text')} AS template FROM conversations) GROUP BY 1""",
)
def _(spark, sf):
    text = load(spark, sf, "conversations").select(fp.normalize_sql(F.col("text")).alias("template"))
    return text.groupBy("template").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pattern_cap",
    f"""{PATTERNED} SELECT pattern_id, epoch_us(max(ts)) AS last_seen_us FROM marked GROUP BY 1
    ORDER BY max(ts) DESC, pattern_id LIMIT 3""",
)
def _(spark, sf):
    newest = L.cap_patterns(L.pattern_stats(derive(spark, sf, "query_log")), 3)
    return newest.select("pattern_id", F.unix_micros("last_seen").alias("last_seen_us"))


@query(
    "execution_history",
    f"""{PATTERNED} SELECT pattern_id, user_id, log_id, round(latency, 6) AS latency FROM (
      SELECT *, row_number() OVER (PARTITION BY pattern_id, user_id ORDER BY ts DESC, log_id DESC) AS r FROM marked) WHERE r = 1""",
)
def _(spark, sf):
    marked = L.with_pattern(derive(spark, sf, "query_log"))
    newest = L.latest(marked, ["pattern_id", "user_id"], ["ts", "log_id"], ["log_id", "latency"])
    return newest.withColumn("latency", F.round("latency", 6))


@query(
    "training_trim",
    f"SELECT count(*) AS kept, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}'",
)
def _(spark, sf):
    kept = L.trim_history(load(spark, sf, "events").select("ts", "event_id"), "ts", as_of())
    return kept.agg(
        F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "training_half",
    """WITH r AS (SELECT event_type, event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank, count(*) OVER () AS n FROM events)
    SELECT event_type, count(*) AS kept, sum(event_id)::BIGINT AS ids, min(event_id) AS first_id FROM r WHERE n <= 600 OR rank <= n // 2 GROUP BY 1""",
)
def _(spark, sf):
    kept = L.trim_training(load(spark, sf, "events"), "ts", "event_id", 300)
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"), F.sum("event_id").alias("ids"), F.min("event_id").alias("first_id"))


@query(
    "latency_ema",
    f"""{PATTERNED} SELECT pattern_id, n, round(ema, 6) AS avg_latency FROM ({ema_sql('marked', 'pattern_id', 'latency')})""",
)
def _(spark, sf):
    marked = L.with_pattern(derive(spark, sf, "query_log"))
    averages = L.latency_ema(marked, slice_seconds=DAY)
    return averages.withColumn("avg_latency", F.round("avg_latency", 6))


@query(
    "latency_series",
    f"""{ctes('query_log')}, ranked AS (SELECT user_id, log_id, latency,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, log_id) AS rn FROM query_log)
    SELECT a.log_id, round(sum(0.1 * b.latency * pow(0.9, a.rn - b.rn)) + 1e-9, 6) AS ema
    FROM ranked a JOIN ranked b ON a.user_id = b.user_id AND b.rn <= a.rn GROUP BY 1""",
)
def _(spark, sf):
    log = derive(spark, sf, "query_log").select("user_id", "ts", "log_id", "latency")
    series = L.ema_series(log, "user_id", "ts", "log_id", "latency", slice_seconds=DAY * 7)
    # the offset keeps exact halves of short series from rounding by summation order
    return series.select("log_id", F.round(F.col("ema") + 1e-9, 6).alias("ema"))


PROFILE = f"""{PATTERNED}, avgs AS ({ema_sql('marked', 'pattern_id', 'latency')}),
  measured AS ({ema_sql('marked', 'pattern_id', 'latency').replace('latency *', 'latency / 100.0 *')}),
  texts AS (SELECT pattern_id, min(template) AS template, arg_min(query, (ts, log_id)) AS query FROM marked GROUP BY 1),
  profile AS (SELECT t.pattern_id, a.n, a.ema AS avg_latency, template, query,
    {ordered_distinct(SQL_REFS)} AS tables,
    list_filter(['SELECT','INSERT','UPDATE','DELETE','CREATE','ALTER','DROP'],
      lambda o: regexp_matches(query, '(?i)\\b' || o || '\\b')) AS operations,
    CAST(len(regexp_extract_all(query, '(?i)\\bjoin\\b')) AS INT) AS join_count,
    CAST(len(regexp_extract_all(query, '\\b\\d+\\b')) + len(regexp_extract_all(query, '''[^'']*''')) AS INT) AS parameter_count,
    {sql_count('template', 'where')} AS where_count,
    {SQL_COMPLEXITY} AS static_complexity,
    m.ema + {SQL_COMPLEXITY} * pow(0.9, a.n) AS complexity
    FROM texts t JOIN avgs a USING (pattern_id) JOIN measured m USING (pattern_id))"""


def profile(spark, sf):
    return L.pattern_profile(derive(spark, sf, "query_log"), slice_seconds=DAY)


@query(
    "pattern_profile",
    f"""{PROFILE} SELECT pattern_id, n, round(avg_latency, 6) AS avg_latency, array_to_string(tables, ',') AS tables,
      array_to_string(operations, ',') AS operations, join_count, parameter_count, where_count,
      round(static_complexity, 6) AS static_complexity, round(complexity, 6) AS complexity,
      CASE WHEN list_has_any(operations, ['INSERT', 'UPDATE', 'DELETE']) THEN 'primary'
        WHEN avg_latency > 2.0 OR n > 50 THEN 'read_replica' ELSE 'primary' END AS route,
      CASE WHEN n > 10 AND avg_latency > 0.5 THEN 'enable_query_cache' WHEN n > 100 THEN 'enable_result_cache' ELSE 'no_cache' END AS cache
    FROM profile""",
)
def _(spark, sf):
    n, average = F.col("n"), F.col("avg_latency")
    return profile(spark, sf).select(
        "pattern_id", "n", F.round("avg_latency", 6).alias("avg_latency"),
        F.concat_ws(",", "tables").alias("tables"), F.concat_ws(",", "operations").alias("operations"),
        "join_count", "parameter_count", "where_count",
        F.round("static_complexity", 6).alias("static_complexity"), F.round("complexity", 6).alias("complexity"),
        L.route_advice(F.col("operations"), average, n).alias("route"),
        L.cache_advice(n, average, n).alias("cache"),
    )


@query(
    "pattern_advice",
    f"""{PROFILE}, a AS (SELECT pattern_id, unnest([
        CASE WHEN avg_latency > 1.0 AND len(tables) > 0 THEN 'index_suggestion' END,
        CASE WHEN complexity > 5.0 THEN 'query_rewrite' END, CASE WHEN n > 100 THEN 'routing' END]) AS kind, tables
      FROM profile WHERE n >= 10)
    SELECT pattern_id, kind, CASE kind
        WHEN 'index_suggestion' THEN 'Consider adding index on frequently queried tables: ' || array_to_string(tables, ', ')
        WHEN 'query_rewrite' THEN 'Consider breaking down complex query into simpler parts'
        ELSE 'Route to read replica for better performance' END AS suggestion,
      CASE kind WHEN 'index_suggestion' THEN 0.3 WHEN 'query_rewrite' THEN 0.4 ELSE 0.2 END::DOUBLE AS improvement,
      CASE kind WHEN 'index_suggestion' THEN 0.7 WHEN 'query_rewrite' THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence
    FROM a WHERE kind IS NOT NULL""",
)
def _(spark, sf):
    return L.advice(profile(spark, sf))


@query(
    "index_advice",
    f"""{PROFILE} SELECT pattern_id, unnest(tables) AS table_name, 'id' AS columns, 'btree' AS kind,
      0.3::DOUBLE AS benefit, 0.1::DOUBLE AS creation_cost, 0.05::DOUBLE AS upkeep_cost FROM profile""",
)
def _(spark, sf):
    return L.index_advice(profile(spark, sf)).withColumn("columns", F.concat_ws(",", "columns"))


@query(
    "rewrite_advice",
    f"""{PROFILE} SELECT pattern_id, join_count > 0 AS joins, join_count > 2 AS advised FROM profile""",
)
def _(spark, sf):
    p = profile(spark, sf)
    advised = L.rewrite_advice(p).select(F.col("pattern_id").alias("_p"))
    return p.join(advised, F.col("pattern_id") == F.col("_p"), "left").select(
        "pattern_id", (F.col("join_count") > 0).alias("joins"), F.col("_p").isNotNull().alias("advised")
    )


def executions(spark, sf):
    log = L.with_pattern(derive(spark, sf, "query_log"))
    return log.select(
        "log_id", "ts", "pattern_id", "latency", ((F.col("log_id") % 10) / 10.0).alias("database_load"),
        ((F.col("user_id") % 7) / 7.0).alias("cache_hit_ratio"),
    )


FEATURES_SQL = f"""{PROFILE}, feats AS (SELECT m.log_id, m.latency, p.complexity AS f1, len(p.tables)::DOUBLE AS f2,
    p.join_count::DOUBLE AS f3, p.where_count::DOUBLE AS f4, p.parameter_count::DOUBLE AS f5,
    (m.log_id % 10) / 10.0 AS f6, hour(m.ts) / 24.0 AS f7, dayofweek(m.ts) / 7.0 AS f8, p.avg_latency AS f9,
    (m.user_id % 7) / 7.0 AS f10, p.n, p.complexity FROM marked m JOIN profile p USING (pattern_id))"""


def with_features(spark, sf):
    return L.features(executions(spark, sf), profile(spark, sf))


@query(
    "latency_features",
    f"""{FEATURES_SQL} SELECT log_id, round(f1, 6) AS f_query_complexity, f2 AS f_table_count, f3 AS f_join_count,
      f4 AS f_where_clause_complexity, f5 AS f_parameter_count, round(f6::DOUBLE, 6) AS f_database_load,
      round(f7::DOUBLE, 6) AS f_time_of_day, round(f8::DOUBLE, 6) AS f_day_of_week,
      round(f9, 6) AS f_historical_avg_latency, round(f10::DOUBLE, 6) AS f_cache_hit_ratio FROM feats""",
)
def _(spark, sf):
    df = with_features(spark, sf)
    return df.select("log_id", *[F.round(f"f_{n}", 6).alias(f"f_{n}") for n in L.FEATURES])


WEIGHTS = {name: (i + 1) / 10.0 for i, name in enumerate(L.FEATURES)} | {"bias": -0.5}


@query(
    "weighted_latency",
    f"""{FEATURES_SQL}, scored AS (SELECT log_id, n, complexity,
      {' + '.join(f'f{i + 1} * {(i + 1) / 10.0}' for i in range(10))} - 0.5 AS raw FROM feats)
    SELECT log_id, round(p::DOUBLE, 5) AS predicted, CAST(floor(round(p::DOUBLE * 100, 6)) AS BIGINT) AS est_rows,
      round(greatest(1.0, p * 10)::DOUBLE, 4) AS est_memory_mb,
      round(greatest(0.1, least(1.0, 0.5 + least(0.3, n / 100.0) + 0.5 * 0.2 - complexity * 0.05))::DOUBLE, 6) AS confidence
    FROM (SELECT *, CASE WHEN raw < 0 THEN 0.001 ELSE raw END AS p FROM scored)""",
)
def _(spark, sf):
    scored = L.score_weights(with_features(spark, sf), "linear", WEIGHTS)
    side = profile(spark, sf).select("pattern_id", "n", "complexity")
    estimated = L.resource_estimate(scored.join(side, "pattern_id"))
    return estimated.select(
        "log_id", F.round("predicted", 5).alias("predicted"),
        F.floor(F.round(F.col("predicted") * 100, 6)).cast("bigint").alias("est_rows"),
        F.round("est_memory_mb", 4).alias("est_memory_mb"),
        F.round(L.confidence(F.col("n"), F.lit(0.5), F.col("complexity")), 6).alias("confidence"),
    )


RELU = {f"h1_w_{j}_{i}": ((j * 3 + i) % 7 - 3) / 10.0 for j in range(10) for i in range(10)}
RELU |= {f"out_w_{i}": (i % 4 - 1) / 10.0 for i in range(10)} | {"out_bias": 0.2}
ENSEMBLE = {f"tree_{t}_w_{i}": ((t + i) % 5 - 1) / 20.0 for t in range(5) for i in range(10)}


@query(
    "network_latency",
    f"""{FEATURES_SQL} SELECT log_id,
      round(greatest(0.001, {' + '.join(f"greatest(0.0, {' + '.join(f'f{j + 1} * ({RELU[f'h1_w_{j}_{i}']})' for j in range(10))}) * ({RELU[f'out_w_{i}']})" for i in range(10))} + 0.2)::DOUBLE, 5) AS relu,
      round(greatest(0.001, {' + '.join(f"({' + '.join(f'f{i + 1} * ({ENSEMBLE[f'tree_{t}_w_{i}']})' for i in range(10))}) / 5.0" for t in range(5))})::DOUBLE, 5) AS ensemble
    FROM feats""",
)
def _(spark, sf):
    df = with_features(spark, sf)
    df = L.score_weights(df, "relu", RELU).withColumnRenamed("predicted", "relu")
    df = L.score_weights(df, "ensemble", ENSEMBLE).withColumnRenamed("predicted", "ensemble")
    return df.select("log_id", F.round("relu", 5).alias("relu"), F.round("ensemble", 5).alias("ensemble"))


def fitted_sql() -> str:
    """Tables up to ``fitted`` (log_id, latency, predicted): sums of products of (1, features | label), and their elimination, a column a step."""
    terms = ["1.0", *(f"f{i + 1}::DOUBLE" for i in range(10))]
    products = ", ".join(f"sum({a} * {b})" for a in terms for b in [*terms, "latency::DOUBLE"])
    pivot = "m[k * 12 + k + 1]"
    eliminated = f"list_transform(range(132), lambda p: CASE WHEN p // 12 = k THEN m[p + 1] / {pivot} ELSE m[p + 1] - m[(p // 12) * 12 + k + 1] * m[k * 12 + p % 12 + 1] / {pivot} END)"
    weight = lambda i: f"CASE WHEN list_contains(used, {i}) THEN m[{i} * 12 + 12] ELSE 0 END"
    raw = " + ".join([weight(0), *(f"{weight(i + 1)} * f{i + 1}" for i in range(10))])
    return f"""{FEATURES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, steps AS (
      SELECT 0::BIGINT AS k, [{products}] AS m, [0.0::DOUBLE] AS spread, []::BIGINT[] AS used FROM feats
      UNION ALL SELECT k + 1, CASE WHEN ok THEN {eliminated} ELSE m END, CASE WHEN k = 0 THEN list_transform(range(11), lambda i: m[i * 13 + 1] - m[i * 12 + 1] * m[i + 1] / m[1]) ELSE spread END,
        CASE WHEN ok THEN list_append(used, k) ELSE used END FROM (SELECT *, k = 0 OR {pivot} > 1e-9 * spread[k + 1] AS ok FROM steps WHERE k < 11)),
    fitted AS (SELECT log_id, latency, CASE WHEN raw < 0 THEN 0.001 ELSE raw END AS predicted FROM (SELECT log_id, latency, {raw} AS raw FROM feats, (SELECT * FROM steps WHERE k = 11)))"""


@query("latency_fit", f"{fitted_sql()} SELECT log_id, latency::DOUBLE AS latency, round(predicted, 5)::DOUBLE AS predicted FROM fitted")
def _(spark, sf):
    df = with_features(spark, sf)
    fitted = L.predict_latency(L.fit_latency(df), df)
    return fitted.select("log_id", F.col("latency").cast("double").alias("latency"), F.round("predicted", 5).alias("predicted"))


@query("latency_fit_accuracy", f"{fitted_sql()} SELECT round(greatest(0.0, 1.0 - avg(abs(predicted - latency) / latency)), 6)::DOUBLE AS accuracy FROM fitted WHERE latency > 0")
def _(spark, sf):
    df = with_features(spark, sf)
    return L.fit_accuracy(L.predict_latency(L.fit_latency(df), df).filter("latency > 0")).select(F.round("accuracy", 6).alias("accuracy"))


# --- text and key functions --------------------------------------------------------------------------------


@query(
    "query_shapes",
    f"""{ctes('query_log')} SELECT log_id,
      array_to_string({ordered_distinct(SQL_REFS)}, ',') AS tables, round({SQL_COMPLEXITY}, 6) AS complexity,
      array_to_string(regexp_extract_all(query, '\\b\\d+\\b'), ',') AS numbers,
      CAST(len(regexp_extract_all(query, '''[^'']*''')) AS INT) AS strings,
      substr(query, 1, 20) AS head, CASE WHEN length(query) > 60 THEN substr(query, 1, 60) || '...' ELSE query END AS short
    FROM query_log""",
)
def _(spark, sf):
    q = F.col("query")
    log = derive(spark, sf, "query_log").withColumn("p", fp.parameters(q))
    numbers = F.transform(F.filter("p", lambda x: x["kind"] == "numeric"), lambda x: x["min_value"].cast("bigint").cast("string"))
    return log.select(
        "log_id", F.concat_ws(",", fp.table_names(q)).alias("tables"), F.round(fp.complexity(q), 6).alias("complexity"),
        F.concat_ws(",", numbers).alias("numbers"),
        F.size(F.filter("p", lambda x: x["kind"] == "string")).alias("strings"),
        fp.truncate(q, 20).alias("head"), fp.truncate(q, 60, ellipsis=True).alias("short"),
    )


@query(
    "cache_keys",
    f"""{ctes('query_log')} SELECT log_id, substr(sha256(query || database || event_type), 1, 32) AS cache_key,
      substr(sha256(query || database), 1, 16) AS tracking_key,
      substr(sha256(database || event_type || query || username), 1, 32) AS tiered_key,
      CAST('0x' || substr(sha256(event_type), 1, 8) AS BIGINT) AS table_hash FROM query_log""",
)
def _(spark, sf):
    q, d, t, u = (F.col(c) for c in ("query", "database", "event_type", "username"))
    return derive(spark, sf, "query_log").select(
        "log_id", K.cache_key(q, d, t).alias("cache_key"), K.tracking_key(q, d).alias("tracking_key"),
        K.tiered_cache_key(d, t, q, u).alias("tiered_key"), K.hash_u32(t).alias("table_hash"),
    )


def mix32_sql(value: str, seed: str) -> str:
    """The mix in 128-bit arithmetic, one step per nested select."""
    return f"""(SELECT xor(h4, h4 >> 16) FROM (SELECT CAST((h3::HUGEINT * 3266489909) % 4294967296 AS BIGINT) AS h4 FROM (
      SELECT xor(h2, h2 >> 13) AS h3 FROM (SELECT CAST((xor({value}, {seed})::HUGEINT * 2246822507) % 4294967296 AS BIGINT) AS h2))))"""


@query(
    "mix_hash",
    f"""{ctes('packets')} SELECT event_id, {mix32_sql('ip::BIGINT', '305419896::BIGINT')} AS user_hash,
      {mix32_sql('ip::BIGINT', 'port::BIGINT')} AS backend_hash, (ip::BIGINT << 16) | port AS session FROM packets""",
)
def _(spark, sf):
    ip, port = F.col("ip"), F.col("port")
    return derive(spark, sf, "packets").select(
        "event_id", K.mix32(ip, F.lit(K.USER_SEED)).alias("user_hash"), K.mix32(ip, port).alias("backend_hash"),
        K.session_key(ip, port).alias("session"),
    )


@query(
    "key_slots",
    f"""WITH k AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'p{{' || page_id || '}}x' || url ELSE 'é{{}}' || url END AS key FROM pages),
    h AS (SELECT page_id, key, encode(CASE WHEN regexp_matches(key, '\\{{.*?\\}}') THEN regexp_extract(key, '\\{{(.*?)\\}}', 1) ELSE key END) AS b FROM k)
    SELECT page_id, key, CAST(list_reduce(list_prepend(0, list_transform(range(1, octet_length(b) + 1),
        lambda i: ('0x' || substr(hex(b), CAST(2 * i - 1 AS BIGINT), 2))::INT)),
      lambda acc, byte: xor((acc << 8) & 65535, ({K.crc16_table()})[1 + (xor(acc >> 8, byte) & 255)])) % 16384 AS INT) AS slot FROM h""".replace("{{", "{").replace("}}", "}"),
)
def _(spark, sf):
    pages = load(spark, sf, "pages")
    key = (
        F.when(F.col("page_id") % 3 == 0, F.col("url"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("p{"), F.col("page_id"), F.lit("}x"), F.col("url")))
        .otherwise(F.concat(F.lit("é{}"), F.col("url")))
    )
    return pages.select("page_id", key.alias("key")).withColumn("slot", K.key_slot(F.col("key")))


@query(
    "ip_numbers",
    f"""{ctes('query_log')} SELECT DISTINCT source_ip, ip, (ip & 4294901760) AS net16, (ip & 4294967040) AS net24 FROM (
      SELECT source_ip, string_split(source_ip, '.')[1]::BIGINT * 16777216 + string_split(source_ip, '.')[2]::BIGINT * 65536
        + string_split(source_ip, '.')[3]::BIGINT * 256 + string_split(source_ip, '.')[4]::BIGINT AS ip FROM query_log)""",
)
def _(spark, sf):
    ips = derive(spark, sf, "query_log").select("source_ip").distinct().withColumn("ip", K.ip_to_long(F.col("source_ip")))
    return ips.select(
        K.long_to_ip(F.col("ip")).alias("source_ip"), "ip",
        F.col("ip").bitwiseAND(K.prefix_mask(16)).alias("net16"), F.col("ip").bitwiseAND(K.prefix_mask(24)).alias("net24"),
    )


@query(
    "client_addresses",
    """SELECT ip, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN '10.1.' || (user_id % 5) || '.1'
        WHEN 1 THEN '172.16.0.' || (user_id % 9) WHEN 2 THEN '192.168.0.' || (user_id % 6) ELSE 'unknown' END AS ip FROM events) GROUP BY 1""",
)
def _(spark, sf):
    turn, user = F.col("event_id") % 4, F.col("user_id")
    headers = load(spark, sf, "events").select(
        F.when(turn == 0, F.concat(F.lit(" 10.1."), user % 5, F.lit(".1 , 10.9.9.9"))).alias("forwarded"),
        F.when(turn == 1, F.concat(F.lit("172.16.0."), user % 9)).alias("real_ip"),
        F.when(turn == 2, F.concat(F.lit("192.168.0."), user % 6, F.lit(":5432"))).alias("remote"),
    )
    ip = C.client_ip(F.col("forwarded"), F.col("real_ip"), F.col("remote"))
    return headers.groupBy(ip.alias("ip")).agg(F.count(F.lit(1)).alias("n"))


SCANNED = "2024-01-31 00:00:00"  # after the last event


@query(
    "scan_ages",
    f"""SELECT age, count(*) AS n FROM (SELECT CASE WHEN s // 86400 > 0 THEN (s // 86400) || ' days ago'
        WHEN s % 86400 > 3600 THEN (s % 86400 // 3600) || ' hours ago' ELSE (s % 86400 // 60) || ' minutes ago' END AS age
      FROM (SELECT CAST(epoch(TIMESTAMP '{SCANNED}') - floor(epoch(ts)) AS BIGINT) AS s FROM events)) GROUP BY 1""",
)
def _(spark, sf):
    age = fp.age_text(F.col("ts"), F.lit(SCANNED).cast("timestamp"))
    return load(spark, sf, "events").groupBy(age.alias("age")).agg(F.count(F.lit(1)).alias("n"))
