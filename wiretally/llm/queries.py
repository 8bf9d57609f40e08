"""The operators applied to the given tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from wiretally.llm import bpe, decontaminate, exact_dedup, language, licenses, near_dedup, ranked_search, sharding, spelling, suffix_dedup, token_counts, token_files, toxicity
from wiretally.llm.common import held_out, work_folder
from wiretally.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op1_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_token_counts")
def token_counts_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op3_ngram_jaccard_join")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = near_dedup.similarity_join(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "n_links", "kept")


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm, row_number() OVER (PARTITION BY doc_id, text) AS again FROM documents
), c AS (
  SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, again) = 1 AS kept FROM t
)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM c
"""


@query("op4_exact_dedup", EXACT_SQL)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op5_decontamination")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_license_scan")
def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_token_files")
def token_files_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/tokens"
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, folder).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op8_bpe_encode_decode")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    n_tokens, decoded = F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return coded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), decoded)


@query("op9_language_id")
def language_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op10_toxicity")
def toxicity_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), i AS (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), wanted AS (SELECT item, item_id, term, count(*) AS repeats FROM i GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
scored AS (
  SELECT item, item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(terms) * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN weight USING (term) JOIN tf USING (term) JOIN d USING (r), total GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op11_ranked_search", SEARCH_SQL)
def ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
    return found.select("item_id", "rank", "doc_id", "score")


SHARDS = sharding.planned(16)

#: CRC-32 over the bytes of ``raw``, a blob: the table of 256 remainders from its polynomial, then a byte at a time.
CRC_SQL = """
WITH remainders AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))
)"""


def crc_sql(raw: str) -> str:
    spelt = f"list_transform(regexp_extract_all(hex({raw}), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {spelt}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _descent_sql(name: str, leaves: list[sharding.Leaf]) -> str:
    """Tables ``name``_nodes and ``name``0 to ``name``3: the child of the largest draw at each level."""
    rows = ", ".join(f"('{parent}', '{child}', {weight}::DOUBLE)" for parent, below in sharding.children(leaves).items() for child, weight in below.items())
    sql = f"{name}_nodes(parent, child, weight) AS (VALUES {rows}),\n{name}0 AS (SELECT r, key, '' AS node FROM d)"
    for level in range(3):
        unit = f"((('0x' || substr(md5(key || '/' || child), 1, {sharding.HEX_DIGITS}))::BIGINT)::DOUBLE + 0.5) / {16**sharding.HEX_DIGITS}::DOUBLE"
        sql += f",\n{name}{level + 1} AS (SELECT r, key, arg_max(child, ln({unit}) / weight) AS node FROM {name}{level} JOIN {name}_nodes ON parent = node GROUP BY r, key)"
    return sql


SHARD_SQL = f"""{CRC_SQL}, d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS key, encode(coalesce(text, '')) AS raw FROM documents
), {_descent_sql("now", SHARDS)}, {_descent_sql("later", sharding.grown(SHARDS))},
placed AS (
  SELECT doc_id, octet_length(raw)::BIGINT + 1 AS size, {crc_sql("raw")} AS text_crc32, split_part(now3.node, '/', 3)::INT AS shard, split_part(later3.node, '/', 3)::INT AS grown_shard
  FROM d JOIN now3 USING (r) JOIN later3 USING (r), remainders
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed
"""


@query("op12_sharding", SHARD_SQL)
def shards_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


#: Near words here by their forms with one character left out or masked; the operator finds them in another way.
SPELLING_SQL = f"""{CRC_SQL.replace("WITH", "WITH RECURSIVE", 1)}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql("encode(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM counted, remainders),
spoilt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
less AS (SELECT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS shorter, substr(word, 1, p - 1) || '*' || substr(word, p + 1) AS masked FROM places),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.masked = b.masked WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.shorter = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM pairs GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN other END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)
), roots AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT roots.word, form FROM roots JOIN formed ON formed.word = roots.at WHERE form IS NOT NULL
)
SELECT formed.word, formed.form, roots.at AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN roots USING (word) JOIN formed ends ON ends.word = roots.at WHERE ends.form IS NULL
"""


@query("op13_spelling_variants", SPELLING_SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
