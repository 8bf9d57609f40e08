"""A training-data pipeline over ``documents``: language, exact copies, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what it returns as Parquet and reads it back as the
next stage's ``docs``. All stages but the last return the columns of ``docs``. A stage judges every row that reaches it, by whole texts;
repeated rows and null ids are told apart by their place in the table. Empty tables go through. Columns whose names the operators use
are safe: operators read only the columns named to them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm import bpe, decontaminate, exact_dedup, language, near_dedup
from wiretally.llm.common import work_folder, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language; texts that are null or have no letter are rejected."""
    return docs.where(language.predictor(spark, language.learn(docs))(F.col("text"))["lang_pred"] != language.UNKNOWN)


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of row numbers, as a table, so that every later look at it sees the same numbers."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), work_folder(spark), "numbered", compression="zstd"), name


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (up to white space), the one with the smallest doc_id."""
    rows, name = _numbered(spark, docs)
    kept = exact_dedup.exact_classes(rows, row_col=name).where("kept").select(F.col("row").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the smallest doc_id."""
    rows, name = _numbered(spark, docs)
    classes, _ = near_dedup.similarity_join(rows, row_col=name)
    return rows.join(classes.where("kept").select(F.col("row").alias(name)), name, "left_semi").drop(name)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no copy of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids, and whether the ids decode to the words of the text as the vocabulary spells them."""
    coded = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: SQL can't express language profiles, the forest, alignment or merges; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_folder(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
