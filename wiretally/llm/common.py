"""What the operators of this package share: work folders, byte packing, row batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 64  # of a batch that are Python strings at once


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="wiretally-work-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table below ``folder``: its lineage ends there, and a lost executor costs no earlier work."""
    path = f"{folder}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, as ``doc_id`` long and ``text`` string; all other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from every fit: crc32 of its id as text, modulo 4, is 2. False for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def record_batch(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
    """(doc_id, text) of a batch, null texts as empty ones; few rows at a time become Python strings."""
    for at in range(0, batch.num_rows, ROWS):
        few = batch.slice(at, ROWS)
        for doc_id, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
            yield doc_id, text or ""
