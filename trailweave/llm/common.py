"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.session import checkpoint_folder

#: A word, and the white space between words, as Java patterns.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

#: Name of the text column that filters put beside the columns of a table.
TEXT = "__text__"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``.  A missing id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds).cast("int")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage at a table every executor can reach; what was computed once
    (a Python pass over whole texts, say) is not repeated by later jobs or retries.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/trailweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text, so that the arrays made
    from a slice stay small; one longer document is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def lower_words(text: str) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased (``bytes`` methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
