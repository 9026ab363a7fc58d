"""Exact duplicates, with DataFrame functions only.

Copies are combined in three steps, each grouping by digest *and* full content, so two
texts are one group only if they are equal character by character:

1. inside every input partition (map-side aggregation),
2. partitions with the same salt (``digest, salt, content``),
3. the winners of all salts (``digest, content``).

A text that a third of all rows repeat reaches step 2 as one row per partition and step
3 as one row per salt, so no task gathers its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import SPACE, documents

#: Winner keys put the length above the id: ``length * 10^20 + (2^63 - id)``; 0 stands for a missing id.
STEP, TOP = "100000000000000000000BD", "9223372036854775808BD"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after white space (space, tab to carriage
    return) is deleted; null counts as empty.  The longest original text stays, then the
    smallest id (a missing id comes last; ids are integers).  Rows that repeat an id and
    a length of the same group are one document and share its flag.  An empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("_id"),
        F.char_length(text).alias("_chars"),
        F.regexp_replace(text, SPACE, "").alias("_body"),
    ).select("_id", "_chars", "_body", F.sha2("_body", 256).alias("_sha"), F.md5("_body").alias("_md5"))
    order = F.expr(f"CAST(_chars AS DECIMAL(10,0)) * {STEP} + coalesce({TOP} - CAST(_id AS DECIMAL(19,0)), 0BD)")
    local = rows.select("_sha", "_md5", "_body", order.alias("_best"), (F.spark_partition_id() % salts).alias("_salt"))
    salted = local.groupBy("_sha", "_md5", "_body", "_salt").agg(F.max("_best").alias("_best"), F.count("*").alias("_n"))
    merged = salted.groupBy("_sha", "_md5", "_body").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))
    # The content is left behind here: documents find their group by two digests.
    groups = merged.select(
        F.col("_sha").alias("_gsha"), F.col("_md5").alias("_gmd5"), "_n",
        F.expr(f"CAST(floor(_best / {STEP}) AS INT)").alias("_keep_chars"),
        F.expr(f"CASE WHEN _best % {STEP} > 0 THEN CAST({TOP} - _best % {STEP} AS BIGINT) END").alias("_keep"),
    )
    found = rows.select("_id", "_chars", "_sha", "_md5").join(
        groups, (F.col("_sha") == F.col("_gsha")) & (F.col("_md5") == F.col("_gmd5")))
    return found.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_chars") == F.col("_keep_chars"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


QUERIES = {"op4_exact_dedup": lambda s, d: exact_groups(documents(s, d))}

ORACLE = {"op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)"""}
