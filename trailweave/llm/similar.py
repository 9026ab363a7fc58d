"""Near-duplicate documents: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

The first candidates are what ``simhash`` links: fingerprints with at most 3 differing bits,
directly or in chains.  They are not all, since at similarity 0.8 about ten of 64 bits differ.
So further candidates share one of 16 bands of four min-hashes (a pair at similarity
0.8 does with probability 0.9998), and the rest is the set join of ``jaccard``: what shares
a fingerprint component or bands, directly or in chains, is a block, blocks are cut into tiles of
bounded weight, and only a link confirmed on whole sets connects.  No estimate decides, and no
component or band is one task's work.
(The exact keys of ``jaccard`` need four times as many keys at 0.8 as at 0.85.)
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.jaccard import TILES, jaccard_components
from trailweave.llm.simhash import simhash_components

SIZE, LEAST = 5, (80, 100)
BANDS, ROWS = 16, 4
_RANDOM = np.random.default_rng(8).integers(0, 1 << 63, (2, BANDS * ROWS), np.int64).astype(np.uint64)
FLIP, FACTOR = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    return np.array([((shingles ^ flip) * factor).min() for flip, factor in zip(FLIP, FACTOR)], np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band; an empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    bands = min_hashes(shingles).reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(band.tobytes(), number) for number, band in enumerate(bands)], np.uint64)
    return (keys & ~TILES).view(np.int64)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id): one key for each SimHash component of two or more documents (last ten bits zero)."""
    found = simhash_components(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("doc_id"), "component_id")
    linked = found.where("doc_id <> component_id")
    named = linked.unionByName(linked.select(F.col("component_id").alias("doc_id"), "component_id")).distinct()
    key = F.xxhash64(F.lit("simhash"), "component_id").bitwiseAND(F.lit(~int(TILES)))
    return named.select(key.alias("key"), "doc_id")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, component_id) for every document that is not the smallest id of its component.

    Null, empty and blank texts are copies of each other.
    """
    found = jaccard_components(
        docs, id_col, text_col, SIZE, least, keys_of=band_keys, groups=simhash_groups(docs, id_col, text_col)).select(F.col(id_col).alias("doc_id"), "n_shingles", "component_id").where(
        "doc_id IS NOT NULL")
    blank = found.where("n_shingles = 0").agg(F.min("doc_id").alias("first"))  # one row
    return found.join(F.broadcast(blank)).select(
        "doc_id", F.when(F.col("n_shingles") == 0, F.col("first")).otherwise(F.col("component_id")).alias("component_id")).where(
        "doc_id <> component_id").distinct()


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: tuple[int, int] = LEAST) -> DataFrame:
    """The documents that stay: of each component of links at ``least`` or more the one with the smallest id.

    Columns are those of ``docs``.  Rows that repeat an id stay or go together, rows without
    an id stay, null and empty texts are copies of each other.
    """
    gone = similar_components(docs, id_col, text_col, least).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col("_gone"), "left_anti").select(*docs.columns)
