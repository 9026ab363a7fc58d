"""SimHash fingerprints, near-duplicate links and their components.

Fingerprints are computed in Arrow batches.  Linking works on distinct fingerprints:

* Two fingerprints with at most 3 differing bits agree on at least one of four blocks of
  their bits.  Each fingerprint is dealt to its four blocks (one shuffle on block and
  value); a block value that too many share is dealt again by four parts of the bits
  that are still free, and so on, so no group is large and no pair is missed.
* Inside a group fingerprints are sorted by Gray rank and put under a tree.  A node keeps
  the bits all its members share (pattern and mask).  Two nodes are compared by the
  differences in bits both share; more than 3 prune all pairs below them.
* A group gives one edge per member to the smallest fingerprint of its local component,
  not its pairs.  Components of the edges are found with large-star / small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import documents, lower_words, pieces, stored, table, texts
from trailweave.session import checked_broadcast, cut_lineage

PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Most members of a group before its key is refined, and the fan-out of the tree.
GROUP, FAN = 2048, 8
BITS = 3


def fingerprint(words: list[bytes], size: int) -> int:
    """64 majority bits over the hashes of all shingles (as a signed number); none gives 0."""
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 17):  # the bits of a very long text come in parts
        ones += np.unpackbits(hashes[i : i + (1 << 17)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint of every whole text.  Null counts as empty, which gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            yield table(PRINTS, part.column("doc_id"), [fingerprint(lower_words(t), size) for t in texts(part)])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, print bigint")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the order of the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; label[i] is the smallest index of the set of i."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(x[differ], y[differ]), np.minimum(x[differ], y[differ]))
        while (label[label] != label).any():
            label[:] = label[label]


def tree(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from leaves to root: the shared bits of each node (pattern, mask)."""
    levels, low, high = [], values, values
    while len(low) > 1 or not levels:
        cuts = np.arange(0, len(low), FAN)
        low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
        levels.append((low, ~(low ^ high)))
    return levels


def close_pairs(values: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of index pairs of a Gray-sorted array with at most ``bits`` differing bits."""
    levels = tree(values)
    step = np.arange(FAN)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        size = len(levels[level - 1][0]) if level else len(values)
        x = np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(step, FAN), len(a))
        y = np.repeat(b * FAN, FAN * FAN) + np.tile(np.tile(step, FAN), len(b))
        if level:
            keep = (y < size) & (x <= y)
            x, y = x[keep], y[keep]
            pattern, mask = levels[level - 1]
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= bits
            x, y = x[near], y[near]
            stack += [(level - 1, x[i : i + 4096], y[i : i + 4096]) for i in range(0, len(x), 4096)]
        else:
            keep = (y < size) & (x < y)
            x, y = x[keep], y[keep]
            near = np.bitwise_count(values[x] ^ values[y]) <= bits
            yield x[near], y[near]


def link(keys: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) inside whole groups; ``keys`` are sorted."""
    values = values.astype(np.uint64, copy=False)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    label = np.arange(len(keys))
    small = np.repeat(sizes <= FAN * FAN, sizes)
    for gap in range(1, FAN * FAN):  # small groups side by side
        i = np.flatnonzero((keys[gap:] == keys[:-gap]) & small[gap:])
        if not len(i):
            break
        i = i[np.bitwise_count(values[i] ^ values[i + gap]) <= bits]
        union(label, i, i + gap)
    for start, size in zip(starts[sizes > FAN * FAN], sizes[sizes > FAN * FAN]):
        order = start + np.argsort(gray_rank(values[start : start + size]))
        for x, y in close_pairs(values[order], bits):
            union(label, order[x], order[y])
    other = np.flatnonzero(label != np.arange(len(keys)))
    return values[other].view(np.int64), values[label[other]].view(np.int64)


def _matches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Groups arrive in order of key; the last one of a batch waits for its rest."""
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def edges(k, v):
        a, b = link(k, v, bits)
        return table(EDGES, a, b)

    for batch in batches:
        keys = np.r_[keys, batch.column("key").to_numpy(zero_copy_only=False)]
        values = np.r_[values, batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)]
        if len(keys):
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield edges(keys[:cut], values[:cut])
            keys, values = keys[cut:], values[cut:]
    if len(keys):
        yield edges(keys, values)


def _masks(free: list[int], depth: int, blocks: int) -> list[int]:
    """The bit masks of all nodes ``depth`` levels below a node with the bits ``free``."""
    parts = [[int(x) for x in p] for p in np.array_split(free, blocks)]
    if depth == 0:
        return [sum(1 << x for x in part) for part in parts]
    return [m for part in parts for m in _masks([x for x in free if x not in part], depth - 1, blocks)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``print``) that connect exactly
    what pairs with at most ``bits`` differing bits connect."""
    blocks = bits + 1
    level, found = prints.select("print", F.lit(0).alias("node"), F.lit(0).cast("bigint").alias("key")), None
    # Enough levels that the bits left free bound the distinct members of a group.
    depth = 0
    while True:
        masks = F.array(*(F.lit(_signed(m)).cast("bigint") for m in _masks(list(range(64)), depth, blocks)))
        dealt = level.select(
            "print", "key", F.explode(F.sequence(F.col("node") * blocks, F.col("node") * blocks + blocks - 1)).alias("node")
        ).select(
            "print", "node",
            F.xxhash64("key", "node", F.col("print").bitwiseAND(F.element_at(masks, F.col("node") + 1))).alias("key"))
        last = depth == 3
        hot = None if last else cut_lineage(dealt.groupBy("key").count().where(F.col("count") > group).select("key"))
        if hot is not None and not hot.isEmpty():
            hot = checked_broadcast(hot)
            ready = dealt.join(hot, "key", "left_anti")
            level = cut_lineage(dealt.join(hot, "key", "left_semi"))
        else:
            ready, last = dealt, True
        edges = ready.select("key", "print").repartition("key").sortWithinPartitions("key").mapInArrow(
            lambda batches: _matches(batches, bits), "a bigint, b bigint")
        found = edges if found is None else found.unionByName(edges)
        if last:
            return found
        depth += 1


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node that is not the smallest of its component: node and smallest node.

    Large-star and small-star rounds until nothing changes; each round is checkpointed.
    """
    edges, before = cut_lineage(edges.where("a <> b").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       size: int = 3, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """One row per document: ``id_col, print, component_id``.

    ``component_id`` is the smallest id that chains of fingerprints with at most ``bits``
    differing bits reach (null if all those ids are missing).  Null and empty texts have
    fingerprint 0 and are linked like any other; repeated rows get equal rows; an empty
    table gives an empty result; other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col, size), "prints")
    distinct = cut_lineage(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    stars = components(links(distinct, bits, group))
    rooted = distinct.join(stars, distinct["print"] == stars["a"], "left").select(
        "print", "first_id", F.coalesce("b", "print").alias("root"))
    rooted = cut_lineage(rooted)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "component_id")
    return prints.join(named, "print").select(F.col("doc_id").alias(id_col), "print", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id.

    Columns are those of ``docs``.  Rows that repeat an id stay or go together; rows
    without an id stay.
    """
    gone = simhash_components(docs, id_col, text_col, **options).where(
        F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


QUERIES = {
    "op8_simhash": lambda s, d: simhash_components(documents(s, d)).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"),
}
ORACLE: dict[str, str] = {}
