"""Documents whose word n-gram sets have a Jaccard similarity of at least ``num/den``: an exact join.

* Documents with equal sets (128-bit digest) are one node, named by the smallest id.
* **Size bands.**  Sizes are cut into bands so that linked sets lie in the same or in
  neighbouring bands, so a node takes part in two bands' tiles.  In a tile two linked sets
  differ in at most ``d`` shingles.  Shingles are dealt to more than ``d`` parts by hash;
  then two linked sets agree in some whole part of two or more shingles.  (A set with too
  many thin parts is dealt again by other hashes; what fails them all shares one key of its
  tile.)  Digests of parts meet in one shuffle, and what shares one, directly or in chains
  inside a tile's sizes, forms a *block* of mostly similar sets.
* **Tiles.**  A block is cut along its sizes into chunks of bounded weight; pairs of chunks
  whose sizes allow a link are tiles, each worked on by one task.  Of a block with many
  chunks the neighbouring ones come first; then only tiles that still hold more than one
  component.
* **Bitmaps.**  In a tile every set has a hashed bitmap.  Differing bits bound the overlap
  of two sets from above; only pairs whose bound allows a link are intersected exactly, as
  sorted arrays.  Pairs already connected by confirmed links are left out, so copies of one
  text cost one comparison each and a tile gives at most one link per set.

No link is lost: candidate parts, bounds and the order of work are exact, and a link
connects only after the intersection of whole sets has confirmed it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import documents, lower_words, pieces, stored, table, texts
from trailweave.llm.simhash import components
from trailweave.session import cut_lineage

SIZE, LEAST = 4, (85, 100)
#: Hash rounds of sets with many thin parts; the bits of a key that name its tile.
ROUNDS, TILES = 6, np.uint64(1023)
#: Most bits of the table of asked ids (32 MB).
FILTER = 1 << 28
#: Greatest weight of a chunk; a set weighs its shingles and ``BASE``.
WEIGHT, BASE = 1 << 19, 128
NODES = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("size", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64())])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
STARS = pa.schema([("tile", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FIRST
    x = (x ^ (x >> np.uint64(29))) * _SECOND
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, an empty one none."""
    words = lower_words(text)
    if len(words) < size:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def linked(both: int, a: int, b: int, least: tuple[int, int]) -> bool:
    """Whether sets of ``a`` and ``b`` shingles with ``both`` in common link."""
    return least[1] * both >= least[0] * (a + b - both)


class Bands:
    """Size bands for one threshold: upper ends, and the parts of each band's tile."""

    def __init__(self, least: tuple[int, int], largest: int):
        num, den = least
        self.tops = [1]
        while self.tops[-1] < largest:
            # Sets of up to this size may link with one of the smallest size of the band.
            low = self.tops[-1] + 1
            self.tops.append(max(low, low * den // num))
        self.ends = np.array(self.tops)
        # Two linked sets, the smaller one of at most ``top`` shingles, differ in at most d of them.
        self.differ = np.array([self._differ(top, num, den) for top in self.tops])

    @staticmethod
    def _differ(top: int, num: int, den: int) -> int:
        # Of s = a + b shingles, linked sets share half of s * 2num / (num + den) or more.  Rounding
        # moves the rest by less than 2, so the greatest one is found near the greatest s.
        s = top + top * den // num
        back = range(max(2, s - 2 * (num + den) // (den - num) - 1), s + 1) if den > num else [s]
        return max(x - 2 * -(-x * num // (num + den)) for x in back)

    def of(self, size: int | np.ndarray):
        return np.searchsorted(self.ends, size)


def part_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Digests of the parts of a set, for the tile of its own band and for that of the band
    below; the last bits hold the tile.

    Of more than ``d`` + spare parts, two linked sets have more than spare ones in common.
    A part of fewer than ``full`` shingles gives no key; if a set has at most spare such
    parts, some common part gives one.
    """
    if not len(shingles):
        return np.zeros(0, np.int64)
    band, out = int(bands.of(len(shingles))), []
    for tile in (band, band - 1):
        if tile < 0 or (d := int(bands.differ[tile])) < 1:
            continue  # equal sets only
        full, spare = (2, math.ceil(0.16 * d) + 2) if d >= 8 else (1, 2)
        parts = d + 1 + spare
        for number in range(ROUNDS):
            seed = np.uint64((tile << 8 | number) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
            values = mixed(shingles ^ mixed(np.array([seed]))[0])
            part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sums = np.add.reduceat(mixed(values[order] ^ _SECOND), edge)
            strong = np.diff(np.r_[edge, len(part)]) >= full
            keys = mixed(sums[strong] + part[edge][strong] * _FIRST + seed)
            out.append(keys & ~TILES | np.uint64(tile))
            if parts - len(keys) <= spare:
                break
        else:
            out.append(np.array([tile], np.uint64))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of key and node: an edge from each node to the first one of its key."""
    key, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.r_[keys[0] != key if key is not None else True, keys[1:] != keys[:-1]])
        root = np.full(len(keys), -1 if first is None else first)
        if len(start):
            lengths = np.diff(np.r_[start, len(keys)])
            root[start[0] :] = np.repeat(nodes[start], lengths)
        key, first = keys[-1], root[-1]
        other = root != nodes
        found = np.unique(np.stack([keys[other] & np.int64(TILES), nodes[other], root[other]], 1), axis=0)
        yield table(STARS, found[:, 0].astype(np.int32), found[:, 1], found[:, 2])


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bitmap per set, wide enough for the largest: a bit is the parity of the shingles hashed to it."""
    words = max(1, 1 << max(len(s) for s in sets).bit_length() >> 6)
    while words > 1 and words * len(sets) > 1 << 20:  # narrower ones only bound less
        words //= 2
    out = np.zeros((len(sets), words * 64), np.uint8)
    for row, s in zip(out, sets):
        np.bitwise_xor.at(row, (mixed(s) % np.uint64(words * 64)).astype(np.int64), 1)
    return np.packbits(out, axis=1).view(np.uint64)


class Tile:
    """The sets of one chunk, or of two, and the links found among them."""

    def __init__(self, least: tuple[int, int]):
        self.least, self.nodes, self.sides, self.labels, self.sets = least, [], [], [], []

    def add(self, node: int, side: int, label: int, shingles: bytes) -> None:
        self.nodes.append(node)
        self.sides.append(side)
        self.labels.append(label)
        self.sets.append(np.frombuffer(shingles, np.uint64))

    def links(self) -> tuple[list[int], list[int]]:
        """Links that connect all that links in the tile connect (with the labels given)."""
        num, den = self.least
        sizes = np.array([len(s) for s in self.sets])
        order = np.argsort(sizes, kind="stable")
        sizes, sides = sizes[order], np.array(self.sides)[order]
        sets = [self.sets[i] for i in order]
        _, label = np.unique(np.array(self.labels)[order], return_inverse=True)
        two = sides.min() != sides.max()
        a, b = [], []
        if label.max() == 0:
            return a, b
        maps = bitmaps(sets)
        for x in range(len(sets)):
            # Larger sets that may link by size, are in another component, and of the other side.
            end = int(np.searchsorted(sizes, sizes[x] * den // num, "right"))
            open_ = label[x + 1 : end] != label[x]
            if two:
                open_ &= sides[x + 1 : end] != sides[x]
            y = np.flatnonzero(open_) + x + 1
            if not len(y):
                continue
            apart = np.bitwise_count(maps[y] ^ maps[x]).sum(1, dtype=np.int64)
            bound = (sizes[x] + sizes[y] - apart) // 2
            fits = den * bound >= num * (sizes[x] + sizes[y] - bound)
            y = y[fits][np.argsort(-bound[fits], kind="stable")]
            for other in y.tolist():
                if label[other] != label[x] and linked(
                        len(np.intersect1d(sets[x], sets[other], assume_unique=True)), len(sets[x]), len(sets[other]), self.least):
                    a.append(self.nodes[order[x]])
                    b.append(self.nodes[order[other]])
                    label[label == label[other]] = label[x]
        return a, b


def _tile_links(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of tile."""
    key, tile = None, None

    def close():
        a, b = tile.links()
        return table(EDGES, np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64))

    for batch in batches:
        for part in pieces([batch], "shingles", 1 << 24):
            for block, low, high, node, side, label, shingles in zip(*(part.column(c).to_pylist() for c in (
                    "block", "low", "high", "node", "side", "label", "shingles"))):
                if (block, low, high) != key:
                    if tile:
                        yield close()
                    key, tile = (block, low, high), Tile(least)
                tile.add(node, side, label, shingles)
    if tile:
        yield close()


def _tiles(members: DataFrame, sets: DataFrame, tiles: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Confirmed links inside tiles.  ``members``: node, block, chunk, label; ``tiles``: block, low, high."""
    sides = tiles.select("block", "low", "high", F.explode(F.when(F.col("low") == F.col("high"), F.array(F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(1)))).alias("side")).withColumn("chunk", F.when(F.col("side") == 0, F.col("low")).otherwise(F.col("high")))
    dealt = members.join(sides, ["block", "chunk"]).join(sets, "node")
    key = ["block", "low", "high"]
    return dealt.select(*key, "node", "side", "label", "shingles").repartition(*key).sortWithinPartitions(*key).mapInArrow(
        lambda batches: _tile_links(batches, least), "a bigint, b bigint")


def set_digests(rows: DataFrame, size: int) -> DataFrame:
    """``doc_id, digest, size``: what tells equal sets, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            sets = [shingle_set(t, size) for t in texts(part)]
            yield table(NODES, part.column("doc_id"), [digest(s) for s in sets], [len(s) for s in sets])

    return rows.mapInArrow(run, "doc_id bigint, digest binary, size bigint")


def set_keys(rows: DataFrame, size: int, least: tuple[int, int], keys_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``key, node``: the keys of every document with an id (``part_keys`` unless others are
    given).  They go straight into their shuffle; a table of them would be larger than the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(least, 1 << 10)
        for part in pieces(batches, "text"):
            sets = [shingle_set(t, size) for t in texts(part)]
            if max(map(len, sets)) > bands.tops[-1]:
                bands = Bands(least, max(map(len, sets)))
            keys = [keys_of(s) if keys_of else part_keys(s, bands) for s in sets]
            yield table(KEYS, np.concatenate(keys), np.repeat(part.column("doc_id").to_numpy(), [len(k) for k in keys]))

    return rows.where("doc_id IS NOT NULL").mapInArrow(run, "key bigint, node bigint")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                       least: tuple[int, int] = LEAST, weight: int = WEIGHT,
                       keys_of: Callable[[np.ndarray], np.ndarray] | None = None,
                       groups: DataFrame | None = None) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id``.

    Two documents link when ``den * intersection >= num * union`` of their sets of ``size``
    words (``least`` is ``(num, den)``); ``component_id`` is the smallest id that links reach.
    A text of fewer words is one shingle; null, empty and blank texts have an empty set,
    which links with nothing.  Rows that repeat an id and a text get equal rows, a missing id
    has no component, an empty table gives an empty result; other columns are ignored.

    ``keys_of`` gives other keys of a set (last ten bits zero): then those pairs are found whose
    sets share a key, directly or in chains, and links are confirmed all the same.  ``groups``
    (key, doc_id) adds keys that come from elsewhere.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    nodes = stored(set_digests(rows, size), "set-digests")
    held = nodes.where("size > 0 AND doc_id IS NOT NULL")
    named = cut_lineage(held.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("size").alias("size")))
    copies = cut_lineage(held.select("doc_id", "digest").join(named, "digest").where("doc_id <> node").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct())
    # Equal sets share all keys, so the first node of a key is the first of its copies; edges of the others go.
    keyed = set_keys(rows, size, least, keys_of)
    if groups is not None:  # copies need not share these, so the first of the copies takes them
        first = groups.join(copies, F.col("doc_id") == F.col("a"), "left")
        keyed = keyed.unionByName(first.select("key", F.coalesce("b", "doc_id").alias("node")).distinct())
    stars = cut_lineage(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
        _stars, "tile int, a bigint, b bigint").distinct().join(copies.select("a"), "a", "left_anti"))
    # A block is a component inside one tile of sizes; a clash of these hashes would only join two blocks.
    blocks = components(stars.select(F.xxhash64("tile", "a").alias("a"), F.xxhash64("tile", "b").alias("b")))
    inside = stars.select("tile", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.xxhash64("tile", "node"))
    blocked = inside.join(blocks, F.col("at") == F.col("a"), "left").select("node", F.coalesce("b", "at").alias("block"))
    members = cut_lineage(blocked.join(named.select("node", "size").distinct(), "node"))
    members = chunked(members, weight)
    sets = member_sets(rows, members, size)
    chunks = members.groupBy("block", "chunk").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    tiles = cut_lineage(chunks.select("block", F.col("chunk").alias("low"), "most").join(
        chunks.select("block", F.col("chunk").alias("high"), "least"), "block").where(
        f"low <= high AND {least[0]} * least <= {least[1]} * most").select("block", "low", "high"))
    near = _tiles(members.withColumn("label", F.col("node")), sets, tiles.where("high - low <= 1"), least)
    edges = cut_lineage(copies.unionByName(near))
    far = tiles.where("high - low > 1")
    joined = components(edges)
    if not far.isEmpty():
        # Chunks far apart: only where two components may still be joined.
        labelled = cut_lineage(members.join(joined, F.col("node") == F.col("a"), "left").select(
            "block", "chunk", "node", F.coalesce("b", "node").alias("label")))
        ends = labelled.groupBy("block", "chunk").agg(F.min("label").alias("x"), F.max("label").alias("y"))
        low, high = (ends.select("block", F.col("chunk").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y")) for n in ("low", "high"))
        open_ = far.join(low, ["block", "low"]).join(high, ["block", "high"]).where(
            "low_x <> low_y OR high_x <> high_y OR low_x <> high_x").select("block", "low", "high")
        more = _tiles(labelled, sets, open_, least)
        joined = components(edges.unionByName(more))
    found = joined.select(F.col("a").alias("_node"), F.col("b").alias("_root"))
    return nodes.join(found, F.col("doc_id") == F.col("_node"), "left").select(
        F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("_root", "doc_id").alias("component_id"))


def chunked(members: DataFrame, weight: int) -> DataFrame:
    """Adds the chunk of each member: blocks are cut along sizes, by summed weights.

    The window runs over the distinct sizes of a block; members of one size are spread by hash.
    """
    each = F.col("size") + BASE
    sizes = members.groupBy("block", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("block").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("first", F.coalesce(F.sum(F.col("n") * each).over(before), F.lit(0)))
    place = F.col("first") + F.pmod(F.xxhash64("node"), F.col("n")) * each
    return cut_lineage(members.join(sizes, ["block", "size"]).select(
        "block", "node", "size", F.floor(place / weight).cast("bigint").alias("chunk")))


def member_sets(rows: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of the members of blocks.  Texts are not shuffled: a bit table of
    bounded size (``FILTER`` bits) tells the tasks which ids may be asked for; the join with the
    tiles leaves out the sets of others that pass it."""
    asked = members.select(F.col("node").alias("doc_id")).distinct()
    bits = 1 << 16
    while bits < FILTER and bits < 16 * asked.count():
        bits *= 2
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    cells = asked.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(cell & 63 AS INT)))").alias("bits")).toArrow()
    table_bits = np.zeros(bits // 64, np.uint64)
    table_bits[cells["word"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("cell").to_numpy(zero_copy_only=False)
            wanted = batch.filter(pa.array((table_bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in pieces([wanted], "text"):
                yield table(SETS, part.column("doc_id"), [shingle_set(t, size).tobytes() for t in texts(part)])

    return rows.where("doc_id IS NOT NULL").select("doc_id", "text", cell.alias("cell")).mapInArrow(
        shingles, "node bigint, shingles binary")


QUERIES = {"op13_jaccard": lambda s, d: jaccard_components(documents(s, d))}
ORACLE: dict[str, str] = {}
