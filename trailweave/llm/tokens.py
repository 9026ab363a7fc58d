"""Token ids in a compact binary format: patched frame-of-reference blocks.

The ids of a run of documents make one *segment*, a byte string (little-endian):

    magic "PFR1", u32 documents, u32 blocks, u64 ids
    per document: u8 has an id, i64 id, u32 tokens
    per block of 256 ids: u64 where its body starts, u32 minimum, u8 width, u8 exceptions
    bodies: the ids less the minimum, packed at the width; then u8 place and u32 value
            of each exception

The width of a block holds at least nine tenths of its differences; larger ones are
exceptions.  Block starts are indexed, so a block is read without the ones before it.
Segments are the rows of a Parquet table (``part, segment``: order of ids).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.llm.common import documents, pieces, table
from trailweave.session import checkpoint_folder

BLOCK, COVER, END = 256, 0.9, 1
#: Words whose ids a worker remembers.
MEMORY = 600_000
MAGIC = b"PFR1"
SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())])
DOCS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()),
                  ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
HEAD = struct.Struct("<4sIIQ")
DOC = np.dtype([("has", "u1"), ("id", "<i8"), ("n", "<u4")])
INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("width", "u1"), ("odd", "u1")])


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block index and bodies of an array of ids."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, INDEX), b""
    full = np.resize(ids, blocks * BLOCK).astype(np.uint32)
    full[len(ids):] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(1)
    delta = full - low[:, None]
    bits = np.frexp(delta.astype(np.float64))[1]  # bits of each difference; 0 for 0
    spread = np.bincount((np.arange(blocks)[:, None] * 33 + bits).ravel(), minlength=blocks * 33).reshape(blocks, 33)
    width = (np.cumsum(spread, 1) >= COVER * BLOCK).argmax(1)
    large = bits > width[:, None]
    odd = large.sum(1)
    size = width * (BLOCK // 8) + odd * 5
    index = np.zeros(blocks, INDEX)
    index["start"], index["low"], index["width"], index["odd"] = np.cumsum(size) - size, low, width, odd
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        every = np.flatnonzero(width == w)
        for at in np.array_split(every, -(-len(every) // 512)) if w else []:
            ones = np.unpackbits(delta[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, count=int(w), bitorder="little")
            packed = np.packbits(ones.reshape(len(at), -1), axis=1, bitorder="little")
            body[index["start"][at].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(large)
    first = np.cumsum(odd) - odd
    at = (index["start"].astype(np.int64) + width * (BLOCK // 8))[row] + (np.arange(len(row)) - first[row])
    body[at] = place
    at = (index["start"].astype(np.int64) + width * (BLOCK // 8) + odd)[row] + 4 * (np.arange(len(row)) - first[row])
    body[at[:, None] + np.arange(4)] = delta[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return index, body.tobytes()


def unpack(index: np.ndarray, body: bytes, count: int) -> np.ndarray:
    """The ids that ``pack`` was given."""
    raw, blocks = np.frombuffer(body, np.uint8), len(index)
    delta = np.zeros((blocks, BLOCK), np.uint32)
    start, width, odd = (index[c].astype(np.int64) for c in ("start", "width", "odd"))
    for w in np.unique(width):
        every = np.flatnonzero(width == w)
        for at in np.array_split(every, -(-len(every) // 512)) if w else []:
            ones = np.unpackbits(raw[start[at][:, None] + np.arange(w * BLOCK // 8)], axis=1, bitorder="little")
            ones = ones.reshape(len(at), BLOCK, w)
            values = np.zeros((len(at), BLOCK), np.uint32)
            for bit in range(w):
                values |= ones[:, :, bit].astype(np.uint32) << np.uint32(bit)
            delta[at] = values
    row = np.repeat(np.arange(blocks), odd)
    nth = np.arange(len(row)) - (np.cumsum(odd) - odd)[row]
    base = start + width * (BLOCK // 8)
    place = raw[base[row] + nth]
    value = raw[(base + odd)[row][:, None] + 4 * nth[:, None] + np.arange(4)].copy().view("<u4").ravel()
    delta[row, place] = value
    return (delta + index["low"][:, None]).ravel()[:count]


def segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    index, body = pack(ids)
    docs = np.zeros(len(doc_ids), DOC)
    docs["has"], docs["id"], docs["n"] = [x is not None for x in doc_ids], [x or 0 for x in doc_ids], counts
    return HEAD.pack(MAGIC, len(docs), len(index), len(ids)) + docs.tobytes() + index.tobytes() + body


def read_segment(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, tokens per document, and all ids of a segment."""
    magic, n_docs, n_blocks, n_ids = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    docs = np.frombuffer(payload, DOC, n_docs, HEAD.size)
    at = HEAD.size + n_docs * DOC.itemsize
    index = np.frombuffer(payload, INDEX, n_blocks, at)
    ids = unpack(index, payload[at + n_blocks * INDEX.itemsize :], n_ids)
    return [int(i) if has else None for has, i in zip(docs["has"], docs["id"])], docs["n"].astype(np.int64), ids


#: Runs of ASCII characters, and ASCII marks.
ASCII = re.compile(r"[\x00-\x7f]+")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The character that stands for each byte: printable ones for themselves, the others from 256 up.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b for b in SHOWN} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in SHOWN)}


class WordIds(dict):
    """Ids of white-space separated words as little-endian u32 bytes, remembered.

    The tokenizer never joins across white space and splits letters from punctuation, so a
    text is encoded word by word.  A word is looked up in lower case, apart from the marks
    behind its letters, only where that cannot change its ids: words of ASCII, and words whose
    every character neither lower-casing nor composition (NFC) would change once A-Z are
    lower.  Any other word goes to the library as it was written, marks included; such a word,
    and one that may hold an added token, comes here after a space.

    With ``added``, the strings of the tokenizer's added tokens, as written, get their own
    ids as in the library's plain call; otherwise they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.added = {t.content: n for n, t in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def plain(self, word: str) -> bytes:
        """Ids of a word without added tokens."""
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word[:1] == " ":
            parts = [p for p in self.split.split(word[1:]) if p] if self.added else [word[1:]]
            ids = b"".join(array("I", [self.added[p]]).tobytes() if p in self.added else self.plain(p) for p in parts)
        else:
            stem = word.rstrip(MARKS)
            if stem != word and stem and stem[-1].isalpha():
                ids = self[stem] + self[word[len(stem):]]
            elif word.isalpha():
                mapped = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
                ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            else:
                ids = self.plain(word)
        if len(self) < MEMORY:
            self[word] = ids
        return ids

    def apart(self, lower: pa.Array, keys: list[str]) -> np.ndarray:
        """Which different words, with A-Z lower, the library must see as they were written: those that are
        not plain even then, and those that may hold an added token."""
        found = np.zeros(len(lower), bool)
        for at in np.flatnonzero(pc.invert(pc.string_is_ascii(lower)).to_numpy(zero_copy_only=False)).tolist():
            word = keys[at]
            found[at] = not (word == word.lower() and is_normalized("NFC", word) and (word.isalpha() or ASCII.sub("", word).isalpha()))
        for token in self.added:
            found |= pc.match_substring(lower, token.lower()).to_numpy(zero_copy_only=False)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, the end id after each, and the number per text.

        Arrow splits the texts and numbers their words, so each different word is looked
        up once; ids are then put in place by index.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten()
        numbered = pc.ascii_lower(words).dictionary_encode()
        code, keys = numbered.indices.to_numpy(zero_copy_only=False), numbered.dictionary.to_pylist()
        apart = self.apart(numbered.dictionary, keys)
        if apart.any():
            at = np.flatnonzero(apart[code])
            written = words.take(pa.array(at)).dictionary_encode()
            code = code.copy()
            code[at] = len(keys) + written.indices.to_numpy(zero_copy_only=False)
            keys = [*keys, *(f" {word}" for word in written.dictionary.to_pylist())]
            for place in np.flatnonzero(apart).tolist():
                keys[place] = ""
        parts = list(map(self.__getitem__, keys))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        n = size[code]
        after = np.cumsum(n)
        ids = pool[np.repeat((np.cumsum(size) - size)[code] - (after - n), n) + np.arange(n.sum())]
        ends = np.r_[0, after][np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()]
        return np.insert(ids, ends, END), np.diff(ends, prepend=0) + 1


_WORDS: dict[tuple[str, bool], WordIds] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 added: bool = False) -> None:
    """Encode whole texts, append the end id to each, and write segments in ascending order of id.

    Strings of the tokenizer's added tokens get their own ids if ``added``, else they are ordinary text.

    Null texts are empty (the end id only); documents without an id come first; rows that
    repeat an id are in order of a hash of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, added) not in _WORDS:
            _WORDS[tokenizer, added] = WordIds(tokenizer, added)
        words = _WORDS[tokenizer, added]
        part, number = TaskContext.get().partitionId(), 0
        for piece in pieces(batches, "text", 1 << 22):
            ids, counts = words.encode(piece.column("text"))
            payload = segment(piece.column("doc_id").to_pylist(), counts, ids)
            yield table(SEGMENTS, [part], [number], [int(counts.sum())], [payload])
            number += 1

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, "part int, segment int, n_ids bigint, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids``: the written ids of every document."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for payload in batch.column("payload"):
                doc_ids, counts, ids = read_segment(payload.as_py())
                ends = np.cumsum(counts)
                yield table(schema, doc_ids, [ids[e - n : e].tolist() for e, n in zip(ends, counts)])

    return spark.read.parquet(path).select("payload").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from written files, every block decoded."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, counts, ids = read_segment(batch.column("payload")[row].as_py())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, counts)]
                n = len(doc_ids)
                yield table(DOCS, [batch.column("part")[row].as_py()] * n, [batch.column("segment")[row].as_py()] * n,
                            doc_ids, ends - counts, counts, crcs)

    files = spark.read.parquet(path)
    rows = files.mapInArrow(
        run, "part int, segment int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    # Parts first (one row per written partition), then segments inside their part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_part_start"))
    starts = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_start")).join(
        parts, F.col("part") == F.col("_part")).select(
        F.col("part").alias("_p"), F.col("segment").alias("_s"), (F.col("_start") + F.col("_part_start")).alias("_first"))
    found = rows.join(starts, (F.col("part") == F.col("_p")) & (F.col("segment") == F.col("_s")))
    return found.select("doc_id", (F.col("_first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, **options) -> DataFrame:
    """Write the token files of ``docs`` (in the shared folder unless ``path`` is given) and index them."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_folder(spark)}/trailweave-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer or default_tokenizer(), **options)
    return token_index(spark, path)


QUERIES = {"op6_token_blocks": lambda s, d: tokenize(documents(s, d), added=True)}
ORACLE: dict[str, str] = {}
