"""Spelling variants: words one edit apart, grouped under their frequent form.

* Words are counted in Arrow batches and summed by word.
* The vocabulary goes into blocked Bloom filters, one set per word length: a word sets four
  bits of one 64-bit block.  The filters are sent to the tasks in rounds of at most
  ``ROUND`` words, 2 bytes a word; a longer list of one length is cut by hash over several
  rounds.  So what is sent is bounded, whatever the vocabulary.
* Every word probes the edits it can generate: each deletion in the filters of words one
  shorter, each replacement by a greater letter in those of its own length.  (An insertion
  is the deletion of the other word, and a smaller letter the greater one of the other
  word.)  Hashes of edits come from prefix sums, so no edited text is made before it is found.
* Only positives are shuffled, to an exact join with the vocabulary that removes false ones.
* Forms are followed to the last one by pointer doubling; counts grow tenfold with each
  step, so a chain has at most some twenty words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import documents, pieces, stored, table, texts
from trailweave.session import cut_lineage

SHORTEST, LEAST, TIMES, NOISE = 7, 2, 10, 31
#: Most words whose filters are sent at a time (32 MB), edits probed at a time, bytes of text in a chunk.
ROUND, PROBES, CHUNK = 1 << 24, 1 << 21, 1 << 23
WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
CELLS = pa.schema([("size", pa.int32()), ("cell", pa.int64()), ("bits", pa.int64())])
FOUND = pa.schema([("word", pa.string()), ("n", pa.int64()), ("edit", pa.string())])
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LETTER = np.random.default_rng(11).integers(0, 1 << 63, 256, np.int64).astype(np.uint64)


def runs_of(shortest: int) -> re.Pattern:
    """Maximal runs of letters of some length (a shorter run cannot give a word)."""
    return re.compile("[A-Za-zÀ-ÿ]{%d,}" % shortest)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
                noise: int = NOISE) -> DataFrame:
    """``word, n``: the words of ``shortest`` letters or more in whole texts, with their occurrences.

    A run of letters (A-Z lower-cased) is a word; where ``noise`` divides the crc32 of
    ``<id>:<run>``, the letter at crc32 modulo length is taken out first (0: never).
    """
    pattern = runs_of(shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", CHUNK):
            counts = Counter()
            lowered = pa.record_batch([pc.ascii_lower(part.column("text"))], ["text"])
            for doc_id, text in zip(part.column("id").to_pylist(), texts(lowered)):
                words = pattern.findall(text)
                counts.update(words)
                if not noise:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word in words:
                    h = zlib.crc32(word.encode(), seed)
                    if not h % noise:
                        at = h % len(word)
                        counts[word] -= 1
                        counts[word[:at] + word[at + 1 :]] += 1
            kept = [(w, n) for w, n in counts.items() if n > 0 and len(w) >= shortest]
            if kept:
                yield table(WORDS, *zip(*kept))

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: list[str], size: int) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.array(words, f"<U{size}").view("<u4").reshape(-1, size)


def powers(size: int) -> np.ndarray:
    out = np.full(size, np.uint64(_BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


def spread(sums: np.ndarray) -> np.ndarray:
    sums = (sums ^ (sums >> np.uint64(31))) * _MIX
    return sums ^ (sums >> np.uint64(29))


class Shard:
    """A blocked Bloom filter of the words of one length, or of one slice of them."""

    def __init__(self, size: int, piece: int, slices: int, words: int):
        self.size, self.piece, self.slices = size, piece, slices
        self.blocks = np.zeros(max(1, words // slices // 4 + 1), np.uint64)

    def mine(self, hashed: np.ndarray) -> np.ndarray:
        return hashed % np.uint64(self.slices) == np.uint64(self.piece)

    def place(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block and the bits of each hash."""
        bits = np.zeros(len(hashed), np.uint64)
        for k in range(4):
            bits |= np.uint64(1) << ((hashed >> np.uint64(34 + 6 * k)) & np.uint64(63))
        return (hashed // np.uint64(self.slices)) % np.uint64(len(self.blocks)), bits

    def holds(self, hashed: np.ndarray) -> np.ndarray:
        cell, bits = self.place(hashed)
        found = self.blocks[cell] & bits == bits
        return found & self.mine(hashed) if self.slices > 1 else found


def by_size(batch: pa.RecordBatch, sizes: set[int]) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False)
    for size in sorted(sizes & set(np.unique(lengths).tolist())):
        yield size, batch.filter(pa.array(lengths == size))


def edits(words: list[str], deleted: Shard | None, replaced: Shard | None, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, edited words) of the edits that the filters hold."""
    size = len(words[0])
    step = max(1, PROBES // (size * max(len(alphabet), 1)))
    power = powers(size)
    for begin in range(0, len(words), step):
        chars = letters(words[begin : begin + step], size)
        parts = _LETTER[chars] * power
        whole = parts.sum(1)
        if deleted:
            before = np.cumsum(parts, 1) - parts
            hashed = spread(before + (whole[:, None] - before - parts) * _BACK)
            first = np.ones(chars.shape, bool)  # of equal neighbours only the first is taken out
            first[:, 1:] = chars[:, 1:] != chars[:, :-1]
            row, at = np.nonzero(first)
            hit = deleted.holds(hashed[row, at])
            row, at = row[hit], at[hit]
            if len(row):
                keep = np.arange(size) != at[:, None]
                yield row + begin, chars[row][keep].reshape(-1, size - 1).copy().view(f"<U{size - 1}").ravel().tolist()
        if replaced and len(alphabet):
            for some in np.array_split(np.arange(size), -(-size * len(alphabet) * len(chars) // PROBES)):
                change = (_LETTER[alphabet][None, None, :] - _LETTER[chars[:, some]][:, :, None]) * power[some][None, :, None]
                greater = alphabet[None, None, :] > chars[:, some][:, :, None]
                row, at, letter = np.nonzero(greater)
                hit = replaced.holds(spread(whole[row] + change[row, at, letter]))
                row, at, letter = row[hit], some[at[hit]], letter[hit]
                if len(row):
                    new = chars[row]
                    new[np.arange(len(row)), at] = alphabet[letter]
                    yield row + begin, new.view(f"<U{size}").ravel().tolist()


def rounds_of(sizes: dict[int, int], most: int) -> list[list[tuple[int, int, int, int]]]:
    """(length, slice, slices, words) of all filters, in rounds of at most ``most`` words."""
    rounds, room = [[]], most
    for size, words in sorted(sizes.items()):
        slices = -(-words // most)
        for piece in range(slices):
            part = -(-words // slices)
            if part > room:
                rounds.append([])
                room = most
            rounds[-1].append((size, piece, slices, words))
            room -= part
    return [r for r in rounds if r]


def filters(vocabulary: DataFrame, shards: list[tuple[int, int, int, int]]) -> dict[int, Shard]:
    """The filters of a round, built in tasks and put together by block."""
    found = {size: Shard(size, piece, slices, words) for size, piece, slices, words in shards}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in by_size(batch, set(found)):
                shard = found[size]
                hashed = spread((_LETTER[letters(part.column("word").to_pylist(), size)] * powers(size)).sum(1))
                cell, bits = shard.place(hashed[shard.mine(hashed)])
                yield table(CELLS, np.full(len(cell), size, np.int32), cell.view(np.int64), bits.view(np.int64))

    cells = vocabulary.where(F.col("size").isin(list(found))).select("word").mapInArrow(
        run, "size int, cell bigint, bits bigint").groupBy("size", "cell").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    sizes = cells["size"].to_numpy()
    for size, shard in found.items():
        mine = sizes == size
        shard.blocks[cells["cell"].to_numpy()[mine]] = cells["bits"].to_numpy()[mine].view(np.uint64)
    return found


def near_words(vocabulary: DataFrame, most: int = ROUND) -> DataFrame:
    """``word, n, other, other_n``: every pair of words one edit apart, in both directions."""
    spark = vocabulary.sparkSession
    sizes = {r[0]: r[1] for r in vocabulary.groupBy("size").count().collect()}
    used: dict[int, list[int]] = {}
    for size, letter in vocabulary.select("size", F.explode(F.array_distinct(F.split("word", "")))).distinct().collect():
        if letter:  # at most 90 letters of each length
            used.setdefault(size, []).append(ord(letter))
    positives = None
    for shards in rounds_of(sizes, most):
        held = filters(vocabulary, shards)

        def run(batches, held=held):
            for batch in batches:
                for size, part in by_size(batch, set(held) | {s + 1 for s in held}):
                    names, counts = part.column("word").to_pylist(), part.column("n").to_numpy(zero_copy_only=False)
                    alphabet = np.array(sorted(used[size]), np.uint32)
                    for row, new in edits(names, held.get(size - 1), held.get(size), alphabet):
                        yield table(FOUND, [names[i] for i in row.tolist()], counts[row], new)

        probing = list(set(held) | {s + 1 for s in held})
        some = vocabulary.where(F.col("size").isin(probing)).select("word", "n").mapInArrow(run, "word string, n bigint, edit string")
        positives = some if positives is None else positives.unionByName(some)
    if positives is None:
        positives = spark.createDataFrame([], "word string, n bigint, edit string")
    exact = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = positives.join(exact, F.col("edit") == F.col("other")).select("word", "n", "other", "other_n")
    sides = F.array(F.struct("word", "n", "other", "other_n"),
                    F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.select(F.inline(sides))


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the one that has none."""
    jump = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = jump.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = cut_lineage(jump.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        jump = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return jump


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
                      least: int = LEAST, times: int = TIMES, noise: int = NOISE, most: int = ROUND) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words have ``shortest`` letters and ``least`` occurrences or more.  Two are near if one
    letter is inserted, deleted or replaced.  The form of a word is its most frequent near
    word (ties: the smaller in code-point order), if that has ``times`` as many occurrences.

    Null and empty texts have no words, a null id is empty text, repeated rows count as
    often as they are there, an empty table gives an empty result; other columns are ignored.
    """
    counted = word_counts(docs, id_col, text_col, shortest, noise).where(F.col("n") >= least)
    vocabulary = stored(counted.select("word", "n", F.char_length("word").alias("size")), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(vocabulary, most).groupBy(F.col("word").alias("_word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, F.col("word") == F.col("_word"), "left")
    follows = -F.col("best.less") >= times * F.col("n").cast("decimal(20,0)")
    words = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(follows, F.col("best.form")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")), "spellings")
    roots = last_forms(words.where("form IS NOT NULL")).withColumnRenamed("word", "_word")
    return words.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


QUERIES = {"op11_spelling": lambda s, d: spelling_variants(documents(s, d))}
ORACLE: dict[str, str] = {}
