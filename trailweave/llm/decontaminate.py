"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size (``block_words``); every block is matched
against all documents.  Of each item, the seeds are its rarest word triples by document
frequency in the corpus: one of any ``window`` neighbouring triples, so every run of
``window + 2`` words that a document shares with the item holds a seed, also where
the whole item is common.  Each place a seed points to is aligned with the whole item
(match 2, mismatch and gap -1); the score is the share of the item's own score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import TEXT, documents, pieces, table, texts

GRAM, WINDOW, THRESHOLD, BLOCK_WORDS = 3, 2, 0.5, 2_000_000
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def grams_of(ids: np.ndarray, size: int) -> np.ndarray:
    """Key of the word triple at every position; -1 where a word is in no item."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(GRAM):
        part = ids[k : k + n]
        key = key * size + part
        known &= part >= 0
    return np.where(known, key, -1)


@dataclass
class Block:
    """Some test items with their vocabulary; ``seeds`` are added when frequencies are known."""

    item_ids: list[int]
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    grams: np.ndarray  # sorted keys of all triples of the items
    seeds: np.ndarray | None = None  # sorted; with the item and the place of each
    seed_item: np.ndarray | None = None
    seed_place: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        vocabulary: dict[str, int] = {}
        kept = [(i, words) for i, words in ((i, words_of(t)) for i, t in rows) if len(words) >= GRAM]
        items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in kept]
        if len(vocabulary) >= 1 << 21:
            raise ValueError("a block of test items has over two million different words; lower block_words")
        grams = np.unique(np.concatenate([grams_of(x, len(vocabulary)) for x in items])) if items else np.zeros(0, np.int64)
        return cls([i for i, _ in kept], vocabulary, items, grams)

    def ids(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words_of(text)], np.int64)

    def seen(self, docs: list[str]) -> np.ndarray:
        """How many of the texts hold each triple."""
        count = np.zeros(len(self.grams), np.int64)
        for text in docs:
            found = grams_of(self.ids(text), len(self.vocabulary))
            found = np.unique(found[found >= 0])
            at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
            count[at[self.grams[at] == found]] += 1
        return count

    def choose(self, count: np.ndarray, window: int) -> None:
        """Seeds: the rarest of any ``window`` neighbouring triples of every item."""
        rows = []
        for item, ids in enumerate(self.items):
            key = grams_of(ids, len(self.vocabulary))
            often = count[np.searchsorted(self.grams, key)]
            width = min(window, len(key))
            first = np.arange(len(key) - width + 1)
            places = np.unique(first + np.argmin(often[first[:, None] + np.arange(width)], axis=1))
            rows.append(np.stack([key[places], np.full(len(places), item), places]))
        found = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0), np.int64)
        found = found[:, np.argsort(found[0], kind="stable")]
        self.seeds, self.seed_item, self.seed_place = found

    def regions(self, docs: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, word ids) of every place where seeds suggest the item."""
        size = len(self.vocabulary)
        for number, text in enumerate(docs):
            ids = self.ids(text)
            key = grams_of(ids, size)
            at = np.flatnonzero(key >= 0)
            low, high = np.searchsorted(self.seeds, key[at]), np.searchsorted(self.seeds, key[at], "right")
            hit = high > low
            if not hit.any():
                continue
            at, low, n = at[hit], low[hit], (high - low)[hit]
            seed = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, start = self.seed_item[seed], np.repeat(at, n) - self.seed_place[seed]
            order = np.lexsort((start, item))
            item, start = item[order], start[order]
            length = np.array([len(self.items[i]) for i in item])
            margin = 8 + length // 3
            new = np.r_[True, (item[1:] != item[:-1]) | (start[1:] - start[:-1] > margin[1:])]
            firsts = np.flatnonzero(new)
            lasts = np.r_[firsts[1:], len(item)] - 1
            for a, b in zip(firsts, lasts):
                yield number, int(item[a]), ids[max(0, start[a] - margin[a]) : start[b] + length[a] + margin[a]]

    def hits(self, docs: list[str], threshold: float) -> dict[tuple[int, int], float]:
        """Best score of every (text, item) that reaches the threshold."""
        best: dict[tuple[int, int], float] = {}
        found = sorted(self.regions(docs), key=lambda r: (len(self.items[r[1]]), len(r[2])))
        start = 0
        while start < len(found):
            end, widest = start, 0
            while end < len(found) and end - start < 512:
                widest = max(widest, len(found[end][2]))
                if end > start and widest * (end - start + 1) > 1 << 20:
                    break
                end += 1
            chunk = found[start:end]
            scores = align([self.items[i] for _, i, _ in chunk], [r for _, _, r in chunk])
            for (number, item, _), score in zip(chunk, scores):
                if score >= threshold:
                    best[number, item] = max(score, best.get((number, item), 0.0))
            start = end
        return best


def align(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs, row by row for all pairs at once, as shares of a full match."""
    rows, columns = max(map(len, items)), max(map(len, regions))
    a = np.full((len(items), rows), -2, np.int32)
    b = np.full((len(items), columns), -3, np.int32)
    for k, (x, y) in enumerate(zip(items, regions)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    score, best = np.zeros((len(items), columns + 1), np.int32), np.zeros(len(items), np.int32)
    step = np.arange(columns, dtype=np.int32)
    for i in range(rows):
        row = np.where(a[:, i : i + 1] == b, 2, -1).astype(np.int32) + score[:, :-1]
        np.maximum(row, score[:, 1:] - 1, out=row)
        np.maximum(row, 0, out=row)
        # A gap in the item: the best cell to the left less one per step.
        score[:, 1:] = np.maximum.accumulate(row + step, axis=1) - step
        best = np.maximum(best, score.max(1))
    return best / (2.0 * np.array([len(x) for x in items]))


def blocks(docs: DataFrame, bench: DataFrame, text_col: str, window: int, block_words: int) -> Iterator[Block]:
    """Blocks of test items with seeds; each costs one pass over the documents to count triples."""
    rows = bench.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2
    parts = -(-total // block_words)
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().orderBy("item_id", "text")
        block = Block.of([tuple(r) for r in own.collect()])  # bounded by block_words
        if not block.items:
            continue

        def count(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(block.grams), np.int64)
            for piece in pieces(batches, "text"):
                seen += block.seen(texts(piece))
            at = np.flatnonzero(seen)
            yield table(pa.schema([("gram", pa.int64()), ("n", pa.int64())]), at, seen[at])

        counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "gram bigint, n bigint")
        found = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        often = np.zeros(len(block.grams), np.int64)
        often[found.column("gram").to_numpy()] = found.column("n").to_numpy()
        block.choose(often, window)
        yield block


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id_col, item_id, score``: documents that hold a test item, whole or edited.

    ``score`` (up to 1) is the best local alignment of the item in the document as a share
    of the item's own score.  Items with fewer than three words cannot be told from
    chance and never match; null texts hold nothing; items that repeat an id count
    together; repeated documents give repeated rows.  Empty tables give an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double")
    for block in blocks(docs, bench, text_col, window, block_words):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text"):
                ids, best = piece.column("doc_id").to_pylist(), {}
                for (number, item), score in block.hits(texts(piece), threshold).items():
                    key = number, block.item_ids[item]
                    best[key] = max(score, best.get(key, 0.0))
                yield table(schema, [ids[n] for n, _ in best], [i for _, i in best], list(best.values()))

        out = out.unionByName(rows.mapInArrow(run, "doc_id bigint, item_id bigint, score double"))
    return out.withColumnRenamed("doc_id", id_col)


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
          window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no test item, with their columns; nothing is shuffled."""
    out = docs
    for block in blocks(docs, bench, text_col, window, block_words):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, TEXT):
                bad = {number for number, _ in block.hits(texts(piece, TEXT), threshold)}
                kept = piece.filter(pa.array([i not in bad for i in range(piece.num_rows)]))
                yield kept.select(list(range(kept.num_columns - 1)))

        out = out.select(*docs.columns, F.col(text_col).cast("string").alias(TEXT)).mapInArrow(run, docs.schema)
    return out


QUERIES = {
    "op9_decontaminate": lambda s, d: contaminated(documents(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
}
ORACLE: dict[str, str] = {}
