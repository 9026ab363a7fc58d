"""Language identification with interpolated Kneser-Ney character models.

A model per language gives the probability of a letter after the three before it.  The
models are fitted on all four-letter runs of a bounded sample of labelled rows (``sample``
documents per language, a parameter), kept as sorted hash arrays with one column per
language, and sent to the tasks.  A text gets the language
with the lowest cross-entropy per letter.  Rejection limits are calibrated on the sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import TEXT, documents, fold, pieces, stored, table, texts

ORDER, DISCOUNT = 4, 0.75
#: Multiplier of the polynomial hash, and one start value per length.
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
SALT = np.array([0, 0x1B873593, 0x2545F491, 0x3C6EF372, 0x510E527F], np.uint64)
SAMPLE = 2000
#: Nats per letter above what the sample needed before a text is rejected.
SLACK = 1.5
NONE = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point to lower-case letter; a space for everything else, 0 for 0 (the edge of a text)."""
    if not _LETTERS:
        lut = np.full(0x110000, 32, np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                lut[code] = ord(low) if len(low) == 1 else code
        lut[0] = 0
        _LETTERS.append(lut)
    return _LETTERS[0]


def letter_codes(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, three edge marks before each, runs of other characters as
    one space; and the index in it where every text starts (marks first)."""
    edge = "\0" * (ORDER - 1)
    docs = [t.replace("\0", " ") if "\0" in t else t for t in docs]
    codes = letters()[np.frombuffer((edge + edge.join(docs)).encode("utf-32-le", "surrogatepass"), "<u4")]
    starts = np.cumsum([0] + [len(t) + len(edge) for t in docs[:-1]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    place = np.cumsum(keep) - keep
    return codes[keep], place[starts]


def keys(codes: np.ndarray, length: int, end: int = 0) -> np.ndarray:
    """Hash of the ``length`` codes that end ``end`` columns before the last one.

    ``codes`` is a list of columns, oldest first.
    """
    out = np.full(len(codes[0]), SALT[length], np.uint64)
    for column in codes[len(codes) - end - length : len(codes) - end]:
        out = out * MULTIPLY + column
    return out


@dataclass
class Lookup:
    """Sorted hashes and one row of values each."""

    key: np.ndarray
    value: np.ndarray

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key


@dataclass
class Languages:
    names: list[str]
    probability: list[Lookup] = field(default_factory=list)  # by length - 1, log
    weight: list[Lookup] = field(default_factory=list)  # of the shorter context, by its length, log
    unknown: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: np.ndarray | None = None
    heat: float = 0.1

    def logs(self, columns: list[np.ndarray], length: int = ORDER) -> np.ndarray:
        """Log-probability of the last column after the others, a column per language."""
        if length == 0:
            return np.broadcast_to(self.unknown, (len(columns[0]), len(self.names)))
        at, hit = self.probability[length - 1].find(keys(columns, length))
        out = self.probability[length - 1].value[at] if len(self.probability[length - 1].key) else np.zeros(
            (len(at), len(self.names)), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest = [c[miss] for c in columns]
            low = self.logs(rest, length - 1)
            if length > 1:
                at, hit = self.weight[length - 1].find(keys(rest, length - 1, 1))
                low = low + np.where(hit[:, None], self.weight[length - 1].value[at], 0)
            out[miss] = low
        return out

    def entropies(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of every text in every language, and letters."""
        codes, starts = letter_codes(docs)
        wide = codes.astype(np.uint64)
        at = np.flatnonzero(codes != 0)
        total, count = np.zeros((len(docs), len(self.names))), np.zeros(len(docs), np.int64)
        for i in range(0, len(at), 1 << 18):
            part = at[i : i + (1 << 18)]
            logs = self.logs([wide[part - k] for k in range(ORDER - 1, -1, -1)])
            doc = np.searchsorted(starts, part, "right") - 1
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total[doc[first]] += np.add.reduceat(logs, first, axis=0, dtype=np.float64)
        letter = np.r_[0, np.cumsum((codes != 0) & (codes != 32))]
        ends = np.r_[starts[1:], len(codes)]
        count = letter[ends] - letter[starts]
        size = np.r_[0, np.cumsum(codes != 0)]
        return -total / np.maximum(size[ends] - size[starts], 1)[:, None], count


def fit(names: list[str], grams: list[dict[str, int]]) -> Languages:
    """Models from the counts of four-letter runs per language."""
    model = Languages(names)
    rows, counts = [], []
    for found in grams:
        text = "".join(found)
        rows.append(np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(-1, ORDER).astype(np.uint64))
        counts.append(np.fromiter(found.values(), np.float64, len(found)))
    pooled = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, ORDER), np.uint64)
    size = len(np.unique(pooled[:, -1])) + 1
    shares = np.ones((1, len(names)))
    below = Lookup(np.zeros(0, np.uint64), np.zeros((0, len(names))))
    model.weight.append(below)
    for length in range(1, ORDER + 1):
        union = np.unique(pooled[:, ORDER - length :], axis=0)
        columns = list(union.T)
        own, context = keys(columns, length), keys(columns, length - 1, 1)
        contexts = np.unique(context)
        share, weights = np.zeros((len(union), len(names))), np.ones((len(contexts), len(names)))
        for i, (codes, n) in enumerate(zip(rows, counts)):
            # Below the full length a run counts once for every letter seen before it.
            key, inverse = np.unique(keys(list(codes.T), length), return_inverse=True)
            amount = np.bincount(inverse, weights=n if length == ORDER else None, minlength=len(key))
            parent = np.zeros(len(key), np.uint64)
            parent[inverse] = keys(list(codes.T), length - 1, 1)
            place = np.searchsorted(contexts, parent)
            total = np.bincount(place, weights=amount, minlength=len(contexts))
            kinds = np.bincount(place, minlength=len(contexts))
            weights[:, i] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)
            at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
            seen = key[at] == own if len(key) else np.zeros(len(own), bool)
            mine = total[np.searchsorted(contexts, context)]
            share[:, i] = np.where(seen & (mine > 0), (amount[at] if len(key) else 0) - DISCOUNT, 0) / np.maximum(mine, 1)
        if length == 1:
            share += weights / size
            model.unknown = np.log(np.maximum(weights[0] / size, 1e-12)).astype(np.float32) if len(contexts) else np.zeros(
                len(names), np.float32)
        else:
            place, _ = below.find(keys(columns, length - 1))
            share += weights[np.searchsorted(contexts, context)] * shares[place]
            model.weight.append(Lookup(contexts, np.log(np.maximum(weights, 1e-12)).astype(np.float32)))
        order = np.argsort(own)
        shares = share[order]
        below = Lookup(own[order], np.log(np.maximum(shares, 1e-12)).astype(np.float32))
        model.probability.append(below)
    return model


def sample_rows(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each group at most, chosen by a hash of ``key``."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_group")
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30))
    return rows.join(F.broadcast(counts), F.col(group) == F.col("_group")).where(
        place < F.lit(float(most << 30)) / F.col("_n")).drop("_group", "_n")


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE) -> Languages:
    """Fit and calibrate models on a sample of the rows for which ``learn`` holds."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    taken = stored(sample_rows(rows, "lang", "doc_id", sample), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
        found: dict[str, Counter] = {}
        for piece in pieces(batches, "text"):
            for lang, text in zip(piece.column("lang").to_pylist(), texts(piece)):
                codes, _ = letter_codes([text])
                s = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                found.setdefault(lang, Counter()).update(map("".join, zip(s, s[1:], s[2:], s[3:])))
        for lang, counter in found.items():
            yield table(schema, [lang] * len(counter), list(counter), list(counter.values()))

    counted = taken.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by: dict[str, dict[str, int]] = {}
    for batch in counted.toArrow().to_batches():  # bounded: the runs of the sample
        for lang, gram, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            by.setdefault(lang, {})[gram] = n
    names = sorted(by)
    model = fit(names, [dict(sorted(by[n].items())) for n in names])
    calibrate(model, taken)
    return model


def calibrate(model: Languages, taken: DataFrame) -> None:
    """Usual cross-entropy per language on the sample, the limit above which a text is
    rejected, and the sharpness of the scores."""
    if not model.names:
        return
    names = {n: i for i, n in enumerate(model.names)}
    schema = pa.schema([("lang", pa.int32()), ("letters", pa.int64()), ("h", pa.list_(pa.float64()))])

    def score(batches):
        for piece in pieces(batches, "text"):
            h, n = model.entropies(texts(piece))
            yield table(schema, [names.get(x, -1) for x in piece.column("lang").to_pylist()], n, h.tolist())

    rows = taken.mapInArrow(score, "lang int, letters bigint, h array<double>").toArrow()  # bounded by the sample
    lang, n = rows.column("lang").to_numpy(), rows.column("letters").to_numpy()
    h = np.array(rows.column("h").to_pylist(), float).reshape(-1, len(names))
    model.mean, model.spread, model.limit = (np.zeros(len(names)) for _ in range(3))
    for i in range(len(names)):
        own, size = h[(lang == i) & (n > 0), i], n[(lang == i) & (n > 0)]
        if len(own):
            model.mean[i] = np.median(own)
            model.spread[i] = 1.4826 * np.median(np.abs(own - model.mean[i]) * np.sqrt(size))
            extra = own - 4 * model.spread[i] / np.sqrt(size)
            model.limit[i] = max(np.quantile(extra, 0.999), model.mean[i]) + SLACK
        else:
            model.limit[i] = np.inf
    good = (lang >= 0) & (n > 0)
    losses = {heat: -np.log(np.maximum(posterior(h[good], n[good], heat)[np.arange(good.sum()), lang[good]], 1e-9)).mean()
              for heat in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)} if good.any() else {0.1: 0}
    model.heat = min(losses, key=losses.get)


def posterior(h: np.ndarray, n: np.ndarray, heat: float) -> np.ndarray:
    z = -(h - h.min(1, keepdims=True)) * (heat * np.maximum(n, 1))[:, None]
    e = np.exp(np.maximum(z, -700))
    return e / e.sum(1, keepdims=True)


PREDICTED = "doc_id bigint, lang_pred string, score double, cross_entropy double, accepted boolean"


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, accepted`` of every whole text.

    ``und`` (score 0, not accepted) where the text is null or has no letter, or nothing
    was learned; a tie goes to the first language by name.  A text is rejected
    (``accepted`` false, language kept) if its cross-entropy is above the calibrated
    limit for its length.  Repeated rows get equal rows; an empty table an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("cross_entropy", pa.float64()), ("accepted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            ids = piece.column("doc_id")
            if not model.names:
                yield table(schema, ids, *([v] * len(ids) for v in (NONE, 0.0, None, False)))
                continue
            h, n = model.entropies(texts(piece))
            best = h.argmin(1)
            low, score = h.min(1), posterior(h, n, model.heat).max(1)
            fine = low <= model.limit[best] + 4 * model.spread[best] / np.sqrt(np.maximum(n, 1))
            none = n == 0
            yield table(schema, ids, [NONE if z else model.names[b] for z, b in zip(none, best)],
                        np.where(none, 0, score), pa.array(low, mask=none), fine & ~none)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PREDICTED)


def identify(docs: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """Train on the rows outside the held-out fold and predict all: ``doc_id, held_out, lang_pred, score, ...``."""
    model = train(docs, fold("doc_id", folds) != held, **options)
    return predict(docs, model).select(
        "doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def known_language(docs: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """The documents whose language is accepted, with the columns of ``docs``."""
    model = train(docs, fold("doc_id", folds) != held, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, TEXT, 1 << 18):  # arrays of a letter each: a quarter of the usual slice
            if not model.names:
                continue
            h, n = model.entropies(texts(piece, TEXT))
            best = h.argmin(1)
            fine = h.min(1) <= model.limit[best] + 4 * model.spread[best] / np.sqrt(np.maximum(n, 1))
            kept = piece.filter(pa.array(fine & (n > 0)))
            yield kept.select([i for i in range(kept.num_columns - 1)])

    rows = docs.select(*docs.columns, F.col("text").cast("string").alias(TEXT))
    return rows.mapInArrow(run, docs.schema)


QUERIES = {"op1_language": lambda s, d: identify(documents(s, d))}
ORACLE: dict[str, str] = {}
