"""Toxicity scores: a learned lexicon, misspellings by automaton, and context windows.

Terms that mark toxic documents are learned from a bounded sample of labelled rows and
put into a trie.  The trie is intersected with a Levenshtein automaton (substitution,
insertion, deletion, swap of neighbours); the product is made deterministic state by
state, as words ask for it.  Terms of ``LONG`` letters or more may have two edits, others
one, and terms of fewer than ``FREE`` letters keep their length.  Besides runs of letters,
words between white space are looked up whole, so digits and signs inside a word stand
for letters (``id1ot``).  A hit is weighed by its term, its form (exact, other letters,
masked) and the words around it: between quotation marks or not, near other hits or
alone.  A logistic regression turns the sums into a probability.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import documents, fold, lower_words, pieces, stored, table, texts
from trailweave.llm.language import sample_rows
from trailweave.llm.simhash import fingerprint

#: Labelled rows of each class to learn from.
SAMPLE = 20_000
#: Least evidence for a term (G squared), and words on each side of a window.
EVIDENCE, SIDE = 20.0, 5
#: Letters from which an edit may change the length, and from which a term may have two edits.
FREE, LONG = 5, 8
#: Automaton states a worker keeps; they are made anew as needed.
STATES = 1 << 16
FEATURES = 7
#: Share of a term's weight that a misspelling has which the sample does not hold.
MISSPELT = 0.8
#: Forms of a hit: the term, other letters, digits or signs inside.
EXACT, LETTERS, MASKED = 0, 1, 2
TOKEN = re.compile(r"[^\W\d_]+")
MARKED = re.compile(r"[^\W\d_]+|[\"“”„«»‹›‘’]")
#: From the first to the last letter or digit between white space.
INNER = re.compile(r"[^\W_](?:\S*[^\W_])?")


class Automaton:
    """The trie of some terms and the automaton of ``most`` edits, intersected on demand.

    A state is a set of (trie node, edits, pending letter of a swap).
    """

    def __init__(self, terms: list[str], most: int = 1, numbers: list[int] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.length = {}
        self.most = most
        for number, word in zip(numbers or range(len(terms)), terms):
            node = 0
            for letter in word:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                node = self.children[node][letter]
            self.term[node] = number
            self.length[number] = len(word)
        self.clear()

    def clear(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.parts: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[list[tuple[int, int]]] = []
        self.state(self.closed({(0, 0, "")}))

    def closed(self, parts: set) -> frozenset:
        """With the states reached by leaving out letters of the term."""
        found, new = set(parts), parts
        while new:
            new = {(child, edits + 1, "") for node, edits, swap in new if edits < self.most and not swap
                   for child in self.children[node].values()} - found
            found |= new
        return frozenset(found)

    def state(self, parts: frozenset) -> int:
        if not parts:
            return -1
        if parts not in self.states:
            self.states[parts] = len(self.parts)
            self.parts.append(parts)
            self.moves.append({})
            self.ends.append(sorted((edits, self.term[node]) for node, edits, swap in parts if not swap and self.term[node] >= 0))
        return self.states[parts]

    def step(self, at: int, letter: str) -> int:
        after = set()
        for node, edits, swap in self.parts[at]:
            if swap:
                if swap == letter:
                    after.add((node, edits, ""))
                continue
            children = self.children[node]
            if letter in children:
                after.add((children[letter], edits, ""))
            if edits < self.most:
                after.add((node, edits + 1, ""))
                for first, child in children.items():
                    after.add((child, edits + 1, ""))
                    if letter in self.children[child]:
                        after.add((self.children[child][letter], edits + 1, first))
        to = self.state(self.closed(after))
        self.moves[at][letter] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, the first term on a tie."""
        if len(self.parts) > STATES:
            self.clear()
        at = 0
        for letter in word:
            move = self.moves[at].get(letter)
            at = self.step(at, letter) if move is None else move
            if at < 0:
                return None
        return next(((e, t) for e, t in self.ends[at] if not e or self.length[t] >= FREE or self.length[t] == len(word)), None)


class Lexicon:
    """All terms with one edit, and the long ones with two."""

    def __init__(self, terms: list[str]):
        long = [n for n, t in enumerate(terms) if len(t) >= LONG]
        self.one = Automaton(terms)
        self.two = Automaton([terms[n] for n in long], 2, long) if long else None
        self.longest = max(map(len, terms), default=0) + 2
        self.looked: dict[str, tuple[int, int] | None] = {}

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term within the edits that its length allows."""
        hit = self.one.find(word)
        return self.two.find(word) if hit is None and self.two and len(word) >= LONG - 2 else hit

    def find_all(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """The words with a term; what was looked up lately is remembered."""
        if len(self.looked) > STATES:
            self.looked.clear()
        new = words - self.looked.keys()
        self.looked.update((w, self.find(w) if len(w) <= self.longest else None) for w in new)
        return {w: hit for w in words if (hit := self.looked[w])}


@dataclass
class Toxicity:
    terms: list[str]
    exact: np.ndarray
    edited: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    weight: np.ndarray | None = None
    _lexicon: list = field(default_factory=list)

    def __getstate__(self):
        return self.__dict__ | {"_lexicon": []}

    def lexicon(self) -> Lexicon:
        if not self._lexicon:
            self._lexicon.append(Lexicon(self.terms))
        return self._lexicon[0]

    def hits(self, docs: list[str]) -> list[list[tuple[int, int, bool, int]]]:
        """Per text, (term, form, quoted, other hits in the window) of every hit.

        A word with digits or signs inside is a hit where none of its letter runs is one.
        """
        lexicon = self.lexicon()
        low = [t.lower() for t in docs]
        runs = [TOKEN.findall(t) for t in low]
        words = [set(t.split()) for t in low]
        known = {w: (term, LETTERS if edits else EXACT) for w, (edits, term) in lexicon.find_all(set().union(*runs)).items()}
        cores = {w: m[0] for w in set().union(*words) if not w.isalpha() and (m := INNER.search(w))}
        cores = {w: core for w, core in cores.items() if not core.isalpha() and not core.isdigit()}
        hit_cores = lexicon.find_all(set(cores.values()))
        masked = {w: (hit_cores[core][1], MASKED) for w, core in cores.items() if core in hit_cores}
        out = []
        for text, own, whole in zip(low, runs, words):
            signed = not masked.keys().isdisjoint(whole)
            if not signed and known.keys().isdisjoint(own):
                out.append([])
                continue
            found: list[tuple[int, tuple[int, int]]] = []  # (letter run it stands at, (term, form))
            count, marks = 0, []
            for token in MARKED.findall(text):
                if token[0].isalpha():
                    if token in known:
                        found.append((count, known[token]))
                    count += 1
                else:
                    marks.append(count)  # the mark stands before this word
            if signed:
                starts, taken = [m.start() for m in TOKEN.finditer(text)], [place for place, _ in found]
                for m in re.finditer(r"\S+", text):
                    if m[0] in masked:
                        first, last = (bisect_left(starts, m.start() + x) for x in INNER.search(m[0]).span())
                        if bisect_left(taken, first) == bisect_left(taken, last):
                            found.append((first, masked[m[0]]))
                found.sort()
            places, quotes = np.array([place for place, _ in found], np.int64), np.array(marks, np.int64)
            near = np.searchsorted(places, places + SIDE, "right") - np.searchsorted(places, places - SIDE) - 1
            before = np.searchsorted(quotes, places, "right") - np.searchsorted(quotes, places - SIDE)
            after = np.searchsorted(quotes, places + 1 + SIDE, "right") - np.searchsorted(quotes, places + 1)
            out.append([(term, form, bool(b and a), int(n)) for (_, (term, form)), n, b, a in zip(found, near, before, after)])
        return out

    def features(self, hits: list[list[tuple[int, int, bool, int]]]) -> np.ndarray:
        out = np.zeros((len(hits), FEATURES))
        for row, found in zip(out, hits):
            for term, form, quoted, near in found:
                weight = self.edited[form - 1, term] if form else self.exact[term]
                if weight <= 0:
                    continue
                kind = int(quoted)
                row[kind] = max(row[kind], weight)
                row[2 + kind] += weight
                row[4 + kind] += weight / self.exact[term]  # a misspelling is part of a hit
                row[6] += 0 if quoted else near
        out[:, 2:] = np.log1p(out[:, 2:])
        return out

    def scores(self, docs: list[str]) -> np.ndarray:
        x = (self.features(self.hits(docs)) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weight[1:] + self.weight[0], -30, 30)))


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    return np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1))


def logistic(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a weighted logistic regression; the first weight is the intercept."""
    x, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    penalty = np.eye(len(w)) * ridge
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (importance * p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (importance * (y - p)) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Toxicity:
    """Learn from at most about ``sample`` labelled rows of each class for which ``learn``
    holds.  Copies (equal fingerprints) count once.  Rows with a null label are ignored; a
    document with several labels counts as toxic if one is."""
    marks = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = dict(marks.groupBy("toxic").count().collect())
    taken = sample_rows(marks, "toxic", "doc_id", sample).select(F.col("doc_id").alias("_doc_id"), "toxic")
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = own.join(F.broadcast(taken), F.col("doc_id") == F.col("_doc_id")).select("toxic", "text")  # bounded by ``sample``

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("print", pa.int64()), ("text", pa.string())])
        for piece in pieces(batches, "text"):
            yield table(schema, piece.column("toxic"), [fingerprint(lower_words(t), 3) for t in texts(piece)], piece.column("text"))

    rows = stored(found.mapInArrow(prints, "toxic int, print bigint, text string").dropDuplicates(["toxic", "print"]).drop("print"),
                  "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
        bad, good = Counter(), Counter()
        for piece in pieces(batches, "text"):
            for toxic, text in zip(piece.column("toxic").to_pylist(), texts(piece)):
                (bad if toxic else good).update({w for w in TOKEN.findall(text.lower()) if len(w) > 2})
        words = list(bad.keys() | good.keys())
        yield table(schema, words, [bad[w] for w in words], [good[w] for w in words])

    n = dict(rows.groupBy("toxic").count().collect())
    n_bad, n_good = float(n.get(1, 0)), float(n.get(0, 0))
    a, b, pool = F.col("toxic"), F.col("clean"), (F.col("toxic") + F.col("clean")) / F.lit(max(n_bad + n_good, 1))
    part = lambda k, total: F.when(k > 0, k * F.log(k / (pool * total))).otherwise(0.0)
    words = rows.mapInArrow(count, "word string, toxic bigint, clean bigint").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = words.withColumn("g", 2 * (part(a, F.lit(max(n_bad, 1))) + part(b, F.lit(max(n_good, 1))))).where(
        (F.col("g") >= EVIDENCE) & (a / max(n_bad, 1) > 2 * b / max(n_good, 1))).orderBy(F.desc("g"), "word").toArrow()  # words of the sample
    model = Toxicity(best.column("word").to_pylist(), log_odds(
        best.column("toxic").to_numpy().astype(float), best.column("clean").to_numpy().astype(float), n_bad, n_good))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("hits", pa.list_(pa.list_(pa.int32())))])
        for piece in pieces(batches, "text"):
            yield table(schema, piece.column("toxic"), [[list(map(int, h)) for h in d] for d in model.hits(texts(piece))])

    rows = rows.mapInArrow(seen, "toxic int, hits array<array<int>>").toArrow()  # bounded by ``sample``
    toxic = rows.column("toxic").to_numpy().astype(float)
    hits = [[(t, f, bool(q), c) for t, f, q, c in d] for d in rows.column("hits").to_pylist()]
    counts = np.zeros((2, 2, len(model.terms)))
    for label, found in zip(toxic, hits):
        for term, form in {(t, f) for t, f, _, _ in found if f}:
            counts[int(label), form - 1, term] += 1
    odds = log_odds(counts[1], counts[0], n_bad, n_good)
    # A misspelling counts as its term unless clean documents are full of it.
    model.edited = np.where(counts.sum(0) == 0, MISSPELT * model.exact, np.minimum(odds, model.exact))
    x = model.features(hits)
    model.center, model.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    importance = np.where(toxic == 1, sizes.get(1, 0) / max(n_bad, 1), sizes.get(0, 0) / max(n_good, 1))
    model.weight = logistic((x - model.center) / model.scale, toxic, importance / max(importance.mean(), 1e-9) if len(x) else importance)
    return model


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text.

    Null and empty texts have no hit and get the score of a text without one.  Repeated
    rows get equal rows; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            p = model.scores(texts(piece))
            yield table(schema, piece.column("doc_id"), p, (p >= threshold).astype(np.int32))

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """Learn outside the held-out fold, score all: ``doc_id, held_out, score, predicted``.

    Without labelled rows every text gets the score 0.5.
    """
    model = train(docs, labels, fold("doc_id", folds) != held, **options)
    return score(docs, model).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": lambda s, d: toxicity(documents(s, d), s.read.parquet(f"{d}/labels.parquet"))}
ORACLE: dict[str, str] = {}
