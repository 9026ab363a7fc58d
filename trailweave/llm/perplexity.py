"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

The neural vocabulary grows with the corpus: the most frequent words, 32 for every unit
of the square root of the number of distinct training words (so what is sent to tasks
stays small).  Each has an input and an output vector.  All other words are classes (a
hash of the last two bytes, which often tell the language); a word of a class has the
class probability times its smoothed share of the class.  The softmax has two levels:
words are cut by frequency into ranges of about equal sums of square-rooted counts; the
first level chooses a range or a class, the second a word of the range.  Every token has
a normalised probability from batched matrix products:
``s(w) = q . Q[w] + b[w]`` with ``q = sum_j C[j] * R[w_j]`` over the three words before it.

Counting covers all training rows.  So does training: documents are dealt by hash to
blocks of about ``BLOCK`` tokens, each block is one pass from the same start in the order
of the hashes, and every vector is averaged over the blocks by the times it was moved.
Neither depends on how the table is partitioned.  Word counts are joined to the
documents by word; only three times the size of the vocabulary is sent to the tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import documents, fold, pieces, stored, table

#: The end of a text; no word holds white space.
END = b"\n"
#: Vocabulary and ranges for each unit of a square root (of distinct words, of the vocabulary), and the classes of all other words.
GROWTH, RANGES, CLASSES = 32, 0.6, 32
SIZE, CONTEXT = 16, 3
#: Words whose counts are sent to tasks, for each word of the vocabulary; counts of all others are joined.
KNOWN = 3
#: Noise of the first level (shared by a step) and of the second (for each token), tokens of a step while it warms up and after.
NOISE, OWN_NOISE, WARM, STEPS = 32, 2, 200, (512, 4096)
RATE, WORD_RATE = 0.05, 0.1
#: Training tokens of a block, and of the piece of it that is shuffled in memory.
BLOCK, PIECE = 4_000_000, 1 << 18
#: Bytes of text that are split at a time, and whose words are looked up at a time.
TEXTS, TURN = 1 << 22, 1 << 24
#: Scores worked out at a time, which stay in a core's cache; no 32-bit exponential up to this is infinite or 0.
SCORES, SAFE = 1 << 16, 85
COUNTS = pa.schema([("token", pa.binary()), ("n_train", pa.int64()), ("n_all", pa.int64())])
CODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                   ("head_known", pa.int64()), ("head_base", pa.float64()), ("class_base", pa.float64()),
                   ("codes", pa.binary()), ("tail", pa.list_(pa.binary()))])


class Classes(dict):
    """The class of a word by its last two bytes, worked out once for each pair of bytes."""

    def __missing__(self, end: bytes) -> int:
        self[end] = found = zlib.crc32(end) % CLASSES
        return found


def class_column(token: Column) -> Column:
    """``Classes`` for a column of words."""
    return (F.crc32(F.substring(token, -2, 2)) % CLASSES).cast("int")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts with A-Z lower-cased (Arrow's ASCII functions touch no other
    bytes), and how many each text has; none if it is null."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    words = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(plain), 0), None, plain))
    return words.flatten().cast(pa.binary()), pc.fill_null(pc.list_value_length(words), 0).to_numpy()


def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray]]:
    """Slices, the number of words of each text (without the end), and all words, each distinct one held once."""
    for piece in pieces(batches, "text", TEXTS):
        words, sizes = words_of(piece.column("text"))
        yield piece, sizes, words.dictionary_encode()


def count_tokens(docs: DataFrame) -> DataFrame:
    """``token, class, n_train, n_all`` over all rows of ``text, held_out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sizes, found in split(batches):
            train = ~piece.column("held_out").to_numpy(zero_copy_only=False)
            at, n = found.indices.to_numpy(), len(found.dictionary)
            yield table(COUNTS, found.dictionary, np.bincount(at[np.repeat(train, sizes)], minlength=n), np.bincount(at, minlength=n))
            yield table(COUNTS, [END], [train.sum()], [len(train)])

    parts = docs.select("text", "held_out").mapInArrow(run, "token binary, n_train bigint, n_all bigint")
    return parts.groupBy("token").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")).select(
        "token", class_column(F.col("token")).alias("class"), "n_train", "n_all")


def head_words(counts: DataFrame, head: int) -> pa.Table:
    """The most frequent words, at most ``head``: those above a frequency that is found
    from a histogram (64 steps per doubling), so no task sorts or gathers other words."""
    step = F.floor(F.log2("n_all") * 64).cast("int")
    sizes = {r[0]: r[1] for r in counts.groupBy(step).count().collect()}  # some thousand steps
    least, total = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > head:
            break
        least = k
    return counts.where(step >= least).toArrow().sort_by([("n_all", "descending"), ("token", "ascending")])


@dataclass
class Model:
    """What tasks need: the vocabulary by falling count, cut into ranges, and the parameters.

    A code is the place of a word of the vocabulary, or the size of the vocabulary and a class.
    """

    names: pa.Array | None  # the head words; dropped once all words are codes
    code: np.ndarray  # of each head word
    log_p: np.ndarray  # log10 base probability of each head word
    known: np.ndarray
    counts: np.ndarray  # smoothed, of the vocabulary
    mass: np.ndarray  # smoothed, of the classes
    cuts: np.ndarray  # first word of each range, and the end
    total: float
    params: list[np.ndarray] | None = None

    @property
    def words(self) -> int:
        return len(self.counts)

    @property
    def ranges(self) -> int:
        return len(self.cuts) - 1

    @property
    def output(self) -> np.ndarray:
        """Output of the first level for each code."""
        return np.r_[np.repeat(np.arange(self.ranges), np.diff(self.cuts)), self.ranges + np.arange(CLASSES)]

    @property
    def first(self) -> np.ndarray:
        """Smoothed counts of the outputs of the first level."""
        own = np.add.reduceat(self.counts, self.cuts[:-1]) if self.words else np.zeros(0)
        return np.r_[own, self.mass]

    @property
    def class_log(self) -> np.ndarray:
        return np.log10(self.mass / self.total)

    def shapes(self) -> list[int]:
        """Rows of inputs (one more for "before the text"), first outputs, word outputs, context weights."""
        return [self.words + CLASSES + 1, self.ranges + CLASSES, self.words, CONTEXT]

    def initial(self) -> list[np.ndarray]:
        """The four parts, each row with a bias behind its vector (0 where there is none)."""
        parts = [np.zeros((n, SIZE + 1), np.float32) for n in self.shapes()]
        parts[0][:, :SIZE] = np.random.default_rng(7).normal(0, 0.5, (len(parts[0]), SIZE))
        first = self.first
        parts[1][:, SIZE] = np.log(first / self.total)
        parts[2][:, SIZE] = np.log(self.counts / np.repeat(first[: self.ranges], np.diff(self.cuts)))
        parts[3][:, :SIZE] = 1 / CONTEXT
        return parts

    def contexts(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The codes before each token of the same document, nearest first."""
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(codes))
        return np.stack([np.where(at - k >= first, codes[np.maximum(at - k, 0)], self.words + CLASSES) for k in range(1, CONTEXT + 1)], 1)


def build(counts: DataFrame, top: pa.Table, total: float, most: int) -> Model:
    """A model whose vocabulary is the ``most`` words of ``top`` with the largest training counts."""
    names, trained = top.column("token").combine_chunks(), top.column("n_train").to_numpy().astype(np.int64)
    order = np.lexsort((np.arange(len(names)), -trained))
    words = min(most, int((trained > 0).sum()))
    classes = np.array(top.column("class").to_pylist(), np.int64)
    code = words + classes
    code[order[:words]] = np.arange(words)
    mass = np.full(CLASSES, 0.5)
    for c, n in counts.where("n_train > 0").groupBy("class").agg(F.sum(F.col("n_train") + 0.5)).collect():
        mass[c] += n
    np.subtract.at(mass, classes[order[:words]], trained[order[:words]] + 0.5)
    own = trained[order[:words]] + 0.5
    steps = np.cumsum(np.sqrt(own))
    ranges = math.ceil(RANGES * math.sqrt(words))
    at = np.minimum((steps - np.sqrt(own) / 2) / (steps[-1] if words else 1) * ranges, ranges - 1).astype(np.int64)
    cuts = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if words else np.zeros(0, np.int64), words].astype(np.int64)
    return Model(names, code, np.log10((trained + 0.5) / total), trained > 0,
                 own, np.maximum(mass, 0.5), cuts, total)


def encode(model: Model, rows: DataFrame) -> DataFrame:
    """Every document as codes, with its words outside the head, as often as they occur, for the join with all counts."""

    end = pa.array([END], pa.binary())

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        turn, size = [], 0
        for part in split(batches):
            turn.append(part)
            size += pc.sum(pc.binary_length(part[0].column("text"))).as_py() or 0
            if size > TURN:
                yield turn
                turn, size = [], 0
        if turn:
            yield turn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, classes = TaskContext.get().partitionId() << 36, Classes()
        # The last entry is for words outside the head, whose place is -1.
        code, known, log_p = np.r_[model.code, 0], np.r_[model.known, False].astype(np.int64), np.r_[model.log_p, 0]
        class_p = np.where(code >= model.words, log_p, 0)
        for turn in turns(batches):
            # Arrow indexes the head for each call, so distinct words of several slices are looked up together.
            kinds = [pa.concat_arrays([found.dictionary, end]) for _, _, found in turn]
            places = pc.fill_null(pc.index_in(pa.chunked_array(kinds), value_set=model.names), -1).to_numpy()
            for (piece, sizes, found), words in zip(turn, kinds):
                own, places = places[: len(words)], places[len(words) :]
                bounds = np.r_[0, np.cumsum(sizes + 1)]
                is_end = np.zeros(bounds[-1], bool)
                is_end[bounds[1:] - 1] = True
                at = np.full(len(is_end), len(words) - 1, np.int32)
                at[~is_end] = found.indices.to_numpy()
                place = own.take(at)
                outside = np.flatnonzero(place < 0)
                tail = words.take(pa.array(at[outside]))
                pairs = pc.binary_slice(tail, -2).dictionary_encode()
                codes = code.take(place, mode="wrap").astype("<i4")
                codes[outside] = model.words + np.array([classes[e] for e in pairs.dictionary.to_pylist()], np.int64).take(pairs.indices.to_numpy())
                yield table(
                    CODED, number + np.arange(len(sizes)), piece.column("doc_id"), piece.column("held_out"), sizes + 1,
                    *(np.add.reduceat(x.take(place, mode="wrap"), bounds[:-1]) for x in (known, log_p, class_p)),
                    pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(codes)]),
                    pa.ListArray.from_arrays(np.searchsorted(outside, bounds).astype(np.int32), tail))
                number += len(sizes)

    return stored(rows.mapInArrow(
        run, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_base double, "
             "class_base double, codes binary, tail array<binary>"), "lm-codes")


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(docs), "<i4").astype(np.int64), np.array([len(d) // 4 for d in docs], np.int64)


def chance(scores: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(scores)), in place."""
    with np.errstate(over="ignore"):  # 1 / infinity is 0
        np.exp(scores, out=scores)
    scores += 1
    return np.reciprocal(scores, out=scores)


def put(array: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``array[rows] = values``, with each row moved as one item."""
    row = np.dtype((np.void, array.itemsize * array.shape[1]))
    array.view(row)[:, 0][rows] = values.view(row)[:, 0]


def added(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of ``at``, the sum of the rows of ``values`` at each, and how many rows these are."""
    keys = at.astype(np.int64) << 32
    keys |= np.arange(len(at))
    keys.sort()  # plain numbers sort faster than an index of them
    order, at = keys & 0xFFFFFFFF, keys >> 32
    new = np.r_[True, at[1:] != at[:-1]]
    first, later = np.flatnonzero(new), np.flatnonzero(~new)
    total, times = values.take(order.take(first), 0), np.diff(np.r_[first, len(at)])
    if len(later):
        many = np.flatnonzero(times > 1)
        starts, rest = np.cumsum(times[many] - 1) - (times[many] - 1), np.empty((len(many), values.shape[1]), values.dtype)
        values, even = values.take(order.take(later), 0), values.shape[1] // 2 * 2
        # Two columns at once, as the parts of complex numbers.
        np.add.reduceat(values[:, :even].view("c8"), starts, axis=0, out=rest[:, :even].view("c8"))
        if even < values.shape[1]:
            np.add.reduceat(values[:, even], starts, out=rest[:, even])
        put(total, many, total.take(many, 0) + rest)
    return at.take(first), total, times


class Trainer:
    """One block: noise-contrastive steps on both levels with AdaGrad."""

    def __init__(self, model: Model):
        self.model, self.params = model, model.initial()
        # Words are moved by sums over the rows of a step that hold them, the small parts by means.
        self.squares = [np.full(p.shape, start, np.float32) for p, start in zip(self.params, (1, 1e-6, 1, 1e-6))]
        self.moved = [np.zeros(len(p)) for p in self.params]
        self.rng, self.steps = np.random.default_rng(11), 0
        self.output = model.output
        self.noise_p = model.first / model.first.sum()
        self.log_noise = np.log(NOISE * self.noise_p).astype(np.float32)
        # Counts inside a range are alike, so its noise is uniform.
        self.width = np.diff(model.cuts).astype(np.int32)
        self.start = model.cuts[:-1].astype(np.int32)
        self.log_own = np.log(OWN_NOISE / self.width).astype(np.float32)
        self.alone = np.r_[np.diff(model.cuts) == 1, np.ones(CLASSES, bool)]

    def move(self, k: int, at: np.ndarray, gradient: np.ndarray) -> None:
        """AdaGrad on the rows ``at`` of part k; repeated rows are added up first."""
        rows, total, times = added(at, gradient)
        squares = self.squares[k].take(rows, 0) + total * total
        put(self.squares[k], rows, squares)
        total *= WORD_RATE
        total /= np.sqrt(squares, out=squares)
        total += self.params[k].take(rows, 0)
        put(self.params[k], rows, total)
        self.moved[k][rows] += times

    def move_all(self, k: int, gradient: np.ndarray, tokens: int) -> None:
        self.squares[k] += gradient * gradient
        self.params[k] += RATE * gradient / np.sqrt(self.squares[k])
        self.moved[k] += tokens

    def learn(self, docs: list[bytes]) -> None:
        """Steps of consecutive tokens: a word is looked up and moved once for all contexts it is in."""
        codes, sizes = joined(docs)
        edge = len(self.params[0]) - 1
        before = np.r_[np.full(CONTEXT, edge), codes].astype(np.int32)
        place, at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), 0
        while at < len(codes):
            end = min(at + STEPS[self.steps >= WARM], len(codes))
            self.step(before[at : end + CONTEXT], place[at:end])
            at, self.steps = end, self.steps + 1

    def step(self, codes: np.ndarray, place: np.ndarray) -> None:
        """``codes`` of the tokens and of those before the first, ``place`` of each in its document."""
        inputs, outs, words, mix = self.params
        n, code = len(place), codes[CONTEXT:]
        target, looked = self.output.take(code), inputs.take(codes, 0)
        vectors, starts = [], []
        for k in range(1, CONTEXT + 1):
            early = np.flatnonzero(place < k)
            vector = looked[CONTEXT - k : CONTEXT - k + n]
            if len(early):
                vector = vector.copy()
                vector[early] = inputs[-1]
            vectors.append(vector)
            starts.append(early)
        q = sum(v * w for v, w in zip(vectors, mix))
        q[:, SIZE] = 1  # what the bias is multiplied by
        # First level: data above, shared noise below; errors are label less probability.
        noise = self.rng.choice(len(outs), NOISE, p=self.noise_p)
        wanted, other = outs.take(target, 0), outs[noise]
        up = chance(np.einsum("ij,ij->i", q, wanted) - self.log_noise[target])
        shifted = -other
        shifted[:, SIZE] += self.log_noise[noise]
        down = chance(q @ shifted.T)
        wanted *= up[:, None]
        dq = np.subtract(wanted, down @ other, out=wanted)
        g_outs = np.stack([np.bincount(target, c, len(outs)) for c in (up * q.T)], 1).astype(np.float32)
        for row, gradient in zip(noise.tolist(), down.T @ q):
            g_outs[row] -= gradient
        # Second level: noise words of the same range.
        inner = np.flatnonzero(~self.alone[target])
        if len(inner):
            own, at = code[inner], target[inner]
            drawn = self.start.take(at) + self.rng.integers(0, self.width.take(at), (OWN_NOISE, len(inner)), np.int32)
            chosen = np.concatenate([own, *drawn])
            q_own, vector = q.take(inner, 0), words.take(chosen, 0).reshape(1 + OWN_NOISE, len(inner), -1)
            error = np.einsum("ij,kij->ki", q_own, vector) - self.log_own.take(at)
            error[1:] *= -1
            error = chance(error)
            error[1:] *= -1
            put(dq, inner, dq.take(inner, 0) + np.einsum("ki,kij->ij", error, vector))
            self.move(2, chosen, (error[:, :, None] * q_own).reshape(len(chosen), -1))
        dq[:, SIZE] = 0
        self.move_all(3, np.stack([np.einsum("ij,ij->j", v, dq) / n for v in vectors]), n)
        g_in = np.zeros((len(codes) + 1, SIZE + 1), np.float32)  # the last for "before the text"
        for k, early in enumerate(starts, 1):
            part = dq * mix[k - 1]
            g_in[-1] += part[early].sum(0)
            part[early] = 0
            g_in[CONTEXT - k : CONTEXT - k + n] += part
        self.move(0, np.r_[codes, np.int32(len(inputs) - 1)], g_in)
        self.move_all(1, g_outs / n, n)


def averaged(model: Model, coded: DataFrame, tokens: int, block: int) -> list[np.ndarray]:
    """Parameters trained on all rows of ``coded``: each block alone, every row averaged by its moves."""
    blocks = max(1, -(-tokens // block))
    names = [f"v{i}" for i in range(SIZE + 1)]
    schema = pa.schema([("at", pa.int32()), ("weight", pa.float64()), *((n, pa.float32()) for n in names)])
    offsets = np.cumsum([0] + model.shapes())

    def rows(trainer: Trainer) -> pa.RecordBatch:
        weight = np.concatenate(trainer.moved)
        at = np.flatnonzero(weight)
        values = np.concatenate(trainer.params)[at]
        return table(schema, at, weight[at], *np.ascontiguousarray(values.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trainer, docs, size = None, None, [], 0
        for batch in batches:
            for number, codes in zip(batch.column("block").to_pylist(), batch.column("codes").to_pylist()):
                if docs and (number != now or size >= PIECE):
                    trainer.learn(docs)
                    docs, size = [], 0
                if number != now:
                    if trainer:
                        yield rows(trainer)
                    now, trainer = number, Trainer(model)
                docs.append(codes)
                size += len(codes) // 4
        if trainer:
            trainer.learn(docs)
            yield rows(trainer)

    # Repeated rows are equal, so their order does not matter; copies under other ids are dealt apart.
    dealt = coded.select("codes", F.xxhash64("doc_id", "codes").alias("key")).withColumn("block", F.pmod("key", F.lit(blocks)))
    sums = dealt.repartition("block").sortWithinPartitions("block", "key", "codes").select("block", "codes").mapInArrow(
        run, "at int, weight double, " + ", ".join(f"{n} float" for n in names)).groupBy("at").agg(
        *((F.sum(F.col(n).cast("double") * F.col("weight")) / F.sum("weight")).cast("float").alias(n) for n in names)).toArrow()
    flat = np.concatenate(model.initial())
    if sums.num_rows:
        flat[sums.column("at").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], 1)
    return np.split(flat, offsets[1:-1])


def own_logs(q: np.ndarray, outs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the softmax over ``outs`` at each target, in pieces that fit into a core's cache."""
    found, step = np.empty(len(q)), max(1, SCORES // max(len(outs), 1))
    weights, ones = np.ascontiguousarray(outs.T), np.ones(len(outs), np.float32)
    room, begin = np.empty((min(step, len(q)), len(outs)), np.float32), np.arange(0, step * len(outs), len(outs))
    # No score is larger than the product of both lengths.  Only where that is large, the largest of a row is taken off.
    length = np.sqrt(np.einsum("ij,ij->i", q, q)) * math.sqrt(np.einsum("ij,ij->i", outs, outs).max())
    most = SAFE - math.log(len(outs))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        scores = np.matmul(part, weights, out=room[: len(part)])
        if not length[i : i + step].max() < most:
            scores -= scores.max(1, keepdims=True)
        own = scores.ravel().take(begin[: len(part)] + target[i : i + step])
        np.exp(scores, out=scores)
        found[i : i + step] = own - np.log(scores @ ones)
    return found


def log_probability(model: Model, codes: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log10 of the normalised probability of each code after its context."""
    inputs, outs, words, mix = model.params
    q = sum((inputs * w).take(c, 0) for w, c in zip(mix, context.T))
    q[:, SIZE] = 1  # what the bias is multiplied by
    target = model.output[codes]
    found = own_logs(q, outs, target)
    # Small numbers are sorted by their digits.
    order = np.argsort(target.astype(np.uint16) if model.ranges + CLASSES <= 1 << 16 else target, kind="stable")
    ends = np.searchsorted(target[order], np.arange(model.ranges + 1))
    for k in np.flatnonzero((np.diff(model.cuts) > 1) & (np.diff(ends) > 0)):
        at, low = order[ends[k] : ends[k + 1]], model.cuts[k]
        found[at] += own_logs(q.take(at, 0), words[low : model.cuts[k + 1]], codes[at] - low)
    return found / np.log(10)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1,
              head: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``head`` is the most words of the vocabulary; without it, it grows with the square root of
    the distinct training words.  Null texts are empty: one end token.  Repeated rows get
    equal rows and are counted as often as they occur.  If nothing is left to train on, all
    base probabilities are equal.  An empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (fold(id_col, folds) == held).alias("held_out"))
    counts = stored(count_tokens(rows), "lm-counts")
    total, distinct = counts.agg(
        F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.when(F.col("n_train") > 0, 1))).first()
    below = total + 0.5 * (distinct + 1)
    most = math.ceil(GROWTH * math.sqrt(distinct)) if head is None else head
    model = build(counts, head_words(counts, KNOWN * most), below, most)
    coded = encode(model, rows)
    model.names = None  # words are codes from here on
    model.params = averaged(model, coded.where(~F.col("held_out")), int(total), block)
    class_log = model.class_log

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "codes"):
            codes, sizes = joined(piece.column("codes").to_pylist())
            part = log_probability(model, codes, model.contexts(codes, sizes))
            # A token of a class: its share of the class.  The base part of tail words is joined later.
            of_class = codes >= model.words
            part[of_class] -= class_log[codes[of_class] - model.words]
            part = np.add.reduceat(part, np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), pa.array(part)], [*names, "part"])

    names = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "class_base"]
    scored = coded.select(*names, "codes").mapInArrow(
        run, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_base double, "
             "class_base double, part double")
    words = coded.select("row", F.explode("tail").alias("token"))
    log_p = F.log10((F.col("n_train") + 0.5) / F.lit(below))
    tails = words.join(counts.select("token", "n_train"), "token").groupBy("row").agg(
        F.sum(log_p).alias("tail_base"), F.count(F.when(F.col("n_train") > 0, 1)).alias("tail_known"))
    none = F.lit(0)
    return scored.join(tails, "row", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", none)).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", none)).alias("base_score"),
        (F.col("part") + F.col("class_base") + F.coalesce("tail_base", none)).alias("score"))


QUERIES = {"op3_lm_score": lambda s, d: lm_scores(documents(s, d))}
ORACLE: dict[str, str] = {}
