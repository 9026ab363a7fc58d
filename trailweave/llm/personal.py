"""Personal data: fixed patterns, and a linear-chain conditional random field.

The field labels white-space separated tokens as nothing, e-mail, address, card or phone
from word-shape features and a few cue words.  It is trained on a small labelled table of
invented sentences (``labelled_table``), with spaced, worded and masked forms that the
patterns do not know and with numbers that are no personal data, and on a bounded number
of stretches of the corpus chosen by hash (``quota`` of each kind).  It is decoded with
Viterbi in numpy batches.  A token whose features favour "nothing" by more than
transitions can ever win back is "nothing" on every best path, so texts are cut there and
the short rests are decoded side by side; the result is that of the whole text.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import documents, lower_words, pieces, table, texts

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a run of digits is tried once, from its start
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Documents of the sample, stretches of each kind taken from it, and sentences of the labelled table.
SAMPLE, QUOTA, SENTENCES = 4000, 150, 1000


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail matches, found from the ``@`` signs.

    Each match holds one sign: it starts where the run of local characters before the
    sign starts (or the last match ended) and ends where the longest domain ends.
    """
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def find_personal(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; failing matches are dropped, not retried."""
    found = [("email", *s) for s in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# --- word shapes -----------------------------------------------------------------

#: Character classes: space, lower, upper, digit, @, dot, dash, plus, bracket, percent or underscore, other.
CLASS_COUNT = 11
#: Values of each feature.
SIZES = (4, 4, 9, 4, 6, 4, 3, 3, 3, 3, 6, 9)
STARTS = np.cumsum((0, *SIZES[:-1]))
WIDTH = sum(SIZES)
#: Place values that turn the features of a token into one number.
RADIX = np.cumprod((1, *SIZES[:-1]))
_CLASSES: list[np.ndarray] = []
#: Cue words by value, with the marks that may stand around them; the last value is a masked sign inside a token.
CUES = {
    1: "at @", 2: "dot . point", 3: "mail email e-mail contact write", 4: "phone call tel telephone mobile cell fax ring",
    5: "card visa mastercard amex credit debit", 6: "ip address host server addr",
    7: "order invoice isbn version page id no number serial item ref tracking total date year",
}
INSIDE = 8
SIGNS = re.compile(rb"[(\[{<](?:at|dot|\.|@)[)\]}>]")
CUE = {mark[0] + word + mark[1]: value for value, words in CUES.items() for word in words.encode().split()
       for mark in ((b"", b""), (b"", b":"), (b"", b","), (b"", b"."), (b"(", b")"), (b"[", b"]"), (b"{", b"}"), (b"<", b">"))}
CUE |= {b".": 2, b"@": 1}


def cues(text: str) -> list[int]:
    """The cue value of every token."""
    words = lower_words(text)
    found = [CUE.get(w, 0) for w in words]
    if any(sign in text for sign in "([{<") and SIGNS.search(text.encode("utf-8", "surrogatepass").lower()):
        found = [c or (INSIDE if SIGNS.search(w) else 0) for c, w in zip(found, words)]
    return found


def classes() -> np.ndarray:
    if not _CLASSES:
        lut = np.full(1 << 16, 10, np.uint8)
        for code in range(1 << 16):
            char = chr(code)
            lut[code] = 1 if char.islower() else 2 if char.isupper() else 3 if "0" <= char <= "9" else 10
        for chars, value in ((" \t\n\v\f\r", 0), ("@", 4), (".", 5), ("-", 6), ("+", 7), ("()", 8), ("%_", 9)):
            lut[[ord(c) for c in chars]] = value
        _CLASSES.append(lut)
    return _CLASSES[0]


@dataclass
class Tokens:
    """Tokens of some texts: text number, start and end in it, and feature values."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    feature: np.ndarray  # tokens x features, index into the weights
    first: np.ndarray  # whether a token is the first of its text


def shapes(docs: list[str]) -> Tokens:
    codes = np.frombuffer("\n".join([*docs, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = classes()[np.minimum(codes, (1 << 16) - 1)]
    ink = np.r_[False, kinds != 0, False]
    start, end = np.flatnonzero(ink[1:] & ~ink[:-1]), np.flatnonzero(ink[:-1] & ~ink[1:])
    offsets = np.cumsum([0] + [len(t) + 1 for t in docs[:-1]]) if docs else np.zeros(1, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    size = end - start
    count = np.zeros((CLASS_COUNT, len(start)), np.int64)
    for kind in range(1, CLASS_COUNT):
        at = np.flatnonzero(kinds == kind) if kind not in (1,) else None
        if at is not None and len(at):
            count[kind] = np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(start))
    count[1] = size - count[2:].sum(0)
    head = kinds[start] if len(start) else np.zeros(0, np.uint8)
    some = lambda x, top: np.minimum(x, top - 1)
    digits = np.searchsorted([1, 2, 4, 7, 9, 12, 13, 20], count[3], "right")
    order = {1: 0, 2: 1, 3: 2}
    outer = lambda k: np.select([k == c for c in order], list(order.values()), 3)
    cue = np.fromiter((c for t in docs for c in cues(t)), np.int64, len(start))
    values = [some(count[1], 4), some(count[2], 4), digits, some(count[4], 4), some(count[5], 6), some(count[6], 4),
              some(count[7], 3), some(count[8], 3), some(count[9], 3), some(count[10], 3),
              outer(head) + 2 * (head == 7), cue]
    feature = np.stack(values, 1) + STARTS if len(start) else np.zeros((0, len(SIZES)), np.int64)
    first = np.r_[True, doc[1:] != doc[:-1]] if len(start) else np.zeros(0, bool)
    return Tokens(doc, start - offsets[doc] if len(start) else start, end - offsets[doc] if len(start) else end, feature, first)


@dataclass
class Field:
    """Weights: emission (previous, own and next token) and transition, labels 0 = nothing."""

    emit: np.ndarray  # 3 x WIDTH x labels
    move: np.ndarray  # labels x labels

    def emissions(self, tokens: Tokens) -> np.ndarray:
        # Few different shapes occur, so weights are added once per shape.
        code = (tokens.feature - STARTS) @ RADIX
        shape, place = np.unique(code, return_inverse=True)
        example = np.zeros(len(shape), np.int64)
        example[place] = np.arange(len(place))
        sums = self.emit[:, tokens.feature[example]].sum(2)
        own = sums[1][place]
        if len(own) > 1:
            same = ~tokens.first[1:, None]
            own[1:] += np.where(same, sums[0][place[:-1]], 0)
            own[:-1] += np.where(same, sums[2][place[1:]], 0)
        return own

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best label of every token."""
        scores = self.emissions(tokens)
        labels = np.zeros(len(scores), np.int64)
        if not len(scores):
            return labels
        # What replacing label 0 between any neighbours can win at most (also at an edge).
        m = self.move
        both = max((m[:, k][:, None] + m[k][None, :] - m[:, 0][:, None] - m[0][None, :]).max() for k in range(len(m)))
        edge = max((m[:, k] - m[:, 0]).max() for k in range(len(m))), max((m[k] - m[0]).max() for k in range(len(m)))
        safe = scores[:, 0] - scores[:, 1:].max(1) > max(both, *edge, 0)
        open_ = np.flatnonzero(~safe)
        if not len(open_):
            return labels
        # Pieces: open tokens in a row, with a safe token (label 0) on either side inside the text.
        new = np.r_[True, (np.diff(open_) > 1) | tokens.first[open_[1:]]]
        firsts = open_[new]
        lasts = open_[np.r_[np.flatnonzero(new)[1:], len(open_)] - 1]
        size = lasts - firsts + 1
        left = ~tokens.first[firsts]
        right = (lasts + 1 < len(scores)) & ~np.r_[tokens.first[1:], True][lasts]
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            best = scores[firsts[at]] + np.where(left[at][:, None], m[0], 0)
            back = []
            for k in range(1, length):
                paths = best[:, :, None] + m
                back.append(paths.argmax(1))
                best = paths.max(1) + scores[firsts[at] + k]
            best = best + np.where(right[at][:, None], m[:, 0], 0)
            label = best.argmax(1)
            labels[lasts[at]] = label
            for k in range(length - 1, 0, -1):
                label = back[k - 1][np.arange(len(at)), label]
                labels[firsts[at] + k - 1] = label
        return labels


def gold(docs: list[str], tokens: Tokens, spans: list[list[tuple[str, int, int]]] | None = None) -> np.ndarray:
    """Labels of tokens from spans (of the patterns if none are given): a token is of the kind that covers most of it."""
    labels = np.zeros(len(tokens.doc), np.int64)
    bounds = np.searchsorted(tokens.doc, np.arange(len(docs) + 1))
    for number, text in enumerate(docs):
        low, high = bounds[number], bounds[number + 1]
        for kind, start, end in find_personal(text) if spans is None else spans[number]:
            inside = np.minimum(tokens.end[low:high], end) - np.maximum(tokens.start[low:high], start)
            labels[low:high][2 * inside > tokens.end[low:high] - tokens.start[low:high]] = KINDS.index(kind) + 1
    return labels


@dataclass
class Stretch:
    """Some neighbouring tokens of a text: weight indices, labels, and where they are."""

    index: np.ndarray
    labels: np.ndarray
    doc: int
    place: int
    clear: bool  # nothing outside the labels looks like a form that the labels may have missed


def windows(docs: list[str], spans: list[list[tuple[str, int, int]]] | None = None, most: int = 24) -> Iterator[Stretch]:
    """The stretches of ``most`` tokens of some texts; features of neighbours look over the edge."""
    tokens = shapes(docs)
    labels = gold(docs, tokens, spans)
    # One more weight, fixed at 0, stands for the missing neighbour.
    before = np.full_like(tokens.feature, 3 * WIDTH)
    after = np.full_like(tokens.feature, 3 * WIDTH)
    if len(labels) > 1:
        same = ~tokens.first[1:, None]
        before[1:] = np.where(same, tokens.feature[:-1], 3 * WIDTH)
        after[:-1] = np.where(same, tokens.feature[1:] + 2 * WIDTH, 3 * WIDTH)
    index = np.concatenate([before, tokens.feature + WIDTH, after], axis=1)
    value = tokens.feature - STARTS
    other = labels == 0
    number, sign = other & (value[:, 2] > 0), other & ((value[:, 3] > 0) | np.isin(value[:, -1], (1, 2, INSIDE)))
    many = other & (value[:, 2] >= 4)  # seven digits or more
    starts = np.flatnonzero(tokens.first)
    for low, high in zip(starts, np.r_[starts[1:], len(labels)]):
        for at in range(low, high, most):
            to = min(at + most, high)
            clear = not (many[at:to].any() or sign[at:to].any()) and number[at:to].sum() < 3
            yield Stretch(index[at:to].astype(np.int32), labels[at:to].copy(), int(tokens.doc[at]), int(at - low), bool(clear))


def labelled_table(rows: int = SENTENCES, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented sentences with the spans of personal data in them, the same at every call."""
    rng = random.Random(seed)
    syllables = "ba do ke li mu na po ri sa te vo zu chi gra shel ton".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    end = lambda: rng.choice("com org net de uk io edu".split())

    def email() -> str:
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"),
                              (" AT ", " DOT "), (" @ ", " . "), (" @ ", "."), (" at ", "."), ("[at]", "."), ("@", ".")])
        name = word() + (rng.choice([".", "_", digits(2), dot]) + word() if rng.random() < 0.4 else "")
        return name + at + word() + (dot + word() if rng.random() < 0.2 else "") + dot + end()

    def ip() -> str:
        return rng.choice([".", ".", " . ", "[.]", "(.)", " dot ", " [.] ", " point "]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice(["", " ", "-", ".", "_", " - ", "/", " . "]).join(number[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}", f"00{digits(2)} {a} {b}{c}", f"{a} {b} {c}",
                           f"+{digits(2)} {a} {b}{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)}/{a}/{b}{c}", f"0{a}/{b}{c}", f"1-{a}-{b}-{c}"])

    def nothing() -> str:
        year, month, day = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)
        return rng.choice([
            lambda: f"{year}-{month:02}-{day:02}", lambda: f"{day}.{month}.{year}", lambda: f"{day:02}/{month:02}/{year}",
            lambda: f"{month:02}:{day:02}:{rng.randint(0, 59):02}", lambda: f"v{month}.{day}.{rng.randint(0, 9)}", lambda: f"{month}.{digits(6)}",
            lambda: f"${month},{digits(3)}.{digits(2)}", lambda: f"{year}-{year + 5}", lambda: f"{month},{digits(3)},{digits(3)}",
            lambda: f"order {digits(rng.randint(6, 14))}", lambda: f"id {digits(12)}", lambda: f"isbn 978-{day}-{digits(2)}-{digits(6)}-{day % 10}",
            lambda: f"section {month}.{day}.{month}", lambda: f"{day} - {month}", lambda: f"at {word()} {word()}", lambda: f"{word()} at {day}",
            lambda: f"at {word()}.", lambda: f"{word()} dot {word()}", lambda: f"call {word()} at {month} pm", lambda: f"({year})",
            lambda: f"{month} {day} {year} {day}", lambda: f"{day} {day + 1} {day + 2} {day + 3} {day + 4}", lambda: f"number {digits(8)}",
            lambda: f"{day}.{digits(4)}, -{month}.{digits(4)}", lambda: f"page {digits(3)} . {word()}", lambda: f"@{word()}",
            lambda: f"{word()}.{word()}", lambda: f"{year} {digits(4)} {digits(4)}", lambda: f"{digits(3)}-{digits(2)}"])()

    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    lead = {"email": ["mail", "contact", "write to", "e-mail:"], "ip": ["ip", "host", "server", "address"], "card": ["card", "visa", "credit card"],
            "phone": ["call", "tel:", "phone", "mobile", "fax"]}
    out = []
    for i in range(rows):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 7))), []
        for _ in range(rng.randint(1, 2)):
            kind = rng.choice([*KINDS, *KINDS, None, None, None, None, None])
            if kind and rng.random() < 0.6:
                text += " " + rng.choice(lead[kind])
            text += " " if text else ""
            start, text = len(text), text + (made[kind]() if kind else nothing())
            if kind:
                spans.append((kind, start, len(text)))
            text += rng.choice(["", "", ".", ",", ")"]) + " " + " ".join(word() for _ in range(rng.randint(1, 6)))
        out.append((text, spans))
    return out


def fit(docs: list[str], spans: list[list[tuple[str, int, int]]] | None = None, more: list[tuple[np.ndarray, np.ndarray]] | None = None,
        rounds: int = 120, rate: float = 0.4, ridge: float = 1e-5) -> Field:
    """Maximum likelihood by full-batch AdaGrad over the stretches of labelled texts (labels of
    the patterns where no spans are given) and ``more`` ones; forward-backward runs over all at once."""
    n = len(KINDS) + 1
    rows = [(x.index, x.labels) for i in range(0, len(docs), 200)
            for x in windows(docs[i : i + 200], spans and spans[i : i + 200])] + (more or [])
    field = Field(np.zeros((3, WIDTH, n)), np.zeros((n, n)))
    if not rows:
        return field
    length = np.array([len(y) for _, y in rows])
    steps = int(length.max())
    valid = np.arange(steps) < length[:, None]
    flat, truth = np.concatenate([x for x, _ in rows]), np.zeros(valid.shape, np.int64)
    truth[valid] = np.concatenate([y for _, y in rows])
    pairs, onehot = valid[:, 1:], np.eye(n)[truth[valid]]
    seen = np.zeros((n, n))
    np.add.at(seen, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
    emit = np.zeros((3 * WIDTH + 1, n))
    squares = [np.full(emit.shape, 1e-8), np.full(field.move.shape, 1e-8)]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        score = np.zeros((*valid.shape, n))
        score[valid] = emit[flat].sum(1)
        forward, backward = score.copy(), np.zeros(score.shape)
        for k in range(1, steps):
            step = log_sum(forward[:, k - 1][:, :, None] + field.move, 1) + score[:, k]
            forward[:, k] = np.where(valid[:, k][:, None], step, forward[:, k - 1])
        for k in range(steps - 2, -1, -1):
            step = log_sum(field.move + (score[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(valid[:, k + 1][:, None], step, 0)
        total = log_sum(forward[:, -1], 1)[:, None, None]
        error = onehot - np.exp(forward + backward - total)[valid]
        joint = np.exp(forward[:, :-1][:, :, :, None] + field.move + (score + backward)[:, 1:][:, :, None, :]
                       - total[..., None])[pairs].sum(0)
        g_emit = np.stack([np.bincount(flat.ravel(), np.repeat(e, flat.shape[1]), 3 * WIDTH + 1) for e in error.T], 1)
        g_emit[-1] = 0
        for weights, gradient, square in ((emit, g_emit, squares[0]), (field.move, seen - joint, squares[1])):
            gradient = gradient / len(rows) - ridge * weights
            square += gradient * gradient
            weights += rate * gradient / np.sqrt(square)
    field.emit = emit[:-1].reshape(3, WIDTH, n)
    return field


def corpus_stretches(docs: DataFrame, id_col: str, text_col: str, sample: int, quota: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every kind, and for nothing, the ``quota`` stretches with the smallest hash of (id, place)
    in about ``sample`` documents, with the labels of the patterns.  Stretches with other
    numbers or signs are left out: the patterns cannot tell what they are."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = max(rows.count(), 1)
    hashed = F.pmod(F.xxhash64(F.lit("personal"), "id"), F.lit(1 << 30))
    schema = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("labels", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for piece in pieces(batches, "text"):
            ids, own = piece.column("id").to_pylist(), texts(piece)
            for x in windows(own):
                if x.clear:
                    rank = zlib.crc32(f"{ids[x.doc]}:{x.place}".encode())
                    kept.setdefault(int(x.labels.max()), []).append((rank, x.labels.tolist(), x.index))
            for kind, found in kept.items():
                found.sort(key=lambda f: f[:2])
                del found[quota:]
        for kind, found in kept.items():
            yield table(schema, [kind] * len(found), *zip(*((rank, labels, index.ravel().tolist()) for rank, labels, index in found)))

    found = rows.where(hashed < F.lit(float(sample << 30) / total)).mapInArrow(
        run, "kind int, place bigint, labels array<int>, features array<int>")
    first = Window.partitionBy("kind").orderBy("place", "labels", "features")
    found = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= quota).orderBy("kind", "_r").toArrow()  # five quotas
    return [(np.array(f, np.int32).reshape(len(y), -1), np.array(y, np.int64))
            for y, f in zip(found.column("labels").to_pylist(), found.column("features").to_pylist())]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, quota: int = QUOTA,
          rows: list[tuple[str, list[tuple[str, int, int]]]] | None = None) -> Field:
    """Fit the field on a labelled table (``labelled_table`` if none is given) and on stretches of ``docs``."""
    rows = labelled_table() if rows is None else rows
    return fit([t for t, _ in rows], [s for _, s in rows], corpus_stretches(docs, id_col, text_col, sample, quota))


#: What a worded form has to hold at least: one sign, and a dot between the first two names behind it.
AT = re.compile(r"@|\bat\b", re.IGNORECASE)
DOT = re.compile(r"[\s\])}>]*[\w-]+(?:\.|\s\.\s|[\[({<]\.[\])}>]|[\s\[({<]+(?:dot|point)[\s\])}>]+)\w", re.IGNORECASE)
NUMBER = re.compile("[0-9]+")


def added(text: str, base: list[tuple[str, int, int]], tokens: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the field that no pattern span touches: runs of one label, without marks at the ends."""
    out, k = [], 0
    while k < len(tokens):
        start, end, label = tokens[k]
        k += 1
        while k < len(tokens) and tokens[k][2] == label and text[end : tokens[k][0]] == " ":
            end, k = tokens[k][1], k + 1
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        found = text[start:end]
        digits = "".join(c for c in found if "0" <= c <= "9")
        groups = NUMBER.findall(found)
        whole = {
            1: len(sides := AT.split(found)) == 2 and bool(DOT.match(sides[1])),
            2: len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
            3: 13 <= len(digits) <= 19 and luhn(digits),
            4: 9 <= len(digits) <= 15,
        }[label]
        if whole and all(end <= s or start >= e for _, s, e in base):
            out.append((KINDS[label - 1], start, end))
    return out


def personal_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` of every whole text, lists as text (``kind:start:end,...``).

    ``base`` are the pattern spans, ``spans`` these and what the field adds, both by kind
    and start.  Null texts are empty; repeated rows get equal rows; an empty table gives an
    empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            docs = texts(piece)
            tokens = shapes(docs)
            labels = field.decode(tokens)
            marked: dict[int, list[tuple[int, int, int]]] = {}
            for i in np.flatnonzero(labels):
                marked.setdefault(int(tokens.doc[i]), []).append((int(tokens.start[i]), int(tokens.end[i]), int(labels[i])))
            base = [find_personal(t) for t in docs]
            spans = [sorted(b + added(t, b, marked.get(n, [])), key=lambda s: (KINDS.index(s[0]), s[1]))
                     for n, (t, b) in enumerate(zip(docs, base))]
            yield table(schema, piece.column("doc_id"), [listed(b) for b in base], [listed(s) for s in spans])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, base string, spans string")


def personal_digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("bigint")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def personal(docs: DataFrame, **options) -> DataFrame:
    return personal_spans(docs, train(docs, **options))


QUERIES = {"op7_personal_data": lambda s, d: personal_digest(personal(documents(s, d)))}
ORACLE: dict[str, str] = {}
