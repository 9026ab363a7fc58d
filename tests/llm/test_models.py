import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from trailweave.llm import perplexity, toxicity


def brute_base(rows, held):
    texts = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for i, t, _, _ in rows}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t) + ["\n"] for i, t in texts.items()}
    counts = Counter(w for i, *_ in rows if not held(i) for w in split[i])
    total, kinds = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), total,
                sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)) for i, ws in split.items()}


@pytest.mark.parametrize("head", [None, 50, 0])
def test_scores(make_docs, corpus, head):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = brute_base(corpus, held)
    got = perplexity.lm_scores(make_docs(corpus), head=head).collect()
    assert len(got) == len(corpus)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score < 0
    if head is None:  # the context tells the language, so held-out texts are likelier than under the base
        out = [r for r in got if r.held_out and r.n_tokens > 5]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def small_model(words=23, seed=1):
    """Random parameters over ranges of one and of several words."""
    counts = np.sort(np.random.default_rng(seed).integers(1, 90, words))[::-1] + 0.5
    cuts = np.array([0, 1, 2, 6, 13, words])
    model = perplexity.Model({}, np.zeros(0, int), np.zeros(0), np.zeros(0, bool), counts, np.full(perplexity.CLASSES, 2.0),
                             cuts, counts.sum() + 2 * perplexity.CLASSES)
    rng = np.random.default_rng(seed)
    model.params = [p + rng.normal(0, 1, p.shape).astype(np.float32) for p in model.initial()]
    return model


def test_probabilities_sum_to_one():
    model = small_model()
    codes = np.arange(model.words + perplexity.CLASSES)
    context = np.tile(np.random.default_rng(2).integers(0, len(codes), (1, perplexity.CONTEXT)), (len(codes), 1))
    logs = perplexity.log_probability(model, codes, context)
    assert (10**logs).sum() == pytest.approx(1, abs=1e-5)


def test_probability_of_a_document_against_loops():
    model = small_model(seed=5)
    inputs, outs, words, mix = (p.astype(float) for p in model.params)
    size, edge = perplexity.SIZE, model.words + perplexity.CLASSES
    codes = [3, 0, 22, 1, 25, 7, 7, 30, 12, 4]
    want = 0.0
    for i, code in enumerate(codes):
        before = [codes[i - k] if i >= k else edge for k in (1, 2, 3)]
        q = [sum(mix[j][d] * inputs[before[j]][d] for j in range(3)) for d in range(size)]
        score = lambda row: sum(x * y for x, y in zip(q, row)) + row[size]
        spots = [k for k in range(model.ranges) if model.cuts[k] <= code < model.cuts[k + 1]]
        at = spots[0] if spots else model.ranges + code - model.words
        want += score(outs[at]) - math.log(sum(math.exp(score(o)) for o in outs))
        if spots:
            own = words[model.cuts[at] : model.cuts[at + 1]]
            want += score(words[code]) - math.log(sum(math.exp(score(o)) for o in own))
    got = perplexity.log_probability(model, np.array(codes), model.contexts(np.array(codes), np.array([len(codes)])))
    assert got.sum() == pytest.approx(want / math.log(10), rel=1e-5)


def test_scores_do_not_depend_on_partitions(make_docs, corpus):
    """Several blocks, a copied text under many ids, repeated rows; one and sixteen partitions."""
    rows = corpus + [(1000 + i, corpus[3][1], "aa", "s1") for i in range(60)]
    docs = make_docs(rows)
    runs = [sorted((r.doc_id, r.score) for r in perplexity.lm_scores(docs.repartition(n), block=2000).collect()) for n in (1, 16)]
    assert [i for i, _ in runs[0]] == [i for i, _ in runs[1]]
    assert [x for _, x in runs[0]] == pytest.approx([x for _, x in runs[1]], rel=1e-6)


def test_vocabulary_grows_with_the_corpus(make_docs, spark):
    rng = random.Random(4)
    sizes = []
    for n in (40, 640):
        docs = make_docs([(i, " ".join(f"w{rng.randrange(n * 20)}" for _ in range(60)), "aa", "s") for i in range(n)])
        counts = perplexity.count_tokens(docs.selectExpr("text", "false as held_out"))
        most = math.ceil(perplexity.GROWTH * math.sqrt(counts.count()))
        sizes.append(perplexity.build(counts, perplexity.head_words(counts, 3 * most), 1.0, most).words)
    assert 0 < 2 * sizes[0] < sizes[1]


def test_counts_and_classes_of_words(spark, monkeypatch):
    """Words of both folds are counted together; a class is worked out once for each pair of bytes, in Spark as in Python."""
    worked = []
    monkeypatch.setattr(perplexity.zlib, "crc32", lambda end, crc=zlib.crc32: worked.append(end) or crc(end))
    classes = perplexity.Classes()
    assert [classes[w[-2:]] for w in [b"xy", b"axy", b"z", b"xy"]] == [zlib.crc32(e) % perplexity.CLASSES for e in (b"xy", b"xy", b"z", b"xy")]
    assert worked[:2] == [b"xy", b"z"] and len(classes) == 2
    rows = [("Ab ab\u00a0c z \u00c9\u00e9 " * 3, False), ("AB \u00c9\u00e9 new", True), (None, True), ("", False)]
    counts = perplexity.count_tokens(spark.createDataFrame(rows, "text string, held_out boolean").repartition(3)).collect()
    want = {"ab": (3, 4), "ab\u00a0c": (3, 3), "z": (3, 3), "\u00c9\u00e9": (3, 4), "new": (0, 1), "\n": (2, 4)}
    assert {bytes(r.token).decode(): (r.n_train, r.n_all) for r in counts} == want
    assert all(r["class"] == classes[bytes(r.token)[-2:]] for r in counts) and len(counts) == len(want)


def test_words_of_texts_against_a_pattern():
    """White space is six ASCII signs, only A-Z are lower-cased, and slices of a column are read as such."""
    texts = ["out", None, "", " \t\n", " Ab\x0b\x0cc  D\r\n", "\x1ca\x1fb\x85C\u00a0d\u2003e \u00c9Z", "\u212a \u0130x", "x"]
    words, sizes = perplexity.words_of(pa.array(texts).slice(1))
    want = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts[1:]]
    assert sizes.tolist() == [len(w) for w in want]
    assert [w.decode() for w in words.to_pylist()] == [w for ws in want for w in ws]


def test_distinct_words_are_looked_up_once_a_turn(monkeypatch):
    """Three slices, one lookup of their distinct words; codes and base sums as word by word."""
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    asked = []
    monkeypatch.setattr(perplexity, "stored", lambda run, name: run)
    monkeypatch.setattr(perplexity, "TEXTS", 30)
    monkeypatch.setattr(perplexity, "TaskContext", type("At", (), {"get": staticmethod(lambda: type("Part", (), {"partitionId": lambda self: 2})())}))
    monkeypatch.setattr(perplexity.pc, "index_in", lambda words, value_set, find=perplexity.pc.index_in: asked.append(len(words)) or find(words, value_set=value_set))
    names, words = [b"a", b"\n", b"bb", b"c"], 2
    model = perplexity.Model(pa.array(names, pa.binary()), np.array([1, 0, words + 5, words + 9]), np.array([-1.0, -2, -4, -8]),
                             np.array([True, True, True, False]), np.ones(words), np.ones(perplexity.CLASSES), np.array([0, words]), 9.0)
    texts = ["A a bb zz zz", "", "c A\tqq q a a a a a a a a", "bb", "zz c c c c c c c c c c c c c", "a"]
    batch = pa.record_batch({"doc_id": list(range(6)), "text": texts, "held_out": [False] * 6})
    got = [r for out in perplexity.encode(model, Rows())(iter([batch])) for r in out.to_pylist()]
    assert len(asked) == 1 and asked[0] < sum(len(t.split()) + 1 for t in texts)
    assert [(r["row"], r["doc_id"]) for r in got] == [((2 << 36) + i, i) for i in range(6)]
    for r, text in zip(got, texts):
        tokens = [t.encode() for t in text.lower().split()] + [b"\n"]
        at = [names.index(t) if t in names else -1 for t in tokens]
        code = [int(model.code[i]) if i >= 0 else words + zlib.crc32(t[-2:]) % perplexity.CLASSES for i, t in zip(at, tokens)]
        assert np.frombuffer(r["codes"], "<i4").tolist() == code
        assert r["tail"] == [t for i, t in zip(at, tokens) if i < 0] and r["n_tokens"] == len(tokens)
        assert r["head_known"] == sum(bool(model.known[i]) for i in at if i >= 0)
        assert r["head_base"] == sum(model.log_p[i] for i in at if i >= 0)
        assert r["class_base"] == sum(model.log_p[i] for i in at if i >= 0 and model.code[i] >= words)


@pytest.mark.parametrize("width", [1, 2, 17, 18])
def test_rows_are_added_up_by_number(width):
    rng = np.random.default_rng(width)
    for at in (rng.integers(0, 40, 300, np.int32), np.array([7]), np.arange(9), np.full(50, 3)):
        values = rng.normal(0, 1, (len(at), width)).astype(np.float32)
        rows, total, times = perplexity.added(at, values)
        want = np.zeros((40, width))
        np.add.at(want, at, values)
        assert rows.tolist() == sorted(set(at.tolist())) and times.tolist() == np.bincount(at)[rows].tolist()
        assert total == pytest.approx(want[rows], abs=1e-5)


@pytest.mark.parametrize("scale", [0.1, 3, 60])
def test_softmax_of_small_and_large_scores(scale):
    """Scores that need no shift and scores whose exponentials pass 32 bits."""
    rng = np.random.default_rng(3)
    q, outs = (rng.normal(0, scale, (n, 17)).astype(np.float32) for n in (900, 200))
    target = rng.integers(0, 200, 900)
    scores = q.astype(float) @ outs.T.astype(float)
    top = scores.max(1)
    want = scores[np.arange(900), target] - top - np.log(np.exp(scores - top[:, None]).sum(1))
    assert perplexity.own_logs(q, outs, target) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_empty(empty_docs, make_docs, spark):
    assert perplexity.lm_scores(empty_docs).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(empty_docs, labels).count() == 0
    rows = toxicity.toxicity(make_docs([(1, "a", "aa", "s"), (2, None, "aa", "s")]), labels).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.5, 1)}


def distance(a, b):
    """Optimal string alignment distance."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_brute_force():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choices("abc", k=rng.randint(3, 10))) for _ in range(40)})
    machine = toxicity.Lexicon(terms)
    for _ in range(4000):
        word = "".join(rng.choices("abc1", k=rng.randint(0, 11)))
        near = [(distance(t, word), n) for n, t in enumerate(terms)]
        near = [(d, n) for d, n in near if d == 0 or d == 1 and (len(terms[n]) >= toxicity.FREE or len(terms[n]) == len(word))
                or d == 2 and len(terms[n]) >= toxicity.LONG]
        assert machine.find(word) == (min(near) if near else None), word


def test_states_are_made_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 3)
    machine = toxicity.Lexicon(["stupid", "blockhead"])
    words = ["stupid", "stvpid", "blokchaed", "stone", "bl0ckhed", "zzz"] * 2
    assert [machine.find(w) for w in words] == [(0, 0), (1, 0), (2, 1), None, (2, 1), None] * 2


def test_hits_of_masked_words():
    model = toxicity.Toxicity(["blockhead", "idiot", "mug"], np.ones(3))
    forms = lambda text: [(t, f) for t, f, _, _ in model.hits([text])[0]]
    assert forms("you id1ot!") == forms("(idi*t)") == forms("IDI_OT") == [(1, toxicity.MASKED)]
    assert forms("bl0ckh3ad, m*g") == [(0, toxicity.MASKED), (2, toxicity.MASKED)]
    assert forms("idiot1 idiot-like idiot") == [(1, toxicity.EXACT)] * 3  # the run inside is the hit
    assert forms("idoit m4gs 12 3.5 -- ") == [(1, toxicity.LETTERS)]
    assert model.hits(["", "  ", "\"an id1ot\""])[2] == [(1, toxicity.MASKED, True, 0)]
    assert model.hits([]) == []


def test_toxicity(make_docs, spark):
    rng = random.Random(6)
    plain = ["".join(rng.choices("klmnoprst", k=rng.randint(3, 8))) for _ in range(300)]
    bad = ["grumblefix", "snorkwad", "blattermug"]
    rows, labels = [], []
    for i in range(900):
        words, kind = rng.choices(plain, k=rng.randint(5, 60)), i % 6
        place = rng.randrange(len(words))
        if kind == 0:
            words[place] = rng.choice(bad)
        elif kind == 1:  # quoted: not abuse
            words[place] = f'"{rng.choice(bad)}"'
        rows.append((i, " ".join(words), "aa", "s"))
        labels.append((i, 1, int(kind == 0)))
    rows += [(2000, " ".join(plain[:9] + ["grumbelfix"]), "aa", "s"), (2001, None, "aa", "s"), (2002, "", "aa", "s"), rows[0]]
    rows += [(2003, " ".join(plain[:9] + ["sn0rkwad!"]), "aa", "s"), (2004, " ".join(plain[:9] + ["bl*tterm_g"]), "aa", "s")]
    labels += [(3, 1, None), (None, 1, 1), (99_999, 1, 1)]
    model_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(make_docs(rows), model_labels).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels if t is not None} | {2000: 1, 2001: 0, 2002: 0, 2003: 1, 2004: 1}
    held = [r for r in got if r.held_out or r.doc_id >= 2000]
    right = [r.predicted == truth[r.doc_id] == int(r.score >= 0.3) for r in held]
    assert all(0 <= r.score <= 1 for r in got) and np.mean(right) > 0.97
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (2000, 2003, 2004)} == {2000: 1, 2003: 1, 2004: 1}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
