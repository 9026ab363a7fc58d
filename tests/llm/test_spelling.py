import random
import re
import zlib
from collections import Counter

import pytest

from trailweave.llm import spelling


def brute(rows, shortest=7, least=2, times=10):
    counts = Counter()
    for doc_id, text, *_ in rows:
        low = (text or "").encode().lower().decode()
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        others = sorted(((-words[v], v) for v in words if v != w and near(w, v)))
        if others and -others[0][0] >= times * n:
            form[w] = others[0][1]
        out[w] = [n, len(others)]
    found = []
    for w, (n, near_count) in out.items():
        root = w
        while root in form:
            root = form[root]
        found.append((w, form.get(w), root, n, near_count, words[form[w]] if w in form else None))
    return sorted(found)


def rows_of(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeéß", k=rng.randint(6, 11))) for _ in range(30)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 80)):
            w = rng.choice(base)
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abzÀü") + w[at:], w[:at] + rng.choice("aZé") + w[at + 1 :]])
            words.append(rng.choice([w, w, w.upper() if w.isascii() else w]))
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words), "aa", "s"))
    long = "abcdefg" * 300  # one word of 2,100 letters and its variants
    return rows + [(300, None, None, None), (301, "", "aa", "s"), (302, f"{long} {long} x{long} x{long}", "aa", "s"),
                   (None, "abcdeab abcdeab", None, None), rows[0], rows[0], (303, "aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa", "aa", "s")]


@pytest.mark.parametrize("most", [1 << 24, 40])
def test_against_brute_force(make_docs, most):
    """With many small rounds of filters the result is the same."""
    rows = rows_of(1)
    df = spelling.spelling_variants(make_docs(rows), most=most)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted(tuple(r) for r in df.collect())
    assert found == brute(rows)
    assert any(r[1] for r in found) and any(r[4] > 1 for r in found)


def test_chain_of_forms(make_docs):
    """abcdefgh (2) -> abcdefg (20) -> abcdefx (200): two steps to the root."""
    rows = []
    for word, times in (("zbcdefgh", 2), ("zbcdefg", 25), ("zbcdefq", 300)):
        rows += [(i, word, "aa", "s") for i in range(times)]
    found = {r["word"]: r for r in spelling.spelling_variants(make_docs(rows), noise=0).collect()}
    assert found["zbcdefgh"]["form"] == "zbcdefg" and found["zbcdefgh"]["root"] == "zbcdefq"
    assert found["zbcdefq"]["form"] is None and found["zbcdefq"]["root"] == "zbcdefq"


def test_empty(empty_docs, make_docs):
    assert spelling.spelling_variants(empty_docs).collect() == []
    assert spelling.spelling_variants(make_docs([(1, None, None, None), (2, "short words", None, None)])).collect() == []


def test_filter_rates():
    """No word is missed, and few others pass."""
    rng = random.Random(2)
    words = list({"".join(rng.choices("abcdefghij", k=9)) for _ in range(20_000)})
    shard = spelling.Shard(9, 0, 1, 10_000)
    hashed = spelling.spread((spelling._LETTER[spelling.letters(words, 9)] * spelling.powers(9)).sum(1))
    cell, bits = shard.place(hashed[:10_000])
    for c, b in zip(cell, bits):
        shard.blocks[c] |= b
    assert shard.holds(hashed[:10_000]).all()
    assert shard.holds(hashed[10_000:]).mean() < 0.03
