import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trailweave.llm import phrases


def brute(rows, least, cover=80):
    count, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").encode().lower().decode()):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, 5):
                count.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    often = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    found = []
    for (lang, words), a in often.items():
        if any(la == lang and len(longer) > len(words) and 100 * b >= cover * a
               and any(longer[i : i + len(words)] == words for i in range(len(longer))) for (la, longer), b in often.items()):
            continue
        cuts = [(2_000_000 * a // (count[lang, words[:k]] + count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.append((lang, " ".join(words), a, count[lang, words[:k]], count[lang, words[k:]], n[lang], score))
    return sorted(found)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["Of", "the", "new", "york", "État", "x", "a-b", " q"]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice([rng.choice(words), "new York times", "the the"]) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"])
        rows.append((i, text, rng.choice(["aa", "aa", "bb", None]), "s"))
    return rows + [(300, None, None, None), (301, "", "aa", "s"), (302, " .,\n", "aa", "s"), rows[3], rows[3],
                   (303, "hot " * 30_000, "cc", "s"), (304, "one " + "cold hot " * 4000, "cc", "s")]


@pytest.mark.parametrize("chunk", [phrases.CHUNK, 500])
def test_against_brute_force(make_docs, monkeypatch, chunk):
    """With many small chunks the result is the same; a word that a third of all words repeat is merged in segments."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = rows_of(4)
    found = phrases.collocations(make_docs(rows), least=5)
    assert found.columns == ["lang", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(rows, 5)
    assert {r[0] for r in got} == {"aa", "bb", "und", "cc"}
    top = phrases.top_collocations(found, 3).collect()
    for lang in {r[0] for r in got}:
        want = sorted((r for r in got if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:3]
        assert sorted((r["rank"], r["phrase"]) for r in top if r["lang"] == lang) == [(i + 1, r[1]) for i, r in enumerate(want)]


def test_wide_prefixes_are_cut():
    texts = pa.array([" ".join(f"w{i} w" for i in range(500))])
    wide = phrases.gram_hashes(phrases.hashes(pa.array(["aa"])), [phrases.hashes(pa.array([b"w"]))])
    every = phrases.Frequent(np.full(1 << 13, 255, np.uint8), wide)
    rows = phrases.stripes(texts, pa.array(["aa"]), 1, every).to_pylist()
    mine = [r for r in rows if r["prefix"] == b"w"]
    assert len(mine) > 100 and sum(len(r["next"].split()) for r in mine) == 499
    assert all(r["seg"] == 0 for r in rows if r["prefix"] != b"w")


def test_empty(empty_docs, make_docs):
    assert phrases.collocations(empty_docs).collect() == []
    assert phrases.collocations(make_docs([(1, None, None, None), (2, "", "aa", "s"), (3, "one two", "aa", "s")])).collect() == []
