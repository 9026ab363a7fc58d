import random
from fractions import Fraction

import numpy as np
import pytest

from trailweave.llm import jaccard
from trailweave.llm.common import lower_words


def grams(text, size=4):
    words = lower_words(text or "")
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute(rows, size=4, least=Fraction(85, 100)):
    sets = {r[0]: grams(r[1], size) for r in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted((i, len(sets[i]), top(i)) for i in ids)


def variants(rng, text, edits):
    words = list(text)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(99))], [words[at], "x" + str(rng.randrange(99))]])
    return words


def cluster_rows(seed, lengths=(400, 60, 25, 12, 9), copies=40, most=9):
    """Clusters of edited copies around the threshold, of long and short texts, that share a passage."""
    rng = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(50)]
    for length in lengths:
        base = [f"w{rng.randrange(500)}" for _ in range(length)]
        for _ in range(copies):
            words = variants(rng, base, rng.randint(0, max(1, most * length // 400)))
            if rng.random() < 0.1:
                words = words + passage
            rows.append((len(rows), " ".join(words), "aa", "s"))
    return rows


@pytest.mark.parametrize("weight", [jaccard.WEIGHT, 3000])
def test_against_all_pairs(make_docs, corpus, weight):
    """Also with blocks cut into many chunks."""
    rows = cluster_rows(1) + [(1000 + r[0], *r[1:]) for r in corpus if r[0] not in (5,)]
    rows += [(3000, " ".join(["Same"] * 900), None, None), (3001, "same " * 700, None, None)]
    found = sorted({tuple(r) for r in jaccard.jaccard_components(make_docs(rows), weight=weight).collect()})
    assert found == brute(rows)
    assert len({r[2] for r in found}) < len(found) - 100


def test_other_limits(make_docs):
    rows = cluster_rows(2, (60, 30), 30, 30)
    found = sorted(tuple(r) for r in jaccard.jaccard_components(make_docs(rows), size=2, least=(4, 5)).collect())
    assert found == brute(rows, 2, Fraction(4, 5))


def test_edges(make_docs, empty_docs):
    assert jaccard.jaccard_components(empty_docs).collect() == []
    rows = [(1, None, None, None), (2, "", None, None), (3, " \t\n", None, None), (4, "One two", None, None), (5, "one  TWO", None, None),
            (6, "one", None, None), (7, "a b c d e", None, None), (7, "a b c d e", None, None), (None, "one two", None, None)]
    found = sorted((tuple(r) for r in jaccard.jaccard_components(make_docs(rows)).collect()), key=str)
    assert found == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7), (7, 2, 7), (None, 1, None)], key=str)


def test_differences_are_bounded():
    """No two linked sets differ in more shingles, or lie further apart, than their bands say."""
    for least in ((85, 100), (4, 5), (1, 2)):
        bands = jaccard.Bands(least, 400)
        for a in range(1, 160):
            for b in range(a, a * least[1] // least[0] + 1):
                assert bands.of(b) - bands.of(a) in (0, 1)
                both = next(x for x in range(a + 1) if jaccard.linked(x, a, b, least))
                assert a + b - 2 * both <= bands.differ[bands.of(a)]


def test_linked_sets_share_a_key():
    """Random pairs at the threshold, many of them with empty parts."""
    rng = np.random.default_rng(5)
    bands = jaccard.Bands((85, 100), 4000)
    for _ in range(400):
        both = int(rng.integers(6, 300))
        union = both * 100 // 85
        extra = rng.integers(0, union - both + 1)
        values = rng.integers(0, 1 << 63, union, np.int64).astype(np.uint64)
        a, b = np.unique(values[: both + extra]), np.unique(np.r_[values[:both], values[both + extra :]])
        assert set(jaccard.part_keys(a, bands).tolist()) & set(jaccard.part_keys(b, bands).tolist()) or len(a) == len(b) == both
