import random

import numpy as np
import pytest

from trailweave.llm import decontaminate as dc


def brute_align(item, region):
    score = [[0] * (len(region) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, x in enumerate(item, 1):
        for j, y in enumerate(region, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if x == y else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best / (2 * len(item))


def test_alignment():
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 6, rng.integers(3, 30)) for _ in range(60)]
    regions = [rng.integers(-1, 6, rng.integers(1, 60)) for _ in range(60)]
    want = [brute_align(x, [y if y >= 0 else None for y in r]) for x, r in zip(items, regions)]
    assert dc.align(items, regions) == pytest.approx(want)


@pytest.fixture(scope="module")
def case(spark, make_docs):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(800)]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [say(rng.randint(12, 60)) for _ in range(25)]
    rows = [(i, " ".join(say(rng.randint(1, 300))), "aa", "s") for i in range(80)]
    want = set()
    for k, item in enumerate(items):
        whole, edited = list(item), [w if n % 6 else "changed" for n, w in enumerate(item)]
        left_out = [w for n, w in enumerate(item) if n % 7 != 3]
        for n, words in enumerate((whole, edited, left_out)):
            text = say(40) + words + say(40)
            rows.append((1000 + 10 * k + n, " ".join(text).upper().replace(" ", ", ", 5), "aa", "s"))
            want.add((1000 + 10 * k + n, k))
    # One item in very many documents is still found.
    rows += [(5000 + i, " ".join(say(5) + items[0] + say(5)), "aa", "s") for i in range(200)]
    want |= {(5000 + i, 0) for i in range(200)}
    rows += [(6000, None, "aa", "s"), (6001, "", "aa", "s")]
    bench = spark.createDataFrame(
        [(k, " ".join(x)) for k, x in enumerate(items)] + [(90, "two words"), (91, None), (None, "no id at all here"), (92, "")],
        "item_id long, text string")
    return make_docs(rows), bench, want, [r[0] for r in rows], items


def test_contaminated(case):
    docs, bench, want, _, _ = case
    got = dc.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.score == 1 for r in got if r.doc_id % 10 == 0 and r.doc_id < 5000)


def test_scores_are_those_of_brute_force(case):
    docs, bench, _, _, items = case
    texts = {r.doc_id: dc.words_of(r.text) for r in docs.where("doc_id between 1000 and 1100").collect()}
    for r in dc.contaminated(docs.where("doc_id between 1000 and 1100"), bench).collect():
        assert r.score == pytest.approx(brute_align(items[r.item_id], texts[r.doc_id]))


def test_blocks_give_the_same(case):
    docs, bench, want, _, _ = case
    got = dc.contaminated(docs, bench, block_words=600).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_clean(case):
    docs, bench, want, ids, _ = case
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(ids) - {i for i, _ in want})


def test_empty(case, empty_docs, spark):
    docs, bench, *_ = case
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(empty_docs, bench).count() == 0
    assert dc.contaminated(docs, nothing).count() == 0
    assert dc.clean(docs, nothing).count() == docs.count()
