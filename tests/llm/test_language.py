from collections import Counter

import numpy as np

from trailweave.llm import language


def test_models_are_distributions():
    """Interpolated probabilities of all letters after any context sum to one."""
    texts = {"aa": ["abc abd acd bcd", "dcba abcd"], "bb": ["xyz zyx abc"]}
    grams = []
    for docs in texts.values():
        found = Counter()
        for text in docs:
            codes, _ = language.letter_codes([text])
            s = "".join(map(chr, codes))
            found.update(s[i : i + 4] for i in range(len(s) - 3))
        grams.append(dict(found))
    model = language.fit(list(texts), grams)
    known = sorted({g[-1] for f in grams for g in f})
    for context in ("abc", "xyz", "qqq", "\0\0\0", "zab"):
        columns = [np.full(len(known) + 1, ord(c), np.uint64) for c in context]
        columns.append(np.array([*map(ord, known), ord("Q")], np.uint64))
        total = np.exp(model.logs(columns).astype(float)).sum(0)
        assert np.allclose(total, 1, atol=1e-4), context


def brute_entropy(model, text):
    """One letter at a time."""
    codes, _ = language.letter_codes([text])
    s = codes.astype(np.uint64)
    logs = [model.logs([s[i - 3 : i - 2], s[i - 2 : i - 1], s[i - 1 : i], s[i : i + 1]])[0] for i in range(3, len(s))]
    return -np.mean(logs, 0)


def test_identify(make_docs, corpus):
    got = language.identify(make_docs(corpus)).collect()
    assert len(got) == len(corpus)
    truth = {i: (t, lang) for i, t, lang, _ in corpus}
    import zlib

    for r in got:
        text, lang = truth[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0, False)
        else:
            assert r.lang_pred == lang and r.accepted


def test_batches_do_not_matter(make_docs, corpus):
    from pyspark.sql import functions as F

    model = language.train(make_docs(corpus), F.lit(True))
    docs = [t or "" for _, t, _, _ in corpus]
    h, n = model.entropies(docs)
    for text, row, letters in zip(docs[:20], h, n):
        assert np.allclose(row, brute_entropy(model, text), atol=1e-4)
        assert letters == sum(map(str.isalpha, text))


def test_rejection_keeps_known_languages(make_docs, corpus):
    rows = corpus + [(700, "жшю щць фыв апролд", None, "s0"), (701, "qqq vvv zzz wwq xqz" * 9, None, "s1")]
    df = make_docs(rows)
    kept = language.known_language(df)
    assert kept.columns == df.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter(i for i, t, _, _ in corpus if any(map(str.isalpha, t or "")))


def test_nothing_to_learn(make_docs, empty_docs):
    df = make_docs([(1, "abc", None, "s")])
    assert [(r.lang_pred, r.score) for r in language.identify(df).collect()] == [("und", 0)]
    assert language.identify(empty_docs).count() == 0
    assert language.known_language(empty_docs).count() == 0


def test_sample_is_bounded(make_docs, corpus):
    rows = language.sample_rows(make_docs(corpus * 5).where("lang is not null"), "lang", "doc_id", 20)
    assert all(r["count"] < 120 for r in rows.groupBy("lang").count().collect())
