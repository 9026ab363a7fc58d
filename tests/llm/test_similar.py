import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_takes_edited_copies_out(make_docs, spark, tmp_path):
    """Copies with edited words, measured at 0.8 to 0.95; others below 0.75 stay."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    rows, near, far = [], {}, {}
    for n in range(500):
        words = [word() for _ in range(rng.randint(200, 600))]
        edited = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 28))):
            edited[rng.randrange(len(words))] = word()
        a, b = shingles(" ".join(words)), shingles(" ".join(edited))
        similarity = len(a & b) / len(a | b)
        rows += [(n, " ".join(words), "aa", "s"), (1000 + n, " ".join(edited).upper(), "aa", "s")]
        if similarity >= 0.8:
            near[1000 + n] = similarity
        else:
            far[1000 + n] = similarity
    assert sum(s < 0.9 for s in near.values()) > 80 and len(far) > 20
    rows += [(2000, rows[0][1], "aa", "s"), (2001, None, "aa", "s"), (2002, "", "aa", "s"), (None, rows[0][1], "aa", "s"), (2003, "one two", "aa", "s")]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, make_docs(rows), str(tmp_path)).select("doc_id").collect()}
    found = sum(i not in kept for i in near)
    print(f"recall {found} of {len(near)}, by tenths", {t: (sum(i not in kept for i, s in near.items() if int(s * 20) == t), sum(int(s * 20) == t for s in near.values())) for t in (16, 17, 18, 19)})
    assert found >= 0.99 * len(near)
    assert all(i in kept for i in far) and {*range(500), None, 2001, 2003} <= kept and not {2000, 2002} & kept


def test_clusters_of_edited_copies(make_docs, spark, tmp_path):
    """In clusters around the limit exactly the components of all true links are joined."""
    rng, rows, want = random.Random(6), [], set()
    for cluster in range(8):
        base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
        ids = []
        for _ in range(40):
            words = list(base)
            for at in rng.sample(range(400), rng.randint(5, 9)):
                words[at] = "".join(rng.choices("abcdefgh", k=6))
            ids.append(len(rows))
            rows.append((len(rows), " ".join(words), "aa", "s"))
        sets, root = [shingles(rows[i][1]) for i in ids], list(range(40))
        for _ in range(40):
            for a in range(40):
                for b in range(a):
                    if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        want |= {ids[i] for i in range(40) if root[i] == i}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, make_docs(rows), str(tmp_path)).select("doc_id").collect()}
    assert kept == want and 8 < len(kept) < 300


def test_simhash_finds_candidates(make_docs, spark, tmp_path, monkeypatch):
    """Without a band, what SimHash links is still compared on whole sets, copies of other ids included."""
    from trailweave.llm import similar
    from trailweave.llm.common import lower_words
    from trailweave.llm.simhash import fingerprint

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    words = [word() for _ in range(1500)]
    edited = [*words[:700], "other", *words[701:]]
    first, second = " ".join(words), " ".join(edited)
    prints = [fingerprint(lower_words(t), 3) & (1 << 64) - 1 for t in (first, second)]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    rows = [(5, first, "aa", "s"), (2, second, "aa", "s"), (9, first, "aa", "s"), (7, " ".join(word() for _ in range(300)), "aa", "s")]
    monkeypatch.setattr(similar, "band_keys", lambda s: s[:0].view("i8"))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, make_docs(rows), str(tmp_path)).select("doc_id").collect()}
    assert kept == {2, 7}
