import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from trailweave.llm import exact, simhash

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def by_id(df):
    return Counter(tuple(r) for r in df.collect())


def brute_exact(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(SPACES.sub("", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    out = Counter()
    for i, text in rows:
        body = SPACES.sub("", text or "")
        size, _, _, keep = min(groups[body])
        out[i, keep, len(groups[body]), i == keep and len(text or "") == -size, hashlib.sha256(body.encode()).hexdigest()] += 1
    return out


def test_exact_groups(make_docs, corpus):
    rows = [(i, t, "aa", "s") for i, t, _, _ in corpus]
    rows += [(300, "a b\tc", "aa", "s"), (301, "abc", "aa", "s"), (302, "a  bc ", "aa", "s"), (299, " abc ", "aa", "s"),
             (None, "abc", "aa", "s"), (303, "ÀÉ x", "aa", "s"), (304, "ÀÉx ", "aa", "s")]
    got = by_id(exact.exact_groups(make_docs(rows)))
    assert got == brute_exact([(i, t) for i, t, _, _ in rows])


def test_exact_groups_of_many_copies(make_docs):
    got = exact.exact_groups(make_docs([(i, " one two" if i % 3 else "onetwo", "aa", "s") for i in range(500)]), salts=4).collect()
    assert {r.group_size for r in got} == {500} and {r.keep_id for r in got} == {1}
    assert [r.doc_id for r in got if r.kept] == [1]


def test_empty(empty_docs):
    assert exact.exact_groups(empty_docs).count() == 0
    assert simhash.simhash_components(empty_docs).count() == 0
    assert simhash.near_dedup(empty_docs).count() == 0


def brute_print(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=3):
    label = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= bits:
                a, b = label[i], label[j]
                label = [b if k == a else k for k in label]
    return label


def test_simhash_components(make_docs, corpus):
    rows = corpus + [(400 + i, corpus[i][1] + " tail", "aa", "s0") for i in range(30)]
    rows += [(500 + i, corpus[115][1].replace(".", "!") + " ab", "aa", "s0") for i in range(5)]
    got = simhash.simhash_components(make_docs(rows), group=4).collect()
    prints = [brute_print(t) for _, t, _, _ in rows]
    label = brute_components(prints)
    least = {}
    for k, (i, *_) in zip(label, rows):
        least[k] = min(i, least.get(k, i))
    want = Counter((i, p, least[k]) for (i, *_), p, k in zip(rows, prints, label))
    assert Counter((r.doc_id, r.print & (2**64 - 1), r.component_id) for r in got) == want
    kept = simhash.near_dedup(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_equal_or_less_half_gives_zero_bits():
    assert simhash.fingerprint([], 3) == 0
    assert simhash.fingerprint([b"a"], 3) & (2**64 - 1) == xxhash.xxh64(b"a", 42).intdigest()


@pytest.mark.parametrize("count", [3, 70, 700, 3000])
def test_tree_finds_what_brute_force_finds(count):
    rng = np.random.default_rng(count)
    base = rng.integers(0, 2**63, max(count // 3, 1), dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) for _ in range(3))]))
    a, b = simhash.link(np.zeros(len(values), np.int64), values, 3)
    label = {int(v): int(v) for v in values.view(np.int64)} | dict(zip(a.tolist(), b.tolist()))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    want = np.arange(len(values))
    simhash.union(want, *np.nonzero(near))
    got = [label[int(v)] for v in values.view(np.int64)]
    assert len({*zip(got, want.tolist())}) == len(set(got)) == len(set(want.tolist()))


def test_links_refine_hot_blocks(spark):
    values = [x << 40 | 5 for x in range(300)]  # one block is the same for all
    prints = spark.createDataFrame([(v,) for v in values], "print long")
    stars = simhash.components(simhash.links(prints, group=16)).collect()
    assert len(stars) == 299 and {r.b for r in stars} == {5}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 901)], "a long, b long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)} | {(901, 900)}
