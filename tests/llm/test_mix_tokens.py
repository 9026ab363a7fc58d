import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from trailweave.llm import mixing, tokens  # noqa: E402


def test_mix_against_sql(make_docs, corpus):
    df = make_docs(corpus)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "int64"}).replace({np.nan: None}))
    want = con.execute(mixing.ORACLE["op2_mix_sources"]).df()
    got = mixing.mixed_sizes(df).toPandas()
    names = ["doc_id", "source", "size", "source_size", "taken", "target"]
    a, b = (x[names].fillna("-").sort_values(names[:1]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    again = mixing.mixed_sizes(df.repartition(7)).toPandas()[names].fillna("-").sort_values(names[:1]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, again)


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, target, total = set(names), {}, float(sum(sizes.values()))
    while free:
        level = total / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        for s in over:
            target[s] = float(most * sizes[s])
            total -= target[s]
        if not over:
            return target | {s: weight[s] * level for s in free}
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 7, 100, 10_000, 10**7]) for s in ["b", "é", "a", "Z", None, "zz", "c", "d"]}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in rows} == want
    for r in rows:
        assert r.repeats * r.source_size + r.rest == pytest.approx(r.target)


def test_mix_repeats_documents(make_docs, corpus):
    df = make_docs(corpus)
    sizes = mixing.mixed_sizes(df).where("size > 0").distinct().collect()
    out = mixing.mix(df)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    copies = {r.doc_id: r["count"] for r in df.groupBy("doc_id").count().collect()}
    assert all(counts.get(r.doc_id, 0) == copies[r.doc_id] * r.taken // r.size for r in sizes)
    assert max(counts[i] / copies[i] for i in counts) <= 3


def test_empty(empty_docs, spark, tmp_path):
    assert mixing.mixed_sizes(empty_docs).count() == 0
    assert mixing.mix(empty_docs).count() == 0
    assert tokens.tokenize(empty_docs).count() == 0


@pytest.mark.parametrize("ids", [
    [], [5], [0] * 1000, list(range(700)), [2**32 - 1, 0, 1] * 300, [1] * 255 + [4_000_000_000], np.random.default_rng(1).integers(0, 50_000, 5000).tolist(),
])
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    index, body = tokens.pack(ids)
    assert (tokens.unpack(index, body, len(ids)) == ids).all()


def test_one_block_is_read_by_its_start():
    ids = np.random.default_rng(2).integers(0, 40_000, 256 * 5).astype(np.uint32)
    index, body = tokens.pack(ids)
    assert (tokens.unpack(index[3:4], body, 256) == ids[768:1024]).all()


def test_tokenize_against_the_library(make_docs, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    library.encode_special_tokens = True
    odd = ["The CAT's hat. x", "é É ñÑ ß", "a...b!! <|endoftext|>x", "x y\x85z\x1cw 42nd", "don't, I'LL? '", "ΑΣ Σ"]
    rows = corpus + [(600 + i, t, "aa", "s") for i, t in enumerate(odd)] + [(None, "none", "aa", "s")]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted((tuple(r) for r in tokens.tokenize(make_docs(rows)).collect()), key=lambda r: r[1])
    start = 0
    for row, (doc_id, text, *_) in zip(got, rows, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert row == (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)


def test_any_string_gets_the_ids_of_the_plain_call():
    """Letters that lower-casing or composition changes, alone and among marks, digits and added tokens."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(tokens.default_tokenizer()), tokens.WordIds(tokens.default_tokenizer(), True)
    rng = random.Random(7)
    alphabet = list("abYKo.,'!-09 ") + ["İ", "\u030a", "\u0301", "é", "É", "ß", "ẞ", "Σ", "ς", "\u212b", "ﬁ", "\u0345", "日", "\u00b2", "ǅ", "\u00ad", "'s", "<|endoftext|>", "\u2019"]
    made = ["İ.", "Kİ,", "Y\u030a", "Y\u030a.", "é.", "É!", "日。"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(20_000)]
    ids, counts = words.encode(pa.array(made))
    ends = np.cumsum(counts)
    wrong = [(t, ids[e - n : e - 1].tolist()) for t, e, n in zip(made, ends, counts)
             if ids[e - n : e - 1].tolist() != library.encode(t, add_special_tokens=False).ids]
    assert not wrong, (len(wrong), wrong[:5])


def test_query_and_stage_give_added_tokens_like_the_library(make_docs, spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "The<|startoftext|>CAT", "a...<|endoftext|>!!<|startoftext|>x <|endoftext|>",
             "<|ENDOFTEXT|> <|EndOfText|>", "É<|endoftext|><|endoftext|>ß <|endoftext|", "<|endoftext|>'s <|<|endoftext|>|>", "plain Text."]
    make_docs([(i, t, "aa", "s") for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    want, start = [], 0
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for got in (tokens.QUERIES["op6_token_blocks"](spark, str(tmp_path)), corpus_pipeline.token_blocks(spark, docs, str(tmp_path))):
        assert sorted(tuple(r) for r in got.collect()) == want


def test_written_ids_are_read_back(make_docs, spark, tmp_path):
    tokens.write_tokens(make_docs([(2, "b", "aa", "s"), (1, "a a", "aa", "s")]), str(tmp_path / "t"), tokens.default_tokenizer())
    got = {r.doc_id: r.ids for r in tokens.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert list(map(len, (got[1], got[2]))) == [3, 2] and got[1][0] == got[1][1] and got[1][2] == got[2][1] == 1


def test_words_are_counted_like_the_pattern(make_docs):
    texts = ["a b", " a b\tc\n", "\x1ca \x0b\x0c", "", None, "ä ö"]
    got = {r.doc_id: r.size for r in mixing.mixed_sizes(make_docs([(i, t, "aa", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_words_are_looked_at_once_each():
    """What tells odd words and added tokens sees the different words of a slice, not all of them."""
    words, seen = tokens.WordIds(tokens.default_tokenizer(), True), []
    plain, mark = words.apart, next(iter(words.added))
    words.apart = lambda lower, keys: seen.append(keys) or plain(lower, keys)
    parts = ["Word", "word", "ÉTÉ", "été", "ΣΣ.", f"a{mark}b", mark.upper(), "İx", "don't", "9,5"]
    texts = [" ".join(parts * 50), None, " ".join(parts[::-1]), ""]
    ids, counts = words.encode(pa.array(texts, pa.string()))
    (keys,) = seen
    assert len(keys) == len(set(keys)) <= len(parts)  # the empty text is a word here
    at = np.cumsum(counts)
    for text, end, n in zip(texts, at, counts):
        alone, m = words.encode(pa.array([text], pa.string()))
        assert ids[end - n : end].tolist() == alone.tolist() and m.tolist() == [n]
        # One word at a time: no word depends on those around it.
        each = [words.encode(pa.array([w]))[0][:-1].tolist() for w in (text or "").split()]
        assert alone.tolist() == [*sum(each, []), tokens.END]
