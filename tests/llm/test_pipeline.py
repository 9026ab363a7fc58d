import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from trailweave.llm import decontaminate, language, mixing, simhash  # noqa: E402
from trailweave.llm.catalog import all_oracles, all_queries  # noqa: E402


def test_stages(make_docs, corpus, spark, tmp_path):
    passage = " ".join(f"{'abcde'[i % 5]}{'edcba'[i % 4]}b{'ace'[i % 3]}" for i in range(30))
    rows = corpus + [(800, corpus[90][1] + " " + passage, "aa", "s1"), (801, corpus[3][1], "aa", "s1")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "decontaminate", "mix_sources", "token_blocks"]
    before, kept = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == docs.columns, name
        path = str(tmp_path / name)
        after.write.parquet(path)
        kept.append((before, spark.read.parquet(path)))
        before = kept[-1][1]
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    (a, b), (_, c), (_, d), (_, e) = kept
    found = {r.doc_id for r in language.identify(a).where("accepted").collect()}
    assert ids(b) == Counter({i: n for i, n in ids(a).items() if i in found})
    stays = {r.doc_id for r in simhash.simhash_components(b).where("doc_id = component_id").collect()}
    assert set(ids(c)) == stays and 801 not in stays
    assert set(ids(c)) - set(ids(d)) == {r.doc_id for r in decontaminate.contaminated(c, spark.read.parquet(
        f"{folder}/benchmark.parquet")).collect()} == {800}
    taken = {(r.doc_id, r.size, r.taken) for r in mixing.mixed_sizes(d).collect()}
    assert ids(e) == Counter({i: n * (t // s) for i, s, t in taken for n in [ids(d)[i]] if s and t})
    rows = pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == ids(e)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in rows)
    assert [r.start for r in ordered[1:]] == [r.start + r.n_tokens for r in ordered[:-1]]


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in all_queries()) == list(range(1, 14))
    assert set(all_oracles()) <= set(all_queries())
