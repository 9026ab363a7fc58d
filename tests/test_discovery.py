import random

from pyspark.sql import functions as F

from trailweave.operators import variants as v
from trailweave.operators.discovery import discover
from trailweave.session import small_table
from trailweave.operators.ordering import find_slices, global_index, in_order, numbered, sequences


def edges(found):
    return {(r["from"], r["to"]): r["count"] for r in found.edges.collect()}


def ranks(found):
    return {r["type"]: r["rank"] for r in found.ranks.collect()}


def test_graph_and_variants(make_log):
    found = discover(make_log({"/o/1": "placed paid shipped", "/o/2": "placed paid shipped", "/o/3": "placed cancelled"}))
    assert edges(found) == {("placed", "paid"): 2, ("paid", "shipped"): 2, ("placed", "cancelled"): 1}
    assert tuple(found.totals.first()) == (3, 8, 3)
    stats = {r["type"]: (r["count"], r["start_count"], r["end_count"]) for r in found.node_stats.collect()}
    assert stats == {"placed": (3, 3, 0), "paid": (2, 0, 0), "shipped": (2, 0, 2), "cancelled": (1, 0, 1)}
    top = v.variants(found, 8).orderBy("rank").collect()
    assert [(r["sequence"], r["count"], r["pct"]) for r in top] == [("placed paid shipped", 2, 66), ("placed cancelled", 1, 33)]


def test_ranks(make_log):
    assert ranks(discover(make_log({"/s": "a b c d"}))) == {"a": 0, "b": 1, "c": 2, "d": 3}
    found = discover(make_log({"/s": "a b a b c"}))
    assert edges(found) == {("a", "b"): 2, ("b", "a"): 1, ("b", "c"): 1}
    assert ranks(found) == {"a": 0, "b": 1, "c": 2}
    two_loops = discover(make_log({"/s": "s a b a b t x y z x y z e"}))
    assert ranks(two_loops)["s"] == 0 and ranks(two_loops)["e"] > ranks(two_loops)["t"]


def test_restart_is_no_step(make_log):
    found = discover(make_log({"/s": "sown grown mown sown grown mown"}))
    assert ("mown", "sown") not in edges(found)
    assert found.totals.first()["traces"] == 2
    assert [(r["sequence"], r["count"]) for r in v.variants(found).collect()] == [("sown grown mown", 2)]
    assert edges(discover(make_log({"/s": "tick tick tick"}))) == {("tick", "tick"): 2}


def test_concurrency(make_log):
    mixed = {f"/x/{i}": "a b c d" for i in range(8)} | {f"/y/{i}": "a c b d" for i in range(12)}
    found = discover(make_log(mixed))
    assert [r["members"] for r in found.concurrent_groups.collect()] == ["b,c"]
    parallel = {(r["from"], r["to"]) for r in found.edges.where("parallel").collect()}
    assert parallel == {("b", "c"), ("c", "b")}
    assert [(r["sequence"], r["count"]) for r in v.variants(found).collect()] == [("a b c d", 20)]
    assert ranks(found)["b"] == ranks(found)["c"] == 1
    blocks = discover(make_log({f"/x/{i}": "a b c x y z" for i in range(5)} | {f"/y/{i}": "a c b y x z" for i in range(5)}))
    assert [r["members"] for r in blocks.concurrent_groups.collect()] == ["b,c", "x,y"]
    lopsided = discover(make_log({f"/x/{i}": "a b" for i in range(30)} | {"/z": "b a b"}))
    assert lopsided.concurrent_groups.count() == 0


def test_variant_cap_and_options(make_log):
    log = make_log({"/a": "x", "/b": "y", "/c": "z"})
    assert v.variants(discover(log), 2).count() == 2
    fixed = discover(make_log({"/a": "x y x y"}), start_types=("x",), end_types=("y",))
    assert fixed.totals.first()["traces"] == 2


def test_reach_and_subgraph(make_log):
    found = discover(make_log({"/s": "a b c d"}))
    nodes, walked = found.downstream("a", 2)
    assert {r["type"] for r in nodes.collect()} == {"a", "b", "c"}
    assert {(r["from"], r["to"]) for r in walked.collect()} == {("a", "b"), ("b", "c")}
    assert found.downstream("a", None)[0].count() == 4
    kept, lines = found.subgraph("B")
    assert [r["type"] for r in kept.collect()] == ["b"] and lines.count() == 0


def noisy(make_log, seed=5, subjects=40, longest=60):
    """One subject holds about a third of all events."""
    rng = random.Random(seed)
    log = {f"/s/{i}": " ".join(rng.choice("abcde") for _ in range(rng.randint(1, longest))) for i in range(subjects)}
    log["/s/hot"] = " ".join(rng.choice("abcde") for _ in range(subjects * longest // 4))
    return make_log(log)


def test_cut_subjects_give_the_same_answer(make_log):
    log = noisy(make_log)
    slices = find_slices(log, rows_per_slice=25)
    assert slices.bounds.agg(F.max(F.size("_bounds"))).first()[0] > 10
    columns = ["subject", "id", "type", "prev_type", "next_type", "pos"]
    whole, cut = in_order(log).df.select(columns), in_order(log, slices).df.select(columns)
    assert whole.exceptAll(cut).count() == 0 and cut.count() == log.count()
    plain, sliced = discover(log), discover(log, slices=slices)
    assert edges(plain) == edges(sliced)
    assert v.split_runs(plain).exceptAll(v.split_runs(sliced)).count() == 0
    same = lambda found: sorted(map(tuple, v.variants(found).select("sequence", "count", "length").collect()))
    assert same(plain) == same(sliced)
    assert plain.totals.first() == sliced.totals.first()


def test_order_of_rows_does_not_matter(make_log):
    log = noisy(make_log, seed=9)
    shuffled = log.orderBy(F.rand(3))
    assert edges(discover(log)) == edges(discover(shuffled))


def test_invariants(make_log):
    found = discover(noisy(make_log, seed=2))
    subjects, events, traces = found.totals.first()
    assert sum(edges(found).values()) == events - traces
    assert v.variants(found).agg(F.sum("count")).first()[0] == traces
    assert found.node_stats.agg(F.sum("count")).first()[0] == events


def test_long_sequences_sort_like_their_text(make_log, monkeypatch):
    """Ties beyond the head are broken by later blocks, as the whole text would."""
    monkeypatch.setattr(v, "HEAD", 3)
    rng = random.Random(4)
    made = {f"/s/{i}": "p q r " * rng.randint(0, 3) + " ".join(rng.choice("pqr") for _ in range(rng.randint(1, 6))) for i in range(60)}
    log = make_log(made)
    texts = {s: " ".join(t.split()) for s, t in made.items()}
    population = {t: list(texts.values()).count(t) for t in texts.values()}
    walked = [r["subject"] for r in v.walk_order(log, "variant").collect()]
    arrows = {s: t.replace(" ", " → ") for s, t in texts.items()}
    expected = sorted(texts, key=lambda s: (-population[texts[s]], arrows[s], list(made).index(s)))
    assert walked == expected
    rare = [r["subject"] for r in v.walk_order(log, "rare").collect()]
    assert rare == sorted(texts, key=lambda s: (population[texts[s]], len(texts[s].split()), list(made).index(s)))


def test_variant_steps_cover_long_variants(make_log, monkeypatch):
    monkeypatch.setattr(v, "HEAD", 4)
    found = discover(make_log({"/a": "s " + "x y " * 6 + "e", "/b": "s " + "x y " * 6 + "e", "/c": "s e"}))
    rows = v.variants(found, 1).orderBy("block").collect()
    assert " ".join(r["sequence"] for r in rows) == "s " + "x " * 6 + "y " * 6 + "e" and [r["block"] for r in rows] == [0, 1, 2, 3]
    steps = v.variant_steps(found, 1).agg(F.sum("n")).first()[0]
    assert steps == 14


def test_sequences_in_blocks(make_log):
    log = make_log({"/a": "a b c d e"})
    blocks = sequences(log, block=2).orderBy("block").collect()
    assert [r["types"] for r in blocks] == [["a", "b"], ["c", "d"], ["e"]]


def test_a_variant_of_5000_steps_is_whole(make_log):
    text = " ".join(random.Random(8).choice("pqrs") for _ in range(5000))
    rows = v.variants(discover(make_log({"/a": text, "/b": text}), start_types=(), end_types=())).orderBy("block").collect()
    assert {(r["rank"], r["length"], r["count"]) for r in rows} == {(1, 5000, 2)} and len(rows) == 5
    steps = " ".join(r["sequence"] for r in rows).split()
    assert sorted(steps) == sorted(text.split())


def test_numbered(spark):
    names = [f"{n:03d}" for n in random.Random(2).sample(range(999), 300)]
    df = small_table(spark, [(n, int(n) % 7) for n in names], "name string, k int")
    got = numbered(df, [F.desc("k"), F.col("name")], "place").collect()
    assert [(r["k"], r["name"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(
        ((int(n) % 7, n) for n in names), key=lambda r: (-r[0], r[1]))
    assert sorted(r["place"] for r in got) == list(range(1, 301))


def test_global_index_by_ranges(spark):
    ids = [f"{n:05d}" for n in random.Random(1).sample(range(99999), 500)]
    df = small_table(spark, [(i,) for i in ids], "id string")
    for rows in (1, 70, 1 << 30):
        got = {r["id"]: r["index"] for r in global_index(df, "id", rows_per_range=rows).collect()}
        assert got == {i: n for n, i in enumerate(sorted(ids))}


def test_cuts_from_a_small_sample(make_log, monkeypatch):
    """Cut points come from a sample; wherever they fall, nothing changes."""
    from trailweave.operators import ordering

    log = noisy(make_log, seed=12)
    monkeypatch.setattr(ordering, "SAMPLED_ROWS_PER_SLICE", 3)
    slices = find_slices(log, rows_per_slice=10)
    assert slices.bounds is not None and slices.bounds.where("subject = '/s/hot'").count() == 1
    columns = ["subject", "id", "type", "prev_type", "next_type", "pos"]
    whole, cut = in_order(log).df.select(columns), in_order(log, slices).df.select(columns)
    assert whole.exceptAll(cut).count() == 0 and cut.count() == log.count()


def test_cut_logs_are_read_and_shuffled_once(spark, make_log, tmp_path):
    """Windows, seams and running sums of a cut log share one exchange of the log."""
    path = str(tmp_path / "log")
    noisy(make_log).write.parquet(path)
    log = spark.read.parquet(path)
    found = discover(log, slices=find_slices(log, rows_per_slice=25))
    found.group_of
    runs = v.split_runs(found)
    runs.write.format("noop").mode("overwrite").save()
    runs.collect()
    plan = runs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") <= 2, plan
    assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan.splitlines()) <= 2, plan


def test_split_runs_shuffles_the_log_once(spark, make_log, tmp_path):
    """Counting neighbours and numbering runs are one query with one exchange of the log, also of a cut log."""
    path = str(tmp_path / "log")
    noisy(make_log).write.parquet(path)
    log = spark.read.parquet(path)
    apart = discover(log)
    assert not apart.few_types
    want = v.split_runs(apart).collect()
    found = discover(log, together=True)
    assert found.few_types
    runs = v.split_runs(found)
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, want))
    plan = runs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan, plan
    cut = discover(log, together=True)
    cut.slices = find_slices(log, rows_per_slice=25)
    assert sorted(map(tuple, v.split_runs(cut).collect())) == sorted(map(tuple, want))
    assert v.split_runs(discover(log.limit(0), together=True)).count() == 0
