"""Walks of many models, templates and long subjects, replay points, delivered batches."""

import random

import pytest
from pyspark.sql import functions as F

from trailweave.operators import conformance, explore, machine
from trailweave.operators.machine import Edge, Model, Node
from trailweave.operators.ordering import Slices
from trailweave.streaming.tail import BatchTable, HighWater, live_cells, merged_cells, strict_batch

LIFT = Model(
    "lift", (Node("still", "Still", start=True), Node("up"), Node("oiled", start=True), Node("down", end=True)),
    (Edge("1", "raise", "still", "up"), Edge("2", "raise", "up", "up"), Edge("3", "lower", "up", "down"),
     Edge("4", "raise", "down", "up"), Edge("5", "oil", "oiled", "still", "once"), Edge("6", "oil", "down", "down", "once")),
)


def log_of(spark, sequences):
    rows = [(f"{i:06d}-{subject}", "s", f"/lifts/{subject}", kind, None, None)
            for subject, kinds in sequences.items() for i, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "id string, source string, subject string, type string, time string, data string")


def walk(model, kinds):
    """Every attempt: (good, passed events, -order, visited nodes)."""
    tries = []
    starts = [n.id for n in model.nodes if n.start]
    for order, start in enumerate(starts):
        at, path, seen, failed = start, [start], set(), False
        for kind in kinds:
            edge = next((e for e in model.edges if e.source == at and e.type == kind), None)
            if edge is None or (edge.cardinality == "once" and kind in seen):
                failed = True
                break
            if edge.cardinality == "once":
                seen.add(kind)
            at = edge.target
            path.append(at)
        good = not failed and any(n.id == at and n.end for n in model.nodes)
        tries.append((good, 0 if good else len(path) - 1, -order, path))
    return max(tries)


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(9)
    made = {f"a{i}": rng.choices(["raise", "lower", "oil"], [5, 3, 1], k=rng.randint(1, 12)) for i in range(60)}
    made["long"] = ["raise", "lower"] * 40 + ["oil"] + ["raise", "lower"] * 20 + ["oil", "raise"]
    made["fine"] = ["oil"] + ["raise", "raise", "lower"] * 30
    return made


@pytest.mark.parametrize("block", [machine.BLOCK, 3])
def test_path_rows(spark, monkeypatch, sequences, block):
    """With blocks of three events and groups of three blocks the path is the same."""
    monkeypatch.setattr(machine, "BLOCK", block)
    log = log_of(spark, sequences)
    rows = machine.check_log_path(log, machine.machine_of(spark, LIFT), Slices()).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["subject"], r["pos"])):
        path = found.setdefault(r["subject"].removeprefix("/lifts/"), [])
        assert r["pos"] == len(path)
        path.append(r["node"])
    assert found == {name: walk(LIFT, kinds)[3] for name, kinds in sequences.items()}


@pytest.mark.parametrize(("block", "grid"), [(machine.BLOCK, machine.GRID), (3, 0)])
def test_many_models(spark, monkeypatch, sequences, block, grid):
    """Models by key, dense or sparse, give the verdicts of one model at a time."""
    monkeypatch.setattr(machine, "BLOCK", block)
    log = log_of(spark, sequences)
    other = Model("other", (Node("x", start=True),), (Edge("1", "raise", "x", "x"), Edge("2", "raise", "x", "y")))
    models = [machine.model_tables(spark, m) for m in (LIFT, other)]
    monkeypatch.setattr(machine, "GRID", grid)
    machines = machine.compile_machine(models[0][0].unionByName(models[1][0]), models[0][1].unionByName(models[1][1]))
    pairs = machines.select("model_id").crossJoin(log.select("subject").distinct())
    columns = ["model_id", "subject", "length", "ok", "fail_ix", "reason", "end_node"]
    found = sorted(map(tuple, machine.check_many(log, machines, pairs).select(columns).collect()))
    monkeypatch.undo()
    alone = []
    for model in (LIFT, other):
        alone += machine.check_log(log, machine.machine_of(spark, model)).select(columns).collect()
    assert found == sorted(map(tuple, alone))


def test_large_model_stays_small(spark):
    """A ring of 2,000 states with as many types: megabytes as a grid, its edges as rows of moves."""
    n = 2000
    model = Model("ring", tuple(Node(f"n{i}", start=i == 0) for i in range(n)),
                  tuple(Edge(f"e{i}", f"t{i}", f"n{i}", f"n{(i + 1) % n}") for i in range(n)))
    compiled = machine.machine_of(spark, model).cache()
    row = compiled.select("jump", F.length(F.to_json("moves")).alias("bytes")).first()
    assert row["jump"] is None and row["bytes"] < 1_000_000
    log = log_of(spark, {"ok": [f"t{i}" for i in range(n)] + ["t0"], "bad": ["t0", "t1", "t5"]})
    found = {r["subject"]: r for r in machine.check_log(log, compiled).collect()}
    assert found["/lifts/ok"]["ok"] and found["/lifts/ok"]["end_node"] == "n1"
    assert found["/lifts/bad"]["fail_ix"] == 2
    assert machine.transitions(compiled).count() == n


@pytest.mark.parametrize("block", [conformance.BLOCK, 3])
def test_many_templates(spark, monkeypatch, sequences, block):
    """All templates at once say what each says alone, also for subjects of many blocks."""
    monkeypatch.setattr(conformance, "BLOCK", block)
    log = log_of(spark, sequences).unionByName(log_of(spark, {"b": ["raise"]}).withColumn("subject", F.lit("/other/77/parts")))
    templates = {
        "t1": ("/lifts/{id}", ["raise", "lower", "oil"]), "t2": ("/lifts/long", ["raise", "lower", "raise"]), "t3": ("", ["oil"]),
        "t4": ("/other/{id}/parts", ["raise"]), "t5": ("/none/{id}", ["raise"]), "t6": ("/{id}/{id}", ["lower", "lower"]),
    }
    rows = [(t, "p", scope, i, kind) for t, (scope, kinds) in templates.items() for i, kind in enumerate(kinds)]
    table = conformance.template_table(spark.createDataFrame(
        rows, "template_id string, process string, subject_pattern string, pos int, type string"))
    found = sorted(map(tuple, conformance.check_templates(log, table).collect()), key=str)
    monkeypatch.undo()
    want = []
    for name, (scope, kinds) in templates.items():
        alone = conformance.template_check(log, conformance.Template("p", tuple(kinds), scope))
        want += [(name, *r) for r in map(tuple, alone.select(
            "subject", "length", "projected", "unexpected", "matched", "relevant", "conforming", "detail").collect())]
    assert found == sorted(want, key=str)
    assert {r[0] for r in found} == {"t1", "t2", "t3", "t4", "t6"}


@pytest.mark.parametrize("size", [7, 1000])
def test_replay_points(spark, sequences, size):
    log = log_of(spark, sequences)
    total = log.count()
    points = spark.createDataFrame([(x,) for x in (-3, 0, 1, 6, 7, 8, 50, 51, total - 1, total, total + 40)], "events int")
    rows = explore.replay_points(log, points, size).collect()
    ordered = [r["type"] for r in log.orderBy("id").collect()]
    want = {(max(e, 0), kind): ordered[: max(e, 0)].count(kind) for e, in points.collect() for kind in set(ordered)}
    assert {(r["events"], r["type"]): r["count"] for r in rows} == want and len(rows) == len(want)


def test_failed_batch_is_delivered_once(spark, tmp_path):
    """A batch that fails between sink and mark, and is tried again, appends no row twice."""
    out = BatchTable(spark, str(tmp_path / "out"), "id string, subject string, type string, time string, phase string")
    marks = HighWater(spark, str(tmp_path / "marks"))
    log = log_of(spark, {"x": ["raise", "lower", "oil"]})
    first, second = log.where("id < '000002'"), log.where("id >= '000001'")
    run = strict_batch(marks, out.write)
    record, marks.record = marks.record, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        run(first, 0)
    marks.record = record
    run(first, 0)
    run(second, 1)
    assert sorted(r["id"] for r in out.read().collect()) == ["000000-x", "000001-x", "000002-x"]
    out.compact(2)
    assert out.batches() == [1] and out.read().count() == 3
    assert BatchTable(spark, str(tmp_path / "none"), "id string").read().count() == 0


def test_cells_of_updates(spark):
    """Later states of a cell replace earlier ones; the more alarming phase leads on a tie."""
    rows = [("1", "/a", "placed", "2026-01-01T00:00:00Z"), ("2", "/a", "failed", "2026-01-01T00:00:10Z"), ("3", "/b", "placed", "2026-01-01T00:01:40Z"),
            ("4", "/b", "placed", "2027-01-01T00:00:00Z"), ("5", "/0", "placed", "2026-01-01T00:00:00Z"), ("6", "/a", "placed", None)]
    log = spark.createDataFrame(rows, "id string, subject string, type string, time string")
    low, high = 1767225600_000_000, 1767225700_000_000
    early = live_cells(log.where("id <= '2'"), low, high, ["/a", "/b"], 2)
    late = live_cells(log, low, high, ["/a", "/b"], 2)
    found = sorted(map(tuple, merged_cells(early.unionByName(late)).select("row", "col", "count", "phase", "min_id", "max_id").collect()))
    assert found == [(0, 0, 2, "error", "1", "2"), (1, 1, 2, "complete", "3", "4")]
