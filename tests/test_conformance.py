import random

import pytest
from pyspark.sql import functions as F

from trailweave.operators import conformance as c
from trailweave.operators import machine as m
from trailweave.operators import payload
from trailweave.session import small_table
from trailweave.operators.ordering import find_slices

ORDER = m.Model(
    "order",
    (m.Node("new", start=True), m.Node("placed"), m.Node("paid"), m.Node("shipped", end=True), m.Node("cancelled", end=True)),
    (m.Edge("1", "created", "new", "placed"), m.Edge("2", "paid", "placed", "paid"), m.Edge("3", "shipped", "paid", "shipped"),
     m.Edge("4", "cancelled", "placed", "cancelled")),
)
STARTS = m.Model(
    "starts", (m.Node("s1", start=True), m.Node("s2", start=True), m.Node("mid"), m.Node("fin", end=True)),
    (m.Edge("1", "other", "s1", "mid"), m.Edge("2", "go", "s2", "mid"), m.Edge("3", "done", "mid", "fin")),
)
ONCE = m.Model(
    "kiln", (m.Node("cold", start=True), m.Node("hot")),
    (m.Edge("k1", "lit", "cold", "hot", "once"), m.Edge("k2", "lit", "hot", "hot", "once"),
     m.Edge("k3", "stoked", "hot", "hot", "many"), m.Edge("k4", "glazed", "hot", "hot", "once")),
)
EMPTY = m.Model("empty")
NO_START = m.Model("nostart", (m.Node("a"),), (m.Edge("1", "x", "a", "a"),))
OFF_LIST = m.Model("off", (m.Node("a", start=True),), (m.Edge("1", "x", "a", "ghost"), m.Edge("2", "y", "ghost", "a")))

CASES = [
    (ORDER, "created paid shipped", True, -1), (ORDER, "created cancelled", True, -1), (ORDER, "", True, -1),
    (ORDER, "shipped", False, 0), (ORDER, "created shipped", False, 1), (ORDER, "created paid", False, 2),
    (STARTS, "go done", True, -1), (STARTS, "nope", False, 0), (STARTS, "go nope", False, 1),
    (ONCE, "lit stoked stoked stoked", True, -1), (ONCE, "lit lit", False, 1),
    (ONCE, "lit glazed glazed", False, 2), (EMPTY, "x", False, -1), (NO_START, "x", False, 0),
    (OFF_LIST, "x y x", True, -1), (OFF_LIST, "x x", False, 1),
]


@pytest.fixture(scope="module")
def judged(spark):
    models = {model.id: model for model, *_ in CASES}
    tables = [m.model_tables(spark, model) for model in models.values()]
    nodes, edges = tables[0]
    for more_nodes, more_edges in tables[1:]:
        nodes, edges = nodes.unionByName(more_nodes), edges.unionByName(more_edges)
    machines = m.compile_machine(nodes, edges)
    cases = small_table(spark, 
        [(model.id, i, seq.split()) for i, (model, seq, *_) in enumerate(CASES)], "model_id string, n int, steps array<string>")
    return {r["n"]: r for r in m.check_sequences(cases, machines).collect()}


@pytest.mark.parametrize("n", [i for i, case in enumerate(CASES) if case[0] is not EMPTY])
def test_sequences(judged, n):
    _, _, ok, fail_ix = CASES[n]
    assert (judged[n]["ok"], judged[n]["fail_ix"]) == (ok, fail_ix)


def test_reasons(judged):
    assert judged[0]["path"] == ["new", "placed", "paid", "shipped"]
    assert judged[3]["reason"] == 'no transition from state "new" via event type "shipped"'
    assert judged[5]["reason"] == 'sequence ends in non-terminal state "paid"'
    assert judged[10]["reason"] == 'event type "lit" may occur at most once per subject'
    assert judged[13]["reason"] == "model has no start state"


def test_model_fit(spark, make_log):
    log = make_log({"/o/1": "created paid", "/o/2": "created refunded"})
    open_end = m.Model("o", ORDER.nodes[:2] + (m.Node("paid", end=True),), ORDER.edges)
    checked = m.check_log(log, m.machine_of(spark, open_end), with_edges=True)
    assert tuple(c.model_fit(checked).first()) == (2, 1, 50)
    assert [r["type"] for r in c.unused_types(log, open_end).collect()] == ["shipped", "cancelled"]
    assert [r["type"] for r in c.unknown_types(log, open_end).collect()] == ["refunded"]
    assert tuple(c.edge_coverage(checked, open_end).first()) == (2, 4, 50)
    bad = make_log({f"/o/{i}": "shipped" for i in range(25)})
    checked = m.check_log(bad, m.machine_of(spark, ORDER))
    assert c.model_fit(checked).first()["subjects"] == 25 and c.model_deviations(checked).count() == 20


def brute(model, seq):
    """Plain walk, to check the blockwise one."""
    best = (-2, None)
    ends = {n.id for n in model.nodes if n.end}
    for start in [n.id for n in model.nodes if n.start]:
        cur, seen, fail = start, set(), None
        for i, t in enumerate(seq):
            edge = next((e for e in model.edges if e.source == cur and e.type == t), None)
            if edge is None or (edge.cardinality == "once" and t in seen):
                fail = i
                break
            if edge.cardinality == "once":
                seen.add(t)
            cur = edge.target
        if fail is None and ends and cur not in ends:
            fail = len(seq)
        if fail is None:
            return True, -1
        if fail > best[0]:
            best = (fail, None)
    return False, best[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_compose(spark, make_log, monkeypatch, seed):
    """Walking in blocks of five, over cut subjects, equals walking in one go."""
    monkeypatch.setattr(m, "BLOCK", 5)
    rng = random.Random(seed)
    names = ["n0", "n1", "n2", "n3"]
    model = m.Model(
        "r", tuple(m.Node(n, start=i < 2, end=i > 1) for i, n in enumerate(names)),
        tuple(m.Edge(str(k), t, a, rng.choice(names), "once" if rng.random() < 0.15 else "")
              for k, (a, t) in enumerate((a, t) for a in names for t in "abcd" if rng.random() < 0.97)),
    )
    made = {f"/s/{i}": " ".join(rng.choice("aabbccd") for _ in range(rng.randint(1, 40))) for i in range(60)}
    log = make_log(made)
    want = {s: brute(model, t.split()) for s, t in made.items()}
    for slices in (None, find_slices(log, rows_per_slice=7)):
        got = {r["subject"]: (r["ok"], r["fail_ix"]) for r in m.check_log(log, m.machine_of(spark, model), slices).collect()}
        assert got == want


def test_template(spark, make_log):
    p = "identity.employee."
    log = make_log({
        "/e/1": f"{p}new {p}created {p}mailbox.attached {p}deployed", "/e/2": f"{p}new {p}created",
        "/e/3": f"{p}new {p}created {p}suspended {p}mailbox.attached {p}deployed", "/other/1": "unrelated"})
    template = c.Template("t", tuple(p + s for s in ("new", "created", "mailbox.attached", "deployed")))
    checked = c.template_check(log, template).cache()
    summary = c.template_summary(log, checked).first()
    assert (summary["relevant"], summary["conforming"], summary["fit_pct"]) == (3, 1, 33)
    assert [r["seen"] for r in c.step_coverage(checked, template).orderBy("step").collect()] == [3, 3, 2, 2]
    assert p + "suspended" in {r["type"] for r in c.unexpected_types(log, template).collect()}
    details = {r["subject"]: r["detail"] for r in c.template_deviations(checked).collect()}
    assert details == {"/e/2": f"stopped at step 3/4 — missing “{p}mailbox.attached”",
                       "/e/3": "all steps in order, but 1 unexpected event(s)"}


@pytest.mark.parametrize("subject,subjects", [
    ("/identity/{id}", {"/identity/1": "a b", "/identity/2": "a", "/orders/9": "a b"}),
    ("/employees/{id}/on", {"/employees/42/on": "a b", "/employees/EMP-30001/on": "a", "/employees/43": "a b"}),
])
def test_template_scope(make_log, subject, subjects):
    checked = c.template_check(make_log(subjects), c.Template("t", ("a", "b"), subject))
    assert checked.where("relevant").count() == 2 and checked.where("conforming").count() == 1


def test_extra_steps(make_log):
    checked = c.template_check(make_log({"/s": "a b b"}), c.Template("t", ("a", "b")))
    assert checked.first()["detail"] == "all steps seen but with extra/repeated events"


FIELDS = m.Model("p", fields=tuple(("t", f) for f in (
    m.Field("id", "string", required=True, format="uuid"), m.Field("mail", "string", format="email"), m.Field("n", "integer"),
    m.Field("x", "number"), m.Field("flag", "boolean"), m.Field("state", "enum", enum=("on", "off")), m.Field("at", "datetime"),
    m.Field("when", "string", format="date-time"), m.Field("who", "reference"), m.Field("odd", "string", format="odd", enum=("a",)),
    m.Field("  "), m.Field("a.b", "number"),
)))
GOOD = '"id":"550e8400-e29b-41d4-a716-446655440000"'
PAYLOADS = [
    ("{" + GOOD + ',"mail":"a@b.c","n":1.0,"x":2.5,"flag":true,"state":"on","at":"2026-01-01T00:00:00Z","odd":"b","more":[1]}', []),
    ("{}", [("id", "required")]), ('{"id":null}', [("id", "required")]), ("", [("id", "required")]), ("null", [("id", "required")]),
    ('{"id":"x"}', [("id", "format")]), ('{"id":5}', [("id", "type")]), ("{" + GOOD + ',"mail":"nope"}', [("mail", "format")]),
    ("{" + GOOD + ',"n":"1"}', [("n", "type")]), ("{" + GOOD + ',"n":1.5}', [("n", "type")]), ("{" + GOOD + ',"x":"1"}', [("x", "type")]),
    ("{" + GOOD + ',"flag":"true"}', [("flag", "type")]), ("{" + GOOD + ',"state":"dim"}', [("state", "enum")]),
    ("{" + GOOD + ',"state":1}', [("state", "type")]), ("{" + GOOD + ',"at":"2026-01-01"}', [("at", "format")]),
    ("{" + GOOD + ',"at":1}', [("at", "type")]), ("{" + GOOD + ',"when":"soon"}', [("when", "format")]),
    ("{" + GOOD + ',"who":{}}', [("who", "type")]), ("[1]", [("", "type")]), ('"text"', [("", "type")]), ("7", [("", "type")]),
    ("{" + GOOD + ',"a.b":"x"}', [("a.b", "type")]), ("{" + GOOD + ',"n":1e3,"x":null}', []),
]


def test_payloads(spark):
    rows = [(str(i), "/s/1", "t", data) for i, (data, _) in enumerate(PAYLOADS)] + [("bad", "/s/2", "t", "{oops"), ("free", "/s/3", "u", "{}")]
    log = small_table(spark, rows, "id string, subject string, type string, data string")
    table = payload.field_table(spark, FIELDS)
    got: dict = {}
    for r in payload.validate_payload(log, table).collect():
        got.setdefault(r["id"], []).append((r["field"], r["rule"]))
    assert {str(i): want for i, (_, want) in enumerate(PAYLOADS) if want} == got
    assert [r["id"] for r in payload.invalid_payloads(log).collect()] == ["bad"]
    assert payload.payload_faults(log, table).where("id = 'bad'").count() == 1
    strict = payload.validate_payload(log.where("id = '0'"), table, strict_enum=True).collect()
    assert [(r["field"], r["rule"]) for r in strict] == [("odd", "enum")]


def test_suite_and_verdicts(spark, make_log):
    nodes, edges = m.model_tables(spark, ORDER)
    machines = m.compile_machine(nodes, edges)
    cases = small_table(spark, [
        ("order", "a", "created paid shipped".split(), "accept", "shipped"), ("order", "b", "created cancelled".split(), "accept", "shipped"),
        ("order", "c", ["paid"], "reject", ""), ("order", "d", "created cancelled".split(), "reject", ""), ("order", "e", [], "accept", ""),
        ("order", "f", ["paid"], "accept", "")], "model_id string, case_id string, steps array<string>, outcome string, end_state string")
    got = {r["case_id"]: (r["passed"], r["detail"]) for r in c.run_suite(cases, machines, nodes).collect()}
    assert got["a"] == (True, "valid walk") and got["e"] == (True, "valid walk")
    assert got["b"] == (False, "ended in cancelled, expected shipped")
    assert got["c"] == (True, 'correctly rejected — no transition from state "new" via event type "paid"')
    assert got["d"] == (False, "expected rejection, but the sequence is a valid walk")
    assert got["f"][0] is False
    log = make_log({"/o/1": "created cancelled", "/o/2": "paid", "/o/3": "created cancelled"}).withColumn(
        "data", F.when(F.col("subject") == "/o/3", "{oops").otherwise("{}"))
    verdicts = c.stream_verdict(m.check_log(log, m.machine_of(spark, ORDER)), payload.payload_faults(log, payload.field_table(spark, FIELDS)))
    reasons = {r["subject"]: (r["rejected"], r["reason"]) for r in verdicts.collect()}
    assert reasons["/o/1"] == (False, "") and reasons["/o/3"] == (True, "payload rejected") and reasons["/o/2"][0]


def test_round_trip(spark, make_log):
    written = make_log({"/t/1": "created cancelled", "/t/2": "created paid shipped"})
    back = written.where("NOT (subject = '/t/2' AND type = 'shipped')")
    row = c.round_trip(written, back, m.machine_of(spark, ORDER)).first()
    assert tuple(row) == (5, 2, 4, 2, 1)
    assert [tuple(r) for r in c.round_trip_differences(written, back).collect()] == [("/t/2", 3, "shipped", "missing")]
