import json

import pytest

from trailweave.operators import machine as m
from trailweave.operators import relations as r
from trailweave.plans import views
from trailweave.session import small_table
from trailweave.sources import events, models, templates

MODEL = {
    "id": "parcel", "name": "Parcel", "subjectStyle": "/parcels/{id}",
    "nodes": [{"id": "idle", "label": "Idle", "start": True, "x": 1.5}, {"id": "sent", "label": ""}, {"id": "home", "label": "Home", "end": True}],
    "edges": [{"id": "e1", "type": "parcel-sent", "from": "idle", "to": "sent", "cardinality": "once"},
              {"id": "e2", "type": "parcel<home>", "from": "sent", "to": "home"}],
    "steps": [{"id": "s1", "kind": "event", "name": "parcel-sent", "fields": [
                  {"name": "weight", "type": "number", "required": True}, {"name": "size", "type": "enum", "enum": ["S", "L"]}]},
              {"id": "s2", "kind": "task", "name": "carry"}, {"id": "s3", "kind": "event", "name": "parcel<home>"}],
}


def revision_by_hand(model):
    import hashlib

    edges = []
    for e in model["edges"]:
        edge = {"Type": e["type"], "From": e["from"], "To": e["to"]}
        edges.append(edge | ({"Cardinality": e["cardinality"]} if e.get("cardinality") else {}))
    steps = [
        {"Name": s["name"], "Fields": [
            {"Name": f["name"], "Type": f["type"], "Format": f.get("format", ""), "Ref": f.get("ref", ""),
             "Required": f.get("required", False), "Enum": f.get("enum")} for f in s.get("fields", [])] or None}
        for s in model["steps"] if s["kind"] == "event"]
    text = json.dumps({"Edges": edges, "Events": steps}, separators=(",", ":"), ensure_ascii=False)
    text = text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    return hashlib.sha256(text.encode()).hexdigest()[:12]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("models")
    (folder / "parcel.json").write_text(json.dumps(MODEL, indent=1))
    return models.read_model_documents(spark, str(folder))


def test_read_events(spark, tmp_path):
    lines = ['{"id":"1","source":"s","subject":"/a","type":"t","time":"x","data":{"k":[1,{"b":null}]},"more":1}', "",
             '{"id":"2","source":"s","subject":"/b","type":"t","time":"x"}']
    (tmp_path / "log.ndjson").write_text("\n".join(lines))
    full = events.read_events(spark, str(tmp_path), with_payload=True).orderBy("id").collect()
    assert [json.loads(e["data"]) if e["data"] else None for e in full] == [{"k": [1, {"b": None}]}, None]
    assert events.read_events(spark, str(tmp_path)).columns == events.EVENT_COLUMNS
    (tmp_path / "bad.ndjson").write_text("{oops\n")
    with pytest.raises(Exception):
        events.read_events(spark, str(tmp_path)).collect()


def test_sinks(spark, tmp_path):
    log = small_table(spark, [("1", "s", 'a"b', "t", "2026", '{"x":1}'), ("2", "s", "/b", "u", "", "")],
                      "id string, source string, subject string, type string, time string, data string")
    events.write_cloudevents(events.cloudevents(log, "me", "/_test"), str(tmp_path / "out"))
    got = sorted((json.loads(row["value"]) for row in spark.read.text(str(tmp_path / "out")).collect()), key=lambda e: e["type"])
    assert got[0]["subject"] == '/_testa"b' and got[0]["data"] == {"x": 1} and got[1]["data"] == {}
    assert got[0]["specversion"] == "1.0" and got[0]["id"] != got[1]["id"]
    events.export_replay(log, str(tmp_path / "replay"))
    assert {row["s"] for row in spark.read.json(str(tmp_path / "replay")).collect()} == {'a"b', "/b"}
    events.write_log(log, str(tmp_path / "log"))
    assert events.read_events(spark, str(tmp_path / "log"), True, "parquet").count() == 2


def test_model_tables(documents, spark):
    assert [x["node_id"] for x in models.model_nodes(documents).orderBy("pos").collect()] == ["idle", "sent", "home"]
    assert [x["cardinality"] for x in models.model_edges(documents).orderBy("pos").collect()] == ["once", ""]
    fields = models.model_fields(documents)
    assert [x["name"] for x in fields.orderBy("pos").collect()] == ["weight", "size"]
    shaped = models.fields_by_type(fields, "parcel").collect()
    assert [f["name"] for f in shaped[0]["fields"]] == ["weight", "size"]
    machine = m.compile_machine(models.model_nodes(documents), models.model_edges(documents))
    assert m.transitions(machine).count() == 2


def test_revision_and_drift(spark, documents, tmp_path):
    revisions = models.model_revision(documents)
    assert revisions.first()["revision"] == revision_by_hand(MODEL)
    suite = {"id": "s", "name": "S", "draftId": "parcel", "draftRev": "000000000000", "cases": [
        {"id": "c1", "name": "ok", "steps": [{"type": "parcel-sent", "data": {"w": 1}}, {"type": "parcel<home>"}],
         "expect": {"outcome": "accept", "endState": "home"}}, {"id": "c2", "name": "none", "expect": {"outcome": "reject"}}]}
    (tmp_path / "a.json").write_text(json.dumps(suite))
    (tmp_path / "b.json").write_text(json.dumps(suite | {"id": "t", "draftRev": ""}))
    suites, cases = models.read_suites(spark, str(tmp_path))
    drifted = {x["suite_id"]: x["drifted"] for x in models.drift(suites, revisions).collect()}
    assert drifted == {"s": True, "t": False}
    from trailweave.operators import conformance as c

    nodes, edges = models.model_nodes(documents), models.model_edges(documents)
    run = c.run_suite(cases, m.compile_machine(nodes, edges), nodes).where("suite_id = 's'").orderBy("pos").collect()
    assert [(x["passed"], x["walked"]) for x in run] == [(True, "Idle → sent → Home"), (False, "")]


BPMN = """<?xml version="1.0"?>
<definitions xmlns="http://www.omg.org/spec/BPMN/20100524/MODEL">
 <process id="brew">
  {pools}
  <task id="mill" name="mill the malt"/><userTask id="taste" name="taste"/>
  {begin}
  <intermediateCatchEvent id="boil" name="wort-boiled"/>
  <intermediateThrowEvent id="skim" name="skimmed"/>
  <parallelGateway id="split"/>
  <endEvent id="done" name="barrel-filled"/>
  <sequenceFlow sourceRef="go" targetRef="mill"/><sequenceFlow sourceRef="mill" targetRef="split"/>
  <sequenceFlow sourceRef="split" targetRef="boil"/><sequenceFlow sourceRef="split" targetRef="skim"/>
  <sequenceFlow sourceRef="boil" targetRef="taste"/><sequenceFlow sourceRef="taste" targetRef="{next}"/>
 </process>
 {team}
</definitions>"""


def test_templates(spark, tmp_path):
    pools = '<laneSet><lane name=""/><lane name="{}"/></laneSet>'
    team = '<collaboration><participant name="ale" processRef="brew"/></collaboration>'
    drafts = {
        "straight": dict(pools=pools.format("vats"), team=team, begin='<startEvent id="go" name="grain-in"/>', next="done"),
        "circle": dict(pools=pools.format("/cellars/77/vats"), team=team, begin='<startEvent id="go" name="grain-in"/>', next="boil"),
        "unnamed": dict(pools="", team="", begin='<sendTask id="go"/>', next="done"),
    }
    for name, parts in drafts.items():
        (tmp_path / f"{name}.bpmn").write_text(BPMN.format(**parts))
    rows = templates.read_templates(spark, str(tmp_path)).orderBy("template_id", "pos").collect()
    got: dict = {}
    for row in rows:
        got.setdefault((row["template_id"], row["process"], row["subject_pattern"]), []).append(row["type"])
    assert got == {
        ("straight", "ale", "/vats/{id}/ale"): ["grain-in", "wort-boiled", "barrel-filled"],
        ("circle", "ale", "/cellars/{id}/vats"): ["grain-in", "wort-boiled"], ("unnamed", "brew", ""): ["wort-boiled", "barrel-filled"]}


def refs(spark, rows):
    return small_table(spark, [(f"{i:03d}", "s", *row) for i, row in enumerate(rows)],
                       "id string, source string, subject string, type string, data string")


def test_reference_graph(spark):
    """A harbour: single fields point n:1, lists 1:n; own ids, broken texts and other JSON point nowhere."""
    voyage, other = "/voyages/31", "/voyages/33"
    log = refs(spark, [
        (voyage, "torn", '{"vesselRef":'), (other, "blank", None), (other, "bare", '["vesselRef"]'), ("/vessels/v9", "launched", "{}"),
        ("/voyages/32", "sailed", '{"id":"32","vesselRef":"v9"}'), (voyage, "moored", '{"voyageId":"31"}'),
        (voyage, "loaded", '{"crateIds":["k","m"]}'), (voyage, "sailed", '{"vesselRef":"v9"}'), (other, "noted", '{"memoRef":"{late"}')])
    graph = r.References(log)
    edges = {e["via"]: (e["from"], e["to"], e["kind"], e["count"]) for e in graph.edges().collect()}
    assert edges == {"vesselRef": ("voyages", "vessels", "n:1", 2), "crateIds": ("voyages", "crate", "1:n", 1),
                     "memoRef": ("voyages", "memo", "n:1", 1)}
    nodes = graph.nodes().collect()
    assert {n["name"]: n["events"] for n in nodes if n["known"]} == {"voyages": 8, "vessels": 1}
    assert {n["name"] for n in nodes if not n["known"]} == {"crate", "memo"}


def test_association(spark):
    """An event about two known collections joins them n:m: its first two reference fields by name."""
    log = refs(spark, [("/vessels/v9", "launched", None), ("/berths/b4", "built", None),
                       ("/bookings/5", "berth-vessel-linked", '{"zoneRefs":[],"vesselId":"v9","berthId":"b4"}')])
    (edge,) = r.References(log).edges().collect()
    assert {edge["from"], edge["to"]} == {"berths", "vessels"} and (edge["kind"], edge["via"]) == ("n:m", "berth-vessel-linked")


def test_payload_references_at_any_depth(spark):
    log = refs(spark, [
        ("/a", "t", '{"userId" : "u1", "x": {"y": [{"orderRef":"o\\"1","n":"userId"}]}, "tagIds":["t1"], "id":"z", "petId":"", "say":"\\"fakeId\\":\\"v\\""}'),
        ("/a", "t", '{"\\u0075serId":"esc"}'), ("/a", "t", '{broken "userId":"u"'), ("/a", "t", None)])
    got = sorted((row["field"], row["ref_subject"]) for row in r.payload_references(log).collect())
    assert got == [("orderRef", '/orders/o"1'), ("userId", "/users/esc"), ("userId", "/users/u1")]


def test_long_payload_text(spark):
    """Texts of any length are scanned whole."""
    log = refs(spark, [("/a", "t", '{"blob":"' + "ab\\\\n" * 200_000 + '","lastId":"end"}')])
    assert [row["ref_subject"] for row in r.payload_references(log).collect()] == ["/lasts/end"]


def test_subject_tree(spark):
    log = refs(spark, [(s, "t", "{}") for s in ["/o/1/items/1", "/o/2/items/1", "/o/1", "o//EMP-77/", "/x"]])
    tree, _, _ = views.relations_view(log)
    got = {t["path"]: (t["events"], t["instances"], t["place"]) for t in tree.collect()}
    assert got == {"/o": (4, 0, 1), "/x": (1, 0, 2), "/o/{id}": (4, 3, 1), "/o/{id}/items": (2, 0, 1), "/o/{id}/items/{id}": (2, 1, 1)}
