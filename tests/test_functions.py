import pytest
from pyspark.sql import functions as F

from trailweave.functions import lifecycle, paths, predicates, text


def values(spark, expr, items, schema="x string"):
    from trailweave.session import small_table

    df = small_table(spark, [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(items)], "row int, " + schema)
    return [r[0] for r in df.orderBy("row").select(expr).collect()]


def test_phase_and_task(spark):
    given = ["shipping.started", "shipping.completed", "shipping.failed", "order-payment-failed", "order-status-updated",
             "order-placed", "cancelled", "Ship.Failed", ".failed", "failed.", "a/b_done", ""]
    assert values(spark, lifecycle.phase(F.col("x")), given) == [
        "active", "complete", "error", "error", "info", "complete", "error", "error", "complete", "complete", "complete", "complete"]
    assert values(spark, lifecycle.task(F.col("x")), given) == [
        "shipping", "shipping", "shipping", "order-payment", "order-status", "order-placed", "cancelled", "Ship", ".failed",
        "failed.", "a/b", ""]


def test_is_id(spark):
    given = {"1234": True, "": False, "orders": False, "550e8400-e29b-41d4-a716-446655440000": True, "deadbeefdeadbeef": True,
             "deadbeef": False, "abcdefghijk1": True, "abcdefghijkl": False, "EMP-30000": True, "order_123": True, "a-1": False,
             "new-order": False, "12\n": False, None: False}
    assert values(spark, paths.is_id(F.col("x")), list(given)) == list(given.values())


def test_patterns(spark):
    assert values(spark, paths.subject_pattern(F.col("x")), ["/orders/1/items/2", "orders//EMP-30000/", "/", "/identity/1234"]) == [
        "/orders/{id}/items/{id}", "/orders/{id}", "/", "/identity/{id}"]
    pairs = [("/e/EMP-1/on", "/e/{id}/on"), ("/e/EMP-1", "/e/{id}/on"), ("/x/1/on", "/e/{id}/on"), ("/e/anything/on/", "e/{id}/on")]
    assert values(spark, paths.matches_pattern(F.col("a"), F.col("b")), pairs, "a string, b string") == [True, False, False, True]
    assert values(spark, paths.scope_prefix(F.col("x")), ["/employees/{id}/on", "/{id}", "/a/b", ""]) == ["/employees", "", "/a/b", ""]
    scopes = [("employees", "employee-onboarding"), ("/identity/1234", "p"), (" ", "p"), ("staff", "")]
    assert values(spark, paths.subject_scope(F.col("a"), F.col("b")), scopes, "a string, b string") == [
        "/employees/{id}/employee-onboarding", "/identity/{id}", "", "/staff/{id}"]
    assert values(spark, paths.style_prefix(F.col("x")), ["/orders/{id}", " /orders/ord-{id} ", "/a/", ""]) == ["/orders", "/orders", "/a", ""]


def test_references(spark):
    given = ["customerId", "tagIds", "productRef", "id", " employeeId ", "valid", "addressRefs", "name", "", "refs"]
    assert values(spark, paths.reference_collection(F.col("x")), given) == [
        "customers", "tags", "products", None, "employees", "vals", "address", None, None, None]


def test_style_slug_prefix(spark):
    given = [("/orders/{id}", "7", "", ""), ("", "7", "Big Shop!", "n"), ("", "7", "", "Ünder score_x"), ("", "7", "", ""),
             ("a/{x}/{y}", "7", "", ""), ("/a/{open", "7", "", ""), ("/cost/{n}", "$1\\2", "", "")]
    expr = paths.apply_subject_style(F.col("s"), F.col("i"), F.col("ns"), F.col("n"))
    assert values(spark, expr, given, "s string, i string, ns string, n string") == [
        "/orders/7", "/big-shop/7", "/nder-score-x/7", "/entity/7", "/a/7/7", "/a/", "/cost/$1\\2"]
    assert values(spark, paths.slugify(F.col("x")), ["  Hello,  World/2 ", "--a--", "a!b", ""]) == ["hello-world-2", "a", "ab", ""]
    sets = [("/o/1", "/o/1", 1), ("/o/1/a", "/o/2/b", 2), ("/a", "/b", 2), ("/orders/10", "/orders/19", 3), ("", "/x", 2)]
    expr = paths.common_path_prefix(F.col("a"), F.col("b"), F.col("n"))
    assert values(spark, expr, sets, "a string, b string, n int") == ["/o/1", "/o", "", "/orders", ""]


def test_text(spark):
    assert values(spark, text.parse_sequence(F.col("x")), ["a → b, c\nd", " ,, ", "x->y"]) == [["a", "b", "c", "d"], [], ["x", "y"]]
    times = ["2026-01-01T09:00:00Z", "2026-01-01", "2026-02-30T00:00:00Z", "2026-01-01T09:00:00.123456789+02:00", "x", None,
             "2026-01-01T09:00:00Z\n"]
    assert [v is not None for v in values(spark, text.rfc3339(F.col("x")), times)] == [True, False, False, True, False, False, False]
    assert values(spark, text.pct(F.col("a"), F.col("b")), [(1, 3), (2, 3), (5, 0), (3, 3)], "a long, b long") == [33, 66, 0, 100]
    assert values(spark, text.is_email(F.col("x")), ["a@b.c", "a@b", "a b@c.d"]) == [True, False, False]
    labels = [(["a"], 1, "a", 3), (["a", "b", "c"], 4, "d", 1), ([], 0, None, 2)]
    expr = text.variant_label(F.col("s"), F.col("n"), F.col("z"), F.col("m"))
    assert values(spark, expr, labels, "s array<string>, n long, z string, m long") == ["a · 3", "a → … → d (4) · 1", "— · 2"]
    assert values(spark, text.log_intensity(F.col("a"), F.col("b")), [(1, 1), (0, 0), (1, 3)], "a long, b long") == [1.0, 1.0, 0.57]


def test_stage_rules(spark):
    rows = [("005", "s", "/orders/1", "created"), ("005", "s", "/orders", "created"), ("005", "s", "/orders2", "created"),
            ("005", "s", "/orders/1", "other"), ("000", "s", "/orders/1", "created"), ("020", "s", "/orders/1", "created")]
    log = spark.createDataFrame(rows, "id string, source string, subject string, type string")
    stage = predicates.Stage(subject="orders", types=("created",), lower="001", upper="010")
    assert sorted(r["subject"] for r in log.where(stage.predicate()).collect()) == ["/orders", "/orders/1"]
    assert stage.label() == "subject orders · type created · from 001 · to 010"
    assert predicates.Stage().label() == "any"
    assert log.where(predicates.Stage(subject="/").predicate()).count() == 6
    nothing = predicates.SpaceFilter(nothing=True)
    assert log.where(nothing.predicate()).count() == 0
    assert log.where(predicates.SpaceFilter(nothing=True, types=("other",)).predicate()).count() == 1
    assert log.where(predicates.SpaceFilter(words=("ORDERS2",)).predicate()).count() == 1


@pytest.mark.parametrize("raw,n", [("", 0), ("all", 0), ("live", 1000), ("-50", 50), ("7", 7), ("x", 0)])
def test_frame_size(raw, n):
    from trailweave.operators.counts import frame_size

    assert frame_size(raw) == n


def test_pushdown(spark, tmp_path):
    from trailweave.sources import events

    log = spark.createDataFrame([("1", "s", "/a/1", "t", "", "{}")], events.EVENT_SCHEMA)
    events.write_log(log, str(tmp_path / "log"))
    read = events.read_events(spark, str(tmp_path / "log"), fmt="parquet")
    scoped = events.scan_scope(read, predicates.Stage(subject="/a", types=("t",), lower="0", source="s"))
    plan = scoped._jdf.queryExecution().explainString(scoped._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(subject,/a/)" in plan and "EqualTo(type,t)" in plan and "StringContains(source,s)" in plan
    assert "data" not in plan.split("ReadSchema:")[1].split("\n")[0]
