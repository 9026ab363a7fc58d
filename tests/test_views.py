"""Composed views and plans."""

from pyspark.sql import functions as F

from trailweave.functions.predicates import Stage, subject_prefix
from trailweave.operators import conformance as c
from trailweave.operators import counts, explore
from trailweave.operators import machine as m
from trailweave.operators.relations import referenced_events
from trailweave.plans import views
from trailweave.session import small_table
from trailweave.sources import events

BAKERY = m.Model(
    "loaf", (m.Node("flour", start=True), m.Node("dough"), m.Node("bread", end=True)),
    (m.Edge("1", "kneaded", "flour", "dough"), m.Edge("2", "baked", "dough", "bread"), m.Edge("3", "burnt", "dough", "flour")),
    subject_style="/ovens/north/loaf-{id}")


def test_model_view_judges_what_the_model_speaks_about(make_log):
    log = make_log({"/ovens/north/1": "kneaded baked", "/ovens/north/2": "kneaded sliced", "/ovens/south/1": "kneaded", "/x": "ghost"})
    view = views.model_view(log, BAKERY)
    assert tuple(view.fit.first()) == (2, 1, 50)
    assert [r["subject"] for r in view.deviations.collect()] == ["/ovens/north/2"]
    assert [r["type"] for r in view.unused.collect()] == ["burnt"] and [r["type"] for r in view.unknown.collect()] == ["sliced"]
    assert tuple(view.coverage.first()) == (2, 3, 66)
    everywhere = views.model_view(log, m.Model("loaf", BAKERY.nodes, BAKERY.edges))
    assert everywhere.fit.first()["subjects"] == 4


def test_template_view_falls_back_to_the_whole_log(make_log):
    log = make_log({"/beds/1/tulips": "dug planted", "/beds/2/tulips": "planted", "/sheds/1": "dug"})
    found = views.template_view(log, c.Template("tulips", ("dug", "planted"), "/beds/7/tulips"))
    assert tuple(found.summary.first()) == (2, 2, 2, 1, 50)
    missing = views.template_view(log, c.Template("roses", ("dug",), "/greenhouse/7/roses"))
    assert missing.summary.first()["total_subjects"] == 3 and missing.summary.first()["in_scope"] == 0
    assert [r["present"] for r in missing.presence.collect()] == [True]


def test_templates_from_rows(spark):
    rows = small_table(spark, [("t1", "p", "/a/{id}", 2, "y"), ("t1", "p", "/a/{id}", 0, "x"), ("t2", "q", "", 1, "z")],
                       "template_id string, process string, subject_pattern string, pos int, type string")
    assert views.templates_of(rows) == [c.Template("p", ("x", "y"), "/a/{id}"), c.Template("q", ("z",), "")]


def test_referenced_events(spark):
    rows = [("1", "/visits/1", "booked", '{"vetId":"v1","pet":{"petRef":"p"}}'), ("2", "/vets/v1", "hired", "{}"),
            ("3", "/vets/v1/rota", "set", "{}"), ("4", "/pets/p", "born", None), ("5", "/pets/q", "born", "{}"), ("6", "/vets/v10", "hired", "{}")]
    log = small_table(spark, rows, "id string, subject string, type string, data string")
    chosen = log.where("id = '1'")
    assert {r["id"] for r in referenced_events(log, chosen).collect()} == {"2", "4"}
    assert {r["id"] for r in referenced_events(log, chosen, subtree=True).collect()} == {"2", "3", "4"}


def test_failing_sequences(spark, make_log):
    log = make_log({"/a": "x y", "/b": "x " * 1200})
    verdicts = small_table(spark, [("/a", False, ""), ("/b", True, "bad")], "subject string, rejected boolean, reason string")
    rows = c.failing_sequences(verdicts, log).orderBy("block").collect()
    assert [(r["subject"], r["reason"], len(r["types"])) for r in rows] == [("/b", "bad", 1000), ("/b", "bad", 200)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan_of_a_written_log(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    events.write_log(make_log({f"/a/{i}": "x y" for i in range(20)}), path)
    log = events.read_events(spark, path, fmt="parquet")
    scoped = events.scan_scope(log, Stage(subject="/a/1", types=("x",), lower="00"))
    pushed = next(line for line in plan_of(scoped).splitlines() if "PushedFilters" in line).split("PushedFilters:")[1]
    assert "StringStartsWith(subject,/a/1/)" in pushed and "type,x" in pushed and "GreaterThanOrEqual(id" in pushed
    hit = counts.scoped_or_all(log, "/a/1")
    assert "StringStartsWith(subject,/a/1/)" in plan_of(hit).split("PushedFilters:")[1]
    assert hit.count() == 2 and counts.scoped_or_all(log, "/none").count() == 40
    assert log.where(subject_prefix("/a/1")).count() == 2


def test_lookups_skip_row_groups_of_a_written_log(spark, tmp_path):
    """Ids lie across all files, so their bounds cut nothing; the Bloom filters do."""
    path, n = str(tmp_path / "log"), 40_000
    log = spark.range(n).selectExpr(
        "lpad(cast(id as string), 12, '0') as id", "'app' as source", "concat('/users/', id % 800) as subject",
        "'clicked' as type", "'2024-01-01T00:00:00Z' as time")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of a small log
    try:
        events.write_log(log, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = len(list((tmp_path / "log").glob("*.parquet")))
    assert files > 2

    def rows_read(df):
        """Rows that the scan gave to the filter behind it, and rows found."""
        found = df.collect()
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return scan.metrics().apply("numOutputRows").value(), len(found)

    written = events.read_events(spark, path, fmt="parquet")
    for number in (0, 777, n - 1):
        read, found = rows_read(counts.event_lookup(written, "/", f"{number:012d}"))
        assert found == 1 and read < n / 2
    assert rows_read(counts.event_lookup(written, "/", "no such event")) == (0, 0)
    assert rows_read(written.where("subject = '/users/5'"))[1] == n // 800


def test_replay_looks_at_the_first_events_only(make_log):
    log = make_log({"/a": "x y x", "/b": "z"})
    got = explore.replay_at(log, 2)
    assert {(r["type"], r["count"]) for r in got.collect()} == {("x", 1), ("y", 1), ("z", 0)}
    assert "TakeOrdered" in plan_of(got) or "Limit" in plan_of(got)
    assert {r["count"] for r in explore.replay_at(log, 0).collect()} == {0}
    assert explore.replay_at(log, 99).agg(F.sum("count")).first()[0] == 4
