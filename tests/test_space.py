import math
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from trailweave.functions.predicates import SpaceFilter, Stage
from trailweave.operators import counts, space
from trailweave.plans import views
from trailweave.session import small_table

SCHEMA = "id string, source string, subject string, type string, time string, data string"


def timed(spark, rows):
    return small_table(spark, [(i, "src", s, t, at, "{}") for i, s, t, at in rows], SCHEMA)


def test_grid_by_time(spark):
    log = timed(spark, [("a", "/o/1", "placed", "2026-01-01T09:00:00Z"), ("b", "/o/2", "placed", "2026-01-01T10:00:00Z"),
                        ("c", "/o/1", "paid", "2026-01-01T11:00:00Z")])
    placed, bands = space.axis(log), space.subject_bands(log)
    assert placed.by_time and placed.events == 3
    cells = space.density(placed, bands, cols=2).collect()
    assert {r["col"] for r in cells} == {0, 1} and sum(r["count"] for r in cells) == 3
    assert [r["subjects"] for r in bands.orderBy("band").collect()] == [1, 1]


def test_leading_phase_and_id_bounds(spark):
    log = timed(spark, [("m", "/o/1", "ship.completed", ""), ("z", "/o/1", "ship.failed", ""), ("a", "/o/1", "ship.failed", "")])
    cell = space.density(space.axis(log), space.subject_bands(log), cols=1).first()
    assert (cell["count"], cell["phase"], cell["min_id"], cell["max_id"]) == (3, "error", "a", "z")
    tie = timed(spark, [("1", "/o", "x.failed", ""), ("2", "/o", "x.completed", ""), ("3", "/o", "x.updated", ""), ("4", "/o", "x.updated", ""),
                        ("5", "/o", "x.started", ""), ("6", "/o", "x.started", "")])
    assert space.dominant_phase(tie, "subject").first()["phase"] == "active"


def test_axis_falls_back_to_order(spark):
    same = timed(spark, [("1", "/a", "t", "2026-01-01T09:00:00Z"), ("2", "/b", "t", "2026-01-01T09:00:00Z")])
    bad = timed(spark, [("1", "/a", "t", "2026-01-01T09:00:00Z"), ("2", "/b", "t", "soon")])
    for log in (same, bad):
        placed = space.axis(log)
        assert not placed.by_time and (placed.low, placed.high) == (0, 1)
        assert [r["x"] for r in space.dotted_points(placed).orderBy("id").collect()] == [0.0, 1.0]
    single = space.dotted_points(space.axis(timed(spark, [("1", "/a", "t", "2026-01-01T09:00:00Z")])))
    assert single.first()["x"] == 0.0


def test_bands_are_near_equal(spark):
    names = [f"/s/{n:03d}" for n in range(23)]
    log = timed(spark, [(f"{i:03d}", s, "t", "") for i, s in enumerate(names)])
    bands = space.subject_bands(log, 5).orderBy("band").collect()
    assert [r["subjects"] for r in bands] == [5, 5, 5, 4, 4]
    assert bands[0]["label"] == "/s/000 … /s/004 · 5" and (bands[0]["from"], bands[0]["to"], bands[0]["prefix"]) == ("/s/000", "/s/004", "/s")
    assert space.subject_bands(log, 40).count() == 23


def brute_grid(rows, bands, cols):
    stamps = [datetime.fromisoformat(t.replace("Z", "+00:00")).timestamp() for *_, t in rows]
    low, span = min(stamps), max(stamps) - min(stamps)
    grid = {}
    for (_, subject, _, _), at in zip(rows, stamps):
        row = next(i for i, (a, b) in enumerate(bands) if a <= subject <= b)
        col = min(cols - 1, math.floor((at - low) / span * cols))
        grid[row, col] = grid.get((row, col), 0) + 1
    return grid


def test_grid_against_brute_force(spark):
    rng, begin = random.Random(3), datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(600):
        subject = "/s/hot" if rng.random() < 0.4 else f"/s/{rng.randint(0, 200):03d}"
        rows.append((f"{i:05d}", subject, rng.choice(["a", "b.failed"]), (begin + timedelta(seconds=rng.randint(0, 99999))).strftime("%Y-%m-%dT%H:%M:%SZ")))
    log = timed(spark, rows)
    bands = space.subject_bands(log, 12)
    limits = [(r["from"], r["to"]) for r in bands.orderBy("band").collect()]
    cells = space.density(space.axis(log), bands, cols=17)
    assert {(r["row"], r["col"]): r["count"] for r in cells.collect()} == brute_grid(rows, limits, 17)
    listed = space.drill(cells, bands, log).groupBy("row", "col").count()
    inside = {(r["row"], r["col"]): r["count"] for r in listed.collect()}
    for cell in cells.collect():
        a, b = limits[cell["row"]]
        want = sum(a <= s <= b and cell["min_id"] <= i <= cell["max_id"] for i, s, *_ in rows)
        assert inside[cell["row"], cell["col"]] == want
        one = log.where(space.cell_filter(cell["min_id"], cell["max_id"], a, b)).count() if cell["row"] == 3 else want
        assert one == want


def test_variant_bands_keep_everything(spark):
    rows, n = [], 0
    for s in range(30):
        for t in "ab" * (s % 7 + 1):
            rows.append((f"{n:05d}", f"/v/{s:02d}", t, ""))
            n += 1
    log = timed(spark, rows)
    bands, member = space.variant_bands(log, 4)
    shown = bands.orderBy("band").collect()
    assert [r["subjects"] for r in shown] == [5, 5, 4, 16] and shown[3]["label"] == "+4 more variants · 16"
    assert shown[0]["label"] == "a → b · 5" and member.count() == 30
    assert space.density(space.axis(log), bands, member, 9).agg(F.sum("count")).first()[0] == len(rows)


def test_counts(spark):
    rows = [(f"{i:03d}", f"/s/{i % 4}", f"t{i % 17:02d}", "") for i in range(100)]
    log = timed(spark, rows)
    legend = counts.type_counts(log).collect()
    assert len(legend) == 15 and legend[-1]["type"] == "+3 more types" and sum(r["count"] for r in legend) == 100
    steps = counts.funnel(log, [Stage(types=("t00", "t01")), Stage(subject="/s/1")]).orderBy("stage").collect()
    assert [r["events"] for r in steps] == [100, 12, 4] and [r["subjects"] for r in steps] == [4, 4, 1]
    assert sorted(r["id"] for r in counts.last_n(log, 3).collect()) == ["097", "098", "099"]
    assert counts.event_lookup(log, "/s", "007").first()["phase"] == "complete"
    assert counts.inspect(log, subject="/s/1", cap=10).where("capped").count() == 10
    assert counts.scoped_or_all(log, "/none").count() == 100 and counts.scoped_or_all(log, "/s/2").count() == 25


def test_view_chooses_detail(spark):
    rows = [(f"{i:03d}", f"/s/{i % 9}", "t", f"2026-01-01T00:00:{i % 60:02d}Z") for i in range(100)]
    log = timed(spark, rows)
    assert views.space_view(log).mode == "dots"
    assert views.space_view(log, max_rows=5).mode == "density"
    assert views.space_view(log, max_dots=50).marks.agg(F.sum("count")).first()[0] == 100
    framed = views.space_view(log, lens=SpaceFilter(words=("s/1",)), frame="5", mode="dots")
    assert framed.marks.count() == 5 and framed.legend.first()["count"] == 100
    assert views.space_view(log, mode="density", group="variant").rows.agg(F.sum("count")).first()[0] == 100
