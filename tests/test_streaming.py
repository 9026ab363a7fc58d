import json

from pyspark.sql import functions as F

from trailweave.functions.predicates import SpaceFilter
from trailweave.streaming import tail


def drop(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events))


def event(n, subject="/orders/1", kind="order.created", time="2026-01-01T00:00:00Z"):
    return {"id": f"{n:04d}", "source": "s", "subject": subject, "type": kind, "time": time, "data": {"n": n}}


def run(query):
    query.processAllAvailable() if query.isActive else None
    query.awaitTermination(60)


def test_tail_shows_each_event_once(spark, tmp_path):
    drop(tmp_path / "in", "a.json", [event(1), event(2, "/users/1")])
    seen = []
    sink = lambda batch, n: seen.extend(tuple(r) for r in batch.collect())
    lens = SpaceFilter(subject="/orders").predicate()
    for more in ([], [event(3, kind="order.failed"), event(4, "/users/2")]):
        if more:
            drop(tmp_path / "in", "b.json", more)
        stream = tail.read_stream(spark, str(tmp_path / "in"))
        run(tail.start_tail(tail.tail_events(stream, lens), sink, str(tmp_path / "cp"), once=True))
    assert [(r[0], r[4]) for r in sorted(seen)] == [("0001", "active"), ("0003", "error")]


def test_start_at_tail(spark, tmp_path):
    drop(tmp_path / "in", "a.json", [event(1), event(2)])
    anchor = tail.current_tail(spark.read.json(str(tmp_path / "in")))
    drop(tmp_path / "in", "b.json", [event(3)])
    seen = []
    stream = tail.read_stream(spark, str(tmp_path / "in"))
    sink = lambda batch, n: seen.extend(r["id"] for r in batch.collect())
    run(tail.start_tail(tail.tail_events(stream, after=anchor), sink, str(tmp_path / "cp"), once=True))
    assert seen == ["0003"]


def test_strict_tail_drops_late_ids(spark, tmp_path):
    marks = tail.HighWater(spark, str(tmp_path / "marks"))
    seen = []
    hidden = F.col("type") != "noise"
    batch = tail.strict_batch(marks, lambda df, n: seen.extend((n, r["id"]) for r in df.collect()), hidden)
    schema = tail.EVENT_SCHEMA
    frame = lambda *rows: spark.createDataFrame([(f"{n:04d}", "s", "/a", t, "", "{}") for n, t in rows], schema)
    batch(frame((1, "x"), (5, "noise")), 0)
    batch(frame((3, "x"), (6, "x")), 1)
    batch(frame((3, "x"), (6, "x")), 1)  # a repeated batch answers the same
    batch(frame((4, "x"), (7, "x")), 2)
    assert seen == [(0, "0001"), (1, "0006"), (1, "0006"), (2, "0007")]


def test_live_counts_and_late_policy(spark, tmp_path):
    drop(tmp_path / "in", "a.json", [event(1), event(2), event(2), event(3, kind="order.failed")])
    stream = tail.read_stream(spark, str(tmp_path / "in"))
    counted = tail.live_counts(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    run(counted)
    assert {r["type"]: r["count"] for r in spark.table("live").collect()} == {"order.created": 3, "order.failed": 1}
    seen = []
    sink = lambda batch, n: seen.extend(r["id"] for r in batch.collect())
    run(tail.start_tail(tail.tail_once(stream, "1 hour"), sink, str(tmp_path / "cp2"), once=True))
    assert sorted(seen) == ["0001", "0002", "0003"]


def test_strict_deliveries_hold_every_event(spark):
    from trailweave.catalog.streams import whole_log

    log = spark.range(1, 2001).select(F.lpad(F.col("id").cast("string"), 20, "0").alias("id"))
    first, rest = whole_log(log)
    assert (first.count(), rest.count()) == (900, 1100)
    assert first.unionByName(rest).distinct().count() == 2000
