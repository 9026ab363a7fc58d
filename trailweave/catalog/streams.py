"""Logs written and read back, as tables and as streams.

Every query writes a derived log below the session's checkpoint folder and runs the
reader, or a stream over the files that are there, to its end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailweave.catalog.logs import DOCS, ORDER, USER, with_logs
from trailweave.functions.predicates import SpaceFilter, subject_prefix
from trailweave.operators import counts, space
from trailweave.sources import events
from trailweave.sources.tables import order_docs, order_log, user_log
from trailweave.session import checkpoint_folder
from trailweave.streaming import tail

CELLS = "row bigint, col bigint, phase string, count bigint, min_id string, max_id string"
SHOWN = "id string, subject string, type string, time string, phase string"
LENS = SpaceFilter(subject="/users", types=("click", "error", "purchase"))
#: Digits of an id of the user log.
WIDTH = 20


def _folder(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/trailweave-{name}-{uuid.uuid4().hex}"


def read_back(spark, log, payload: bool = False, fmt: str = "parquet"):
    """The log through a materialised copy and the reader."""
    path = _folder(spark, "log")
    if fmt == "parquet":
        events.write_log(log, path)
    else:
        log.write.json(path)
    return events.read_events(spark, path, payload, fmt)


def nameless(spark, sf):
    """Events of which every fifth has no type."""
    return user_log(spark, sf).withColumn("type", F.when(F.substring("id", -1, 1).cast("int") % 5 > 0, F.col("type")))


def streamed(spark, log, tailed):
    """What a tail over the written log appends, until all of it is read."""
    source, out = _folder(spark, "stream"), tail.BatchTable(spark, _folder(spark, "tail"), SHOWN)
    events.write_log(log, source)
    tail.start_tail(tailed(tail.read_stream(spark, source, "parquet")), out.write, _folder(spark, "progress"), once=True).awaitTermination()
    return out.read()


def middle_id(log):
    """The id in the middle between the first and the last one."""
    number = F.col("id").cast("bigint")
    return log.agg(F.lpad(((F.min(number) + F.max(number)) / 2).cast("bigint").cast("string"), WIDTH, "0")).first()[0]


def started_at_tail(spark, sf):
    """A tail that starts at the end of the first half shows the second half only."""
    log = user_log(spark, sf)
    anchor = tail.current_tail(log.where(F.col("id") <= middle_id(log)))
    return streamed(spark, log, lambda s: tail.tail_events(s, after=anchor))


def strict(spark, sf, deliveries):
    """Two deliveries, the second with ids below the mark of the first: those are dropped."""
    log, source, progress = user_log(spark, sf), _folder(spark, "stream"), _folder(spark, "progress")
    marks, out = tail.HighWater(spark, _folder(spark, "marks")), tail.BatchTable(spark, _folder(spark, "tail"), SHOWN)
    run = tail.strict_batch(marks, out.write, LENS.predicate())
    for delivery in deliveries(log):
        delivery.write.mode("append").parquet(source)
        tail.start_tail(tail.read_stream(spark, source, "parquet"), run, progress, once=True).awaitTermination()
    return out.read()


def whole_log(log):
    """All ids up to the middle of the log but a late share, then all the rest."""
    middle = middle_id(log)
    first = (F.col("id") <= middle) & (F.substring("id", -1, 1) != "3")
    return log.where(first), log.where(~first)


def live(spark, sf):
    """Counts per type after the last batch."""
    source, out = _folder(spark, "stream"), _folder(spark, "counts")
    events.write_log(user_log(spark, sf), source)
    counted = tail.live_counts(tail.read_stream(spark, source, "parquet"))

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(out)

    counted.writeStream.outputMode("complete").foreachBatch(sink).option(
        "checkpointLocation", _folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("type string, count bigint").parquet(out)


def live_grid(spark, sf):
    """The grid of a stream, updated batch by batch, against a fixed axis and bands."""
    log = user_log(spark, sf)
    placed, bands = space.axis(log), space.subject_bands(log)
    source, out = _folder(spark, "stream"), tail.BatchTable(spark, _folder(spark, "cells"), CELLS)
    middle = middle_id(log)
    progress = _folder(spark, "progress")
    for part in (log.where(F.col("id") <= middle), log.where(F.col("id") > middle)):
        part.write.mode("append").parquet(source)
        cells = tail.live_cells(tail.read_stream(spark, source, "parquet"), placed.low, placed.high, space.band_lows(bands), space.COLUMNS)
        cells.writeStream.outputMode("update").foreachBatch(out.write).option("checkpointLocation", progress).trigger(
            availableNow=True).start().awaitTermination()
    return tail.merged_cells(out.read())


QUERIES = {
    "read_events": lambda s, d: read_back(s, user_log(s, d), fmt="json"),
    "read_events_missing_type": lambda s, d: read_back(s, nameless(s, d), fmt="json"),
    "read_events_with_payload": lambda s, d: read_back(s, order_docs(s, d), payload=True),
    "event_lookup_written": lambda s, d: counts.event_lookup(
        read_back(s, user_log(s, d), payload=True), "/users", "00000000000000000007"),
    "scan_written_log": lambda s, d: read_back(s, order_log(s, d)).where(
        subject_prefix("/customers/7") & (F.col("type") == "item.R") & (F.col("id") >= "1995")),
    "tail_events": lambda s, d: streamed(s, user_log(s, d), lambda t: tail.tail_events(t, LENS.predicate())),
    "start_at_tail": started_at_tail,
    "strict_tail_whole": lambda s, d: strict(s, d, whole_log),
    "tail_once": lambda s, d: streamed(
        s, user_log(s, d).unionByName(user_log(s, d).where("type = 'error'")), lambda t: tail.tail_once(t, "1 hour")),
    "live_counts": live,
    "live_density": live_grid,
}

_PHASE = "CASE type WHEN 'error' THEN 'error' ELSE 'complete' END AS phase"
_SHOWN = f"SELECT id, subject, type, time, {_PHASE} FROM user_log"
_LENS = "type IN ('click', 'error', 'purchase')"

ORACLE = {
    "event_lookup_written": with_logs(USER)
    + """SELECT id, source, subject, type, time, data, CASE type WHEN 'error' THEN 'error' ELSE 'complete' END AS phase
       FROM user_log WHERE id = '00000000000000000007'""",
    "read_events": with_logs(USER) + "SELECT id, source, subject, type, time FROM user_log",
    "read_events_missing_type": with_logs(USER)
    + "SELECT id, source, subject, CASE WHEN right(id, 1)::INT % 5 > 0 THEN type ELSE '' END AS type, time FROM user_log",
    "read_events_with_payload": with_logs(DOCS) + "SELECT id, source, subject, type, time, data FROM order_docs",
    "scan_written_log": with_logs(ORDER)
    + """SELECT id, source, subject, type, time FROM order_log
       WHERE starts_with(subject, '/customers/7/') AND type = 'item.R' AND id >= '1995'""",
    "tail_events": with_logs(USER) + f"{_SHOWN} WHERE {_LENS}",
    "start_at_tail": with_logs(USER)
    + f"{_SHOWN} WHERE id > (SELECT max(id) FROM user_log WHERE id::BIGINT <= (SELECT (min(id::BIGINT) + max(id::BIGINT)) // 2 FROM user_log))",
    "strict_tail_whole": with_logs(USER)
    + f""", m AS (SELECT lpad(((min(id::BIGINT) + max(id::BIGINT)) // 2)::VARCHAR, {WIDTH}, '0') AS middle FROM user_log)
       {_SHOWN}, m WHERE {_LENS} AND ((id <= middle AND right(id, 1) <> '3') OR id >
       (SELECT max(id) FROM user_log, m WHERE id <= middle AND right(id, 1) <> '3'))""",
    "tail_once": with_logs(USER) + _SHOWN,
    "live_counts": with_logs(USER) + "SELECT type, count(*) AS count FROM user_log GROUP BY type",
    "live_density": with_logs(USER)
    + """, names AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS ix, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM user_log)),
       banded AS (SELECT subject, CASE WHEN n <= 70 THEN ix WHEN ix < (n % 70) * (n // 70 + 1) THEN ix // (n // 70 + 1)
         ELSE n % 70 + (ix - (n % 70) * (n // 70 + 1)) // greatest(n // 70, 1) END AS row FROM names),
       t AS (SELECT row, id, type, epoch_us(ts) AS val, min(epoch_us(ts)) OVER () AS low, max(epoch_us(ts)) OVER () AS high
             FROM user_log JOIN banded USING (subject))
       SELECT row, least(floor((val - low) / (high - low)::DOUBLE * 120), 119)::BIGINT AS col, count(*) AS count,
         CASE WHEN count(*) FILTER (type = 'error') * 2 >= count(*) THEN 'error' ELSE 'complete' END AS phase,
         min(id) AS min_id, max(id) AS max_id FROM t GROUP BY 1, 2""",
}
