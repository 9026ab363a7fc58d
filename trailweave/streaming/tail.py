"""Tail new events with Structured Streaming.

Progress lives in the query's checkpoint.  The strict mode, which never shows an
event whose id is not above everything seen before, keeps its high-water mark in a
table next to it, one row per batch, so a repeated batch gives the same answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailweave.functions.lifecycle import phase, phase_priority
from trailweave.functions.text import normalise_x, rfc3339
from trailweave.operators.ordering import which_range
from trailweave.session import cut_lineage, small_table
from trailweave.sources.events import EVENT_SCHEMA, filled

POLL = "2 seconds"
SHOWN = ["id", "subject", "type", "time"]


def read_stream(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Log files as a stream; extra options go to the source."""
    raw = spark.readStream.schema(EVENT_SCHEMA).format(fmt).options(**options).load(path)
    return raw.select(*filled(EVENT_SCHEMA.names))


def read_kafka(spark: SparkSession, servers: str, topic: str, from_start: bool = False) -> DataFrame:
    """Log events from a Kafka topic of JSON values, from the end unless told otherwise."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest" if from_start else "latest")
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), EVENT_SCHEMA).alias("e")).select("e.*").select(
        *filled(EVENT_SCHEMA.names))


def current_tail(log: DataFrame) -> str:
    """Largest id so far; a tail that starts here replays nothing."""
    return log.agg(F.max("id")).first()[0] or ""


def tail_events(stream: DataFrame, predicate: Column | None = None, after: str = "") -> DataFrame:
    """New events that pass all layers, with their phase."""
    fresh = stream.where(F.col("id") > after) if after else stream
    kept = fresh.where(predicate) if predicate is not None else fresh
    return kept.select(*SHOWN, phase(F.col("type")).alias("phase"))


def tail_once(stream: DataFrame, delay: str, predicate: Column | None = None) -> DataFrame:
    """Tail that tolerates late and repeated events: ids are unique within ``delay``."""
    timed = stream.withColumn("ts", rfc3339(F.col("time"))).withWatermark("ts", delay)
    return tail_events(timed.dropDuplicatesWithinWatermark(["id"]), predicate)


def live_counts(stream: DataFrame) -> DataFrame:
    """Events per type so far; write it in update or complete mode."""
    return stream.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


class HighWater:
    """Anchors of the last two batches, one small folder each, on shared storage.

    Writing a batch again replaces its folder, so a repeated batch gives the same answer.
    """

    def __init__(self, spark: SparkSession, folder: str, start: str = "") -> None:
        self.spark, self.folder, self.start = spark, folder, start

    def before(self, batch: int) -> str:
        past = [n for n in self._batches() if n < batch]
        if not past:
            return self.start
        read = self.spark.read.schema("anchor string")
        return read.parquet(f"{self.folder}/batch-{max(past)}").agg(F.max("anchor")).first()[0] or self.start

    def record(self, batch: int, anchor: str) -> None:
        row = small_table(self.spark, [(anchor,)], "anchor string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        for old in self._batches():
            if old < batch - 1:
                self._files().delete(self._path(f"{self.folder}/batch-{old}"), True)

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        """Batches with a finished mark."""
        found = self._files().globStatus(self._path(f"{self.folder}/batch-*/_SUCCESS")) or []
        return [int(f.getPath().getParent().getName().removeprefix("batch-")) for f in found]


class BatchTable:
    """A table of delivered batches: one folder per batch id, and a list of those that count.

    A batch that is written again replaces its own folder, so a failure between sink and
    mark, and the retry after it, delivers no row twice.  Readers see finished folders only.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder, schema

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")

    def batches(self) -> list[int]:
        return sorted(HighWater(self.spark, self.folder)._batches())

    def read(self) -> DataFrame:
        folders = [f"{self.folder}/batch-{n}" for n in self.batches()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def compact(self, below: int) -> None:
        """Fold the batches before ``below`` into the one just before it (call it from one place,
        between batches).  Their folders go once the folded one is finished."""
        old = [n for n in self.batches() if n < below]
        if len(old) < 2:
            return
        kept = cut_lineage(self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/batch-{n}" for n in old]))
        files = HighWater(self.spark, self.folder)
        for n in old[:-1]:
            files._files().delete(files._path(f"{self.folder}/batch-{n}"), True)
        self.write(kept, old[-1])


def live_cells(stream: DataFrame, low: int, high: int, lows: list[str], cols: int) -> DataFrame:
    """Grid cells of a stream on a fixed axis (update mode): row, col, phase, count, min_id, max_id.

    The axis (microseconds ``low`` to ``high``) and the name bands (their lower ends) are those
    of the chart the stream continues.  Later events fall into the last column, as newer ones
    do in the chart; events without a time and subjects before the first band are left out.
    State is one row per cell and phase.
    """
    micros = F.unix_micros(rfc3339(F.col("time")))
    share = normalise_x(micros, F.lit(low), F.lit(high))
    col = F.when(micros.isNotNull(), F.greatest(F.least(F.floor(share * cols), F.lit(cols - 1)), F.lit(0))).cast("bigint")
    marked = stream.select(which_range(F.col("subject"), lows).alias("row"), col.alias("col"), phase(F.col("type")).alias("phase"), "id")
    return marked.where("row >= 0 AND col IS NOT NULL").groupBy("row", "col", "phase").agg(
        F.count(F.lit(1)).alias("count"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def merged_cells(updates: DataFrame) -> DataFrame:
    """The grid after all delivered updates: of each cell and phase the latest state (counts
    only grow), then cells with their leading phase."""
    latest = updates.groupBy("row", "col", "phase").agg(
        F.max_by(F.struct("count", "min_id", "max_id"), "count").alias("s")).select("row", "col", "phase", "s.*")
    lead = F.max_by("phase", F.struct("count", -phase_priority(F.col("phase"))))
    return latest.groupBy("row", "col").agg(
        F.sum("count").alias("count"), lead.alias("phase"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"))


def strict_batch(
    marks: HighWater, sink: Callable[[DataFrame, int], None], predicate: Column | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch function that drops ids at or below the anchor for good.

    The anchor also moves past events the predicate hides.
    """

    def run(batch: DataFrame, number: int) -> None:
        anchor = marks.before(number)
        batch = batch.persist()  # read by the sink and for the mark
        try:
            highest = batch.agg(F.max("id")).first()[0]
            sink(tail_events(batch.where(F.col("id") > anchor), predicate), number)
            marks.record(number, max(anchor, highest or ""))
        finally:
            batch.unpersist()

    return run


def start_tail(
    tail: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Run a tail every two seconds, or over what is there now if ``once``."""
    writer = tail.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()
