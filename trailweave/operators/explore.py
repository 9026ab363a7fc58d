"""Replay counters and comparison of single subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.operators.ordering import ROWS_PER_SLICE, global_index, in_order, search
from trailweave.session import cut_lineage, kept_table


def running_counts(log: DataFrame) -> DataFrame:
    """How often the type of each event has occurred so far: (id, subject, type, so_far)."""
    # Types take the part of subjects here, the key that events are ordered under.  The log is read more
    # than once (counts and samples for the cuts, events, seams), so what is needed of it is written once.
    keyed = kept_table(log.select(F.coalesce("type", F.lit("")).alias("subject"), "id", F.col("subject").alias("owner")), "typed")
    counted = in_order(keyed.withColumn("type", F.col("subject")), extra=("owner",)).df
    return counted.select("id", F.col("owner").alias("subject"), "type", F.col("pos").alias("so_far"))


def replay_at(log: DataFrame, events: int) -> DataFrame:
    """Counts per type after the first ``events`` events; unseen types count 0."""
    seen = log.select("id", "type").orderBy("id").limit(max(events, 0)).groupBy("type").agg(F.count(F.lit(1)).alias("count"))
    return log.select("type").distinct().join(seen, "type", "left").select(
        "type", F.coalesce("count", F.lit(0)).alias("count"))


def replay_points(log: DataFrame, points: DataFrame, rows_per_range: int = ROWS_PER_SLICE) -> DataFrame:
    """(events, type, count): counts per type after the first ``events`` events, for every
    point of a table with that column; unseen types count 0.

    The log is cut into ranges of ids.  Counts at the ends of ranges are snapshots, made by
    summing what each range holds; a point takes the snapshot before its range and adds the
    events of that range only.  Ranges are numbered in tasks of their own, the log as a whole
    is never sorted, and all points share one job.  Points beyond the log stand at its end.
    """
    typed = log.select("id", F.coalesce("type", F.lit("")).alias("type"))
    placed = kept_table(global_index(typed, "id", "_at", rows_per_range).select(
        "type", "_at", F.floor(F.col("_at") / rows_per_range).alias("_range")), "places")
    held = cut_lineage(placed.groupBy("_range", "type").agg(F.count(F.lit(1)).alias("_n")))
    kinds = held.select("type").distinct()
    asked = cut_lineage(points.select(F.greatest(F.col("events").cast("bigint"), F.lit(0)).alias("events")).distinct().withColumn(
        "_range", F.floor(F.col("events") / rows_per_range)))
    # Snapshots: for every range that a point lies in, all earlier ranges by type (running sums per type).
    marks = asked.select("_range").distinct().crossJoin(kinds).withColumn("_n", F.lit(0)).withColumn("_mark", F.lit(True))
    steps = held.select("_range", "type", "_n", F.lit(False).alias("_mark")).unionByName(marks)
    before = Window.partitionBy("type").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    snapshots = steps.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_mark").select(
        "_range", "type", "_before")
    # Inside its range a point counts the events up to it: cumulative counts between the points of the range.
    ends = asked.groupBy("_range").agg(F.sort_array(F.collect_set("events")).alias("_ends"))
    longest = asked.groupBy("_range").count().agg(F.max("count")).first()[0] or 0
    met = placed.join(ends, "_range").select(
        "_range", "type", F.get("_ends", search(F.col("_ends"), F.col("_at"), longest)).alias("_next"))
    between = met.where("_next IS NOT NULL").groupBy("_range", "type", "_next").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_range", "type").orderBy("events")
    grid = asked.crossJoin(kinds).join(
        between.withColumnRenamed("_next", "events"), ["events", "_range", "type"], "left").withColumn(
        "_inside", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    return grid.join(snapshots, ["_range", "type"]).select(
        "events", "type", (F.col("_before") + F.col("_inside")).cast("bigint").alias("count"))


def compare_subjects(log: DataFrame, subjects: list[str]) -> tuple[DataFrame, DataFrame]:
    """Types and steps the chosen subjects go through, and how many of them share each."""
    flow = in_order(log.where(F.col("subject").isin(*subjects))).df
    nodes = (
        flow.select("type", "subject").distinct().groupBy("type").agg(
            F.count(F.lit(1)).alias("shared_by"), F.array_join(F.array_sort(F.collect_list("subject")), ",").alias("subjects")
        )
    )
    steps = flow.where("prev_type <> type").select(F.col("prev_type").alias("from"), F.col("type").alias("to"), "subject")
    edges = (
        steps.distinct().groupBy("from", "to").agg(
            F.count(F.lit(1)).alias("shared_by"), F.array_join(F.array_sort(F.collect_list("subject")), ",").alias("subjects")
        )
    )
    return nodes, edges
