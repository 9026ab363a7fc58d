"""Counts, funnels, windows on the newest events and lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.lifecycle import phase
from trailweave.functions.predicates import Stage, subject_prefix

# Sizes of short lists.
LEGEND = 14
LIST_CAP = 300
LIVE_FRAME = 1000


def funnel(log: DataFrame, stages: list[Stage]) -> DataFrame:
    """Events and subjects left after each cumulative stage, in one scan.

    Subjects are counted in two steps (per subject, then over subjects), so no row
    is copied per stage and a huge subject is folded before it is shuffled.
    """
    passed = [reduce(and_, [s.predicate() for s in stages[: k + 1]]) for k in range(len(stages))]
    tests = [F.lit(True), *passed]
    per_subject = log.groupBy("subject").agg(*[F.count_if(t).alias(f"n{k}") for k, t in enumerate(tests)])
    totals = per_subject.agg(
        *[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"e{k}") for k in range(len(tests))],
        *[F.count_if(F.col(f"n{k}") > 0).alias(f"s{k}") for k in range(len(tests))],
    )
    labels = ["all", *[stage.label() for stage in stages]]
    rows = F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("stage"), F.lit(label).alias("label"),
                 F.col(f"e{k}").alias("events"), F.col(f"s{k}").alias("subjects"))
        for k, label in enumerate(labels)
    ])
    return totals.select(F.inline(rows))


def type_counts(log: DataFrame, top: int = LEGEND) -> DataFrame:
    """Busiest types; the tail becomes one ``+N more types`` row."""
    counts = log.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
    heads = counts.orderBy(F.desc("count"), "type").limit(top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "type")).cast("bigint"))
    everything = counts.agg(F.count(F.lit(1)).alias("types"), F.sum("count").alias("events"))
    shown = heads.agg(F.count(F.lit(1)).alias("shown"), F.sum("count").alias("covered"))
    tail = everything.crossJoin(shown).where("types > shown").select(
        F.concat(F.lit("+"), (F.col("types") - F.col("shown")).cast("string"), F.lit(" more types")).alias("type"),
        (F.col("events") - F.col("covered")).alias("count"),
        (F.col("shown") + 1).alias("rank"),
    )
    return ranked.select("rank", "type", "count").unionByName(tail).orderBy("rank")


def subject_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("subject").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "subject")


def distinct_subjects(log: DataFrame, approximate: bool = False) -> DataFrame:
    if approximate:
        return log.agg(F.approx_count_distinct("subject", 0.01).alias("subjects"))
    return log.select("subject").distinct().agg(F.count(F.lit(1)).alias("subjects"))


def frame_size(text: str) -> int:
    """Number of newest events asked for; 0 means all."""
    if text in ("", "all", "0"):
        return 0
    if text in ("live", "last"):
        return LIVE_FRAME
    try:
        return abs(int(text))
    except ValueError:
        return 0


def last_n(log: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events; everything when ``n`` is 0."""
    return log.orderBy(F.desc("id")).limit(n) if n > 0 else log


def event_lookup(log: DataFrame, subject: str, event_id: str) -> DataFrame:
    """One event of a subtree, with its phase."""
    return log.where(subject_prefix(subject) & (F.col("id") == event_id)).withColumn("phase", phase(F.col("type")))


def inspect(log: DataFrame, event_type: str = "", subject: str = "", cap: int = LIST_CAP) -> DataFrame:
    """Oldest events of a subtree, or else of a type, with payload.

    ``capped`` says whether the list reached its limit.
    """
    if not (event_type or subject):
        raise ValueError("an event type or a subject is needed")
    chosen = subject_prefix(subject) if subject else F.col("type") == event_type
    listed = log.where(chosen).orderBy("id").limit(cap)
    return listed.withColumn("capped", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) >= cap)  # cap rows


def scoped_or_all(log: DataFrame, prefix: str) -> DataFrame:
    """The subtree, or the whole log when nothing lies under the prefix."""
    inside = subject_prefix(prefix)
    if not prefix.strip("/"):
        return log
    under = log.where(inside)  # this filter reaches the scan
    nothing = under.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return under.unionByName(log.crossJoin(F.broadcast(nothing)).drop("_n"))  # one row or none

