"""Process discovery: what follows what, where runs start, what runs in parallel.

One pass over the log counts neighbouring types.  Runs are split between two
neighbours only because of *which types* they are, so starts, ends, splits, edges
and totals all follow from that small table; the log is not read again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trailweave.functions.lifecycle import phase, task
from trailweave.functions.text import pct
from trailweave.operators import typegraph
from trailweave.operators.ordering import Ordered, Slices, find_slices, in_order, kept_order
from trailweave.session import cut_lineage

# When two types count as running in parallel.
MIN_BOTH_WAYS = 2
MAX_DEPENDENCY = 0.5
# Types (as estimated) whose pairs are few enough to be sent to tasks without being counted first.
FEW_TYPES = 500


def neighbours(flow: Ordered) -> DataFrame:
    """Counts per (prev_type, type); prev_type is NULL for first events.

    ``ends`` counts last events; ``deepest`` is the largest position seen.
    """
    return (
        flow.df.groupBy("prev_type", "type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("next_type").isNull()).alias("ends"),
            F.max("pos").alias("deepest"),
        )
    )


@dataclass
class Discovery:
    """A discovered process; every member is derived from the neighbour counts."""

    log: DataFrame
    slices: Slices | None = None
    start_types: tuple[str, ...] | None = None
    end_types: tuple[str, ...] | None = None
    #: Whether the ordered log is written down; for those who go on to its runs without ids.
    keep: bool = False
    #: Whether types are counted with the cut points, so that ``split_runs`` can be one query.
    together: bool = False

    def __post_init__(self) -> None:
        #: Whether there are few types; only known if they were counted with the cut points.
        self.few_types = False
        if self.together and not self.slices:
            seen = Observation()
            self.slices = find_slices(self.log.observe(seen, F.approx_count_distinct("type").alias("types")))
            try:
                self.few_types = seen.get["types"] <= FEW_TYPES
            except Py4JJavaError:  # a plan found to be empty is not run, so nothing was observed
                pass
        self.slices = self.slices or find_slices(self.log)

    @cached_property
    def flow(self) -> Ordered:
        """The ordered log, without ids and written down."""
        return kept_order(self.log, self.slices)

    def within(self, flow: Ordered) -> "Discovery":
        """The same process, counted inside the query that goes on with ``flow``, so that both share one exchange.

        The counts of a pair are one value: whoever asks for any of them asks for the same rows, which are made once.
        """
        inner = replace(self, slices=flow.slices)
        whole = neighbours(flow).groupBy("prev_type", "type").agg(F.max(F.struct("n", "ends", "deepest")).alias("_whole"))
        inner._counted = (whole.select("prev_type", "type", "_whole.*").where("n > 0"), False)
        return inner

    @cached_property
    def _counted(self) -> tuple[DataFrame, bool]:
        """Neighbour counts, and whether they are few enough for one partition.

        One partition spares every join and round on the type graph its shuffles.
        """
        pairs = cut_lineage(neighbours(self.flow if self.keep else in_order(self.log, self.slices)))
        single = pairs.count() <= typegraph.FEW
        return (pairs.coalesce(1) if single else pairs), single

    @property
    def pairs(self) -> DataFrame:
        return self._counted[0]

    @property
    def single(self) -> bool:
        return self._counted[1]

    @cached_property
    def deepest(self) -> int:
        """Number of events of the longest subject."""
        return self.pairs.agg(F.max("deepest")).first()[0] or 0

    @cached_property
    def node_stats(self) -> DataFrame:
        """Per type: events, how often it starts or ends a subject, task, phase."""
        return (
            self.pairs.groupBy("type")
            .agg(
                F.sum("n").alias("count"),
                F.sum(F.when(F.col("prev_type").isNull(), F.col("n")).otherwise(0)).alias("start_count"),
                F.sum("ends").alias("end_count"),
            )
            .select("type", task(F.col("type")).alias("task"), phase(F.col("type")).alias("phase"),
                    "count", "start_count", "end_count")
        )

    @cached_property
    def boundary_types(self) -> DataFrame:
        """Types that ever start or end a subject, unless given explicitly."""
        starts = F.col("start_count") > 0 if self.start_types is None else F.col("type").isin(*self.start_types)
        ends = F.col("end_count") > 0 if self.end_types is None else F.col("type").isin(*self.end_types)
        return self.node_stats.select("type", starts.alias("starts"), ends.alias("ends"))

    @cached_property
    def classified(self) -> DataFrame:
        """Neighbour pairs, told apart into steps of a run and restarts."""
        bounds = self.boundary_types
        return (
            self.pairs.join(bounds.select("type", "starts"), "type")
            .join(bounds.select(F.col("type").alias("prev_type"), F.col("ends").alias("prev_ends")), "prev_type", "left")
            .select(
                "prev_type", "type", "n",
                F.coalesce((F.col("prev_type") != F.col("type")) & F.col("prev_ends") & F.col("starts"), F.lit(False))
                .alias("restart"),
            )
        )

    @cached_property
    def directly_follows(self) -> DataFrame:
        return cut_lineage(
            self.classified.where("prev_type IS NOT NULL AND NOT restart").select(
                F.col("prev_type").alias("from"), F.col("type").alias("to"), F.col("n").alias("count")
            )
        )

    @cached_property
    def totals(self) -> DataFrame:
        """Subjects, events and runs."""
        first = F.when(F.col("prev_type").isNull(), F.col("n")).otherwise(0)
        again = F.when(F.col("restart"), F.col("n")).otherwise(0)
        return self.classified.agg(
            F.coalesce(F.sum(first), F.lit(0)).alias("subjects"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
            F.coalesce(F.sum(first + again), F.lit(0)).alias("traces"),
        )

    @cached_property
    def concurrent_pairs(self) -> DataFrame:
        """Pairs seen both ways often enough and evenly enough (a before b by name)."""
        forward = self.directly_follows.select(
            F.col("from").alias("a"), F.col("to").alias("b"), F.col("count").alias("fwd")
        ).where("a < b")
        backward = self.directly_follows.select(
            F.col("to").alias("a"), F.col("from").alias("b"), F.col("count").alias("rev")
        ).where("a < b")
        lean = F.abs(F.col("fwd") - F.col("rev")) / (F.col("fwd") + F.col("rev") + 1)
        return forward.join(backward, ["a", "b"]).where(
            (F.least("fwd", "rev") >= MIN_BOTH_WAYS) & (lean <= MAX_DEPENDENCY)
        )

    @cached_property
    def group_of(self) -> DataFrame:
        """(type, grp): the parallel group of a type, named by its first member."""
        return typegraph.components(self.concurrent_pairs.select("a", "b"), self.single)

    @property
    def concurrent_groups(self) -> DataFrame:
        members = F.array_join(F.array_sort(F.collect_list("type")), ",")
        return self.group_of.groupBy("grp").agg(
            members.alias("members"), F.count(F.lit(1)).alias("size")
        ).select("members", "size").orderBy("members")

    @cached_property
    def edges(self) -> DataFrame:
        """Directly-follows edges with a flag for order that is only interleaving."""
        pairs = self.concurrent_pairs.select("a", "b")
        both = typegraph.union(pairs, pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), self.single).select(
            F.col("a").alias("from"), F.col("b").alias("to"), F.lit(True).alias("parallel")
        )
        return self.directly_follows.join(both, ["from", "to"], "left").select(
            "from", "to", "count", F.coalesce("parallel", F.lit(False)).alias("parallel")
        ).orderBy(F.desc("count"), "from", "to")

    @cached_property
    def structural(self) -> DataFrame:
        """Edges that are real steps: not parallel, not a self loop."""
        return cut_lineage(self.edges.where("NOT parallel AND from <> to").select("from", "to"))

    @cached_property
    def ranks(self) -> DataFrame:
        starts = self.node_stats.where("start_count > 0").select("type")
        ranked = typegraph.longest_paths(self.structural, starts, self.single)
        return self.node_stats.select("type").join(ranked, "type", "left").select(
            "type", F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank")
        )

    @property
    def nodes(self) -> DataFrame:
        return self.node_stats.join(self.ranks, "type").orderBy("rank", F.desc("count"), "type")

    def task_groups(self) -> DataFrame:
        """Tasks that show up as two or more event types."""
        return (
            self.node_stats.groupBy("task")
            .agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
                 F.count(F.lit(1)).alias("size"))
            .where("size >= 2")
        )

    def subgraph(self, text: str) -> tuple[DataFrame, DataFrame]:
        """Nodes whose type contains a text, and the edges that keep both ends."""
        kept = self.node_stats.where(F.lower("type").contains(text.strip().lower()))
        names = kept.select("type")
        edges = (
            self.edges.join(names.withColumnRenamed("type", "from"), "from", "left_semi")
            .join(names.withColumnRenamed("type", "to"), "to", "left_semi")
            .select("from", "to", "count", "parallel")
        )
        return kept, edges

    def downstream(self, start: str, hops: int | None = 1) -> tuple[DataFrame, DataFrame]:
        """Types and drawn edges within reach of a type; ``None`` hops goes all the way."""
        steps = self.edges.where("NOT parallel").select("from", "to")
        seed = self.node_stats.where(F.col("type") == start).select("type")
        return typegraph.reach(steps, seed, hops, self.single)


def discover(log: DataFrame, **options) -> Discovery:
    return Discovery(log, **options)


def share_of(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the whole-number share of all runs."""
    return counts.crossJoin(totals.select("traces")).withColumn("pct", pct(F.col("count"), F.col("traces"))).drop("traces")

