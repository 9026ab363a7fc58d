"""Iterative algorithms on the type graph, as rounds of joins.

The graph has one row per pair of types that follow each other, so it is far
smaller than the log.  Every round works on de-duplicated rows (no path is ever
enumerated) and cuts its lineage, so plans do not grow with the rounds.  A graph of at
most ``FEW`` pairs sits in one partition (``single``), where no round shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.session import cut_lineage


FEW = 200_000


def union(a: DataFrame, b: DataFrame, single: bool) -> DataFrame:
    both = a.unionByName(b)
    return both.coalesce(1) if single else both


def components(pairs: DataFrame, single: bool = False) -> DataFrame:
    """(type, grp) for every node of an undirected pair list, grp = smallest member.

    Each node repeatedly takes the smallest label around it and then the label of
    its label, which halves long chains per round.
    """
    both = cut_lineage(union(pairs, pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), single).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("grp")))
    while not labels.isEmpty():
        around = (
            both.join(labels.select(F.col("a").alias("b"), F.col("grp").alias("near")), "b")
            .groupBy("a")
            .agg(F.min("near").alias("near"))
        )
        closer = labels.join(around, "a").select("a", "grp", F.least("grp", "near").alias("new"))
        jump = labels.select(F.col("a").alias("new"), F.col("grp").alias("far"))
        stepped = cut_lineage(
            closer.join(jump, "new", "left").select("a", "grp", F.least("new", "far").alias("new"))
        )
        labels_changed = not stepped.where("new <> grp").isEmpty()
        labels = stepped.select("a", F.col("new").alias("grp"))
        if not labels_changed:
            break
    return labels.withColumnRenamed("a", "type")


def reach(edges: DataFrame, seed: DataFrame, hops: int | None, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """Breadth-first nodes (type, hop) and the edges leaving nodes before the last hop."""
    seen = cut_lineage(seed.select("type", F.lit(0).cast("bigint").alias("hop")))
    frontier, step = seen, 0
    while (hops is None or step < hops) and not frontier.isEmpty():
        step += 1
        fresh = (
            edges.join(frontier.select(F.col("type").alias("from")), "from", "left_semi")
            .select(F.col("to").alias("type"))
            .distinct()
            .join(seen, "type", "left_anti")
        )
        frontier = cut_lineage(fresh.select("type", F.lit(step).cast("bigint").alias("hop")))
        seen = cut_lineage(union(seen, frontier, single))
    inner = seen if hops is None else seen.where(F.col("hop") < hops)
    walked = edges.join(inner.select(F.col("type").alias("from")), "from", "left_semi")
    return seen, walked


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after peeling off nodes nothing leads to or that lead nowhere."""
    core, size = edges, edges.count()
    while size:
        inner = core.join(core.select(F.col("to").alias("from")).distinct(), "from", "left_semi").join(
            core.select(F.col("from").alias("to")).distinct(), "to", "left_semi"
        )
        core = cut_lineage(inner.select("from", "to"))
        left = core.count()
        if left == size:
            break
        size = left
    return core


def strong_components(edges: DataFrame, single: bool = False) -> DataFrame:
    """(type, scc) of every node of a graph whose nodes all have edges both ways.

    Colouring: each node takes the largest name that can reach it; the nodes of a
    colour that can in turn reach the name giver are one component.
    """
    found: DataFrame | None = None
    left = edges
    while not left.isEmpty():
        nodes = union(left.select(F.col("from").alias("type")), left.select(F.col("to").alias("type")), single).distinct()
        colours = cut_lineage(nodes.select("type", F.col("type").alias("colour")))
        while True:
            incoming = (
                left.join(colours.select(F.col("type").alias("from"), F.col("colour").alias("new")), "from")
                .groupBy(F.col("to").alias("type"))
                .agg(F.max("new").alias("new"))
            )
            stepped = cut_lineage(
                colours.join(incoming, "type", "left").select(
                    "type", F.col("colour").alias("old"), F.greatest("colour", "new").alias("colour")
                )
            )
            changed = not stepped.where("old <> colour").isEmpty()
            colours = stepped.select("type", "colour")
            if not changed:
                break
        inside = (
            left.join(colours.select(F.col("type").alias("from"), F.col("colour").alias("c1")), "from")
            .join(colours.select(F.col("type").alias("to"), F.col("colour").alias("c2")), "to")
            .where("c1 = c2")
            .select(F.col("to").alias("from"), F.col("from").alias("to"))
        )
        members, _ = reach(cut_lineage(inside), colours.where("type = colour").select("type"), None, single)
        done = cut_lineage(members.select("type").join(colours, "type").select("type", F.col("colour").alias("scc")))
        found = done if found is None else cut_lineage(union(found, done, single))
        gone = done.select("type")
        left = cut_lineage(
            left.join(gone.withColumnRenamed("type", "from"), "from", "left_anti")
            .join(gone.withColumnRenamed("type", "to"), "to", "left_anti")
            .select("from", "to")
        )
        # What cannot lie on a cycle any more needs no colour.
        left = cyclic_core(left)
    return found


def forward_edges(edges: DataFrame, starts: DataFrame, single: bool = False) -> DataFrame:
    """An acyclic subset: inside a cycle only edges that lead away from the starts."""
    core = cyclic_core(edges)
    if core.isEmpty():
        return edges
    scc = strong_components(core, single)
    levels, _ = reach(edges, starts, None, single)
    at = levels.select("type", F.col("hop").alias("level"))
    marked = (
        edges.join(scc.select(F.col("type").alias("from"), F.col("scc").alias("s1")), "from", "left")
        .join(scc.select(F.col("type").alias("to"), F.col("scc").alias("s2")), "to", "left")
        .join(at.select(F.col("type").alias("from"), F.col("level").alias("l1")), "from", "left")
        .join(at.select(F.col("type").alias("to"), F.col("level").alias("l2")), "to", "left")
    )
    backward = F.coalesce((F.col("s1") == F.col("s2")) & (F.col("l1") >= F.col("l2")), F.lit(False))
    return cut_lineage(marked.where(~backward).select("from", "to"))


def longest_paths(edges: DataFrame, starts: DataFrame, single: bool = False) -> DataFrame:
    """(type, rank): longest way from any start; types out of reach are left out."""
    steps = forward_edges(edges, starts, single)
    ranks = cut_lineage(starts.select("type", F.lit(0).cast("bigint").alias("rank")).distinct())
    frontier = ranks
    while not frontier.isEmpty():
        pushed = (
            steps.join(frontier.withColumnRenamed("type", "from"), "from")
            .groupBy(F.col("to").alias("type"))
            .agg((F.max("rank") + 1).alias("new"))
        )
        stepped = cut_lineage(
            ranks.join(pushed, "type", "full").select(
                "type", F.greatest("rank", "new").alias("rank"),
                (F.col("new") > F.coalesce("rank", F.lit(-1))).alias("moved"),
            )
        )
        ranks = stepped.select("type", "rank")
        frontier = stepped.where("moved").select("type", "rank")
    return ranks
