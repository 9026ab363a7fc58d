"""Order inside subjects that stays parallel when one subject is huge.

Most operators look at the events of a subject in ``id`` order.  A window
partitioned by subject does that, but puts a whole subject into one task.  Here a
subject that holds many events is cut into consecutive id ranges ("slices"); the
window runs per slice, and a small summary of the slices repairs their seams.

Where to cut is estimated from a sample, so it only affects balance: any cut
points give the same answer.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.session import cut_lineage, kept_table, small_table

# Rows of one slice or key range, and sampled rows that choose the end of one.
ROWS_PER_SLICE = 2_000_000
SAMPLED_ROWS_PER_SLICE = 32


def search(points: Column, key: Column, longest: int) -> Column:
    """How many entries of a sorted array of at most ``longest`` are at or below ``key`` (binary search)."""
    steps = [1 << n for n in range(longest.bit_length() - 1, -1, -1)]

    def probe(low: Column, step: Column) -> Column:
        ahead = low + step
        return F.when((ahead <= F.size(points)) & (F.get(points, ahead - 1) <= key), ahead).otherwise(low)

    return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), probe) if steps else F.lit(0)


def which_range(key: Column, lows: list) -> Column:
    """Index of the last of a few sorted literals at or below ``key``, -1 if none is.

    A balanced tree of comparisons, which stays inside generated code.
    """

    def node(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first).cast("bigint")
        middle = (first + last + 1) // 2
        return F.when(key < lows[middle], node(first, middle - 1)).otherwise(node(middle, last))

    return F.when(key < lows[0], F.lit(-1).cast("bigint")).otherwise(node(0, len(lows) - 1)) if lows else F.lit(-1).cast("bigint")


@dataclass(frozen=True)
class Slices:
    """Cut points of large subjects (``longest`` at most); ``bounds`` is None when no subject needs cutting."""

    bounds: DataFrame | None = None
    longest: int = 0


def global_index(df: DataFrame, order: str, name: str = "index", rows_per_range: int = ROWS_PER_SLICE) -> DataFrame:
    """0-based position of every row in the order of a unique column.

    The rows are cut into key ranges by sampled bounds, numbered inside each range and
    shifted by the sizes of the ranges before.  How many ranges follows from the row
    count; a table of one range has no bounds.
    """
    rows = df.count()
    ranges = max(1, round(rows / rows_per_range))
    points: list = []
    if ranges > 1:
        share = min(1.0, ranges * SAMPLED_ROWS_PER_SLICE / rows)
        tile = F.ntile(ranges).over(Window.orderBy(order))  # over the sample
        cuts = df.select(order).sample(fraction=share, seed=11).withColumn("tile", tile).groupBy("tile").agg(F.min(order).alias("low"))
        points = sorted(row["low"] for row in cuts.where("tile > 1").collect())  # one per range
    lookup = small_table(df.sparkSession, [(points,)], f"_points array<{dict(df.dtypes)[order]}>")
    ranged = df.crossJoin(F.broadcast(lookup)).select(
        *df.columns, search(F.col("_points"), F.col(order), len(points)).alias("_range"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # one row per range
    shift = shift.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    numbered = ranged.withColumn("_place", place).join(F.broadcast(shift), "_range")
    return numbered.select(*df.columns, (F.col("_place") + F.col("_shift")).cast("bigint").alias(name))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """1-based place of every row of a table in a sort order, however long the table is.

    Range partitions are sorted and kept; places inside a partition are shifted by the
    sizes of the partitions before.
    """
    kept = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    shift = shift.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.withColumn("_place", place).join(F.broadcast(shift), "_part").select(
        *df.columns, (F.col("_place") + F.col("_shift")).cast("bigint").alias(name))


def find_slices(log: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> Slices:
    """Choose cut points for the subjects with more than one slice of events.

    One pass counts events per subject (reduced on the map side); only ids of subjects
    that need cutting are sampled, about ``SAMPLED_ROWS_PER_SLICE`` per slice.
    """
    counts = log.groupBy("subject").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2 * rows_per_slice)
    heavy = counts.collect()  # at most half as many as the log has slices
    if not heavy:
        return Slices()
    large = small_table(log.sparkSession, [tuple(r) for r in heavy], "subject string, _n bigint")
    wanted = F.col("_n") / rows_per_slice * SAMPLED_ROWS_PER_SLICE
    sampled = log.select("subject", "id").join(F.broadcast(large), "subject").where(F.rand(11) < wanted / F.col("_n"))
    place = F.row_number().over(Window.partitionBy("subject").orderBy("id"))
    every = max(1, min(SAMPLED_ROWS_PER_SLICE, rows_per_slice))
    cuts = (
        sampled.withColumn("place", place)
        .where(F.col("place") % every == 0)
        .groupBy("subject")
        .agg(F.sort_array(F.collect_set("id")).alias("_bounds"))
    )
    rows = cuts.collect()  # one id per slice
    if not rows:
        return Slices()
    return Slices(small_table(log.sparkSession, rows, "subject string, _bounds array<string>"), max(len(r[1]) for r in rows))


@dataclass(frozen=True)
class Ordered:
    """A log with ``slice``, ``prev_type``, ``next_type`` and ``pos`` per event."""

    df: DataFrame
    slices: Slices
    order: str = "id"

    @property
    def keys(self) -> list[str]:
        return ["subject"] if self.slices.bounds is None else ["subject", "slice"]

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def _seams(self, *summary: Column) -> DataFrame:
        """Summary rows of the slices of cut subjects: small, one row per slice.

        Rows are told apart after grouping, so that the summary is made from the same
        exchange as the windows and the log is neither read nor shuffled again.
        """
        sums = self.df.groupBy("subject", "slice").agg(F.max("sliced").alias("_cut"), *summary)
        return sums.where("_cut").drop("_cut")

    def running(self, fold=F.sum, **values: Column) -> "Ordered":
        """Running sum (or running ``F.max``) per subject, current event included."""
        names = list(values)
        staged = self.df.select("*", *[values[n].cast("bigint").alias(f"_{n}") for n in names])
        upto = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = staged.select("*", *[fold(f"_{n}").over(upto).alias(n) for n in names]).drop(*[f"_{n}" for n in names])
        if self.slices.bounds is None:
            return replace(self, df=local)
        seams = replace(self, df=staged)._seams(*[fold(f"_{n}").alias(n) for n in names])
        earlier = Window.partitionBy("subject").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = seams.select("subject", "slice", *[fold(n).over(earlier).alias(f"_{n}") for n in names])
        kept = [c for c in local.columns if c not in names]

        def carried(name: str) -> Column:
            before = F.col(f"_{name}")
            return F.col(name) + F.coalesce(before, F.lit(0)) if fold is F.sum else F.greatest(F.col(name), before)

        joined = local.join(F.broadcast(offsets), ["subject", "slice"], "left")
        return replace(self, df=joined.select(*kept, *[carried(n).alias(n) for n in names]))


def kept_order(log: DataFrame, slices: Slices | None = None) -> Ordered:
    """``in_order`` once and for all: without ids, which positions stand for from here on, and written as a table."""
    flow = in_order(log, slices)
    return replace(flow, df=kept_table(flow.df.drop("id"), "flow"), order="pos")


def in_order(log: DataFrame, slices: Slices | None = None, extra: tuple[str, ...] = ()) -> Ordered:
    """Neighbouring types and 1-based position of every event in its subject.

    A missing type is empty text, so ``prev_type`` is NULL exactly at position 1.
    """
    slices = slices or find_slices(log)
    base = log.select("subject", "id", F.coalesce("type", F.lit("")).alias("type"), *extra)
    if slices.bounds is None:
        w = Window.partitionBy("subject").orderBy("id")
        df = base.select(
            "*", F.lag("type").over(w).alias("prev_type"), F.lead("type").over(w).alias("next_type"),
            F.row_number().over(w).cast("bigint").alias("pos"),
        )
        return Ordered(df, slices)
    cut = base.join(F.broadcast(slices.bounds), "subject", "left").select(
        *base.columns,
        F.when(F.col("_bounds").isNull(), 0).otherwise(search(F.col("_bounds"), F.col("id"), slices.longest)).alias("slice"),
        F.col("_bounds").isNotNull().alias("sliced"),
    ).repartition("subject", "slice")
    w = Window.partitionBy("subject", "slice").orderBy("id")
    local = cut.select(
        "*", F.lag("type").over(w).alias("prev_type"), F.lead("type").over(w).alias("next_type"),
        F.row_number().over(w).cast("bigint").alias("pos"),
    )
    seams = Ordered(cut, slices)._seams(
        F.count(F.lit(1)).alias("n"), F.min_by("type", "id").alias("first"), F.max_by("type", "id").alias("last")
    )
    along = Window.partitionBy("subject").orderBy("slice")
    repair = seams.select(
        "subject", "slice",
        F.lag("last").over(along).alias("_prev"), F.lead("first").over(along).alias("_next"),
        F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    df = local.join(F.broadcast(repair), ["subject", "slice"], "left").select(
        *base.columns, "slice", "sliced",
        F.coalesce("prev_type", "_prev").alias("prev_type"),
        F.coalesce("next_type", "_next").alias("next_type"),
        (F.col("pos") + F.coalesce("_before", F.lit(0))).alias("pos"),
    )
    return Ordered(df, slices)


def sequences(log: DataFrame, slices: Slices | None = None, block: int = 1000) -> DataFrame:
    """Ordered types per subject, in blocks of at most ``block`` steps.

    Concatenating the blocks of a subject gives its whole sequence; an ordinary
    subject has one block.
    """
    flow = in_order(log, slices).df
    return blocks_of(flow, ["subject"], block).select("subject", "block", F.col("types"))


def blocks_of(flow: DataFrame, keys: list[str], block: int, pos: str = "pos") -> DataFrame:
    """Types in position order, cut into blocks: keys, block, offset, types."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), "type")))
    return (
        flow.withColumn("block", F.floor((F.col(pos) - 1) / block).cast("bigint"))
        .groupBy(*keys, "block")
        .agg(steps.alias("steps"))
        .select(*keys, "block", F.col("steps.type").alias("types"), F.col("steps.pos").alias("places"))
    )
