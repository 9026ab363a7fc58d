"""Event space: dotted charts, density grids and the choice between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.lifecycle import phase, phase_priority
from trailweave.functions.paths import common_path_prefix
from trailweave.functions.predicates import id_from, id_to, subject_prefix, subject_range
from trailweave.functions.text import band_label, log_intensity, normalise_x, rfc3339, variant_label
from trailweave.operators.ordering import Slices, find_slices, global_index, which_range
from trailweave.operators.variants import most_common, subject_signatures, tally, tie_breakers, with_heads
from trailweave.session import cut_lineage, kept_table

# Budgets of the automatic choice and sizes of the views.
MAX_ROWS = 70
MAX_DOTS = 6000
COLUMNS = 120


@dataclass(frozen=True)
class Axis:
    """Events with a ``value``, its range, and whether it is real time."""

    df: DataFrame
    by_time: bool
    low: int
    high: int
    events: int


def axis(log: DataFrame) -> Axis:
    """Time if every event has one and they differ, else position in the log.

    One row of statistics is read to decide; positions are only computed if needed.
    """
    micros = F.unix_micros(rfc3339(F.col("time")))
    stats = log.agg(
        F.count(F.lit(1)).alias("n"), F.count(micros).alias("timed"), F.min(micros).alias("low"),
        F.max(micros).alias("high"),
    ).first()
    if stats["n"] and stats["timed"] == stats["n"] and stats["high"] > stats["low"]:
        return Axis(log.withColumn("value", micros), True, stats["low"], stats["high"], stats["n"])
    return Axis(global_index(log, "id", "value"), False, 0, max(stats["n"] - 1, 0), stats["n"])


def axis_facts(log: DataFrame) -> DataFrame:
    """The axis decision as one row."""
    micros = F.unix_micros(rfc3339(F.col("time")))
    facts = log.agg(
        F.count(F.lit(1)).alias("events"),
        (F.count(micros) == F.count(F.lit(1))).alias("all_timed"),
        F.min(micros).alias("low"), F.max(micros).alias("high"),
    )
    by_time = F.coalesce(F.col("all_timed") & (F.col("high") > F.col("low")), F.lit(False))
    return facts.select(
        "events", by_time.alias("by_time"),
        F.when(by_time, F.col("low")).otherwise(0).cast("bigint").alias("low"),
        F.when(by_time, F.col("high")).otherwise(F.greatest(F.col("events") - 1, F.lit(0))).cast("bigint").alias("high"),
    )


def dotted_rows(placed: Axis, max_rows: int = 60) -> DataFrame:
    """The busiest subjects, in order of their first event."""
    per_subject = placed.df.groupBy("subject").agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("first_value")
    )
    kept = per_subject.orderBy(F.desc("count"), "subject").limit(max_rows)
    place = F.row_number().over(Window.orderBy("first_value", "subject")) - 1
    return kept.select(place.cast("bigint").alias("row"), "subject", "count")


def dotted_points(placed: Axis, max_rows: int = 60) -> DataFrame:
    """One dot per event of a charted subject."""
    rows = F.broadcast(dotted_rows(placed, max_rows).select("row", "subject"))  # at most max_rows rows
    return placed.df.join(rows, "subject").select(
        "row", normalise_x(F.col("value"), F.lit(placed.low), F.lit(placed.high)).alias("x"),
        "id", "type", phase(F.col("type")).alias("phase"), "subject", "time",
    )


def band_of_subject(log: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(subject, band): name order cut into near-equal runs, larger ones first."""
    # Numbering takes several passes; they read the names, not the log.
    names = global_index(kept_table(log.select("subject").distinct(), "subjects"), "subject", "at")
    total = names.agg(F.count(F.lit(1)).alias("total"))
    count, base, rem = F.col("total"), F.floor(F.col("total") / max_rows), F.col("total") % max_rows
    head = rem * (base + 1)
    banded = (
        F.when(count <= max_rows, F.col("at"))
        .when(F.col("at") < head, F.floor(F.col("at") / (base + 1)))
        .otherwise(rem + F.floor((F.col("at") - head) / F.greatest(base, F.lit(1))))
    )
    return names.crossJoin(F.broadcast(total)).select("subject", banded.cast("bigint").alias("band"))


def subject_bands(log: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Bands with label, common path and exact subject range."""
    low, high, members = F.min("subject"), F.max("subject"), F.count(F.lit(1))
    return cut_lineage(band_of_subject(log, max_rows).groupBy("band").agg(
        band_label(low, high, members).alias("label"),
        common_path_prefix(low, high, members).alias("prefix"),
        low.alias("from"), high.alias("to"), members.alias("subjects"),
    ))  # max_rows rows


def variant_bands(log: DataFrame, max_rows: int = MAX_ROWS, slices: Slices | None = None) -> tuple[DataFrame, DataFrame]:
    """Bands of equal behaviour, and the band of every subject.

    The rarest variants beyond the row budget share one last band.
    """
    slices = slices or find_slices(log)
    signed, pieces = subject_signatures(log, slices)
    signed = cut_lineage(signed)
    deepest = signed.agg(F.max("length")).first()[0] or 0
    ident = ["h1", "h2", "length"]
    counted = cut_lineage(tally(signed))
    total = counted.count()
    kept = max_rows - 1 if total > max_rows else max_rows
    counted, keys = tie_breakers(with_heads(most_common(counted, kept), pieces), pieces, deepest, "\u0000", ["count"])
    order = [F.desc("count"), *keys, "h1", "h2"]
    top = counted.orderBy(*order).limit(kept).withColumn(
        "band", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint")
    )
    top = cut_lineage(top)
    member = signed.join(F.broadcast(top.select(*ident, "band")), ident, "left").select(
        "subject", F.coalesce("band", F.lit(kept).cast("bigint")).alias("band")
    )
    low, high, members = F.min("subject"), F.max("subject"), F.count(F.lit(1))
    sized = member.groupBy("band").agg(members.alias("subjects"), common_path_prefix(low, high, members).alias("prefix"))
    name = variant_label(F.slice("head", 1, 3), F.col("length"), F.col("last_type"), F.col("subjects"))
    rest = F.concat(F.lit(f"+{total - kept} more variants · "), F.col("subjects").cast("string"))
    bands = sized.join(F.broadcast(top.select("band", "head", "length", "last_type")), "band", "left").select(
        "band", F.when(F.col("length").isNull(), rest).otherwise(name).alias("label"), "prefix",
        F.lit("").alias("from"), F.lit("").alias("to"), "subjects",
    )
    return bands, member


def _column(placed: Axis, cols: int) -> Column:
    share = normalise_x(F.col("value"), F.lit(placed.low), F.lit(placed.high))
    return F.greatest(F.least(F.floor(share * cols), F.lit(cols - 1)), F.lit(0)).cast("bigint")


def _summary() -> list[Column]:
    return [F.count(F.lit(1)).alias("count"), F.min("id").alias("min_id"), F.max("id").alias("max_id")]


def _fold() -> list[Column]:
    return [F.sum("count").alias("count"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id")]


def _cells(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Fold counts per (keys, type) into cells with their leading phase.

    Types are turned into phases here, once per count rather than once per event.
    """
    phased = counted.groupBy(*keys, phase(F.col("type")).alias("phase")).agg(*_fold())
    lead = F.max_by("phase", F.struct("count", -phase_priority(F.col("phase"))))
    return phased.groupBy(*keys).agg(
        F.sum("count").alias("count"), lead.alias("phase"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id")
    )


def band_lows(bands: DataFrame) -> list[str]:
    """Lower ends of name-ordered bands: at most ``max_rows`` names."""
    return [row["from"] for row in bands.select("band", "from").orderBy("band").collect()]


def density(placed: Axis, bands: DataFrame, member: DataFrame | None = None, cols: int = COLUMNS) -> DataFrame:
    """Sparse grid cells (row, col, count, phase, min_id, max_id).

    Name-ordered bands are found by their range, without moving the log.  Scattered
    bands come with a ``member`` table; the log is first reduced per subject, column
    and phase so that a huge subject is small when it is shuffled.
    """
    marked = placed.df.select("subject", "id", _column(placed, cols).alias("col"), "type")
    if member is None:
        ranged = marked.select(which_range(F.col("subject"), band_lows(bands)).alias("row"), "col", "type", "id")
        return _cells(ranged.where("row >= 0").groupBy("row", "col", "type").agg(*_summary()), ["row", "col"])
    reduced = marked.groupBy("subject", "col", "type").agg(*_summary())
    placed_cells = reduced.join(member.withColumnRenamed("band", "row"), "subject")
    return _cells(placed_cells.groupBy("row", "col", "type").agg(*_fold()), ["row", "col"])


def dominant_phase(events: DataFrame, *keys: str) -> DataFrame:
    """Most frequent phase per key; equal counts go to the more alarming phase."""
    cells = _cells(events.groupBy(*keys, "type").agg(*_summary()), list(keys))
    return cells.select(*keys, "phase", "count")


def density_rows(cells: DataFrame, bands: DataFrame) -> DataFrame:
    """Bands with the number of events they hold."""
    held = cells.groupBy(F.col("row").alias("band")).agg(F.sum("count").alias("count"))
    return bands.join(held, "band", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def density_view(cells: DataFrame) -> DataFrame:
    """Cells with the opacity they are drawn with."""
    busiest = cells.agg(F.max("count").alias("busiest"))
    return cells.crossJoin(F.broadcast(busiest)).select(
        *cells.columns, log_intensity(F.col("count"), F.col("busiest")).alias("opacity")
    )


def drill(cells: DataFrame, bands: DataFrame, events: DataFrame, member: DataFrame | None = None) -> DataFrame:
    """Events inside the subjects and the id range of cells (at most rows x columns of them).

    The band of an event is found by its name, or through ``member`` where bands are not
    name ranges.  The cells of a band travel as one array, which is filtered in place, so an
    event is copied only into the cells that hold it.
    """
    if member is None:
        bands = cut_lineage(bands)
        ends = bands.select(F.col("band").alias("row"), F.col("to").alias("_to"))
        located = events.withColumn("row", which_range(F.col("subject"), band_lows(bands)))
    else:
        ends = bands.select(F.col("band").alias("row"), F.lit(None).cast("string").alias("_to"))
        located = events.join(member.withColumnRenamed("band", "row"), "subject")
    held = cells.groupBy("row").agg(F.collect_list(F.struct("col", "min_id", "max_id")).alias("_cells")).join(ends, "row")
    hit = F.filter("_cells", lambda c: F.col("id").between(c["min_id"], c["max_id"]))
    found = located.join(F.broadcast(held), "row").where("_to IS NULL OR subject <= _to")  # one row per band
    return found.select("row", F.explode(hit).alias("_cell"), *events.columns).select("row", "_cell.col", *events.columns)


def cell_filter(min_id: str, max_id: str, low: str = "", high: str = "", prefix: str = "") -> Column:
    """Predicate of one clicked cell: subject range, else subtree, else ids alone."""
    subjects = subject_range(low, high) if low and high else subject_prefix(prefix)
    return subjects & id_from(min_id) & id_to(max_id)


def detail(log: DataFrame, max_rows: int = MAX_ROWS, max_dots: int = MAX_DOTS) -> DataFrame:
    """Which level of detail a log calls for, with the numbers behind it."""
    counts = log.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count(F.lit(1)).alias("subjects")
    )
    dense = (F.col("subjects") > max_rows) | (F.col("events") > max_dots)
    return counts.select("events", "subjects", F.when(dense, "density").otherwise("dots").alias("mode"))
