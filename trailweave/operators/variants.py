"""Variants: which whole type sequences occur, and how often.

A sequence is identified by a fingerprint that can be aggregated in any order: the
XOR of hashes of its (position, type) pieces, twice with different salts, plus its
length.  So variants are counted with ordinary partial aggregation and no sequence
has to fit into one row.  Two 64-bit digests and the length decide equality.  Text is made for
one example run of each distinct sequence only: its first ``HEAD`` steps for sorting;
sequences that agree up to there are told apart by later steps, block by block.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.text import pct
from trailweave.operators.discovery import Discovery
from trailweave.operators.ordering import Ordered, Slices, in_order, numbered
from trailweave.session import checked_broadcast, cut_lineage, kept_table

HEAD = 1000
# Steps written out at a time.
CHUNK = 100_000


def _fingerprint() -> list[Column]:
    """Order-free digest of pieces (start, type, n)."""
    return [F.bit_xor(F.xxhash64(F.lit(salt), "start", "type", "n")).alias(f"h{salt}") for salt in (1, 2)]


def _steps_between(low: int, high: int) -> Column:
    """Types of the pieces that lie at positions low..high-1, in order."""
    begin = F.greatest(F.col("start"), F.lit(low))
    times = F.least(F.col("start") + F.col("n"), F.lit(high)) - begin
    inside = F.when(times > 0, F.struct(begin.alias("at"), "type", times.cast("int").alias("times")))
    ordered = F.array_sort(F.collect_list(inside))
    return F.flatten(F.transform(ordered, lambda p: F.array_repeat(p["type"], p["times"])))


def whole_pieces(flow: Ordered) -> DataFrame:
    """Every event as a piece of its subject's sequence."""
    return flow.df.select(
        "subject", F.lit(0).cast("bigint").alias("run"), "id", (F.col("pos") - 1).alias("start"), "type",
        F.lit(1).cast("bigint").alias("n"),
    )


def run_pieces(found: Discovery) -> DataFrame:
    """Pieces of the runs, written down once per discovery."""
    if not hasattr(found, "_pieces"):
        found._pieces = kept_table(_run_pieces(found), "pieces")
    return found._pieces


def _run_pieces(found: Discovery) -> DataFrame:
    """Runs of every subject with parallel stretches brought into one order.

    Pieces are (subject, run, start, type, n): ``n`` events of a type from position
    ``start`` on.  A stretch inside one parallel group is a count per type, since its
    canonical order is simply sorted.
    """
    flow = _split(found, found.flow)
    if found.group_of.isEmpty():
        return flow.df.select(
            "subject", "run", (F.col("pos") - F.col("run_start")).alias("start"), "type",
            F.lit(1).cast("bigint").alias("n"),
        )
    counted = flow.df.groupBy("subject", "run", "island", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("pos") - F.col("run_start")).alias("first"))
    stretch = Window.partitionBy("subject", "run", "island")
    smaller = stretch.orderBy("type").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        "subject", "run",
        (F.min("first").over(stretch) + F.coalesce(F.sum("n").over(smaller), F.lit(0))).alias("start"),
        "type", "n",
    )


def _split(found: Discovery, flow: Ordered, stretches: bool = True) -> Ordered:
    """Events with run number, run start and, if asked for, stretch number."""
    if not stretches:
        # Pairs of few types need no count before they are sent; then one query counts and numbers.
        inside = found.few_types and "_counted" not in found.__dict__
        marks = (found.within(flow) if inside else found).classified.select(
            F.col("prev_type").alias("p"), F.col("type").alias("t"), "restart")
        return _numbered_runs(flow, F.broadcast(marks) if inside else checked_broadcast(cut_lineage(marks)))
    groups = found.group_of
    marks = (
        found.classified.join(groups.select("type", F.col("grp")), "type", "left")
        .join(groups.select(F.col("type").alias("prev_type"), F.col("grp").alias("prev_grp")), "prev_type", "left")
        .select(
            F.col("prev_type").alias("p"), F.col("type").alias("t"), "restart",
            (F.col("prev_type").isNull() | F.col("restart") | F.col("grp").isNull() | ~F.col("grp").eqNullSafe(F.col("prev_grp")))
            .alias("fresh"),
        )
    )
    # One row per pair of types; without the hint its unknown size would shuffle the log.
    return _numbered_runs(flow, checked_broadcast(cut_lineage(marks)), island=F.col("fresh"))


def _numbered_runs(flow: Ordered, marks: DataFrame, **counts: Column) -> Ordered:
    """Adds run, run_start and further running counts of what the pairs (p, t) are marked with."""
    df = flow.df.join(marks, F.col("prev_type").eqNullSafe(F.col("p")) & (F.col("type") == F.col("t"))).drop("p", "t")
    flow = replace(flow, df=df).running(run=F.col("restart"), **counts)
    begins = F.when(F.col("prev_type").isNull() | F.col("restart"), F.col("pos"))
    return flow.running(fold=F.max, run_start=begins)


def split_runs(found: Discovery) -> DataFrame:
    """(subject, id, type, pos, run, step): run numbers from 1, steps from 1."""
    return _split(found, in_order(found.log, found.slices), stretches=False).df.select(
        "subject", "id", "type", "pos", (F.col("run") + 1).alias("run"),
        (F.col("pos") - F.col("run_start") + 1).alias("step"),
    )


def canonicalise(found: Discovery) -> DataFrame:
    """Runs in canonical order as (subject, run, step, type)."""
    last = F.col("start") + F.col("n")
    # In two levels, so that a piece of any size never becomes one long array.
    chunks = run_pieces(found).select(
        "subject", "run", "type", last.alias("last"),
        F.explode(F.sequence(F.col("start") + 1, last, F.lit(CHUNK).cast("bigint"))).alias("low"),
    )
    at = F.explode(F.sequence(F.col("low"), F.least(F.col("low") + (CHUNK - 1), F.col("last"))))
    return chunks.select("subject", (F.col("run") + 1).alias("run"), at.alias("step"), "type")


def signatures(pieces: DataFrame) -> DataFrame:
    """One row per (subject, run): fingerprint, length, and the first id of pieces that have one."""
    first = [F.min("id").alias("first_id")] if "id" in pieces.columns else []
    return pieces.groupBy("subject", "run").agg(*_fingerprint(), F.sum("n").alias("length"), *first)


def tally(signed: DataFrame) -> DataFrame:
    """Distinct sequences with how many runs follow them and one of those runs."""
    return signed.groupBy("h1", "h2", "length").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct("subject", "run")).alias("example"),
    )


def with_heads(counted: DataFrame, pieces: DataFrame) -> DataFrame:
    """Adds the first ``HEAD`` steps and the last type, taken from the example run."""
    wanted = checked_broadcast(counted.select("h1", "h2", "length", "example.*"))
    heads = pieces.join(wanted, ["subject", "run"]).groupBy("h1", "h2", "length").agg(
        _steps_between(0, HEAD).alias("head"), F.max_by("type", "start").alias("last_type"))
    return counted.join(heads, ["h1", "h2", "length"])


def most_common(counted: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent sequences and all that tie with the last of them; all if ``n`` is 0."""
    if n <= 0:
        return counted
    least = counted.orderBy(F.desc("count")).limit(n).agg(F.coalesce(F.min("count"), F.lit(0)).alias("_least"))
    return counted.crossJoin(F.broadcast(least)).where("count >= _least").drop("_least")  # one row


def tie_breakers(
    counted: DataFrame, pieces: DataFrame, deepest: int, joiner: str, by: list[str]
) -> tuple[DataFrame, list[str]]:
    """Adds sort columns that put distinct sequences into the order of their text.

    The first column is the text of the head.  Only while sequences longer than what
    has been compared still tie is the next block of steps looked at, for those alone.
    """
    key = F.array_join("head", joiner)
    # A head that goes on is followed by the joiner, just as in the whole text.
    key = F.when(F.col("length") > HEAD, F.concat(key, F.lit(joiner))).otherwise(key)
    counted, keys, reach = counted.withColumn("text0", key), ["text0"], HEAD
    if deepest <= HEAD:
        return counted, keys
    counted = cut_lineage(counted)
    while reach < deepest:
        tied = counted.where(F.col("length") >= reach).groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        open_ties = cut_lineage(counted.join(tied, [*by, *keys], "left_semi").select("h1", "h2", "length", "example.*"))
        if open_ties.isEmpty():
            break
        name = f"text{len(keys)}"
        piece = pieces.join(open_ties, ["subject", "run"]).groupBy("h1", "h2", "length").agg(
            _steps_between(reach, reach + HEAD).alias("steps")
        )
        text = F.array_join("steps", joiner)
        text = F.when(F.col("length") > reach + HEAD, F.concat(text, F.lit(joiner))).otherwise(text)
        piece = piece.select("h1", "h2", "length", text.alias(name))
        counted = cut_lineage(counted.join(piece, ["h1", "h2", "length"], "left").fillna("", [name]))
        keys.append(name)
        reach += HEAD
    return counted, keys


def variants(found: Discovery, max_n: int = 0) -> DataFrame:
    """Canonical run sequences by frequency, then by text: rank, length, count, pct, block, sequence.

    Every step is returned: a sequence has one row per ``HEAD`` steps, numbered by
    ``block`` from 0, so ordinary sequences have one row.
    """
    pieces, ranked = _ranked(found, max_n)
    top = ranked.select("rank", "example.subject", "example.run")
    last = F.floor((F.col("start") + F.col("n") - 1) / HEAD)
    spread = pieces.join(checked_broadcast(top), ["subject", "run"]).select(
        "rank", "start", "type", "n", F.explode(F.sequence(F.floor(F.col("start") / HEAD), last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * HEAD)
    times = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * HEAD) - begin
    ordered = F.array_sort(F.collect_list(F.struct(begin.alias("at"), "type", times.cast("int").alias("times"))))
    steps = F.flatten(F.transform(ordered, lambda p: F.array_repeat(p["type"], p["times"])))
    texts = spread.groupBy("rank", "block").agg(F.array_join(steps, " ").alias("sequence"))
    return ranked.drop("example").join(texts, "rank").select("rank", "length", "count", "pct", "block", "sequence")


def _ranked(found: Discovery, max_n: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of all runs, and the ranked sequences with an example run each."""
    pieces = run_pieces(found)
    counted = most_common(cut_lineage(tally(signatures(pieces))), max_n)
    named, keys = tie_breakers(with_heads(counted, pieces), pieces, found.deepest, " ", ["count"])
    order = [F.desc("count"), *map(F.col, keys), F.col("h1"), F.col("h2")]
    if max_n > 0:
        top = named.orderBy(*order).limit(max_n)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    else:
        ranked = numbered(named, order, "rank")
    return pieces, cut_lineage(ranked.crossJoin(F.broadcast(found.totals.select("traces"))).select(
        "rank", "length", "count", pct(F.col("count"), F.col("traces")).alias("pct"), "example"))


def variant_steps(found: Discovery, max_n: int) -> DataFrame:
    """Steps of the top variants as rows (rank, start, type, n), whatever their length."""
    if max_n < 1:
        raise ValueError("variant_steps lists the steps of a number of top variants")
    pieces, ranked = _ranked(found, max_n)
    top = ranked.select("rank", "example.subject", "example.run")  # max_n rows
    return pieces.join(F.broadcast(top), ["subject", "run"]).select("rank", "start", "type", "n")


def subject_signatures(log: DataFrame, slices: Slices | None = None) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the whole, unsplit sequences, and their pieces."""
    pieces = whole_pieces(in_order(log, slices))
    return signatures(pieces), pieces


def walk_order(log: DataFrame, mode: str = "chrono", slices: Slices | None = None, deepest: int | None = None) -> DataFrame:
    """Subjects in walking order: by first event, by common or by rare behaviour first.

    Columns: subject, first_id, length, population, is_unique; rows come sorted.
    """
    signed, pieces = subject_signatures(log, slices)
    signed = cut_lineage(signed)
    counted = tally(signed)
    shown = ["subject", "first_id", "length", "population", "is_unique"]
    keys: list[str] = []
    if mode == "variant":
        deepest = deepest or signed.agg(F.max("length")).first()[0] or 0
        counted, keys = tie_breakers(with_heads(cut_lineage(counted), pieces), pieces, deepest, " → ", ["count"])
    mates = counted.select("h1", "h2", "length", F.col("count").alias("population"), *keys)
    order = {
        "chrono": ["first_id"],
        "variant": [F.desc("population"), *keys, "first_id"],
        "rare": ["population", "length", "first_id"],
    }[mode]
    walked = signed.select("subject", "first_id", "h1", "h2", "length").join(mates, ["h1", "h2", "length"])
    return walked.withColumn("is_unique", F.col("population") == 1).orderBy(*order).select(*shown)
