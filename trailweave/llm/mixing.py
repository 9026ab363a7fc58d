"""Mixing sources to target weights with hash-threshold histograms.

A document's place in its source is a hash of its id.  What a source gives beyond whole
repeats is "all documents below a threshold of that hash".  The threshold is found by
adding sizes per source and hash bucket, taking the bucket in which the budget ends, and
refining that bucket only, five times 12 bits.  Nothing is sorted but the at most 4,096
buckets of a source; the documents are filtered by comparison with their source's
threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import WORD, documents, stored
from trailweave.session import checked_broadcast, cut_lineage

LEVELS, WIDTH = 5, 12


def hash_rank(id_col: str) -> Column:
    """60 bits of the md5 of the id as text (a missing id counts as empty text)."""
    text = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target, repeats, rest``.

    Weights go round by the code-point order of the sources, null last.  Shares follow the
    weights, but no target is above ``most`` times its source; what is cut off goes to
    the others by weight.  With sources in order of ``limit / weight``, exactly the
    first ones are cut, so running sums give the level at which the rest share.
    ``repeats`` whole passes and ``rest`` words make up the target.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("bigint"))
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left", F.sum("source_size").over(everything) - F.col("used"))
        .withColumn("level", F.col("left").cast("double") / F.col("left_weight").cast("double"))
        .withColumn("cut", F.col("ratio") <= F.col("level"))
    )
    level = F.max_by(F.when(~F.col("cut"), F.col("level")), F.when(~F.col("cut"), -F.col("ratio"))).over(everything)
    rows = rows.withColumn(
        "target", F.when(F.col("cut"), F.col("limit").cast("double")).otherwise(level * F.col("weight")))
    rows = rows.withColumn(
        "repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    return rows.select(
        "source", "source_size", "target", "repeats",
        (F.col("target") - (F.col("repeats") * F.col("source_size")).cast("double")).alias("rest"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, top, edge``: documents with ``rank < top`` belong to the rest of their
    source, those with ``rank = top`` if ``edge`` (when that comes closer to it).

    ``rows`` is ``source, size, rank``; sources without a rest have no row.
    """
    state = plan.where("rest > 0").select(
        "source", "rest", F.lit(0).cast("bigint").alias("low"), F.lit(2 ** (LEVELS * WIDTH) - 1).alias("high"),
        F.lit(0).cast("bigint").alias("sum_before"))
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * WIDTH
        s = state.select(F.col("source").alias("_source"), "rest", "low", "high", "sum_before")
        inside = rows.join(
            checked_broadcast(s), rows["source"].eqNullSafe(s["_source"]) & rows["rank"].between(s["low"], s["high"]))
        buckets = inside.groupBy(
            "source", "rest", "sum_before", F.shiftright("rank", shift).alias("bucket")
        ).agg(F.sum("size").alias("size"), F.min("rank").alias("low"), F.max("rank").alias("high"))
        order = Window.partitionBy("source").orderBy("bucket")
        summed = buckets.withColumn("after", F.col("sum_before") + F.sum("size").over(order))
        # The first bucket that reaches the rest; sizes before it stay below.
        ended = summed.where((F.col("after") >= F.col("rest")) & (F.col("after") - F.col("size") < F.col("rest")))
        state = cut_lineage(ended.select(
            "source", "rest", "low", "high", (F.col("after") - F.col("size")).alias("sum_before"), "after"))
    closer = (F.col("after") <= F.col("rest")) | (F.col("after") - F.col("rest") < F.col("rest") - F.col("sum_before"))
    return state.select("source", F.col("low").alias("top"), closer.alias("edge"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (``doc_id, source, size, rank``) and one plan row per source."""
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        hash_rank(id_col).alias("rank")), "mix")
    plan = cut_lineage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    tops = thresholds(rows, plan).withColumnRenamed("source", "_source")
    joined = plan.join(tops, plan["source"].eqNullSafe(tops["_source"]), "left").drop("_source")
    return rows, cut_lineage(joined)


def times(plan: DataFrame) -> Column:
    """How often the mix takes a row that carries ``rank`` and the plan columns."""
    part = (F.col("rank") < F.col("top")) | ((F.col("rank") == F.col("top")) & F.col("edge"))
    return F.col("repeats") + F.when(part, 1).otherwise(0)


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and ``source``.

    Null texts have size 0; a null source is a source.  Documents are taken whole, so a
    source misses its target by half a document at most; rows that repeat an id are taken
    together.  The choice depends on ids and sizes only, so reruns agree.  An empty
    table gives an empty result; other columns are ignored.
    """
    rows, plan = mix_plan(docs, **options)
    p = plan.withColumnRenamed("source", "_source")
    return rows.join(checked_broadcast(p), rows["source"].eqNullSafe(p["_source"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times(p)).alias("taken"), "source")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    _, plan = mix_plan(docs, id_col, source_col, text_col, **options)
    p = plan.select(*(F.col(c).alias(f"_mix_{c}") for c in plan.columns))
    rank = hash_rank(id_col)
    part = (rank < F.col("_mix_top")) | ((rank == F.col("_mix_top")) & F.col("_mix_edge"))
    taken = F.col("_mix_repeats") + F.when(part, 1).otherwise(0)
    found = docs.join(checked_broadcast(p), docs[source_col].eqNullSafe(p["_mix_source"]))
    return found.where(taken > 0).withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1), taken.cast("int")))).select(*docs.columns)


QUERIES = {"op2_mix_sources": lambda s, d: mixed_sizes(documents(s, d))}

ORACLE = {"op2_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS rank FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, place % 3 + 1 AS weight, 3 * source_size AS lim, 3 * source_size / (place % 3 + 1) AS ratio FROM n),
u AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(lim) OVER b, 0))::DOUBLE
             / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN lim::DOUBLE ELSE
             (SELECT arg_min(level, ratio) FROM u WHERE ratio > level) * weight END AS target FROM u),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS repeats FROM t),
x AS (SELECT *, target - (repeats * source_size)::DOUBLE AS rest FROM r),
g AS (SELECT source, rank, sum(size)::BIGINT AS size FROM d GROUP BY ALL),
c AS (SELECT source, rank, sum(size) OVER (PARTITION BY source ORDER BY rank) AS after,
             sum(size) OVER (PARTITION BY source ORDER BY rank) - size AS upto FROM g)
SELECT d.doc_id, d.size, x.source_size, x.target, d.source,
       d.size * (x.repeats + CASE WHEN x.rest > 0 AND c.upto < x.rest
         AND (c.after <= x.rest OR c.after - x.rest < x.rest - c.upto) THEN 1 ELSE 0 END) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
       JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.rank = c.rank"""}
