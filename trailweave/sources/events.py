"""The event log: schema, reads, scoped scans, counts and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.functions.predicates import Stage, subject_prefix

EVENT_COLUMNS = ["id", "source", "subject", "type", "time"]
EVENT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in [*EVENT_COLUMNS, "data"]])


def read_events(spark: SparkSession, path: str, with_payload: bool = False, fmt: str = "json") -> DataFrame:
    """Log from line-delimited JSON (strict: one bad line fails the read) or Parquet.

    The payload stays JSON text and is left out of the scan unless asked for.
    """
    reader = spark.read.schema(EVENT_SCHEMA)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    columns = [*EVENT_COLUMNS, "data"] if with_payload else EVENT_COLUMNS
    log = reader.format(fmt).load(path).select(*columns)
    # Written logs have no missing fields, and filters must reach their scan.
    return log.select(*filled(columns)) if fmt == "json" else log


def filled(columns: list[str]) -> list[Column]:
    """The columns of an event; a missing field other than the payload is empty text."""
    return [F.col(c) if c == "data" else F.coalesce(c, F.lit("")).alias(c) for c in columns]


#: Writer options of the Bloom filters.
BLOOM = {"parquet.bloom.filter.adaptive.enabled": "true"} | {
    f"parquet.bloom.filter.enabled#{column}": "true" for column in ("id", "subject")}


def write_log(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Materialise a log as Parquet laid out for subject and id filters.

    Range partitioning by (subject, id) keeps subtree scans to a few files and lets
    a very large subject spread over many of them.  Row groups hold Bloom filters of
    both columns, no larger than their values need, so the lookup of one event reads
    the row groups that may hold it although ids lie across all files.
    """
    columns = [c for c in [*EVENT_COLUMNS, "data"] if c in log.columns]
    (
        log.select(*filled(columns))
        .repartitionByRange("subject", "id")
        .sortWithinPartitions("subject", "id")
        .write.mode(mode)
        .options(**BLOOM)
        .parquet(path)
    )


def scan_scope(log: DataFrame, scope: Stage, limit: int = 0) -> DataFrame:
    """Subtree, types and id bounds in one pushed-down filter, oldest first if limited."""
    return read_limit(log.where(scope.predicate()), limit)


def scan_subtree(log: DataFrame, prefix: str = "") -> DataFrame:
    return log.where(subject_prefix(prefix))


def scan_type(log: DataFrame, event_type: str, limit: int = 0) -> DataFrame:
    return read_limit(log.where(F.col("type") == event_type), limit)


def read_limit(log: DataFrame, limit: int = 0) -> DataFrame:
    """First ``limit`` events in append order; nothing to cut when not positive."""
    return log.orderBy("id").limit(limit) if limit > 0 else log


def truncation(log: DataFrame, limit: int = 0) -> DataFrame:
    """Did the limit cut, and how much was left out?"""
    total = F.count(F.lit(1))
    cap = F.lit(limit).cast("bigint")
    cut = (F.lit(limit > 0)) & (total >= cap)
    return log.agg(
        total.alias("total"),
        F.when(F.lit(limit > 0), F.least(total, cap)).otherwise(total).alias("loaded"),
        cut.alias("truncated"),
        F.when(F.lit(limit > 0) & (total > cap), total - cap).otherwise(F.lit(0)).cast("bigint").alias("not_loaded"),
    )


def event_types(log: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Types with their counts and whether a schema is registered for them."""
    counts = log.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
    if schemas is None:
        return counts.withColumn("has_schema", F.lit(False))
    known = schemas.select("type").distinct().withColumn("has_schema", F.lit(True))
    return counts.join(known, "type", "left").withColumn("has_schema", F.coalesce("has_schema", F.lit(False)))


def log_info(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("events"))


def cloudevents(log: DataFrame, source: str, prefix: str = "", ids: str | None = None) -> DataFrame:
    """CloudEvents envelopes as one JSON text column ``value``.

    ``ids`` names the column to take event ids from; without it fresh random ids
    are made, so write the result once rather than reading it twice.
    """
    body = F.when(F.coalesce(F.col("data"), F.lit("")) == "", F.lit("{}")).otherwise(F.col("data"))
    event_id = F.col(ids) if ids else F.concat(F.lit("ev-"), F.uuid())
    envelope = F.concat(
        F.lit('{"specversion":"1.0","type":'), _quoted("type"),
        F.lit(',"source":'), _quoted(F.lit(source)),
        F.lit(',"id":'), _quoted(event_id),
        F.lit(',"subject":'), _quoted(F.concat(F.lit(prefix), F.col("subject"))),
        F.lit(',"datacontenttype":"application/json","data":'), body, F.lit("}"),
    )
    return log.select(envelope.alias("value"))


def _quoted(value: Column | str) -> Column:
    """JSON text of one string: a one-field object without its frame."""
    column = F.col(value) if isinstance(value, str) else value
    framed = F.to_json(F.struct(F.coalesce(column, F.lit("")).alias("v")))
    return F.regexp_extract(framed, r'(?s)^\{"v":(.*)\}\z', 1)


def write_cloudevents(envelopes: DataFrame, path: str | None = None, **kafka: str) -> None:
    """Envelopes to text files, or to Kafka when topic options are given."""
    if kafka:
        envelopes.write.format("kafka").options(**kafka).save()
    else:
        envelopes.write.text(path)


def replay_feed(log: DataFrame) -> DataFrame:
    """Ordered ``{s, t, ts}`` rows for playing a log back."""
    return log.select(F.col("subject").alias("s"), F.col("type").alias("t"), F.col("time").alias("ts"), "id").orderBy("id")


def export_replay(log: DataFrame, path: str) -> None:
    replay_feed(log).drop("id").write.json(path)
