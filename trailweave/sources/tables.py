"""Event logs derived from the relational test tables.

Ids are zero-padded so that their byte order is the order of events.  Where the
order of lines inside an order matters the id is composed from the sort fields
themselves, so no ranking pass (and no shuffle) is needed to number them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pad(column: str, width: int) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


def _instant(column: str, fraction: bool = False) -> Column:
    shape = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'" if fraction else "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return F.date_format(F.col(column), shape)


def _day(column: str) -> Column:
    return F.replace(F.col(column).cast("date").cast("string"), F.lit("-"), F.lit(""))


def user_log(spark: SparkSession, folder: str) -> DataFrame:
    """One subject per user, one event per activity row."""
    return table(spark, folder, "events").select(
        _pad("event_id", 20).alias("id"),
        F.concat(F.lit("app-"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("type"),
        _instant("ts", fraction=True).alias("time"),
        F.col("props").alias("data"),
    )


def chat_log(spark: SparkSession, folder: str) -> DataFrame:
    """One subject per conversation; turns carry no time."""
    return table(spark, folder, "conversations").select(
        F.concat(_pad("conv_id", 12), F.lit("-"), _pad("turn", 8)).alias("id"),
        F.lit("chat").alias("source"),
        F.concat(F.lit("/conversations/"), F.col("conv_id").cast("string")).alias("subject"),
        F.col("role").alias("type"),
        F.lit(None).cast("string").alias("time"),
        F.lit(None).cast("string").alias("data"),
    )


def _line_key() -> Column:
    return F.concat_ws(
        ".",
        _day("l_shipdate"),
        _pad("l_partkey", 12),
        _pad("l_suppkey", 10),
        _pad("l_linenumber", 6),
        F.lpad(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("string"), 14, "0"),
    )


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """One subject per customer; every order is placed, its items move, it is closed."""
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")
    subject = F.concat(F.lit("/customers/"), F.col("o_custkey").cast("string"), F.lit("/orders")).alias("subject")
    head = F.concat(_day("o_orderdate"), F.lit("-"), _pad("o_orderkey", 12), F.lit("-"))
    ends = orders.select(
        "o_orderkey",
        F.explode(F.array(F.lit("placed"), F.concat(F.lit("closed."), F.col("o_orderstatus")))).alias("step"),
        "o_custkey",
        "o_orderdate",
    ).select(
        F.concat(head, F.when(F.col("step") == "placed", "0").otherwise("2")).alias("id"),
        F.lit("shop").alias("source"),
        subject,
        F.concat(F.lit("order."), F.col("step")).alias("type"),
        _instant("o_orderdate").alias("time"),
    )
    items = lines.join(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.concat(head, F.lit("1."), _line_key()).alias("id"),
        F.lit("warehouse").alias("source"),
        subject,
        F.concat(F.lit("item."), F.col("l_returnflag")).alias("type"),
        _instant("l_shipdate").alias("time"),
    )
    return ends.unionByName(items)


def order_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their items as documents whose payloads refer to each other."""
    orders = table(spark, folder, "orders").select(
        F.concat(_pad("o_orderkey", 12), F.lit("-0")).alias("id"),
        F.lit("shop").alias("source"),
        F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")).alias("subject"),
        F.lit("order.placed").alias("type"),
        _instant("o_orderdate").alias("time"),
        F.concat(
            F.lit('{"customerId":"c'), F.col("o_custkey").cast("string"),
            F.lit('","total":'), F.floor(F.col("o_totalprice") + 0.5).cast("string"),
            F.when(F.col("o_orderkey") % 3 == 0, ".0").when(F.col("o_orderkey") % 3 == 1, ".25").otherwise(""),
            F.lit(',"priority":"'), F.col("o_orderpriority"),
            F.lit('","placedAt":"'),
            F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
                _instant("o_orderdate")
            ),
            F.lit('"}'),
        ).alias("data"),
    )
    items = table(spark, folder, "lineitem").select(
        F.concat(_pad("l_orderkey", 12), F.lit("-1."), _line_key()).alias("id"),
        F.lit("warehouse").alias("source"),
        F.concat(
            F.lit("/orders/"), F.col("l_orderkey").cast("string"), F.lit("/items/"),
            F.col("l_linenumber").cast("string"),
        ).alias("subject"),
        F.concat(F.lit("item."), F.col("l_returnflag"), F.lit(".updated")).alias("type"),
        _instant("l_shipdate").alias("time"),
        F.concat(
            F.lit('{"partId":"'), F.col("l_partkey").cast("string"),
            F.lit('","supplierId":"'), F.col("l_suppkey").cast("string"),
            F.lit('","quantity":'), F.col("l_quantity").cast("bigint").cast("string"), F.lit("}"),
        ).alias("data"),
    )
    return orders.unionByName(items)
