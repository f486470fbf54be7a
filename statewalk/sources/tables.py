"""The given tables, and the edge, event and sequence tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.functions.algebra import TOKENS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_of(number: Column) -> Column:
    """Token number `number` mod 18 of the tokens in byte order."""
    names = F.expr(f"array({', '.join(repr(t) for t in TOKENS)})")
    return F.get(names, F.pmod(number, F.lit(len(TOKENS))).cast("int"))


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token per event; (user_id, ts, event_id) orders them."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        "ts",
        "event_id",
        "event_type",
        token_of(F.col("event_id") + F.floor("value")).alias("token"),
    )


LINE_ORDER = [
    "l_shipdate",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_orderkey",
    "l_quantity",
    "l_extendedprice",
]


def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token per line item; LINE_ORDER is total up to lines with equal tokens."""
    return table(spark, sf_dir, "lineitem").select(
        *LINE_ORDER,
        token_of(F.col("l_partkey") + F.col("l_linenumber") + F.col("l_orderkey")).alias("token"),
    )


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind), F.col(key).cast("string"))


def order_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src order, dst part, for every line item."""
    return table(spark, sf_dir, "lineitem").select(
        _node("o", "l_orderkey").alias("src"), _node("p", "l_partkey").alias("dst")
    )


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer - order and part - supplier edges besides the order - part ones."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return (
        order_part_edges(spark, sf_dir)
        .unionByName(
            orders.select(_node("c", "o_custkey").alias("src"), _node("o", "o_orderkey").alias("dst"))
        )
        .unionByName(
            lines.select(_node("p", "l_partkey").alias("src"), _node("s", "l_suppkey").alias("dst"))
        )
    )


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed: supplier to order, order to part, part to supplier."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = [("s", "l_suppkey", "o", "l_orderkey"), ("o", "l_orderkey", "p", "l_partkey"), ("p", "l_partkey", "s", "l_suppkey")]
    return lines.select(
        F.explode(
            F.array(
                *[
                    F.struct(_node(a, x).alias("src"), _node(b, y).alias("dst"))
                    for a, x, b, y in pairs
                ]
            )
        ).alias("e")
    ).select("e.*")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(_node("p", "p_partkey").alias("node"))


def supplier_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_node("s", "s_suppkey").alias("node"))


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(_node("c", "c_custkey").alias("node"))


def first_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part with the smallest key that any line item names."""
    key = table(spark, sf_dir, "lineitem").agg(F.min("l_partkey").alias("l_partkey"))
    return key.select(_node("p", "l_partkey").alias("node"))
