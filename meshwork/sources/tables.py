"""Graphs read from tables: each function gives an edge DataFrame for a folder of Parquet tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_order(spark, sf_dir: str, support: int = 1) -> DataFrame:
    """Parts that at least so many orders hold together: src < dst, each pair once.  An order's pairs come from its own list of parts, without a join."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    later = F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("src"), y.alias("dst"))))
    pairs = parts.select(F.explode(F.flatten(later)).alias("e")).select("e.src", "e.dst")
    return pairs.distinct() if support == 1 else pairs.groupBy("src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("src", "dst")


def part_supplier(spark, sf_dir: str) -> DataFrame:
    """Bipartite: part u, supplier v."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")).distinct()


def customer_part(spark, sf_dir: str, support: int = 1) -> DataFrame:
    """Bipartite: customer u, part v that at least so many of the customer's orders hold."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("u"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("v")).join(orders, "l_orderkey").select("u", "v", "l_orderkey").distinct()
    return rows.groupBy("u", "v").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("u", "v")


def customer_supplier_months(spark, sf_dir: str) -> DataFrame:
    """Temporal: customer u, supplier v, months t since the first order's month."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"))
    first = orders.agg(F.min("m").alias("m0"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.crossJoin(F.broadcast(first)).select(F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("v"), (F.col("m") - F.col("m0")).alias("t")).distinct()


def uncertain(spark, sf_dir: str) -> DataFrame:
    """Part-supplier edges with probability p = 1 - mean discount - mean tax, as one graph (suppliers as negative ids)."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"))
    return rows.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"), F.round(1 - F.col("d") - F.col("x"), 6).alias("p"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge (src, dst, further columns)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))
