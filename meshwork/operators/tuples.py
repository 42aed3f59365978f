"""Many graphs in one table: nodes(graph, id, ...), edges(graph, src, dst, ...), globals(graph, ...), with broadcasts between them and reductions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDUCERS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def globals_to(rows: DataFrame, globals_: DataFrame, value: str = "g") -> DataFrame:
    """rows (edges or nodes) with their graph's value."""
    return rows.join(globals_.select("graph", F.col(value).alias("g")), "graph")


def ends_to_edges(edges: DataFrame, nodes: DataFrame, value: str, kind: str | None = None) -> DataFrame:
    """edges with the values of their sender (s) and receiver (r); kind: only edges of that kind, whose ends may be of any."""
    kept = edges.filter(F.col("kind") == kind) if kind is not None else edges
    own = nodes.select("graph", "id", F.col(value).alias("v"))
    return kept.join(own.withColumnsRenamed({"id": "src", "v": "s"}), ["graph", "src"]).join(own.withColumnsRenamed({"id": "dst", "v": "r"}), ["graph", "dst"])


def edges_to_nodes(edges: DataFrame, nodes: DataFrame, value: str, how: str = "sum", end: str = "dst") -> DataFrame:
    """graph, id, v: a reduction over the received (end dst) or sent (src) edges; 0 where there is none."""
    got = edges.groupBy("graph", F.col(end).alias("id")).agg(REDUCERS[how](value).cast("double").alias("v"))
    return nodes.select("graph", "id").join(got, ["graph", "id"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def to_globals(rows: DataFrame, globals_: DataFrame, value: str, how: str = "sum") -> DataFrame:
    """graph, v: a reduction over a graph's edges or nodes; 0 where it has none."""
    got = rows.groupBy("graph").agg(REDUCERS[how](value).cast("double").alias("v"))
    return globals_.select("graph").join(got, "graph", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def block(nodes: DataFrame, edges: DataFrame, globals_: DataFrame, update_edge, update_node, update_global) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One graph-network step over columns x: edges from (x, s, r, g), nodes from (x, summed edges v, g), globals from (x, summed edges e, summed nodes n).

    The updates are functions of columns that give a column.
    """
    g = globals_.withColumnRenamed("x", "g")
    e = ends_to_edges(globals_to(edges, g), nodes, "x").withColumn("x", update_edge(F.col("x"), F.col("s"), F.col("r"), F.col("g"))).select(*edges.columns)
    got = edges_to_nodes(e, nodes, "x")
    n = globals_to(nodes.join(got, ["graph", "id"]), g).withColumn("x", update_node(F.col("x"), F.col("v"), F.col("g"))).select(*nodes.columns)
    both = globals_.join(to_globals(e, globals_, "x").withColumnRenamed("v", "e"), "graph").join(to_globals(n, globals_, "x").withColumnRenamed("v", "n"), "graph")
    return n, e, both.withColumn("x", update_global(F.col("x"), F.col("e"), F.col("n"))).select(*globals_.columns)


def stacked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, id, at; graph, src, dst) with ids counted through all graphs: the offsets of a batch."""
    from .order import numbered

    at = numbered(nodes.select("graph", "id"), ["graph", "id"], "at")
    moved = edges.join(at.withColumnsRenamed({"id": "src", "at": "a"}), ["graph", "src"]).join(at.withColumnsRenamed({"id": "dst", "at": "b"}), ["graph", "dst"])
    return at, moved.select("graph", F.col("a").alias("src"), F.col("b").alias("dst"))


def concatenated(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], first_graphs: int) -> tuple[DataFrame, DataFrame]:
    """Two batches as one: the graphs of the second are counted on."""
    later = lambda df: df.withColumn("graph", F.col("graph") + first_graphs)
    return first[0].unionByName(later(second[0])), first[1].unionByName(later(second[1]))
