"""Graph files: edge lists with their headers and comments, attributes, temporal edges, binary adjacency, id lists."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.store import cut


def _lines(spark: SparkSession, path: str, comments: str = "%#") -> DataFrame:
    text = F.trim(F.col("value"))
    lines = spark.read.text(path).select(text.alias("line")).filter("line <> ''")
    return lines.filter(~F.substring("line", 1, 1).isin(list(comments)))


def _fields(lines: DataFrame, names: list[str], types: list[str]) -> DataFrame:
    parts = F.split("line", r"[\s,]+")
    return lines.select(*(F.get(parts, i).cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types, strict=True))))


def _body(spark, path: str, fields: int) -> DataFrame:
    """The lines of a file that have at least so many fields and aren't its header (its first line that is no comment)."""
    numbered = _lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    head = numbered.agg(F.min_by("line", "at").alias("h"), F.min("at").alias("first"))
    return numbered.crossJoin(F.broadcast(head)).filter((F.col("at") > F.col("first")) & (F.size(F.split("line", r"[\s,]+")) >= fields)).select("line")


def edge_list(spark, path: str, header: bool = True, ascending_only: bool = False, drop_loops: bool = False) -> DataFrame:
    """src, dst.  header: the first line (n, or n m) is no edge; ascending_only: only lines with src < dst count."""
    out = _fields(_body(spark, path, 2) if header else _lines(spark, path), ["src", "dst"], ["long", "long"])
    out = out.filter("src < dst") if ascending_only else out
    return out.filter("src <> dst") if drop_loops else out


def weighted_edge_list(spark, path: str, header: bool = True) -> DataFrame:
    return _fields(_body(spark, path, 3) if header else _lines(spark, path), ["src", "dst", "w"], ["long", "long", "double"])


def uncertain_edge_list(spark, path: str) -> DataFrame:
    return _fields(_body(spark, path, 3), ["src", "dst", "p"], ["long", "long", "double"]).filter("src < dst")


def bipartite_edge_list(spark, path: str, header: bool = True) -> DataFrame:
    """u, v; the header n1 n2 m may be missing (then the sides' sizes are the greatest ids plus 1)."""
    return _fields(_body(spark, path, 2) if header else _lines(spark, path), ["u", "v"], ["long", "long"])


def temporal_edge_list(spark, path: str) -> DataFrame:
    """u, v, t from lines of from, to, time: no loops, no repeated triples, both directions, times from 0."""
    rows = _fields(_lines(spark, path), ["u", "v", "t"], ["long", "long", "int"]).filter("u <> v")
    both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"), "t")).distinct()
    return both.crossJoin(F.broadcast(rows.agg(F.min("t").alias("t0")))).select("u", "v", (F.col("t") - F.col("t0")).alias("t"))


def attributed_graph(spark, edges: str, attributes: str) -> tuple[DataFrame, DataFrame]:
    """(edges without loops, id and attr)."""
    return edge_list(spark, edges, header=False, drop_loops=True), _fields(_lines(spark, attributes), ["id", "attr"], ["long", "int"])


def dense_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges over ids 0, 1, ... in the order of the old ids, and the map (id, old).

    Ids are dealt by range: each range counts its own, and only the counts of ranges (a row each) are summed in one place.
    """
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("old")).distinct().repartitionByRange("old").withColumn("part", F.spark_partition_id()))
    sizes = nodes.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("old")) - 1
    ids = nodes.withColumn("own", own).join(F.broadcast(before), "part").select((F.col("own") + F.col("before")).alias("id"), "old")
    out = edges.join(ids.withColumnsRenamed({"id": "s", "old": "src"}), "src").join(ids.withColumnsRenamed({"id": "d", "old": "dst"}), "dst")
    return out.select(F.col("s").alias("src"), F.col("d").alias("dst")), ids


def id_list(spark, path: str) -> DataFrame:
    """One id a line."""
    return _fields(_lines(spark, path), ["id"], ["long"])


def pair_list(spark, path: str) -> DataFrame:
    return _fields(_lines(spark, path), ["s", "t"], ["long", "long"])


def binary_adjacency(spark, folder: str) -> DataFrame:
    """id, nbrs from pairs of files NAME.edge (unsigned 32-bit neighbour ids) and NAME.idx (unsigned 32-bit starts, one more than nodes)."""
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.{edge,idx}").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.(edge|idx)$", 1)
    pairs = blobs.groupBy(name.alias("name")).agg(F.max(F.when(F.col("path").endswith(".edge"), F.col("content"))).alias("edge"), F.max(F.when(F.col("path").endswith(".idx"), F.col("content"))).alias("idx"))

    def rows(batches):
        for batch in batches:
            for edge, idx in zip(batch.column("edge").to_pylist(), batch.column("idx").to_pylist(), strict=True):
                at, to = np.frombuffer(idx, "<u4"), np.frombuffer(edge, "<u4").astype(np.int64)
                for a in range(0, len(at) - 1, 8192):
                    part = at[a : a + 8193].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), pa.array(to[part[0] : part[-1]]))
                    yield pa.record_batch([pa.array(np.arange(a, a + len(part) - 1)), lists], names=["id", "nbrs"])

    return pairs.select("edge", "idx").mapInArrow(rows, "id long, nbrs array<long>")


def expression_matrix(spark, path: str) -> DataFrame:
    """cell, gene, x from a CSV of cells by genes (first column: the cell)."""
    wide = spark.read.csv(path, header=True)
    first, genes = wide.columns[0], wide.columns[1:]
    pairs = F.explode(F.array(*(F.struct(F.lit(g).alias("gene"), F.col(f"`{g}`").cast("double").alias("x")) for g in genes))).alias("e")
    return wide.select(F.col(f"`{first}`").alias("cell"), pairs).select("cell", "e.gene", "e.x")
