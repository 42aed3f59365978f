"""Degrees, wedges, butterflies, bicliques, triangles and cliques."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import cut, kept
from ..sources.tables import symmetric
from .cells import shared, triangles


def degrees(edges: DataFrame) -> DataFrame:
    """id, deg of an undirected graph with each edge once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))


def wedges(bip: DataFrame, side: str = "v", least: int = 1) -> DataFrame:
    """a < b on one side and the number of neighbours that they share, if at least so many."""
    return shared(bip, side, least)


def cheaper_side(bip: DataFrame) -> str:
    """The side whose pairs are fewer to enumerate: the sum over the other side's vertices of deg choose 2."""
    cost = {s: bip.groupBy("u" if s == "v" else "v").count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0))).first()[0] for s in ("u", "v")}
    return min(cost, key=cost.get)


def wedge_costs(bip: DataFrame) -> DataFrame:
    """A row for each side with the number of wedges whose ends lie there."""
    one = lambda s, other: bip.groupBy(other).agg(F.count("*").alias("d")).agg(F.sum(F.expr("d * (d - 1) div 2")).cast("long").alias("wedges")).select(F.lit(s).alias("side"), "wedges")
    return one("u", "v").unionByName(one("v", "u"))


def choose(name: str, k: int):
    """The column name choose k, exactly, in whole numbers."""
    return F.expr(f"if({name} < {k}, 0L, " + (name if k else "1L") + "".join(f" * ({name} - {i}) div {i + 1}" for i in range(1, k)) + ")")


def butterflies(bip: DataFrame) -> DataFrame:
    """The number of butterflies, from the cheaper side."""
    bip = cut(bip)
    return wedges(bip, cheaper_side(bip), 2).agg(F.coalesce(F.sum(F.expr("shared * (shared - 1) div 2")), F.lit(0)).cast("long").alias("butterflies"))


def butterflies_by_vertex(bip: DataFrame, side: str = "v") -> DataFrame:
    """id, butterflies of each vertex of one side."""
    w = wedges(bip, side, 2)
    return w.select(F.explode(F.array("a", "b")).alias("id"), F.expr("shared * (shared - 1) div 2").alias("n")).groupBy("id").agg(F.sum("n").cast("long").alias("butterflies"))


def butterflies_by_edge(bip: DataFrame) -> DataFrame:
    """u, v, butterflies of each edge: the sum over the other neighbours w of u of the neighbours that v and w share, less u itself."""
    return shared(bip, "v", 2, "edges").select(F.col("o").alias("u"), F.col("a").alias("v"), F.col("n").alias("butterflies"))


def _sets(bip: DataFrame, p: int, side: str, least: int) -> DataFrame:
    """x0 < x1 < ... of each p-set of one side with at least ``least`` common neighbours, and their number c; sets grow by one vertex at a time and go when too few remain.  Pairs come from cells."""
    if p == 2:
        return wedges(bip, side, least).toDF("x0", "x1", "c")
    other = "u" if side == "v" else "v"
    pairs = bip.select(F.col(other).alias("o"), F.col(side).alias("x"))
    enough = pairs.groupBy("x").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
    found = pairs.join(enough.select("x"), "x", "left_semi").withColumnRenamed("x", "x0")
    for i in range(1, p):
        names = [f"x{j}" for j in range(i + 1)]
        longer = found.join(pairs.withColumnRenamed("x", f"x{i}"), "o").filter(F.col(f"x{i - 1}") < F.col(f"x{i}"))
        found = longer
        if i < p - 1:
            found = cut(longer)
            alive = found.groupBy(*names).agg(F.count("*").alias("c")).filter(F.col("c") >= least)
            found = found.join(alive.select(*names), names, "left_semi")
    return found.groupBy(*(f"x{i}" for i in range(p))).agg(F.count("*").alias("c")).filter(F.col("c") >= least)


def set_cost(bip: DataFrame, size: int, side: str) -> float:
    """How many sets of so many vertices of one side have a common neighbour, with repeats."""
    d = bip.groupBy("u" if side == "v" else "v").agg(F.count("*").alias("d"))
    return float(d.agg(F.coalesce(F.sum(choose("d", size).cast("double")), F.lit(0.0))).first()[0])


def bicliques(bip: DataFrame, p: int, q: int) -> DataFrame:
    """The number of (p, q)-bicliques: p vertices of side v, q of side u.

    The side whose sets are fewer is listed, p-sets of v or q-sets of u, with their number of common neighbours; the binomials are summed.
    """
    bip = cut(bip)
    side, size, rest = ("v", p, q) if set_cost(bip, p, "v") <= set_cost(bip, q, "u") else ("u", q, p)
    return _sets(bip, size, side, rest).agg(F.coalesce(F.sum(choose("c", rest)).cast("long"), F.lit(0).cast("long")).alias("bicliques"))


def bicliques_by_vertex(bip: DataFrame, p: int, q: int, side: str = "v") -> DataFrame:
    """id, bicliques: the (p, q)-bicliques (p of side v, q of side u) that hold each vertex of one side; vertices without any are left out."""
    size, rest = (p, q) if side == "v" else (q, p)
    found = _sets(bip, size, side, rest)
    return found.select(F.explode(F.array(*(f"x{i}" for i in range(size)))).alias("id"), choose("c", rest).alias("n")).groupBy("id").agg(F.sum("n").cast("long").alias("bicliques"))


def oriented(edges: DataFrame, *rest: str) -> DataFrame:
    """Each edge once (with the columns rest), from the end of lower (degree, id) to the other: out-degrees stay below sqrt(2 m)."""
    deg = degrees(edges)
    both = edges.join(deg.withColumnsRenamed({"id": "src", "deg": "ds"}), "src").join(deg.withColumnsRenamed({"id": "dst", "deg": "dd"}), "dst")
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    return both.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("dst"), *rest)


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """x0 ... of each k-clique, once, along the orientation by degree: triangles by cells, and larger ones by the triangles on their first and last vertex."""
    out = kept(oriented(edges))
    found = out.select(F.col("src").alias("x0"), F.col("dst").alias("x1"))
    if k > 2:
        found = triangles(out).toDF("x0", "x1", "x2")
        closed = found = kept(found) if k > 3 else found
    for i in range(3, k):
        found = found.join(closed.toDF("x0", f"x{i - 1}", f"x{i}"), ["x0", f"x{i - 1}"])
        for j in range(1, i - 1):
            found = found.join(out.select(F.col("src").alias(f"x{j}"), F.col("dst").alias(f"x{i}")), [f"x{j}", f"x{i}"], "left_semi")
    return found.select(*(f"x{i}" for i in range(k)))


def clique_count(edges: DataFrame, k: int) -> DataFrame:
    return cliques(edges, k).agg(F.count("*").alias("cliques"))


def cliques_by_vertex(edges: DataFrame, k: int) -> DataFrame:
    return cliques(edges, k).select(F.explode(F.array(*(f"x{i}" for i in range(k)))).alias("id")).groupBy("id").agg(F.count("*").alias("cliques"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, the clustering coefficient of each vertex of degree 2 or more."""
    deg = degrees(edges).filter("deg > 1")
    return deg.join(cliques_by_vertex(edges, 3), "id", "left").select("id", F.round(2.0 * F.coalesce("cliques", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1)), 6).alias("coefficient"))


def contract(edges: DataFrame, keep: int, gone: int) -> DataFrame:
    """gone becomes keep; edges between them go, parallel ones stay."""
    new = lambda c: F.when(F.col(c) == gone, F.lit(keep)).otherwise(F.col(c)).alias(c)
    return edges.select(new("src"), new("dst")).filter("src <> dst")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in nodes(id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def two_hop(edges: DataFrame) -> DataFrame:
    """id, other: pairs at a distance of exactly two, both directions."""
    both = symmetric(edges)
    far = both.select(F.col("src").alias("id"), F.col("dst").alias("m")).join(both.select(F.col("src").alias("m"), F.col("dst").alias("other")), "m").filter("id <> other").select("id", "other").distinct()
    return far.join(both.select(F.col("src").alias("id"), F.col("dst").alias("other")), ["id", "other"], "left_anti")
