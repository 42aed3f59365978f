"""Resistance distance: exactly by conjugate gradients on the Laplacian grounded at a landmark, by rounds and pushes of absorbed walks, and by walks and spanning trees."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import cut
from ..sources.tables import symmetric
from .count import degrees
from .held import Held, reached
from .parts import Parts, parts_of, passed_on


def laplacian(edges: DataFrame) -> DataFrame:
    """row, col, val of D - A."""
    d = degrees(edges).select(F.col("id").alias("row"), F.col("id").alias("col"), F.col("deg").cast("double").alias("val"))
    return d.unionByName(symmetric(edges).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(-1.0).alias("val")))


def landmark(edges: DataFrame | Parts) -> DataFrame:
    """The id of greatest degree, the least on ties."""
    return (edges.vertices() if isinstance(edges, Parts) else degrees(edges)).orderBy(F.desc("deg"), "id").limit(1).select("id")


def absorbed_visits(edges: DataFrame, sources: DataFrame, stop: int, rounds: int) -> DataFrame:
    """source, id, visits expected in so many steps of a walk from the source that ends at the landmark stop."""
    start = sources.filter(F.col("id") != stop).select(F.col("id").alias("source"), "id")
    return _visits(edges, start, rounds, stop)


def _visits(edges: DataFrame, start: DataFrame, rounds: int, stop: int | None = None) -> DataFrame:
    """source, id, visits expected in so many steps of walks from start(source, id): rounds over the parts of the graph."""
    parts = parts_of(edges)
    found = passed_on(parts, start.withColumn("r", F.lit(1.0)), [rounds], 1.0, 1.0, stop=stop)[0]
    lone = start.join(parts.vertices().select("id"), "id", "left_anti")  # no step leads away from it
    return found.select("source", "id", (F.col("p") + F.col("r")).alias("visits")).unionByName(lone.select("source", "id", F.lit(1.0).alias("visits")))


def pair_resistance(edges: DataFrame, pairs: DataFrame, stop: int, rounds: int) -> DataFrame:
    """s, t, resistance = X_s(s)/d_s - X_s(t)/d_t + X_t(t)/d_t - X_t(s)/d_s, where a landmark's own visits are 0."""
    ends = pairs.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    edges = parts_of(edges)
    deg = edges.vertices()
    x = cut(absorbed_visits(edges, ends, stop, rounds).join(deg, "id").select("source", "id", (F.col("visits") / F.col("deg")).alias("x")))
    out = pairs
    for name, a, b in (("ss", "s", "s"), ("st", "s", "t"), ("tt", "t", "t"), ("ts", "t", "s")):
        out = out.join(x.select(F.col("source").alias(f"_{a}"), F.col("id").alias(f"__{b}"), F.col("x").alias(name)), (F.col(a) == F.col(f"_{a}")) & (F.col(b) == F.col(f"__{b}")), "left").drop(f"_{a}", f"__{b}")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    value = zero("ss") - zero("st") + zero("tt") - zero("ts")
    return out.select("s", "t", F.when(F.col("s") == F.col("t"), 0.0).otherwise(value).alias("resistance"))


def landmark_index(edges: DataFrame, stop: int, rounds: int) -> DataFrame:
    """id, resistance to the landmark: (L_v^-1)_uu = visits of u from u / d_u."""
    edges = parts_of(edges)
    nodes = edges.vertices()
    x = absorbed_visits(edges, nodes.select("id"), stop, rounds).filter("source = id")
    return x.join(nodes, "id").select("id", (F.col("visits") / F.col("deg")).alias("resistance"))


def potentials(edges: DataFrame, sources: DataFrame, stop: int, tolerance: float = 1e-10, most: int = 500) -> DataFrame:
    """source, id, x: the columns of the inverse of the Laplacian without the landmark's row and column, for each of sources(id) of its component.

    Conjugate gradients with the degrees as preconditioner.  Arcs of one range are held by the tasks, one for some of the sources.  Else all sources go through the same joins, and a round is
    one join and two sums.  The state is one row (source, id) of solution x, residual r and direction d.
    """
    held = Held(symmetric(edges.select("src", "dst")))
    if not len(held.bounds):
        return held_potentials(held, sources, stop, tolerance, most)
    nodes = cut(degrees(edges).filter(F.col("id") != stop))
    arcs = cut(symmetric(edges.select("src", "dst")).filter((F.col("src") != stop) & (F.col("dst") != stop)))
    begun = sources.select("id").distinct().join(nodes, "id").select(F.col("id").alias("source"), "id", F.lit(0.0).alias("x"), F.lit(1.0).alias("r"), (1.0 / F.col("deg")).alias("d"), F.col("deg"))
    now = cut(begun)
    totals = cut(now.select("source", (F.col("r") * F.col("r") / F.col("deg")).alias("rz"), F.lit(False).alias("done")))
    for _ in range(most):
        pushed = now.filter("d <> 0").join(arcs, now.id == arcs.src).select("source", F.col("dst").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("r"), F.lit(0.0).alias("d"), (-F.col("d")).alias("q"))
        own = now.select("source", "id", "x", "r", "d", (F.col("d") * F.col("deg")).alias("q"))
        state = own.unionByName(pushed).groupBy("source", "id").agg(*(F.sum(c).alias(c) for c in ("x", "r", "d", "q")))
        state = cut(state.join(nodes, "id").join(totals.select("source", "rz"), "source"))
        curve = state.groupBy("source").agg(F.sum(F.col("d") * F.col("q")).alias("dq"))
        step = F.when(F.col("dq") > 0, F.col("rz") / F.col("dq")).otherwise(0.0)
        moved = cut(state.join(F.broadcast(curve), "source").select("source", "id", "deg", "rz", "d", (F.col("x") + step * F.col("d")).alias("x"), (F.col("r") - step * F.col("q")).alias("r")))
        totals = cut(moved.groupBy("source").agg(F.sum(F.col("r") * F.col("r") / F.col("deg")).alias("rz")))
        if (totals.agg(F.max("rz")).first()[0] or 0.0) <= tolerance**2:
            return moved.filter("x <> 0").select("source", "id", "x")
        turned = moved.withColumnRenamed("rz", "old").join(F.broadcast(totals), "source")
        beta = F.when(F.col("old") > 0, F.col("rz") / F.col("old")).otherwise(0.0)
        now = turned.select("source", "id", "x", "r", (F.col("r") / F.col("deg") + beta * F.col("d")).alias("d"), "deg")
    raise RuntimeError("conjugate gradients did not reach the tolerance")


def held_potentials(held: Held, sources: DataFrame, stop: int, tolerance: float = 1e-10, most: int = 500) -> DataFrame:
    """As ``potentials``, over arcs that a task holds."""

    def run(g, jobs):
        to, tail, out = g.at(g.to), np.repeat(np.arange(len(g.ids)), g.degree), []
        free, deg = (g.ids != stop).astype(float), g.degree.astype(float)
        for source in jobs["id"].tolist():
            at = int(g.at(np.array([source]))[0])
            if at < 0 or source == stop:
                continue
            x, r = np.zeros(len(deg)), np.zeros(len(deg))
            r[at] = 1.0
            d, rz = r / deg, 1.0 / deg[at]
            for _ in range(most):
                q = (d * deg - np.bincount(tail, d[to], len(deg))) * free
                dq = d @ q
                step = rz / dq if dq > 0 else 0.0
                x, r, old = x + step * d, r - step * q, rz
                rz = r @ (r / deg)
                if rz <= tolerance**2:
                    break
                d = r / deg + (rz / old if old > 0 else 0.0) * d
            else:
                raise RuntimeError("conjugate gradients did not reach the tolerance")
            some = np.flatnonzero(x)
            out.append(pd.DataFrame({"source": source, "id": g.ids[some], "x": x[some]}))
        return pd.concat(out) if out else pd.DataFrame({"source": [], "id": [], "x": []})

    return held.with_all(cut(sources.select("id").distinct()), run, "source long, id long, x double")


def resistances(pairs: DataFrame, x: DataFrame) -> DataFrame:
    """s, t, resistance of pairs from potentials: x_s(s) - x_s(t) + x_t(t) - x_t(s), a landmark's being 0."""
    out = pairs.select("s", "t")
    for name, a, b in (("ss", "s", "s"), ("st", "s", "t"), ("tt", "t", "t"), ("ts", "t", "s")):
        out = out.join(x.select(F.col("source").alias("_a"), F.col("id").alias("_b"), F.col("x").alias(name)), (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left").drop("_a", "_b")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("s", "t", (zero("ss") - zero("st") + zero("tt") - zero("ts")).alias("resistance"))


def exact_resistance(edges: DataFrame, pairs: DataFrame, stop: int | None = None, tolerance: float = 1e-10) -> DataFrame:
    """s, t, resistance of pairs within one component, to the tolerance of the solver; the landmark is the vertex of greatest degree if none is given."""
    ends = cut(pairs.select(F.explode(F.array("s", "t")).alias("id")).distinct())
    if stop is None:
        edges = reached(symmetric(edges.select("src", "dst")), ends).filter("src < dst")
        stop = (landmark(edges).first() or [0])[0]
    return resistances(pairs, cut(potentials(edges, ends, stop, tolerance)))


def absorbed_push(edges: DataFrame, sources: DataFrame, stop: int, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """(source, id, visits and source, id, r): residual walks are passed on until no vertex has more than epsilon times its degree; none passes the landmark stop."""
    deg = cut(degrees(edges))
    t = cut(symmetric(edges.select("src", "dst")).join(deg, F.col("src") == deg.id).select("src", "dst", (1.0 / F.col("deg")).alias("share")).filter(F.col("dst") != stop))
    p, r = None, cut(sources.filter(F.col("id") != stop).select(F.col("id").alias("source"), "id", F.lit(1.0).alias("r")))
    while True:
        marked = cut(r.join(deg, "id").withColumn("hot", F.col("r") > epsilon * F.col("deg")))
        hot = marked.filter("hot").select("source", "id", F.col("r").alias("visits"))
        if hot.isEmpty():
            return p if p is not None else hot, r
        p = cut(hot if p is None else p.unionByName(hot).groupBy("source", "id").agg(F.sum("visits").alias("visits")))
        moved = hot.join(t, hot.id == t.src).select("source", F.col("dst").alias("id"), (F.col("visits") * F.col("share")).alias("r"))
        r = cut(marked.filter("NOT hot").select("source", "id", "r").unionByName(moved).groupBy("source", "id").agg(F.sum("r").alias("r")))


def potentials_of(edges: DataFrame, visits: DataFrame) -> DataFrame:
    """source, id, x = visits / degree."""
    return visits.join(degrees(edges), "id").select("source", "id", (F.col("visits") / F.col("deg")).alias("x"))


def push_resistance(edges: DataFrame, pairs: DataFrame, stop: int, epsilon: float) -> DataFrame:
    ends = pairs.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    return resistances(pairs, cut(potentials_of(edges, absorbed_push(edges, ends, stop, epsilon)[0])))


def bidirectional_resistance(edges: DataFrame, pairs: DataFrame, stop: int, epsilon: float, walks: int, seed: int = 0) -> DataFrame:
    """s, t, resistance: pushes, and walks from s and t that collect, where they stand before the landmark, the residuals of the pushes over the degrees."""
    from .kernels import absorbed_walks

    ends = pairs.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    p, r = absorbed_push(edges, ends, stop, epsilon)
    visits = cut(absorbed_walks(symmetric(edges.select("src", "dst")), ends, stop, walks, seed))
    share = r.join(degrees(edges), "id").select(F.col("source"), "id", (F.col("r") / F.col("deg")).alias("w"))
    # by symmetry x_s(t) = x_t(s): the residual of s at v adds to x_s(t) its share of the visits that walks from t pay to v
    more = share.join(visits.select(F.col("source").alias("of"), "id", "visits"), "id").groupBy("source", F.col("of").alias("id")).agg(F.sum(F.col("w") * F.col("visits")).alias("x"))
    x = potentials_of(edges, p).unionByName(more).groupBy("source", "id").agg(F.sum("x").alias("x"))
    return resistances(pairs, cut(x))


def walk_resistance(edges: DataFrame, pairs: DataFrame, stop: int, walks: int, seed: int = 0) -> DataFrame:
    """s, t, resistance from the visits of absorbed walks alone."""
    from .kernels import absorbed_walks

    ends = pairs.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    return resistances(pairs, cut(potentials_of(edges, absorbed_walks(symmetric(edges.select("src", "dst")), ends, stop, walks, seed))))


def escape_resistance(edges: DataFrame, pairs: DataFrame, walks: int, seed: int = 0) -> DataFrame:
    from .kernels import escape_walks

    return escape_walks(symmetric(edges.select("src", "dst")), pairs, walks, seed)


def truncated_resistance(edges: DataFrame, pairs: DataFrame, rounds: int) -> DataFrame:
    """s, t, resistance: the sum, over walk lengths 0 ... rounds - 1 and without a landmark, of (P_ss - P_st) / d_s + (P_tt - P_ts) / d_t, P the lengths' end probabilities."""
    ends = pairs.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    return resistances(pairs, cut(potentials_of(edges, _visits(edges, ends.select(F.col("id").alias("source"), "id"), rounds - 1))))


def landmark_by_trees(edges: DataFrame, stop: int, samples: int, seed: int = 0) -> DataFrame:
    """id, resistance to the landmark, from the visits of loop-erased walks: the diagonal of the grounded inverse."""
    from .kernels import loop_erased_visits

    v = loop_erased_visits(symmetric(edges.select("src", "dst")), stop, samples, seed)
    return v.join(degrees(edges), "id").select("id", F.when(F.col("id") == stop, 0.0).otherwise(F.col("visits") / F.col("deg")).alias("resistance"))


def by_index(edges: DataFrame, source: int, stop: int, index: DataFrame, epsilon: float) -> DataFrame:
    """id, resistance to one source: index[s] + index[id] - 2 x_s(id), from a landmark index(id, resistance) and one push from the source."""
    spark = edges.sparkSession
    p, _ = absorbed_push(edges, spark.createDataFrame([(source,)], "id long"), stop, epsilon)
    x = potentials_of(edges, p).select("id", "x")
    own = F.broadcast(index.filter(F.col("id") == source).select(F.col("resistance").alias("own")))
    out = index.crossJoin(own).join(x, "id", "left")
    return out.select("id", F.when(F.col("id") == source, 0.0).otherwise(F.col("own") + F.col("resistance") - 2 * F.coalesce("x", F.lit(0.0))).alias("resistance"))


def spanning_edge_centrality(edges: DataFrame, root: int, samples: int, seed: int = 0) -> DataFrame:
    """src, dst, share of sampled spanning trees that hold the edge; its expectation is the edge's resistance."""
    from .kernels import spanning_trees

    found = spanning_trees(symmetric(edges.select("src", "dst")), root, samples, seed)
    n = found.groupBy(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst")).agg(F.count("*").alias("n"))
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).join(n, ["src", "dst"], "left").select("src", "dst", (F.coalesce("n", F.lit(0)) / samples).alias("share"))


def tree_resistance(edges: DataFrame, stop: int, samples: int, seed: int = 0) -> DataFrame:
    """id, resistance to the landmark: along each vertex's path of the BFS tree, how often sampled trees carry its current over the path's edges, less how often against.

    For a vertex u, a tree's path from u to the landmark carries one unit of current; the potential of u is the sum over the BFS path of that current's mean.
    """
    from .core import bfs_tree
    from .kernels import spanning_trees

    spark = edges.sparkSession
    steps = cut(bfs_tree(edges, spark.createDataFrame([(stop,)], "id long")).filter("parent IS NOT NULL").select("id", "parent"))
    trees = cut(spanning_trees(symmetric(edges.select("src", "dst")), stop, samples, seed))
    # (u, a, b): the edges of u's BFS path; (sample, u, x, y): the edges of u's path in a tree
    now = steps.select(F.col("id").alias("u"), F.col("id").alias("a"), F.col("parent").alias("b"))
    path = now
    while not now.isEmpty():
        now = cut(now.select("u", F.col("b").alias("a")).join(steps.select(F.col("id").alias("a"), F.col("parent").alias("b")), "a").select("u", "a", "b"))
        path = path.unionByName(now)
    path, now, hits = cut(path), trees.select("sample", F.col("id").alias("u"), F.col("id").alias("x"), F.col("parent").alias("y")), None
    while True:
        with_ = now.join(path, (now.u == path.u) & (now.x == path.a) & (now.y == path.b), "left_semi").groupBy("u").agg(F.count("*").alias("n"))
        against = now.join(path, (now.u == path.u) & (now.x == path.b) & (now.y == path.a), "left_semi").groupBy("u").agg((-F.count("*")).alias("n"))
        both = with_.unionByName(against)
        hits = cut(both if hits is None else hits.unionByName(both).groupBy("u").agg(F.sum("n").alias("n")))
        now = cut(now.select("sample", "u", F.col("y").alias("x")).join(trees.select("sample", F.col("id").alias("x"), F.col("parent").alias("y")), ["sample", "x"]).select("sample", "u", "x", "y"))
        if now.isEmpty():
            break
    every = degrees(edges).select("id").join(hits.groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "id"), "id", "left")
    return every.select("id", (F.coalesce("n", F.lit(0)) / samples).alias("resistance"))


def log_spanning_trees(edges: DataFrame) -> float:
    """The logarithm of the number of spanning trees of a connected graph: a vertex at a time joins the grounded part, and each adds the logarithm of its potential there.

    Solved on the driver, for at most 3,000 vertices.
    """
    import numpy as np

    e = edges.select("src", "dst").limit(3000 * 2999 // 2 + 1).toPandas()
    ids = np.unique(e.to_numpy())
    if len(ids) > 3000:
        raise ValueError("more than 3,000 vertices")
    m, at = np.zeros((len(ids), len(ids))), np.searchsorted(ids, e.to_numpy())
    np.add.at(m, (at[:, 0], at[:, 1]), -1.0)
    np.add.at(m, (at[:, 1], at[:, 0]), -1.0)
    np.fill_diagonal(m, -m.sum(axis=1))
    return float(np.linalg.slogdet(m[1:, 1:])[1]) if len(ids) > 1 else 0.0


def resistance_by_tree_counts(edges: DataFrame, s: int, t: int) -> float:
    """Trees of the graph with s and t contracted over trees of the graph."""
    import math

    from .count import contract

    return math.exp(log_spanning_trees(contract(edges, s, t)) - log_spanning_trees(edges))


#: The estimators by name, over (edges, pairs, ...).
METHODS = {"exact": exact_resistance, "push": push_resistance, "bidirectional": bidirectional_resistance, "walks": walk_resistance, "escape": escape_resistance, "truncated": truncated_resistance, "rounds": pair_resistance}


def landmark_by(edges: DataFrame, how: str) -> int:
    """The landmark of greatest degree, core number or PageRank, or of least eccentricity (of all vertices: for graphs whose distances fit); the least id on ties."""
    from .core import core_numbers, distances
    from .ppr import centrality

    if how == "degree":
        return landmark(edges).first()[0]
    if how == "core":
        found = core_numbers(edges).select("id", F.col("core").alias("v"))
    elif how == "pagerank":
        found = centrality(symmetric(edges.select("src", "dst")), 30).select("id", F.round("score", 12).alias("v"))
    else:
        far = distances(edges, degrees(edges).select("id")).groupBy(F.col("source").alias("id")).agg((-F.max("dist")).alias("v"))
        found = far
    return found.orderBy(F.desc("v"), "id").limit(1).first()["id"]


def solve(edges: DataFrame, pairs: DataFrame, method: str, landmark_how: str = "degree", **options) -> DataFrame:
    """s, t, resistance by one of METHODS with a landmark of one of the kinds."""
    needs = method in ("push", "bidirectional", "walks", "rounds", "exact")
    return METHODS[method](edges, pairs, *([landmark_by(edges, landmark_how)] if needs else []), **options)
