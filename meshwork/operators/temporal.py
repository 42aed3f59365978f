"""Temporal graphs (u, v, t): activity, segment density and bursting cores."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "t")).distinct()


def activity(edges: DataFrame) -> DataFrame:
    """u, t, ds: distinct neighbours at each time."""
    return edges.groupBy("u", "t").agg(F.countDistinct("v").alias("ds"))


def average_degree(edges: DataFrame) -> DataFrame:
    """Temporal edges for each vertex: one row."""
    ends = edges.agg(F.count("*").alias("m"), F.countDistinct("u").alias("n"))
    return ends.select((F.col("m") / F.col("n")).alias("average"))


def densest_segment(ds: np.ndarray, length: int) -> float:
    """The greatest mean of a window of at least ``length`` values: lengths below twice that suffice."""
    if len(ds) < length:
        return float(ds.mean()) if len(ds) else 0.0
    total = np.concatenate([[0], np.cumsum(ds)])
    return max(float(((total[k:] - total[:-k]) / k).max()) for k in range(length, min(2 * length, len(ds) + 1)))


def segment_density(edges: DataFrame, length: int, horizon: int) -> DataFrame:
    """u, msd: the greatest mean activity over windows of at least ``length`` of the times 0 ... horizon - 1, by prefix sums and a join of window ends.

    Only windows that end at an active time can be densest for their start; both ends are found among the prefix sums of one vertex.
    """
    if not edges.filter((F.col("t") >= horizon) | (F.col("t") < 0)).isEmpty():
        raise ValueError("a time lies outside 0 ... horizon - 1")
    times = F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("k")
    from pyspark.sql import Window

    grid = edges.select("u").distinct().select("u", times)
    seen = activity(edges).select("u", (F.col("t") + 1).alias("k"), "ds")
    prefix = grid.join(seen, ["u", "k"], "left").withColumn("s", F.sum(F.coalesce("ds", F.lit(0))).over(Window.partitionBy("u").orderBy("k"))).select("u", "k", "s")
    lists = prefix.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("p"))
    best = F.array_max(
        F.flatten(
            F.transform(
                F.sequence(F.lit(length), F.lit(max(length, min(2 * length - 1, horizon)))),
                lambda k: F.transform(F.sequence(k, F.lit(horizon)), lambda j: (F.get("p", j)["s"] - F.get("p", j - k)["s"]) / k.cast("double")),
            )
        )
    )
    return lists.select("u", best.alias("msd"))


def bursting_core(edges: DataFrame, length: int, delta: float, horizon: int) -> DataFrame:
    """u of the greatest set in which each vertex has at least delta neighbours and a segment density of at least delta, within the set (edges in both directions)."""
    now = cut(edges)
    n = now.count()
    while n:
        deg = now.groupBy("u").agg(F.countDistinct("v").alias("d")).filter(F.col("d") >= delta)
        keep = deg.join(segment_density(now, length, horizon).filter(F.col("msd") >= delta - 1e-12), "u").select("u")
        now = cut(now.join(keep, "u", "left_semi").join(keep.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v", "t"))
        m = now.count()
        if m == n:
            break
        n = m
    return now.select("u").distinct()


def greatest_delta(edges: DataFrame, length: int, horizon: int) -> tuple[int, DataFrame]:
    """The greatest whole delta with a bursting core, and the core; each search starts from the core before, as cores are nested."""
    delta, core, now = 0, edges.select("u").distinct(), edges
    while True:
        found = cut(bursting_core(now, length, delta + 1, horizon))
        if found.isEmpty():
            return delta, core
        delta, core = delta + 1, found
        now = cut(edges.join(core, "u", "left_semi").join(core.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v", "t"))


def greatest_length(edges: DataFrame, delta: float, horizon: int) -> tuple[int, DataFrame]:
    """The greatest window length with a bursting core of delta, and the core (0 and no vertex if there is none).

    A core of some length is one of every length whose windows it can be cut into, but not of every shorter one, so all lengths are tried, longest first.
    """
    for length in range(horizon, 0, -1):
        core = cut(bursting_core(edges, length, delta, horizon))
        if not core.isEmpty():
            return length, core
    return 0, edges.select("u").filter("false")


def slopes(edges: DataFrame, horizon: int) -> DataFrame:
    """u, a, b, slope: for each time b the start a of the steepest rise of a vertex's summed activity that ends there (the longest of equal ones)."""
    from pyspark.sql import Window

    grid = edges.select("u").distinct().select("u", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("k"))
    seen = activity(edges).select("u", (F.col("t") + 1).alias("k"), "ds")
    sums = grid.join(seen, ["u", "k"], "left").withColumn("s", F.sum(F.coalesce("ds", F.lit(0))).over(Window.partitionBy("u").orderBy("k"))).select("u", "k", "s")
    lists = sums.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("p"))
    point = lists.select("u", "p", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("b"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda a: F.struct(((F.get("p", F.col("b"))["s"] - F.get("p", a)["s"]) / (F.col("b") - a).cast("double")).alias("slope"), (-a).alias("neg"))))
    return point.withColumn("x", best).select("u", (-F.col("x.neg")).alias("a"), "b", F.col("x.slope").alias("slope"))


def pareto_cores(edges: DataFrame, lengths: list[int], horizon: int) -> DataFrame:
    """length, delta, size of the cores that no other with length and delta at least as great dominates."""
    rows = []
    for length in lengths:
        delta, core = greatest_delta(edges, length, horizon)
        if delta:
            rows.append((length, delta, core.count()))
    kept = [r for r in rows if not any(o != r and o[0] >= r[0] and o[1] >= r[1] for o in rows)]
    return edges.sparkSession.createDataFrame(kept, "length int, delta int, size long")


def burst_support(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges, nodes, support: temporal edges within a set of nodes(u), for each of its nodes."""
    inner = edges.join(nodes, "u", "left_semi").join(nodes.select(F.col("u").alias("v")), "v", "left_semi")
    return inner.agg(F.count("*").alias("edges"), F.countDistinct("u").alias("nodes")).withColumn("support", F.col("edges") / F.col("nodes"))




def best_by_end(ds: np.ndarray, length: int, first: int = 0, last: int | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """At place b the greatest mean of a window of length ... 2 length - 1 values that ends before time b; only the places first ... last are written, if out is given."""
    n = len(ds)
    out = np.zeros(n + 1) if out is None else out
    last = n if last is None else min(last, n)
    first = max(first, length)
    if first > last:
        return out
    base = max(0, first - 2 * length)
    total = np.concatenate([[0], np.cumsum(ds[base:last])])
    ends = np.arange(first, last + 1)
    best = np.zeros(len(ends))
    for k in range(length, min(2 * length, n + 1)):
        fits = ends >= k
        best[fits] = np.maximum(best[fits], (total[ends[fits] - base] - total[ends[fits] - k - base]) / k)
    out[first : last + 1] = best
    return out


_STATE = "u long, d long, ds array<int>, best array<double>, msd double"


def bursting_core_by_rounds(edges: DataFrame, length: int, delta: float, horizon: int, compact: int = 10) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(u of the bursting core, as ``bursting_core``; (vertices touched, vertices gone) of each round).

    A vertex's state is a row: its neighbours, its activity at each time and the best window for each end.  A round touches the neighbours of the vertices that went in the last one alone:
    their activity falls at the times they shared, and only windows that end within 2 length of these are computed again.  The other rows are neither read into the round nor
    written; the edges are never written again.
    """
    import pandas as pd

    if length > horizon:
        raise ValueError("the length is beyond the horizon")
    edges = cut(edges.select("u", "v", "t").distinct())
    if not edges.filter((F.col("t") >= horizon) | (F.col("t") < 0)).isEmpty():
        raise ValueError("a time lies outside 0 ... horizon - 1")
    low = delta - 1e-12

    def begin(batches):
        for pdf in batches:
            rows = []
            for u, d, times in pdf[["u", "d", "times"]].itertuples(index=False):
                ds = np.zeros(horizon, np.int64)
                for x in times:
                    ds[x["t"]] = x["n"]
                best = best_by_end(ds, length)
                rows.append((u, d, ds.tolist(), best.tolist(), float(best.max())))
            yield pd.DataFrame(rows, columns=["u", "d", "ds", "best", "msd"])

    def repair(batches):
        for pdf in batches:
            rows = []
            for u, d, ds, best, lost, times in pdf[["u", "d", "ds", "best", "lost", "times"]].itertuples(index=False):
                ds, best = np.array(ds, np.int64), np.array(best)
                at = sorted((x["t"], x["n"]) for x in times)
                for t, n in at:
                    ds[t] -= n
                k = 0
                while k < len(at):  # stretches of times whose windows overlap are repaired at once
                    first = last = at[k][0]
                    while k < len(at) and at[k][0] <= last + 2 * length:
                        last, k = at[k][0], k + 1
                    best_by_end(ds, length, first + 1, last + 2 * length, best)
                rows.append((u, d - lost, ds.tolist(), best.tolist(), float(best.max())))
            yield pd.DataFrame(rows, columns=["u", "d", "ds", "best", "msd"])

    degree = edges.groupBy("u").agg(F.countDistinct("v").alias("d"))
    times = activity(edges).groupBy("u").agg(F.collect_list(F.struct("t", F.col("ds").alias("n"))).alias("times"))
    state = cut(degree.join(times, "u").mapInPandas(begin, _STATE).withColumn("round", F.lit(0)))
    out = (F.col("d") < delta) | (F.col("msd") < low)
    front = cut(state.filter(out).select("u"))
    gone, went, rounds = front, front.count(), []
    rounds.append((state.count(), went))
    while went:
        hits = edges.join(front.withColumnRenamed("u", "v"), "v", "left_semi").join(gone, "u", "left_anti")
        lost = hits.groupBy("u").agg(F.countDistinct("v").alias("lost"))
        when = hits.groupBy("u", "t").agg(F.count("*").alias("n")).groupBy("u").agg(F.collect_list(F.struct("t", "n")).alias("times"))
        touched = cut(lost.join(when, "u"))
        newest = state.join(touched.select("u"), "u", "left_semi").groupBy("u").agg(F.max_by(F.struct("d", "ds", "best"), "round").alias("s")).select("u", "s.*")
        fresh = cut(newest.join(touched, "u").mapInPandas(repair, _STATE).withColumn("round", F.lit(len(rounds))))
        front = cut(fresh.filter(out).select("u"))
        went = front.count()
        rounds.append((fresh.count(), went))
        state, gone = state.unionByName(fresh), gone.unionByName(front)
        if len(rounds) % compact == 0:
            gone = cut(gone)
            state = cut(state.groupBy("u").agg(F.max_by(F.struct("d", "ds", "best", "msd", "round"), "round").alias("s")).select("u", "s.*").join(gone, "u", "left_anti"))
    return degree.select("u").join(gone, "u", "left_anti"), rounds
