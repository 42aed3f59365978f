"""Personalised and global PageRank: power rounds, push to a tolerance, backward push, smoothing, and estimates by walks and forests.

A state is rows (source, id, p, r): reserve and residual.  All sources go through the same joins.  A vertex without out-edges keeps its (1 - alpha) share.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..plans.store import cut
from .held import Held
from .parts import Parts, passed_on

CUT_EVERY = 5


def _transitions(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """src, dst, share of the out-weight; weight: the name of a column."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = edges.select("src", "dst", w.cast("double").alias("w"))
    return cut(e.join(e.groupBy("src").agg(F.sum("w").alias("total")), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))


def _spread(r: DataFrame, t: DataFrame, alpha: float) -> DataFrame:
    """source, id, r after one step of the residuals r."""
    moved = r.join(t, r.id == t.src, "left")
    return moved.groupBy("source", F.coalesce("dst", "id").alias("id")).agg(F.sum(F.col("r") * (1 - alpha) * F.coalesce("share", F.lit(1.0))).alias("r"))


def _moves(edges: DataFrame, start: DataFrame, weight: str | None) -> DataFrame:
    """src, dst, share, own: the transitions, a move to itself for each vertex without any, and one row (own) for each vertex by which its reserve stays."""
    t = _transitions(edges, weight)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("src")).unionByName(start.select(F.col("id").alias("src"))).distinct()
    ends = nodes.join(t.select("src").distinct(), "src", "left_anti")
    row = lambda df, share, own: df.select("src", F.col("src").alias("dst"), F.lit(share).alias("share"), F.lit(own).alias("own"))
    return cut(t.withColumn("own", F.lit(False)).unionByName(row(ends, 1.0, False)).unionByName(row(nodes, 0.0, True)))


def powers(parts: Parts, start: DataFrame, rounds: list[int], alpha: float = 0.2) -> list[DataFrame]:
    """source, id, score after each of so many rounds (ascending) of ``power`` on the undirected edges of parts."""
    lone = start.join(parts.vertices().select("id"), "id", "left_anti")  # keeps what it would pass on
    tables = passed_on(parts, start, rounds, alpha, 1 - alpha)
    return [t.filter("p > 0").select("source", "id", F.col("p").alias("score")).unionByName(lone.select("source", "id", (F.col("r") * (1 - (1 - alpha) ** n)).alias("score"))) for n, t in zip(rounds, tables, strict=True)]


def power(edges: DataFrame | Parts, start: DataFrame, rounds: int, alpha: float = 0.2, weight: str | None = None, every: int = CUT_EVERY) -> DataFrame:
    """source, id, score after so many rounds from start(source, id, r): each round gives alpha of the residual to the reserve and passes on the rest.

    The state of a round is one row (source, id, p, r) for each vertex reached; a round is one join with the moves and one aggregate.  On the parts of undirected edges only values between parts move.
    """
    if isinstance(edges, Parts):
        return powers(edges, start, [rounds], alpha)[0]
    moves = _moves(edges, start, weight)
    now = start.select("source", "id", F.lit(0.0).alias("p"), F.col("r").cast("double").alias("r"))
    for i in range(rounds):
        each = now.join(moves, now.id == moves.src)
        p = F.when(F.col("own"), F.col("p") + F.col("r") * alpha).otherwise(0.0)
        now = each.select("source", F.col("dst").alias("id"), p.alias("p"), (F.col("r") * (1 - alpha) * F.col("share")).alias("r"))
        now = now.groupBy("source", "id").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
        if i % every == every - 1:
            now = cut(now)
    return now.filter("p > 0").select("source", "id", F.col("p").alias("score"))


def single_sources(nodes: DataFrame) -> DataFrame:
    """The start of a query for each id: all residual at the source."""
    return nodes.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("r"))


def uniform_start(edges: DataFrame | Parts) -> DataFrame:
    nodes = edges.vertices().select("id") if isinstance(edges, Parts) else edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n")))).select(F.lit(0).cast("long").alias("source"), "id", (1.0 / F.col("n")).alias("r"))


def centrality(edges: DataFrame | Parts, rounds: int, alpha: float = 0.2) -> DataFrame:
    return power(edges, uniform_start(edges), rounds, alpha).select("id", "score")


def power_to(edges: DataFrame, start: DataFrame, error: float, alpha: float = 0.2, weight: str | None = None) -> DataFrame:
    """Power rounds until the residual of each source is at most error: a number of rounds known beforehand, as each keeps 1 - alpha.  Arcs of one range are held by the tasks, one for some of the sources."""
    rounds = max(1, math.ceil(math.log(error) / math.log(1 - alpha)))
    held = Held(edges, weight)
    return power(edges, start, rounds, alpha, weight) if len(held.bounds) else held_power(held, start, rounds, alpha)


def held_power(held: Held, start: DataFrame, rounds: int, alpha: float = 0.2) -> DataFrame:
    """As ``power``, over arcs that a task holds."""

    def run(g, jobs):
        ids = np.unique(np.concatenate([g.ids, g.to, *(np.asarray(x, np.int64) for x in jobs["ids"])]))
        tail, head = np.repeat(np.searchsorted(ids, g.ids), g.degree), np.searchsorted(ids, g.to)
        w = np.ones(len(g.to)) if g.w is None else g.w
        total = np.bincount(tail, w, len(ids))
        ends, share, out = total == 0, w / total[tail], []
        for source, at, given in zip(jobs["source"], jobs["ids"], jobs["rs"], strict=True):
            p, r = np.zeros(len(ids)), np.bincount(np.searchsorted(ids, at), given, len(ids))
            for _ in range(rounds):
                p += r * alpha
                r = (np.bincount(head, r[tail] * share, len(ids)) + np.where(ends, r, 0.0)) * (1 - alpha)
            some = np.flatnonzero(p > 0)
            out.append(pd.DataFrame({"source": source, "id": ids[some], "score": p[some]}))
        return pd.concat(out)

    jobs = start.groupBy("source").agg(F.collect_list("id").alias("ids"), F.collect_list(F.col("r").cast("double")).alias("rs"))
    return held.with_all(cut(jobs), run, "source long, id long, score double")


def push(edges: DataFrame, start: DataFrame, epsilon: float, alpha: float = 0.2, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(reserve, residual) when no vertex has a residual over epsilon times its out-degree; all such vertices are pushed at once, round by round."""
    t = _transitions(edges)
    deg = cut(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg")))
    p, r = None, cut(start.select("source", "id", F.col("r").cast("double").alias("r")))
    for _ in range(limit):
        marked = cut(r.join(deg, "id", "left").withColumn("hot", F.col("r") > epsilon * F.coalesce("deg", F.lit(1))))
        hot = marked.filter("hot").select("source", "id", "r")
        if hot.isEmpty():
            return p if p is not None else r.select("source", "id", F.col("r").alias("p")).filter("false"), r
        gain = hot.select("source", "id", (F.col("r") * alpha).alias("p"))
        p = cut(gain if p is None else p.unionByName(gain).groupBy("source", "id").agg(F.sum("p").alias("p")))
        r = cut(marked.filter("NOT hot").select("source", "id", "r").unionByName(_spread(hot, t, alpha)).groupBy("source", "id").agg(F.sum("r").alias("r")))
    raise RuntimeError("residuals are above the threshold after so many rounds")


def backward(edges: DataFrame | Parts, target: int, rounds: int, alpha: float = 0.2) -> DataFrame:
    """id, score: each vertex's PPR value of one target, by rounds against the edges' direction; a receiver divides by its own out-degree."""
    if isinstance(edges, Parts):
        at = edges.edges.sparkSession.createDataFrame([(0, target, 1.0)], "source long, id long, r double")
        lone = at.join(edges.vertices().select("id"), "id", "left_anti").select("id", F.lit(alpha if rounds else 0.0).alias("score"))
        found = passed_on(edges, at, [rounds], alpha, 1 - alpha, to_receiver=True)[0]
        return found.filter("p > 0").select("id", F.col("p").alias("score")).unionByName(lone)
    t = _transitions(edges)
    start = edges.sparkSession.createDataFrame([(target, 0.0, 1.0)], "id long, p double, r double")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("src")).unionByName(start.select(F.col("id").alias("src"))).distinct()
    own = nodes.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("share"), F.lit(True).alias("own"))
    moves = cut(t.withColumn("own", F.lit(False)).unionByName(own))
    now = start
    for i in range(rounds):  # a state is one row (id, p, r): a round is one join and one aggregate
        p = F.when(F.col("own"), F.col("p") + F.col("r") * alpha).otherwise(0.0)
        each = now.join(moves, now.id == moves.dst).select(F.col("src").alias("id"), p.alias("p"), (F.col("r") * (1 - alpha) * F.col("share")).alias("r"))
        now = each.groupBy("id").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
        if i % CUT_EVERY == CUT_EVERY - 1:
            now = cut(now)
    return now.filter("p > 0").select("id", F.col("p").alias("score"))


def stationary(edges: DataFrame) -> DataFrame:
    """id, score = degree / 2m: the limit for alpha to 0 of an undirected graph (each edge in both directions)."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("m")))).select("id", (F.col("d") / F.col("m")).alias("score"))


def smooth(edges: DataFrame, values: DataFrame, rounds: int, alpha: float = 0.2) -> DataFrame:
    """id, w: w <- (1 - alpha) A w + alpha w0, so many rounds, then divided by the mean; A is row-normalised."""
    t = _transitions(edges)
    w = values.select("id", F.col("w").alias("w0"), "w")
    for i in range(rounds):
        got = t.join(w.select(F.col("id").alias("dst"), "w"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("share") * F.col("w")).alias("s"))
        w = w.join(got, "id", "left").select("id", "w0", (F.coalesce("s", F.lit(0.0)) * (1 - alpha) + F.col("w0") * alpha).alias("w"))
        if i % CUT_EVERY == CUT_EVERY - 1:
            w = cut(w)
    return w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("m")))).select("id", (F.col("w") / F.col("m")).alias("w"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """source, l1, worst: the sum and the greatest of the differences of two score tables."""
    both = a.withColumnRenamed("score", "x").join(b.withColumnRenamed("score", "y"), ["source", "id"], "full")
    diff = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return both.groupBy("source").agg(F.sum(diff).alias("l1"), F.max(diff).alias("worst"))


def walks(edges: DataFrame, start: DataFrame, per_unit: int, alpha: float = 0.2, seed: int = 0, weight: str | None = None) -> DataFrame:
    """source, id, score estimated by walks from start(source, id, r): see ``walks.stopping_walks``."""
    from .walks import stopping_walks

    return stopping_walks(edges, start, per_unit, alpha, weight, seed)


def fora(edges: DataFrame, start: DataFrame, epsilon: float, per_unit: int, alpha: float = 0.2, seed: int = 0) -> DataFrame:
    """Push to epsilon, then walks from the residuals."""
    p, r = push(edges, start, epsilon, alpha)
    w = walks(edges, r, per_unit, alpha, seed).withColumnRenamed("score", "p")
    return p.unionByName(w).groupBy("source", "id").agg(F.sum("p").alias("score"))


def forests(edges: DataFrame, samples: int, alpha: float = 0.2, seed: int = 0) -> DataFrame:
    """sample, id, root: spanning forests by loop-erased walks that stop with probability alpha at each vertex.

    A sample is drawn by one task from the whole edge list, which each task of this operator holds: for graphs that fit in a task's memory.
    """
    lists = edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("out"))
    spark = edges.sparkSession
    tasks = spark.range(1, samples + 1, 1, samples).withColumnRenamed("id", "sample")

    def draw(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import random

        rng, out = random.Random(f"{seed}:{key[0]}"), dict(zip(right["src"].tolist(), right["out"].tolist(), strict=True))
        root: dict[int, int] = {}
        for start in sorted(set(out) | {x for v in out.values() for x in v}):
            nxt, u = {}, start
            while u not in root:
                if rng.random() < alpha or not len(out.get(u, ())):
                    root[u] = u
                    break
                nxt[u] = out[u][rng.randrange(len(out[u]))]
                u = nxt[u]
            r, u = root[u], start
            while u not in root:
                root[u] = r
                u = nxt[u]
        return pd.DataFrame({"sample": key[0], "id": list(root), "root": list(root.values())})

    every = spark.range(1, samples + 1, 1, samples).withColumnRenamed("id", "of").crossJoin(lists)
    return tasks.groupBy("sample").cogroup(every.groupBy("of")).applyInPandas(draw, "sample long, id long, root long")


def forest_scores(edges: DataFrame, start: DataFrame, samples: int, alpha: float = 0.2, seed: int = 0, reduced: bool = True) -> DataFrame:
    """source, id, score estimated from forests; reduced: a tree's residual is spread over it by degree (undirected graphs), else all goes to its root."""
    found = cut(forests(edges, samples, alpha, seed))
    res = found.join(start.select("source", "id", "r"), "id").groupBy("sample", "source", "root").agg(F.sum("r").alias("r"))
    if not reduced:
        return res.groupBy("source", F.col("root").alias("id")).agg((F.sum("r") / samples).alias("score"))
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    trees = found.join(deg, "id")
    total = trees.groupBy("sample", "root").agg(F.sum("d").alias("total"))
    each = trees.join(total, ["sample", "root"]).join(res, ["sample", "root"])
    return each.groupBy("source", "id").agg((F.sum(F.col("r") * F.col("d") / F.col("total")) / samples).alias("score"))


def backward_push(edges: DataFrame, target: int, epsilon: float, alpha: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(id, score and id, r) when no residual is above epsilon: each vertex's PPR value of the target lies within epsilon above its score."""
    t = _transitions(edges)
    p, r = None, cut(edges.sparkSession.createDataFrame([(target, 1.0)], "id long, r double"))
    while True:
        hot = r.filter(F.col("r") > epsilon)
        if hot.isEmpty():
            return p if p is not None else r.select("id", F.col("r").alias("score")).filter("false"), r
        gain = hot.select("id", (F.col("r") * alpha).alias("score"))
        p = cut(gain if p is None else p.unionByName(gain).groupBy("id").agg(F.sum("score").alias("score")))
        moved = hot.join(t, hot.id == t.dst).select(F.col("src").alias("id"), (F.col("r") * (1 - alpha) * F.col("share")).alias("r"))
        r = cut(r.filter(F.col("r") <= epsilon).unionByName(moved).groupBy("id").agg(F.sum("r").alias("r")))


def randomised_backward(edges: DataFrame, target: int, epsilon: float, alpha: float = 0.2, seed: int = 0) -> DataFrame:
    """id, score estimated level by level against the edges: an increment below epsilon / sqrt(d) is added as that much with the fitting probability.

    All receivers of one pusher share its coin of the level; a receiver v divides by the root of its own out-degree d.
    """
    d = cut(edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d")))
    arcs = cut(edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).join(d, "v"))
    r = edges.sparkSession.createDataFrame([(target, 1.0)], "id long, r double")
    total = r.select("id", (F.col("r") * alpha).alias("score"))
    for level in range(math.ceil(math.log(epsilon) / math.log(1 - alpha)) + 1):
        keyed = r.withColumn("_k", F.xxhash64("id", F.lit(level)))
        pushed = keyed.join(arcs, keyed.id == arcs.w)
        exact = F.col("r") * (1 - alpha) / F.col("d")
        least = F.lit(float(epsilon)) / F.sqrt("d")
        amount = F.when(exact >= least, exact).when(uniform("_k", seed) < exact / least, least).otherwise(0.0)
        r = cut(pushed.select(F.col("v").alias("id"), amount.alias("r")).groupBy("id").agg(F.sum("r").alias("r")).filter("r > 0"))
        total = cut(total.unionByName(r.select("id", (F.col("r") * alpha).alias("score"))).groupBy("id").agg(F.sum("score").alias("score")))
        if r.isEmpty():
            break
    return total


def backward_with_forests(edges: DataFrame, target: int, epsilon: float, samples: int, alpha: float = 0.2, seed: int = 0) -> DataFrame:
    """id, score: backward push, then the residuals spread over the trees of forests by degree (undirected graphs, each edge in both directions)."""
    p, r = backward_push(edges, target, epsilon, alpha)
    found = cut(forests(edges, samples, alpha, seed))
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("d"))
    trees = found.join(deg, "id").join(r, "id", "left")
    means = trees.groupBy("sample", "root").agg((F.sum(F.coalesce("r", F.lit(0.0)) * F.col("d")) / F.sum("d")).alias("m"))
    each = found.join(means, ["sample", "root"]).groupBy("id").agg((F.sum("m") / samples).alias("score"))
    return p.unionByName(each).groupBy("id").agg(F.sum("score").alias("score"))


def fora_with_forests(edges: DataFrame, start: DataFrame, epsilon: float, samples: int, alpha: float = 0.2, seed: int = 0, reduced: bool = True) -> DataFrame:
    """Push to epsilon, then forests for the residuals (reduced: spread over the trees)."""
    p, r = push(edges, start, epsilon, alpha)
    w = forest_scores(edges, r, samples, alpha, seed, reduced).withColumnRenamed("score", "p")
    return p.unionByName(w.select("source", "id", "p")).groupBy("source", "id").agg(F.sum("p").alias("score"))


def speed_ppr(edges: DataFrame, start: DataFrame, epsilon: float, per_unit: int, alpha: float = 0.2, seed: int = 0, rest: str = "walks", samples: int = 16, arcs: int | None = None) -> DataFrame:
    """source, id, score: pushes while frontiers are small, then rounds that push every vertex until the residual of each source is at most
    arcs x epsilon, then walks, forests or reduced forests for what is left.  arcs: of the whole graph, if edges are a part of it."""
    t, m = _transitions(edges), edges.count() if arcs is None else arcs
    now = cut(start.select("source", "id", F.lit(0.0).alias("p"), F.col("r").cast("double").alias("r")))
    while (now.groupBy("source").agg(F.sum("r").alias("r")).agg(F.max("r")).first()[0] or 0.0) > min(0.5, m * epsilon):
        moved = now.join(t, now.id == t.src, "left").select("source", F.coalesce("dst", "id").alias("id"), F.lit(0.0).alias("p"), (F.col("r") * (1 - alpha) * F.coalesce("share", F.lit(1.0))).alias("r"))
        stays = now.select("source", "id", (F.col("p") + F.col("r") * alpha).alias("p"), F.lit(0.0).alias("r"))
        now = cut(moved.unionByName(stays).groupBy("source", "id").agg(F.sum("p").alias("p"), F.sum("r").alias("r")))
    r = now.filter("r > 0").select("source", "id", "r")
    left = walks(edges, r, per_unit, alpha, seed) if rest == "walks" else forest_scores(edges, r, samples, alpha, seed, rest == "reduced")
    return now.select("source", "id", F.col("p").alias("score")).unionByName(left.select("source", "id", "score")).groupBy("source", "id").agg(F.sum("score").alias("score"))


def residual_of(edges: DataFrame, start: DataFrame, estimate: DataFrame, alpha: float = 0.2) -> DataFrame:
    """source, id, r (signed): what the estimate lacks, start - estimate (I - (1 - alpha) P) / alpha; walks from it correct the estimate."""
    t = _transitions(edges)
    moved = estimate.join(t, estimate.id == t.src, "left").select("source", F.coalesce("dst", "id").alias("id"), (F.col("score") * ((1 - alpha) / alpha) * F.coalesce("share", F.lit(1.0))).alias("r"))
    every = start.select("source", "id", "r").unionByName(estimate.select("source", "id", (-F.col("score") / alpha).alias("r"))).unionByName(moved)
    return every.groupBy("source", "id").agg(F.sum("r").alias("r")).filter("abs(r) > 1e-15")


def powered(edges: DataFrame, start: DataFrame, estimate: DataFrame, rounds: int, alpha: float = 0.2) -> DataFrame:
    """The estimate after so many rounds of score <- alpha start + (1 - alpha) score P, each of which takes (1 - alpha) of its error."""
    t = _transitions(edges)
    for _ in range(rounds):
        moved = estimate.join(t, estimate.id == t.src, "left").select("source", F.coalesce("dst", "id").alias("id"), (F.col("score") * (1 - alpha) * F.coalesce("share", F.lit(1.0))).alias("score"))
        estimate = cut(moved.unionByName(start.select("source", "id", (F.col("r") * alpha).alias("score"))).groupBy("source", "id").agg(F.sum("score").alias("score")))
    return estimate


def progressive(edges: DataFrame, start: DataFrame, batches: int, per_unit: int, alpha: float = 0.2, seed: int = 0, by: str = "walks", samples: int = 8, power_rounds: int = 0) -> DataFrame:
    """source, id, score: an estimate by walks, corrected batch after batch by walks (or forests) from its own signed residual, and power rounds at last."""
    estimate = cut(walks(edges, start, per_unit, alpha, seed))
    for k in range(1, batches):
        r = cut(residual_of(edges, start, estimate, alpha))
        parts = []
        for sign in (1, -1):
            side = r.filter(F.col("r") * sign > 0).select("source", "id", (F.col("r") * sign).alias("r"))
            found = walks(edges, side, per_unit, alpha, seed + 2 * k + (sign > 0)) if by == "walks" else forest_scores(edges, side, samples, alpha, seed + k)
            parts.append(found.select("source", "id", (F.col("score") * sign).alias("score")))
        estimate = cut(estimate.unionByName(parts[0]).unionByName(parts[1]).groupBy("source", "id").agg(F.sum("score").alias("score")))
    return powered(edges, start, estimate, power_rounds, alpha)


def progressive_to(edges: DataFrame, start: DataFrame, error: float, per_unit: int, alpha: float = 0.2, seed: int = 0, most: int = 200) -> DataFrame:
    """Power rounds on an estimate by walks until the residual of every source, alpha times its sum of sizes, is at most ``error``."""
    estimate = cut(walks(edges, start, per_unit, alpha, seed))
    for _ in range(most):
        worst = residual_of(edges, start, estimate, alpha).groupBy("source").agg((F.sum(F.abs("r")) * alpha).alias("e")).agg(F.max("e")).first()[0] or 0.0
        if worst <= error:
            return estimate
        estimate = powered(edges, start, estimate, 1, alpha)
    raise RuntimeError("the error is above its bound after so many rounds")


#: The estimators of one PPR problem by name: edges, start and the options of each.
METHODS = {
    "power": lambda e, s, rounds=30, **k: power(e, s, rounds, **k), "walks": walks, "fora": fora, "fora_forests": fora_with_forests, "speed": speed_ppr, "forests": forest_scores, "progressive": progressive,
}


def single_source(edges: DataFrame, nodes: DataFrame, method: str, **options) -> DataFrame:
    """source, id, score for each of nodes(id)."""
    return METHODS[method](edges, single_sources(nodes), **options)


def any_distribution(edges: DataFrame, start: DataFrame, method: str, **options) -> DataFrame:
    return METHODS[method](edges, start, **options)


def centrality_by(edges: DataFrame, method: str, **options) -> DataFrame:
    """id, score from the uniform start."""
    return METHODS[method](edges, uniform_start(edges), **options).select("id", "score")


def compare_runs(truth: DataFrame, runs: DataFrame) -> DataFrame:
    """method, source, l1_mean, l1_variance of runs(method, run, source, id, score) against truth(source, id, score)."""
    ids = runs.select("method", "run", "source").distinct()
    want = ids.join(truth.withColumnRenamed("score", "x"), "source")
    both = want.join(runs.withColumnRenamed("score", "y"), ["method", "run", "source", "id"], "full")
    each = both.groupBy("method", "run", "source").agg(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))).alias("l1"))
    return each.groupBy("method", "source").agg(F.avg("l1").alias("l1_mean"), F.coalesce(F.var_samp("l1"), F.lit(0.0)).alias("l1_variance"))


def source_distribution(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """source (0), id, r: hashed numbers over nodes(id), scaled to a sum of 1."""
    u = nodes.select("id", uniform("id", seed).alias("u"))
    return u.crossJoin(F.broadcast(u.agg(F.sum("u").alias("t")))).select(F.lit(0).cast("long").alias("source"), "id", (F.col("u") / F.col("t")).alias("r"))


def top_k(scores: DataFrame, k: int, ties: bool = False) -> DataFrame:
    """The k best rows of each source by (score, least id); ties: all that reach the k-th score."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("score")) if ties else Window.partitionBy("source").orderBy(F.desc("score"), "id")
    return scores.withColumn("place", (F.rank() if ties else F.row_number()).over(w)).filter(F.col("place") <= k)
