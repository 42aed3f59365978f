"""Reductions to cores, components and distances: loops whose rounds are joins and aggregates."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import cut, until_stable
from ..sources.tables import symmetric
from .count import degrees, induced
from .parts import Parts, parts_of


def k_core(edges: DataFrame | Parts, k: int) -> DataFrame:
    """The edges left when vertices of degree below k go, again and again: in each part until none goes, then the parts tell each other."""
    parts, shared = parts_of(edges), {"alive": "tinyint"}

    def kernel(g, own, full):
        alive = full["alive"]
        before = int(alive[g.own].sum())
        while True:
            stays = alive[g.own] & (g.sums(alive[g.near]) >= k)
            if (stays == alive[g.own]).all():
                return {"alive": stays}, before - int(stays.sum())
            alive[g.own] = stays

    state = parts.until_stable(parts.begin(lambda g: {"alive": np.ones(len(g.ids), np.int8)}, shared), kernel, shared)
    if edges is parts or edges.columns == ["src", "dst"]:
        return parts.left(state, shared)
    ids = parts.out(state, lambda g, own, full, key: pd.DataFrame({"id": g.ids[own["alive"] > 0]}), shared, "id bigint")
    return induced(edges, cut(ids))


def core_numbers(edges: DataFrame | Parts, rounds: int | None = None) -> DataFrame:
    """id, core: the h-index of the neighbours' values, again and again from the degrees on, settles at the core numbers; in each part until it settles, then the parts tell each other.

    A vertex's value falls only where fewer neighbours than it says have at least that value; the others are not looked at further.
    rounds: the values after so many rounds in which all vertices fall at once, which are core numbers only where that is enough for them to settle, and above them elsewhere.
    """
    parts, shared = parts_of(edges), {"core": "int"}

    def fallen(g, core):
        mine = core[g.own].copy()
        low = np.flatnonzero(g.sums(core[g.near] >= np.repeat(mine, g.deg)) < mine)
        if len(low):
            arcs, begins = g.arcs_of(low)
            tail = np.repeat(np.arange(len(low)), g.deg[low])
            value = core[g.near[arcs]].astype(np.int64)
            value = value[np.argsort((tail << 32) - value)]
            mine[low] = np.maximum.reduceat(np.minimum(value, np.arange(len(value)) - begins[tail] + 1), begins[:-1])
        return mine, len(low)

    def once(g, own, full):
        mine, fell = fallen(g, full["core"])
        return {"core": mine}, fell

    def settle(g, own, full):
        core, changed = full["core"], 0
        while True:
            mine, fell = fallen(g, core)
            if not fell:
                return {"core": mine}, changed
            core[g.own] = mine
            changed += fell

    state = parts.begin(lambda g: {"core": g.deg.astype(np.int32)}, shared)
    if rounds is None:
        state = parts.until_stable(state, settle, shared)
    else:
        state = parts.rounds(state, once, shared, rounds)
    return parts.out(state, lambda g, own, full, key: pd.DataFrame({"id": g.ids, "core": own["core"]}), shared, "id bigint, core bigint")


def pq_core(bip: DataFrame, p: int, q: int) -> DataFrame:
    """Bipartite edges left when vertices u of degree below q and v of degree below p go, again and again."""

    def step(e):
        e = e.join(e.groupBy("u").count().filter(F.col("count") >= q).select("u"), "u", "left_semi")
        return e.join(e.groupBy("v").count().filter(F.col("count") >= p).select("v"), "v", "left_semi").select("u", "v")

    return until_stable(bip, step)


def eta_core(edges: DataFrame, k: int, eta: float) -> DataFrame:
    """Uncertain edges (src, dst, p) left when edges with p < eta and vertices whose eta-degree is below k - 1 go, again and again.

    The eta-degree is the greatest t for which the product of the t highest probabilities is at least eta.
    """
    return until_stable(edges.filter(F.col("p") >= eta), lambda e: induced(e, eta_degrees(e, eta).filter(F.col("eta_deg") >= k - 1)))


def eta_degrees(edges: DataFrame, eta: float) -> DataFrame:
    both = symmetric(edges)
    w = Window.partitionBy("src").orderBy(F.desc("p"), "dst").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumn("product", F.exp(F.sum(F.ln("p")).over(w)))
    return run.groupBy(F.col("src").alias("id")).agg(F.sum((F.col("product") >= eta - 1e-9).cast("long")).alias("eta_deg"))


def components(edges: DataFrame) -> DataFrame:
    """id, root (the least id of its component): the least label of the neighbours, and pointer jumping."""
    both = cut(symmetric(edges))
    start = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("root"))

    def step(now):
        near = both.join(now.withColumnsRenamed({"id": "dst"}), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("m"))
        low = now.join(near, "id").select("id", F.least("root", "m").alias("root"))
        return low.join(low.select(F.col("id").alias("root"), F.col("root").alias("up")), "root").select("id", F.least("root", "up").alias("root"))

    return until_stable(start, step, lambda x: x.agg(F.sum("root")).first()[0])


def distances(edges: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """source, id, dist of each vertex within reach (or so many hops) of sources(id): frontier by frontier, until no new vertex is found.

    Each round writes its frontier alone; a vertex of an undirected graph has all its neighbours in the last, this or the next frontier, so only the last two are looked at.
    """
    both = cut(symmetric(edges))
    last = front = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("dist")).distinct())
    rounds, d = [front], 0
    while hops is None or d < hops:
        d += 1
        near = front.join(both, front.id == both.src).select("source", F.col("dst").alias("id")).distinct()
        old = front if d == 1 else front.unionByName(last)
        last, front = front, cut(near.join(old.select("source", "id"), ["source", "id"], "left_anti").withColumn("dist", F.lit(d).cast("long")))
        if front.isEmpty():
            break
        rounds.append(front)
        if len(rounds) == 50:
            rounds = [cut(reduce(DataFrame.unionByName, rounds))]
    return reduce(DataFrame.unionByName, rounds)


def bfs_tree(edges: DataFrame, root: DataFrame) -> DataFrame:
    """id, parent (the least neighbour one hop nearer; null for the root), dist from root(id)."""
    d = cut(distances(edges, root).select("id", "dist"))
    near = symmetric(edges).join(d.withColumnsRenamed({"id": "src", "dist": "a"}), "src").join(d.withColumnsRenamed({"id": "dst", "dist": "b"}), "dst").filter("b = a - 1")
    return d.join(near.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent")), "id", "left").select("id", "parent", "dist")


def colourful_degrees(edges: DataFrame, colours: DataFrame, attributes: DataFrame) -> DataFrame:
    """id, attr, colours: the number of distinct colours among a vertex's neighbours of each attribute."""
    both = symmetric(edges)
    info = colours.join(attributes, "id")
    return both.join(info.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "attr").agg(F.countDistinct("colour").alias("colours"))


MARKS = {"alive": "tinyint", "attr": "int", "colour": "int"}


def marked(parts: Parts, colours: DataFrame, attributes: DataFrame, kinds: list) -> DataFrame:
    """A state of parts: alive, attr (its place among kinds, from 1; 0: none) and colour (from 1; 0: none)."""
    place = reduce(lambda x, i: F.when(F.col("attr") == F.lit(kinds[i]), i + 1).otherwise(x), range(len(kinds)), F.lit(0))
    values = colours.select("id", (F.col("colour") + 1).cast("int").alias("colour")).join(attributes.select("id", place.cast("int").alias("attr")), "id", "full")

    def kernel(g, rows, at):
        out = {c: np.zeros(len(g.ids), np.int32) for c in ("attr", "colour")}
        for c, x in out.items():
            x[at] = rows[c].fillna(0)
        return {"alive": (out["attr"] > 0).astype(np.int8), **out}

    return parts.begin(kernel, MARKS, values=values.select(F.col("id").cast("long").alias("id"), "attr", "colour"))


def attribute_kinds(attributes: DataFrame) -> list:
    """The attributes that occur, in order; few."""
    return [r[0] for r in attributes.select("attr").distinct().orderBy("attr").collect()]


class Groups:
    """Runs of equal (own vertex, colour, attribute) among a part's arcs to neighbours that have both, and runs of equal (own vertex, colour) among these."""

    def __init__(self, g, full: dict, kinds: int):
        colour, attr = full["colour"][g.near].astype(np.int64), full["attr"][g.near].astype(np.int64)
        some = np.flatnonzero((colour > 0) & (attr > 0))
        key = (g.tails()[some] * (int(colour.max(initial=0)) + 1) + colour[some]) * (kinds + 1) + attr[some]
        order = np.argsort(key, kind="stable")
        key, self.near = key[order], g.near[some[order]]
        self.begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key = key[self.begins]
        self.attr, pair = key % (kinds + 1) - 1, key // (kinds + 1)
        self.tail, self.n, self.kinds = pair // (int(colour.max(initial=0)) + 1), len(g.ids), kinds
        self.pairs = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)

    def seen(self, alive: np.ndarray) -> np.ndarray:
        """Whether each run has a neighbour that is alive."""
        return np.maximum.reduceat(alive[self.near], self.begins) > 0 if len(self.begins) else np.zeros(0, bool)

    def by_attribute(self, runs: np.ndarray) -> np.ndarray:
        """For each own vertex and attribute how many of the runs are marked."""
        return np.bincount(self.tail[runs] * self.kinds + self.attr[runs], minlength=self.n * self.kinds).reshape(self.n, self.kinds)

    def split(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(for each own vertex and attribute the colours of that attribute alone, for each vertex the colours of more attributes)."""
        if not len(self.pairs):
            return np.zeros((self.n, self.kinds), np.int64), np.zeros(self.n, np.int64)
        times = np.add.reduceat(seen, self.pairs, dtype=np.int64)
        alone = seen & (np.repeat(times, np.diff(np.append(self.pairs, len(seen)))) == 1)
        return self.by_attribute(alone), np.bincount(self.tail[self.pairs[times > 1]], minlength=self.n)


def while_enough(parts: Parts, state: DataFrame, kinds: int, enough) -> DataFrame:
    """The state when vertices have gone, again and again, for which enough(groups, seen, own: whether an attribute is a vertex's own) is false."""

    def kernel(g, own, full):
        alive, runs = full["alive"], Groups(g, full, kinds)
        before, is_own = int(alive[g.own].sum()), own["attr"][:, None] == np.arange(1, kinds + 1)
        while True:
            stays = (alive[g.own] > 0) & enough(runs, runs.seen(alive), is_own)
            if (stays == alive[g.own]).all():
                return {**own, "alive": stays.astype(np.int8)}, before - int(stays.sum())
            alive[g.own] = stays

    return parts.until_stable(state, kernel, MARKS)


def colourful_state(parts: Parts, state: DataFrame, kinds: int, least: int) -> DataFrame:
    return while_enough(parts, state, kinds, lambda runs, seen, own: (runs.by_attribute(seen) >= least - own.astype(np.int64)).all(axis=1))


def colourful_core(edges: DataFrame | Parts, colours: DataFrame, attributes: DataFrame, least: int) -> DataFrame:
    """Edges left when vertices go that have, of some attribute, fewer than ``least`` neighbour colours (their own attribute: one less)."""
    parts, kinds = parts_of(edges), attribute_kinds(attributes)
    return parts.left(colourful_state(parts, marked(parts, colours, attributes, kinds), len(kinds), least), MARKS)


def _xxhash64(ids: np.ndarray, k: int) -> np.ndarray:
    """Spark's xxhash64 of a long and an int."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def mix(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    h = np.full(len(ids), 42, np.uint64) + p5 + np.uint64(8)
    h = mix(turn(h ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
    return mix(turn((h + p5 + np.uint64(4)) ^ (np.full(len(ids), k, np.uint64) * p1), 23) * p2 + p3).view(np.int64)


def colouring(edges: DataFrame | Parts, most: int = 500) -> DataFrame:
    """id, colour of a proper colouring, by proposals: rounds whose number grows with the logarithm of the vertices, whatever the degrees.

    In a round each uncoloured vertex proposes one of its first free colours, by a hash among one more than half of its uncoloured neighbours before it (by descending degree, id), so the first
    take their least one; of two neighbours that propose the same colour the earlier has it.  The values (colour and proposal from 1, 0: none) of ends in other parts come anew for each half of a round.
    """
    parts, shared = parts_of(edges), {"deg": "int", "colour": "int", "asked": "int"}

    def open_arcs(g, full):
        left = np.flatnonzero(full["colour"][g.own] == 0)
        arcs, _ = g.arcs_of(left)
        tail, near = np.repeat(np.arange(len(left)), g.deg[left]), g.near[arcs]
        mine, other = np.repeat(g.deg[left], g.deg[left]), full["deg"][near]
        later = (other > mine) | ((other == mine) & (g.local[near] > np.repeat(g.ids[left], g.deg[left])))
        return left, tail, near, later

    def propose(k):
        def kernel(g, own, full):
            left, tail, near, later = open_arcs(g, full)
            colour = full["colour"][near].astype(np.int64)
            ahead = np.bincount(tail[later & (colour == 0)], minlength=len(left))
            t = _xxhash64(g.ids[left], k) % ((ahead >> 1) + 1)  # numpy's % of a positive divisor is not negative
            many = int(colour.max(initial=0)) + 1
            pairs = np.unique(tail[colour > 0] * many + colour[colour > 0])
            who, used = pairs // many, pairs % many - 1
            place = np.arange(len(pairs)) - np.searchsorted(who, who)
            asked = np.zeros(len(g.ids), np.int32)
            asked[left] = t + np.bincount(who[used - place <= t[who]], minlength=len(left)) + 1  # free colours before the i-th used one c: c - i
            return {**own, "asked": asked}, 0

        return kernel

    def settle(g, own, full):
        left, tail, near, later = open_arcs(g, full)
        asked, colour = full["asked"], own["colour"].copy()
        mine = asked[g.own][left]
        beaten = np.bincount(tail[later & (full["colour"][near] == 0) & (asked[near] == mine[tail])], minlength=len(left)) > 0
        colour[left[~beaten]] = mine[~beaten]
        return {**own, "colour": colour, "asked": np.zeros(len(colour), np.int32)}, int(beaten.sum())

    zeros = lambda g: np.zeros(len(g.ids), np.int32)
    state = parts.begin(lambda g: {"deg": g.deg.astype(np.int32), "colour": zeros(g), "asked": zeros(g)}, shared)
    for k in range(most):
        state = cut(parts.step(parts.step(state, propose(k), shared), settle, shared))
        if not state.agg(F.sum("changed")).first()[0]:
            return parts.out(state, lambda g, own, full, key: pd.DataFrame({"id": g.ids, "colour": own["colour"] - 1}), shared, "id bigint, colour int")
    raise RuntimeError("vertices are uncoloured after so many rounds")
