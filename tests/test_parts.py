"""Rounds over parts: several small parts give the results of plain searches, and a round shuffles no arcs."""
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meshwork.operators import core, peel, ppr, resistance
from meshwork.operators.parts import Parts

RNG = random.Random(5)
PAIRS = sorted({tuple(sorted(RNG.sample(range(60), 2))) for _ in range(260)} | {(100, 101), (101, 102)})


def parts(spark):
    g = Parts(spark.createDataFrame(PAIRS, "src long, dst long"), part_arcs=90)
    assert g.rows.count() > 3
    return g


def near():
    out = {}
    for a, b in PAIRS:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def test_round_moves_no_arcs(spark):
    g = parts(spark)
    shared = {"x": "double"}
    state = g.step(g.begin(lambda p: {"x": np.ones(len(p.ids))}, shared), lambda p, own, full: ({"x": p.sums(full["x"][p.near])}, 0), shared)
    assert str(state._jdf.queryExecution().executedPlan()).split("== Initial Plan ==")[-1].count("Exchange") == 1
    got = {r.id: r.x for r in g.out(state, lambda p, own, full, key: pd.DataFrame({"id": p.ids, "x": own["x"]}), shared, "id bigint, x double").collect()}
    assert got == {k: len(v) for k, v in near().items()}


def test_cores_and_colours(spark):
    g, adj = parts(spark), near()
    numbers, left, k = {}, {a: set(b) for a, b in adj.items()}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        numbers[v] = k
        for w in left.pop(v):
            left[w].discard(v)
    assert {r.id: r.core for r in core.core_numbers(g).collect()} == numbers
    assert sorted(map(tuple, core.k_core(g, 5).collect())) == [(a, b) for a, b in PAIRS if numbers[a] >= 5 and numbers[b] >= 5]
    colour = {r.id: r.colour for r in core.colouring(g).collect()}
    assert colour.keys() == adj.keys() and all(colour[a] != colour[b] for a, b in PAIRS) and all(colour[v] <= len(adj[v]) for v in adj)
    hashed = spark.createDataFrame([(i,) for i in (0, 1, -7, 2**40)], "id long").select("id", F.xxhash64("id", F.lit(3)).alias("h")).collect()
    assert core._xxhash64(np.array([r.id for r in hashed]), 3).tolist() == [r.h for r in hashed]


def test_reductions(spark):
    g, adj = parts(spark), near()
    colours = core.colouring(g).localCheckpoint()
    attr = g.vertices().select("id", (F.col("id") % 2).cast("int").alias("attr"))
    colour = {r.id: r.colour for r in colours.collect()}
    kinds = lambda v, alive: {c: {w % 2 for w in adj[v] if w in alive and colour[w] == c} for c in {colour[w] for w in adj[v] if w in alive}}.values()

    def reduced(stays):
        alive = set(adj)
        while gone := [v for v in alive if not stays(v, alive)]:
            alive -= set(gone)
        return [e for e in PAIRS if set(e) <= alive]

    def fair(v, alive):
        seen = list(kinds(v, alive))
        return sum(max(0, 2 - seen.count({a}) - (a == v % 2)) for a in (0, 1)) <= seen.count({0, 1})

    colourful = lambda v, alive: all(sum(a in x for x in kinds(v, alive)) >= 2 - (a == v % 2) for a in (0, 1))
    for got, want in ((peel.fair_reduction(g, colours, attr, 2), fair), (core.colourful_core(g, colours, attr, 2), colourful), (peel.strong_reduction(g, colours, attr, 2), lambda v, a: colourful(v, a) and fair(v, a))):
        found = sorted(map(tuple, got.collect()))
        assert found == reduced(want) and 0 < len(found) < len(PAIRS)


def test_pagerank_and_visits(spark):
    g = parts(spark)
    both = g.edges.unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.5), (2, 101, 0.5), (3, 999, 1.0)], "source long, id long, r double")
    table = lambda df: {tuple(r)[:-1]: r[-1] for r in df.collect()}
    for got, want in ((ppr.power(g, start, 7), ppr.power(both, start, 7)), (ppr.backward(g, 3, 6), ppr.backward(both, 3, 6)), (ppr.centrality(g, 6), ppr.centrality(both, 6))):
        a, b = table(got), table(want)
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    visits = table(resistance.absorbed_visits(g, spark.createDataFrame([(1,), (2,), (4,), (999,)], "id long"), 2, 5))
    adj, x = near(), {1: 1.0}
    total = dict(x)
    for _ in range(5):
        nxt = {}
        for v, r in x.items():
            for w in adj[v] - {2}:
                nxt[w] = nxt.get(w, 0.0) + r / len(adj[v])
        x = nxt
        for w, r in x.items():
            total[w] = total.get(w, 0.0) + r
    got = {k[1]: v for k, v in visits.items() if k[0] == 1}
    assert got.keys() == total.keys() and all(abs(got[k] - total[k]) < 1e-12 for k in total)
    assert visits[999, 999] == 1.0 and not any(k[0] == 2 for k in visits)
