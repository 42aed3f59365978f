"""Bursting cores by repaired rows and greedy communities, against the plain ways."""
from itertools import combinations

import numpy as np
import pytest

from meshwork.operators import community, temporal


@pytest.mark.parametrize("n,length,first,last", [(12, 3, 0, None), (12, 3, 4, 7), (9, 4, 6, 20), (5, 5, 0, None), (30, 2, 11, 13)])
def test_best_windows_by_end(n, length, first, last):
    ds = np.random.default_rng(n).integers(0, 5, n)
    want = [max(((ds[b - k : b].sum()) / k for k in range(length, 2 * length) if k <= b), default=0.0) for b in range(n + 1)]
    got = temporal.best_by_end(ds, length, first, last, np.full(n + 1, -1.0))
    for b in range(n + 1):
        inside = max(first, length) <= b <= (n if last is None else min(last, n))
        assert got[b] == pytest.approx(want[b]) if inside else got[b] == -1


@pytest.mark.parametrize("seed,length,delta", [(1, 2, 1.5), (2, 3, 2), (3, 2, 2.5), (4, 4, 1)])
def test_repaired_core_equals_the_plain_one(spark, seed, length, delta):
    rng = np.random.default_rng(seed)
    rows = {(int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, 30, 500), rng.integers(0, 30, 500), rng.integers(0, 12, 500), strict=True) if a != b and (a + b) % 3}
    df = temporal.both_ways(spark.createDataFrame(sorted(rows), "u long, v long, t int"))
    want = sorted(r.u for r in temporal.bursting_core(df, length, delta, 12).collect())
    core, rounds = temporal.bursting_core_by_rounds(df, length, delta, 12, compact=2)
    assert sorted(r.u for r in core.collect()) == want
    assert all(touched <= rounds[0][0] for touched, _ in rounds) and rounds[-1][1] == 0


def test_rounds_touch_changed_vertices_only(spark):
    clique = [(a, b, t) for a, b in combinations(range(6), 2) for t in range(8)]
    path = [(k, k + 1, 0) for k in range(100, 108)]
    df = temporal.both_ways(spark.createDataFrame(clique + path, "u long, v long, t int"))
    core, rounds = temporal.bursting_core_by_rounds(df, 3, 2, 8)
    assert sorted(r.u for r in core.collect()) == list(range(6))
    assert rounds[0] == (15, 9) and rounds[-1][1] == 0 and sum(t for t, _ in rounds[1:]) <= 9


def brute_greedy(adj, seed, prob, size, hops):
    dist, order = {seed: 0}, [seed]
    for v in order:
        for w in sorted(adj[v]):
            if w not in dist and dist[v] < hops:
                dist[w] = dist[v] + 1
                order.append(w)
    parent = {v: min(w for w in adj[v] if dist.get(w) == dist[v] - 1) for v in dist if v != seed}
    chosen = [seed]
    while len(chosen) < size:
        best = None
        for v in dist:
            if v in chosen:
                continue
            path = [v]
            while parent[path[-1]] not in chosen:
                path.append(parent[path[-1]])
            key = (-round(sum(prob.get(x, 0.0) for x in path) / len(path), 9), dist[v], v)
            best = min(best or (key, path), (key, path))
        if best is None:
            break
        chosen += best[1][: size - len(chosen)]
    return chosen


def test_greedy_communities(spark):
    rng = np.random.default_rng(3)
    pairs = [e for e in combinations(range(24), 2) if rng.random() < 0.11]
    adj = {v: set() for v in range(24)}
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    prob = {v: float(round(rng.random(), 1)) for v in range(24) if v % 7}
    start = [v for v in range(24) if adj[v]][:4]
    got = community.greedy_community(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(v,) for v in start], "id long"), spark.createDataFrame(list(prob.items()), "id long, prob double"), 6)
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.place):
        found.setdefault(r.seed, []).append(r.id)
    assert found == {v: brute_greedy(adj, v, prob, 6, 3) for v in start}
