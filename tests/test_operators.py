"""Operators that SQL doesn't express, against brute force on small graphs, closed forms and invariants."""
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.operators import core, count, matrix, metrics, ppr, resistance, sampling, spatial, temporal
from meshwork.operators import enumerate as enum
from meshwork.sources import files, sinks
from meshwork.sources.tables import symmetric

EIGHTEEN = [(1, 2), (1, 3), (1, 7), (1, 8), (2, 3), (2, 8), (3, 4), (3, 8), (4, 5), (4, 6), (4, 7), (4, 8), (5, 6), (5, 7), (5, 8), (6, 7), (6, 8), (7, 8)]


def edges(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")


def complete(n):
    return list(combinations(range(1, n + 1), 2))


def graph(seed, n, p):
    rng = np.random.default_rng(seed)
    return [e for e in combinations(range(1, n + 1), 2) if rng.random() < p]


def members(df):
    return sorted(tuple(sorted(r.members)) for r in df.collect())


def maximal(sets):
    return sorted(tuple(sorted(s)) for s in sets if not any(s < t for t in sets))


def subsets(nodes, least):
    return (frozenset(c) for k in range(least, len(nodes) + 1) for c in combinations(nodes, k))


def adjacency(pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def test_counts_of_known_graphs(spark):
    k5, k33 = edges(spark, complete(5)), spark.createDataFrame([(u, v) for u in range(3) for v in range(3)], "u long, v long")
    assert [count.clique_count(k5, k).first()[0] for k in (3, 4, 5)] == [10, 5, 1]
    assert count.butterflies(k33).first()[0] == 9
    assert count.bicliques(k33, 2, 3).first()[0] == 3 and count.bicliques(k33, 3, 3).first()[0] == 1


def test_cliques(spark):
    assert members(enum.maximal_cliques(edges(spark, EIGHTEEN))) == [(1, 2, 3, 8), (1, 7, 8), (3, 4, 8), (4, 5, 6, 7, 8)]
    for seed in (1, 2):
        g = graph(seed, 11, 0.5)
        adj = adjacency(g)
        want = maximal([s for s in subsets(sorted(adj), 2) if all(b in adj[a] for a, b in combinations(s, 2))])
        assert members(enum.maximal_cliques(edges(spark, g))) == want
        assert members(enum.maximal_cliques(edges(spark, g), 4)) == [m for m in want if len(m) >= 4]


def test_fair_cliques(spark):
    g = edges(spark, EIGHTEEN)
    attr = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "id long, attr int")
    assert len(members(enum.fair_cliques(g, attr, 1))) == 4
    assert members(enum.fair_cliques(g, attr, 2)) == [(1, 2, 3, 8), (4, 5, 6, 7, 8)]
    adj = adjacency(EIGHTEEN)
    for delta in (0, 1):
        fair = [s for s in subsets(range(1, 9), 2) if all(b in adj[a] for a, b in combinations(s, 2)) and min(k := [sum(x % 2 == a for x in s) for a in (0, 1)]) >= 1 and max(k) - min(k) <= delta]
        assert members(enum.fair_cliques(g, attr, 1, delta)) == maximal(fair)


def test_uncertain_cliques(spark):
    rng = np.random.default_rng(3)
    g = [(a, b, float(rng.uniform(0.5, 1))) for a, b in graph(4, 10, 0.6)]
    p = {frozenset((a, b)): w for a, b, w in g}
    df = spark.createDataFrame(g, "src long, dst long, p double")
    good = [s for s in subsets(range(1, 11), 2) if all(frozenset(e) in p for e in combinations(s, 2)) and np.prod([p[frozenset(e)] for e in combinations(s, 2)]) >= 0.4]
    want = [m for m in maximal(good) if len(m) >= 3]
    assert members(enum.uncertain_cliques(df, 3, 0.4)) == want


def test_defective_cliques(spark):
    adj = adjacency(EIGHTEEN)
    for k, q, n in ((1, 3, 14), (1, 4, 12), (2, 5, 10)):
        good = [s for s in subsets(range(1, 9), 1) if sum(b not in adj[a] for a, b in combinations(s, 2)) <= k]
        want = [m for m in maximal(good) if len(m) >= q]
        assert len(want) == n
        assert members(enum.defective_cliques(edges(spark, EIGHTEEN), k, q)) == want


def bip(seed, p=0.5):
    rng = np.random.default_rng(seed)
    return [(u, v) for u in range(1, 7) for v in range(1, 7) if rng.random() < p]


def pairs_of(df):
    return sorted((tuple(sorted(r.us)), tuple(sorted(r.vs))) for r in df.collect())


def test_bicliques_and_biplexes(spark):
    for seed in (1, 2):
        e = set(bip(seed, 0.6))
        df = spark.createDataFrame(sorted(e), "u long, v long")
        for k, least in ((0, 1), (0, 2), (1, 3)):
            good = []
            for us in subsets(range(1, 7), 1):
                for vs in subsets(range(1, 7), 1):
                    if all(sum((u, v) not in e for v in vs) <= k for u in us) and all(sum((u, v) not in e for u in us) <= k for v in vs):
                        good.append((us, vs))
            want = sorted((tuple(sorted(a)), tuple(sorted(b))) for a, b in good if len(a) >= least and len(b) >= least and not any(a <= c and b <= d and (a, b) != (c, d) for c, d in good))
            got = enum.maximal_bicliques(df, least, least) if k == 0 else enum.maximal_biplexes(df, k, least, least)
            assert pairs_of(got) == want


def test_cores_and_components(spark):
    g = graph(5, 40, 0.12)
    df, adj = edges(spark, g), adjacency(g)

    def core_of(k):
        a = {x: set(y) for x, y in adj.items()}
        while any(len(v) < k for v in a.values()):
            x = next(x for x, v in a.items() if len(v) < k)
            for y in a.pop(x):
                a[y].discard(x)
        return set(a)

    got = {r.id: r.core for r in core.core_numbers(df).collect()}
    assert got == {x: max(k for k in range(0, 20) if x in core_of(k)) for x in adj}
    colour = {r.id: r.colour for r in core.colouring(df).collect()}
    assert set(colour) == set(adj) and all(colour[a] != colour[b] for a, b in g)
    comp = {r.id: r.root for r in core.components(edges(spark, [(1, 2), (2, 3), (7, 8), (10, 9), (9, 7)])).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7}
    dist = {r.id: r.dist for r in core.distances(edges(spark, [(i, i + 1) for i in range(1, 6)]), spark.createDataFrame([(1,)], "id long")).collect()}
    assert dist == {i: i - 1 for i in range(1, 7)}


def test_eta_core(spark):
    df = spark.createDataFrame([(a, b, 0.9) for a, b in EIGHTEEN], "src long, dst long, p double")
    assert core.eta_core(df, 4, 0.5).count() > 0
    assert core.eta_core(df, 4, 0.99).count() == 0


def transition(pairs):
    nodes = sorted({x for e in pairs for x in e})
    p = np.zeros((len(nodes), len(nodes)))
    for a, b in pairs:
        p[nodes.index(a), nodes.index(b)] = 1
    dangling = p.sum(axis=1) == 0
    p[dangling, dangling] = 1
    return nodes, p / p.sum(axis=1, keepdims=True)


def test_ppr(spark):
    arcs = [(a, b) for e in EIGHTEEN for a, b in (e, e[::-1])] + [(8, 9)]
    nodes, p = transition(arcs)
    exact = 0.2 * np.linalg.inv(np.eye(len(nodes)) - 0.8 * p)
    df = edges(spark, arcs)
    start = ppr.single_sources(spark.createDataFrame([(1,), (9,)], "id long"))
    got = {(r.source, r.id): r.score for r in ppr.power_to(df, start, 1e-5).collect()}
    for s in (1, 9):
        for x in nodes:
            assert abs(got.get((s, x), 0) - exact[nodes.index(s), nodes.index(x)]) < 2e-5
    back = {r.id: r.score for r in ppr.backward(edges(spark, arcs[:-1]), 1, 60).collect()}
    n2, p2 = transition(arcs[:-1])
    e2 = 0.2 * np.linalg.inv(np.eye(len(n2)) - 0.8 * p2)
    assert all(abs(back[x] - e2[n2.index(x), n2.index(1)]) < 1e-4 for x in n2)
    res, rest = ppr.push(df, start, 1e-4)
    total = res.agg(F.sum("p")).first()[0] + rest.agg(F.sum("r")).first()[0]
    assert abs(total - 2) < 1e-9
    for est in (ppr.walks(df, start, 4000), ppr.fora(df, start, 1e-2, 4000)):
        rows = {(r.source, r.id): r.score for r in est.collect()}
        assert max(abs(rows.get((1, x), 0) - exact[nodes.index(1), nodes.index(x)]) for x in nodes) < 0.05
    undirected = edges(spark, arcs[:-1])
    one = ppr.single_sources(spark.createDataFrame([(1,)], "id long"))
    for reduced in (True, False):
        rows = {r.id: r.score for r in ppr.forest_scores(undirected, one, 300, reduced=reduced).collect()}
        assert max(abs(rows.get(x, 0) - e2[n2.index(1), n2.index(x)]) for x in n2) < 0.1
    assert [r.id for r in ppr.top_k(ppr.power(df, one, 10), 1).collect()] == [1]


def test_resistance(spark):
    k5 = edges(spark, complete(5))
    pairs = spark.createDataFrame([(1, 2), (3, 5), (2, 2)], "s long, t long")
    got = {(r.s, r.t): r.resistance for r in resistance.pair_resistance(k5, pairs, 5, 60).collect()}
    assert abs(got[1, 2] - 0.4) < 1e-6 and abs(got[3, 5] - 0.4) < 1e-6 and got[2, 2] == 0
    path = edges(spark, [(i, i + 1) for i in range(1, 5)])
    index = {r.id: r.resistance for r in resistance.landmark_index(path, 1, 400).collect()}
    assert all(abs(index[i] - (i - 1)) < 1e-4 for i in range(2, 6))


def test_isolated_rows_of_norms(spark):
    m = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "row long, col long, val double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {(r.row, r.col): r.val for r in matrix.normalise(m, nodes, "norm_laplacian").collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (1, 2): -1.0, (2, 1): -1.0}
    with pytest.raises(ValueError):
        matrix.normalise(m, nodes, "other")


def test_segments_and_bursts(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        ds = rng.integers(0, 5, 12)
        want = max(ds[i:j].mean() for i in range(12) for j in range(i + 3, 13))
        assert abs(temporal.densest_segment(ds, 3) - want) < 1e-12
    rows = [(u, v, t) for t in (3, 4, 5) for u, v in combinations((1, 2, 3), 2)] + [(4, 1, 9), (4, 2, 0)]
    both = temporal.both_ways(spark.createDataFrame(rows, "u long, v long, t int"))
    assert {r.u for r in temporal.bursting_core(both, 3, 2, 10).collect()} == {1, 2, 3}
    assert temporal.greatest_delta(both, 3, 10)[0] == 2
    msd = {r.u: r.msd for r in temporal.segment_density(both, 3, 10).collect()}
    assert abs(msd[1] - 2.0) < 1e-9


def test_samplers_repeat(spark):
    g = sampling.random_graph(spark, 60, 0.2, 3)
    assert sorted(g.collect()) == sorted(sampling.random_graph(spark, 60, 0.2, 3).repartition(7).collect()) == sorted(set(g.collect()))
    assert abs(g.count() - 0.2 * 60 * 59 / 2) < 80 and g.filter("src >= dst OR dst >= 60").isEmpty()
    assert sampling.random_graph(spark, 20, 1.0).count() == 190 and sampling.random_graph(spark, 20, 0.0).count() == 0
    neg = sampling.local_negatives(g, count.degrees(g), 2)
    assert neg.join(symmetric(g), ["src", "dst"]).count() == 0 and neg.count() > 0
    full = sampling.sampled_clique_count(g, 3, 1.0).first()[0]
    assert full == count.clique_count(g, 3).first()[0]
    w = g.withColumn("w", F.lit(1.0))
    p = sampling.priority_edges(w, 50)
    assert p.count() == 50 and abs(p.agg(F.sum(F.col("w") / F.col("prob"))).first()[0] - g.count()) < 0.5 * g.count()
    table = sampling.unigram_table(g).orderBy("id").collect()
    assert abs(table[-1].high - 1) < 1e-9 and all(abs(a.high - b.low) < 1e-9 for a, b in zip(table, table[1:], strict=False))


def test_clique_estimates_by_paths(spark):
    g = edges(spark, graph(3, 24, 0.5))
    for arcs, k in ((count.oriented(g), 4), (sampling.ordered_by_colour(g), 3)):
        want = count.clique_count(g, k).first()[0]
        got = sampling.path_clique_count(arcs, k, 4000).first()
        assert abs(got.cliques - want) < 0.15 * want
        assert got.hits <= got.draws and abs(got.draws - 4000) <= 24
    whole = sampling.path_clique_count(edges(spark, complete(5)), 3, 200).first()
    assert whole.paths == 10 and whole.draws == whole.hits and abs(whole.cliques - 10) < 0.5
    none = sampling.path_clique_count(edges(spark, [(1, 2)]), 3, 100).first()
    assert (none.draws, none.hits, none.paths, none.cliques) == (0, 0, 0.0, 0.0)


def test_cluster_heads_in_turn(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(rng.uniform(0, 10)), float(rng.uniform(0, 10)), float(rng.integers(0, 5))) for i in range(60)]
    left, heads = {p[0] for p in pts}, set()
    by = {p[0]: p for p in pts}
    while left:
        h = max(left, key=lambda i: (by[i][3], -i))
        heads.add(h)
        left -= {i for i in left if (by[i][1] - by[h][1]) ** 2 + (by[i][2] - by[h][2]) ** 2 <= 4}
    got = spatial.cluster_heads(spark.createDataFrame(pts, "id long, x double, y double, weight double"), 2.0).collect()
    assert {r.head for r in got} == heads and {r.id for r in got} == set(by)


def test_assignment_against_all_permutations(spark):
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(20):
        c = rng.integers(0, 20, (5, 5)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(5)) for p in permutations(range(5)))
        assert sum(c[i, j] for i, j in enumerate(metrics.assignment(c))) == best
    df = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "label int, pred int")
    assert metrics.best_mapping_accuracy(df) == 1.0


def test_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("4 3\n0 1\n1 2\n2 1\n")
    assert sorted(map(tuple, files.edge_list(spark, str(tmp_path / "e.txt")).collect())) == [(0, 1), (1, 2), (2, 1)]
    assert sorted(map(tuple, files.edge_list(spark, str(tmp_path / "e.txt"), ascending_only=True).collect())) == [(0, 1), (1, 2)]
    (tmp_path / "w.txt").write_text("% c\n3\n0 1 0.5\n1 2 2\n")
    assert sorted(map(tuple, files.weighted_edge_list(spark, str(tmp_path / "w.txt")).collect())) == [(0, 1, 0.5), (1, 2, 2.0)]
    (tmp_path / "t.txt").write_text("5\t6\t10\n6\t5\t10\n5\t5\t3\n5\t7\t12\n")
    assert sorted(map(tuple, files.temporal_edge_list(spark, str(tmp_path / "t.txt")).collect())) == [(5, 6, 0), (5, 7, 2), (6, 5, 0), (7, 5, 2)]
    np.array([1, 0, 2, 1], "<u4").tofile(tmp_path / "g.edge")
    np.array([0, 1, 3, 4], "<u4").tofile(tmp_path / "g.idx")
    assert sorted((r.id, list(r.nbrs)) for r in files.binary_adjacency(spark, str(tmp_path)).collect()) == [(0, [1]), (1, [0, 2]), (2, [1])]
    e, ids = files.dense_ids(edges(spark, [(10, 30), (30, 70)]))
    assert sorted(map(tuple, e.collect())) == [(0, 1), (1, 2)] and sorted(map(tuple, ids.collect())) == [(0, 10), (1, 30), (2, 70)]
    sinks.member_lines(enum.maximal_cliques(edges(spark, complete(3))), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["3 1 2 3"]


def test_stream_equals_batch(spark, tmp_path):
    from meshwork.streaming import events as stream

    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.windowed(stream.event_stream(spark, str(tmp_path / "in"), batch.schema), "1 day", "40 days")
    q = live.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.start, r.event_type, r.n) for r in spark.table("seen").collect())
    assert got == sorted((r.start, r.event_type, r.n) for r in stream.windowed(batch).collect())
