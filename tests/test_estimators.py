"""Counts by pivots, orders, reductions, estimators, readers and tuples against closed forms and brute force."""
import json
import pickle
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.functions.hashing import edge_key, spread
from meshwork.operators import community, core, count, enumerate as enum, kernels, metrics, order, peel, pivot, ppr, resistance, sampling, temporal, tuples, walks
from meshwork.sources import bundles
from meshwork.sources.tables import symmetric


def edges(spark, pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src long, dst long").coalesce(2)


def bip(spark, pairs):
    return spark.createDataFrame(list(pairs), "u long, v long").coalesce(2)


def random_pairs(seed, n, p):
    rng = np.random.default_rng(seed)
    return [(a, b) for a, b in combinations(range(n), 2) if rng.random() < p]


def test_hashes_of_large_ids(spark):
    big = edges(spark, [(2**62, 2**61), (10**9 + 7, 10**12), (1, 2)])
    u = [r[0] for r in big.select(spread(edge_key(), 3)).collect()]
    assert all(0 <= x < 1 for x in u) and len(set(u)) == 3
    assert sum(r["n"] for r in community.split_edges(big).groupBy("split").agg(F.count("*").alias("n")).collect()) == 3


def test_numbering_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert [(r.x, r.at) for r in order.numbered(df, "x", "at").orderBy("x").collect()] == [(i, i) for i in range(1000)]
    assert [r.s for r in order.running(df, "x", "x", "s").orderBy("x").collect()] == np.cumsum(np.arange(1000)).tolist()


def test_pivot_counts(spark):
    k30 = edges(spark, combinations(range(30), 2))
    assert {r.k: int(r.cliques) for r in pivot.clique_counts(k30).collect()} == {k: comb(30, k) for k in range(1, 31)}
    pairs = random_pairs(1, 18, 0.5)
    near = {frozenset(p) for p in pairs}
    want = {k: n for k in range(1, 8) if (n := sum(all(frozenset(p) in near for p in combinations(c, 2)) for c in combinations(range(18), k)))}
    for by in ("vertex", "edge"):
        assert {r.k: int(r.cliques) for r in pivot.clique_counts(edges(spark, pairs), by=by).collect()} == want


def test_biclique_counts(spark):
    rng = np.random.default_rng(2)
    pairs = {(int(u), int(v)) for u in range(8) for v in range(9) if rng.random() < 0.5}
    want = {(p, q): n for p in (1, 2, 3) for q in (1, 2, 3) if (n := sum(all((u, v) in pairs for u in us for v in vs) for vs in combinations(range(9), p) for us in combinations(range(8), q)))}
    g = bip(spark, pairs)
    assert {(r.p, r.q): int(r.bicliques) for r in pivot.biclique_counts(g, 3, 3).collect()} == want
    for p, q in ((2, 3), (3, 2)):
        assert int(pivot.biclique_count(g, p, q).first()[0]) == count.bicliques(g, p, q).first()[0] == want[p, q]
        by = count.bicliques_by_vertex(g, p, q, "u").agg(F.sum("bicliques")).first()[0]
        assert by == q * want[p, q]
    got = sampling.biclique_estimate(g, 2, 2, 3000).first()
    assert abs(got.bicliques - want[2, 2]) < 0.2 * want[2, 2]
    small, rest = pivot.sparse_biclique_counts(g, 20, 3, 3)
    assert rest.count() < 8 and small.count() > 0


def test_densest_set(spark):
    k33 = [(u, v) for u in (1, 2, 3) for v in (1, 2, 3)]
    tail = [(3, 4), (4, 4), (4, 5), (5, 5), (5, 6), (6, 6), (4, 1)]
    got = enum.densest_exact(bip(spark, k33 + tail), 2, 2).first()
    assert (got.us, got.vs, got.bicliques, got.density) == ([1, 2, 3], [1, 2, 3], 9, 1.5)
    rows = {(p, q): enum.densest_by_peeling(bip(spark, k33), p, q).first() for p, q in ((2, 2), (3, 3))}
    assert rows[2, 2].bicliques == 9 and rows[3, 3].bicliques == 1
    flow = enum.Flow(4)
    for a, b, c in ((0, 1, 3), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 3)):
        flow.add(a, b, c)
    assert flow.most(0, 3) == 5


def test_orders_and_reductions(spark):
    pairs = random_pairs(3, 24, 0.3)
    g = edges(spark, pairs)
    want = {r.id: r.core for r in core.core_numbers(g).collect()}
    rows = peel.core_order(g).orderBy("place").collect()
    assert {r.id: r.core for r in rows} == want and [r.place for r in rows] == list(range(len(want)))
    at = {r.id: r.place for r in rows}
    for r in rows:  # a vertex has at most as many later neighbours as the largest core
        assert sum(at[b if a == r.id else a] > r.place for a, b in pairs if r.id in (a, b)) <= max(want.values()) + 24
    attr = spark.createDataFrame([(i, i % 2) for i in range(24)], "id long, attr int")
    colours = core.colouring(g)
    paint = {r.id: r.colour for r in colours.collect()}
    assert len(paint) == len(want) and all(paint[a] != paint[b] for a, b in pairs)
    live = {x for p in pairs for x in p}
    while True:
        gone = set()
        for x in live:
            by = {}
            for a, b in pairs:
                if x in (a, b) and a in live and b in live:
                    y = b if a == x else a
                    by.setdefault(paint[y], set()).add(y % 2)
            only = [sum(k == {t} for k in by.values()) + (x % 2 == t) for t in (0, 1)]
            mixed = sum(len(k) == 2 for k in by.values())
            if mixed < sum(max(0, 2 - o) for o in only):
                gone.add(x)
        if not gone:
            break
        live -= gone
    got = {tuple(r) for r in peel.fair_reduction(g, colours, attr, 2).collect()}
    assert got == {p for p in pairs if set(p) <= live}
    assert peel.fairness_order(g, attr).count() == peel.colourful_order(g, colours).count() == len(want)
    assert peel.strong_reduction(g, colours, attr, 2).count() <= len(got)


def test_eta_triangles(spark):
    rows = [(a, b, 0.9) for a, b in combinations(range(4), 2)] + [(3, 4, 0.9), (4, 5, 0.9), (3, 5, 0.6)]
    g = spark.createDataFrame(rows, "src long, dst long, p double")
    kept = {(r.src, r.dst) for r in peel.eta_triangle_core(g, 4, 0.55).collect()}
    assert kept == set(combinations(range(4), 2))  # 0.9 times two products of 0.81 is 0.59


def test_many_attributes_and_long_paths(spark):
    star = edges(spark, combinations(range(3), 2))
    attr = spark.createDataFrame([(i, i) for i in range(74)], "id long, attr int")
    assert enum.fair_cliques(star, attr, 1).count() == 0  # 74 attributes, of which a triangle has three
    path = edges(spark, [(i, i + 1) for i in range(149)])
    d = core.distances(path, spark.createDataFrame([(0,)], "id long"))
    assert d.count() == 150 and d.agg(F.max("dist")).first()[0] == 149
    with pytest.raises(ValueError):
        temporal.segment_density(spark.createDataFrame([(1, 2, 9)], "u long, v long, t int"), 2, 5)
    tree = {r.id: (r.parent, r.dist) for r in core.bfs_tree(edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)]), spark.createDataFrame([(1,)], "id long")).collect()}
    assert tree == {1: (None, 0), 2: (1, 1), 3: (1, 1), 4: (2, 2)}


def test_more_ppr(spark):
    pairs = random_pairs(5, 14, 0.4)
    arcs = symmetric(edges(spark, pairs))
    one = ppr.single_sources(spark.createDataFrame([(0,)], "id long"))
    exact = {r.id: r.score for r in ppr.power(arcs, one, 40).collect()}
    for got in (ppr.fora_with_forests(arcs, one, 1e-2, 60), ppr.speed_ppr(arcs, one, 1e-3, 2000), ppr.progressive(arcs, one, 2, 500, power_rounds=3), walks.stopping_walks(arcs, one, 20_000)):
        found = {r.id: r.score for r in got.collect()}
        assert abs(sum(found.values()) - 1) < 0.02 and max(abs(found.get(x, 0) - exact[x]) for x in exact) < 0.03
    score, rest = ppr.backward_push(arcs, 0, 1e-4)
    back, deg = {r.id: r.score for r in score.collect()}, {r.id: r.deg for r in count.degrees(edges(spark, pairs)).collect()}
    assert all(abs(back.get(x, 0) - exact[x] * deg[0] / deg[x]) < 1e-3 for x in exact)  # of undirected graphs
    rough = {r.id: r.score for r in ppr.randomised_backward(arcs, 0, 1e-3).collect()}
    assert max(abs(rough.get(x, 0) - back.get(x, 0)) for x in back) < 0.05
    share, other = kernels.alias_table(np.array([1.0, 2.0, 5.0]))
    drawn = kernels.alias_draws(share, other, 40_000, np.random.default_rng(1))
    assert np.allclose(np.bincount(drawn) / 40_000, [0.125, 0.25, 0.625], atol=0.01)


def test_more_resistance(spark):
    pairs = random_pairs(6, 12, 0.5)
    n = 12
    lap = np.zeros((n, n))
    for a, b in pairs:
        lap[a, b] = lap[b, a] = -1
    np.fill_diagonal(lap, -lap.sum(axis=1))
    inv = np.linalg.pinv(lap)
    want = lambda s, t: inv[s, s] + inv[t, t] - 2 * inv[s, t]
    g = edges(spark, pairs)
    ask = spark.createDataFrame([(0, 1), (2, 7), (5, 5)], "s long, t long")
    stop = resistance.landmark_by(g, "degree")
    for got, near in ((resistance.exact_resistance(g, ask), 1e-7), (resistance.push_resistance(g, ask, stop, 1e-3), 0.05), (resistance.walk_resistance(g, ask, stop, 4000), 0.06), (resistance.escape_resistance(g, ask, 20_000), 0.05), (resistance.bidirectional_resistance(g, ask, stop, 0.05, 2000), 0.06)):
        for r in got.collect():
            assert abs(r.resistance - want(r.s, r.t)) < near, (r, want(r.s, r.t))
    assert abs(resistance.resistance_by_tree_counts(g, 0, 1) - want(0, 1)) < 1e-9
    index = {r.id: r.resistance for r in resistance.landmark_by_trees(g, stop, 600).collect()}
    assert max(abs(index[i] - (want(i, stop) if i != stop else 0)) for i in range(n)) < 0.08
    share = {(r.src, r.dst): r.share for r in resistance.spanning_edge_centrality(g, stop, 600).collect()}
    assert max(abs(share[p] - want(*p)) for p in pairs) < 0.1 and abs(sum(share.values()) - (n - 1)) < 1e-9
    trees = {r.id: r.resistance for r in resistance.tree_resistance(g, stop, 400).collect()}
    assert max(abs(trees[i] - (want(i, stop) if i != stop else 0)) for i in range(n)) < 0.12


def test_negatives_and_walks(spark):
    g = edges(spark, random_pairs(7, 20, 0.3))
    nodes = count.degrees(g)
    neg = sampling.global_negatives(nodes, g, 40)
    assert neg.count() == 40 and neg.join(symmetric(g), ["src", "dst"]).count() == 0 and neg.filter("src = dst").count() == 0
    copies = sampling.permuted_negatives(nodes, g, 10, 3)
    assert copies.count() == 30 and copies.select("src", "dst").distinct().count() == 10
    scored = symmetric(g).withColumn("score", F.lit(1.0))
    assert sampling.similarity_walks(scored, nodes.select("id").limit(2), 3).count() >= 3
    full = edges(spark, combinations(range(9), 2))
    got = sampling.colour_set_estimate(full, 3, 500).first()
    assert got.hits == got.draws and abs(got.cliques - 84) < 8
    both = sampling.hybrid_clique_count(full, 3, 4, 2000).first()
    assert abs(both.cliques - 84) < 8 and 0 < both.exact < 84


def test_losses_by_hand(spark):
    rows = [(0.5, 0.2, 0.4), (2.0, -1.0, 1.5), (-0.3, 0.6, 0.2)]
    got = metrics.losses(spark.createDataFrame(rows, "pos double, neg double, weight double")).first().asDict()
    d = [(p - n, w) for p, n, w in rows]
    assert abs(got["adaptive_auc"] - sum((w - x) ** 2 for x, w in d)) < 1e-9
    assert abs(got["weighted_hinge_auc"] - sum(w * max(0, w - x) ** 2 for x, w in d)) < 1e-9
    assert abs(got["info_nce"] - sum(-np.log(np.exp(p) / (np.exp(p) + np.exp(n)) + 1e-15) for p, n, _ in rows) / 3) < 1e-9


def test_tuples(spark):
    n = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 1, 5.0)], "graph long, id long, x double")
    e = spark.createDataFrame([(0, 1, 2, 10.0)], "graph long, src long, dst long, x double")
    g = spark.createDataFrame([(0, 100.0), (1, 200.0)], "graph long, x double")
    assert {(r.graph, r.v) for r in tuples.to_globals(e, g, "x").collect()} == {(0, 10.0), (1, 0.0)}
    nodes, edges_, globals_ = tuples.block(n, e, g, lambda x, s, r, g: x + s + r + g, lambda x, v, g: x + v, lambda x, e, n: x + e + n)
    assert edges_.first().x == 113.0 and {(r.graph, r.id, r.x) for r in nodes.collect()} == {(0, 1, 1.0), (0, 2, 115.0), (1, 1, 5.0)}
    assert {(r.graph, r.x) for r in globals_.collect()} == {(0, 329.0), (1, 205.0)}
    more = tuples.concatenated((n, e), (n, e), 2)
    assert more[0].count() == 6 and more[0].agg(F.max("graph")).first()[0] == 3


def test_readers(spark, tmp_path):
    dump = lambda name, x: pickle.dump(x, open(tmp_path / f"ind.toy.{name}", "wb"))
    dump("allx", np.array([[1.0, 0.0], [0.0, 2.0], [3.0, 3.0]]))
    dump("tx", np.array([[7.0, 7.0], [8.0, 8.0]]))
    dump("ally", np.array([[1, 0], [0, 1], [0, 1]]))
    dump("ty", np.array([[1, 0], [0, 1]]))
    dump("y", np.array([[1, 0]]))
    dump("graph", {0: [1, 2], 1: [0], 2: [0, 2], 3: [4]})
    (tmp_path / "ind.toy.test.index").write_text("4\n3\n")
    toy = bundles.Citation(spark, str(tmp_path), "toy")
    assert {tuple(r) for r in toy.edges().collect()} == {(0, 1), (0, 2), (3, 4)}
    assert {r.id: r.x for r in toy.features().collect()}[4] == [7.0, 7.0] and {r.id: r.label for r in toy.labels().collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}
    assert {r.id: r.split for r in toy.splits(1).collect()} == {0: "train", 1: "valid", 2: None, 3: "test", 4: "test"}
    with pytest.raises(pickle.UnpicklingError):
        (tmp_path / "ind.toy.graph").write_bytes(pickle.dumps(print))
        toy.edges()

    (tmp_path / "e.txt").write_text("# a\n# b\n10 30\n30 20\n")
    (tmp_path / "c.txt").write_text("10 20\n30 20 10\n")
    e, c, _ = bundles.communities(spark, str(tmp_path / "e.txt"), str(tmp_path / "c.txt"), 3)
    assert {tuple(r) for r in e.collect()} == {(0, 2), (2, 1)} and [r.members for r in c.collect()] == [[2, 1, 0]]

    for part, text in (("egofeat", "1 1\n"), ("feat", "5 0 1\n6 1 0\n"), ("edges", "5 6\n5 99\n"), ("circles", "c0 5 6\nc1 5\n")):
        (tmp_path / f"9.{part}").write_text(text)
    ego = bundles.ego_network(spark, str(tmp_path), 9, 2)
    assert {tuple(r) for r in ego["edges"].collect()} == {(0, 1), (2, 0), (2, 1)} and ego["seed"].first().id == 2 and ego["circles"].count() == 1

    base = str(tmp_path / "b")
    nodes = [{"id": "a", "val": False, "test": False}, {"id": "b", "val": False, "test": False}, {"id": "c", "val": True, "test": False}, {"id": "z", "val": False, "test": False}]
    json.dump({"nodes": nodes, "links": [{"source": 0, "target": 1}, {"source": 1, "target": 2}, {"source": 2, "target": 3}]}, open(f"{base}-G.json", "w"))
    json.dump({"a": 0, "b": 1, "c": 2}, open(f"{base}-id_map.json", "w"))
    json.dump({"a": 1, "b": 2, "c": 1}, open(f"{base}-class_map.json", "w"))
    np.save(f"{base}-feats.npy", np.array([[0.0, 1.0], [2.0, 1.0], [4.0, 1.0]]))
    got = bundles.node_link_bundle(spark, base)
    assert {tuple(r) for r in got["edges"].collect()} == {(0, 1), (1, 2)} and [tuple(r) for r in got["train_edges"].collect()] == [(0, 1)]
    assert {r.id: r.x for r in got["features"].collect()} == {0: [-1.0, 0.0], 1: [1.0, 0.0], 2: [3.0, 0.0]}

    np.savez(tmp_path / "adj_full.npz", indptr=[0, 1, 2], indices=[1, 0], data=[1, 1], shape=[2, 2])
    np.savez(tmp_path / "adj_train.npz", indptr=[0, 1, 1], indices=[0], data=[1], shape=[2, 2])
    np.save(tmp_path / "feats.npy", np.array([[1.0], [3.0]]))
    json.dump({"0": 3, "1": 4}, open(tmp_path / "class_map.json", "w"))
    json.dump({"tr": [0], "va": [1], "te": []}, open(tmp_path / "role.json", "w"))
    got = bundles.sampled_graph_bundle(spark, str(tmp_path))
    assert {tuple(r) for r in got["edges"].collect()} == {(0, 1), (1, 0)} and {r.id: r.x for r in got["features"].collect()} == {0: [0.0], 1: [2.0]}
    assert {r.id: r.label for r in got["labels"].collect()} == {0: [1.0, 0.0], 1: [0.0, 1.0]}

    for kind, text in (("NODE", "1\n2\n"), ("ADJ", '{"0": [2]}\n{"0": [1]}\n'), ("DS", '{"0": 1}\n{"0": 1}\n')):
        (tmp_path / f"t#0#5#{kind}").write_text(text)
    adj, ds = bundles.temporal_sidecars(spark, str(tmp_path / "t"), 0, 5)
    assert {tuple(r) for r in adj.collect()} == {(1, 2, 0), (2, 1, 0)} and ds.count() == 2
