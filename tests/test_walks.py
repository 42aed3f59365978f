"""Walks as rows, draws, negatives and guards against exact values."""
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.functions.hashing import spread
from meshwork.operators import ppr, resistance, sampling, walks
from meshwork.sources.tables import symmetric


def weighted(spark):
    rows = [(1, 2, 1.0), (1, 3, 3.0), (2, 1, 1.0), (2, 3, 1.0), (3, 1, 5.0), (3, 4, 1.0), (5, 1, 2.0)]  # 4 has no arcs
    return spark.createDataFrame(rows, "src long, dst long, w double")


@pytest.mark.parametrize("weight,block", [(None, 65_536), ("w", 65_536), ("w", 2)])
def test_steps_follow_the_weights(spark, weight, block):
    arcs = spark.createDataFrame([(0, k, float(k)) for k in range(1, 6)], "src long, dst long, w double")
    slots = walks.Slots(arcs, weight, block)
    assert (slots.blocks is not None) == (block == 2)
    n = 20_000
    walkers = spark.range(n).select(F.col("id").alias("walk"), F.lit(0).cast("long").alias("id"), F.lit(5).cast("long").alias("n"))
    got = {r.id: r["count"] / n for r in slots.step(walkers, "walk", 1).groupBy("id").count().collect()}
    want = {k: (k / 15 if weight else 0.2) for k in range(1, 6)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.015 for k in want)


def test_weighted_walks_equal_the_power_rounds(spark):
    df = weighted(spark)
    start = spark.createDataFrame([(1, 1, 0.5), (1, 5, 0.5), (9, 3, 1.0)], "source long, id long, r double")
    got = walks.stopping_walks(df, start, 20_000, weight="w")
    for r in ppr.compare(got, ppr.power_to(df, start, 1e-6, weight="w")).collect():
        assert r.worst < 0.015
    assert abs(got.filter("source = 9").agg(F.sum("score")).first()[0] - 1) < 1e-9


def test_negative_units(spark):
    df = weighted(spark).select("src", "dst")
    plus = {r.id: r.score for r in ppr.walks(df, spark.createDataFrame([(1, 1, 1.0)], "source long, id long, r double"), 500).collect()}
    minus = {r.id: r.score for r in ppr.walks(df, spark.createDataFrame([(1, 1, -1.0)], "source long, id long, r double"), 500).collect()}
    assert plus and minus == {k: -v for k, v in plus.items()}


def test_fixed_walks_follow_arcs(spark):
    df = symmetric(spark.createDataFrame([(a, b) for a, b in combinations(range(8), 2) if (a + b) % 3], "src long, dst long"))
    arcs = {(r.src, r.dst) for r in df.collect()}
    rows = {(r.root, r.step): r.id for r in sampling.walk_nodes(df, spark.range(8), 12).collect()}
    assert len(rows) == 8 * 13 and all(rows[k, 0] == k for k in range(8))
    assert all((rows[k, i], rows[k, i + 1]) in arcs for k in range(8) for i in range(12))
    assert sampling.walk_nodes(df, spark.range(8).limit(0), 3).count() == 0


def test_salts_give_other_draws(spark):
    df = spark.range(4000).select(*(spread("id", s).alias(f"s{s}") for s in (0, 1, 2, 3)))
    x = np.array([list(r) for r in df.collect()])
    assert (x >= 0).all() and (x < 1).all() and np.abs(x.mean(axis=0) - 0.5).max() < 0.02
    off = np.corrcoef(x.T) - np.eye(4)
    assert np.abs(off).max() < 0.06
    gap = np.mod(x[:, 1:] - x[:, :1], 1)
    assert (gap.std(axis=0) > 0.2).all()  # no salt is a shift of another


@pytest.mark.parametrize("n_nodes,share,n", [(40, 0.985, 24), (40, 0.985, 10), (12, 0.3, 60), (30, 0.2, 40), (6, 0.5, 200)])
def test_negatives_repeat_only_when_all_are_used(spark, n_nodes, share, n):
    rng = np.random.default_rng(n_nodes)
    pairs = [(a, b) for a, b in combinations(range(n_nodes), 2) if rng.random() < share]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    rest = {(a, b) for a in range(n_nodes) for b in range(n_nodes) if a != b} - set(pairs) - {(b, a) for a, b in pairs}
    got = sampling.global_negatives(spark.range(n_nodes), edges, n).collect()
    used = Counter((r.src, r.dst) for r in got)
    assert sorted(r.k for r in got) == list(range(n)) and set(used) <= rest
    assert len(used) == min(n, len(rest)) and max(used.values()) - min(used.values()) <= (n > len(rest))


def test_no_negatives_of_a_complete_graph(spark):
    edges = spark.createDataFrame(list(combinations(range(5), 2)), "src long, dst long")
    assert sampling.global_negatives(spark.range(5), edges, 3).count() == 0


def test_other_components_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8)], "src long, dst long")
    trees = {(r.src, r.dst): r.share for r in resistance.spanning_edge_centrality(edges, 1, 20).collect()}
    assert trees[7, 8] == 0 and abs(sum(trees.values()) - 2) < 1e-9
    assert {r.id for r in resistance.landmark_by_trees(edges, 1, 5).collect()} == {1, 2, 3}
    pairs = spark.createDataFrame([(1, 7), (1, 2)], "s long, t long")
    got = {(r.s, r.t): r.resistance for r in resistance.escape_resistance(edges, pairs, 3000).collect()}
    assert got[1, 7] == float("inf") and abs(got[1, 2] - 2 / 3) < 0.05
    with pytest.raises(Exception, match="different components"):
        resistance.walk_resistance(edges, pairs, 1, 10).collect()
