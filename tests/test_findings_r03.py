"""Findings of the third round: each of these failed before its fix."""
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from meshwork.operators import cells, community, peel, sampling, walks

RNG = random.Random(11)


def tables(spark, folder, **rows):
    """A folder of Parquet tables from (rows, schema)."""
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(name, folder):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        try:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        except duckdb.IOException:
            pass
    return con.sql(__spark_entry__.oracle_sql()[name]).fetchall()


def test_core_numbers_stop_where_the_sql_stops(spark, tmp_path):
    path = [(k, p) for k in range(150) for p in (k, k + 1)]  # values fall by one vertex a round from each end
    d = tables(spark, tmp_path, lineitem=(path, "l_orderkey long, l_partkey long"))
    got = sorted(map(tuple, __spark_entry__.queries()["core_numbers"](spark, d).collect()))
    assert got == sorted(by_sql("core_numbers", tmp_path)) and {c for _, c in got} == {1, 2}


def test_first_paths_are_those_of_all_paths(spark):
    pairs = sorted({tuple(sorted(RNG.sample(range(70), 2))) for _ in range(110)})
    g, seeds = spark.createDataFrame(pairs, "src long, dst long"), spark.range(0, 70, 3)
    ids = sorted({x for p in pairs for x in p})
    probs = spark.createDataFrame([(i, round(i * 37 % 11 / 11.0, 12)) for i in ids], "id long, prob double")  # many ties
    want = community.best_paths(community.bfs_paths(g, seeds, 2), probs, seeds.select(F.col("id").alias("seed"), "id"))
    frame = community.first_paths(g, seeds, probs)
    got = sorted(map(tuple, frame.collect()))
    assert got == sorted(map(tuple, want.collect())) and {r[3] for r in got} == {1, 2}
    # a star whose hub is likeliest: the leaves' pairs, a row for each in the form before, are not made
    star = spark.createDataFrame([(0, k) for k in range(1, 400)], "src long, dst long")
    hub = spark.createDataFrame([(k, 1.0 if k == 0 else 0.5) for k in range(400)], "id long, prob double")
    leaves = spark.range(1, 400)
    found = community.first_paths(star, leaves, hub)
    assert {(r.seed, r.id, r.score, r.steps) for r in found.collect()} == {(k, 0, 1.0, 1) for k in range(1, 400)}


def eta_core_plainly(p, k, eta):
    p = {e: x for e, x in p.items() if x >= eta}
    while True:
        of = lambda a, b: p.get((min(a, b), max(a, b)), 0.0)
        ids = {x for e in p for x in e}
        stays = {}
        for (a, b), x in p.items():
            top = sorted((w for c in ids - {a, b} if (w := of(a, c) * of(b, c)) >= eta - 1e-16), reverse=True)[: k - 2]
            if len(top) == k - 2 and x * np.prod(top) >= eta - 1e-12:
                stays[a, b] = x
        if len(stays) == len(p):
            return set(p)
        p = stays


def test_eta_triangles_are_never_shuffled(spark, monkeypatch):
    pairs = sorted({tuple(sorted(RNG.sample(range(24), 2))) for _ in range(170)})
    p = {e: 0.9 + (e[0] * 7 + e[1]) % 10 / 100 for e in pairs}
    g = spark.createDataFrame([(*e[:: RNG.choice((1, -1))], x) for e, x in p.items()], "src long, dst long, p double")
    given = {(r.src, r.dst) for r in g.collect()}
    for k, eta in ((3, 0.8), (4, 0.8), (5, 0.72), (4, 0.85)):
        kept = [(r.src, r.dst) for r in peel.eta_triangle_core(g, k, eta).collect()]
        assert set(kept) <= given and {tuple(sorted(e)) for e in kept} == eta_core_plainly(p, k, eta)
    arcs = spark.createDataFrame([(a, b, 0.9) for a in range(30) for b in range(a + 1, 30)], "src long, dst long, p double")
    assert cells.triangle_products(arcs, 2, 0.5).count() == 435 * 2  # of 4,060 triangles
    many = cells.triangle_products(arcs, 2, 0.5, cells.dealing(arcs, 100))  # several cells
    assert many.select("src", "dst").distinct().count() == 435


def test_priority_threshold_is_exact_without_one_sort(spark):
    for values in ([RNG.random() ** -1 for _ in range(3000)], [float(RNG.randrange(4)) for _ in range(3000)], [1.0] * 1500 + [2.0] * 1500):
        df, want = spark.createDataFrame([(v,) for v in values], "x double"), sorted(values, reverse=True)
        for n in (1, 2, 1499, 1500, 1501, 2999, 3000):
            assert sampling.nth_greatest(df, n, most=20) == want[n - 1]
    w = spark.range(500).select(F.col("id").alias("src"), F.lit(1).cast("long").alias("dst"), (F.col("id") + 1).cast("double").alias("w"))
    chosen = sampling.priority_edges(w, 40)
    assert chosen.count() == 40 and "TakeOrdered" not in chosen._jdf.queryExecution().executedPlan().toString() and sampling.priority_edges(w, 500).filter("prob < 1").isEmpty()


def test_few_walks_number_few_arcs(spark, monkeypatch):
    g = spark.createDataFrame([(a, b) for a in range(40) for b in range(40) if a != b and (a * b + a) % 3 and a % 13], "src long, dst long")
    roots = spark.range(0, 40, 4)
    numbered = []
    monkeypatch.setattr(walks, "numbered", lambda rows, by, name, of=walks.numbered: numbered.append(rows.count()) or of(rows, by, name))
    few = sorted(map(tuple, sampling.walk_nodes(g, roots, 3).collect()))
    assert len(numbered) == 3 and max(numbered) < g.count() / 2
    monkeypatch.setattr(walks, "BROADCAST_ROWS", -1)
    assert few == sorted(map(tuple, sampling.walk_nodes(g, roots, 3).collect()))
