"""Further registered queries: counts by pivots, peeling orders, reductions, estimators, spanning trees, tuples of graphs and adjacency forms."""
from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _T3, DEG, SYM, TEMPORAL, _around, _bfs, _co, _first, _feature_edges, _rounds, _sym30, query
from .operators import community, core, count, enumerate as enum, order, partition, peel, pivot, ppr, resistance, sampling, shadow, temporal, tuples, walks, zigzag
from .operators.parts import Parts
from .plans.store import cut, kept
from .sources import bundles
from .sources import tables as src

# ---- counts by pivots -----------------------------------------------------------------------------------------------------------

_CLIQUES = f"WITH {_co()}, {_T3}, n AS (SELECT 1 AS k, count(*) AS n FROM (SELECT src FROM g UNION SELECT dst FROM g) UNION ALL SELECT 2, count(*) FROM g UNION ALL SELECT 3, count(*) FROM t3) SELECT k::BIGINT AS k, n::BIGINT AS cliques FROM n WHERE n > 0"


@query("clique_counts", _CLIQUES)
def _(spark, d):
    return pivot.clique_counts(src.co_order(spark, d), 3).select("k", F.col("cliques").cast("long").alias("cliques"))


@query("clique_counts_by_edge", _CLIQUES)
def _(spark, d):
    return pivot.clique_counts(src.co_order(spark, d), 3, "edge").select("k", F.col("cliques").cast("long").alias("cliques"))


@query("clique_counts_all")
def _(spark, d):
    return pivot.clique_counts(src.co_order(spark, d)).select("k", F.col("cliques").cast("long").alias("cliques"))


_CP = "bp AS MATERIALIZED (SELECT DISTINCT o_custkey AS u, l_partkey AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_SETS = "c1 AS (SELECT v, count(*) AS c FROM bp GROUP BY 1), c2 AS (SELECT count(*) AS c FROM bp x JOIN bp y ON x.u = y.u AND x.v < y.v GROUP BY x.v, y.v), c3 AS (SELECT count(*) AS c FROM bp x JOIN bp y ON x.u = y.u AND x.v < y.v JOIN bp z ON x.u = z.u AND y.v < z.v GROUP BY x.v, y.v, z.v), s AS (SELECT 1 AS p, c FROM c1 UNION ALL SELECT 2, c FROM c2 UNION ALL SELECT 3, c FROM c3)"
_BIC = " UNION ALL ".join(f"SELECT p::BIGINT AS p, {q}::BIGINT AS q, sum({e})::BIGINT AS bicliques FROM s WHERE c >= {q} GROUP BY p" for q, e in ((1, "c"), (2, "c * (c - 1) // 2"), (3, "c * (c - 1) * (c - 2) // 6")))


@query("biclique_counts", f"WITH {_CP}, {_SETS} {_BIC}")
def _(spark, d):
    return pivot.biclique_counts(src.customer_part(spark, d), 3, 3).withColumn("bicliques", F.col("bicliques").cast("long"))


@query("biclique_count_2_2", f"WITH {_CP}, c2 AS (SELECT count(*) AS c FROM bp x JOIN bp y ON x.u = y.u AND x.v < y.v GROUP BY x.v, y.v) SELECT coalesce(sum(c * (c - 1) // 2), 0)::BIGINT AS bicliques FROM c2")
def _(spark, d):
    return pivot.biclique_count(src.customer_part(spark, d), 2, 2).withColumn("bicliques", F.col("bicliques").cast("long"))


@query("sampled_biclique_counts")
def _(spark, d):
    return pivot.sampled_biclique_counts(src.customer_part(spark, d), 0.5, 3, 3)


@query("maximal_biclique_count")
def _(spark, d):
    return pivot.maximal_biclique_count(src.customer_part(spark, d), 3, 3)


@query("bicliques_by_vertex_2_3", f"WITH {_CP}, c2 AS (SELECT x.v AS a, y.v AS b, count(*) AS c FROM bp x JOIN bp y ON x.u = y.u AND x.v < y.v GROUP BY x.v, y.v), e AS (SELECT a AS id, c FROM c2 UNION ALL SELECT b, c FROM c2) SELECT id, sum(c * (c - 1) * (c - 2) // 6)::BIGINT AS bicliques FROM e WHERE c >= 3 GROUP BY id")
def _(spark, d):
    return count.bicliques_by_vertex(src.customer_part(spark, d), 2, 3)


@query("hybrid_clique_count")
def _(spark, d):
    return sampling.hybrid_clique_count(src.co_order(spark, d), 3, 40, 20_000)


@query("colour_set_clique_estimate")
def _(spark, d):
    return sampling.colour_set_estimate(src.co_order(spark, d, 2), 3, 20_000)


@query("biclique_estimate")
def _(spark, d):
    return sampling.biclique_estimate(src.customer_part(spark, d), 2, 2, 20_000)


# ---- orders and reductions: over the pairs of parts that two or more orders hold -------------------------------------------------


def _pairs(spark, d):
    return cut(src.co_order(spark, d, 2))


def _half(g):
    return (g.vertices() if isinstance(g, Parts) else count.degrees(g)).select("id", (F.col("id") % 2).cast("int").alias("attr"))


@query("core_order")
def _(spark, d):
    return peel.core_order(_pairs(spark, d))


@query("two_hop_core_order")
def _(spark, d):
    return peel.two_hop_core_order(src.customer_part(spark, d, 2))


@query("fairness_order")
def _(spark, d):
    g = _pairs(spark, d)
    return peel.fairness_order(g, _half(g))


@query("colourful_order")
def _(spark, d):
    g = _pairs(spark, d)
    return peel.colourful_order(g, core.colouring(g))


@query("attribute_core")
def _(spark, d):
    g = _pairs(spark, d)
    return peel.attribute_core(g, _half(g), 1)


@query("fair_reduction")
def _(spark, d):
    g = Parts(src.co_order(spark, d))
    return peel.fair_reduction(g, core.colouring(g), _half(g), 20)


@query("strong_reduction")
def _(spark, d):
    g = Parts(src.co_order(spark, d))
    return peel.strong_reduction(g, core.colouring(g), _half(g), 20)


@query("fairness_degree")
def _(spark, d):
    g = Parts(src.co_order(spark, d))
    return peel.fairness_degree(g, core.colouring(g), _half(g))


@query("eta_triangle_core")
def _(spark, d):
    g = src.co_order(spark, d).withColumn("p", F.lit(0.9) + F.pmod(F.col("src") + F.col("dst"), F.lit(10)) / 100.0)
    return peel.eta_triangle_core(g, 4, 0.7)


_ADJ = f"WITH {_co()}, {SYM}, {DEG}"


@query("csr_rows", f"{_ADJ} SELECT id, (sum(deg) OVER (ORDER BY id) - deg)::BIGINT AS first, deg::INTEGER AS n FROM d")
def _(spark, d):
    return peel.csr(src.co_order(spark, d)).select("id", "first", F.size("neighbours").alias("n"))


@query("neighbours_by_degree", f"{_ADJ}, x AS (SELECT s.src, s.dst, row_number() OVER (PARTITION BY s.src ORDER BY d.deg DESC, s.dst) AS place FROM s JOIN d ON d.id = s.dst) SELECT src AS id, (place - 1)::INTEGER AS place, dst FROM x")
def _(spark, d):
    return peel.by_descending_degree(src.co_order(spark, d)).select("id", F.posexplode("neighbours").alias("place", "dst"))


@query("bfs_tree", _rounds(f"{_co()}, {SYM}, {DEG}, r0 AS MATERIALIZED (SELECT id, 0::BIGINT AS dist FROM (SELECT id FROM d ORDER BY deg DESC, id LIMIT 1))", _bfs, 12, "SELECT x.id, coalesce(min(y.id), x.id) AS parent, x.dist FROM {r} x LEFT JOIN s ON s.dst = x.id LEFT JOIN {r} y ON y.id = s.src AND y.dist = x.dist - 1 GROUP BY x.id, x.dist"))
def _(spark, d):
    g = cut(src.co_order(spark, d))
    return core.bfs_tree(g, resistance.landmark(g)).withColumn("parent", F.coalesce("parent", "id"))


@query("connected_with_loops", f"{_ADJ} SELECT src, dst FROM s UNION ALL SELECT id, id FROM d")
def _(spark, d):
    g = src.co_order(spark, d)
    return bundles.connected_with_loops(g, count.degrees(g))


@query("symmetric_by_max", "WITH m AS (SELECT l_partkey % 500 AS row, l_suppkey AS col, max(l_quantity) AS val FROM lineitem GROUP BY 1, 2) SELECT row, col, max(val) AS val FROM (SELECT * FROM m UNION ALL SELECT col, row, val FROM m) GROUP BY row, col")
def _(spark, d):
    m = src.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("row"), F.col("l_suppkey").alias("col")).agg(F.max("l_quantity").alias("val"))
    return sampling.symmetric_by_max(m)


@query("node_mask", "SELECT p_partkey AS id, p_partkey IN (SELECT vec_id FROM embeddings) AS mask FROM part")
def _(spark, d):
    return bundles.mask(src.table(spark, d, "part").select(F.col("p_partkey").alias("id")), src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


@query("standardised_features", "WITH e AS (SELECT vec_id AS id, i - 1 AS dim, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)), t AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM e WHERE id % 2 = 0 GROUP BY dim) SELECT id, dim::INTEGER AS dim, round((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) + 0.0 AS v FROM e JOIN t USING (dim)")
def _(spark, d):
    x = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return bundles.standardised(x, x.filter("id % 2 = 0")).select("id", F.posexplode("x").alias("dim", "v")).withColumn("v", F.round("v", 5) + 0.0)


@query("relabelled_edges", f"{_ADJ}, o AS (SELECT id, (row_number() OVER (ORDER BY deg DESC, id) - 1)::BIGINT AS place FROM d) SELECT least(a.place, b.place) AS src, greatest(a.place, b.place) AS dst FROM g JOIN o a ON a.id = g.src JOIN o b ON b.id = g.dst")
def _(spark, d):
    g = src.co_order(spark, d)
    return peel.relabelled(g, order.numbered(count.degrees(g), [F.desc("deg"), F.col("id")], "place"))


# ---- many graphs: an order is a graph, its lines are edges from part to supplier ------------------------------------------------

_GR = "ed AS (SELECT l_orderkey AS graph, l_partkey AS src, -l_suppkey AS dst, l_quantity AS x FROM lineitem), nd AS (SELECT DISTINCT graph, src AS id, (src % 7)::DOUBLE AS x FROM ed UNION SELECT DISTINCT graph, dst, (dst % 7)::DOUBLE FROM ed), gl AS (SELECT o_orderkey AS graph, o_totalprice AS x FROM orders)"


def _tuples(spark, d):
    e = src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"), F.col("l_quantity").alias("x"))
    n = e.select("graph", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("x", (F.col("id") % 7).cast("double"))
    return n, e, src.table(spark, d, "orders").select(F.col("o_orderkey").alias("graph"), F.col("o_totalprice").alias("x"))


@query("globals_to_edges", f"WITH {_GR} SELECT ed.graph, src, dst, ed.x, gl.x AS g FROM ed JOIN gl USING (graph)")
def _(spark, d):
    _n, e, g = _tuples(spark, d)
    return tuples.globals_to(e, g, "x")


@query("ends_to_edges", f"WITH {_GR} SELECT ed.graph, src, dst, ed.x, a.x AS s, b.x AS r FROM ed JOIN nd a ON a.graph = ed.graph AND a.id = src JOIN nd b ON b.graph = ed.graph AND b.id = dst")
def _(spark, d):
    n, e, _g = _tuples(spark, d)
    return tuples.ends_to_edges(e, n, "x").select("graph", "src", "dst", "x", "s", "r")


@query("edges_to_globals", f"WITH {_GR} SELECT gl.graph, coalesce(sum(ed.x), 0)::DOUBLE AS v FROM gl LEFT JOIN ed USING (graph) GROUP BY gl.graph")
def _(spark, d):
    _n, e, g = _tuples(spark, d)
    return tuples.to_globals(e, g, "x")


@query("nodes_to_globals", f"WITH {_GR} SELECT gl.graph, round(coalesce(avg(nd.x), 0), 6)::DOUBLE AS v FROM gl LEFT JOIN nd USING (graph) GROUP BY gl.graph")
def _(spark, d):
    n, _e, g = _tuples(spark, d)
    return tuples.to_globals(n, g, "x", "mean").withColumn("v", F.round("v", 6))


@query("graph_block", f"WITH {_GR}, e2 AS (SELECT ed.graph, src, dst, ed.x + a.x - b.x AS x FROM ed JOIN nd a ON a.graph = ed.graph AND a.id = src JOIN nd b ON b.graph = ed.graph AND b.id = dst), r AS (SELECT graph, dst AS id, sum(x) AS v FROM e2 GROUP BY 1, 2) SELECT nd.graph, nd.id, nd.x * 2 + coalesce(v, 0) AS x FROM nd LEFT JOIN r ON r.graph = nd.graph AND r.id = nd.id")
def _(spark, d):
    n, e, g = _tuples(spark, d)
    return tuples.block(n, e, g, lambda x, s, r, g: x + s - r, lambda x, v, g: x * 2 + v, lambda x, e, n: x + e + n)[0]


@query("stacked_edges", f"WITH {_GR}, a AS (SELECT graph, id, (row_number() OVER (ORDER BY graph, id) - 1)::BIGINT AS at FROM nd) SELECT ed.graph, x.at AS src, y.at AS dst FROM ed JOIN a x ON x.graph = ed.graph AND x.id = src JOIN a y ON y.graph = ed.graph AND y.id = dst")
def _(spark, d):
    n, e, _g = _tuples(spark, d)
    return tuples.stacked(n, e)[1]


# ---- PageRank and resistance estimators -------------------------------------------------------------------------------------------


def _round6(df):
    return df.withColumn("score", F.round("score", 6))


@query("ppr_fora_forests")
def _(spark, d):
    g, first = _around(spark, d)
    return _round6(ppr.fora_with_forests(g, ppr.single_sources(first), 1e-3, 8))


@query("ppr_speed")
def _(spark, d):
    edges = kept(src.co_order(spark, d))
    g, first = _around(spark, d, edges=edges)
    return _round6(ppr.speed_ppr(g, ppr.single_sources(first), 1e-6, 500, arcs=2 * edges.count()))


@query("ppr_progressive")
def _(spark, d):
    g, first = _around(spark, d, 1)
    return _round6(ppr.progressive(g, ppr.single_sources(first), 3, 1000, power_rounds=2))


@query("ppr_backward_push")
def _(spark, d):
    g = cut(_sym30(spark, d))
    return _round6(ppr.backward_push(g, g.agg(F.min("src")).first()[0], 1e-3)[0])


@query("ppr_randomised_backward")
def _(spark, d):
    g = cut(_sym30(spark, d))
    return _round6(ppr.randomised_backward(g, g.agg(F.min("src")).first()[0], 1e-2))


@query("centrality_by_walks")
def _(spark, d):
    return _round6(ppr.centrality_by(src.symmetric(kept(src.co_order(spark, d))), "walks", per_unit=20_000))


def _ends(spark, d):
    ids = [r.id for r in _first(spark, d, 3).collect()]
    return spark.createDataFrame([(ids[0], ids[1]), (ids[1], ids[2])], "s long, t long")


@query("exact_resistance")
def _(spark, d):
    return resistance.exact_resistance(kept(src.co_order(spark, d)), _ends(spark, d), tolerance=1e-8).withColumn("resistance", F.round("resistance", 6))


@query("walk_resistance")
def _(spark, d):
    g = kept(src.co_order(spark, d))
    return resistance.walk_resistance(g, _ends(spark, d), resistance.landmark_by(g, "degree"), 500)


@query("escape_resistance")
def _(spark, d):
    return resistance.escape_resistance(kept(src.co_order(spark, d)), _ends(spark, d), 2000)


@query("spanning_edge_centrality")
def _(spark, d):
    g = kept(src.co_order(spark, d))
    return resistance.spanning_edge_centrality(g, resistance.landmark_by(g, "degree"), 8)


@query("landmark_by_trees")
def _(spark, d):
    g = kept(src.co_order(spark, d))
    return resistance.landmark_by_trees(g, resistance.landmark_by(g, "degree"), 8)


# ---- draws and negatives ----------------------------------------------------------------------------------------------------------


@query("global_negatives")
def _(spark, d):
    g = cut(src.co_order(spark, d))
    return sampling.global_negatives(count.degrees(g), g, 500)


@query("similarity_walks")
def _(spark, d):
    from .operators import matrix
    from .catalog import _vectors

    scored = matrix.edge_scores(_feature_edges(spark, d), _vectors(spark, d))
    return sampling.similarity_walks(cut(src.symmetric(scored)), scored.select(F.col("src").alias("id")).distinct(), 3)


_SLOPES = f"""WITH {TEMPORAL}, a AS (SELECT u, t, count(DISTINCT v) AS ds FROM te GROUP BY u, t), g AS (SELECT u, k FROM (SELECT DISTINCT u FROM te), range(0, 82) r(k)),
p AS MATERIALIZED (SELECT g.u, g.k, sum(coalesce(ds, 0)) OVER (PARTITION BY g.u ORDER BY g.k) AS s FROM g LEFT JOIN a ON a.u = g.u AND a.t + 1 = g.k)
SELECT u, a::INTEGER AS a, b::INTEGER AS b, slope FROM (SELECT x.u, x.k AS a, y.k AS b, (y.s - x.s) / (y.k - x.k)::DOUBLE AS slope FROM p x JOIN p y ON x.u = y.u AND x.k < y.k)
QUALIFY row_number() OVER (PARTITION BY u, b ORDER BY slope DESC, a) = 1"""


@query("slopes", _SLOPES)
def _(spark, d):
    return temporal.slopes(src.customer_supplier_months(spark, d), 81)


@query("densest_exact")
def _(spark, d):
    return enum.densest_exact(src.customer_part(spark, d, 2), 2, 1)


# ---- estimators of cliques and bicliques ------------------------------------------------------------------------------------------


@query("turan_clique_estimate")
def _(spark, d):
    g = cut(src.co_order(spark, d))
    return shadow.turan_clique_count(g, 4, 20_000).unionByName(shadow.turan_clique_count(g, 5, 20_000))


@query("zigzag_biclique_estimate")
def _(spark, d):
    g = cut(src.customer_part(spark, d))
    return zigzag.zigzag_biclique_count(g, 2, 3, 50_000).unionByName(zigzag.zigzag_biclique_count(g, 3, 3, 50_000))


@query("split_biclique_estimate")
def _(spark, d):
    return zigzag.split_biclique_counts(src.customer_part(spark, d), 3, 3, 500, 20_000)


@query("split_biclique_exact", f"WITH {_CP}, {_SETS} SELECT p::INTEGER AS p, q::INTEGER AS q, bicliques::DOUBLE AS exact, 0::DOUBLE AS sampled, 0::DOUBLE AS error, bicliques::DOUBLE AS bicliques FROM ({_BIC})")
def _(spark, d):
    return zigzag.split_biclique_counts(src.customer_part(spark, d), 3, 3, None, 0)


@query("biclique_sets_2_3", f"WITH {_CP}, c2 AS (SELECT count(*) AS c FROM bp x JOIN bp y ON x.u = y.u AND x.v < y.v GROUP BY x.v, y.v) SELECT coalesce(sum(c * (c - 1) * (c - 2) // 6), 0)::BIGINT AS bicliques FROM c2")
def _(spark, d):
    return zigzag.exact_by_sets(src.customer_part(spark, d), 2, 3)


@query("priority_biclique_estimate")
def _(spark, d):
    g = cut(src.customer_part(spark, d))
    return zigzag.priority_biclique_count(g, 2, 2, g.count() // 2)


@query("zigzag_local_edges", f"WITH {_CP} SELECT a.u, a.v, count(*)::BIGINT AS n FROM bp a JOIN bp b ON b.v = a.v AND b.u > a.u JOIN bp c ON c.u = a.u AND c.v > a.v JOIN bp e ON e.u = b.u AND e.v = c.v GROUP BY a.u, a.v")
def _(spark, d):
    return zigzag.local_edges(src.customer_part(spark, d)).groupBy("u", "v").agg(F.count("*").alias("n"))


# ---- weighted walks ---------------------------------------------------------------------------------------------------------------


@query("weighted_walk_error")
def _(spark, d):
    g, first = _around(spark, d)
    g, start = g.withColumn("w", 1.0 + F.pmod(F.col("src") + F.col("dst"), F.lit(5))), ppr.single_sources(first)
    error = ppr.compare(walks.stopping_walks(g, start, 4000, weight="w"), ppr.power_to(g, start, 1e-4, weight="w"))
    return error.select("source", (F.col("worst") < 0.03).alias("bounded"))


# ---- cores and communities by rounds ------------------------------------------------------------------------------------------------


@query("bursting_core_by_rounds")
def _(spark, d):
    return temporal.bursting_core_by_rounds(temporal.both_ways(src.customer_supplier_months(spark, d).withColumn("v", -F.col("v"))), 6, 1.5, 81)[0]


def _probs(g):
    return count.degrees(g).select("id", ((F.col("id") * 37) % 101 / 101.0).alias("prob"))


_PATH = f"""WITH {_co()}, {SYM}, {DEG}, seeds AS (SELECT id AS seed FROM d WHERE id % 50 = 0), n1 AS MATERIALIZED (SELECT seed, dst AS id FROM seeds JOIN s ON s.src = seed),
n2 AS (SELECT seed, dst AS id, min(src) AS parent FROM n1 JOIN s ON s.src = n1.id WHERE dst <> seed GROUP BY seed, dst),
c AS (SELECT seed, id, 1 AS dist, ((id * 37) % 101) / 101.0::DOUBLE AS score FROM n1
      UNION ALL SELECT n2.seed, n2.id, 2, (((n2.id * 37) % 101) / 101.0::DOUBLE + ((parent * 37) % 101) / 101.0::DOUBLE) / 2 FROM n2 LEFT JOIN n1 ON n1.seed = n2.seed AND n1.id = n2.id WHERE n1.id IS NULL)
SELECT seed, id, round(score, 6) AS score, dist::INTEGER AS steps FROM c QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, dist, id) = 1"""


@query("greedy_first_paths", _PATH)
def _(spark, d):
    g = cut(src.co_order(spark, d))
    seeds = count.degrees(g).filter("id % 50 = 0").select("id")
    probs = _probs(g).withColumn("prob", F.round("prob", 12))
    found = community.first_paths(g, seeds, probs)
    return found.select("seed", "id", F.round("score", 6).alias("score"), "steps")


@query("greedy_communities")
def _(spark, d):
    g = cut(src.co_order(spark, d))
    return community.greedy_community(g, count.degrees(g).filter("id % 200 = 0").select("id"), _probs(g), 12, 2)


# ---- partitions -------------------------------------------------------------------------------------------------------------------


@query("balanced_parts")
def _(spark, d):
    return partition.balanced_parts(src.co_order(spark, d), 8)


@query("partition_sizes", f"WITH {_co()}, {SYM}, {DEG} SELECT count(*)::BIGINT AS vertices, 8::BIGINT AS parts, true AS even FROM d")
def _(spark, d):
    parts = cut(partition.balanced_parts(src.co_order(spark, d), 8))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("vertices"), F.count("*").alias("parts"), (F.max("n") <= 1.05 * F.sum("n") / 8).alias("even"))
