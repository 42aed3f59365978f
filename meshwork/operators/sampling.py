"""Samplers and estimators whose draws are hashes of keys, so that they repeat whatever the partitions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import edge_key, spread, uniform
from ..plans.store import cut, kept
from ..sources.tables import symmetric
from .core import colouring
from .count import cliques_by_vertex, degrees
from .order import numbered, running


def nodes(df: DataFrame, share: float, salt: int = 0) -> DataFrame:
    """About that share of the rows of df(id, ...)."""
    return df.filter(spread("id", salt) < share)


def sampled_edges(edges: DataFrame, share: float, salt: int = 0) -> DataFrame:
    key = edges.withColumn("_k", edge_key())
    return key.filter(spread("_k", salt) < share).drop("_k")


def query_nodes(edges: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """n ids with an out-edge, by least hash."""
    return edges.select(F.col("src").alias("id")).distinct().orderBy(spread("id", salt), "id").limit(n)


def random_graph(spark, n: int, p: float, seed: int = 0) -> DataFrame:
    """An Erdos-Renyi graph: each pair src < dst with probability p.  A vertex jumps from one of its pairs to the next by geometric gaps, so the work is the edges', not the pairs'."""
    import math

    import pandas as pd

    def draw(batches):
        import random

        for pdf in batches:
            src, dst = [], []
            for v in pdf["id"].tolist():
                rng, at = random.Random(f"{seed}:{v}"), v
                while p > 0:
                    at += 1 if p >= 1 else 1 + int(math.log(1.0 - rng.random()) / math.log(1.0 - p))
                    if at >= n:
                        break
                    src.append(v)
                    dst.append(at)
                if len(src) >= 100_000:
                    yield pd.DataFrame({"src": src, "dst": dst})
                    src, dst = [], []
            yield pd.DataFrame({"src": pd.Series(src, dtype="int64"), "dst": pd.Series(dst, dtype="int64")})

    return spark.range(n).mapInPandas(draw, "src long, dst long")


def degree_distribution(edges: DataFrame, alpha: float) -> DataFrame:
    """id, prob proportional to degree ^ alpha."""
    d = degrees(edges).withColumn("w", F.pow(F.col("deg").cast("double"), F.lit(float(alpha))))
    return d.crossJoin(F.broadcast(d.agg(F.sum("w").alias("t")))).select("id", (F.col("w") / F.col("t")).alias("prob"))


def weighted_without_replacement(probs: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """n ids of probs(id, prob), by the least exponential clock -ln(u) / prob."""
    return probs.filter("prob > 0").orderBy(-F.ln(spread("id", salt) + 1e-12) / F.col("prob"), "id").limit(n).select("id")


def edges_by_degree(edges: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """n distinct edges, each equally likely, by least hash."""
    key = edges.withColumn("_k", edge_key())
    return key.orderBy(spread("_k", salt), "src", "dst").limit(n).drop("_k")


def local_negatives(edges: DataFrame, nodes_: DataFrame, per_edge: int = 1, salt: int = 0) -> DataFrame:
    """src, dst, k: for each edge, per_edge other ends drawn by rank among nodes(id), those kept that are no edge and no loop."""
    ranked = numbered(nodes_.select("id").distinct(), "id", "at")
    n = F.broadcast(ranked.agg(F.count("*").alias("n")))
    draws = edges.select("src", "dst").crossJoin(n).select("src", edge_key().alias("key"), "n", F.explode(F.sequence(F.lit(1), F.lit(per_edge))).alias("k"))
    at = F.floor(spread("key", salt) * F.col("n") + F.col("k") * 7919) % F.col("n")
    drawn = draws.withColumn("at", at.cast("long")).join(ranked, "at").select("src", F.col("id").alias("dst"), "k").filter("src <> dst")
    return drawn.join(symmetric(edges.select("src", "dst")), ["src", "dst"], "left_anti").distinct()


def saint_norms(edges: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge and node norms from samples(sample, id): edge = node count / edge count (0.1 where never seen, at most 10,000), node = samples / count / nodes."""
    count = samples.groupBy("id").agg(F.countDistinct("sample").alias("c"))
    both = edges.join(samples.select("sample", F.col("id").alias("src")), "src").join(samples.select("sample", F.col("id").alias("dst")), ["sample", "dst"])
    seen = both.groupBy("src", "dst").agg(F.countDistinct("sample").alias("e"))
    norm = F.when(F.col("e").isNull(), 0.1).otherwise(F.least(F.col("c") / F.col("e"), F.lit(1e4)))
    edge = edges.join(seen, ["src", "dst"], "left").join(count.withColumnRenamed("id", "dst"), "dst", "left").select("src", "dst", norm.alias("norm"))
    total = samples.agg(F.countDistinct("sample").alias("s"), F.countDistinct("id").alias("n"))
    node = count.crossJoin(F.broadcast(total)).select("id", (F.col("s") / F.col("c") / F.col("n")).alias("norm"))
    return edge, node


def fan_out(edges: DataFrame, seeds: DataFrame, most: int, salt: int = 0) -> DataFrame:
    """seed, dst: at most so many neighbours of each of seeds(id), by least hash."""
    key = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").withColumn("_k", edge_key())
    place = F.row_number().over(Window.partitionBy("src").orderBy(spread("_k", salt), "dst"))
    return key.withColumn("place", place).filter(F.col("place") <= most).select(F.col("src").alias("seed"), "dst")


def walk_nodes(edges: DataFrame, roots: DataFrame, length: int, salt: int = 0) -> DataFrame:
    """root, step, id: one hash-driven walk from each of roots(id), by numbered arcs; a walk that cannot go on stays."""
    from .walks import fixed_walks

    return fixed_walks(edges, roots, length, salt=salt)


def oversample(df: DataFrame, label: str, share: float) -> DataFrame:
    """df with rows of rare classes repeated until each class has at least share times the largest; copy says which repeat a row is."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    want = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("most")))).select(label, F.greatest(F.lit(1), F.ceil(F.col("most") * share / F.col("n"))).cast("int").alias("times"))
    return df.join(F.broadcast(want), label).select("*", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("times")


def sampled_clique_count(edges: DataFrame, k: int, share: float, salt: int = 0) -> DataFrame:
    """cliques: an estimate from the cliques of a vertex sample, each weighed by 1 / share over its k vertices."""
    found = cliques_by_vertex(edges, k)
    return nodes(found, share, salt).agg((F.coalesce(F.sum("cliques"), F.lit(0)) / (share * k)).alias("cliques"))


def ordered_by_colour(edges: DataFrame) -> DataFrame:
    """src, dst of each edge from its end of lesser colour to the other, so the vertices of a path all differ in colour."""
    colours = colouring(edges)
    ends = edges.join(colours.withColumnsRenamed({"id": "src", "colour": "a"}), "src").join(colours.withColumnsRenamed({"id": "dst", "colour": "b"}), "dst")
    up = F.col("a") < F.col("b")
    return ends.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def path_weights(arcs: DataFrame, k: int) -> DataFrame:
    """id, left, paths: the number of paths of left vertices (1 to k) along the arcs of an acyclic orientation that begin at id; those without any are left out."""
    now = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.lit(1.0).alias("paths"))
    every = now.withColumn("left", F.lit(1))
    for left in range(2, k + 1):
        now = cut(arcs.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("paths").alias("paths")))
        every = every.unionByName(now.withColumn("left", F.lit(left)))
    return every.select("id", "left", "paths")


def path_clique_count(arcs: DataFrame, k: int, samples: int, salt: int = 0, starts: DataFrame | None = None) -> DataFrame:
    """draws, hits, paths, cliques: an unbiased estimate of the k-cliques from about so many paths of k vertices, each path equally likely.

    A clique is one path of an acyclic orientation.  A vertex gets its share of the draws (rounded by a hash, so no global order of the
    vertices is needed), each step goes to a neighbour in proportion to the paths that it begins, and a draw ends at the first vertex
    that is not joined to all before it.  starts(id): only the paths, and so the cliques, that begin at these vertices.
    """
    arcs = cut(arcs.select("src", "dst"))
    weights = cut(path_weights(arcs, k))
    first = weights.filter(F.col("left") == k)
    first = first if starts is None else first.join(starts.select("id"), "id", "left_semi")
    total = first.agg(F.coalesce(F.sum("paths"), F.lit(0.0))).first()[0]
    share = F.col("paths") * (samples / total if total else 0.0)
    begun = first.select("id", F.floor(share + uniform("id", salt)).cast("int").alias("n")).filter("n > 0")
    now = begun.select(F.col("id").alias("v1"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("draw"))
    now = cut(now.withColumn("draw", F.xxhash64("v1", "draw")))
    draws = now.count()
    for i in range(2, k + 1):
        ahead = weights.filter(F.col("left") == k - i + 1).select(F.col("id").alias("dst"), "paths")
        steps = now.join(arcs.join(ahead, "dst"), F.col(f"v{i - 1}") == F.col("src")).drop("src")
        steps = steps.withColumn("_k", F.xxhash64("draw", "dst", F.lit(i)))
        clock = -F.ln(uniform("_k", salt) + 1e-300) / F.col("paths")
        kept = [f"v{j}" for j in range(1, i)]
        now = steps.groupBy("draw", *kept).agg(F.min_by("dst", F.struct(clock.alias("clock"), F.col("dst").alias("d"))).alias(f"v{i}"))
        for j in range(1, i - 1):
            now = now.join(arcs.select(F.col("src").alias(f"v{j}"), F.col("dst").alias(f"v{i}")), [f"v{j}", f"v{i}"], "left_semi")
    hits = F.count("*").cast("long")
    return now.agg(F.lit(draws).cast("long").alias("draws"), hits.alias("hits"), F.lit(float(total)).alias("paths"), (hits * (total / samples)).alias("cliques"))


def nth_greatest(values: DataFrame, n: int, most: int = 100_000) -> float:
    """The n-th greatest x of values(x), exactly: counts about approximate percentiles narrow the range until few enough rows are left to be sorted.  values is read in each round."""
    x = F.col("x")
    inside, ahead, m = values, 0, values.count()
    while m > most:
        share = 1 - (n - ahead - 0.5) / m
        marks = sorted(set(inside.agg(F.percentile_approx("x", [max(0.0, share - 0.001), share, min(1.0, share + 0.001)], 10_000)).first()[0]), reverse=True)
        counts = inside.agg(*(F.sum((x > v).cast("long")) for v in marks), *(F.sum((x == v).cast("long")) for v in marks)).first()
        high = None
        for v, above, equal in zip(marks, counts, counts[len(marks) :], strict=False):
            if ahead + above >= n:  # between two marks, or beyond the first
                break
            if ahead + above + equal >= n:
                return v
            high = v, above + equal
        else:
            v, above = None, m
        inside = inside.filter(x > v) if v is not None else inside
        if high:
            inside, ahead, above = inside.filter(x < high[0]), ahead + high[1], above - high[1]
        m = above
    return inside.orderBy(F.desc("x")).limit(n - ahead).agg(F.min("x")).first()[0]


def priority_edges(weighted: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """src, dst, w, prob of the n edges with the highest w / u; prob = min(1, w / z) for the (n + 1)-th priority z, so sums of w / prob are unbiased."""
    keyed = kept(weighted.withColumn("_k", edge_key()).withColumn("priority", F.col("w") / (spread("_k", salt) + 1e-12)).drop("_k"))
    if keyed.count() <= n:
        return keyed.select("src", "dst", "w", F.lit(1.0).alias("prob"))
    z = nth_greatest(keyed.select(F.col("priority").alias("x")), n + 1)
    return keyed.filter(F.col("priority") > F.lit(z)).select("src", "dst", "w", F.least(F.lit(1.0), F.col("w") / F.lit(z)).alias("prob"))


def unigram_table(edges: DataFrame, power: float = 0.75) -> DataFrame:
    """id, low, high: each vertex's interval of [0, 1) in proportion to degree ^ power; a draw is a range lookup."""
    d = degree_distribution(edges, power)
    return running(d, "id", "prob", "high").select("id", (F.col("high") - F.col("prob")).alias("low"), "high")


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """id, part: each vertex takes its neighbours' most frequent part (least on ties), so many rounds: a partition without a global cut solver."""
    both = symmetric(edges)
    now = both.select(F.col("src").alias("id")).distinct().withColumn("part", F.col("id"))
    for _ in range(rounds):
        votes = both.join(now.withColumnRenamed("id", "dst"), "dst").groupBy("src", "part").agg(F.count("*").alias("n"))
        now = votes.groupBy(F.col("src").alias("id")).agg(F.min_by("part", F.struct((-F.col("n")).alias("n"), F.col("part").alias("x"))).alias("part"))
    return now


def coarsen(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """src, dst, w: the number of edges between parts(id, part), src < dst."""
    both = edges.join(parts.select(F.col("id").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("b")), "dst").filter("a <> b")
    return both.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").alias("w"))


def global_negatives(nodes_: DataFrame, edges: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """k, src, dst: n pairs of nodes(id) that are no edge (in either direction) and no loop; pairs repeat only once all are used.

    Pairs are drawn by rank from hashes until there are enough.  Where three of four pairs are edges, or half of the others are asked for, all are listed, which is
    linear in the edges or in n.
    """
    spark = nodes_.sparkSession
    ranked = cut(numbered(nodes_.select("id").distinct(), "id", "at"))
    size, both = ranked.count(), cut(symmetric(edges.select("src", "dst")).filter("src <> dst").distinct())
    known = both.join(ranked.select(F.col("id").alias("src")), "src", "left_semi").join(ranked.select(F.col("id").alias("dst")), "dst", "left_semi").count()
    pairs = size * (size - 1)
    total = pairs - known

    def no_edges(ranks: DataFrame) -> DataFrame:
        """k, src, dst of the ranks (k, a, b) that are no edge, each pair once."""
        named = ranks.join(ranked.withColumnsRenamed({"at": "a", "id": "src"}), "a").join(ranked.withColumnsRenamed({"at": "b", "id": "dst"}), "b").filter("src <> dst")
        return named.join(both, ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("k").alias("k"))

    if total <= 0 or n <= 0:
        return spark.createDataFrame([], "k long, src long, dst long")
    if total * 4 < pairs or n * 2 > total:
        every = spark.range(pairs).select(F.expr(f"id div {size - 1}").alias("a"), (F.col("id") % (size - 1)).alias("b"), F.xxhash64("id", F.lit(salt)).alias("k"))
        found = no_edges(every.withColumn("b", F.col("b") + (F.col("b") >= F.col("a")).cast("long")))
    else:
        found, have, k = None, 0, 0
        while have < n:  # a draw is no edge with a chance of a quarter at least, and new with one of a half
            draws = spark.range(k * 2 * n, (k + 1) * 2 * n).withColumnRenamed("id", "k")
            fresh = no_edges(draws.select("k", *(F.floor(uniform("k", 2 * salt + i) * size).cast("long").alias(name) for i, name in enumerate("ab"))))
            found = cut(fresh if found is None else found.unionByName(fresh).groupBy("src", "dst").agg(F.min("k").alias("k")))
            have, k = found.count(), k + 1
    kept = cut(numbered(found, ["k", "src", "dst"], "place").filter(F.col("place") < n))
    if total >= n:
        return kept.select(F.col("place").alias("k"), "src", "dst")
    wanted = spark.range(n).withColumnRenamed("id", "k").withColumn("place", F.col("k") % total)
    return wanted.join(kept, "place").select(wanted["k"], "src", "dst")


def permuted_negatives(nodes_: DataFrame, edges: DataFrame, n: int, copies: int, salt: int = 0) -> DataFrame:
    """k, copy, src, dst: one set of n negative pairs, and copies of it in other orders."""
    base = cut(global_negatives(nodes_, edges, n, salt))
    out = base.select("k", F.lit(0).alias("copy"), "src", "dst")
    for c in range(1, copies):
        shuffled = numbered(base.withColumn("h", F.xxhash64("k", F.lit(salt), F.lit(c))), ["h", "k"], "to")
        out = out.unionByName(shuffled.select(F.col("to").alias("k"), F.lit(c).alias("copy"), "src", "dst"))
    return out


def labelled_pairs(splits: DataFrame, negatives: DataFrame, split: str) -> DataFrame:
    """src, dst, label: the edges of one split(src, dst, split) with 1 and negatives(src, dst) with 0."""
    return splits.filter(F.col("split") == split).select("src", "dst", F.lit(1).alias("label")).unionByName(negatives.select("src", "dst", F.lit(0).alias("label")))


def ranked_pairs(positives: DataFrame) -> DataFrame:
    """src, dst, label of positives(src, dst, negatives array): each row's edge, and its source with each of its negative ends."""
    return positives.select("src", "dst", F.lit(1).alias("label")).unionByName(positives.select("src", F.explode("negatives").alias("dst"), F.lit(0).alias("label")))


def similarity_step(similar: DataFrame, at: DataFrame, temperature: float = 1.0, salt: int = 0) -> DataFrame:
    """walk, id: for each of at(walk, id) a neighbour from similar(src, dst, score) with the probability of the softmax of score / temperature, by the greatest of score plus Gumbel noise."""
    options = at.join(similar, F.col("id") == F.col("src")).withColumn("_k", F.xxhash64("walk", "dst"))
    noisy = F.col("score") / temperature - F.ln(-F.ln(uniform("_k", salt) + 1e-300))
    return options.groupBy("walk").agg(F.max_by("dst", F.struct(noisy.alias("v"), F.col("dst").alias("d"))).alias("id"))


def similarity_walks(similar: DataFrame, roots: DataFrame, length: int, temperature: float = 1.0, salt: int = 0) -> DataFrame:
    """id: the vertices that walks of so many similarity steps from each of roots(id) meet, once."""
    now = roots.select(F.col("id").alias("walk"), "id")
    every = now.select("id")
    for i in range(length):
        now = cut(similarity_step(similar, now, temperature, salt + i))
        every = every.unionByName(now.select("id"))
    return every.distinct()


def community_seeds(communities: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """community, seed: n communities(community, members) by least hash, and in each the member of least hash."""
    picked = communities.orderBy(spread("community", salt), "community").limit(n).select("community", F.explode("members").alias("id"))
    return picked.groupBy("community").agg(F.min_by("id", F.struct(F.xxhash64("id", F.lit(salt)), "id")).alias("seed"))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """The ids of a that b lacks."""
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def symmetric_by_max(m: DataFrame) -> DataFrame:
    """row, col, val: the greater of an entry and its mirror."""
    both = m.select("row", "col", "val").unionByName(m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))
    return both.groupBy("row", "col").agg(F.max("val").alias("val"))


def colour_set_estimate(edges: DataFrame, k: int, samples: int, salt: int = 0) -> DataFrame:
    """draws, hits, weight, cliques: k-cliques estimated from sets of k vertices of different colours in one vertex's later neighbourhood.

    A seed's neighbours are grouped by colour; the number of sets of k - 1 colours with one vertex of each is a polynomial in the group sizes, whose coefficients choose the colours of a
    draw backwards.  A seed gets its share of the draws, and a draw counts if its vertices are pairwise adjacent.
    """
    import pandas as pd

    colours = colouring(edges)
    out = cut(ordered_by_colour(edges))
    near = out.join(colours.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("seed")).agg(F.array_sort(F.collect_list(F.struct("colour", "dst"))).alias("near"))

    def sets(groups: list[int]):
        """table[i][j]: the ways to take j vertices of different colours from the first i groups."""
        table = [[1.0] + [0.0] * (k - 1)]
        for g in groups:
            last = table[-1]
            table.append([last[j] + (last[j - 1] * g if j else 0.0) for j in range(k)])
        return table

    def grouped(near_):
        by: dict = {}
        for x in near_:
            by.setdefault(x["colour"], []).append(x["dst"])
        return list(by.values())

    def weigh(batches):
        for pdf in batches:
            yield pd.DataFrame({"seed": pdf["seed"], "weight": [sets([len(g) for g in grouped(x)])[-1][k - 1] for x in pdf["near"]]})

    weights = cut(near.mapInPandas(weigh, "seed long, weight double").filter("weight > 0"))
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    share = F.floor(F.col("weight") * (samples / total if total else 0.0) + uniform("seed", salt)).cast("int")

    def draw(batches):
        import random

        for pdf in batches:
            rows = []
            for seed, near_, n in pdf[["seed", "near", "n"]].itertuples(index=False):
                groups, rng = grouped(near_), random.Random(f"{salt}:{seed}")
                table = sets([len(g) for g in groups])
                for d in range(n):
                    j, taken = k - 1, []
                    for i in range(len(groups), 0, -1):
                        if not j:
                            break
                        if rng.random() * table[i][j] >= table[i - 1][j]:
                            taken.append(int(rng.choice(groups[i - 1])))
                            j -= 1
                    rows.append((int(seed), d, taken))
            yield pd.DataFrame(rows, columns=["seed", "draw", "taken"])

    drawn = cut(near.join(weights.withColumn("n", share).filter("n > 0"), "seed").mapInPandas(draw, "seed long, draw int, taken array<long>"))
    draws = drawn.count()
    pairs = drawn.select("seed", "draw", F.posexplode("taken").alias("i", "a"), "taken").select("seed", "draw", "i", "a", F.posexplode("taken").alias("j", "b")).filter("i < j")
    known = cut(symmetric(edges.select("src", "dst")).withColumnsRenamed({"src": "a", "dst": "b"}))
    missing = pairs.join(known, ["a", "b"], "left_anti").select("seed", "draw").distinct()
    hits = drawn.join(missing, ["seed", "draw"], "left_anti").count()
    return edges.sparkSession.createDataFrame([(draws, hits, float(total), hits * total / samples if samples else 0.0)], "draws long, hits long, weight double, cliques double")


def biclique_estimate(bip: DataFrame, p: int, q: int, samples: int, salt: int = 0) -> DataFrame:
    """draws, hits, weight, bicliques: (p, q)-bicliques (p of side v, q of side u) estimated from edges as strata.

    The edge (u, v) stands for the bicliques whose least u and least v it is: q - 1 of the later u that v has and p - 1 of the later v that u has, so C x C sets.
    Edges get their share of the draws, and a draw counts if all its pairs are edges.
    """
    import pandas as pd

    from .count import choose

    lists_u = bip.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    lists_v = bip.groupBy("v").agg(F.array_sort(F.collect_list("u")).alias("us"))
    later = bip.join(lists_u, "u").join(lists_v, "v").select("u", "v", F.filter("us", lambda x: x > F.col("u")).alias("us"), F.filter("vs", lambda x: x > F.col("v")).alias("vs"))
    later = later.withColumns({"nu": F.size("us").cast("long"), "nv": F.size("vs").cast("long")})
    weighed = cut(later.withColumn("weight", choose("nu", q - 1).cast("double") * choose("nv", p - 1).cast("double")).filter("weight > 0"))
    total = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    key = weighed.withColumn("_k", edge_key("u", "v"))
    n = F.floor(F.col("weight") * (samples / total if total else 0.0) + uniform("_k", salt)).cast("int")

    def draw(batches):
        import random

        for pdf in batches:
            rows = []
            for u, v, us, vs, n in pdf[["u", "v", "us", "vs", "n"]].itertuples(index=False):
                rng = random.Random(f"{salt}:{u}:{v}")
                rows += [(int(u), int(v), d, [int(x) for x in rng.sample(list(us), q - 1)], [int(x) for x in rng.sample(list(vs), p - 1)]) for d in range(n)]
            yield pd.DataFrame(rows, columns=["u", "v", "draw", "xs", "ys"])

    drawn = cut(key.withColumn("n", n).filter("n > 0").mapInPandas(draw, "u long, v long, draw int, xs array<long>, ys array<long>"))
    draws = drawn.count()
    pairs = drawn.select("u", "v", "draw", F.explode("xs").alias("a"), "ys").select("u", "v", "draw", "a", F.explode("ys").alias("b"))
    missing = pairs.join(bip.withColumnsRenamed({"u": "a", "v": "b"}), ["a", "b"], "left_anti").select("u", "v", "draw").distinct()
    hits = drawn.join(missing, ["u", "v", "draw"], "left_anti").count()
    return bip.sparkSession.createDataFrame([(draws, hits, float(total), hits * total / samples if samples else 0.0)], "draws long, hits long, weight double, bicliques double")


def hybrid_clique_count(edges: DataFrame, k: int, bar: int, samples: int, salt: int = 0) -> DataFrame:
    """exact, sampled, cliques: k-cliques of the vertices with at most ``bar`` later neighbours exactly, by pivots; those of the others from paths."""
    from .count import oriented
    from .pivot import clique_counts_of

    arcs = cut(oriented(edges.select("src", "dst")))
    sizes = arcs.groupBy("src").agg(F.count("*").alias("n"))
    light = cut(sizes.filter(F.col("n") <= bar).select("src"))
    exact = clique_counts_of(arcs, light, k).filter(F.col("k") == k).agg(F.coalesce(F.sum("cliques"), F.lit(0)).cast("double")).first()[0]
    sampled = path_clique_count(arcs, k, samples, salt, starts=sizes.filter(F.col("n") > bar).select(F.col("src").alias("id"))).first()["cliques"]
    return edges.sparkSession.createDataFrame([(exact, sampled, exact + sampled)], "exact double, sampled double, cliques double")
