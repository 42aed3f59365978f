"""Normalised adjacency matrices as rows (row, col, val), propagation, and functions along edges."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("laplacian", "norm_laplacian", "first_order", "aug_sym", "sym", "rw_laplacian", "aug_rw", "rw", "none", "low_pass")


def _sums(m: DataFrame) -> DataFrame:
    return m.groupBy(F.col("row").alias("i")).agg(F.sum("val").alias("s"))


def _scaled(m: DataFrame, left: float, right: float) -> DataFrame:
    """D^left M D^right; 0 to a negative power counts as 0."""
    s = _sums(m)
    power = lambda c, p: F.when(F.col(c) > 0, F.pow(c, F.lit(p))).otherwise(0.0)
    out = m.join(s.select(F.col("i").alias("row"), power("s", left).alias("a")), "row") if left else m.withColumn("a", F.lit(1.0))
    out = out.join(s.select(F.col("i").alias("col"), power("s", right).alias("b")), "col", "left").withColumn("b", F.coalesce("b", F.lit(0.0))) if right else out.withColumn("b", F.lit(1.0))
    return out.select("row", "col", (F.col("val") * F.col("a") * F.col("b")).alias("val"))


def _plus_identity(m: DataFrame, nodes: DataFrame, sign: float = 1.0, unit: float = 1.0) -> DataFrame:
    """unit I + sign M."""
    eye = nodes.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(float(unit)).alias("val"))
    return m.select("row", "col", (F.col("val") * sign).alias("val")).unionByName(eye).groupBy("row", "col").agg(F.sum("val").alias("val"))


def normalise(m: DataFrame, nodes: DataFrame, kind: str, gamma: float = 1.0) -> DataFrame:
    """One of KINDS of a symmetric matrix m(row, col, val) over nodes(id)."""
    if kind == "none":
        return m
    if kind == "sym":
        return _scaled(m, -0.5, -0.5)
    if kind == "rw":
        return _scaled(m, -1.0, 0)
    if kind == "laplacian":
        d = _sums(m).select(F.col("i").alias("row"), F.col("i").alias("col"), F.col("s").alias("val"))
        return m.select("row", "col", (-F.col("val")).alias("val")).unionByName(d).groupBy("row", "col").agg(F.sum("val").alias("val"))
    if kind == "norm_laplacian":
        return _plus_identity(_scaled(m, -0.5, -0.5), nodes, -1.0)
    if kind == "rw_laplacian":
        return _plus_identity(_scaled(m, -1.0, 0), nodes, -1.0)
    if kind == "first_order":
        return _plus_identity(_scaled(m, -0.5, -0.5), nodes)
    if kind == "aug_sym":
        return _scaled(_plus_identity(m, nodes, 1.0, gamma), -0.5, -0.5)
    if kind == "aug_rw":
        return _scaled(_plus_identity(m, nodes, 1.0, gamma), -1.0, 0)
    if kind == "low_pass":
        return _plus_identity(normalise(m, nodes, "norm_laplacian"), nodes, -0.5)
    raise ValueError(f"unknown kind {kind}")


def row_normalise(m: DataFrame, least: float | None = None) -> DataFrame:
    """val / row sum, 0 where the sum is 0; least: divide by at least this."""
    s = F.sum("val").over(Window.partitionBy("row"))
    d = F.greatest(s, F.lit(least)) if least is not None else s
    return m.select("row", "col", F.when(d != 0, F.col("val") / d).otherwise(0.0).alias("val"))


def diagonal_enhanced(m: DataFrame, nodes: DataFrame, lam: float = 1.0) -> DataFrame:
    """A' + lam diag(A') of the augmented random walk A'."""
    a = normalise(m, nodes, "aug_rw")
    return a.select("row", "col", F.when(F.col("row") == F.col("col"), F.col("val") * (1 + lam)).otherwise(F.col("val")).alias("val"))


def propagate(m: DataFrame, x: DataFrame, steps: int) -> DataFrame:
    """x(id, dim, val) multiplied by m so many times."""
    for _ in range(steps):
        x = m.join(x.select(F.col("id").alias("col"), "dim", F.col("val").alias("x")), "col").groupBy(F.col("row").alias("id"), "dim").agg(F.sum(F.col("val") * F.col("x")).alias("val"))
    return x


def exploded(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, dim, val."""
    return vectors.select(F.col(id).alias("id"), F.posexplode(vector).alias("dim", "v")).select("id", "dim", F.col("v").cast("double").alias("val"))


def dot(a, b):
    """The inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b):
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def edge_scores(edges: DataFrame, vectors: DataFrame, score=cosine) -> DataFrame:
    """src, dst, score of the vectors(id, x) at the ends."""
    both = edges.join(vectors.select(F.col("id").alias("src"), F.col("x").alias("xs")), "src").join(vectors.select(F.col("id").alias("dst"), F.col("x").alias("xd")), "dst")
    return both.select("src", "dst", score(F.col("xs"), F.col("xd")).alias("score"))


def softmax(df: DataFrame, group: str, value: str, temperature: float = 1.0) -> DataFrame:
    """df with prob: the softmax of value / temperature within a group, stable by the group's greatest."""
    w = Window.partitionBy(group)
    e = F.exp((F.col(value) - F.max(value).over(w)) / temperature)
    return df.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def segments(messages: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """id, n, total, mean, least, most of messages(by, val) for each of nodes(id); 0 where there is none."""
    got = messages.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("n"), F.sum("val").alias("total"), F.avg("val").alias("mean"), F.min("val").alias("least"), F.max("val").alias("most"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) if c == "n" else F.coalesce(c, F.lit(0.0)).alias(c) for c in ("n", "total", "mean", "least", "most")]
    return nodes.select("id").join(got, "id", "left").select("id", *zero)


def edge_weights(edges: DataFrame) -> DataFrame:
    """src, dst, weight from wi, wj, sx, sh: 1 - (1-wi) wj (1-sx) sh - wi (1-wj) sx (1-sh), scaled to 0..1 over all edges."""
    wi, wj, sx, sh = (F.col(c) for c in ("wi", "wj", "sx", "sh"))
    p = edges.select("src", "dst", (1 - (1 - wi) * wj * (1 - sx) * sh - wi * (1 - wj) * sx * (1 - sh)).alias("p"))
    return p.crossJoin(F.broadcast(p.agg(F.min("p").alias("lo"), F.max("p").alias("hi")))).select("src", "dst", ((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("weight"))
