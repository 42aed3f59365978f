"""Evaluation aggregates: ranking, classification and clustering metrics, and pairwise losses."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import running


#: Cells of a contingency table that the driver solves, at most.
CELLS = 1_000_000


def hits_at(positives: DataFrame, negatives: DataFrame, k: int) -> DataFrame:
    """hits: the share of positive scores over the k-th best negative one (all, if there are fewer negatives)."""
    bar = negatives.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("bar"), F.count("*").alias("n"))
    hit = F.when(F.col("n") < k, 1.0).otherwise((F.col("score") > F.col("bar")).cast("double"))
    return positives.crossJoin(F.broadcast(bar)).agg(F.round(F.avg(hit), 6).alias("hits"))


def mrr(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """mrr: the mean of 1 / rank of each positive among the negatives of the same source (higher scores before it; ties half).

    Equal scores of a source are counted first; sums over a source's scores in order give the ranks, without pairs of positives and negatives.
    """
    each = positives.select("source", "score", F.lit(1).alias("p"), F.lit(0).alias("n")).unionByName(negatives.select("source", "score", F.lit(0).alias("p"), F.lit(1).alias("n")))
    by = each.groupBy("source", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("place", 1 + above + F.col("n") / 2).filter("p > 0")
    return ranked.agg(F.round(F.sum(F.col("p") / F.col("place")) / F.sum("p"), 6).alias("mrr"))


def auc_ap(df: DataFrame) -> DataFrame:
    """auc, ap of (score, label 0/1): sums over distinct scores, which are counted first, so ties cost nothing; running sums go by ranges of scores."""
    by = df.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    up = running(running(by, "score", "n", "upto"), "score", "p", "pupto")
    total = F.broadcast(by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")))
    p, n = F.col("p"), F.col("n")
    run = up.crossJoin(total).select("p", "n", "all_p", "all_n", (F.col("upto") - n).alias("below"), (F.col("all_p") - F.col("pupto") + p).alias("tp"), (F.col("all_n") - F.col("upto") + n).alias("fp"))
    out = run.agg(F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"), F.sum(p * (F.col("below") + n / 2)).alias("a"), F.sum(p * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"))
    return out.select(F.round(F.col("a") / (F.col("all_p") * F.col("all_n")), 6).alias("auc"), F.round(F.col("s") / F.col("all_p"), 6).alias("ap"))


def confusion(df: DataFrame) -> DataFrame:
    """label, tp, fp, fn of (label, pred)."""
    hit = F.col("label") == F.col("pred")
    t = df.groupBy("label").agg(F.sum(hit.cast("long")).alias("tp"), F.sum((~hit).cast("long")).alias("fn"))
    p = df.groupBy(F.col("pred").alias("label")).agg(F.sum((~hit).cast("long")).alias("fp"))
    z = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return t.join(p, "label", "full").select("label", z("tp"), z("fp"), z("fn"))


def classification(df: DataFrame) -> DataFrame:
    """accuracy, micro_f1, macro_f1, macro_precision."""
    c = confusion(df).withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)).withColumn("pr", F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0))
    out = c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro"), F.avg("pr").alias("pr"))
    return out.select(F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("accuracy"), F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("micro_f1"), F.round("macro", 6).alias("macro_f1"), F.round("pr", 6).alias("macro_precision"))


def contingency(df: DataFrame) -> DataFrame:
    """label, pred, n with both margins and the total."""
    c = df.groupBy("label", "pred").agg(F.count("*").alias("n"))
    a, b = df.groupBy("label").agg(F.count("*").alias("a")), df.groupBy("pred").agg(F.count("*").alias("b"))
    return c.join(a, "label").join(b, "pred").crossJoin(F.broadcast(df.agg(F.count("*").alias("t"))))


def clustering(df: DataFrame) -> DataFrame:
    """nmi (arithmetic mean of entropies) and ari of (label, pred)."""
    c = contingency(df)
    n, a, b, t = (F.col(x).cast("double") for x in "nabt")
    mi = c.agg(F.sum(n / t * F.ln(n * t / (a * b))).alias("mi"), F.sum(n * (n - 1) / 2).alias("pairs"))
    h = lambda name, col: df.groupBy(name).agg(F.count("*").cast("double").alias("k")).crossJoin(F.broadcast(df.agg(F.count("*").cast("double").alias("t")))).agg(F.sum(-F.col("k") / F.col("t") * F.ln(F.col("k") / F.col("t"))).alias(f"h{col}"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(f"s{col}"), F.max("t").alias(f"t{col}"))
    out = mi.crossJoin(h("label", "a")).crossJoin(h("pred", "b"))
    expected = F.col("sa") * F.col("sb") / (F.col("ta") * (F.col("ta") - 1) / 2)
    return out.select(F.round(2 * F.col("mi") / (F.col("ha") + F.col("hb")), 6).alias("nmi"), F.round((F.col("pairs") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected), 6).alias("ari"))


def best_mapping_accuracy(df: DataFrame) -> float:
    """The accuracy under the best one-to-one mapping of clusters to labels (the contingency table, a cell for each pair of classes, is solved on the driver)."""
    import numpy as np

    cells = df.groupBy("label", "pred").count()
    if cells.limit(CELLS + 1).count() > CELLS:
        raise ValueError(f"more than {CELLS} cells: the mapping is solved on the driver")
    c = cells.toPandas()
    labels, preds = sorted(c["label"].unique()), sorted(c["pred"].unique())
    n = max(len(labels), len(preds))
    gain = np.zeros((n, n))
    for label, pred, k in c.itertuples(index=False):
        gain[preds.index(pred), labels.index(label)] = k
    return float(sum(gain[i, j] for i, j in enumerate(assignment(-gain))) / gain.sum())


def assignment(cost) -> list[int]:
    """For each row its column in a cheapest one-to-one assignment, by shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        match[n], j = i, n
        least, way, used = [float("inf")] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while True:
            used[j], row, delta, nxt = True, match[j], float("inf"), n
            for c in range(n):
                if not used[c]:
                    d = cost[row][c] - u[row] - v[c]
                    if d < least[c]:
                        least[c], way[c] = d, j
                    if least[c] < delta:
                        delta, nxt = least[c], c
            for c in range(n + 1):
                if used[c]:
                    u[match[c]] += delta
                    v[c] -= delta
                else:
                    least[c] -= delta
            j = nxt
            if match[j] == n:
                break
        while j != n:
            match[j], j = match[way[j]], way[j]
    out = [0] * n
    for c in range(n):
        out[match[c]] = c
    return out


def losses(pairs: DataFrame) -> DataFrame:
    """One row over pairs(pos, neg, weight), one negative for each positive: sums of the squared losses of the margin d = pos - neg, means of the logarithmic ones.

    auc (1 - d)^2, hinge_auc max(0, 1 - d)^2, weighted_auc w (1 - d)^2, adaptive_auc (w - d)^2, weighted_hinge_auc w max(0, w - d)^2, adaptive_hinge_auc max(0, w - d)^2,
    log_rank -ln(sigmoid(d) + 1e-15), cross_entropy -ln(sigmoid(pos) + 1e-15) - ln(1 - sigmoid(neg) + 1e-15), info_nce -ln(e^pos / (e^pos + e^neg) + 1e-15).
    """
    d, w = F.col("pos") - F.col("neg"), F.col("weight")
    square = lambda x: x * x
    above = lambda x: F.greatest(F.lit(0.0), x)
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    sums = {"auc": square(1 - d), "hinge_auc": square(above(1 - d)), "weighted_auc": w * square(1 - d), "adaptive_auc": square(w - d), "weighted_hinge_auc": w * square(above(w - d)), "adaptive_hinge_auc": square(above(w - d))}
    means = {
        "log_rank": -F.ln(sigmoid(d) + 1e-15), "cross_entropy": -F.ln(sigmoid(F.col("pos")) + 1e-15) - F.ln(1 - sigmoid(F.col("neg")) + 1e-15),
        "info_nce": -F.ln(F.exp("pos") / (F.exp("pos") + F.exp("neg")) + 1e-15),
    }
    return pairs.agg(*(F.sum(x).alias(k) for k, x in sums.items()), *(F.avg(x).alias(k) for k, x in means.items()))


def best_epochs(runs: DataFrame) -> DataFrame:
    """mean and deviation, over runs(run, epoch, valid, test), of the test value at the best (then last) valid epoch."""
    best = runs.groupBy("run").agg(F.max_by("test", F.struct("valid", "epoch")).alias("test"), F.max("valid").alias("valid"))
    return best.agg(F.round(F.avg("test"), 6).alias("test_mean"), F.round(F.stddev_samp("test"), 6).alias("test_std"), F.round(F.avg("valid"), 6).alias("valid_mean"))
