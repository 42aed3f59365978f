"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), all in DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, hot_join


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """id, root (the least id of its component) for each id that has an edge in edges(a, b).

    Each round is written to the shared folder, which cuts the lineage; a star's centre has its neighbours' rows in one group
    only as a minimum (pre-aggregated), never as a collected list; the edges of the largest stars are dealt by a salt.
    """
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc0")
    total = None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = hot_join(both.filter(F.col("b") > F.col("a")), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, "a", "n").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        after = scratch.write(small, f"cc{k}")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"cc{k - 1}")
        now = after
        if found == total:
            break
        total = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select("b", F.col("b").alias("root")).distinct().withColumnRenamed("b", "id"))
