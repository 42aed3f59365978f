"""Sinks: vectors by source, sorted scores, cliques as lines, appended results."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, path: str) -> None:
    """source, node, value: a folder for each source."""
    df.write.mode("overwrite").partitionBy("source").parquet(path)


def sorted_scores(df: DataFrame, path: str) -> None:
    """id and score as text, the highest score first."""
    df.orderBy(F.desc("score"), "id").select(F.concat_ws(" ", F.col("id"), F.col("score").cast("string"))).write.mode("overwrite").text(path)


def member_lines(df: DataFrame, path: str) -> None:
    """members: lines of the size and the sorted members."""
    members = F.array_sort("members")
    df.select(F.concat_ws(" ", F.size("members").cast("string"), F.array_join(F.transform(members, lambda x: x.cast("string")), " "))).write.mode("overwrite").text(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def temporal_json(df: DataFrame, path: str) -> None:
    """u, v, t as JSON lines."""
    df.select("u", "v", "t").write.mode("overwrite").json(path)
