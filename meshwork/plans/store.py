"""Cutting lineage, and size-checked broadcasts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side that has been counted is broadcast.
BROADCAST_ROWS = 200_000


def _folder(df: DataFrame) -> str:
    """The checkpoint folder that all executors share (a temporary one only in local mode)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="meshwork-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, evaluated and read from the checkpoint folder."""
    _folder(df)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the checkpoint folder: smaller than a checkpoint, for long tables of numbers."""
    path = f"{_folder(df)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df, evaluated, in so many parts by the hash of key: later joins by key shuffle only their other side, if the parts are no fewer than the session's shuffle partitions.

    Adaptive execution hides the parts of a plan from its checkpoint, so it is off for this plan.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(parts, key))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, evaluated, and marked for broadcast if it has few enough rows."""
    out = cut(df)
    return F.broadcast(out) if out.count() <= rows else out


def until_stable(df: DataFrame, step, size=None, every: int = 1, limit: int = 1000) -> DataFrame:
    """Repeats step until size(df) (default: its rows) stays as it is; the lineage is cut every few rounds."""
    size = size or (lambda x: x.count())
    before, now = None, cut(df)
    for _ in range(limit):
        for _ in range(every):
            now = step(now)
        now = cut(now)
        n = size(now)
        if n == before:
            return now
        before = n
    raise RuntimeError("no fixpoint within the limit of rounds")
