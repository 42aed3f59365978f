"""Shared helpers: the scratch folder, table reading, size-checked broadcasts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its written Parquet files are at most this large.
BROADCAST_BYTES = 8 << 20
#: ... and have at most this many rows.
BROADCAST_ROWS = 400_000
NULL_ID = -(2**63)
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``), else a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="meshwork-"))


class Scratch:
    """Tables of one run of an operator, written under the shared folder, so that lost executors lose nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df as Parquet and reads it again; the lineage ends here."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def _fs(self, table: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def bytes(self, table: str) -> int:
        fs, path = self._fs(table)
        return fs.getContentSummary(path).getLength()

    def drop(self, table: str) -> None:
        fs, path = self._fs(table)
        fs.delete(path, True)

    def fits(self, df: DataFrame, table: str, limit: int = BROADCAST_BYTES) -> bool:
        """Whether a written table is small enough for a broadcast."""
        return self.bytes(table) <= limit and df.count() <= BROADCAST_ROWS

    def small(self, df: DataFrame, table: str, limit: int = BROADCAST_BYTES) -> DataFrame:
        """Writes df; marks it for broadcast if its files and rows are within the limits, else leaves the join to Spark."""
        out = self.write(df, table)
        return F.broadcast(out) if self.fits(out, table, limit) else out


#: Keys that ``hot_join`` treats apart, and the rows of a key from which it does.
HOT_KEYS, HOT_ROWS = 1000, 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right on key, where right has one row for each key and a column n: how many rows of left have the key, about.

    The at most ``HOT_KEYS`` most frequent keys of ``HOT_ROWS`` rows or more are broadcast and their rows dealt by a salt, so the rows of no key with more
    than 1 / HOT_KEYS of left meet in one task.  A null key matches nothing.
    """
    names = [c for c in right.columns if c != key]
    hot = right.filter(F.col(n) >= HOT_ROWS).orderBy(F.desc(n), key).limit(HOT_KEYS).select(F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot"))
    rest = right.select(F.lit(0).alias("_zero"), F.col(key).alias("_key"), F.struct(*names).alias("_rest"))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), F.lit(HOT_KEYS)).cast("int") + 1)
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn("_salt", salt)
    out = out.join(rest, (F.col("_salt") == F.col("_zero")) & (F.col(key) == F.col("_key")), "left").select(*left.columns, F.coalesce("_hot", "_rest").alias("_found"))
    return (out if how == "left" else out.filter("_found IS NOT NULL")).select(*left.columns, "_found.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame) -> DataFrame:
    """doc_id and text only (null text: empty), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ascii_lower(x):
    """A-Z to a-z, other characters as they are; the fast way where the string is pure ASCII."""
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def slices(batch, n: int = 256):
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)
