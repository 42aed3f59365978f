"""Exact de-duplication of an incoming batch against immutable snapshots.

A snapshot holds exact buckets (one row for each digest of normalised text) and, for each shard of the digest space, a
static binary fuse filter.  Incoming digests are grouped first (so a digest that a third of the batch holds is one row),
screened by the filter of their shard, and only positives join the exact buckets.  At last the bytes of all rows of a group of two or more are compared: the least
and the greatest text of a group must be one.

A batch may be screened against any number of snapshots, and the groups that come out become a snapshot in turn (``Snapshot.of_groups``).

Defined cases: null or empty text is the empty text (all such rows are equal); of equally long texts the smallest doc_id stays; a null doc_id is kept last; rows that repeat a
doc_id and a text count as rows of the group and are all marked as kept if that doc_id is (also where all ids of a group are null); texts of any length are compared whole;
an empty table gives an empty table; other columns, whatever their names, don't matter.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, hot_join, slim

#: Digests in one shard of a snapshot's filters, about.
SHARD_KEYS = 200_000
#: Bits of the bitmap that says which texts may have a copy, and bits in one of its rows: 8 MiB at most, whatever the input.
SCREEN_BITS, ROW_BITS = 1 << 26, 32_768
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: the finaliser of MurmurHash3


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= _C1
    h ^= h >> np.uint64(33)
    h *= _C2
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """A static 3-wise binary fuse filter with one byte for each of about 1.13 n slots (Graf and Lemire, 2022)."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    def _slots(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "FuseFilter":
        keys = np.unique(keys.astype(np.uint64))
        n = max(2, len(keys))
        segment = min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        slots = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        segments = max(1, -(-slots // segment) - 2)
        for seed in range(1, 100):
            out = cls(seed * 0x9E3779B97F4A7C15 % 2**64, segment, segments + seed // 8, np.zeros((segments + seed // 8 + 2) * segment, np.uint8))
            if out._fill(keys):
                return out
        raise RuntimeError("no seed lets the filter be built")

    def _fill(self, keys: np.ndarray) -> bool:
        h = _mix(keys, self.seed)
        slots, size = self._slots(h), len(self.table)
        count, xor = np.zeros(size, np.int32), np.zeros(size, np.int64)
        for s in slots:
            np.add.at(count, s, 1)
            np.bitwise_xor.at(xor, s, np.arange(len(keys)))
        rounds, left, look = [], len(keys), np.flatnonzero(count == 1)
        while left:
            at = look[count[look] == 1]
            if not len(at):
                return False
            ids, where = np.unique(xor[at], return_index=True)
            rounds.append((ids, at[where]))
            left -= len(ids)
            for s in slots:
                np.subtract.at(count, s[ids], 1)
                np.bitwise_xor.at(xor, s[ids], ids)
            look = np.unique(slots[:, ids])
        prints = self._prints(h)
        for ids, at in reversed(rounds):
            self.table[at] = 0
            self.table[at] = prints[ids] ^ np.bitwise_xor.reduce(self.table[slots[:, ids]], axis=0)
        return True

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed)
        return np.bitwise_xor.reduce(self.table[self._slots(h)], axis=0) == self._prints(h)

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.uint64).tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> "FuseFilter":
        seed, segment, segments = map(int, np.frombuffer(raw, np.uint64, 3))
        return cls(seed, segment, segments, np.frombuffer(raw, np.uint8, offset=24))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text without white space, hex), n_cp (code points of the original text), norm."""
    norm = F.col("text")
    for c in " \t\n\x0b\x0c\r":
        norm = F.replace(norm, F.lit(c), F.lit(""))
    out = slim(docs).select("doc_id", F.length("text").alias("n_cp"), norm.alias("norm"))
    return out.select("doc_id", F.sha2("norm", 256).alias("digest"), "n_cp", "norm")


def _groups(df: DataFrame) -> DataFrame:
    """A row for each digest: how many rows, the best row (most code points, then smallest doc_id), the first doc_id."""
    best = F.max(F.struct("n_cp", (-F.col("doc_id")).alias("neg"))).alias("best")
    return df.groupBy("digest").agg(F.count("*").alias("n"), best, F.min("doc_id").alias("first_id"))


def _key():
    return F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")


class Snapshot:
    """An immutable set of exact buckets with its filters, written once."""

    def __init__(self, rows: DataFrame, scratch: Scratch, name: str):
        self._build(_groups(rows), scratch, name)

    @classmethod
    def of_groups(cls, groups: DataFrame, scratch: Scratch, name: str) -> "Snapshot":
        """The snapshot whose buckets are the groups that ``dedup_batch`` returned."""
        out = cls.__new__(cls)
        out._build(groups.select("digest", "n", "best", "first_id"), scratch, name)
        return out

    def _build(self, groups: DataFrame, scratch: Scratch, name: str) -> None:
        self.buckets = scratch.write(groups.withColumn("key", _key()), f"{name}-buckets")
        self.shards = max(1, math.ceil(self.buckets.count() / SHARD_KEYS))
        shards = self.shards

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [FuseFilter.build(pdf["key"].to_numpy()).dump()]})

        sharded = self.buckets.select(F.pmod("key", F.lit(shards)).cast("long").alias("shard"), "key")
        self.filters = scratch.write(sharded.groupBy("shard").applyInPandas(build, "shard long, filter binary"), f"{name}-filters")

    def dealt(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(digest, key, shard, salt of groups; the filters for each shard and salt): about SHARD_KEYS digests meet one filter, however small the snapshot and large the batch is."""
        salts = max(1, math.ceil(groups.count() / (self.shards * SHARD_KEYS)))
        keys = groups.select("digest", _key().alias("key")).withColumn("shard", F.pmod("key", F.lit(self.shards)).cast("long"))
        keys = keys.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)))
        return keys, self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def screen(self, groups: DataFrame) -> DataFrame:
        """groups with a column maybe: whether the snapshot may hold the digest."""

        def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            keys = left["key"].to_numpy()
            maybe = FuseFilter.load(right["filter"].iloc[0]).might_hold(keys) if len(right) else np.zeros(len(keys), bool)
            return pd.DataFrame({"digest": left["digest"], "maybe": maybe})

        keys, filters = self.dealt(groups)
        found = keys.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(check, "digest string, maybe boolean")
        return groups.join(found, "digest")


def dedup_batch(batch: DataFrame, snapshots: list[Snapshot], scratch: Scratch) -> DataFrame:
    """The groups of batch and snapshots together: digest, n, best, first_id; snapshot digests that no row of batch has stay as they are.

    No two snapshots hold the same digest (each was made from rows that its predecessors had been asked about, or they are first merged by ``Snapshot.of_groups``).
    """
    now = scratch.write(_groups(batch), "batch-0")
    rest = []
    for k, snapshot in enumerate(snapshots, 1):
        screened = scratch.write(snapshot.screen(now), f"screened-{k}")
        hits = screened.filter("maybe").join(snapshot.buckets.select("digest", F.col("n").alias("n2"), F.col("best").alias("best2"), F.col("first_id").alias("first2")), "digest", "left")
        both = hits.select("digest", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("best", "best2").alias("best"), F.least("first_id", "first2").alias("first_id"))
        now = both.unionByName(screened.filter("NOT maybe").select("digest", "n", "best", "first_id"))
        rest.append(snapshot.buckets.join(screened.filter("maybe").select("digest"), "digest", "left_anti").select("digest", "n", "best", "first_id"))
    for df in rest:
        now = now.unionByName(df)
    return now


def may_be_in(rows: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose digest is in keys, and few others: a bitmap of fixed size is broadcast, so texts without a copy are not shuffled.

    A full bitmap lets rows pass that have no match, never the reverse.
    """
    place = F.xxhash64("digest").bitwiseAND(SCREEN_BITS - 1)  # never null, so the join infers no filter that would hash the text again
    part, bit = F.shiftright(place, ROW_BITS.bit_length() - 1).alias("_part"), place.bitwiseAND(ROW_BITS - 1).alias("_bit")
    bitmap = scratch.write(keys.select(part, bit).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "bitmap")
    byte = "cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    held = F.expr(f"shiftright({byte}, cast(_bit % 8 as int)) & 1 = 1")
    return rows.select("*", part, bit).join(F.broadcast(bitmap), "_part").filter(held).select(rows.columns)


def exact_dedup(docs: DataFrame, scratch: Scratch | None = None, in_snapshot=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs.

    in_snapshot: a condition on doc_id that says which rows are an earlier snapshot (default: about half, by hash); the rest is the incoming batch.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    in_snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    rows = scratch.write(digests(docs).withColumn("old", in_snapshot).drop("norm"), "rows")
    snapshot = Snapshot(rows.filter("old"), scratch, "first")
    groups = scratch.write(dedup_batch(rows.filter("NOT old"), [snapshot], scratch), "groups")
    many = groups.filter("n > 1").select("digest", "n")
    # a group whose least and greatest text are equal has one text: a pre-aggregated minimum and maximum, in which no group meets as a whole
    texts = hot_join(may_be_in(digests(docs), many, scratch), many, "digest", "n").groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    odd = scratch.write(texts.filter("least <> greatest").select("digest"), "odd")
    keep = F.when(F.col("best.neg").isNotNull(), -F.col("best.neg"))
    if not odd.isEmpty():  # different bytes under one digest: their groups go by the bytes themselves
        rows = digests(docs).select("doc_id", "n_cp", "digest", F.concat("digest", F.lit(":"), "norm").alias("full"))
        groups = _groups(rows.select("doc_id", "n_cp", F.col("full").alias("digest"))).withColumnRenamed("digest", "full")
        joined = hot_join(rows, groups.select("full", "n", "best"), "full", "n")
    else:
        joined = hot_join(rows.select("doc_id", "digest"), groups.select("digest", "n", "best"), "digest", "n")
    out = joined.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), F.col("digest").alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), g AS (
  SELECT h, count(*)::BIGINT AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY h
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
