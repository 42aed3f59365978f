"""Near-duplicate join on the Jaccard similarity of word shingles, with Bayesian pruning of candidates.

1. Every row becomes its set of five-word shingles; rows with equal sets are one class, which its smallest doc_id stands for.
2. 128 MinHash values of a class give 32 band keys of 4 values; a pair at the threshold of 0.8 shares no key with
   probability 5e-8.  Buckets with two or more classes are candidates; of buckets with the same members the first band's stays.
3. A large bucket is cut into blocks by a hash of the class, and each pair of blocks is a cell of its own, so no task holds a whole bucket.
4. In a cell, a pair is taken in the first band that it shares; its MinHash values are compared 16 at a time, and it is dropped as soon as the posterior
   probability of reaching the threshold (uniform prior) falls below ``TOLERANCE``; the rest is verified on the exact sets.
5. A cell returns, for each class, its number of links and one edge of the cell's spanning forest: never its pairs.  Links are summed, edges joined to components.

Defined cases: null and empty texts have the empty set and are equal to each other, with no link to anything else; texts of one to four words have one shingle
of all their words; rows that repeat a doc_id are rows of their class; a null doc_id never names a class unless all its rows have none (then the class is null); of equal
smallest ids the least text hash stands for a class; a text of any length is one set of all its shingles; other columns, whatever their names, don't matter; an empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import Scratch, hot_join, slices, slim

SHINGLE, THRESHOLD, HASHES, ROWS, STEP, TOLERANCE = 5, 0.8, 128, 4, 16, 1e-9
BANDS = HASHES // ROWS
#: Classes, and bytes of their texts, in one block of a bucket, about.
BLOCK, BLOCK_BYTES = 400, 4 << 20
MEMO_WORDS = 150_000
WORD = re.compile(r"\w+").findall
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**64, HASHES // 2, np.uint64) | np.uint64(1 << 32 | 1)
_B = _rng.integers(0, 2**64, HASHES // 2, np.uint64)
_memo: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    miss = set(words).difference(_memo)
    if len(_memo) + len(miss) > MEMO_WORDS:
        _memo.clear()
        miss = set(words)
    for w in miss:
        _memo[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles of a text."""
    h = _word_hashes(WORD(text.lower()))
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The MinHash values (32 bits) of a set of shingles: the upper and the lower half of each product give one each."""
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(found), 512):
        x = found[at : at + 512, None] * _A + _B
        out = np.minimum(out, x.view(np.uint32).min(axis=0))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = (h ^ rows[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return ((h & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)  # the band is its key's last 5 bits


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... values compared: the fewest matches with which P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior that probability is P(Binomial(n + 1, threshold) <= matches).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def pruned(a: np.ndarray, b: np.ndarray, sig: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) that no step drops."""
    match = np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        cols = slice(k * STEP, (k + 1) * STEP)
        match = match + (sig[a, cols] == sig[b, cols]).sum(axis=1)
        keep = match >= m
        a, b, match = a[keep], b[keep], match[keep]
    return a, b


def verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose exact Jaccard similarity reaches the threshold."""
    if not len(a):
        return a, b
    used = np.unique(np.concatenate([a, b]))
    vocab, ids = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    size = np.array([len(s) for s in sets])
    if len(used) ** 2 * len(vocab) < 2e9 * 8 and len(a) * 40_000 > len(used) ** 2 * len(vocab) / 8:
        place = np.zeros(len(sets), np.int64)
        place[used] = np.arange(len(used))
        owner = np.repeat(np.arange(len(used)), size[used])
        both = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        for at in range(0, len(vocab), 4096):
            s, e = np.searchsorted(ids, [at, at + 4096])
            x = np.zeros((len(used), min(4096, len(vocab) - at)), np.float32)
            x[owner[s:e], ids[s:e] - at] = 1
            both += x @ x.T
        common = both[place[a], place[b]].astype(np.int64)
    else:
        common = np.array([_common(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    keep = common >= threshold * (size[a] + size[b] - common) - 1e-9
    return a[keep], b[keep]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def cell_links(band: int, keys: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each class of a cell.  side: None if the cell is one block, else 0 or 1 for its two blocks, of which one may be empty."""
    k = len(sets)
    least, links, parent = least_matches(threshold), np.zeros(k, np.int64), list(range(k))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = (np.arange(k), np.arange(k)) if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        a, b = (x.ravel() for x in np.meshgrid(part, right, indexing="ij"))
        if side is None:
            a, b = a[a < b], b[a < b]
        for i in range(band):
            fresh = keys[a, i] != keys[b, i]
            a, b = a[fresh], b[fresh]
        a, b = verified(*pruned(a, b, sig, least), sets, threshold)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return links, np.array([root(i) for i in range(k)])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, th (as in docs), c (the digest of the shingle set), size (of the text), keys (the band keys; null for the empty set)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                sets = [shingles(t) for t in texts]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                keys = [band_keys(signature(s)).tolist() if len(s) else None for s in sets]
                yield pa.record_batch([part.column("doc_id"), part.column("th"), pa.array(digest, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "c", "size", "keys"])

    return docs.mapInArrow(run, "doc_id long, th long, c binary, size long, keys array<long>")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, class_id (of equal sets), group_id (of linked classes), n_links (other rows at the threshold or above), text_hash and kept of each row.

    kept: the row has the least (doc_id, text_hash) of its group, a null doc_id coming last.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    big = F.lit(2**63 - 1)  # a null doc_id comes last
    rows = slim(docs).withColumn("doc_id", F.coalesce("doc_id", big)).withColumn("th", F.xxhash64("text"))
    sketched = scratch.write(sketch(rows), "sketch")
    first = F.min_by(F.struct("doc_id", "th", "size", "keys"), F.struct("doc_id", "th")).alias("first")
    classes = scratch.write(sketched.groupBy("c").agg(F.count("*").alias("n"), first).select("c", "n", F.col("first.doc_id").alias("class_id"), "first.th", "first.size", "first.keys"), "classes")
    banded = classes.filter("keys IS NOT NULL").select("c", "n", "class_id", "th", "size", F.explode("keys").alias("key"))
    look = F.xxhash64("c")
    buckets = banded.groupBy("key").agg(F.count("*").alias("k"), F.sum("size").alias("bytes"), F.bit_xor(look).alias("x"), F.min(look).alias("m")).filter("k > 1")
    band = F.col("key").bitwiseAND(BANDS - 1)
    kept = buckets.groupBy("k", "bytes", "x", "m").agg(F.min_by("key", band).alias("key"))
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    kept = scratch.write(kept.select("key", "k", blocks), "buckets")
    members = hot_join(banded, kept, "key", "k").select("c", "n", "class_id", "th", "key", "blocks", F.pmod(F.xxhash64(F.lit(2), "c"), "blocks").cast("int").alias("block"))
    members = members.select("c", "n", "class_id", "th", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("c", "n", "class_id", "th", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    members = scratch.write(members, "members")
    wanted = scratch.small(members.select("c", "class_id", "th").distinct().select("c", F.col("class_id").alias("doc_id"), "th"), "wanted")
    texts = rows.join(wanted, ["doc_id", "th"]).select("c", "text").dropDuplicates(["c"])
    cells = members.select("c", "n", "key", "lo", "hi", "side").join(texts, "c")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t) for t in pdf["text"]]
        sig = np.array([signature(s) for s in sets])
        keys = np.array([band_keys(s) for s in sig])
        side = None if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else pdf["side"].to_numpy()
        links, root = cell_links(int(pdf["key"].iloc[0]) & (BANDS - 1), keys, sig, sets, pdf["n"].to_numpy(), side, threshold)
        ids = pdf["c"].to_numpy()
        return pd.DataFrame({"a": ids, "b": ids[root], "links": links})

    found = scratch.write(cells.groupBy("key", "lo", "hi").applyInPandas(run, "a binary, b binary, links long").filter("links > 0"), "found")
    tied = components(found.select("a", "b"), scratch).withColumnsRenamed({"id": "c", "root": "group"})
    tied = tied.join(classes.select("c", F.struct("class_id", "th").alias("first")), "c")
    group = tied.groupBy("group").agg(F.min("first").alias("first"), F.count("*").alias("classes"))
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "c")
    known = hot_join(tied.select("c", "group"), group, "group", "classes").join(links, "c").select("c", F.col("first.class_id").alias("group_id"), F.col("first.th").alias("group_th"), "links")
    known = scratch.write(classes.select("c", "class_id", "n", F.col("th").alias("class_th")).join(known, "c", "left"), "known")
    out = hot_join(sketched.select("doc_id", "th", "c"), known, "c", "n")
    own = lambda x: F.when(x != big, x)
    kept = (F.col("doc_id") == F.coalesce("group_id", "class_id")) & (F.col("th") == F.coalesce("group_th", "class_th"))
    return out.select(own(F.col("doc_id")).alias("doc_id"), own(F.col("class_id")).alias("class_id"), own(F.coalesce("group_id", "class_id")).alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("th").alias("text_hash"), kept.alias("kept"))


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs (all columns) that stand for their group of near duplicates: of rows that repeat a doc_id, each text is judged by itself; rows equal in both stay together."""
    last = F.lit(2**63 - 1)
    found = near_duplicates(docs, threshold, scratch)
    gone = found.filter("NOT kept").select(F.coalesce("doc_id", last).alias("did"), F.col("text_hash").alias("th")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), last).alias("did"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"))
    return row.join(gone, ["did", "th"], "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id", "n_links")
