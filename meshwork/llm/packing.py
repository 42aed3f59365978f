"""Lexical retrieval packing.

Texts become token ids once (written as 16-bit ids).  Document frequencies of all ids, the number of documents and their mean
length are counted over the whole corpus; the ids of a vocabulary bound what reaches the driver.

The index is sharded by content: a document's key is ``KEYS`` weighted MinHash values of its distinct ids, each weighted by its idf (ids of one document alone
have no weight), so two documents agree in the first value with a probability that is the weighted Jaccard similarity of their ids, however many shards there are.  Documents are
range-partitioned by key and, within a range, cut into shards of about ``shard_tokens`` tokens in order of key: what is alike lies in one shard, and no
key, however frequent, makes a shard larger.  A shard holds a BM25 inverted index of its documents; each seed document asks it for
its best unused neighbours, which fill the seed's window in order of score; the last one is cut to fit and its rest stays
available, so only a shard's last window has padding.  A seed does not ask other shards: README gives the measured recall.

Defined cases: null text is empty and has the end id only; a null doc_id is placed by its text like any other; rows that repeat a doc_id or a text are
packed one by one; of equal scores the document that comes first in its shard is taken; a text of any length is encoded whole, and its full windows are sequences of their own;
other columns, whatever their names, don't matter; an empty table gives no piece; a vocabulary of more than 65,536 ids is refused.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer
from .util import Scratch, slices, slim

WINDOW, END_ID, SHARD_TOKENS = 2048, 1, 1_000_000
K1, B = 1.2, 0.75
#: Entries of a dense table of postings (documents by ids of a shard), at most; seeds whose scores are taken in one product.
DENSE, SEEDS = 16_000_000, 64
#: MinHash values in a placement key, of 16 bits each.
KEYS = 4
#: Shards in one range of keys, about.
RANGE_SHARDS = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_ids(docs: DataFrame, vocab: str, kind: str = "word", end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit), n of each row."""

    def encode(batches):
        tok, end = tokenizer(vocab, kind), np.array([end_id], "<u2")
        if tok.size > 1 << 16:
            raise ValueError(f"a vocabulary of {tok.size} ids does not fit 16 bits")
        for batch in batches:
            for part in slices(batch):
                raw = [np.concatenate([np.frombuffer(x, "<u4").astype("<u2"), end]) for x in tok.encode(part.column("text").to_pylist())]
                yield pa.record_batch([part.column("doc_id"), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=["doc_id", "ids", "n"])

    return slim(docs).mapInArrow(encode, "doc_id long, ids binary, n long")


def document_frequencies(encoded: DataFrame) -> DataFrame:
    """token, df over all rows; each task sends a row for each token it has seen."""

    def count(batches):
        df, place = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw, "<u2")
                at = np.arange(len(ids))
                place[ids] = at  # of equal ids one place stays
                df[ids[place[ids] == at]] += 1
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(df[seen], pa.int64())], names=["token", "df"])

    return encoded.select("ids").mapInArrow(count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


class Index:
    """BM25 postings of one shard's documents; idf and the mean length come from the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        tokens, owners, weights, self.terms = [], [], [], []
        for i, x in enumerate(docs):
            t, tf = np.unique(x, return_counts=True)
            tokens.append(t)
            owners.append(np.full(len(t), i, np.int32))
            weights.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean)))
            self.terms.append(t)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint16)
        order = np.argsort(flat, kind="stable")
        self.owners = np.concatenate(owners)[order] if owners else np.zeros(0, np.int32)
        self.weights = np.concatenate(weights)[order] if weights else np.zeros(0)
        self.starts, self.n = np.searchsorted(flat[order], np.arange((1 << 16) + 1)), len(docs)
        used = np.flatnonzero(np.diff(self.starts))
        self.dense = None
        if self.n * len(used) <= DENSE:
            self.dense = np.zeros((self.n, len(used)), np.float32)
            self.dense[self.owners, np.repeat(np.arange(len(used)), np.diff(self.starts)[used])] = self.weights

    def scores_of(self, seeds: np.ndarray) -> np.ndarray:
        """The scores of all documents for each seed, to three decimals: through a matrix product of the postings where these fit a dense table, else seed by seed."""
        if self.dense is None:
            return np.array([self.scores(s) for s in seeds]).round(3)
        return ((self.dense[seeds] > 0).astype(np.float32) @ self.dense.T).round(3)

    def scores(self, seed: int) -> np.ndarray:
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.terms[seed].astype(np.int64)]
        return np.bincount(np.concatenate([self.owners[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    out, sequence = [], 0
    at = np.zeros(len(docs), np.int64)
    size = np.array([len(x) for x in docs], np.int64)
    for i in range(len(docs)):
        for _ in range(size[i] // window):
            out.append((i, int(at[i]), window, sequence, 0))
            at[i] += window
            sequence += 1
    index, known = Index(docs, idf, mean), {}
    for seed in range(len(docs)):
        while at[seed] < size[seed]:
            room, offset, order, k = window, 0, None, 0
            i = seed
            while True:
                take = int(min(room, size[i] - at[i]))
                out.append((i, int(at[i]), take, sequence, offset))
                at[i] += take
                offset += take
                room -= take
                if not room:
                    break
                if order is None:
                    unused = np.flatnonzero(at < size)
                    if seed not in known:
                        ahead = np.concatenate([[seed], unused[unused > seed][: (SEEDS if index.dense is not None else 1) - 1]]).astype(np.int64)
                        known = dict(zip(ahead.tolist(), index.scores_of(ahead), strict=True))
                    order = unused[np.argsort(-known[seed][unused], kind="stable")]
                if k == len(order):
                    break
                i, k = order[k], k + 1
            sequence += 1
    return out


def placement_values(df: np.ndarray, idf: np.ndarray, keys: int = KEYS) -> np.ndarray:
    """For each of ``keys`` hash functions a number for each id: the id of a document with the least number is its MinHash value, weighted by idf."""
    u = np.random.default_rng(11).random((keys, len(idf)))
    weight = np.where(df > 1, idf, 0.0)
    return np.where(weight > 0, -np.log(u) / np.maximum(weight, 1e-300), 1e300 * (1 + u))


def placement_key(ids: np.ndarray, values: np.ndarray) -> int:
    key = 0
    for v in values:
        key = key << 16 | int(ids[v[ids].argmin()])
    return key - (1 << 63)


def pack_documents(docs: DataFrame, vocab: str, scratch: Scratch | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all rows of docs."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    encoded = scratch.write(token_ids(docs, vocab), "ids")
    n, total = encoded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = document_frequencies(encoded).toPandas()  # at most a row for each id of the vocabulary
    idf, df = np.zeros(1 << 16), np.zeros(1 << 16, np.int64)
    df[found["token"].to_numpy(np.int64)] = found["df"]
    idf[df > 0] = np.log1p((n - df[df > 0] + 0.5) / (df[df > 0] + 0.5))
    mean = max(1.0, total / max(n, 1))

    def place(batches):
        values = placement_values(df, idf)
        for batch in batches:
            keys = [placement_key(np.frombuffer(raw, "<u2"), values) for raw in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array(keys, pa.int64())], names=["doc_id", "ids", "key"])

    def shards(batches):
        """Lists of (doc_id, ids) of about shard_tokens tokens, in order."""
        held, size = [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2")
                held.append((doc_id, ids))
                size += len(ids)
                if size >= shard_tokens:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches):
        sequence = TaskContext.get().partitionId() << 32
        for shard in shards(batches):
            ids = [x for _, x in shard]
            rows = [(shard[i][0], s, k, zlib.crc32(ids[i][s : s + k].astype("<u4").tobytes()), len(ids[i]), sequence + q, o) for i, s, k, q, o in pack(ids, idf, mean)]
            sequence = rows[-1][5] + 1
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = encoded.select("doc_id", "ids").mapInArrow(place, "doc_id long, ids binary, key long").withColumn("salt", F.monotonically_increasing_id())
    order = ["key", F.xxhash64("doc_id"), "salt"]
    ranges = max(1, -(-total // (RANGE_SHARDS * shard_tokens)))
    return placed.repartitionByRange(int(ranges), *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    return pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
