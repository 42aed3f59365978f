"""Ranked lexical search by WAND in each document shard.

Queries are taken in blocks of bounded size; a block's terms and their statistics go to every task.  One pass over the documents counts them, all their terms and how
many of them hold each query term; a second one cuts each task's documents into shards, inverts a shard for the query terms and searches it.  A query's cursors stand on their
terms' next documents, in document order; the *pivot* is the first of them where the largest impacts of the terms up to there could reach the score of the
query's k-th best document so far, so documents before it are skipped.  A task's heaps go from shard to shard; the heaps of the tasks are merged, in two steps.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case.  The scores are integers, see ``impacts`` and ``weight``.

Defined cases: a null or empty text has no term, does not count as a document and is never found; a query without a term has no result; queries with one item_id and other texts
are ranked apart, equal ones once; every row of the documents is a document of its own, whatever its doc_id; equal scores go by ascending doc_id (null first), so only equal rows can
change places; texts of any length are read whole; a query term may stand in every document, as a shard holds bounded postings; other columns, whatever their names,
don't matter; empty tables give an empty table.
"""
from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import slices, slim

#: Bytes of query text that are one block.
QUERY_BYTES = 4 << 20
#: A shard ends with the document that reaches either.
SHARD_POSTINGS, SHARD_DOCS = 1 << 19, 1 << 15
#: Groups of tasks whose heaps are merged before all.
MERGE_GROUPS = 64
#: Bytes of terms as they are, A-Z in lower case, all others as spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the score of a document of n terms that holds it tf times, for a weight of 1."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Shard:
    """An inverted index of the query terms; documents are numbered from 0."""

    def __init__(self):
        self.ids, self.lengths, self.postings, self.size = [], [], {}, 0

    def add(self, doc_id: int | None, n: int, counts: dict) -> None:
        k = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.size += len(counts)
        for term, tf in counts.items():
            if (found := self.postings.get(term)) is None:
                found = self.postings[term] = ([], [])
            found[0].append(k)
            found[1].append(tf)

    def full(self, postings: int, docs: int) -> bool:
        return self.size >= postings or len(self.ids) >= docs

    def inverted(self, n_docs: int, n_terms: int) -> dict:
        """For each term its documents, their impacts and the largest one."""
        lengths, out = np.array(self.lengths, np.int64), {}
        for term, (docs, tf) in self.postings.items():
            found = impacts(np.array(tf, np.int64), lengths[docs], n_docs, n_terms)
            out[term] = docs, found.tolist(), int(found.max())
        return out


def wand(query: list[tuple], index: dict, ids: list, heap: list, k: int) -> int:
    """Puts the documents that belong to the k best into heap, as (score, -doc_id); returns how many were scored.

    query: (term, weight with repeats), the weights above 0.
    """
    cursors = []  # the next document, its place, the documents, their impacts, the weight, the bound
    for term, w in query:
        if (found := index.get(term)) is not None and found[2]:
            cursors.append([found[0][0], 0, found[0], found[1], w, w * found[2]])
    first, scored = itemgetter(0), 0
    least = heap[0][0] if len(heap) == k else 1
    while cursors:
        cursors.sort(key=first)
        reach, pivot = 0, None
        for at, cursor in enumerate(cursors):
            reach += cursor[5]
            if reach >= least:
                pivot = cursor[0]
                break
        if pivot is None:
            break
        ended = False
        if cursors[0][0] == pivot:
            score, scored = 0, scored + 1
            for cursor in cursors:
                if cursor[0] != pivot:
                    break
                place = cursor[1]
                score += cursor[4] * cursor[3][place]
                cursor[1] = place = place + 1
                if place < len(cursor[2]):
                    cursor[0] = cursor[2][place]
                else:
                    cursor[0], ended = -1, True
            if score >= least:
                doc_id = ids[pivot]
                entry = score, 1 << 64 if doc_id is None else -doc_id
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
                if len(heap) == k:
                    least = heap[0][0]
        else:
            for cursor in cursors[:at]:
                if cursor[0] < pivot:
                    cursor[1] = place = bisect_left(cursor[2], pivot, cursor[1])
                    if place < len(cursor[2]):
                        cursor[0] = cursor[2][place]
                    else:
                        cursor[0], ended = -1, True
        if ended:
            cursors = [c for c in cursors if c[0] >= 0]
    return scored


def _binary(part) -> list:
    return part.column("text").cast(pa.binary()).to_pylist()


def _statistics(docs: DataFrame, wanted: frozenset) -> tuple[int, int, dict]:
    """The documents with a term, all their terms, and the documents that hold each of wanted (a block's terms, so bounded)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        asked, seen, n_docs, n_terms = shared.value, Counter(), 0, 0
        for batch in batches:
            for raw in _binary(batch):
                found = terms(raw)
                n_docs, n_terms = n_docs + bool(found), n_terms + len(found)
                seen.update(asked.intersection(found))
        yield pa.record_batch([pa.array([b"", b" ", *seen], pa.binary()), pa.array([n_docs, n_terms, *seen.values()], pa.int64())], names=["term", "n"])

    rows = docs.mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.term): r.n for r in rows}
    return found.pop(b"", 0), found.pop(b" ", 0), found


def search_block(docs: DataFrame, queries: list[bytes], k: int, postings: int = SHARD_POSTINGS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """qid (the place in queries), rank, doc_id, score of the k best documents of each query; docs has doc_id and text."""
    spark = docs.sparkSession
    asked = [Counter(terms(q)) for q in queries]
    n_docs, n_terms, df = _statistics(docs, frozenset().union(*asked))
    weights = {t: weight(n_docs, n) for t, n in df.items()}
    shared = spark.sparkContext.broadcast(([[(t, weights[t] * n) for t, n in q.items() if weights.get(t)] for q in asked], frozenset(t for t, w in weights.items() if w)))

    def run(batches):
        todo, known = shared.value
        heaps = [[] for _ in todo]

        def search(shard: Shard) -> None:
            index = shard.inverted(n_docs, n_terms)
            for query, heap in zip(todo, heaps, strict=True):
                wand(query, index, shard.ids, heap, k)

        shard = Shard()
        for batch in batches:
            for part in slices(batch):
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), _binary(part), strict=True):
                    found = terms(raw)
                    counts = Counter(found)
                    if held := known.intersection(counts):
                        shard.add(doc_id, len(found), {t: counts[t] for t in held})
                        if shard.full(postings, shard_docs):
                            search(shard)
                            shard = Shard()
        search(shard)
        for qid, heap in enumerate(heaps):
            if heap:
                scores, ids = zip(*heap, strict=True)
                cols = [pa.array([qid] * len(heap), pa.int32()), pa.array([None if i == 1 << 64 else -i for i in ids], pa.int64()), pa.array(scores, pa.int64())]
                yield pa.record_batch(cols, names=["qid", "doc_id", "score"])

    found = docs.mapInArrow(run, "qid int, doc_id long, score long").withColumn("group", F.spark_partition_id() % MERGE_GROUPS)
    best = [F.desc("score"), F.asc_nulls_first("doc_id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "group").orderBy(*best))).filter(F.col("rank") <= k)
    every = some.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*best))).filter(F.col("rank") <= k)
    return every.select("qid", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, query_bytes: int = QUERY_BYTES, **sizes) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k documents with the highest scores above 0 for each row (item_id, text) of queries.

    query_bytes and sizes (of a shard: postings, shard_docs) change no result.
    """
    spark, kind = docs.sparkSession, queries.schema["item_id"].dataType
    asked = queries.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes))
    out = spark.createDataFrame([], "rank int, doc_id long, score long").select(F.lit(None).cast(kind).alias("item_id"), "*")
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        if rows:
            names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], f"qid int, item_id {kind.simpleString()}")
            found = search_block(slim(docs), [r.text.encode() for r in rows], k, **sizes)
            found = found.join(F.broadcast(names), "qid").select("item_id", "rank", "doc_id", "score")
            out = found if b == 0 else out.union(found)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY doc_id, term),
d AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY item_id, term),
w AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, total WHERE term IN (SELECT term FROM q) GROUP BY term
), i AS MATERIALIZED (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))) AS impact FROM t JOIN w USING (term) JOIN d USING (doc_id), total
), s AS (
  SELECT item_id, doc_id, sum(repeats * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
