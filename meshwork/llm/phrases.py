"""Phrase collocations by hashed bucket counts (PCY, DHP) and Apriori pruning.

Pass k over the documents counts phrases of k words exactly and, in an array of fixed size, the hash buckets of those of k + 1 words.  Before a phrase is counted, two
broadcast bitmaps of fixed size must hold it: its bucket has ``min_count`` occurrences, and so have both of its parts of k - 1 words (by their hashes).  A collision lets a phrase
be counted in vain, never the reverse, so all counts are exact at any size.  From the second pass on, a bucket counts an occurrence only if both of its parts of k words are candidates.

Everything is per language.  A phrase's score is that of its lowest-scoring cut into two parts; phrases that a longer one covers go, and the best of each language stay.

Defined cases: a null text is empty and has no words; a null lang is ``und``; rows are read one by one, whatever their doc_id, repeated ones too; texts of any length are read whole, in
chunks that end between pieces; ties in score and count go by the bytes of the phrase, which is unique; a word may hold a third of all occurrences, as words are counted before they are
shuffled and parts joined by a salt; other columns, whatever their names, don't matter; an empty table gives an empty table.
"""
from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import Scratch, hot_join, slices

#: Buckets of a pass and bits of a bitmap: 8 MiB at most, whatever the input; and the bits in one row of a bitmap.
BUCKETS, PART_BITS = 1 << 26, 15
#: Bytes of text that are cut into words together, and words that are counted together.
CHUNK_BYTES, CHUNK_WORDS = 1 << 20, 2_000_000
#: Words that one worker numbers before it starts anew.
MAX_WORDS = 1 << 20
#: Pieces end at these bytes, which become "."; A-Z in lower case.
ENDS = b".,;:!?\n\x0b\x0c\r"
TEXT_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in ENDS else 32 if b == 9 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to number; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.names, self.hashes = [b"."], array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = n = len(self)
        self.names.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Pass:
    """What one task counts in pass k.

    parts and held: the bitmaps, from the second pass on; most: where bucket counts stop; buckets: how many there are (a power of two, 0 in the last pass).
    """

    def __init__(self, k: int, parts: np.ndarray | None, held: np.ndarray | None, most: int, buckets: int):
        self.k, self.parts, self.held, self.most, self.words = k, parts, held, most, Words()
        self.seen = np.zeros(buckets, np.min_scalar_type(most)) if buckets else None

    def numbers(self, text: bytes) -> np.ndarray:
        """The numbers of the words of a text, 0 at the end of each piece."""
        words = text.replace(b".", b" . ").split()
        return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))

    def count(self, lang: str, ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The phrases of k words among ids, their hashes and counts; counts the buckets of those of k + 1 words."""
        import xxhash

        k, names = self.k, self.words.names
        one = _mix(np.frombuffer(self.words.hashes, np.uint64)[ids] ^ np.uint64(xxhash.xxh3_64_intdigest(lang)))
        whole, h, before, whole_before = ids > 0, one, one, ids > 0
        for size in range(2, k + 1):  # the hashes of the phrases of size words that begin at each place
            before, whole_before = h, whole
            whole, h = whole[:-1] & (ids[size - 1 :] > 0), _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[size - 1 :])
        if k > 1:
            some = whole_before & _holds(self.parts, before)
            whole = whole & some[:-1] & some[1:]
            whole[whole] = _holds(self.held, h[whole])
        if self.seen is not None and len(whole) > 1:
            at = np.flatnonzero(whole[:-1] & whole[1:])
            longer = _mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + one[at + k])
            found, n = np.unique(longer & np.uint64(len(self.seen) - 1), return_counts=True)
            found = found.astype(np.int64)
            self.seen[found] = np.minimum(self.seen[found] + n, self.most)
        at = np.flatnonzero(whole)
        code, size = ids[at].astype(np.int64), len(self.words)
        for step in range(1, k):
            if size * len(self.words) >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                size = len(code)
            code, size = code * len(self.words) + ids[at + step], size * len(self.words)
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        at = at[first]
        which = [ids[at + step].tolist() for step in range(k)]
        return [b" ".join([names[i] for i in row]) for row in zip(*which, strict=True)], h[at], n

    def buckets(self):
        """(part, places, counts) of the buckets that were met: places within a part as 16 bits."""
        found = np.flatnonzero(self.seen)
        part = found >> PART_BITS
        starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(found)] if len(found) else [0]
        for a, b in zip(starts, starts[1:], strict=False):
            some = found[a:b]
            yield int(part[a]), (some & (1 << PART_BITS) - 1).astype("<u2").tobytes(), self.seen[some].tobytes()


def _chunks(text: bytes, size: int):
    """text in parts of about size bytes that end between pieces."""
    at = 0
    while len(text) - at > size:
        end = text.find(b".", at + size) + 1 or len(text)
        yield text[at:end]
        at = end
    yield text[at:]


_COUNTS = "lang string, phrase string, h long, n long, part int, places binary, counts binary"


def _one_pass(docs: DataFrame, k: int, parts, held, min_count: int, buckets: int, chunk: int, chunk_words: int, max_words: int) -> DataFrame:
    """Counts of phrases (part null) and of buckets (phrase null; none if buckets is 0) by task."""
    names = [c.split()[0] for c in _COUNTS.split(", ")]

    def rows(lang, found):
        phrases, h, n = found
        size = len(phrases)
        cols = [pa.array([lang] * size, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())]
        return pa.record_batch([*cols, pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary())], names=names)

    def run(batches):
        bitmaps = [None if b is None else np.frombuffer(b.value, np.uint8) for b in (parts, held)]
        task, texts, size, ids = Pass(k, *bitmaps, min_count, buckets), {}, 0, {}
        end = np.zeros(1, np.int32)

        def number():
            for lang, some in texts.items():
                for text in _chunks(b".".join(some), chunk):
                    ids.setdefault(lang, []).extend((task.numbers(text), end))
            texts.clear()

        def flush():
            for lang, some in ids.items():
                yield rows(lang, task.count(lang, np.concatenate(some)))
            ids.clear()

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(text.translate(TEXT_BYTES))
                    size += len(text)
                    if size >= chunk:
                        number()
                        size = 0
                        if sum(len(x) for some in ids.values() for x in some) >= chunk_words or len(task.words) > max_words:
                            yield from flush()
                            if len(task.words) > max_words:
                                task.words = Words()
        number()
        yield from flush()
        if buckets:
            found = list(task.buckets())
            for at in range(0, len(found), 256):
                some = list(zip(*found[at : at + 256], strict=True))
                none = [pa.nulls(len(some[0]), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
                yield pa.record_batch([*none, pa.array(some[0], pa.int32()), pa.array(some[1], pa.binary()), pa.array(some[2], pa.binary())], names=names)

    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(run, _COUNTS)


def _collected(rows: DataFrame, buckets: int):
    """A broadcast bitmap from rows (part, bits): a row for each part, so of fixed size."""
    out, size = np.zeros(buckets // 8, np.uint8), 1 << PART_BITS - 3
    for r in rows.collect():
        bits = np.frombuffer(bytes(r.bits), np.uint8)[:size]
        out[r.part * size : r.part * size + size] = bits[: len(out) - r.part * size]
    return rows.sparkSession.sparkContext.broadcast(out.tobytes())


def _full_buckets(rows: DataFrame, buckets: int, min_count: int):
    """A broadcast bitmap of the buckets whose counts in rows(part, places, counts) come to min_count.

    The rows of a part are summed as they come, in an array of the part's size, so a task holds no more however many rows there are.
    """
    kind = np.min_scalar_type(min_count)

    def run(batches):
        sums = {}
        for batch in batches:
            for part, places, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if part not in sums:
                    sums[part] = np.zeros(1 << PART_BITS, kind)
                at = np.frombuffer(places, "<u2")
                sums[part][at] = np.minimum(sums[part][at].astype(np.int64) + np.frombuffer(counts, kind), min_count)
        if sums:
            bits = [np.packbits(x >= min_count, bitorder="little").tobytes() for x in sums.values()]
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["part", "bits"])

    return _collected(rows.select("part", "places", "counts").repartition("part").mapInArrow(run, "part int, bits binary"), buckets)


def _bitmap(keys: DataFrame, buckets: int):
    """A broadcast bitmap of fixed size of the column bucket."""
    part, bit = F.shiftright("bucket", PART_BITS).cast("int").alias("part"), F.expr(f"bucket & {(1 << PART_BITS) - 1}").alias("bit")
    return _collected(keys.select(part, bit).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")), buckets)


def frequent_phrases(docs: DataFrame, max_words: int, min_count: int, scratch: Scratch, buckets: int = BUCKETS, chunk: int = CHUNK_BYTES, chunk_words: int = CHUNK_WORDS, worker_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k (its words), f of each phrase of 1 to max_words words with f >= min_count; and lang, n: all word occurrences."""
    parts = held = None
    found, total = [], None
    for k in range(1, max_words + 1):
        rows = scratch.write(_one_pass(docs, k, parts, held, min_count, buckets if k < max_words else 0, chunk, chunk_words, worker_words), f"pass-{k}")
        counts = rows.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("h").alias("h"))
        if k == 1:
            total = scratch.write(rows.filter("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "total")
        counts = scratch.write(counts.filter(F.col("f") >= min_count).withColumn("k", F.lit(k)), f"frequent-{k}")
        found.append(counts.select("lang", "phrase", "k", "f"))
        if k < max_words:
            parts = _bitmap(counts.select(F.expr(f"h & {buckets - 1}").alias("bucket")), buckets)
            held = _full_buckets(rows.filter("part IS NOT NULL"), buckets, min_count)
        scratch.drop(f"pass-{k}")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out, total


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, cover: int = 50, top: int = 2000, scratch: Scratch | None = None, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to max_words words.

    a, l, r: the occurrences of the phrase and of both parts of the cut whose score, floor(1000000 a² / (l r)), is lowest (then the one after fewest words).  A phrase goes if a
    longer one that holds its words in a row has at least cover percent of its occurrences.  sizes: of buckets, chunk, chunk_words and worker_words; no result depends on them.
    """
    if max_words < 2:
        raise ValueError("max_words must be 2 at least")
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    frequent, total = frequent_phrases(docs, max_words, min_count, scratch, **sizes)
    words = F.split("phrase", " ")
    candidates = frequent.filter("k > 1").withColumnRenamed("f", "a")

    def part(first, size):
        return F.struct("lang", F.array_join(F.slice(words, first, size), " ").alias("phrase"))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    counts = frequent.select(F.struct("lang", "phrase").alias("key"), "f")
    for side, name in (("left", "l"), ("right", "r")):
        uses = cuts.groupBy(F.col(side).alias("key")).agg(F.count("*").alias("uses"))
        known = counts.join(uses, "key").select(F.col("key").alias(side), F.col("f").alias(name), "uses")
        cuts = hot_join(cuts, known, side, "uses").drop("uses")
    exact = "cast(1000000 * cast(a AS decimal(38, 0)) * a AS decimal(38, 0)) div cast(cast(l AS decimal(38, 0)) * r AS decimal(38, 0))"
    best = cuts.withColumn("score", F.expr(exact).cast("long")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    sizes = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(split(phrase, ' '), i, s), ' '))))")
    inside = candidates.filter("k > 2").select("lang", "a", F.explode(sizes).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter((F.col("longer").isNull()) | (100 * F.col("longer") < cover * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w
), c AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), cuts AS (
  SELECT lang, phrase, k, f AS a, w, unnest(range(1, k)) AS cut FROM c WHERE k > 1
), s AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN c x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN c y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, f AS a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
