"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

1. Texts and items become words (letters, digits, and other non-ASCII characters; lower case), hashed five by five; an item of fewer words is one shingle of all its words.
2. A window of a document is as long as an item (or the whole text, if that is shorter) and has at least t / (1 + t) of both their shingles
   at places whose shingle the item has anywhere, in any order; no other window can reach the similarity t.  The places come from a join on shingle hashes.
3. A window and an item are fingerprinted by a 64-bit SimHash of their shingles (each weighted by how often it occurs).
   Fingerprints are cut into ``BLOCKS`` blocks; items are indexed by (words, block, value) for every value within one bit, and as
   at most ``RADIUS`` = 2 * BLOCKS - 1 differing bits leave some block with at most one of them, the lookup finds every fingerprint within the radius.
4. Pairs within the radius are verified by the weighted Jaccard similarity of their shingle multisets: at least ``THRESHOLD``.

Defined cases: null and empty texts and items have no words and match nothing; repeated rows are judged each by doc_id and text; a null doc_id is kept
apart by its text; repeated items are one; empty tables give no match; other columns don't matter.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import NULL_ID, Scratch, slim

SHINGLE, THRESHOLD = 5, 0.8
BLOCKS = 10
RADIUS = 2 * BLOCKS - 1
#: Bits of each block: 64 in BLOCKS parts.
CUTS = [(i * 64 // BLOCKS, (i + 1) * 64 // BLOCKS) for i in range(BLOCKS)]
LANES = 1 << 32 | 1
#: Windows that start within so many words are fingerprinted together, one from the other.
RUN = 64


def words(text):
    """The words of a text as an array."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ", -1), "")


def shingle_hashes(found, k: int = SHINGLE):
    """The hashes of all k-word shingles of an array of words, in order; fewer words are one shingle; no words, none."""
    many = F.transform(F.sequence(F.lit(0), F.size(found) - k), lambda i: F.xxhash64(*(F.get(found, i + c) for c in range(k))))
    return F.when(F.size(found) >= k, many).when(F.size(found) > 0, F.array(F.xxhash64(found))).otherwise(F.array().cast("array<bigint>"))


def _sketches(part: str, own: str, more: str) -> str:
    """SQL for the 64-bit SimHashes of the windows of own hashes that start at 0 to more of the array part: bit b is set if more than half of a window's hashes have it.

    32 sums hold the votes of two bits each, in lanes of 32 bits; a step adds the hash that comes in and takes off the one that leaves.
    """
    lane = lambda h: f"(shiftrightunsigned({h}, j) & {LANES}L)"
    votes = f"aggregate(slice({part}, 1, {own}), array_repeat(0L, 32), (v, h) -> transform(v, (s, j) -> s + {lane('h')}))"
    bits = f"if((get(a.v, j) & 4294967295L) * 2 > {own}, shiftleft(1L, j), 0L) | if(shiftrightunsigned(get(a.v, j), 32) * 2 > {own}, shiftleft(1L, j + 32), 0L)"
    sketch = f"aggregate(sequence(0, 31), 0L, (b, j) -> b | {bits})"
    moved = f"transform(a.v, (s, j) -> s + {lane(f'coalesce(get({part}, {own} + i), 0L)')} - {lane(f'get({part}, i)')})"
    step = f"named_struct('v', {moved}, 'out', array_append(a.out, {sketch}))"
    return f"aggregate(sequence(0, {more}), named_struct('v', {votes}, 'out', cast(array() AS array<bigint>)), (a, i) -> {step}, a -> a.out)"


def with_simhash(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """df with the SimHash of its array of hashes."""
    return df.withColumn(name, F.expr(f"get({_sketches(hashes, f'size({hashes})', '0')}, 0)"))


def _block(value, cut):
    return F.shiftrightunsigned(value, cut[0]).bitwiseAND(F.lit((1 << (cut[1] - cut[0])) - 1))


def common_weight(a, b):
    """The sum over shingles of the lesser count in a and b."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.array_intersect(a, b)
    count = lambda xs, h: F.size(F.filter(xs, lambda y: y == h))
    return F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id (the least of those with the same shingles), hashes, n (of words), sketch."""
    found = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    found = found.select("item_id", F.size("w").alias("n"), shingle_hashes(F.col("w")).alias("hashes")).filter("n > 0")
    return with_simhash(found.groupBy("n", "hashes").agg(F.min("item_id").alias("item_id")), "hashes", "sketch")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, rk (the hash of the text), item_id, start (word), n_words, distance, similarity: for each row and item the best window that reaches the threshold (of equal ones the first)."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    items = scratch.small(items_of(benchmark), "items")
    places = scratch.small(items.select("item_id", "n", F.size("hashes").alias("m"), F.explode(F.array_distinct("hashes")).alias("h")), "places")
    base = slim(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), F.xxhash64("text").alias("rk"), "text")
    found = None
    # items of fewer words than a shingle have shingles of their own length: at most 5 lengths, usually one
    for k in sorted(r.k for r in items.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()):
        seen = base.select("did", "rk", words(F.col("text")).alias("w")).select("did", "rk", F.size("w").alias("size"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "h"))
        hit = seen.join(places.filter(F.least("n", F.lit(SHINGLE)) == k), "h")
        # rows that repeat a text have the same places
        hit = hit.groupBy("did", "rk", "item_id", "n", "m", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        own = F.greatest(F.lit(1), F.least("n", "size") - F.lit(k - 1))
        hit = hit.withColumn("need", F.greatest(F.lit(1), F.ceil(F.lit(threshold) / (1 + threshold) * (own + F.col("m")) - 1e-9).cast("int"))).filter(F.size("at") >= F.col("need"))
        starts = hit.select("did", "rk", "n", F.explode(_dense_starts(k)).alias("start"))
        windows = scratch.small(starts.distinct(), f"windows{k}")
        runs = windows.groupBy("did", "rk", "n", F.floor(F.col("start") / RUN).alias("run")).agg(F.array_sort(F.collect_list("start")).alias("starts"))
        hits = base.join(runs.groupBy("did", "rk").agg(F.collect_list(F.struct("n", "starts")).alias("runs")), ["did", "rk"])
        hashed = hits.select("did", "rk", words(F.col("text")).alias("w"), "runs").select("did", "rk", shingle_hashes(F.col("w"), k).alias("all"), "runs")
        each = hashed.select("did", "rk", F.explode(F.transform("runs", _run(k))).alias("x")).select("did", "rk", "x.*")
        # written before the lookup, lest its filters compute the fingerprints again
        each = scratch.write(each.withColumn("sketches", F.expr(_sketches("part", "own", "get(starts, size(starts) - 1) - get(starts, 0)"))), f"sketches{k}")
        each = each.select("did", "rk", "n", "own", "part", "sketches", F.get("starts", F.lit(0)).alias("first"), F.explode("starts").alias("start"))
        at = F.col("start") - F.col("first")
        each = each.select("did", "rk", "n", "start", F.slice("part", at + 1, F.col("own")).alias("hashes"), F.get("sketches", at).alias("sketch"))
        found = each if found is None else found.unionByName(each)
    if found is None:
        found = base.select("did", "rk", F.lit(0).alias("n"), F.lit(0).alias("start"), F.array().cast("array<bigint>").alias("hashes"), F.lit(0).cast("long").alias("sketch")).limit(0)
    return _matches(found, items, threshold, scratch)


def _dense_starts(k: int):
    """Every start of a window of n words that has at least need of the places at."""
    end = F.greatest(F.lit(0), F.col("size") - F.col("n"))

    def around(i):
        low = F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - (F.col("n") - F.lit(k)))
        high = F.least(F.get("at", i), end)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), around)))


def _run(k: int):
    """A function from (n, starts) to (n, starts, own: the hashes of a window, part: those of the column all that the run's windows span)."""

    def run(x):
        own = F.least(x["n"] - k + 1, F.size("all"))
        first, last = F.get(x["starts"], F.lit(0)), F.get(x["starts"], F.size(x["starts"]) - 1)
        return F.struct(x["n"].alias("n"), x["starts"].alias("starts"), own.alias("own"), F.slice("all", first + 1, last - first + own).alias("part"))

    return run


def verify(windows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Fingerprints windows (did, rk, n, start, hashes), looks them up in the multi-index of the items and keeps the best verified one of each text and item."""
    return _matches(with_simhash(windows, "hashes", "sketch"), items, threshold)


def _matches(sketched: DataFrame, items: DataFrame, threshold: float, scratch: Scratch | None = None) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("sketch"), c).alias("value")) for i, c in enumerate(CUTS)))
    near = []
    for i, c in enumerate(CUTS):
        value = _block(F.col("sketch"), c)
        near += [F.struct(F.lit(i).alias("block"), value.bitwiseXOR(F.lit(flip).cast("long")).alias("value")) for flip in (0, *(1 << b for b in range(c[1] - c[0])))]
    items = items.withColumn("ik", F.xxhash64("n", "hashes"))
    index = items.select("ik", "n", F.col("sketch").alias("item_sketch"), F.explode(F.array(*near)).alias("k")).select("ik", "n", "item_sketch", "k.*")
    if scratch:  # many rows an item, so its size is checked by itself
        index = scratch.small(index, "index")
    asked = sketched.select("did", "rk", "n", "start", "hashes", "sketch", F.explode(keys).alias("k")).select("did", "rk", "n", "start", "hashes", "sketch", "k.*")
    distance = F.bit_count(F.col("sketch").bitwiseXOR(F.col("item_sketch")))
    # a pair is taken at the first block that finds it
    first = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(CUTS))):
        differ = F.bit_count(_block(F.col("sketch"), c).bitwiseXOR(_block(F.col("item_sketch"), c)))
        first = F.when(differ <= 1, F.lit(i)).otherwise(first)
    pairs = asked.join(index, ["n", "block", "value"]).filter((distance <= RADIUS) & (F.col("block") == first)).withColumn("distance", distance)
    pairs = pairs.join(items.select("ik", "item_id", F.col("hashes").alias("item_hashes")), "ik")
    common = common_weight(F.col("hashes"), F.col("item_hashes"))
    pairs = pairs.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("hashes") + F.size("item_hashes") - F.col("common")))
    best = F.max_by(F.struct("start", "n", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("b")
    found = pairs.filter(F.col("similarity") >= threshold).groupBy("did", "rk", "item_id").agg(best)
    return found.select(F.when(F.col("did") != NULL_ID, F.col("did")).alias("doc_id"), "rk", "item_id", F.col("b.start").alias("start"), F.col("b.n").alias("n_words"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs (all columns) that hold no benchmark item."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    gone = scratch.small(contaminated(docs, benchmark, threshold, scratch).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), "rk").distinct(), "gone")
    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("rk"))
    return row.join(gone, ["did", "rk"], "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.col("distance").cast("long").alias("distance"), "similarity")
