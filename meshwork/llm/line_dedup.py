"""Line de-duplication across documents (DataFrame functions only).

Lines are normalised (white space stripped at both ends, A-Z lower-cased) and hashed to 128 bits; a hash that at least
``min_docs`` documents hold loses its lines everywhere but in the document with the largest doc_id that holds it; the other lines are joined again by position.

Defined cases: null or empty text is one empty line; rows that repeat a doc_id are one document, which counts once for a line and, where it is the holder, keeps the
line in all its rows; all rows with a null doc_id are one document, which orders before every other; of equal lines in the holder all stay (ties need no order); texts
of any length are cut whole; an empty table gives an empty table; other columns of the input, whatever their names, don't matter.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import NULL_ID, Scratch, ascii_lower, hot_join, slim

BLANKS = " \t\n\x0b\x0c\r"


def _key(line):
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _hashes(key):
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, scratch: Scratch) -> DataFrame:
    """did, rk (the hash of the text) and the positions of the lines to drop, for the rows that lose any.

    Two passes over the text: one counts hashes (pre-aggregated before its shuffle), one marks positions.  The over-frequent
    hashes and then the marked positions are broadcast only if their written size is small, else joined by a shuffle, the places of a line that is in very many documents by a salt.
    """
    lines = F.split("text", "\n", -1)
    base = _keyed(slim(docs))
    long_keys = F.filter(F.transform(F.filter(lines, lambda x: F.length(x) >= min_chars), _key), lambda x: F.length(x) >= min_chars)
    once = base.select("did", F.explode(F.array_distinct(long_keys)).alias("key")).select("did", *_hashes(F.col("key")))
    held_by = once.groupBy("h1", "h2", "did").agg(F.lit(1).alias("one"))  # rows that repeat a doc_id are one document
    often = held_by.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("did").alias("holder")).filter(F.col("n") >= min_docs).select(F.struct("h1", "h2").alias("line"), "holder", "n")
    often = scratch.write(often, "often")
    held = base.select("did", "rk", F.posexplode(lines).alias("pos", "line")).filter(F.length("line") >= min_chars)
    held = held.withColumn("key", _key(F.col("line"))).filter(F.length("key") >= min_chars).select("did", "rk", "pos", F.struct(*_hashes(F.col("key"))).alias("line"))
    found = held.join(F.broadcast(often), "line") if scratch.fits(often, "often") else hot_join(held, often, "line", "n")
    gone = found.filter(F.col("did") != F.col("holder")).groupBy("did", "rk").agg(F.collect_set("pos").alias("gone"))
    return scratch.small(gone, "gone")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("did", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("rk", F.xxhash64("text"))


def _kept(text, gone):
    """The text without the lines at the positions in gone (null: all stay)."""
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_text of each row of docs."""
    gone = dropped_lines(docs, min_chars, min_docs, scratch or Scratch(docs.sparkSession, "lines"))
    out = _keyed(slim(docs)).join(gone, ["did", "rk"], "left")
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped")
    return out.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), n_dropped, _kept(F.col("text"), F.col("gone")).alias("kept_text"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """The rows and columns of docs, each text without its dropped lines (n_chars, if there is one, is counted anew for these)."""
    gone = dropped_lines(docs, min_chars, min_docs, scratch or Scratch(docs.sparkSession, "lines"))
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = _kept(F.col("text"), F.col("gone"))
    out = F.col("row").withField("text", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast("long")))
    return _keyed(row).join(gone, ["did", "rk"], "left").select(out.alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, i AS pos, n, string_split(t, chr(10))[i] AS line
  FROM (SELECT doc_id, t, len(string_split(t, chr(10))) AS n, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), often AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.n, k.pos, k.line, (o.key IS NOT NULL AND k.doc_id <> o.holder) AS gone FROM k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, max(n)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
