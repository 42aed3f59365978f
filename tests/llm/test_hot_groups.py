"""The ways for hot lines and for small snapshots of large batches."""
import pytest
from pyspark.sql import functions as F
from test_text_operators import LONG, SCHEMA, brute_lines, texts

from meshwork.llm import exact_dedup, line_dedup, util


def line_rows(df):
    import hashlib

    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in line_dedup.dedup_lines(df).collect()), key=str)


@pytest.mark.parametrize("hot_rows", [10, 1000])
def test_a_line_in_every_document_without_broadcasts(spark, monkeypatch, hot_rows):
    rows = [(i, f"{LONG}\n{'x' * 50}{i % 40}\n{LONG} {i}\n{LONG}", "s", 1, "k", "h") for i in range(400)] + [(None, LONG, None, None, None, None), (5, LONG, "s", 1, "k", "h")]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(util.Scratch, "fits", lambda self, df, table, limit=0: False)
    monkeypatch.setattr(util, "HOT_ROWS", hot_rows)
    assert line_rows(df) == brute_lines(texts(df))


@pytest.mark.parametrize("old", [0, 3, 900])
def test_a_small_snapshot_of_a_large_batch(spark, monkeypatch, old):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 50)
    df = spark.createDataFrame([(i, f"text {i % 800}") for i in range(2000)], "doc_id long, text string")
    scratch = util.Scratch(spark, "test")
    rows = exact_dedup.digests(df).drop("norm")
    snapshot = exact_dedup.Snapshot(rows.filter(f"doc_id < {old}"), scratch, "first")
    batch = scratch.write(exact_dedup._groups(rows.filter(f"doc_id >= {old}")), "batch")
    keys, filters = snapshot.dealt(batch)
    assert max(r["count"] for r in keys.groupBy("shard", "salt").count().collect()) <= 100
    assert filters.count() == (0 if not old else filters.select("shard").distinct().count() * max(1, -(-800 // (snapshot.shards * 50))))
    found = {r.digest for r in snapshot.screen(batch).filter("maybe").collect()}
    assert found >= {r.digest for r in snapshot.buckets.select("digest").intersect(batch.select("digest")).collect()}
    got = exact_dedup.exact_dedup(df, in_snapshot=F.col("doc_id") < old)
    assert sorted((r.keep_id, r.group_size) for r in got.select("keep_id", "group_size").distinct().collect()) == [(i, 3 if i < 400 else 2) for i in range(800)]
