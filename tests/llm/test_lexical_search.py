"""Ranked search against brute force over all documents."""
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from test_text_operators import ODD, SCHEMA, SF

from meshwork.llm import lexical_search

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(d, Counter(term.findall((t or "").translate(LOW)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item, text in items:
        asked, scores = term.findall((text or "").translate(LOW)), []
        for d, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("postings,docs", [(1 << 19, 1 << 15), (300, 1 << 15), (1 << 19, 7), (1, 1)])
def test_random_texts(spark, postings, docs):
    r = random.Random(postings + docs)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 60}"
    table = [(d, " ".join(word() for _ in range(r.randrange(40)))) for d in range(300)]
    table += [(1000 + d, table[d % 3][1]) for d in range(40)]  # copies: ties at the k-th place
    items = [(i, " ".join(word() for _ in range(r.randrange(12)))) for i in range(30)] + [(90, "w1 w1 w2 w1"), (91, "nowhere")]
    got = lexical_search.search(spark.createDataFrame(table, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 6, postings=postings, shard_docs=docs)
    assert rows(got) == brute(table, items, 6)


def test_documents_are_skipped():
    r = random.Random(2)
    shard = lexical_search.Shard()
    for d in range(3000):
        shard.add(d, 10, {"often": 1} | ({"rare": 1 + r.randrange(3)} if d % 100 == 0 else {}))
    heap, index = [], shard.inverted(3000, 30000)
    scored = lexical_search.wand([("often", 1), ("rare", 4000)], index, shard.ids, heap, 5)
    # all documents until five hold the rare term, then only those that hold it
    assert scored == 401 + 25 and len(heap) == 5


def test_whole_table_and_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows(lexical_search.query(spark, SF))
    assert got == sorted(con.sql(lexical_search.SQL).fetchall(), key=str) == brute(docs, items)


def test_odd_rows_and_blocks(spark):
    table = [(i, t, "s", i, "k", "h") for i, t in enumerate(ODD)] + [(None, "quick fox", None, None, None, None), (None, None, None, None, None, None), (3, "FOX fox É", "s", 1, "k", "h"), (3, "dog", "s", 1, "k", "h")]
    items = [(1, "the quick fox"), (2, None), (3, ""), (4, "é É 日本語 x"), (5, "fox"), (5, "fox"), (None, "lazy DOG"), (6, "... !")]
    docs, asked = spark.createDataFrame(table, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = brute([(d, t) for d, t, *_ in table], sorted(set(items), key=str))
    assert rows(lexical_search.search(docs, asked)) == want
    assert rows(lexical_search.search(docs, asked, query_bytes=8)) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert lexical_search.search(empty, asked).count() == 0
    out = lexical_search.search(docs, asked.limit(0))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
