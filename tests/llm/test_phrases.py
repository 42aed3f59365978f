"""Collocations against brute force and SQL."""
import random
import re
from collections import Counter

import duckdb
import pytest
from test_text_operators import ODD, SF

from meshwork.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, max_words=3, min_count=10, cover=50, top=2000):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    longer = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    out = []
    for lang in total:
        best = []
        for (g, w), a in cand.items():
            if g == lang and not (longer[lang, w] and 100 * longer[lang, w] >= cover * a):
                score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                best.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, total[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "Über", "x-1", "日本", f"w{int(r.paretovariate(0.6)) % 25}"])
    return [(i, "".join(word() + r.choice([" ", " ", " ", "\t", "  ", ", ", "\n"]) for _ in range(r.randrange(60))), r.choice(["en", "en", "de", None, ""])) for i in range(n)]


@pytest.mark.parametrize("seed,max_words,min_count,cover,top", [(1, 3, 10, 50, 2000), (2, 2, 3, 50, 7), (3, 4, 3, 80, 2000), (4, 5, 2, 20, 50)])
def test_random_texts(spark, seed, max_words, min_count, cover, top):
    docs = corpus(seed)
    got = phrases.collocations(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), max_words, min_count, cover, top)
    assert rows(got) == brute([(lang, t) for _, t, lang in docs], max_words, min_count, cover, top)


def test_collisions_and_small_chunks_change_nothing(spark):
    docs = corpus(9)
    want = brute([(lang, t) for _, t, lang in docs], 4, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    assert rows(phrases.collocations(df, 4, 4, buckets=1 << 6, chunk=50, chunk_words=30, worker_words=10)) == want
    assert rows(phrases.collocations(df, 4, 4, buckets=1 << 17)) == want


def test_products_beyond_64_bits(spark):
    a, l, r = 3_000_000_000_001, 5_000_000_000_003, 4_000_000_000_007
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    exact = "cast(1000000 * cast(a AS decimal(38, 0)) * a AS decimal(38, 0)) div cast(cast(l AS decimal(38, 0)) * r AS decimal(38, 0))"
    from pyspark.sql import functions as F

    assert df.select(F.expr(exact).cast("long")).first()[0] == 10**6 * a * a // (l * r)


def test_pruning_is_effective(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = b".".join((r.text or "").encode().translate(phrases.TEXT_BYTES) for r in docs.collect())
    import numpy as np

    none = phrases.Pass(2, np.full(phrases.BUCKETS // 8, 255, np.uint8), np.full(phrases.BUCKETS // 8, 255, np.uint8), 10, 0)
    every = len(none.count("en", none.numbers(texts))[0])
    first = phrases.Pass(1, None, None, 10, phrases.BUCKETS)
    found, h, n = first.count("en", first.numbers(texts))
    bits = np.zeros(phrases.BUCKETS, bool)
    bits[(h[n >= 10] & np.uint64(phrases.BUCKETS - 1)).astype(np.int64)] = True
    second = phrases.Pass(2, np.packbits(bits, bitorder="little"), np.packbits(first.seen >= 10, bitorder="little"), 10, 0)
    kept, _, n = second.count("en", second.numbers(texts))
    assert len(kept) < every / 5 and (n >= 10).mean() > 0.9


def test_whole_table_and_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = rows(phrases.query(spark, SF))
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.SQL})").fetchall()) == brute(docs)


def test_odd_rows(spark):
    docs = [(i, t, None, "k", "h") for i, t in enumerate(ODD)] + [(None, "a b a b a b " * 30, "en", "k", None)] * 2 + [(1, "a b. c a b; a", "en", None, None), (2, None, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, phrase string, n string")
    assert rows(phrases.collocations(df, 3, 2)) == brute([(lang, t) for _, t, lang, *_ in docs], 3, 2)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(empty).count() == 0
