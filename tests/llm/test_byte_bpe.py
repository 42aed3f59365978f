"""Byte-level BPE by a tree reduction against the library."""
import hashlib
import random

import pytest
from test_text_operators import ODD, SCHEMA, SF

from meshwork.llm import byte_bpe
from meshwork.llm.tokens import vocabulary

VOCAB = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(vocabulary(VOCAB))


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return list(memoryview(raw).cast("I"))


def plain_merges(ranks, raw):
    part = [raw[k : k + 1] for k in range(len(raw))]
    while True:
        found = min(((ranks.get(part[k] + part[k + 1], 1 << 40), k) for k in range(len(part) - 1)), default=(1 << 40, 0))
        if found[0] == 1 << 40:
            return [ranks[p] for p in part]
        part[found[1] : found[1] + 2] = [part[found[1]] + part[found[1] + 1]]


def test_tree_equals_the_library(ranks, library):
    bpe, r = byte_bpe.ByteBPE(ranks), random.Random(3)
    for alphabet in ("a", "ab", "abc ", "thingers", "日本語中文", "🙂👍🏽é", " \n\t\x1c\x85", "0123", "=-"):
        for size in (0, 1, 16, 17, 33, 64, 100, 257, 1000, 4000):
            text = "".join(r.choice(alphabet) for _ in range(size))
            got = bpe.encode(text)
            assert ids(got) == library.encode_ordinary(text)
            assert bpe.decode(got) == text.encode()
    long = "x" * 200_000
    assert ids(bpe.encode(long)) == library.encode_ordinary(long)


def test_any_split_joins_to_the_whole():
    r = random.Random(5)
    for _ in range(60):  # small made-up vocabularies whose merges reach far
        tokens = {bytes([c]): k for k, c in enumerate(b"abc")}
        while len(tokens) < 25:
            new = r.choice(list(tokens)) + r.choice(list(tokens))
            tokens.setdefault(new, len(tokens))
        bpe = byte_bpe.ByteBPE(tokens)
        for _ in range(20):
            raw = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 40)))
            whole = plain_merges(tokens, raw)
            assert bpe.merged(raw) == bpe.tree(raw) == whole
            cut = r.randrange(len(raw) + 1)
            assert bpe.join(plain_merges(tokens, raw[:cut]), plain_merges(tokens, raw[cut:])) == whole


def test_query_equals_the_library(spark, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = byte_bpe.query(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(rows[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, library):
    rows = [(i, t, "s", i, "k", "h") for i, t in enumerate(ODD)] + [(1, "twice", None, None, None, None), (1, "twice", None, None, None, None), (None, "no id", None, None, None, None)]
    out = byte_bpe.encode_texts(spark.createDataFrame(rows, SCHEMA), VOCAB)
    assert sorted((str(r.doc_id), r.n_tokens, ids(bytes(r.ids))) for r in out.collect()) == sorted((str(d), len(library.encode_ordinary(t or "")), library.encode_ordinary(t or "")) for d, t, *_ in rows)
    back = byte_bpe.decode_ids(out, VOCAB)
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back.collect()) == sorted((str(d), t or "") for d, t, *_ in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(empty, VOCAB), VOCAB).count() == 0
