"""Byte-level BPE encoding and decoding by a tree reduction.

The pattern cuts a text into pieces, which are encoded apart.  A piece is encoded by halves, down to leaves of ``LEAF`` bytes that are merged directly; two
neighbours are joined by encoding a window of tokens around their boundary anew, which grows on either side until its outer token and the first token outside are
*stable*: the two, encoded as one string, give themselves.  A sequence whose neighbours are all stable is the encoding of its bytes: were there a first merge
across two of its tokens, all merges before it would have stayed within tokens, so those two alone would have been merged in the same order and across too.  So the
join equals the encoding of the whole, and it is associative, which is why a piece of any length needs windows instead of a pass over all its bytes for each merge.
Decoding concatenates the bytes of the tokens up a tree in the same way.

Defined cases: null or empty text has no ids and decodes to no bytes; rows are encoded one by one, whatever their doc_id (null too), repeated ones too; texts and pieces of
any length are encoded whole; of equal ranks the leftmost pair is merged first; an id outside the vocabulary raises; other columns, whatever their names, don't matter; an
empty table gives an empty table.
"""
from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CUTS, MEMO_CHARS, MEMO_PIECES, PLAIN, vocabulary
from .util import slices, slim

#: Bytes that are merged directly.
LEAF = 16
#: Pairs whose stability one worker remembers; beyond that it starts anew.
MEMO_PAIRS = 200_000
#: Tokens that are one leaf of the tree of decoding.
DECODE_LEAF = 512
_open: dict[str, "ByteBPE"] = {}


class ByteBPE:
    """ranks: the id of each token's bytes; a lower id is merged first.  Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        import regex

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
            self.plain = PLAIN.fullmatch  # texts that this pattern cuts as CUTS["byte"] does
        else:
            self.plain = lambda text: None
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        self.cut, self.quick = regex.compile(pattern).findall, CUTS["byte"].findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The ids of raw by merging the lowest pair, of equal ones the leftmost, until none is left."""
        ranks, n = self.ranks, len(raw)
        part = [raw[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, 2) for k in range(n - 1) if (r := ranks.get(raw[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            right = after[k]
            if part[k] is None or right >= n or len(part[k]) + len(part[right]) != size:
                continue  # one of the two has been merged since
            part[k], part[right] = part[k] + part[right], None
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if (r := ranks.get(part[k] + part[right])) is not None:
                    heapq.heappush(heap, (r, k, len(part[k]) + len(part[right])))
            if (left := before[k]) >= 0 and (r := ranks.get(part[left] + part[k])) is not None:
                heapq.heappush(heap, (r, left, len(part[left]) + len(part[k])))
        return [ranks[p] for p in part if p is not None]

    def stable(self, a: int, b: int) -> bool:
        """Whether the tokens a and b, encoded as one string, give a and b."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of left and right from the encodings of both."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))
            grow_left = i < len(left) and not self.stable(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:-i] + window + right[j:]
            i, j = min(len(left), i * 2) if grow_left else i, min(len(right), j * 2) if grow_right else j

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.merged(raw)
        half = 1 << (len(raw) - 1).bit_length() - 1  # a power of two, so that long runs of one character are cut where their tokens end
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def piece(self, text: str) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers; a piece that is a token is that token."""
        raw = text.encode()
        found = self.ranks.get(raw)
        ids = np.array([found] if found is not None else self.tree(raw), "<u4").tobytes()
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        pieces = self.quick(text) if self.plain(text) else self.cut(text)
        known = self.memo
        return b"".join([known.get(p) or self.piece(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        found = array("I", ids) if isinstance(ids, bytes) else ids
        token = self.token.__getitem__
        parts = [b"".join(map(token, found[k : k + DECODE_LEAF])) for k in range(0, len(found), DECODE_LEAF)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a line for each, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def coder(vocab: str, pattern: str | None = None) -> ByteBPE:
    """The worker's own coder for a vocabulary, loaded once; a bare name is looked up where the task runs."""
    if (key := f"{vocab}\n{pattern}") not in _open:
        _open[key] = ByteBPE(read_ranks(vocabulary(vocab)), pattern)
    return _open[key]


def encode_texts(docs: DataFrame, vocab: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of each row; no shuffle."""

    def run(batches):
        bpe = coder(vocab, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.record_batch([part.column("doc_id"), n, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return slim(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(rows: DataFrame, vocab: str) -> DataFrame:
    """doc_id, ids, decoded (the bytes of the tokens) of each row; null ids decode to no bytes."""

    def run(batches):
        bpe = coder(vocab)
        for batch in batches:
            for part in slices(batch):
                decoded = pa.array([bpe.decode(x) for x in part.column("ids").to_pylist()], pa.binary())
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), decoded], names=["doc_id", "ids", "decoded"])

    ids = F.coalesce(F.col("ids").cast("binary"), F.lit(b"")).alias("ids")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    vocab = "byte_bpe_multi_50k.tiktoken"
    decoded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), vocab), vocab)
    n_tokens = F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens")
    return decoded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
