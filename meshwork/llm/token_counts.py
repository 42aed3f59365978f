"""Greedy longest-match token counts by a linear automaton.

A vocabulary trie over bytes has, at each node, a failure link to the node of what remains after the longest pieces are popped
from the node's string, and the number of pieces so popped (Song et al., "Fast WordPiece Tokenization", 2021).  A word is read once, byte by byte; no
piece is built.  A piece that the vocabulary marks as ending a word ends in the symbol ``END``, which follows each word's bytes, so it matches at a word's end only;
END alone counts as no piece, so that an unmarked piece may also be a word's last one where no marked piece is as long.

A word is a maximal run of letters, digits and underscores, or any other single visible character, in lower case.  A word that no sequence of pieces covers counts as one
unknown piece.  Defined cases: null or empty text has 0 words and pieces; rows are counted one by one, whatever their doc_id, repeated ones too; a text or a word of any
length is read whole; the greedy piece is unique, so there are no ties; other columns, whatever their names, don't matter; an empty table gives an empty table.
"""
from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import byte_alphabet, vocabulary
from .util import slices, slim

#: Words whose counts one worker remembers; beyond that it starts anew.
MEMO_WORDS = 300_000
WORD = re.compile(r"\w+|[^\w\s]").findall
#: The symbol after a word's last byte.
END = 256
_open: dict[str, "LongestMatch"] = {}


class LongestMatch:
    """pieces: sequences of symbols (bytes, and END); the piece free counts nothing."""

    def __init__(self, pieces, free=None):
        child, final, parent, unpaid = [{}], [False], [(0, 0)], None
        for piece in pieces:
            v = 0
            for c in piece:
                if c not in child[v]:
                    child[v][c] = len(child)
                    child.append({})
                    final.append(False)
                    parent.append((v, c))
                v = child[v][c]
            final[v] = v > 0
            unpaid = v if piece == free else unpaid
        self.child, self.fail, self.pops = child, [-1] * len(child), [0] * len(child)
        queue = list(child[0].values())
        for v in queue:  # breadth first: shorter strings are done before longer ones
            queue.extend(child[v].values())
            if final[v]:
                self.fail[v], self.pops[v] = 0, int(v != unpaid)
                continue
            u, c = parent[v]
            z, n = self.fail[u], self.pops[u]
            while z >= 0 and c not in child[z]:
                z, n = self.fail[z], n + self.pops[z]
            if z >= 0:
                self.fail[v], self.pops[v] = child[z][c], n

    def count(self, symbols) -> int:
        """The number of greedy pieces; 0 if they cannot cover the word."""
        child, fail, pops, v, n = self.child, self.fail, self.pops, 0, 0
        for c in symbols:
            while c not in child[v]:
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return 0
            v = child[v][c]
        while v:
            n += pops[v]
            v = fail[v]
            if v < 0:
                return 0
        return n


def pieces_of(path: str) -> set[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file (one that ends a word is marked with </w> there and with END here)."""
    byte = {c: b for b, c in byte_alphabet().items()}
    out = set()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    for piece in vocab:
        body = piece.removesuffix("</w>")
        if body and all(c in byte for c in body) and not piece.startswith("<|"):
            out.add((*(byte[c] for c in body), *([END] if body != piece else [])))
    return out


class Counter:
    def __init__(self, path: str):
        self.automaton, self.memo = LongestMatch(pieces_of(vocabulary(path)) | {(END,)}, (END,)), {}

    def counts(self, text: str) -> tuple[int, int, int, int]:
        """Words, pieces, unknown words, pieces of the longest word."""
        words = WORD(text.lower())
        memo = self.memo
        miss = set(words).difference(memo)
        if len(memo) + len(miss) > MEMO_WORDS:
            memo.clear()
            miss = set(words)
        for w in miss:
            memo[w] = self.automaton.count((*w.encode("utf-8", "replace"), END))
        found = list(map(memo.__getitem__, words))
        unknown = found.count(0)
        return len(found), sum(found) + unknown, unknown, max(found, default=0)


def count_tokens(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown, longest of each row; no shuffle."""

    def run(batches):
        if vocab not in _open:
            _open[vocab] = Counter(vocab)
        counter = _open[vocab]
        for batch in batches:
            for part in slices(batch):
                rows = [counter.counts(t) for t in part.column("text").to_pylist()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.record_batch([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_tokens", "n_unknown", "longest"])

    return slim(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long, longest long")


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    return count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
