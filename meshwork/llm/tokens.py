"""Exact token ids of the public BPE vocabularies, through a bounded memo of text pieces.

The pre-tokenizer of either vocabulary cuts a text into pieces that are encoded independently.  Texts whose
characters all lie in a range where the cut is known are cut here with ``re``; a piece that the memo lacks is encoded by the
model of the tokenizers library.  Any other text goes to the library whole.
"""
from __future__ import annotations

import os
import re
import unicodedata
from array import array

#: Pieces kept in the memo of one worker (about 120 MB); it starts anew after as many lookups in vain since it was full.
MEMO_PIECES = 500_000
#: Longer pieces are not kept.
MEMO_CHARS = 64
_open: dict[tuple[str, str], "Tok"] = {}


def vocabulary(name: str) -> str:
    """The place of a vocabulary file on this machine: a path as it is, a bare name from the installed public vocabularies."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> tuple[str, str, str]:
    out = {"L": [], "N": [], "O": []}
    for c in range(0x21, 0x250):
        kind = unicodedata.category(chr(c))[0]
        if c != 0x130 and kind in "LNPS":
            out[kind if kind in "LN" else "O"].append(re.escape(chr(c)))
    return "".join(out["L"]), "".join(out["N"]), "".join(out["O"])


LETTERS, DIGITS, OTHER = _classes()
PLAIN = re.compile(f"[\t\n\r {LETTERS}{DIGITS}{OTHER}]*")
CUTS = {
    "byte": re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\\s{LETTERS}{DIGITS}]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+"),
}


class Memo(dict):
    """Piece to ids, as bytes."""

    def __init__(self, model, byte_chars: dict[int, str]):
        self.model, self.chars, self.vain = model, byte_chars, 0

    def __missing__(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.chars))
        ids = array("I", [t.id for t in found]).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) < MEMO_PIECES:
                self[piece] = ids
            else:
                self.vain += 1
                if self.vain > MEMO_PIECES:
                    self.clear()
                    self.vain = 0
        return ids


def byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tok:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kind, self.cut = Tokenizer.from_file(path), kind, CUTS[kind].findall
        self.size, self.memo = self.tok.get_vocab_size(), Memo(self.tok.model, byte_alphabet())

    def _one(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.memo.__getitem__, self.cut(text.lower() if self.kind == "word" else text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return [self._one(t) for t in texts]


def tokenizer(path: str, kind: str) -> Tok:
    """The worker's own tokenizer for a vocabulary, loaded once; a bare name is looked up where the task runs."""
    if (path, kind) not in _open:
        _open[path, kind] = Tok(vocabulary(path), kind)
    return _open[path, kind]
