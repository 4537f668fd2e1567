"""Ids of the lower-casing word-end BPE vocabulary, with the library's model called once per new word."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from .common import vocabulary

#: Entries a worker remembers; the memory is emptied when it is full. Longer stretches are not remembered.
REMEMBER = 250_000
LONG = 64
#: The pre-tokenizer's split pattern of the vocabulary file, spelled out for lower-case Latin-1 text.
PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc\xbd\xbe]"
    "|[^\t\n\v\f\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc\xbd\xbe]+")


@cache
def library(name: str):
    """The library's tokenizer, one per worker, without threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of whole texts, equal to the library's, as little-endian 32-bit bytes.

    No token of this vocabulary contains white space: the normaliser turns it into blanks, the split
    pattern drops it and special strings have none. A text's ids are therefore those of its
    blank-separated stretches, one after the other, and a stretch seen before needs no second call.
    Latin-1 texts without special strings are lower-cased first, which the normaliser does anyway
    (nothing in Latin-1 composes), and their new stretches go to the library's BPE model piece by
    piece. Any other stretch goes through the library's full encoder.
    """

    def __init__(self, name: str) -> None:
        self.tokenizer = library(name)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.other: dict[str, bytes] = {"": b""}

    def piece(self, piece: str) -> bytes:
        coded = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        ids = np.array([t.id for t in self.model.tokenize(coded)], "<u4").tobytes()
        if len(self.pieces) >= REMEMBER:
            self.pieces.clear()
        if len(piece) <= LONG:
            self.pieces[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        known = self.pieces
        return b"".join([known.get(p) or self.piece(p) for p in PIECE.findall(word)])

    def encode(self, text: str) -> bytes:
        simple = "<|" not in text
        if simple:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                simple = False
        if simple:
            stretches, known, new = text.lower().replace("\n", " ").split(" "), self.words, self.word
        else:
            stretches, known = text.replace("\n", " ").split(" "), self.other
            new = lambda w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if len(known) >= REMEMBER:
            known.clear()
        own: dict[str, bytes] = {}
        for w in set(stretches).difference(known):
            (known if len(w) <= LONG else own)[w] = new(w)
        if not own:
            return b"".join(map(known.__getitem__, stretches))
        return b"".join([own[w] if w in own else known[w] for w in stretches])


@cache
def word_ids(name: str) -> WordIds:
    return WordIds(name)
