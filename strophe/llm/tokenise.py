"""Byte-level BPE ids of whole texts, by the tokenizers library, with a cache of the ids of space-delimited pieces.

A byte-level BPE splits text before merging, and a single space before a non-space always begins a new split: what stands
between two such places can be encoded on its own. Pieces repeat (Zipf), so a worker looks most of them up. A text with
runs of white space, or with an added token's string in it, goes to the library as a whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex

#: The split of byte-level BPE (fixed value of the public vocabulary's pre-tokenizer).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space that is not followed by a non-space: the pieces' boundaries do not hold there.
RUNS = re.compile(r" (?=\s|$)")
#: White space on which regular-expression libraries differ: such a piece goes to the library.
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
#: Most pieces that a worker keeps; further ones are encoded each time.
CACHED = 400_000


def _byte_chars() -> dict[int, str]:
    """Byte -> printable stand-in, as byte-level vocabularies have it: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """piece -> ids of it with a space before it, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chars = _byte_chars()
        self.space = self.chars[32]
        self.others: dict[str, bytes] = {}
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """ids of one split, by the library's BPE model."""
        return self.form(word.encode().decode("latin-1").translate(self.chars))

    def form(self, form: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(form)]).tobytes()

    def split(self, split: str) -> bytes:
        if split[0] == " " and split[1:].isalpha():
            return self[split[1:]]
        ids = self.others.get(split)
        if ids is None:
            ids = self.word(split)
            if len(self.others) < CACHED // 8:
                self.others[split] = ids
        return ids

    def pieces(self, text: str) -> bytes:
        return self.whole(text) if ODD.search(text) else b"".join(map(self.split, SPLIT.findall(text)))

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            ids = self.form(self.space + piece) if piece.isascii() else self.word(" " + piece)
        elif piece[-1] in ".,;:" and piece[:-1].isalpha():
            return self[piece[:-1]] + self.split(piece[-1])
        else:
            ids = self.pieces(" " + piece)
        if len(self) < CACHED:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """ids of the whole text, as bytes; null is taken as empty."""
        if not text:
            return b""
        if RUNS.search(text) or (self.added and self.added.search(text)):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.pieces(first) if first else b"") + b"".join(map(self.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
