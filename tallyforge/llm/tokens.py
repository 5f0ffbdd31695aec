"""Ids by the tokenizers library, with one model call for many distinct pre-tokens.

Texts in Latin letters are cut into the vocabulary's pre-tokens here; every
distinct one goes through the library's model once and its ids are kept in a
bounded table. Other texts are cut into chunks where no pre-token can reach
across: at white space, or, where a pre-token may start with a space, before
each space that a visible character follows; chunks in other scripts go through
the library. Texts with unusual white space or the name of a special token go
through the library whole. The ids are those of a plain ``encode`` of the text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: White space on which Python and the libraries' patterns may not agree.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")
_BEFORE_SPACE = re.compile(r"(?= [^\t-\r ])")


#: Letters and numbers up to U+017F, where all libraries agree on both; İ is left out, as its lower case is two code points.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_FOREIGN = re.compile("[^\0-\u012f\u0131-\u017f]")
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pre-tokens of the two public patterns, for such text.
_SPACED = re.compile(rf"{_CONTRACTED}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORDS = re.compile(rf"{_CONTRACTED}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: visible bytes stand for themselves, the rest follow from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in visible else next(other)) for b in range(256)]


class ChunkEncoder:
    """Encodes texts with the tokenizer file at `path`, as its plain encode() does without special tokens.

    The name of a special token in a text becomes that token's id, as the
    library does by default; such texts go through the library whole.

    limit: pieces, and chunks in other scripts, that are remembered; longest: code
    points of the longest of them. Beyond `limit` a table starts anew.
    """

    def __init__(self, path: str, limit: int = 600_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.longest = Tokenizer.from_file(path), limit, longest
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.spaced = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.letters = "".join(_byte_letters())
        self.separator = self._separator(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or r"(?!)", re.IGNORECASE)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _separator(self, path: str) -> int | None:
        """The id of byte 255, which no text holds, if no merge can reach across it and words have no end mark."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        mark = self.letters[255]
        merges = (m if isinstance(m, str) else "".join(m) for m in model.get("merges", ()))
        if model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or any(mark in m for m in merges):
            return None
        return model["vocab"].get(mark)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _made(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens; a thousand at a time go through the model as one word, cut by the separator."""
        if self.separator is None:
            return {p: array(self.code, [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]).tobytes() for p in pieces}
        made, width = {}, self.dtype.itemsize
        for at in range(0, len(pieces), 1000):
            part = pieces[at : at + 1000]
            word = b"\xff".join(map(str.encode, part)).decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(word)], self.dtype)
            data, begin = ids.tobytes(), 0
            for piece, end in zip(part, [*(np.flatnonzero(ids == self.separator) * width).tolist(), len(data)], strict=True):
                made[piece] = data[begin:end]
                begin = end + width
        return made

    def _latin(self, text: str) -> bytes:
        found = _SPACED.findall(text) if self.spaced else _WORDS.findall(text.lower())
        held, distinct = self.pieces, set(found)
        missing = distinct.difference(held)
        if missing:
            if len(held) + len(missing) > self.limit:
                held.clear()
                missing = distinct
            held.update(self._made(list(missing)))
        data = b"".join(map(held.__getitem__, found))
        for piece in missing:
            if len(piece) > self.longest:
                del held[piece]
        return data

    def _chunk(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = self._library(chunk) if _FOREIGN.search(chunk) else self._latin(chunk)
            if len(chunk) <= self.longest:
                if len(self.chunks) >= self.limit:
                    self.chunks.clear()
                self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of text, little-endian of self.dtype."""
        if self.special.search(text) or _UNUSUAL.search(text):
            return self._library(text)
        if not _FOREIGN.search(text):
            return self._latin(text)
        if not self.spaced:
            return b"".join(map(self._chunk, text.split()))
        return b"".join(map(self._chunk, _BEFORE_SPACE.split(text)))


@lru_cache(4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each process."""
    return ChunkEncoder(path)
