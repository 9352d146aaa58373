"""Token ids by the tokenizers library, one call for each distinct piece instead of each text.

A text is cut where the library itself cuts before its merges, so that the ids of a piece do not
depend on its surroundings; a bounded cache keeps pieces' ids. A text with characters outside the
plain set below, or with what may be a special token, goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = " \\t\\n\\r\\x0b\\x0c"
#: Texts with any other character are not cut here.
UNUSUAL = re.compile("[^\\x00-\\x7f¡-¬®-įı-ſ–—‘-„…€]|<\\|")
#: The pieces of the two public vocabularies: words with a leading space, and words by themselves.
BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Pieces that a worker's cache holds before it starts anew.
CACHED = 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """ids(text): the text's ids as little-endian unsigned 32-bit integers. As a dict: the cache."""

    def __init__(self, path: str, words: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.words = Tokenizer.from_file(path), words
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = (WORD_PIECES if words else BYTE_PIECES).findall
        self.merged, self.letters = self.library.model.tokenize, {b: c for c, b in byte_letters().items()}

    def __missing__(self, piece: str) -> bytes:
        # a piece needs the library's merges alone: its bytes' letters go to the model itself
        found = self.merged(piece.encode().decode("latin-1").translate(self.letters))
        out = self[piece] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        # of plain ASCII, which is soon told, only what may be a special token is unusual
        if "<|" in text if text.isascii() else UNUSUAL.search(text):
            return self.whole(text)
        if len(self) > CACHED:
            self.clear()
        return b"".join(map(self.__getitem__, self.cut(text.lower() if self.words else text)))


@lru_cache(maxsize=4)
def encoder(path: str, words: bool) -> Encoder:
    """The process's own encoder of a vocabulary file; words: it lower-cases and drops white space."""
    return Encoder(path, words)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
