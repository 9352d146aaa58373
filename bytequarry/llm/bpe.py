"""Byte-level BPE by a segment tree over adjacent pair ranks.

The leaf of a position holds the rank of the pair that starts there, joined with the position; a
node holds the least of its children. So the root is the leftmost pair of the lowest rank. A merge
changes three leaves at most, each in logarithmic time, until no pair in the tree can be merged.

Defined results: null text counts as empty (no ids, empty decoded text); the strings of the
vocabulary's added tokens become those tokens, as in the library; texts of any length are encoded whole (a piece of
n bytes takes a tree of 4 n numbers at most); repeated rows repeat; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.common import map_batches, texts
from bytequarry.llm.tokens import BYTE_PIECES, UNUSUAL, byte_letters, vocabulary

NEVER = 1 << 62
SHIFT = 32
#: Pieces that a worker's cache holds before it starts anew (some 200 bytes each).
CACHED = 800_000


def merge(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """ids after all merges; pairs: (left, right) -> (rank, merged id)."""
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NEVER] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        if found := get((ids[i], ids[i + 1])):
            tree[size + i] = found[0] << SHIFT | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least

    while (root := tree[1]) != NEVER:
        i = root & ((1 << SHIFT) - 1)
        j = after[i]
        ids[i] = get((ids[i], ids[j]))[1]
        k = after[i] = after[j]
        ids[j] = -1
        if j < n - 1:
            put(j, NEVER)
        if k < n:
            before[k] = i
            found = get((ids[i], ids[k]))
            put(i, found[0] << SHIFT | i if found else NEVER)
        else:
            put(i, NEVER)
        if (h := before[i]) >= 0:
            found = get((ids[h], ids[i]))
            put(h, found[0] << SHIFT | h if found else NEVER)
    return [x for x in ids if x >= 0]


class Bpe(dict):
    """encode(text) and decode(ids) of a byte-level vocabulary file; ids are little-endian unsigned 32-bit. As a dict: the cache of pieces."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        import public_tokenizers

        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = np.array(merge([self.of_byte[b] for b in piece.encode()], self.pairs), "<u4").tobytes()
        return out

    def _plain(self, text: str) -> bytes:
        cut = self.pieces if UNUSUAL.search(text) else BYTE_PIECES.findall
        return b"".join(map(self.__getitem__, cut(text)))

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        if self.split is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._plain(p) for p in self.split(text) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", keep: bool = False) -> DataFrame:
    """Per document: n_tokens, ids_sha256 and, of the text decoded from the ids, decoded_sha256; with keep the ids and that text too."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = bpe(vocabulary(tokenizer))
        ids = [model.encode(t) for t in texts(batch)]
        back = [model.decode(x) for x in ids]
        arrays = [
            batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep:
            arrays, names = [*arrays, pa.array(ids, pa.binary()), pa.array(back, pa.string())], [*names, "ids", "decoded"]
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
