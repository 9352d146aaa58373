"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the 32-bit hashes of its words, of their stems (the first STEM letters of longer
words), of word pairs and triples, and of pairs with one word between, each counted once. FTRL-proximal gives each coordinate its own rate, and its L1 term
leaves most weights at exactly zero, so the model is a short list of weights that is broadcast.

Defined results: null text counts as empty and scores by the bias alone, as do texts without a
weighted feature; without labels the score is 0; rows with a null label or null doc_id are not
learned from; a doc_id with several label rows counts as toxic if one of them says so; repeated
rows repeat; texts of any length are scored whole, in chunks of texts of about CHUNK characters; columns
other than doc_id and text are not read, and none is lost by its name. Learning takes whole texts of a sample
of about `fit_rows` labelled rows, drawn by a hash of the id, which one task holds and learns from;
the bound is a parameter, the scores are for all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.common import given_back, texts, unused

#: Expected labelled rows to learn from.
FIT_ROWS = 12_000
#: Weights that a model may have (12 bytes each): with more, L1 is doubled and the model learned anew.
MAX_WEIGHTS = 200_000
#: Letters of a stem.
STEM = 5
WORD = re.compile(r"[^\W_]+")
CACHED = 100_000
CHUNK = 1 << 20


class _Words(dict):
    """A worker's cache: a number for each word, and by it the hashes of the word and of its stem (0 where it is shorter than one)."""

    def __init__(self) -> None:
        self.word, self.stem = np.zeros(4096, np.uint64), np.zeros(4096, np.uint64)

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        if out == len(self.word):
            self.word, self.stem = (np.concatenate([x, np.zeros(len(x), np.uint64)]) for x in (self.word, self.stem))
        self.word[out] = xxhash.xxh3_64_intdigest(word)
        self.stem[out] = xxhash.xxh3_64_intdigest("stem " + word[:STEM]) if len(word) >= STEM else 0
        return out


_words = _Words()


def features(chunk: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit feature hashes of the texts, repeats included, and the number of the text of each."""
    if len(_words) > CACHED:
        _words.clear()
    lists = [WORD.findall(t.lower()) for t in chunk]
    sizes = np.array([len(x) for x in lists], np.int64)
    at = np.fromiter(map(_words.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    h, stems = _words.word[at], _words.stem[at]
    owner = np.repeat(np.arange(len(chunk)), sizes)
    found, owners = [h, stems[stems > 0]], [owner, owner[stems > 0]]
    for kind, offsets in ((1, (1,)), (2, (1, 2)), (3, (2,))):
        n = len(h) - offsets[-1]
        if n <= 0:
            continue
        g = h[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)
        for o in offsets:
            g = ((g ^ (g >> np.uint64(31))) + h[o : o + n]) * np.uint64(0xBF58476D1CE4E5B9)
        same = owner[:n] == owner[offsets[-1] :]
        found.append(g[same])
        owners.append(owner[:n][same])
    return (np.concatenate(found) >> np.uint64(32)).astype(np.uint32), np.concatenate(owners)


def _chunks(batch_texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start, size = 0, 0
    for i, t in enumerate(batch_texts):
        if size and size + len(t) > CHUNK:
            yield start, batch_texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(batch_texts):
        yield start, batch_texts[start:]


@dataclass
class Model:
    """Ascending feature hashes with their weights."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    learned: bool = True

    def score(self, batch_texts: list[str]) -> np.ndarray:
        z = np.full(len(batch_texts), self.bias)
        if not self.learned:
            return np.zeros(len(batch_texts))
        if len(self.keys):
            # most features have no weight: a table of low bits turns them away before the search
            gate = np.zeros(1 << 22, bool)
            gate[self.keys & np.uint32((1 << 22) - 1)] = True
            for start, chunk in _chunks(batch_texts):
                found, owner = features(chunk)
                maybe = np.flatnonzero(gate[found & np.uint32((1 << 22) - 1)])
                found, owner = found[maybe], owner[maybe]
                at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
                hit = self.keys[at] == found
                once = np.unique(owner[hit] * len(self.keys) + at[hit])
                z[start : start + len(chunk)] += np.bincount(once // len(self.keys), self.weights[once % len(self.keys)], len(chunk))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def learn(rows: list[tuple[np.ndarray, int]], alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 6, least_docs: int = 4, weight: float = 3.0) -> Model:
    """FTRL-proximal over (unique feature hashes, label) in the given order, so many times over; weight: of a toxic row's gradient.

    The defaults were compared by four folds within the rows that may be learned from, never on held-out ones.
    """
    if not rows:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0, False)
    least_docs = min(least_docs, max(1, len(rows) // 8))
    # most features are rare: counts by their high bits turn them away before the sort, in little memory
    shared = np.zeros(1 << 24, np.uint16)
    for f, _ in rows:
        at = f >> np.uint32(8)
        shared[at] = np.minimum(shared[at], 65534) + 1
    rows = [(f[shared[f >> np.uint32(8)] >= least_docs], y) for f, y in rows]
    del shared
    flat = np.concatenate([f for f, _ in rows])
    keys, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    frequent = counts >= least_docs
    renumber = np.cumsum(frequent) - 1
    ends = np.cumsum([len(f) for f, _ in rows])
    index = [renumber[i[frequent[i]]] for i in np.split(inverse, ends[:-1])]
    keys = keys[frequent]
    bias = len(keys)

    def weights(at):
        zi, ni = z[at], n[at]
        shrink = np.where(at == bias, 0.0, l1)
        return np.where(np.abs(zi) <= shrink, 0.0, -(zi - np.sign(zi) * shrink) / ((beta + np.sqrt(ni)) / alpha + l2))

    while True:
        z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
        for _ in range(epochs):
            for at, (_, label) in zip(index, rows, strict=True):
                at = np.append(at, bias)
                w = weights(at)
                g = 1 / (1 + math.exp(-max(-40.0, min(40.0, float(w.sum()))))) - label
                g *= weight if label else 1.0
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
                z[at] += g - sigma * w
                n[at] += g * g
        w = weights(np.arange(len(keys) + 1))
        left = np.flatnonzero(w[:-1])
        if len(left) <= MAX_WEIGHTS:
            return Model(keys[left], w[left], float(w[-1]))
        l1 *= 2


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **learning) -> Model:
    """The model of docs (doc_id, text) with labels (doc_id, toxic)."""
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = marked.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    wanted = share < fit_rows / max(n, 1)
    sample = docs.select("doc_id", "text").where(wanted).join(marked.where(wanted), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, chunk in _chunks(texts(batch)):
                f, owner = features(chunk)
                both = np.unique(owner.astype(np.uint64) << np.uint64(32) | f)
                cuts = np.searchsorted(both >> np.uint64(32), np.arange(1, len(chunk)))
                found = [x.astype(np.uint32).tobytes() for x in np.split(both & np.uint64(0xFFFFFFFF), cuts)]
                own = batch.slice(start, len(chunk))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(d, np.frombuffer(f, np.uint32), y) for b in batches for d, y, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "f")), strict=True)]
        rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[0], r[1].tobytes()))
        model = learn([(f, y) for _, f, y in rows], **learning)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1 if model.learned else -2, *model.keys.astype(np.int64).tolist()], pa.int64()), pa.array([model.bias, *model.weights.tolist()], pa.float64())], ["key", "weight"]
        )

    featured = sample.select("doc_id", "text", "toxic").mapInArrow(given_back(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, f binary")
    # the sample's bound is what lets one task hold it
    table = featured.repartition(1).mapInArrow(given_back(train), "key long, weight double").toPandas().sort_values("key")
    if not len(table) or table["key"].iloc[0] == -2:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0, False)
    return Model(table["key"].to_numpy()[1:].astype(np.uint32), table["weight"].to_numpy()[1:], float(table["weight"].iloc[0]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` (default: all) with the score."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.score(texts(batch)))], [*keep, name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(given_back(run), schema)


def held_out(modulus: int = 5, remainder: int = 0) -> Column:
    """Rows that learning must not see: crc32 of doc_id's text has this remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, learned from the rows that are not held out."""
    model = fit(docs.where(~held_out()), labels, fit_rows)
    return score(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that score at least the threshold."""
    model, name = fit(docs.where(~held_out()), labels, fit_rows), unused("toxic_score", docs.columns)
    return score(docs, model, name=name).where(F.col(name) < threshold).select(docs.columns)
