"""Language ID by n-gram filters of language bitmasks.

One Bloom filter holds the n-grams of all languages, bit-sliced: a slot is a mask with one bit a
language (as many words of 64 as the languages need), and the AND of an n-gram's slots tells at once every language that (maybe) has it. A
document's hits of a language are corrected for the false positives that its share of set bits
makes; the language with most hits left is predicted.

Defined results: null or letterless text is `und` with score 0; ties go to the language with
most labelled rows, then by name; without labelled rows everything is `und`; rows with a null or empty label are
not learned from; repeated rows repeat; a text of any length is read whole; columns other than doc_id and text (and, to learn,
the label) are not read. Learning takes whole texts of a sample of about `fit_rows` rows a language,
drawn by a hash of the id; the bound is a parameter, the predictions are for all rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.common import given_back, texts, unused

#: Expected labelled rows a language to learn from.
FIT_ROWS = 3000
#: Characters of an n-gram, a space for each run of other characters included.
GRAM = 4
#: Slots of the filter (a mask of one word of 64 bits for each 64 languages), and slots an n-gram sets.
SLOTS = 1 << 20
PROBES = 2
#: Characters handled at once.
CHUNK = 1 << 20
#: Share of a document's n-grams that its language must have for `keep` to take it.
LEAST_SCORE = 0.25


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def grams(chunk: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit n-gram hashes of the texts, the number of the text of each, and which texts have letters."""
    lowered = [f" {t.lower()} " for t in chunk]
    flat = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(chunk)), sizes)
    letter = _letters()[flat]
    with_letters = np.bincount(owner[letter], minlength=len(chunk)) > 0
    code = np.where(letter, flat, 32).astype(np.uint64)
    start = np.zeros(len(flat), bool)
    start[np.cumsum(sizes)[:-1]] = True
    start[:1] = True
    keep = letter | np.concatenate([[True], letter[:-1]]) | start
    code, owner = code[keep], owner[keep]
    if len(code) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), with_letters
    h = np.zeros(len(code) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = owner[: len(h)] == owner[n - 1 :]
    return h[whole], owner[: len(h)][whole], with_letters


def _chunks(batch_texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(batch_texts):
        if size and size + len(t) > CHUNK:
            yield start, batch_texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(batch_texts):
        yield start, batch_texts[start:]


def _slots(h: np.ndarray, slots: int, probes: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(slots)).astype(np.int64) for k in range(probes)]


@dataclass
class Model:
    """masks: words x slots; bit b % 64 of word b // 64 is the language b."""

    languages: list[str]
    masks: np.ndarray
    probes: int = PROBES
    gram: int = GRAM

    def false_rates(self) -> np.ndarray:
        fill = np.array([np.count_nonzero(self.masks[b // 64] >> np.uint64(b % 64) & np.uint64(1)) / self.masks.shape[1] for b in range(len(self.languages))])
        return np.minimum(fill**self.probes, 0.99)

    def predict(self, batch_texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs, scores = ["und"] * len(batch_texts), np.zeros(len(batch_texts))
        if not self.languages:
            return langs, scores
        rates = self.false_rates()
        for start, chunk in _chunks(batch_texts):
            h, owner, with_letters = grams(chunk, self.gram)
            slots = _slots(h, self.masks.shape[1], self.probes)
            found = [word[slots[0]] for word in self.masks]
            for at in slots[1:]:
                for mask, word in zip(found, self.masks, strict=True):
                    mask &= word[at]
            total = np.bincount(owner, minlength=len(chunk))
            hits = np.stack([np.bincount(owner[(found[b // 64] >> np.uint64(b % 64) & np.uint64(1)).astype(bool)], minlength=len(chunk)) for b in range(len(self.languages))])
            share = np.clip((hits / np.maximum(total, 1) - rates[:, None]) / (1 - rates[:, None]), 0, 1)
            best = share.argmax(axis=0)
            for i in np.flatnonzero(with_letters):
                langs[start + i], scores[start + i] = self.languages[best[i]], share[best[i], i]
        return langs, scores


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, slots: int = SLOTS, probes: int = PROBES, gram: int = GRAM, least_docs: int = 3) -> Model:
    """The filter of labelled (doc_id, text, lang); an n-gram counts for a language once least_docs sampled documents of it hold it."""
    labelled = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.col("lang") != ""))
    # a row a language
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Model([], np.zeros((0, 1), np.uint64), probes, gram)
    share = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    shares = F.map_from_arrays(F.array(*map(F.lit, languages)), F.array(*[F.lit(float(fit_rows / sizes[x])) for x in languages]))
    wanted = share < shares[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for start, chunk in _chunks(texts(batch)):
                h, owner, _ = grams(chunk, gram)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, lang = h[first], langs[start + owner[first]]
                for b in np.unique(lang):
                    key, n = np.unique(h[lang == b], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), b)), pa.array(n.astype(np.int64))], ["h", "b", "n"])

    counts = labelled.where(wanted).mapInArrow(given_back(run), "h long, b long, n long").groupBy("h", "b").agg(F.sum("n").alias("n"))
    held = counts.where(F.col("n") >= least_docs).groupBy("h", F.floor(F.col("b") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = batch.column("mask")
            for at in _slots(batch.column("h").to_numpy().astype(np.int64).view(np.uint64), slots, probes):
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("word"), mask], ["slot", "word", "mask"])

    # at most `slots` rows for each 64 languages
    table = held.mapInArrow(place, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros((-(-len(languages) // 64), slots), np.uint64)
    masks[table.column("word").to_numpy(), table.column("slot").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return Model(languages, masks, probes, gram)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` (default: all) with the language and its score under two names."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(texts(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores)], [*keep, *names])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{names[0]}` string, `{names[1]}` double"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(given_back(run), schema)


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Rows that learning must not see: crc32 of doc_id's text has this remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    model = fit(docs.where(~held_out()), fit_rows)
    return predict(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, least_score: float = LEAST_SCORE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows whose language is `und` or too uncertain; other columns and their values stay."""
    model = fit(docs.where(~held_out()), fit_rows)
    lang, score = unused("lang_pred", docs.columns), unused("score", docs.columns)
    return predict(docs, model, names=(lang, score)).where((F.col(lang) != "und") & (F.col(score) >= least_score)).select(docs.columns)
