"""SimHash near-dedup by bit-sliced comparison.

A fingerprint's bit is 1 where over half of the hashes of a text's word shingles have it. Texts with
equal fingerprints are one class. Classes that differ in at most `radius` bits must agree in one of
radius + 1 blocks of bits, so each class goes to one group a block. A group is compared bit-sliced:
fingerprints are stored as vertical bit planes of 64 a word; a query's bit turns a plane into 64
differences, which carry-save counters add up for all at once; words in which every counter has passed
the radius are abandoned. A group gives a spanning forest of its links, never all pairs. Groups
above `largest` classes are split by blocks of the remaining bits, again without losing a link.
Components come from repeated contraction of the links, as tables.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked
like any other; fewer words than a shingle make one shingle; shingles count as often as they occur;
component_id is the smallest doc_id reachable (null only if no member has one); repeated rows
repeat; texts of any length are read whole; an empty table gives no rows; columns besides doc_id and text,
whatever their names, are not read. Of a doc_id with
several texts each text is a document of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.common import map_batches, partitions, raw_texts, unused, written

SEED = 42
RADIUS = 4
#: Classes of a group from which it is split by further blocks.
LARGEST = 20_000
#: How often a group may be split.
SPLITS = 2
#: Word pairs (a query against 64 fingerprints) that are compared at once.
LANES = 1 << 15

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit fingerprint of a text's UTF-8 bytes."""
    parts = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, text_key and fp (the fingerprint as a signed 64-bit integer)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words) for t in raw_texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fp)], ["doc_id", "text_key", "fp"])

    return map_batches(keyed(docs), run, "doc_id long, text_key long, fp long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, which tells apart the texts of one doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def least_row() -> Column:
    """The aggregate that finds the row (doc_id, text_key) of the smallest doc_id; rows without a doc_id do not count."""
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key")))


def is_kept(first: str) -> Column:
    """Whether a row is its component's `first`, or has no doc_id."""
    return F.col("doc_id").isNull() | ((F.col("doc_id") == F.col(f"{first}.doc_id")) & (F.col("text_key") == F.col(f"{first}.text_key")))


def blocks(bits: list[int], count: int) -> list[list[int]]:
    """The bits in so many blocks of about equal size."""
    cuts = [round(i * len(bits) / count) for i in range(count + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def near(planes: np.ndarray, query: np.ndarray, word: np.ndarray, who: np.ndarray, radius: int) -> np.ndarray:
    """For each lane, a 64-bit word of the fingerprints within the radius of its query.

    planes: 64 x words; query: the lane's fingerprints; word: the word each lane compares with; who:
    the fingerprints of that word to compare, as bits.
    """
    width = (radius + 1).bit_length()
    hit = np.zeros(len(query), np.uint64)
    lane = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(width)]
    # counters start so that radius + 1 differences make the top carry out
    start = (1 << width) - radius - 1
    for k in range(width):
        if start >> k & 1:
            counters[k][:] = _FULL
    over = ~who
    for b in range(64):
        turned = np.uint64(0) - (query >> np.uint64(b) & np.uint64(1))
        carry = planes[b][word] ^ turned
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 6 == 5 and b < 60:
            alive = over != _FULL
            if not alive.all():
                if not alive.any():
                    return hit
                lane, query, word, over = lane[alive], query[alive], word[alive], over[alive]
                counters = [c[alive] for c in counters]
    hit[lane] = ~over
    return hit


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links(fp: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that span, in each group (consecutive equal numbers), the links within the radius."""
    n = len(fp)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    # each group starts a word of its own
    words_of = -(-size // 64)
    base = np.concatenate([[0], np.cumsum(words_of)])
    number = np.repeat(np.arange(len(first)), size)
    inside = np.arange(n) - first[number]
    slot = base[number] * 64 + inside
    planes = np.zeros((64, int(base[-1])), np.uint64)
    at = np.full(int(base[-1]) * 64, -1, np.int64)
    at[slot] = np.arange(n)
    spread = np.zeros(int(base[-1]) * 64, np.uint64)
    spread[slot] = fp
    for b in range(64):
        planes[b] = np.packbits((spread >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
    valid = np.packbits((at >= 0).astype(np.uint8), bitorder="little").view(np.uint64)
    forest, out = Forest(n), []
    settled = np.zeros(int(base[-1]), np.uint64)

    def compare(queries: np.ndarray, whole: bool) -> None:
        """Each query with the later fingerprints of its group, and, with whole, with the settled ones."""
        first_word = base[number[queries]] if whole else slot[queries] // 64
        lanes = base[number[queries] + 1] - first_word
        ends, i = np.cumsum(lanes), 0
        while i < len(queries):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LANES, "right")))
            count = lanes[i:j]
            query = np.repeat(queries[i:j], count)
            word = np.repeat(first_word[i:j], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
            own, bit = slot[query] // 64, (slot[query] % 64).astype(np.uint64)
            later = np.where(word == own, ~((np.uint64(2) << bit) - np.uint64(1)), np.where(word > own, _FULL, np.uint64(0)))
            later[(word == own) & (bit == 63)] = 0
            who = valid[word] & (later | settled[word])
            some = np.flatnonzero(who)
            hit = near(planes, fp[query[some]], word[some], who[some], radius)
            found = np.flatnonzero(hit)
            lane, at_bit = np.nonzero(np.unpackbits(hit[found].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            asks, others = query[some[found[lane]]], at[word[some[found[lane]]] * 64 + at_bit]
            for q, other in zip(asks.tolist(), others.tolist(), strict=True):
                if forest.join(q, other):
                    out.append((q, other))
            i = j

    # the first 64 of each group meet all of it; what they bring together in its largest part needs no more
    # comparisons within, so that only the others go on as queries
    compare(np.flatnonzero(inside < 64), False)
    if (size > 64).any():
        done = np.zeros(n, bool)
        for g in np.flatnonzero(size > 64):
            mine = np.array([forest.root(x) for x in range(first[g], first[g] + size[g])])
            values, often = np.unique(mine, return_counts=True)
            done[first[g] : first[g] + size[g]] = mine == values[often.argmax()]
        here = np.zeros(len(at), np.uint8)
        here[slot[done]] = 1
        settled[:] = np.packbits(here, bitorder="little").view(np.uint64)
        compare(np.flatnonzero((inside >= 64) & ~done), True)
    return out


def _edges(rows: DataFrame, radius: int) -> DataFrame:
    """a, b: links of the groups in rows (part int, key long, fp long), dealt out by part and key."""
    n = max(1, partitions(rows.sparkSession))
    rows = rows.repartition(n, "part", "key").sortWithinPartitions("part", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def solved(part, key, fp):
            group = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | (key[1:] != key[:-1])]))
            found = np.array(links(fp.view(np.uint64), group, radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], ["a", "b"])

        for batch in batches:
            new = tuple(batch.column(c).to_numpy().copy() for c in ("part", "key", "fp"))
            if not len(new[0]):
                continue
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            part, key, _ = held
            last = int(np.flatnonzero((part != part[-1]) | (key != key[-1]))[-1]) + 1 if ((part != part[-1]) | (key != key[-1])).any() else 0
            if last:
                yield solved(*(x[:last] for x in held))
                held = tuple(x[last:] for x in held)
        if held is not None:
            yield solved(*held)

    return rows.mapInArrow(run, "a long, b long")


def near_links(classes: DataFrame, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """a, b: links between fingerprints (column fp, distinct) that connect all within the radius.

    Fingerprints that differ in no more bits than the radius agree in one of radius + 1 blocks of any bits, so a group
    above `largest` is split by blocks of the bits that it does not agree in yet, SPLITS times at most: groups of one
    family are cheap as they are (see links), and by then others agree in 31 bits by chance, which would take some
    10**13 fingerprints. A group that is still larger is compared as it is.
    """
    masks = {part: mask(b) for part, b in enumerate(blocks(list(range(64)), radius + 1))}
    rows = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for p, m in masks.items()])).alias("k"))
    rows, done = rows.select("k.part", "k.key", "fp"), []
    for level in range(SPLITS + 1):
        if level == SPLITS:
            return _edges(_union([*done, rows]), radius)
        big = written(rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("part", "key"), "simhash-big")
        parts = [r["part"] for r in big.select("part").distinct().collect()]  # no more than there are masks
        inner = {}
        for p in parts:
            rest = [b for b in range(64) if not masks[p] >> b & 1]
            if len(rest) > radius:
                inner[p] = [((p + 1) * (radius + 2) + j, masks[p] | mask(x)) for j, x in enumerate(blocks(rest, radius + 1))]
        if not inner:
            return _edges(rows if not done else _union([*done, rows]), radius)
        big = big.where(F.col("part").isin(list(inner)))
        done.append(rows.join(big, ["part", "key"], "left_anti"))
        split = rows.join(big, ["part", "key"], "left_semi")
        keys = None
        for p, found in inner.items():
            each = F.array(*[F.struct(F.lit(part).cast("long").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for part, m in found])
            keys = F.when(F.col("part") == p, each) if keys is None else keys.when(F.col("part") == p, each)
        masks = {part: m for found in inner.values() for part, m in found}
        rows = written(split.select("fp", F.explode(keys).alias("k")).select("k.part", "k.key", "fp"), "simhash-split")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select(F.col("part").cast("long").alias("part"), "key", "fp")
    for f in frames[1:]:
        out = out.unionByName(f.select(F.col("part").cast("long").alias("part"), "key", "fp"))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) reaches; large-star and small-star rounds until none changes, each a written table."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "links")
    while True:
        if edges.isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        # large star: each larger neighbour of a node is hung on the node's least neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: each smaller neighbour of a node, and the node, are hung on the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), "a").where("x != a").select(F.col("x").alias("a"), F.col("a").alias("b"))
        new = written(small.union(least.select(F.col("m").alias("a"), "b")).distinct(), "links")
        # done when every node hangs on one root that hangs on none
        many = new.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
        deep = new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        edges = new
        if many.isEmpty() and deep.isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """doc_id, text_key, fp, component_id and kept (the component's one document) of every row."""
    fps = written(fingerprints(docs, words), "simhash")
    classes = written(fps.groupBy("fp").agg(least_row().alias("first")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), radius, largest))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # only classes with links share a root
    groups = named.groupBy("root").agg(F.min("first").alias("least"))
    final = named.join(groups, "root").select("fp", "least")
    return fps.join(final, "fp", "left").select("doc_id", "text_key", "fp", F.col("least.doc_id").alias("component_id"), is_kept("least").alias("kept"))


def one_of_each(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The document of the smallest doc_id of each component, with all its columns; a row that repeats stays once.

    components: doc_id, text_key and kept of every row of docs. Rows without a doc_id all stay.
    """
    found = written(components.select("doc_id", "text_key", "kept"), "simhash-components")
    gone_id, gone_key, key = (unused(c, docs.columns) for c in ("gone_id", "gone_key", "text_key"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    left = rows.join(gone, (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    again = found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        left = left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", key]).unionByName(left.where(F.col("doc_id").isNull()))
    return left.select(docs.columns)


def keep_one(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """One document of each component of near_duplicates; see one_of_each."""
    return one_of_each(docs, near_duplicates(docs, words, radius))
