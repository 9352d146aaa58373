"""SimHash near-duplicates by the Jaccard similarity of word shingles: wide fingerprints, compared bit-sliced.

`keep_one` and `near_classes` serve the corpus pipeline: texts whose sets of five-word shingles have a
similarity of 0.8 or more. 64 bits can't tell 0.8 from unrelated, so a fingerprint has 1,024: a bit is
1 where over half of the distinct shingles' hashes have it. Two sets of Jaccard similarity j have
fingerprints that differ in a share acos(2j / (1 + j)) / pi of the bits, give or take a standard
deviation: 155 +- 11 at 0.8, 197 +- 13 at 0.7, 274 +- 14 at 0.5. What RADIUS accepts is a candidate only:
a link needs a similarity of 0.8 of the shingle sets themselves, counted in whole numbers. In small sets ties
turn bits to zero and the formula does not hold (4 against 5 shingles: 192 bits at 0.8), so two sets of at
most SHORT are candidates whatever their fingerprints. Of other pairs of 0.8, RADIUS leaves out fewer than
one in 10**10, by the binomial distributions of bits.

Texts of equal words (lower-cased A-Z, blanks aside) are one class. Classes meet in a group where they
agree in a band: ROWS least hashes of their shingles, BANDS times (at 0.8, one pair in 6,000 meets in
none). In a group the fingerprints stand as vertical bit planes, 64 a word; carry-save counters add
up the differences of 64 at once, and words in which all have passed the radius are abandoned. Pairs
that earlier links connect already are not compared again, and a group gives a spanning forest, never all
pairs. The candidates of a query are counted out together; one that fails is no link, and the others are
still tried. Only classes that share a band carry their shingle hashes, made anew from one text of each. A
group above `largest` classes or `most` shingles is cut in chunks. Each chunk meets REPRESENTATIVES of the group first,
the same in all chunks; what links to the largest part of those is connected across the chunks already. Only
the classes that are not go on to meet all other chunks, so that none of the links that matter is lost,
none of the tasks is larger, and a family costs about as much as its chunks. Components come from contraction, as tables.

Defined results: null text counts as empty; texts without words are one class and link to nothing else;
fewer words than a shingle make one shingle; component_id is the smallest doc_id reachable (null only
if no member has one); repeated rows repeat; an empty table gives no rows; columns besides doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.common import given_back, map_batches, partitions, raw_texts, written
from bytequarry.llm.simhash import Forest, components, is_kept, keyed, least_row, one_of_each

SEED = 42
WORDS = 5
BITS = 1024
RADIUS = 240
#: Sets of so many shingles at most are compared without their fingerprints: a pair of 0.8 with one up to 64.
SHORT = 80
BANDS = 12
ROWS = 3
#: Classes of a group from which it is cut in chunks.
LARGEST = 20_000
#: Shingles of a group from which it is cut in chunks.
MOST = 1 << 21
#: Classes of a group that is cut that all of its chunks meet first.
REPRESENTATIVES = 64
#: Shingles of candidates that are counted out at once.
COUNTED = 1 << 20
#: Word pairs (a query against 64 fingerprints) that are compared at once.
LANES = 1 << 13

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTES = np.uint64(0x0101010101010101)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection whose bits depend on the bits of x; zero stays zero."""
    x = x ^ (x >> np.uint64(32))
    x *= _ODD
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


def _salts(n: int, name: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name} {i}", SEED) | 1 for i in range(n)], np.uint64)


_PLANES, _LEAST = _salts(BITS // 64, "plane"), _salts(BANDS * ROWS, "least")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only, and the six ASCII blanks


def class_of(parts: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(parts), SEED)


def shingles(parts: list[bytes], words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the word shingles; one for all words where they are fewer than a shingle's."""
    each = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    span = min(words, len(each))
    found = np.zeros(len(each) - span + 1, np.uint64)
    for k in range(span):
        found = found * _ODD + each[k : len(found) + k]
    return np.unique(mixed(found))


def fingerprint(found: np.ndarray) -> bytes:
    """The wide fingerprint of a set of shingle hashes."""
    ones = np.zeros((8, BITS // 64, 8), np.int64)  # by bit of a byte, word, byte
    for i in range(0, len(found), 8 * 255):
        part = found[i : i + 8 * 255]
        runs = -(-len(part) // 255)  # of at most 255 hashes, filled up with zeros, which stay zero
        part = np.concatenate([part, np.zeros(-len(part) % runs, np.uint64)])
        drawn = mixed(part.reshape(runs, -1, 1) * _PLANES)
        for bit in range(8):
            # eight counters a word, none above 255
            sums = (drawn & _BYTES).sum(axis=1)
            ones[bit] += sums.view(np.uint8).reshape(runs, -1, 8).sum(axis=0, dtype=np.int64)
            drawn >>= np.uint64(1)
    return np.packbits(2 * ones.transpose(1, 2, 0).reshape(-1) > len(found), bitorder="little").tobytes()


def bands(found: np.ndarray) -> list[int]:
    """The keys of the bands, as signed 64-bit integers."""
    least = np.min([mixed(found[None, i : i + 2048] * _LEAST[:, None]).min(axis=1) for i in range(0, len(found), 2048)], axis=0).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys + least[:, r])
    return keys.view(np.int64).tolist()


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, cls (128 bits of the words), fp, keys (none where a text has no words) and size (its shingles) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cls, fps, keys, sizes = [], [], [], []
        for text in raw_texts(batch):
            parts = words_of(text)
            cls.append(class_of(parts))
            found = shingles(parts, words) if parts else None
            sizes.append(0 if found is None else len(found))
            fps.append(bytes(BITS // 8) if found is None else fingerprint(found))
            keys.append([] if found is None else bands(found))
        arrays = [batch.column("doc_id"), batch.column("text_key"), pa.array(cls, pa.binary()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "cls", "fp", "keys", "size"])

    return map_batches(keyed(docs), run, "doc_id long, text_key long, cls binary, fp binary, keys array<long>, size int")


def shingle_sets(docs: DataFrame, sources: DataFrame, words: int = WORDS) -> DataFrame:
    """cls and found (the ascending shingle hashes) of the texts that the sources (doc_id, text_key) name, a class once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [words_of(text) for text in raw_texts(batch)]
        found = [shingles(p, words).tobytes() if p else b"" for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(map(class_of, parts), pa.binary()), pa.array(found, pa.binary())], ["cls", "found"])

    wanted = sources.select(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key"))
    texts = keyed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_key") == F.col("__text_key")), "left_semi")
    return map_batches(texts.select("text"), run, "cls binary, found binary").groupBy("cls").agg(F.first("found").alias("found"))


class Counters:
    """Carry-save counters of 64 lanes a word: level k holds bits of weight 2**k, and at most one more word to add."""

    def __init__(self, n: int, levels: int) -> None:
        self.sums = [np.zeros(n, np.uint64) for _ in range(levels)]
        self.more: list[np.ndarray | None] = [None] * levels

    def add(self, x: np.ndarray, level: int = 0) -> None:
        while True:
            y = self.more[level]
            if y is None:
                self.more[level] = x
                return
            s = self.sums[level]
            half = s ^ x
            self.sums[level], self.more[level] = half ^ y, None
            x, level = (s & x) | (half & y), level + 1

    def above(self, limit: int) -> np.ndarray:
        """Bits of the lanes that count more than the limit."""
        for level, y in enumerate(self.more):
            if (y := self.more[level]) is not None:
                s = self.sums[level]
                self.sums[level], self.more[level] = s ^ y, None
                if level + 1 < len(self.sums):
                    self.add(s & y, level + 1)
        over, level_with = np.zeros_like(self.sums[0]), np.full_like(self.sums[0], _FULL)
        for level in reversed(range(len(self.sums))):
            if limit >> level & 1:
                level_with &= self.sums[level]
            else:
                over |= level_with & self.sums[level]
                level_with &= ~self.sums[level]
        return over

    def keep(self, which: np.ndarray) -> None:
        self.sums = [s[which] for s in self.sums]
        self.more = [y if y is None else y[which] for y in self.more]


def near(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, who: np.ndarray, radius: int) -> np.ndarray:
    """For each lane, a word of the fingerprints (those of `who`, as bits) within the radius of its query.

    planes: BITS x words; fps: fingerprints x BITS / 64; query and word: indexes of both for each lane.
    """
    hit, lane = np.zeros(len(query), np.uint64), np.arange(len(query))
    count = Counters(len(query), BITS.bit_length())
    for at in range(BITS // 64):
        mine = fps[query, at]
        for b in range(64):
            count.add(planes[at * 64 + b][word] ^ (np.uint64(0) - (mine >> np.uint64(b) & np.uint64(1))))
        alive = ~count.above(radius) & who
        if not alive.all():
            left = alive != 0
            if not left.any():
                return hit
            if not left.all():
                lane, query, word, who, alive = lane[left], query[left], word[left], who[left], alive[left]
                count.keep(left)
    hit[lane] = alive
    return hit


class Sets:
    """Shingle sets, one after the other, which are counted against each other exactly."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray) -> None:
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.hashes, self.codes = hashes, None

    def like(self, query: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have a similarity of 0.8 or more with the query."""
        if self.codes is None:
            names, self.codes = np.unique(self.hashes, return_inverse=True)
            self.hashes, self.mine = None, np.zeros(len(names), bool)
        own = self.codes[self.starts[query] : self.starts[query] + self.sizes[query]]
        self.mine[own] = True
        both, ends, i = np.zeros(len(others), np.int64), np.cumsum(self.sizes[others]), 0
        while i < len(others):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + COUNTED, "right")))
            size = self.sizes[others[i:j]]
            first = np.cumsum(size) - size
            at = np.repeat(self.starts[others[i:j]] - first, size) + np.arange(size.sum())
            both[i:j] = np.add.reduceat(self.mine[self.codes[at]], first, dtype=np.int64)
            i = j
        self.mine[own] = False
        # both / (a + b - both) >= 4 / 5
        return 9 * both >= 4 * (self.sizes[query] + self.sizes[others])


def links(fps: np.ndarray, group: np.ndarray, radius: int, sets: Sets | None = None, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that span, in each group (consecutive equal numbers), the links: pairs within the radius.

    With sets, links are the pairs whose sets are alike, of those within the radius and of all short ones. With
    queries (a mask), pairs without a query are known to be connected or compared already.
    """
    n = len(fps)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    words_of = -(-size // 64)  # each group starts a word of its own
    base = np.concatenate([[0], np.cumsum(words_of)])
    number = np.repeat(np.arange(len(first)), size)
    inside = np.arange(n) - first[number]
    slot = base[number] * 64 + inside
    at = np.full(int(base[-1]) * 64, -1, np.int64)
    at[slot] = np.arange(n)
    planes = np.zeros((BITS, int(base[-1])), np.uint64)
    for w in range(BITS // 64):
        spread = np.zeros(len(at), np.uint64)
        spread[slot] = fps[:, w]
        for b in range(64):
            planes[w * 64 + b] = np.packbits((spread >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
    forest, out = Forest(n), []
    settled, roots, known = np.zeros(n + 1, bool), np.append(np.arange(n), -1), 0

    def compare(queries: np.ndarray) -> None:
        """Each query with the later fingerprints of its group, and with the settled ones."""
        nonlocal known
        ends = np.cumsum(words_of[number[queries]])
        i = 0
        while i < len(queries):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LANES, "right")))
            count = words_of[number[queries[i:j]]]
            query = np.repeat(queries[i:j], count)
            word = base[number[query]] + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
            if len(out) > known:
                known = len(out)
                roots[:n] = [forest.root(x) for x in range(n)]
            members = at.reshape(-1, 64)[word]
            # once each, and only those that no link connects with the query yet
            wanted = (roots[members] != roots[query][:, None]) & (members >= 0) & ((members > query[:, None]) | settled[members])
            if sets is not None:
                # sizes alone tell that these are not alike
                a, b = sets.sizes[query][:, None], sets.sizes[members]
                wanted &= 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
                short = wanted & (a <= SHORT) & (b <= SHORT)
                wanted &= ~short
            who = np.packbits(wanted, axis=1, bitorder="little").view(np.uint64).reshape(-1)
            some = np.flatnonzero(who)
            hit = np.zeros(len(who), np.uint64)
            hit[some] = near(planes, fps, query[some], word[some], who[some], radius)
            if sets is not None:
                hit |= np.packbits(short, axis=1, bitorder="little").view(np.uint64).reshape(-1)
            found = np.flatnonzero(hit)
            lane, bit = np.nonzero(np.unpackbits(hit[found].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            asks, others = query[found[lane]], at[word[found[lane]] * 64 + bit]
            cuts = np.flatnonzero(np.diff(asks)) + 1
            for q, some in zip(asks[np.concatenate([[0], cuts])].tolist() if len(asks) else [], np.split(others, cuts)):
                if sets is not None:
                    mine = forest.root(q)
                    some = np.array([x for x in some.tolist() if forest.root(x) != mine], np.int64)
                    some = some[sets.like(q, some)]
                for other in some.tolist():
                    if forest.join(q, other):
                        out.append((q, other))
            i = j

    if queries is not None:
        settled[:n] = ~queries
        compare(np.flatnonzero(queries))
        return out
    # the first 64 of each group meet all of it; what they bring together in its largest part needs
    # no more comparisons within, so only the others go on as queries
    compare(np.flatnonzero(inside < 64))
    if (size > 64).any():
        final = np.array([forest.root(x) for x in range(n)])
        for g in np.flatnonzero(size > 64):
            mine = final[first[g] : first[g] + size[g]]
            values, often = np.unique(mine, return_counts=True)
            settled[first[g] : first[g] + size[g]] = mine == values[often.argmax()]
        compare(np.flatnonzero((inside >= 64) & ~settled[:n]))
    return out


def near_links(docs: DataFrame, classes: DataFrame, words: int = WORDS, radius: int = RADIUS, largest: int = LARGEST, most: int = MOST) -> DataFrame:
    """a, b: links between classes (cls distinct, fp, keys, size, source) of docs that connect all that share a band and are alike (see links)."""
    chunks = lambda n, of: F.ceil(F.greatest(F.col(n) / largest, F.col(of) / most)).cast("int")
    keyed = classes.select("cls", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("of")).where("n > 1")
    rows = written(keyed.join(shared, "key").select("cls", "key", "size", chunks("n", "of").alias("chunks")), "wide-groups")
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    none = F.lit(0)
    small = rows.where("chunks = 1").select("cls", "key", none.alias("x"), none.alias("y"), F.lit(False).alias("first"), F.lit(True).alias("whole"))
    big = rows.where("chunks > 1")
    if big.isEmpty():
        return _linked(docs, classes, small, words, radius).where("b IS NOT NULL").select("a", "b")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("cls", F.lit(1)), "cls"))
    first = written(big.withColumn("rank", rank).where(F.col("rank") <= REPRESENTATIVES).select("cls", "key", "chunks"), "wide-representatives")
    everywhere = first.select("cls", "key", F.explode(F.sequence(none, F.col("chunks") - 1)).alias("x"))
    members = big.select("cls", "key", own.alias("x")).join(everywhere, ["cls", "key", "x"], "left_anti")
    apart = everywhere.withColumn("first", F.lit(True)).unionByName(members.withColumn("first", F.lit(False))).select("cls", "key", "x", none.alias("y"), "first", F.lit(False).alias("whole"))
    found = written(_linked(docs, classes, small.unionByName(apart), words, radius), "wide-links")
    # what is not connected with the representatives' largest part meets the members of all chunks
    left = big.join(found.where("b IS NULL").select(F.col("a").alias("cls"), "key").distinct(), ["cls", "key"], "left_semi")
    sizes = left.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("of")).select("key", chunks("n", "of").alias("parts"))
    part = F.pmod(F.xxhash64("cls", F.lit(2)), F.col("parts")).cast("int")
    asking = left.join(sizes, "key").select("cls", "key", F.explode(F.sequence(none, F.col("chunks") - 1)).alias("x"), part.alias("y"), F.lit(True).alias("first"))
    asked = big.join(sizes, "key").select("cls", "key", own.alias("x"), F.explode(F.sequence(none, F.col("parts") - 1)).alias("y"), F.lit(False).alias("first"))
    again = _linked(docs, classes, asking.unionByName(asked).withColumn("whole", F.lit(False)), words, radius, asked=True)
    return found.unionByName(again).where("b IS NOT NULL").select("a", "b")


def _linked(docs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, radius: int, asked: bool = False) -> DataFrame:
    """a, b, key: the links of the groups (key, x, y) in rows (cls, key, x, y, first, whole).

    Of a group that is not whole, the classes marked first are the representatives, and a row with a null b names
    each class a that is not connected with the largest part of them. With asked, only pairs with a class marked
    first are compared.
    """
    sources = classes.join(rows.select("cls").distinct(), "cls", "left_semi").select("source.doc_id", "source.text_key")
    held = classes.select("cls", "fp").join(shingle_sets(docs, sources, words), "cls")
    rows = rows.join(held, "cls").select("key", "x", "y", "first", "whole", "cls", "fp", "found")
    rows = rows.repartition(max(1, partitions(classes.sparkSession)), "key", "x", "y").sortWithinPartitions("key", "x", "y", F.col("first").desc(), "cls")

    def solved(held: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        fps = np.frombuffer(b"".join(held.column("fp").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        each = held.column("found").to_pylist()
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 8
        hashes = np.frombuffer(b"".join(each), np.uint64)
        del each
        first, group = held.column("first").to_numpy(), np.cumsum(cuts)
        whole = asked or held.column("whole").to_numpy().all()
        sets = Sets(hashes, sizes)
        if whole:
            del hashes
        found = links(fps, group, radius, sets, first if asked else None)
        cls, key = held.column("cls").to_pylist(), held.column("key").to_pylist()
        out = [(cls[i], cls[j], key[i]) for i, j in found]
        if not whole:
            forest = Forest(len(cls))
            for i, j in found:
                forest.join(i, j)
            ends = np.cumsum(sizes)
            starts = np.append(np.flatnonzero(cuts), len(cls))
            for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                if not held.column("whole")[a].as_py():
                    # the representatives by themselves, so that all chunks see the same parts
                    n = int(first[a:b].sum())
                    alone = Forest(n)
                    for i, j in links(fps[a : a + n], np.zeros(n, int), radius, Sets(hashes[ends[a] - sizes[a] : ends[a + n - 1]], sizes[a : a + n])):
                        alone.join(i, j)
                    values, often = np.unique([alone.root(i) for i in range(n)], return_counts=True)
                    main = forest.root(a + int(values[often.argmax()]))
                    out += [(cls[i], None, key[i]) for i in range(a, b) if forest.root(i) != main]
        kinds = (pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["a", "b", "key"])

    def starts(held: pa.Table) -> np.ndarray:
        columns = [held.column(c).to_numpy() for c in ("key", "x", "y")]
        return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # of the group that is still open
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = np.flatnonzero(starts(pa.Table.from_batches([batch])))
            if waiting and all(waiting[-1].column(c)[-1] == batch.column(c)[0] for c in ("key", "x", "y")):
                cut = cut[1:]
            if not len(cut):
                waiting.append(batch)
                continue
            held = pa.Table.from_batches([*waiting, batch.slice(0, int(cut[-1]))])
            waiting = [batch.slice(int(cut[-1]))]
            if held.num_rows:
                yield solved(held, starts(held))
        if waiting:
            held = pa.Table.from_batches(waiting)
            yield solved(held, starts(held))

    return rows.mapInArrow(given_back(run), "a binary, b binary, key long")


def near_classes(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """doc_id, text_key, component_id and kept (the component's one document) of every row."""
    rows = written(sketches(docs, words), "wide-sketches")
    classes = written(rows.groupBy("cls").agg(least_row().alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.max(F.struct("doc_id", "text_key")).alias("source")), "wide-classes")
    roots = components(near_links(docs, classes, words, radius, largest))
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    groups = named.groupBy("root").agg(F.min("first").alias("least"))
    final = named.join(groups, "root").select("cls", "least")
    return rows.join(final, "cls", "left").select("doc_id", "text_key", F.col("least.doc_id").alias("component_id"), is_kept("least").alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """The document of the smallest doc_id of each component, with all its columns; see one_of_each."""
    return one_of_each(docs, near_classes(docs, words, radius, largest))
