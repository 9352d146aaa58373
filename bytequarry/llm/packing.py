"""Packing of documents into sequences by bin completion with branch and bound.

Only the count of pieces of each length matters to the packing, at most `capacity` numbers, so the
solver sees a histogram whatever the corpus's size. Best-fit decreasing gives the incumbent, `least` a lower
bound. For counts of sequences from the bound up to the incumbent's, bin completion looks for a packing
into so many: it takes the longest piece left and enumerates the fillings of the room beside it, those of
least waste first and among them those of longer pieces. Sums that the pieces left can make are bit sets,
so that no filling that must waste too much is entered; a filling is left out where pieces of it (or none)
can be swapped for a longer piece that fits in their place (it is dominated). A filling is used for as
many sequences at once as there are pieces and waste allowed; on the way back it is used for fewer, then
the next filling is tried. The least packing found is the result (`packed_by` completion); only if `effort`
runs out at every count does the incumbent stay (`packed_by` best fit).
Each piece then finds its place by its rank among the pieces of its length.

Defined results: null text counts as empty (its ids are the end id alone); a text of any length is cut
whole, a piece at a time; repeated rows are packed each; a null doc_id stays null; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.common import given_back, texts, written
from bytequarry.llm.tokens import encoder, vocabulary

CAPACITY = 2048
#: Fillings looked at for each count of sequences, beyond four a length.
EFFORT = 10_000
#: Shares in which the pieces of one length are ranked, whatever the cluster's size.
SHARES = 64
#: Open choices that are kept; an older one is enumerated anew when the search comes back to it.
KEPT = 128

Filling = tuple[tuple[int, int], ...]
Pattern = tuple[Filling, int]


class Stock:
    """Counts of lengths, the lengths left in ascending order, and those as a bit set."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)
        self.mask = sum(1 << s for s in self.sizes)

    def take(self, need: Filling, times: int) -> None:
        for size, n in need:
            self.counts[size] -= n * times
            if not self.counts[size]:
                self.sizes.pop(bisect.bisect_left(self.sizes, size))
                self.mask ^= 1 << size

    def give(self, need: Filling, times: int) -> None:
        for size, n in need:
            if not self.counts[size]:
                bisect.insort(self.sizes, size)
                self.mask ^= 1 << size
            self.counts[size] += n * times


def more_sums(sums: int, size: int, n: int) -> int:
    """The sums with up to n more pieces of a size; sums are bit sets."""
    step = 1
    while n > 0:
        now = min(step, n)
        sums |= sums << size * now
        n, step = n - now, step * 2
    return sums


def spread(sums: int, by: int) -> int:
    """The sums and those up to so much larger."""
    return more_sums(sums, 1, by)


def dominated(filling: Filling, waste: int, left: int) -> bool:
    """Whether a length of the bit set `left` fits in the place of several pieces, of a shorter one, or of none."""
    one, many = 1, 0
    for size, n in filling:
        many = more_sums(many, size, n) | more_sums(one >> 1 << 1 + size, size, n - 1) | (more_sums(1 << 2 * size, size, n - 2) if n > 1 else 0)
        one |= 1 << size
    better = spread(many, waste) | (spread(one << 1, waste - 1) if waste else 0)
    return bool(better & left)


def beside(first: int, filling: Filling) -> Filling:
    """The filling together with the piece that it is the filling beside."""
    return tuple(sorted((Counter({first: 1}) + Counter(dict(filling))).items(), reverse=True))


def fillings(stock: Stock, first: int, room: int, spare: int) -> Iterator[tuple[int, Filling] | None]:
    """(waste, filling) of the room beside one piece of length `first`: by waste, then longer pieces first; None for a dominated one."""
    have = lambda size: stock.counts[size] - (size == first)
    sizes = [s for s in stock.sizes[: bisect.bisect_right(stock.sizes, room)] if have(s)]
    full = (1 << room + 1) - 1
    reach = [1]  # sums of so many of the shortest lengths, up to where all sums are there
    for size in sizes:
        reach.append(more_sums(reach[-1], size, min(have(size), room // size)) & full)
        if reach[-1] == full:
            break

    def makes(i: int, total: int) -> int:
        return reach[min(i, len(reach) - 1)] >> total & 1

    def fill(total: int, i: int) -> Iterator[Filling]:
        if not total:
            yield ()
        while total and i and makes(i, total):
            i = min(i, bisect.bisect_right(sizes, total))
            size = sizes[i - 1]
            for n in range(min(have(size), total // size), 0, -1):
                if makes(i - 1, total - n * size):
                    for rest in fill(total - n * size, i - 1):
                        yield ((size, n), *rest)
            i -= 1

    for waste in range(min(spare, room) + 1):
        if makes(len(sizes), room - waste):
            for filling in fill(room - waste, len(sizes)):
                left = stock.mask
                for size, n in beside(first, filling):
                    if stock.counts[size] == n:
                        left ^= 1 << size
                yield None if dominated(filling, waste, left) else (waste, filling)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: open rooms by size, pieces of one length placed together."""
    rooms: dict[int, list[tuple[Filling, int]]] = {}
    keys: list[int] = []

    def put(room: int, chosen: Filling, n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(keys, room)
        rooms[room].append((chosen, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(keys, size)
            if at < len(keys):
                room = keys[at]
                chosen, m = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    keys.pop(at)
            else:
                room, chosen, m = capacity, (), -(-n // (capacity // size))
            each = min(room // size, -(-n // m) if m <= n else 1)
            now = min(m, n // each)
            put(room - each * size, (*chosen, (size, each)), now)
            if m > now and chosen:
                put(room, chosen, m - now)
            n -= now * each
    return [(chosen, n) for held in rooms.values() for chosen, n in held if chosen]


def least(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the sequences: the sum's, and for each threshold k what pieces of k or more need beside those above half."""
    n = np.zeros(capacity + 1, np.int64)
    for size, many in counts.items():
        n[size] = many
    size = np.arange(capacity + 1)
    many, total = np.cumsum(n), np.cumsum(n * size)  # of pieces up to each length
    half = capacity // 2
    k = np.arange(1, half + 1)
    # pieces above capacity - k share with none of k or more; those above half share with no other above half
    sharing = many[capacity - k] - many[half]
    room = capacity * sharing - (total[capacity - k] - total[half])
    small = total[half] - total[k - 1]
    bound = many[-1] - many[half] + np.maximum(0, -(-(small - room) // capacity))
    return max(-(-int(total[-1]) // capacity), int(bound.max(initial=0)))


class Choice:
    """A pattern of the packing under construction: its fillings not tried yet, and the one in use, `times` over."""

    def __init__(self, first: int, spare: int, after: tuple[int, Filling] | None) -> None:
        self.first, self.spare, self.after = first, spare, after
        self.open: Iterator | None = None
        self.seen, self.times, self.waste, self.need, self.filling = 0, 0, 0, (), ()


def complete(counts: dict[int, int], capacity: int, most: int, effort: int = EFFORT) -> list[Pattern] | None:
    """A packing into at most so many sequences by bin completion; None where there is none, or where the effort runs out."""
    stock, path = Stock(counts), []
    spare = most * capacity - sum(s * n for s, n in counts.items())
    used, after, effort = 0, None, effort + 4 * len(stock.sizes)
    while True:
        if spare >= 0 and not stock.sizes:
            return [(c.need, c.times) for c in path]
        if spare >= 0 and used + least(stock.counts, capacity) <= most:
            path.append(Choice(stock.sizes[-1], spare, after))
            if len(path) > KEPT:
                path[-KEPT - 1].open = None
        while True:  # the next way of the last choice that has one
            if not path or effort <= 0:
                return None
            c = path[-1]
            if c.times:
                stock.give(c.need, c.times)
                used -= c.times
                # one time less each, or half as often where there are many
                c.times = c.times - 1 if c.times <= 8 else c.times // 2
            if not c.times:
                if c.open is None:
                    c.open = islice(fillings(stock, c.first, capacity - c.first, c.spare), c.seen, None)
                found = None
                for found in c.open:
                    c.seen += 1
                    effort -= 1
                    # sequences around pieces of one length come in the order of their fillings
                    if found and (c.after is None or (found[0], c.after[1]) > (c.after[0], found[1])):
                        break
                    found = None
                    if effort <= 0:
                        return None
                if found is None:
                    path.pop()
                    continue
                c.waste, c.filling = found
                c.need = beside(c.first, c.filling)
                c.times = min(stock.counts[s] // n for s, n in c.need)
                if c.waste:
                    c.times = min(c.times, c.spare // c.waste)
            stock.take(c.need, c.times)
            used += c.times
            spare = c.spare - c.waste * c.times
            after = (c.waste, c.filling) if stock.sizes and stock.sizes[-1] == c.first else None
            break


def solve(counts: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT) -> tuple[list[Pattern], str]:
    """(lengths with their copies in a sequence, how many such sequences) for a histogram of piece lengths, and what found them."""
    incumbent = best_fit(counts, capacity)
    low, high = least(counts, capacity), sum(n for _, n in incumbent)
    best, step = None, 0
    while low <= high:
        # from the bound on in doubling steps; once there is a packing, in halves of what is left below it
        most = min(high, low + step) if best is None else (low + high) // 2
        found = complete(counts, capacity, most, effort)
        if found is not None:
            best, high = found, sum(n for _, n in found) - 1
        else:
            low, step = most + 1, 2 * step + (step == 0)
    return (best, "completion") if best is not None else (incumbent, "best fit")


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", words: bool = False, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The documents' pieces: ids with the end id, cut into pieces of the capacity; the first may be shorter."""
    end = struct.pack("<I", end_id)

    def run(batches):
        for batch in batches:
            ids = encoder(vocabulary(tokenizer), words).ids
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                data = memoryview(ids(text) + end)
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = data[4 * a : 4 * b]
                    rows.append((doc_id, i, a, b - a, zlib.crc32(part), bytes(part) if keep_ids else None))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + keep_ids], names[: 5 + keep_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(given_back(run), schema)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", words: bool = False, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, effort: int = EFFORT) -> DataFrame:
    """pieces() with sequence_id, offset (each piece's place) and packed_by (completion or best fit)."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, words, end_id, capacity, keep_ids), "pieces")
    # pieces of a length are ranked in shares, since very many may have one length
    cut = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SHARES)).cast("int"))
    # at most capacity * SHARES rows, whatever the table's size
    found = cut.groupBy("length", "share").agg(F.count("*").alias("n")).toArrow()
    held = np.zeros((capacity + 1, SHARES + 1), np.int64)
    held[found.column("length").to_numpy(), found.column("share").to_numpy() + 1] = found.column("n").to_numpy()
    before = np.cumsum(held, axis=1)  # pieces of a length in the shares before
    counts = {s: int(n) for s, n in enumerate(before[:, -1]) if n}
    patterns, packed_by = solve(counts, capacity, effort)
    # of each length, runs of ranks: first rank, first sequence, offset, copies in a sequence
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for size, n in lengths:
            places.setdefault(size, []).append((taken[size], sequence, offset, n))
            taken[size] += n * times
            offset += n * size
        sequence += times
    lengths = np.array(sorted(counts), np.int64)
    shared = spark.sparkContext.broadcast(({s: tuple(np.array(c, np.int64) for c in zip(*p, strict=True)) for s, p in places.items()}, lengths, before[lengths]))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1)

    def run(batches):
        places, lengths, before = shared.value
        for batch in batches:
            size, rank, share = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank", "share"))
            rank += before[np.searchsorted(lengths, size), share]
            sequence_id, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                first, base, at, copies = places[int(s)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                own = rank[rows] - first[k]
                sequence_id[rows], offset[rows] = base[k] + own // copies[k], at[k] + own % copies[k] * s
            names = [c for c in batch.schema.names if c not in ("rank", "share")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence_id), pa.array(offset), pa.array([packed_by] * len(size), pa.string())], [*names, "sequence_id", "offset", "packed_by"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "share")
    return ranked.mapInArrow(given_back(run), f"{kinds}, sequence_id long, offset long, packed_by string")
