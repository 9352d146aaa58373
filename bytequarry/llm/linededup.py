"""Line dedup over levelled sorted runs of line hashes.

The space of 128-bit line hashes is cut into ranges. A run is a folder with a file a range, which holds
(hash, documents that have it) in hash order. A store keeps runs in levels, and apart from them a run of the
settled hashes, those that `enough` documents are known to hold. A batch of documents is dealt out by range
and sorted, the only exchange there is. The task of a range then merge-anti-joins the batch with the settled
run (whose counts go on), and adds what is left as a run of level 0; where a level has `fan` runs, the same
task merges their files of its range with it into a run of the next level, and moves what has become enough to
the settled run. Once all batches are in, the tasks of the ranges merge the runs that are left; the settled
hashes are then known for the whole corpus, and their lines are dropped everywhere.

Defined results: null or empty text is one empty line, whose empty key never counts; a row is one
document, so repeated rows count each; a document whose lines all go has an empty text; lines keep
their own bytes; texts and lines of any length are read whole; an empty table gives no rows. Other columns,
whatever their names, stay as they are in `dedup`, and are never looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm.common import given_back, open_file, partitions, put_file, raw_texts, remove_folder, scratch, unused, written

BLANK = b" \t\n\x0b\x0c\r"
#: Settled hashes that are broadcast at most (16 bytes each): all, or the ones that most documents hold; others are joined.
BROADCAST_LIMIT = 500_000
#: Rows of a range, of 24 bytes each, that a task holds at once: there are as many ranges as that takes.
RANGE_ROWS = 1 << 21
BATCHES, FAN = 4, 2
#: Keys that a task counts before it gives their rows.
HELD = 200_000

Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def key_of(line: bytes) -> bytes:
    """The line with white space stripped at both ends and A-Z lower-cased (UTF-8 letters keep their bytes)."""
    return line.strip(BLANK).lower()


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def hashes(docs: DataFrame, least_chars: int = 1, text: str = "text") -> DataFrame:
    """hi and lo of the hash of each distinct key of each document, and docs: how many documents hold it, added up within a task by HELD keys at a time."""

    def rows(found: Counter) -> pa.RecordBatch:
        both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.fromiter(found.values(), np.int64, len(found)))], ["hi", "lo", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc in raw_texts(batch, text):
                keys = {key_of(line) for line in doc.split(b"\n")}
                found.update(_digest(k) for k in keys if len(k) >= least_chars and (least_chars <= 1 or len(k.decode()) >= least_chars))
                if len(found) >= HELD:
                    yield rows(found)
                    found.clear()
        if found:
            yield rows(found)

    return docs.select(F.col(text).cast("string").alias(text)).mapInArrow(given_back(run), "hi long, lo long, docs long")


def merge(runs: list[Run]) -> Run:
    """Sorted runs as one, the documents of equal hashes added up."""
    hi, lo, docs = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(hi, kind="stable")  # of runs in order: a merge
    hi, lo, docs = hi[order], lo[order], docs[order]
    if ((hi[1:] == hi[:-1]) & (lo[1:] < lo[:-1])).any():
        order = np.lexsort((lo, hi))
        hi, lo, docs = hi[order], lo[order], docs[order]
    if not len(hi):
        return hi, lo, docs
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[first], lo[first], np.add.reduceat(docs, first)


def places(run: Run, known: Run) -> np.ndarray:
    """Where each hash of a run is in another one; -1 for none."""
    at, out = np.searchsorted(known[0], run[0]), np.full(len(run[0]), -1, np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        open_ = open_[at[open_] < len(known[0])]
        open_ = open_[known[0][at[open_]] == run[0][open_]]
        same = known[1][at[open_]] == run[1][open_]
        out[open_[same]] = at[open_[same]]
        open_ = open_[~same]  # equal first halves: on to the next one
        at[open_] += 1
    return out


class LineStore:
    """Runs of line hashes below the session's shared folder; levels[k] holds the names of level k's runs."""

    def __init__(self, spark: SparkSession, enough: int, bits: int = 3, fan: int = FAN) -> None:
        """2**bits ranges."""
        self.spark, self.enough, self.bits, self.fan = spark, enough, bits, fan
        self.folder = scratch(spark, "line-store")
        self.levels: list[list[str]] = []
        self.known: str | None = None
        self.added = 0

    def _file(self) -> Callable[[str, int], str]:
        folder = self.folder
        return lambda run, r: f"{folder}/{run}/range-{r:07d}"

    def _range(self):
        """The range of a hash, ascending with it."""
        return (F.shiftright("hi", 64 - self.bits) + (1 << self.bits - 1)).cast("int") if self.bits else F.lit(0)

    def add(self, lines: DataFrame) -> None:
        """A batch: lines has hi, lo and docs, a hash in one row or several."""
        due, k = [], 0
        while k < len(self.levels) and len(self.levels[k]) + 1 >= self.fan:
            due += self.levels[k]
            k += 1
        run, settled, before = f"run-{self.added}", f"settled-{self.added}", self.known
        enough, count, file = self.enough, 1 << self.bits, self._file()

        def of_range(r: int, own: Run) -> None:
            known = read_run(file(before, r)) if before else NO_ROWS
            at = places(own, known)
            known[2][at[at >= 0]] += own[2][at >= 0]
            left = merge([tuple(c[at < 0] for c in own), *(read_run(file(d, r)) for d in due)])
            done = left[2] >= enough
            put_file(file(settled, r), run_bytes(merge([known, tuple(c[done] for c in left)])))
            put_file(file(run, r), run_bytes(tuple(c[~done] for c in left)))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r, own in by_range(batches):
                of_range(r, merge([own]))
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32())], ["range"])

        # a row of no documents in each range, so that every range has its task
        every = self.spark.range(count).select(F.col("id").cast("int").alias("range"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), F.lit(0).cast("long").alias("docs"))
        rows = lines.select(self._range().alias("range"), "hi", "lo", "docs").unionByName(every)
        self.plan = rows.repartitionById(count, F.col("range")).sortWithinPartitions("range", "hi", "lo").mapInArrow(given_back(task), "range int")
        # a number a range comes to the driver
        if self.plan.toArrow().num_rows != count:
            raise RuntimeError("a range without a task")
        for name in [*due, *([before] if before else [])]:
            remove_folder(f"{self.folder}/{name}")
        self.levels[:k] = [[] for _ in range(k)]
        self.levels += [[] for _ in range(k + 1 - len(self.levels))]
        self.levels[k].append(run)
        self.known, self.added = settled, self.added + 1

    def settled(self) -> DataFrame:
        """hi, lo and docs of the hashes that enough documents hold, by a merge of all runs, range by range."""
        runs, known, enough, file = [r for level in self.levels for r in level], self.known, self.enough, self._file()

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.column("id").to_pylist():
                    left, settled = merge([read_run(file(name, r)) for name in runs]), read_run(file(known, r))
                    # older runs may hold counts of what has been settled since
                    counts = (left[2] >= enough) | (places(left, settled) >= 0)
                    found = merge([settled, tuple(c[counts] for c in left)])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["hi", "lo", "docs"])

        if known is None:
            return self.spark.createDataFrame([], "hi long, lo long, docs long")
        return self.spark.range(0, 1 << self.bits, 1, 1 << self.bits).mapInArrow(given_back(task), "hi long, lo long, docs long")


NO_ROWS: Run = tuple(np.zeros(0, np.int64) for _ in range(3))


def run_bytes(run: Run) -> bytes:
    return np.stack(run).astype("<i8").tobytes()


def read_run(path: str) -> Run:
    with open_file(path, "r") as source:
        return tuple(np.frombuffer(source.read(), "<i8").reshape(3, -1).copy())


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Run]]:
    """The rows of each range of rows sorted by range; rows without a hash only name their range."""
    now, held = None, []
    for batch in batches:
        ranges = batch.column("range").to_numpy()
        for r in np.unique(ranges):
            if now is not None and r != now:
                yield int(now), merge(held)
                held = []
            now = r
            part = batch.filter(pa.array((ranges == r) & batch.column("hi").is_valid().to_numpy(zero_copy_only=False)))
            held.append(tuple(part.column(c).to_numpy() for c in ("hi", "lo", "docs")))
    if now is not None:
        yield int(now), merge(held)


def _cut(docs: DataFrame, shared, own: str | None, text: str, names: list[str] | None) -> DataFrame:
    """Without the lines whose digests are in the broadcast set or, row by row, in the column `own`.

    names: of the two counts beside all columns; None for doc_id, n_lines, n_dropped and kept_sha256.
    """
    columns = [c for c in docs.columns if c != own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = shared.value
        for batch in batches:
            total, dropped, kept = [], [], []
            more = batch.column(own).to_pylist() if own else [None] * batch.num_rows
            for doc, found in zip(raw_texts(batch, text), more, strict=True):
                here = {np.array([x["hi"], x["lo"]], "<i8").tobytes() for x in found or ()}
                lines = doc.split(b"\n")
                stay = [x for x in lines if not (k := key_of(x)) or ((d := _digest(k)) not in everywhere and d not in here)] if everywhere or here else lines
                total.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            counts = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            if names:
                kind = batch.schema.field(text).type
                keep = [batch.column(c) if c != text else pa.array(kept, pa.binary()).cast(pa.string()).cast(kind) for c in columns]
                yield pa.RecordBatch.from_arrays([*keep, *counts], [*columns, *names])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    if names:
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + f", `{names[0]}` long, `{names[1]}` long"
    else:
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string"
    return docs.mapInArrow(given_back(run), schema)


def settle(docs: DataFrame, min_docs: int = 10, least_chars: int = 1, batches: int = BATCHES, text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """hi, lo and docs of the keys that min_docs documents hold, through a store fed batch by batch."""
    spark = docs.sparkSession
    lines = hashes(docs, least_chars, text).withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(batches)))
    path = scratch(spark, "line-hashes")
    lines.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema("hi long, lo long, docs long, batch int").parquet(path)
    ranges = max(partitions(spark), -(-stored.count() // range_rows), 1)
    store = LineStore(spark, min_docs, (ranges - 1).bit_length())
    for b in range(batches):
        store.add(stored.where(F.col("batch") == b))
    return written(store.settled(), "settled-lines")


def drop(docs: DataFrame, settled: DataFrame, text: str = "text", full: bool = False, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Drop the settled keys' lines (settled: hi, lo, docs).

    full: the columns of docs with the text that is left, then n_lines and n_dropped (with underscores before
    them where docs has such columns); else doc_id, n_lines, n_dropped and kept_sha256. Up to `limit` settled
    hashes are broadcast. Of more, those are that so many documents hold that no more than `limit` can be
    so common; every document gets its other ones by a join on the hash, in which no key is hot any more.
    The rows are the same either way.
    """
    spark = docs.sparkSession
    docs = docs if full else docs.select("doc_id", F.col(text).cast("string").alias(text))
    names = [unused(c, docs.columns) for c in ("n_lines", "n_dropped")] if full else None
    size = settled.agg(F.count("*").alias("n"), F.sum("docs").alias("docs")).first()
    # of hashes held by S documents in all, at most `limit` are held by more than S / limit each
    common = 0 if size["n"] <= limit else size["docs"] // max(limit, 1) + 1
    heavy = settled.where(F.col("docs") >= common).toArrow() if limit else settled.limit(0).toArrow()
    both = np.stack([heavy.column(c).to_numpy() for c in ("hi", "lo")], axis=1).astype("<i8")
    shared = spark.sparkContext.broadcast(frozenset(row.tobytes() for row in both))
    if size["n"] <= limit:
        return _cut(docs, shared, None, text, names)
    row, own = unused("row", docs.columns), unused("gone", docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "line-rows")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for n, doc in zip(batch.column(row).to_pylist(), raw_texts(batch, text), strict=True):
                keys = {d for line in doc.split(b"\n") if (k := key_of(line)) and (d := _digest(k)) not in shared.value}
                owner += [n] * len(keys)
                found += keys
            both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], [row, "hi", "lo"])

    hits = rows.select(row, text).mapInArrow(given_back(keyed), f"`{row}` long, hi long, lo long").join(settled.select("hi", "lo"), ["hi", "lo"], "left_semi")
    hits = hits.groupBy(row).agg(F.collect_list(F.struct("hi", "lo")).alias(own))
    return _cut(rows.join(hits, row, "left").drop(row), shared, own, text, names)


def dedup(docs: DataFrame, min_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """docs with the common lines gone, n_chars (if there is one) renewed, and its columns as they were."""
    left = drop(docs, settle(docs, min_docs, least_chars), full=True)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


ORACLE = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id
"""
