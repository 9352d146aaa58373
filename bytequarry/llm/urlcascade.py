"""URL filters by a Bloom filter cascade over the corpus's complete key universe.

Level 0 encodes the listed keys, level 1 the other keys of the universe that pass level 0, level 2
the listed keys that pass level 1, and so on until no key passes wrongly. For any key of the
universe, the first level that does not hold it tells membership exactly, without a join.

A rule is a host with a path prefix, such as `example.net/en/`. It fits its host and all
subdomains where the url's path starts with its path; the longest fitting rule wins (between rules
of one length, block). A url's key universe is each of its host's suffixes of as many labels as
rules have, with each path prefix as long as a rule's.

Defined results: a null url or one without `://` has an empty host and path, no rule, and is
allowed, as is any url that no rule fits. Urls of any length are taken whole. Repeated rows repeat. An empty
table gives no rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm.common import written

#: Levels after which only keys whose 128 bits of hash are equal could be left.
MAX_LEVELS = 200

#: The rules of the query: fixed values of its contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), *LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _positions(h: np.ndarray, g: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit positions of keys at a level, hashes x keys; h and g are two hashes of each key."""
    with np.errstate(over="ignore"):
        a = (h ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(29)
        b = ((g + np.uint64(level)) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        b ^= b >> np.uint64(31)
        return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(hashes)])


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def holds(self, h: np.ndarray, g: np.ndarray, level: int) -> np.ndarray:
        at = _positions(h, g, level, self.bits, self.hashes)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def listed(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed."""
        out, open_ = np.zeros(len(h), bool), np.arange(len(h))
        for i, level in enumerate(self.levels):
            held = level.holds(h[open_], g[open_], i)
            out[open_[~held]] = i % 2 == 1
            open_ = open_[held]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def build(keys: DataFrame) -> Cascade:
    """The cascade over keys (h long, g long, listed boolean), one row a key.

    With l listed keys of u others, level 0 lets l / (sqrt(2) u) of the others pass, every later level half of
    what should not: so all levels together take about l * (1.44 log2(u / l) + 5) bits, which follow the rule
    list and hardly the corpus (52 bits a rule at 2**33 keys to a rule). Tasks set bits of their own, words are
    merged by bit_or, and only the words of a level come to the driver. What passes a level, which after level 0
    is about as many keys as are listed, is written, so that no level reads the whole universe again.
    """
    spark = keys.sparkSession
    cascade, left = Cascade(), keys
    for i in range(MAX_LEVELS):
        sizes = {r["listed"]: r["n"] for r in left.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        n, others = sizes.get(i % 2 == 0, 0), sizes.get(i % 2 == 1, 0)
        if n == 0:
            return cascade
        rate = min(0.5, max(n, 1) / (math.sqrt(2) * max(others, 1))) if i == 0 else 0.5
        bits, hashes = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2))), max(1, round(math.log2(1 / rate)))

        def words(batches, i=i, bits=bits, hashes=hashes):
            for batch in batches:
                at = np.unique(_positions(_unsigned(batch.column("h")), _unsigned(batch.column("g")), i, bits, hashes))
                if len(at):
                    word, start = np.unique(at >> np.uint64(6), return_index=True)
                    value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

        side = left.where(F.col("listed") == F.lit(i % 2 == 0)).select("h", "g")
        found = side.mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
        level = Level(bits, hashes, np.zeros((bits + 63) // 64, np.uint64))
        level.words[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
        cascade.levels.append(level)
        shared = spark.sparkContext.broadcast(level)

        def passing(batches, i=i, shared=shared):
            for batch in batches:
                yield batch.filter(pa.array(shared.value.holds(_unsigned(batch.column("h")), _unsigned(batch.column("g")), i)))

        if others == 0:
            return cascade
        # what the level encodes passes it, and so stays for the level after the next
        left = written(left.mapInArrow(passing, "h long, g long, listed boolean"), f"url-level-{i}")
    raise ValueError("keys with equal hashes on both sides")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every url.

    rules: (host, path prefix, block or allow). They come as a list, which is what bounds the broadcast:
    the filters made of them (see build) are smaller than the list itself.
    """
    spark = pages.sparkSession
    labels, lengths = max([r[0].count(".") + 1 for r in rules], default=0), sorted({len(r[1]) for r in rules})
    rows = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), F.size(parts))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.filter(F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda x: x.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    rows = rows.withColumn("keys", F.when((F.col("host") != "") & F.lit(bool(rules)), keys).otherwise(F.array().cast("array<string>")))
    named = spark.createDataFrame([(h + p, v == "block") for h, p, v in rules] or [("", True)], "key string, block boolean").where(F.lit(bool(rules)))
    universe = rows.select(F.explode("keys").alias("key")).distinct().select("key", F.lit(False).alias("b"), F.lit(False).alias("a"))
    universe = universe.union(named.select("key", "block", ~F.col("block"))).groupBy("key").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    universe = written(universe.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g"), "b", "a"), "url-keys")
    block, allow = (build(universe.select("h", "g", F.col(c).alias("listed"))) for c in ("b", "a"))
    shared = spark.sparkContext.broadcast((block, allow))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, h, g = (batch.column(c) for c in ("keys", "h", "g"))
            counts = np.diff(keys.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), counts)
            flat, hv, gv = keys.flatten(), _unsigned(h.flatten()), _unsigned(g.flatten())
            blocked, allowed = shared.value[0].listed(hv, gv), shared.value[1].listed(hv, gv)
            rule, verdict, best = [None] * batch.num_rows, [default] * batch.num_rows, [(-1, False)] * batch.num_rows
            for j in np.flatnonzero(blocked | allowed):
                key, i = flat[int(j)].as_py(), owner[j]
                rank = (len(key), bool(blocked[j]))
                if rank > best[i]:
                    rule[i], verdict[i], best[i] = key, "block" if blocked[j] else "allow", rank
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    hashed = rows.select("page_id", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("h"), F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k)).alias("g"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return hashed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


ORACLE = """
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.page_id, coalesce(p.host, '') AS host, p.path, rhost || rpath AS rule, v,
             row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
      FROM p LEFT JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
