"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot signature starts at an anchor and hashes the chain of content words that follows it, anchors
skipped. Anchors are common words; a text's start, a line's end, a cell's border and punctuation that ends
a sentence or clause are anchors too, so that tables and lists have spots. A document's fingerprint is its set
of signatures. Two fingerprints are compared by the Jaccard measure of the sets, for a threshold through pruning:
sets fall in partitions by their length, in steps of the threshold, so that sets more than a partition apart are
never compared; nor are sets whose prefixes, the least signatures that a set of that length must
share one of, have none in common.

Defined results: null text counts as empty; texts of any length are read whole. A chain near the end of a text
may be shorter. A text without content words has one signature, the hash of the whole text, so equal
texts always have equal fingerprints. Repeated rows give repeated results; rows with equal doc_id are
ordered by a hash of their text, then by the text; a null doc_id comes first; the neighbour of a lone document
is itself; an empty table gives no rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.common import id_buckets, partitions, written

#: Anchors: common function words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be by for from in is it of on or that the this to was were with
au aux avec dans de des du elle en est et il la le les mais ou par pas pour que qui se sur un une
als am auf aus bei das dem den der die ein eine im ist mit nicht sich sie und von wie zu zum
al con del el ella es las lo los más no para por se su sus una y
""".split()

MARK = "\u0001"
#: Characters that end a line, a cell, a sentence or a clause.
BORDERS = "\n|.!?;:"
CHAIN = 3
#: Similarity from which two fingerprints are near.
THRESHOLD = 0.8
#: Classes that share a signature in one partition from which they are split by a second one.
LARGEST = 1000


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value as a lambda's variable, so that it is computed once a row."""
    return F.transform(F.array(value), use)[0]


def signatures(text: Column | str, chain: int = CHAIN) -> Column:
    """The sorted set of a text's spot signatures, array<string> of 8 hex digits; chain: content words of a signature."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    marked = F.replace(F.translate(F.lower(text), BORDERS, MARK * len(BORDERS)), F.lit(MARK), F.lit(f" {MARK} "))
    # no group is repeated in the expression: Java would recurse as often as it repeats
    tokens = F.split(marked, f"[^\\p{{L}}\\p{{N}}{MARK}]+")
    return _once(tokens, lambda t: _once(F.transform(t, lambda w: w.isin("", MARK, *ANCHORS)), lambda anchor: _once(_content(t, anchor), lambda words: _set_of(words, text, chain))))


def _content(tokens: Column, anchor: Column) -> Column:
    """The content words, with whether an anchor (or the text's start) is right before each."""
    after = lambda i: (i == 0) | F.get(anchor, i - 1)
    words = F.transform(tokens, lambda w, i: F.when(~F.get(anchor, i), F.struct(w.alias("word"), after(i).alias("spot"))))
    return F.filter(words, lambda x: x.isNotNull())


def _set_of(words: Column, text: Column, chain: int) -> Column:
    spots = F.transform(words, lambda w, i: F.when(w["spot"], _hash(F.concat_ws(" ", w["word"], *[F.get(words, i + k)["word"] for k in range(1, chain)]))))
    return F.when(F.size(words) == 0, F.array(_hash(text))).otherwise(F.array_sort(F.array_distinct(F.filter(spots, lambda x: x.isNotNull()))))


def _hash(text: Column) -> Column:
    """The first 32 bits of a digest that every database has, so that SQL can check the fingerprints."""
    return F.substring(F.md5(text), 1, 8)


def fingerprint(sigs: Column | str) -> Column:
    """The signature set as a string, 8 hex digits a signature in ascending order."""
    return F.array_join(sigs, "")


def likeness(a: Column | str, b: Column | str) -> Column:
    """Jaccard of two signature sets, 0 where one is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / (F.size(a) + F.size(b) - both), F.lit(0.0))


def partition_of(sigs: Column | str, threshold: float = THRESHOLD) -> Column:
    """The partition of a set by its length: sets that are near are in the same one or in neighbours."""
    return F.floor(F.log(F.size(sigs)) / math.log(1 / threshold) + 1e-9).cast("int")


def prefix_of(sigs: Column | str, threshold: float = THRESHOLD, more: int = 0) -> Column:
    """The least signatures of a set, of which two sets that are near share one (with `more`: so many and one)."""
    sigs = F.col(sigs) if isinstance(sigs, str) else sigs
    n = F.size(sigs)
    return F.slice(sigs, 1, F.least(n, n - F.ceil(n * threshold - 1e-9).cast("int") + 1 + more))


def near(a: Column | str, b: Column | str, threshold: float = THRESHOLD) -> Column:
    """Whether two sets' likeness is the threshold or more: by partition, by length, by prefix, and only then by Jaccard."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (
        F.when(F.abs(partition_of(a, threshold) - partition_of(b, threshold)) > 1, False)
        .when(least < threshold * most - 1e-9, False)
        .when(~F.arrays_overlap(prefix_of(a, threshold), prefix_of(b, threshold)), False)
        .otherwise(likeness(a, b) >= threshold - 1e-12)
    )


def near_pairs(df: DataFrame, id_col: str = "doc_id", sigs: str = "sigs", threshold: float = THRESHOLD, largest: int = LARGEST) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes with likeness >= threshold, and the membership of rows in classes.

    Rows with equal sets are one class (class_id: its smallest id). Returns
    (pairs: class_a < class_b, likeness; members: id, class_id). A set meets its own and the next partition only;
    within one, sets meet on a signature of their prefixes, which a near pair must share. Above `largest`
    classes on one signature, they meet on it and a second one: of prefixes longer by one a near pair shares two
    (for a threshold above one half).
    Null sets have no class.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(sigs).alias("s")).where(F.col("s").isNotNull())
    classes = written(rows.groupBy("s").agg(F.min("id").alias("class_id")), "spot-classes")
    members = rows.join(classes, "s").select("id", "class_id")
    prefix = classes.select("class_id", F.size("s").alias("n"), partition_of("s", threshold).alias("part"), prefix_of("s", threshold, 1).alias("more"), F.explode(prefix_of("s", threshold)).alias("sig"))
    prefix = written(prefix, "spot-prefix")
    hot = written(prefix.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("sig", F.lit(True).alias("hot")), "spot-hot")
    keyed = prefix.join(hot, "sig", "left")
    # the first two that a pair shares stand in both prefixes longer by one, so pairs of signatures are keys too
    two = F.transform(F.filter("more", lambda x: x != F.col("sig")), lambda x: F.struct(F.least(x, F.col("sig")).alias("x"), F.greatest(x, F.col("sig")).alias("y")))
    one = F.array(F.struct(F.col("sig").alias("x"), F.col("sig").alias("y")))
    keyed = keyed.select("class_id", "n", "part", F.explode(F.when(F.col("hot"), two).otherwise(one)).alias("key"))
    left = keyed.select(F.col("class_id").alias("x"), F.col("n").alias("nx"), "key", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = keyed.select(F.col("class_id").alias("y"), F.col("n").alias("ny"), "key", "part")
    met = left.join(right, ["part", "key"]).where((F.col("x") != F.col("y")) & (F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9))
    met = met.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).distinct()
    a, b = classes.select(F.col("class_id").alias("class_a"), F.col("s").alias("sa")), classes.select(F.col("class_id").alias("class_b"), F.col("s").alias("sb"))
    pairs = met.join(a, "class_a").join(b, "class_b").where(near("sa", "sb", threshold)).select("class_a", "class_b", likeness("sa", "sb").alias("likeness"))
    return pairs, members


def with_next(docs: DataFrame, own: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the next document in ascending doc_id (after the last, the first).

    With own, also own(text) as own and that of the next document as next_own, made once a text. Documents are
    dealt out by doc_id into buckets between quantiles (see id_buckets); each bucket is ordered by itself and ends
    with one added row that holds the first text of the next bucket that has rows. Which bucket that is comes from the
    buckets' numbers alone; no text but the first of each bucket is seen outside it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    bucket, _ = id_buckets(docs, 8 * partitions(spark), tie="tie")
    docs = docs.withColumn("bucket", bucket)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    # a row of three numbers a bucket
    firsts = docs.groupBy("bucket").agg(F.min(order).alias("first"))
    by = Window.orderBy("bucket")
    firsts = firsts.select("bucket", "first", F.coalesce(F.lag("bucket").over(by), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("to"))
    heads = docs.alias("d").join(F.broadcast(firsts).alias("f"), (F.col("d.bucket") == F.col("f.bucket")) & F.col("d.doc_id").eqNullSafe(F.col("f.first.doc_id")) & (F.col("d.tie") == F.col("f.first.tie")))
    heads = heads.groupBy("f.to").agg(F.min("d.text").alias("text")).select(F.col("to").alias("bucket"), F.lit(True).alias("added"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tie"), "text")
    rows = docs.select("bucket", F.lit(False).alias("added"), "doc_id", "tie", "text").unionByName(heads).repartition("bucket")
    if own is not None:
        rows = rows.withColumn("own", own(F.col("text")))
    window = Window.partitionBy("bucket").orderBy("added", F.col("doc_id").asc_nulls_first(), "tie", "text")
    names = ["text", *(["own"] if own is not None else [])]
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in names}).where(~F.col("added"))
    return rows.select("doc_id", *names, *(f"next_{c}" for c in names))


def compare_edited(docs: DataFrame, chain: int = CHAIN, threshold: float = THRESHOLD) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The edited text has the last floor(n_chars/4) code points replaced by the first as many (or all)
    of the next document. Besides the likenesses, set_partition is the fingerprint's partition by length, and
    edited_is_near and next_is_near tell by the pruned comparison whether the likeness is the threshold or more.
    """
    n = F.char_length("text")
    rows = with_next(docs, lambda text: signatures(text, chain)).select(
        "doc_id", "own", F.col("next_own").alias("next"), n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 4).cast("int"))).alias("edited"),
    )
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", signatures("edited", chain).alias("other"), "next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"),
        partition_of("own", threshold).alias("set_partition"), near("own", "other", threshold).alias("edited_is_near"), near("own", "next", threshold).alias("next_is_near"),
    )


_QUOTED = ", ".join(f"'{w}'" for w in ANCHORS)
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after
      FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, n - n // 4) || substr(after, 1, n // 4) AS edited FROM n),
t AS (SELECT doc_id, 'own' AS kind, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
k AS (SELECT doc_id, kind, string_split_regex(replace(translate(lower(text), chr(10) || '|.!?;:', repeat(chr(1), {len(BORDERS)})), chr(1), ' ' || chr(1) || ' '), '[^\\p{{L}}\\p{{N}}\\x01]+') AS k FROM t),
u AS (SELECT doc_id, kind, unnest(k) AS w, generate_subscripts(k, 1) AS i FROM k),
a AS (SELECT *, w IN ('', chr(1), {_QUOTED}) AS anchor FROM u),
s AS (SELECT *, coalesce(lag(anchor) OVER (PARTITION BY doc_id, kind ORDER BY i), true) AS spot FROM a),
c AS (SELECT *, lead(w, 1) OVER v AS w2, lead(w, 2) OVER v AS w3 FROM s WHERE NOT anchor WINDOW v AS (PARTITION BY doc_id, kind ORDER BY i)),
g AS (SELECT doc_id, kind, list_sort(list(DISTINCT substr(md5(concat_ws(' ', w, w2, w3)), 1, 8))) AS g FROM c WHERE spot GROUP BY doc_id, kind),
f AS (SELECT t.doc_id, t.kind, coalesce(g.g, [substr(md5(t.text), 1, 8)]) AS g FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.kind = g.kind),
j AS (SELECT e.doc_id, e.n, e.edited, o.g AS own, x.g AS other, len(list_intersect(o.g, x.g)) AS bx, len(o.g) + len(x.g) AS sx, len(list_intersect(o.g, y.g)) AS bn, len(o.g) + len(y.g) AS sn
      FROM e JOIN f o ON o.doc_id = e.doc_id AND o.kind = 'own' JOIN f x ON x.doc_id = e.doc_id AND x.kind = 'edited' JOIN f y ON y.doc_id = e.next_id AND y.kind = 'own')
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(other, '') AS edited_fingerprint,
       bx::DOUBLE / (sx - bx) AS near_edited, bn::DOUBLE / (sn - bn) AS near_next, floor(ln(len(own)) / {math.log(1 / THRESHOLD)!r} + 1e-9)::INT AS set_partition,
       bx::DOUBLE / (sx - bx) >= {THRESHOLD} - 1e-12 AS edited_is_near, bn::DOUBLE / (sn - bn) >= {THRESHOLD} - 1e-12 AS next_is_near
FROM j
"""
