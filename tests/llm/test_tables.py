import hashlib
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from bytequarry.llm import bpe, common, langid, linededup, media, packing, planes, registry, simhash, simhash_wide, spotsigs, tokens, toxicity, urlcascade

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, bucket string, hi string, fp string, length string, page_id string"
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = "word " * 30_000 + "\n" + "y" * 100_000


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "The cat sat on the mat\nshared line"), (2, None), (None, "no id"), (4, ""), (1, "The cat sat on the mat\nshared line"), (7, LONG), (8, "\n\n"), (None, None), (9, "!!! 123")]
    return spark.createDataFrame([(d, t, None, None, None, "s", "b", "h", "f", "l", "p") for d, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def test_spotsigs(spark, odd, none):
    rows = spotsigs.compare_edited(odd).collect()
    assert len(rows) == 9
    by_text = {}
    for r in rows:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert len(by_text[1, 34]) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert spotsigs.compare_edited(none).count() == 0
    one = spotsigs.compare_edited(odd.where("doc_id = 8")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_spotsigs_next_document(spark):
    docs = spark.createDataFrame([(i * 3 % 101, f"text of {i} " * (i % 7)) for i in range(101)], "doc_id long, text string")
    want = sorted(docs.collect())
    got = {r.doc_id: r for r in spotsigs.compare_edited(docs).collect()}
    for a, b in zip(want, want[1:] + want[:1]):
        q = len(a.text) // 4
        assert got[a.doc_id].edited_sha256 == hashlib.sha256((a.text[: len(a.text) - q] + b.text[:q]).encode()).hexdigest()


def reference_spots(text):
    """Spot signatures in plain Python."""
    anchors, bare, marked, mark = set(spotsigs.ANCHORS), [], [], True
    for token in regex.findall(r"[\p{L}\p{N}]+|[\n|.!?;:\x01]", text.lower()):
        if token in anchors or token in "\n|.!?;:\x01":
            mark = True
        else:
            bare.append(token)
            marked.append(mark)
            mark = False
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()[:8]
    return {digest(" ".join(bare[i : i + 3])) for i, m in enumerate(marked) if m} or {digest(text)}


def test_spotsigs_by_brute_force(spark, odd):
    """Fingerprints, likenesses and the pruned comparison of a whole table, and of odd texts, against plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in spotsigs.compare_edited(docs).collect()}
    hexes = lambda s: "".join(sorted(s))
    like = lambda a, b: len(a & b) / len(a | b)
    near = 0
    for (d, text), (_, after) in zip(texts, texts[1:] + texts[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        own, other, following = reference_spots(text), reference_spots(edited), reference_spots(after)
        r = got[d]
        assert (r.fingerprint, r.edited_fingerprint, r.n_chars) == (hexes(own), hexes(other), len(text))
        assert r.near_edited == pytest.approx(like(own, other)) and r.near_next == pytest.approx(like(own, following))
        assert (r.edited_is_near, r.next_is_near) == (like(own, other) >= 0.8, like(own, following) >= 0.8)
        near += r.edited_is_near + r.next_is_near
    assert near and len(got) == len(texts)
    odd_texts = ["A b c. d|e\nf; the g", "the of", "", "É ß straße İ 12 x\x01y", "a" * 70_000 + " b", "The The the cat"]
    df = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string").select("doc_id", spotsigs.signatures("text").alias("s"))
    assert {r.doc_id: set(r.s) for r in df.collect()} == {i: reference_spots(t) for i, t in enumerate(odd_texts)}


def test_next_document_of_hot_and_missing_ids(spark):
    """Half of the rows have one id, a third none: the order is by id, hash of the text, text, and the buckets split them."""
    rows = [(7, f"hot {i}") for i in range(300)] + [(None, f"none {i % 150}") for i in range(200)] + [(i, f"own {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest(r[1], 42) + 2**63) % 2**64, r[1])
    order = sorted(rows, key=key)
    want = sorted(((d, t, n[1]) for (d, t), n in zip(order, order[1:] + order[:1])), key=repr)
    found = spotsigs.with_next(docs)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in found.collect()), key=repr) == want
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    bucket, count = common.id_buckets(keyed, 20, tie="tie")
    sizes = {r.b: r.n for r in keyed.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
    assert max(sizes) < count and max(sizes.values()) <= 80


@pytest.mark.parametrize("largest", [spotsigs.LARGEST, 2])
def test_spotsigs_likeness_and_pairs(spark, largest):
    rng = np.random.default_rng(1)
    sets = [sorted(set(rng.integers(0, 60, rng.integers(1, 30)).tolist())) for _ in range(60)]
    sets += [s[:-1] for s in sets if len(s) > 8] + [sets[0]] * 3
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, sigs array<bigint>")
    found, members = spotsigs.near_pairs(df, threshold=0.7, largest=largest)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    assert {r.id: r.class_id for r in members.collect()} == {i: first[tuple(s)] for i, s in enumerate(sets)}
    want = set()
    for s, i in first.items():
        for t, j in first.items():
            if i < j and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.7:
                want.add((i, j))
    assert {(r.class_a, r.class_b) for r in found.collect()} == want and want


def test_url_cascade(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x", "http://example.net/de/", "https://x.example.com/de/1?q", "http://notexample.com/de/", "http://org/fr/", "http://a.org/fr", "http://net", "http://net?x", "ftp://u@h.net:80/y#z", "http://" + "a." * 5000 + "net/", "http://example.net/en/", "http://example.net/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlcascade.judge(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4][2:] == ("net/", "block")
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2:] == (None, "allow") and got[7][2:] == ("org/fr/", "allow")
    assert got[8][2:] == got[9][2:] == got[10][2:] == (None, "allow") and got[11] == ("u@h.net:80", "/y", None, "allow")
    assert got[12][2:] == ("net/", "block") and got[13] == got[14]
    assert urlcascade.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urlcascade.judge(pages, []).collect()} == {"allow"}


def test_url_cascade_beside_clashing_columns(spark):
    urls = [(i, f"http://h{i % 9}.example.net/{'en' if i % 2 else 'de'}/" + "x" * (i * 5000)) for i in range(12)]
    plain = spark.createDataFrame([*urls, (99, None)], "page_id long, url string")
    extra = plain.select("*", *[F.lit("other").alias(c) for c in ("host", "path", "rule", "verdict", "keys", "key", "h", "g", "listed")])
    want = pairs(urlcascade.judge(plain), "page_id", "host", "path", "rule", "verdict")
    assert pairs(urlcascade.judge(extra), "page_id", "host", "path", "rule", "verdict") == want and len(want) == 13


def test_cascade_is_exact(spark):
    for listed in (F.col("id") % 7 == 0, F.col("id") < 2, F.col("id") >= 2, F.lit(True), F.lit(False)):
        keys = spark.range(6000).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("g"), listed.alias("listed"))
        model, rows = urlcascade.build(keys), keys.toPandas()
        assert (model.listed(rows.h.to_numpy().view(np.uint64), rows.g.to_numpy().view(np.uint64)) == rows.listed.to_numpy()).all()
        few, many = int(rows.listed.sum()), int((~rows.listed).sum())
        if 0 < few < many:
            # the filters follow the listed keys, not the universe
            assert sum(x.bits for x in model.levels) <= few * (1.44 * np.log2(many / few) + 8) + 64 * len(model.levels)


def test_language(spark, odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == 9 and {r.lang_pred for r in got} == {"und"} and {r.score for r in got} == {0.0}
    assert langid.identify(none).count() == 0 and langid.known(odd).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    held = held[held.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    extra = docs.withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit(1))
    kept = langid.known(extra)
    assert kept.columns == extra.columns and kept.where("score = 'own' and lang_pred = 1").count() == kept.count() > 190


def test_more_languages_than_a_word_has_bits(spark):
    rng = np.random.default_rng(3)
    words = {f"l{k:02d}": ["".join(chr(0x4E00 + 40 * k + int(c)) for c in rng.integers(0, 40, 3)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(words[lang], 20)), lang) for i, lang in enumerate(sorted(words) * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.masks.shape == (2, langid.SLOTS) and model.predict([r[1] for r in rows])[0] == [r[2] for r in rows]


def test_language_by_brute_force(spark):
    """The filter, its masks and the corrected shares, one n-gram at a time in plain Python, give the same languages and scores."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    slots, big = 4096, (1 << 64) - 1
    fit_on = docs.where(~langid.held_out())
    model = langid.fit(fit_on, slots=slots)

    def grams(text):
        out, last = [], None
        for c in f" {text.lower()} ":
            c = c if c.isalpha() else " "
            if c != " " or last != " ":
                out.append(c)
            last = c
        return ["".join(out[i : i + 4]) for i in range(len(out) - 3)]

    def at(gram):
        h = 0
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & big
            h ^= h >> 29
        step = h >> 32 | 1
        return [(h + k * step & big) % slots for k in range(2)]

    rows = fit_on.where("lang is not null and lang <> ''").collect()
    held = {}
    for r in rows:
        for g in set(grams(r.text or "")):
            held[g, r.lang] = held.get((g, r.lang), 0) + 1
    filled = {x: set() for x in model.languages}
    for (g, lang), n in held.items():
        if n >= 3:
            filled[lang].update(at(g))
    rates = {x: min((len(f) / slots) ** 2, 0.99) for x, f in filled.items()}
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    for r in docs.limit(60).collect():
        found = [at(g) for g in grams(r.text or "")]
        share = {x: min(1, max(0, (sum(all(s in f for s in g) for g in found) / max(1, len(found)) - rates[x]) / (1 - rates[x]))) for x, f in filled.items()}
        best = max(model.languages, key=lambda x: share[x])
        want = (best, share[best]) if any(c.isalpha() for c in r.text or "") else ("und", 0.0)
        assert got[r.doc_id].lang_pred == want[0] and got[r.doc_id].score == pytest.approx(want[1])


def test_whole_table_equals_the_library(spark):
    """Ids of every document, through the shard files and through the segment tree, are the tokenizers library's."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    words, pieces = (tokens.encoder(tokens.vocabulary(n), w) for n, w in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)))
    stored = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in planes.read(planes.write(docs, planes.encode(docs))).collect()}
    merged = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect()}
    start = 0
    for d, text in texts:
        ids = words.whole(text) + (1).to_bytes(4, "little")
        assert stored[d] == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
        ids = pieces.whole(text)
        back = pieces.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert merged[d] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert len(stored) == len(merged) == len(texts)


def test_planes(spark, odd, none):
    rows = [r.asDict() for r in planes.read(planes.write(odd, planes.encode(odd), bits=1, chunk_ids=50), keep_ids=True).collect()]
    assert len(rows) == 9
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 2, 4, 7, 8, 9]
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["n_tokens"] and bytes(r["ids"][-4:]) == b"\1\0\0\0"
        at += r["n_tokens"]
    assert planes.read(planes.write(none, planes.encode(none))).count() == 0


def test_planes_of_hot_and_missing_ids(spark):
    rows = [(7, f"hot {i}") for i in range(200)] + [(None, f"none {i}") for i in range(150)] + [(i, f"own {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = planes.write(docs, planes.encode(docs))
    assert manifest.agg(F.max("n_docs")).first()[0] <= 150 and manifest.count() >= 7
    found = sorted(planes.read(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 150 + sorted([*[7] * 200, *range(100)])
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]


@pytest.mark.parametrize("limit", [linededup.BROADCAST_LIMIT, 1, 0])
def test_line_dedup(spark, odd, none, limit):
    docs = spark.createDataFrame([(i, f" SHARED \t\nown {i}\n\nfour" + ("\nfour" if i < 2 else "")) for i in range(10)] + [(20, None), (21, "shared"), (22, "other"), (22, "other")], "doc_id long, text string")
    settled = linededup.settle(docs, min_docs=10)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.drop(docs, settled, limit=limit).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[0] == (5, 3, sha("own 0\n")) and got[5] == (4, 2, sha("own 5\n"))
    assert got[20] == (1, 0, sha("")) and got[21] == (1, 1, sha("")) and got[22] == (1, 0, sha("other"))
    assert linededup.drop(docs, settled, limit=limit).count() == 14
    kept = linededup.dedup(odd, min_docs=2)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").select("text", "n_chars").distinct().collect() == [("", 0)]
    assert linededup.dedup(none).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["__gone", "__row", "__lines", "gone", "row", "n_lines", "N_Dropped", "hi", "lo", "docs", "batch"]
    docs = spark.createDataFrame([(i, "shared\nown", *names) for i in range(12)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for limit in (100, 1, 0):
        left = linededup.drop(docs, linededup.settle(docs), full=True, limit=limit)
        assert left.columns[: len(docs.columns)] == docs.columns and left.select(*names).distinct().collect() == [tuple(names)]
        assert left.select("text", left.columns[-1]).distinct().collect() == [("", 2)]
    assert linededup.dedup(docs).columns == docs.columns


@pytest.mark.parametrize("bits,fan", [(0, 2), (2, 2), (3, 3)])
def test_line_store_levels(spark, bits, fan):
    """Runs are merged level by level; what is settled is what a plain count says; only a batch's own rows are exchanged."""
    rng = np.random.default_rng(8)
    store, counts = linededup.LineStore(spark, 5, bits, fan), {}
    for n in range(5):
        rows = [(int(h), int(l), int(d)) for h, l, d in zip(rng.choice([-(2**63), -(2**62), -1, 0, 1, 2**62, 2**63 - 1], 60), rng.integers(-3, 3, 60), rng.integers(1, 3, 60))]
        for h, l, d in rows:
            counts[h, l] = counts.get((h, l), 0) + d
        store.add(spark.createDataFrame(rows, "hi long, lo long, docs long"))
        assert sum(map(len, store.levels)) == sum(int(x) for x in np.base_repr(n + 1, fan))
        plan = store.plan._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("Exchange ") == 1 and "Join" not in plan and "Aggregate" not in plan
        got = {(r.hi, r.lo): r.docs for r in store.settled().collect()}
        assert got == {k: d for k, d in counts.items() if d >= 5}
    assert "Exchange" not in store.settled()._jdf.queryExecution().executedPlan().toString()
    store.add(spark.createDataFrame([], "hi long, lo long, docs long"))
    assert {(r.hi, r.lo): r.docs for r in store.settled().collect()} == got


def test_packing(spark, odd, none):
    rows = packing.pack(odd, capacity=64).toPandas()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 64 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    per = rows.groupby("doc_id", dropna=False).length.sum()
    assert per[2] == 1 and per[4] == 1 and rows.doc_id.isna().sum() == 2
    long = rows[rows.doc_id == 7].sort_values("piece")
    assert (long.length[1:] == 64).all() and long.start.tolist() == [0, *np.cumsum(long.length)[:-1]]
    assert packing.pack(none).count() == 0


def test_packing_equals_the_library(spark):
    """Every piece of the whole table: its ids are the library's, its place its own, and bin completion found no more sequences than best fit."""
    library = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"), False).whole
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want, counts = {}, {}
    for r in docs.collect():
        ids = library(r.text or "") + bytes(4)
        n = len(ids) // 4
        cuts = [0, *range(n % 2048 or 2048, n + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, i] = (a, b - a, zlib.crc32(ids[4 * a : 4 * b]))
            counts[b - a] = counts.get(b - a, 0) + 1
    rows = packing.pack(docs).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows.itertuples()} == want and len(rows) == len(want)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert set(rows.packed_by) == {"completion"}
    assert packing.least(counts, 2048) <= rows.sequence_id.nunique() <= sum(n for _, n in packing.best_fit(counts, 2048))


def test_bpe(spark, odd, none):
    rows = bpe.round_trip(odd, keep=True).collect()
    texts = sorted(r.text or "" for r in odd.collect())
    assert sorted(r.decoded for r in rows) == texts
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in rows)
    assert bpe.round_trip(none).count() == 0


@pytest.mark.parametrize("largest", [simhash.LARGEST, 3])
def test_simhash(spark, odd, none, largest):
    rng = np.random.default_rng(5)
    base = [" ".join(str(x) for x in rng.integers(0, 5000, 400)) for _ in range(8)]
    texts = [b.replace(" 1", " 2", k) for b in base for k in range(12)] + ["", None, " ", "one"]
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs, largest=largest).collect()
    ids, fps = [r.doc_id for r in rows], [r.fp & (2**64 - 1) for r in rows]
    forest = simhash.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                forest.join(i, j)
    least = {}
    for i, d in enumerate(ids):
        least[forest.root(i)] = min(d, least.get(forest.root(i), 1 << 60))
    assert [r.component_id for r in rows] == [least[forest.root(i)] for i in range(len(rows))]
    if largest > 3:
        kept = simhash.keep_one(odd)
        assert kept.columns == odd.columns
        assert pairs(kept.where("doc_id is not null"), "doc_id") == [[1], [2], [7], [9]]
        assert simhash.near_duplicates(none).count() == 0


def word_sets(texts):
    """The five-word shingles of each text, as tuples."""
    words = {d: tuple(re.split("[\\x20\\x09-\\x0D]+", t.strip(" \t\n\x0b\x0c\r").translate(LOWER))) for d, t in texts.items()}
    return {d: {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w != ("",) else frozenset() for d, w in words.items()}


def check_near_classes(texts, kept):
    """One of each group of texts stays: pairs of 0.8 or more are in one group, and groups hang together by pairs well above 0.6."""
    sets, ids = word_sets(texts), sorted(texts)
    strict, loose = simhash.Forest(len(ids)), simhash.Forest(len(ids))
    for i, a in enumerate(ids):
        for j in range(i):
            both, either = len(sets[a] & sets[ids[j]]), len(sets[a] | sets[ids[j]])
            alike = both / either if either else 1.0
            if alike >= 0.8:
                strict.join(i, j)
            if alike >= 0.65:
                loose.join(i, j)
    assert {d for i, d in enumerate(ids) if loose.root(i) == i} <= kept <= {d for i, d in enumerate(ids) if strict.root(i) == i}


@pytest.mark.parametrize("largest", [simhash_wide.LARGEST, 5])
def test_simhash_wide(spark, odd, none, largest, monkeypatch):
    if largest < 10:
        monkeypatch.setattr(simhash_wide, "REPRESENTATIVES", 3)
    rng = np.random.default_rng(6)
    texts = ["", None, " \n", "one", "ONE ", "one two", "one two three four five", "one two three four six", "É b c d e f", "é b c d e f"]
    for _ in range(12):
        words = [str(x) for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        for _ in range(10):
            copy = list(words)
            for k in rng.choice(len(copy), int(rng.integers(0, len(copy) // 60 + 1)), replace=False):
                copy[k] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(zip(map(int, rng.permutation(len(texts))), texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_wide.keep_one(docs, largest=largest).collect()}
    check_near_classes({r.doc_id: r.text or "" for r in docs.collect()}, kept)
    if largest > 5:
        found = simhash_wide.keep_one(odd)
        assert found.columns == odd.columns
        assert pairs(found.where("doc_id is not null"), "doc_id") == [[1], [2], [7], [9]]
        assert simhash_wide.keep_one(none).count() == 0


@pytest.mark.parametrize("keep_one", [simhash.keep_one, simhash_wide.keep_one])
def test_repeated_and_missing_ids(spark, keep_one):
    one, two = (" ".join(f"{w}{i}" for i in range(200)) for w in "ab")
    docs = spark.createDataFrame([(1, one), (2, two), (2, one), (2, two), (None, one), (None, two), (None, two), (3, two + " "), (4, None), (4, None)], "doc_id int, text string")
    want = [(1, one), (2, two), (4, None), (None, one), (None, two), (None, two)]
    assert sorted(map(tuple, keep_one(docs).collect()), key=repr) == sorted(want, key=repr)


def test_url_rules_of_one_length(spark):
    pages = spark.createDataFrame([(1, "http://x.ab/cd"), (2, None)], "page_id long, url string")
    for rules in ([("ab", "/cd", "allow"), ("x.ab", "/", "block")], [("ab", "/cd", "block"), ("x.ab", "/", "allow")]):
        assert [r.verdict for r in urlcascade.judge(pages, rules).orderBy("page_id").collect()] == ["block", "allow"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_media(spark, odd, none):
    rows = media.through_images(odd, keep=True).collect()
    want = sorted((len((r.text or "").encode()), hashlib.sha256(media.payload((r.text or "").encode())).hexdigest()) for r in odd.collect())
    assert sorted((r.n_bytes, r.payload_sha256) for r in rows) == want
    assert all(r.media_bytes == len(r.media) and r.payload_bytes % 576 == 0 and r.media_sha256 == hashlib.sha256(r.media).hexdigest() for r in rows)
    assert len({r.feature for r in rows if r.doc_id == 1}) == 1
    assert media.through_images(none).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, None, 0), (1, 1, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(odd, labels).count() == 9
    assert {r.score for r in toxicity.judge(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.judge(none, labels).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.judge(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    clean = rows[rows.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.99 and rows[(rows.toxic == 1) & ~rows.held_out].predicted.mean() > 0.9
    assert rows[(rows.toxic == 1) & rows.held_out].score.mean() > 3 * clean[clean.held_out].score.mean()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    lang = stages["language ID"](spark, docs, DATA)
    assert lang.columns == docs.columns and lang.count() >= 0.97 * docs.count()
    tox = stages["toxicity"](spark, lang, DATA)
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in lang.collect()} - {r.doc_id for r in tox.collect()}
    assert gone and gone <= toxic | {r.doc_id for r in docs.collect()} and tox.columns == docs.columns
    lines = stages["line dedup"](spark, tox, DATA)
    texts = [r.text for r in tox.collect()]
    common = {}
    for t in texts:
        for k in {linededup.key_of(x) for x in t.encode().split(b"\n")}:
            common[k] = common.get(k, 0) + 1
    want = sorted("\n".join(x for x in t.split("\n") if not linededup.key_of(x.encode()) or common[linededup.key_of(x.encode())] < 10) for t in texts)
    kept = lines.collect()
    assert sorted(r.text for r in kept) == want and all(r.n_chars == len(r.text) for r in kept)
    one = stages["SimHash near-dedup"](spark, lines, DATA).collect()
    check_near_classes({r.doc_id: r.text for r in kept}, {r.doc_id for r in one})
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(packed.doc_id.unique()) == sorted(r.doc_id for r in one)


def test_registry_names():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 11)] or sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = registry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in df.select(names).collect()) == sorted(repr(tuple(r)) for r in want.fetchall())


def test_simhash_wide_links_no_pair_below(spark):
    """A chain of texts, each at 0.75 to the next, stays whole; of neighbours at 0.8 one stays."""

    def chain(name, count, drop):
        # 104 words, 100 shingles, of which the next text has all but `drop`
        return [" ".join(f"{name}{i}" for i in range(k * drop, k * drop + 104)) for k in range(count)]

    texts = [*(t for c in range(12) for t in chain(f"a{c}w", 10, 15)), *chain("bw", 5, 11)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = word_sets(dict(enumerate(texts)))
    assert 0.73 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8 <= len(sets[120] & sets[121]) / len(sets[120] | sets[121])
    assert {r.doc_id for r in simhash_wide.keep_one(docs).collect()} == set(range(121))


def test_simhash_wide_of_a_family_in_chunks(spark, monkeypatch):
    """A family of which most link to the representatives, some only to each other, and some to nothing, over many chunks."""
    monkeypatch.setattr(simhash_wide, "REPRESENTATIVES", 4)
    rng, words = np.random.default_rng(11), [f"w{i}" for i in range(200)]

    def changed(base, n):
        copy = list(base)
        for k in rng.choice(np.arange(60, 200), n, replace=False):
            copy[k] = f"x{rng.integers(0, 10**9)}"
        return copy

    other = changed(words, 12)
    lines = [changed(words, int(rng.integers(0, 4))) for _ in range(60)] + [changed(other, int(rng.integers(0, 3))) for _ in range(15)] + [changed(words, 14) for _ in range(15)]
    docs = spark.createDataFrame([(int(d), " ".join(w)) for d, w in zip(rng.permutation(len(lines)), lines)], "doc_id long, text string")
    sets = word_sets({r.doc_id: r.text for r in docs.collect()})
    exact = simhash.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                exact.join(i, j)
    want = {d for d in sets if exact.root(d) == d}
    assert 5 < len(want) < 40
    for largest in (simhash_wide.LARGEST, 20, 7):
        assert {r.doc_id for r in simhash_wide.keep_one(docs, largest=largest).collect()} == want


def test_simhash_wide_links_short_texts(spark):
    """Texts of few shingles with a similarity of 0.8 or more, of which one has a word or more at its end than the other."""
    texts = []
    for k, (few, many) in enumerate([(8, 9), (9, 10), (10, 11), (16, 19), (17, 18), (24, 29), (68, 84)] * 30):
        texts += [" ".join(f"t{k}w{i}" for i in range(n)) for n in (few, many)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = word_sets(dict(enumerate(texts)))
    assert all(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8 for i in range(0, len(texts), 2))
    assert {r.doc_id for r in simhash_wide.keep_one(docs).collect()} == set(range(0, len(texts), 2))


def test_simhash_wide_finds_the_pairs_of_a_whole_table(spark):
    """Groups of the 10,000 documents of scale 0.1 against those of an exact similarity join of their shingle sets."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    by_class = {}
    for r in docs.select("doc_id", "text").collect():
        by_class.setdefault(simhash_wide.class_of(simhash_wide.words_of((r.text or "").encode())), (r.text or "", []))[1].append(r.doc_id)
    sets = [simhash_wide.shingles(simhash_wide.words_of(t.encode())) if t.split() else np.zeros(0, np.uint64) for t, _ in by_class.values()]
    names, often = np.unique(np.concatenate(sets), return_counts=True)
    index, pairs_found = {}, []
    whole = [set(s.tolist()) for s in sets]
    for i in np.argsort([len(s) for s in sets], kind="stable").tolist():
        # rarest first: of a pair of 0.8 both prefixes hold one shingle in common
        order = sets[i][np.argsort(often[np.searchsorted(names, sets[i])], kind="stable")]
        n = len(order)
        near = set()
        for x in order[: n - -(-4 * n // 5) + 1].tolist():
            near.update(index.setdefault(x, []))
            index[x].append(i)
        pairs_found += [(i, j) for j in near if 5 * len(whole[j]) >= 4 * n and 9 * len(whole[i] & whole[j]) >= 4 * (n + len(whole[j]))]
    exact = simhash.Forest(len(sets))
    for i, j in pairs_found:
        exact.join(i, j)
    got = {r.doc_id: r.component_id for r in simhash_wide.near_classes(docs).collect()}
    ids = [d for _, d in by_class.values()]
    assert all(len({got[x] for x in d}) == 1 for d in ids)
    found = [got[d[0]] for d in ids]
    recall = np.mean([found[i] == found[j] for i, j in pairs_found])
    assert len(pairs_found) > 40 and recall >= 0.99, (len(pairs_found), recall)
    # and nothing is joined that no chain of such pairs joins
    of = {}
    assert all(of.setdefault(c, exact.root(i)) == exact.root(i) for i, c in enumerate(found))


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null, empty, letterless and very long texts, missing and repeated ids, repeated rows, names that the stages use."""
    extra = ["lang_pred", "score", "toxic_score", "n_lines", "n_dropped", "row", "gone", "text_key", "gone_id", "gone_key", "fp", "cls", "piece", "start", "length"]
    prose = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en' and n_chars > 400").orderBy("doc_id").limit(30).collect()]
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(100, None, "en"), (101, "", None), (102, "123 !!", "en"), (None, prose[0] + " of its own", "en"), (103, prose[1], "en"), (103, prose[1], "en"), (1, prose[1], "en"), (104, " ".join(prose) * 8, "en")]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in extra))
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None), (9999, 1)], "doc_id long, toxic int")
    for name, part in (("some", docs), ("none", docs.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    left = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path / "some"))
        assert left.columns == docs.columns, name
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    got = {d for d, _ in kept}
    assert not got & {100, 101, 102, 103} and None in got and {1, 104} <= got and [d for d, _ in kept].count(1) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path / "some")).toPandas()
    assert set(packed.doc_id.dropna().astype(int)) == got - {None} and packed.doc_id.isna().sum() >= 1
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns == packed.columns.tolist()
