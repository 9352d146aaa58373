import math
import random
import struct
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from bytequarry.llm import bpe, langid, linededup, media, packing, planes, simhash, simhash_wide, tokens, toxicity, urlcascade, webp

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [
    "", " ", "  a  b\n\n c", "it's don't we'LL", "naïve café Straße 123 ½ ²", "日本語 テキスト", "a b c\x1cd\x85e", "<|endoftext|> x<|endoftext|><|startoftext|>", "é İI ſ",
    "the " * 300, "x" * 3000, "\t\t\n  \r\n mixed", "emoji 👍🏽 ok", "‘quoted’ – dash… €5", "A_B_C 1_000", "\x00\x01\x02",
]


@pytest.mark.parametrize("name,words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_equal_the_library(name, words):
    one = tokens.encoder(public_tokenizers.path(name), words)
    for t in TEXTS:
        assert one.ids(t) == one.whole(t), repr(t)


@given(st.text(alphabet="abAB '\n\t.,!sté12½  ", max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_the_library_on_any_text(text):
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        one = tokens.encoder(public_tokenizers.path(name), words)
        assert one.ids(text) == one.whole(text)


def test_segment_tree_bpe_equals_the_library():
    model, library = bpe.bpe(public_tokenizers.path("byte_bpe_50k.json")), tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    rng = random.Random(2)
    for t in [*TEXTS, *("".join(rng.choice("abcdeé 1'\n") for _ in range(rng.randrange(200))) for _ in range(100))]:
        assert model.encode(t) == library.whole(t), repr(t)
        assert model.decode(model.encode(t)) == t


def test_merge_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        pairs, n = {}, 4
        for rank in range(12):
            pairs.setdefault((rng.randrange(n), rng.randrange(n)), (rank, n))
            n += 1
        ids = [rng.randrange(4) for _ in range(rng.randrange(30))]
        want = list(ids)
        while found := min(((pairs[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in pairs), default=None):
            i = found[1]
            want[i : i + 2] = [pairs[want[i], want[i + 1]][1]]
        assert bpe.merge(ids, pairs) == want


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([1, 8]))
@settings(max_examples=40, deadline=None)
def test_planes_round_trip(ids, bits):
    a = np.array(ids, "<u4")
    assert (planes.from_planes(planes.to_planes(a, bits), len(a), bits) == a).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_shard_file(bits, tmp_path):
    docs = [(3, [1, 2, 3]), (4, []), (None, list(range(100))), (9, [7])]
    with open(tmp_path / "x", "wb") as out:
        writer = planes.ShardWriter(out, bits, chunk_ids=16)
        for d, ids in docs:
            writer.add(d, np.array(ids, "<u4"))
        writer.close()
    with open(tmp_path / "x", "rb") as source:
        reader = planes.ShardReader(source)
        assert [(d, i.tolist()) for d, i in reader.documents()] == docs
        assert reader.chunk(2).tolist() == [*range(29, 45)] and len(reader.index) == 7


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_optimal_where_it_can_be_seen(seed):
    """Bin completion itself, never the incumbent, finds the least count of sequences, and proves that fewer don't do."""
    rng = random.Random(seed)
    counts = {}
    for _ in range(14):
        s = rng.randrange(1, (60, 35)[seed % 2])
        counts[s] = counts.get(s, 0) + 1
    found, packed_by = packing.solve(counts, 60)
    assert packed_by == "completion"
    used = {}
    for sizes, n in found:
        assert sum(s * k for s, k in sizes) <= 60
        for s, k in sizes:
            used[s] = used.get(s, 0) + n * k
    assert used == counts

    def least(items, rooms, limit):
        if not items:
            return len(rooms)
        best = limit
        for i in range(len(rooms)):
            if rooms[i] >= items[0] and rooms[i] not in rooms[:i]:
                best = min(best, least(items[1:], rooms[:i] + [rooms[i] - items[0]] + rooms[i + 1 :], best))
        if len(rooms) + 1 < best:
            best = min(best, least(items[1:], [*rooms, 60 - items[0]], best))
        return best

    items = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    need = least(items, [], 99)
    assert sum(n for _, n in found) == need >= packing.least(counts, 60)
    assert packing.complete(counts, 60, need - 1, 100_000) is None and packing.solve({}, 60) == ([], "completion")


def test_packing_of_many_is_near_the_bound():
    for seed, (mean, spread) in enumerate([(6, 1), (5, 0.4), (6.6, 0.8), (7, 0.3)]):
        rng = random.Random(seed)
        counts = {}
        for _ in range(20_000):
            s = min(2048, int(rng.lognormvariate(mean, spread)) + 1)
            counts[s] = counts.get(s, 0) + 1
        found, packed_by = packing.solve(counts)
        n = sum(k for _, k in found)
        assert packed_by == "completion" and packing.least(counts, 2048) <= n <= sum(k for _, k in packing.best_fit(counts, 2048))
        assert n <= packing.least(counts, 2048) * 1.002 + 1


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=6), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_fillings_are_what_is_undominated(counts, spare):
    first = max(counts)
    stock, room = packing.Stock(counts), 40 - first
    rest = sorted((s for s, n in counts.items() for _ in range(n - (s == first))), reverse=True)
    ways = {()}
    for s in rest:
        ways |= {tuple(sorted((*w, s), reverse=True)) for w in ways if sum(w) + s <= room}

    def better(way):
        """Whether some pieces of the way can be swapped for one that is not in it, is no shorter and fits."""
        left = list(rest)
        for s in way:
            left.remove(s)
        slack = room - sum(way)
        parts = {(0, 0)}
        for s in way:
            parts |= {(t + s, min(2, k + 1)) for t, k in parts}
        return any(t + (k < 2) <= x <= t + slack for t, k in parts for x in left)

    want = sorted(((room - sum(w), w) for w in ways if room - sum(w) <= spare and not better(w)), key=lambda x: (x[0], [-s for s in x[1]]))
    got = [(waste, tuple(s for s, n in f for _ in range(n))) for waste, f in filter(None, packing.fillings(stock, first, room, spare))]
    assert got == want


def brute_links(fps, radius):
    forest = simhash.Forest(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius:
                forest.join(i, j)
    return [forest.root(i) for i in range(len(fps))]


def test_bit_sliced_links_by_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False))) for b in base for _ in range(40)], np.uint64)
    for groups in (np.zeros(len(fps), int), np.arange(len(fps)) // 40, np.arange(len(fps)) // 7):
        forest = simhash.Forest(len(fps))
        for a, b in simhash.links(fps, groups, 4):
            assert bin(int(fps[a] ^ fps[b])).count("1") <= 4 and groups[a] == groups[b]
            forest.join(a, b)
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            want = brute_links(fps[at], 4)
            assert [forest.root(i) == forest.root(j) for i in at for j in at] == [a == b for a in want for b in want]


def test_wide_links_equal_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(6):
        base = rng.integers(0, 256, (8, simhash_wide.BITS // 8)).astype(np.uint8)
        bits = np.unpackbits(base, axis=1)[rng.integers(0, 8, 260)]
        bits ^= (rng.random(bits.shape) < rng.uniform(0, 0.16, (260, 1))).astype(np.uint8)
        group = np.sort(rng.integers(0, [1, 3, 90][trial % 3], 260))
        fps = np.packbits(bits, axis=1).view(np.uint64)
        want, got = simhash.Forest(260), simhash.Forest(260)
        near = {(i, j) for i in range(260) for j in range(i) if group[i] == group[j] and (bits[i] != bits[j]).sum() <= 180}
        for i, j in near:
            want.join(i, j)
        found = simhash_wide.links(fps, group, 180)
        assert all((max(p), min(p)) in near and got.join(*p) for p in found)
        assert [got.root(i) for i in range(260)] == [want.root(i) for i in range(260)]


def test_wide_fingerprint():
    found = np.random.default_rng(4).integers(0, 1 << 63, 5000).astype(np.uint64)
    drawn = simhash_wide.mixed(found[:, None] * simhash_wide._PLANES)
    want = [2 * int((drawn[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)).sum()) > 5000 for b in range(simhash_wide.BITS)]
    assert np.unpackbits(np.frombuffer(simhash_wide.fingerprint(found), np.uint8), bitorder="little").astype(bool).tolist() == want
    parts = b"a b c d e f g a b c d e".split()
    assert len(simhash_wide.shingles(parts)) == 7 and len(simhash_wide.shingles(parts[:2])) == 1


def test_simhash_vectors():
    import xxhash

    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \t\n\x0b") == 0
    assert simhash.fingerprint(b"One TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    words = [regex.sub("[A-Z]", lambda m: m[0].lower(), w) for w in regex.findall(r"[^\x20\x09-\x0D]+", "A b c D e F É g a b d d")]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    assert simhash.fingerprint("A b c D e F É g a b d d".encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_line_keys():
    assert linededup.key_of(b" \tAbC\xc3\x89 \r") == b"abc\xc3\x89" and linededup.key_of(b"\x0b\x0c ") == b""


def test_language_model():
    masks = np.zeros((1, 8), np.uint64)
    assert langid.Model([], masks).predict(["text"])[0] == ["und"]
    model = langid.Model(["en"], ~masks)
    assert model.predict(["", "12 !", "a"])[0] == ["und", "und", "en"]


def test_toxicity_learning():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, texts, labels = [], [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(" ".join([*(rng.choice(words) for _ in range(40)), *(["nasty"] if bad else [])]))
        labels.append(int(bad))
    f, owner = toxicity.features(texts)
    rows = [(np.unique(f[owner == i]), y) for i, y in enumerate(labels)]
    model = toxicity.learn(rows)
    scores = model.score([*texts, "", "nasty"])
    assert ((scores[:-2] >= 0.5) == np.array(labels, bool)).all() and scores[-1] > 0.5 > scores[-2]
    assert len(model.keys) < 60
    assert toxicity.learn([]).score(["x"]).tolist() == [0.0]


def test_ftrl_by_brute_force():
    """The same updates, one weight at a time in plain numbers, give the same weights."""
    rng = random.Random(4)
    rows = [(np.array(sorted(rng.sample(range(1, 40), 6)), np.uint32), int(rng.random() < 0.4)) for _ in range(60)]
    alpha, beta, l1, l2, weight = 0.7, 1.0, 0.6, 0.2, 2.0
    model = toxicity.learn(rows, alpha, beta, l1, l2, epochs=3, least_docs=2, weight=weight)
    z, n = {}, {}

    def value(k):
        shrink = 0.0 if k == "bias" else l1
        if abs(z.get(k, 0.0)) <= shrink:
            return 0.0
        return -(z[k] - math.copysign(shrink, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(3):
        for f, y in rows:
            keys = [*f.tolist(), "bias"]
            w = {k: value(k) for k in keys}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (weight if y else 1.0)
            for k in keys:
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha * w[k]
                n[k] = n.get(k, 0.0) + g * g
    want = {k: value(k) for k in z if k != "bias" and value(k)}
    assert model.keys.tolist() == sorted(want) and 0 < len(want) < 39
    assert np.allclose(model.weights, [want[k] for k in sorted(want)], atol=1e-9) and abs(model.bias - value("bias")) < 1e-9


def test_a_model_that_would_be_too_large_gets_sparser(monkeypatch):
    rng = random.Random(4)
    rows = [(np.array(sorted(rng.sample(range(1, 400), 60)), np.uint32), i % 2) for i in range(80)]
    assert len(toxicity.learn(rows, l1=0.01).keys) > 50
    monkeypatch.setattr(toxicity, "MAX_WEIGHTS", 50)
    assert 0 < len(toxicity.learn(rows, l1=0.01).keys) <= 50


def test_features_by_hand():
    import xxhash

    def words(text):
        return [xxhash.xxh3_64_intdigest(w) for w in text.split()]

    f, owner = toxicity.features(["Idiotic, cat", "", "cat"])
    want = {w >> 32 for w in words("idiotic cat")} | {xxhash.xxh3_64_intdigest("stem idiot") >> 32}
    mine = set(f[owner == 0].tolist())
    assert want < mine and len(mine) == 4 and f[owner == 2].tolist() == [words("cat")[0] >> 32] and not (owner == 1).any()
    # five words: each, a stem, 4 pairs, 3 triples, 3 pairs with one word between
    assert len(set(toxicity.features(["aa bb cc dd eeeeee"])[0].tolist())) == 5 + 1 + 4 + 3 + 3


def test_cascade_levels():
    h = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    empty = urlcascade.Cascade()
    assert not empty.listed(h, h).any()


# --- lossless WebP: streams written by hand, with a writer that shares nothing with the encoder ---


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def file(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        data = bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))
        data += bytes(len(data) % 2)
        return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data

    def flat_code(self, alphabet, used=None):
        """All of the first 2^k symbols (or the given ones) with codes of equal length, each length written out."""
        used = list(range(256)) if used is None else used
        k = len(used).bit_length() - 1
        self.put(0, 1)
        self.put(15, 4)  # all 19 lengths of the code-length code
        for s in (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15):
            self.put(1 if s in (0, k) else 0, 3)
        self.put(0, 1)
        for s in range(alphabet):
            self.put(int((s in used) == (k > 0)), 1)
        return {s: (int(f"{i:0{k}b}"[::-1], 2), k) for i, s in enumerate(sorted(used))}

    def one(self, symbol):
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)

    def pixels(self, argb, cache=0, main=False):
        """Literals only; every channel with 8-bit codes."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        codes = [self.flat_code(280 if i == 0 else 256) for i in range(4)]
        self.one(0)
        for p in argb:
            for code, shift in zip(codes, (8, 16, 0, 24)):
                self.put(*code[p >> shift & 255])


def started(width, height):
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def argb_of(image):
    r, g, b, a = (image[..., i].astype(int) for i in range(4))
    return (a << 24 | r << 16 | g << 8 | b).reshape(-1).tolist()


RNG = np.random.default_rng(7)
SAMPLE = RNG.integers(0, 256, (9, 7, 4), dtype=np.uint8)


def test_webp_literals():
    w = started(7, 9)
    w.put(0, 1)
    w.pixels(argb_of(SAMPLE), main=True)
    assert (webp.decode(w.file()) == SAMPLE).all()
    assert (webp.decode_many([w.file()])[0] == SAMPLE[..., 1]).all()


def test_webp_subtract_green_and_cross_colour():
    w = started(7, 9)
    factors = [0xFF000000 | int(x) for x in RNG.integers(0, 1 << 24, 6)]
    w.put(1, 1)
    w.put(1, 2)
    w.put(0, 3)
    w.pixels(factors)
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    s8 = lambda x: (x & 255) - 256 if x & 128 else x & 255
    out = []
    for i, p in enumerate(argb_of(SAMPLE)):
        y, x = divmod(i, 7)
        f = factors[(y // 4) * 2 + x // 4]
        a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
        b = b - (s8(f >> 8) * s8(g) >> 5) - (s8(f >> 16) * s8(r) >> 5)
        r = r - (s8(f) * s8(g) >> 5)
        out.append(a << 24 | ((r - g) & 255) << 16 | g << 8 | ((b - g) & 255))
    w.pixels(out, main=True)
    assert (webp.decode(w.file()) == SAMPLE).all()


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictor(mode):
    w = started(7, 9)
    w.put(1, 1)
    w.put(0, 2)
    w.put(0, 3)
    w.pixels([0xFF000000 | mode << 8] * 6)
    w.put(0, 1)
    px = SAMPLE.astype(int)
    half = lambda a, b: (a + b) // 2
    res = px.copy()
    for y in range(9):
        for x in range(7):
            if y == 0:
                g = px[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                g = px[y - 1, 0]
            else:
                L, T, TL = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
                TR = px[y - 1, x + 1] if x < 6 else px[y, 0]
                pick = L if np.abs(T - TL).sum() < np.abs(L - TL).sum() else T
                m = half(L, T)
                g = [np.array([0, 0, 0, 255]), L, T, TR, TL, half(half(L, TR), T), half(L, TL), half(L, T), half(TL, T), half(T, TR), half(half(L, TL), half(T, TR)), pick, np.clip(L + T - TL, 0, 255), np.clip(m + np.trunc((m - TL) / 2).astype(int), 0, 255)][mode]
            res[y, x] = (px[y, x] - g) & 255
    w.pixels(argb_of(res), main=True)
    assert (webp.decode(w.file()) == SAMPLE).all()


@pytest.mark.parametrize("colours,bundle", [(2, 3), (4, 2), (13, 1), (40, 0)])
def test_webp_palette(colours, bundle):
    palette = [int(x) for x in RNG.integers(0, 1 << 32, colours)]
    index = RNG.integers(0, colours, (9, 7))
    w = started(7, 9)
    w.put(1, 1)
    w.put(3, 2)
    w.put(colours - 1, 8)
    before, deltas = 0, []
    for c in palette:
        deltas.append(sum((((c >> s) - (before >> s)) & 255) << s for s in (0, 8, 16, 24)))
        before = c
    w.pixels(deltas)
    w.put(0, 1)
    per, size = 1 << bundle, 8 >> bundle
    packed = [sum(int(v) << (size * k) for k, v in enumerate(row[x : x + per])) << 8 for row in index for x in range(0, 7, per)]
    w.pixels(packed, main=True)
    got = argb_of(webp.decode(w.file()))
    assert got == [palette[i] for i in index.reshape(-1)]


def test_webp_cache_references_and_groups():
    # 8 x 8: two groups by an entropy image of 4 x 4 blocks, a colour cache of 2 bits, one back-reference
    w = started(8, 8)
    w.put(0, 1)
    w.put(1, 1)
    w.put(2, 4)
    w.put(1, 1)
    w.put(0, 3)
    groups = [0, 1, 1, 0]
    w.pixels([g << 8 for g in groups])
    greens = []
    for base in (10, 20):
        greens.append(w.flat_code(284, [base, base + 1, 256 + 3, 280 + 2]))
        for c in (0x33, 0x44, 0xFF):
            w.one(c)
        w.one(1)  # distance code 2: the left neighbour
    want, cache, at = [], {}, 0
    rng = random.Random(3)

    def note(p):
        cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> 30] = p

    while at < 64:
        g = groups[(at // 8 // 4) * 2 + at % 8 // 4]
        code = greens[g]
        if at > 10 and at < 50 and rng.random() < 0.2:
            w.put(*code[259])
            want += [want[-1]] * 4
            at += 4
        elif 2 in cache and rng.random() < 0.4:
            w.put(*code[282])
            want.append(cache[2])
            at += 1
        else:
            s = 10 * (g + 1) + rng.randrange(2)
            w.put(*code[s])
            want.append(0xFF330000 | s << 8 | 0x44)
            at += 1
        note(want[-1])
    assert argb_of(webp.decode(w.file())) == want


STORED = {
    "plain": (None, bytes(RNG.integers(97, 123, 24 * 30, dtype=np.uint8))),
    "above": (webp.PREDICTOR, b"abc def ghi jkl mno pqr " * 40),
    "left": (webp.PREDICTOR, bytes((i * 3 + (i // 24) * 7) & 255 for i in range(24 * 40))),
    "two": (webp.PALETTE, b"".join([b"\x07\xc8\x07\x07\xc8\xc8\x07\xc8", b"\xc8" * 8, b"\xc8\x07" * 4][k] for k in RNG.integers(0, 3, 3 * 41))),
    "four": (webp.PALETTE, b"".join([b"\x00\x07\x09\xff", b"\x09\x09\x07\x07", b"\xff\x00\x07\x00"][k] for k in RNG.integers(0, 3, 6 * 41))),
    "sixteen": (webp.PALETTE, bytes(np.repeat(RNG.integers(0, 16, 24 * 60, dtype=np.uint8) * 17, 2))),
    "one": (None, b"\xff" * 576),
}


@pytest.mark.parametrize("name", STORED)
def test_webp_encoder_takes_the_shortest_way(name):
    """Files that need a predictor or a palette come back the same through lanes, through the whole decoder, and in a VP8X file."""
    kind, data = STORED[name]
    file = webp.encode_samples([data], 24)[0]
    assert [t.kind for t in webp._start(file)[3]] == ([] if kind is None else [kind])
    want = np.frombuffer(data, np.uint8).reshape(-1, 24)
    assert (webp.decode_many([file, file])[1] == want).all()
    pixels = webp.decode(file)
    assert (pixels[..., 1] == want).all() and (pixels[..., [0, 2]] == 0).all() and (pixels[..., 3] == 255).all()
    extra = b"VP8X" + struct.pack("<I", 10) + bytes(10) + b"EXIF" + struct.pack("<I", 3) + b"abc\0" + file[12:] + b"XMP " + struct.pack("<I", 0)
    assert (webp.decode(b"RIFF" + struct.pack("<I", len(extra) + 4) + b"WEBP" + extra) == pixels).all()


def test_webp_near_distances():
    assert webp.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert len(webp.NEAR) == 120 and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]
    assert webp.distance_of(1, 10) == 10 and webp.distance_of(4, 10) == 9 and webp.distance_of(121, 10) == 1
    for v in [1, 2, 4, 5, 6, 7, 8, 9, 100, 4096]:
        p, n, extra = webp.prefix_of(v)
        bits = webp.Bits(struct.pack("<I", extra) + bytes(8))
        assert webp.prefixed(p, bits) == v and bits.at == n


def test_webp_errors():
    good = media.store(b"ab" * 288)[0]
    for bad in (b"", b"x" * 40, good[:30], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


@given(st.lists(st.binary(max_size=900) | st.integers(9000, 30000).map(lambda n: bytes(range(97, 123)) * (n // 26)), min_size=1, max_size=6))
@settings(max_examples=30, deadline=None)
def test_media_round_trip(raw):
    data = [media.payload(t) for t in raw]
    stored = [media.store(d) for d in data]
    flat = [f for s in stored for f in s]
    assert [media.files(b"".join(s)) for s in stored] == stored
    lanes = webp.decode_many(flat)
    assert b"".join(x.tobytes() for x in lanes) == b"".join(data)
    assert all((webp.decode(f)[..., 1] == x).all() for f, x in zip(flat[:2], lanes))
    assert all(len(d) % 576 == 0 and d for d in data)
    assert zlib.crc32(lanes[-1].tobytes()[-32:]) == zlib.crc32(data[-1][-32:])


def test_links_of_a_large_family_by_brute_force():
    """One group of several hundred, most of them one family, others apart or linked only among themselves."""
    rng = np.random.default_rng(9)
    flips = lambda base, most: base ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, most + 1), replace=False)))
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.array([flips(base[0], 3) for _ in range(500)] + [flips(b, 4) for b in base[1:] for _ in range(4)], np.uint64))
    rng.shuffle(fps)
    forest = simhash.Forest(len(fps))
    for a, b in simhash.links(fps, np.zeros(len(fps), int), 4):
        assert bin(int(fps[a] ^ fps[b])).count("1") <= 4 and forest.join(a, b)
    assert [forest.root(i) for i in range(len(fps))] == brute_links(fps, 4)
