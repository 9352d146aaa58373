"""Lossless WebP (VP8L) in a RIFF file: a decoder of the whole format and an encoder of 8-bit samples.

The decoder reads prefix codes, back-references and the colour cache, groups of codes by an entropy
image, and inverts the predictor, cross-colour, subtract-green and palette transforms. `decode` gives
an image's pixels; `decode_many` gives their green samples and decodes images of one group of codes in lanes, one
symbol of each image at a time, inverts palettes and predictors of one mode by table and running sums,
and leaves any other image to `decode`.

The encoder keeps rows of 8-bit samples in the green channel, as they are, as a predictor's differences from the
sample above or to the left, or as a palette of up to 16 values with several samples in a pixel, whichever takes
the fewest bits by the entropy of its symbols. It writes prefix codes of each image's own, and a run
of equal symbols at the end as a back-reference. Red and blue are constant and a pixel costs no less
as a cache index than as a literal, so cross-colour and the colour cache can never pay here and are not written.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass

import numpy as np

SIGNATURE = 0x2F
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Fixed value of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The 120 near distances by nearness, then by columns away, to the left (positive) first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
#: Longest code that the encoder makes and that lanes look up at once.
LANE_BITS = 12
CACHE_MULTIPLIER = 0x1E35A7BD


class Bits:
    """Little-endian bits of a byte string."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        at = self.at
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image's data end early")
        return value


def canonical(lengths) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of each symbol with a length."""
    out, code, last = [], 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        last = length
        out.append((symbol, length, int(f"{code:0{length}b}"[::-1], 2)))
        code += 1
    if out and len(out) > 1 and code != 1 << last:
        raise ValueError("an incomplete or oversubscribed prefix code")
    return out


class Code:
    """A prefix code: a table by the next bits, of (symbol, bits to skip)."""

    def __init__(self, lengths) -> None:
        self.codes = canonical(lengths)
        if not self.codes:
            raise ValueError("a prefix code without symbols")
        self.only = self.codes[0][0] if len(self.codes) == 1 else None
        self.bits = 0 if self.only is not None else max(n for _, n, _ in self.codes)
        self.table: list[tuple[int, int]] | None = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = [(0, 0)] * (1 << self.bits)
            for symbol, n, code in self.codes:
                for i in range(code, 1 << self.bits, 1 << n):
                    self.table[i] = (symbol, n)
        symbol, n = self.table[bits.peek(self.bits)]
        bits.read(n)
        return symbol

    def fill(self, lut: np.ndarray) -> None:
        """Entries symbol << 4 | bits in a lane's table of LANE_BITS."""
        if self.only is not None:
            lut[:] = self.only << 4
        for symbol, n, code in self.codes if self.only is None else ():
            lut[code :: 1 << n] = symbol << 4 | n


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        for n in [8 if bits.read(1) else 1, *([8] if two else [])]:
            symbol = bits.read(n)
            if symbol >= alphabet:
                raise ValueError("a symbol outside the alphabet")
            lengths[symbol] = 1
        return Code(lengths)
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    code, at, before = Code(own), 0, 8
    while at < alphabet and tokens:
        tokens -= 1
        token = code.read(bits)
        if token < 16:
            lengths[at] = token
            before = token or before
            at += 1
            continue
        value, extra, least = ((before, 2, 3), (0, 3, 3), (0, 7, 11))[token - 16]
        n = least + bits.read(extra)
        if at + n > alphabet:
            raise ValueError("code lengths beyond the alphabet")
        lengths[at : at + n] = [value] * n
        at += n
    return Code(lengths)


def prefixed(prefix: int, bits: Bits) -> int:
    """The length or distance of a prefix symbol and its extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, count of extra bits, extra bits) of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    return 2 * high + second, high - 1, value & ((1 << (high - 1)) - 1)


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


@dataclass
class Head:
    """What precedes an image's symbols."""

    width: int
    height: int
    cache_bits: int
    group_bits: int
    group_of: np.ndarray | None
    groups: list[list[Code]]


def read_head(bits: Bits, width: int, height: int, main: bool) -> Head:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    group_bits, group_of, count = 0, None, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        image = read_pixels(bits, -(-width >> group_bits), -(-height >> group_bits), False)
        group_of = (image >> 8 & 0xFFFF).astype(np.int64)
        count = int(group_of.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    return Head(width, height, cache_bits, group_bits, group_of, [[read_code(bits, n) for n in sizes] for _ in range(count)])


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The ARGB values (uint32) of an entropy-coded image, in rows."""
    head = read_head(bits, width, height, main)
    total, at = width * height, 0
    out = [0] * total
    cache, shift, kept = [0] * (1 << head.cache_bits), 32 - head.cache_bits, 0
    group = head.groups[0]
    while at < total:
        if head.group_of is not None:
            y, x = divmod(at, width)
            group = head.groups[head.group_of[(y >> head.group_bits) * -(-width >> head.group_bits) + (x >> head.group_bits)]]
        symbol = group[GREEN].read(bits)
        if symbol < LITERALS:
            red, blue, alpha = group[RED].read(bits), group[BLUE].read(bits), group[ALPHA].read(bits)
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
            continue
        if head.cache_bits:
            for value in out[kept:at]:
                cache[(value * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = value
            kept = at
        if symbol < LITERALS + LENGTHS:
            n = prefixed(symbol - LITERALS, bits)
            back = distance_of(prefixed(group[DISTANCE].read(bits), bits), width)
            if back > at or at + n > total:
                raise ValueError("a back-reference outside the image")
            for i in range(at, at + n):
                out[i] = out[i - back]
            at += n
        else:
            out[at] = cache[symbol - LITERALS - LENGTHS]
            at += 1
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """The bytes B, G, R, A of each value, as int64."""
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4).astype(np.int64)


def _values(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((channels & 255).astype(np.uint8)).view("<u4").reshape(channels.shape[:-1]).astype(np.uint32)


def _select(left, top, corner):
    toward_left, toward_top = sum(abs(t - c) for t, c in zip(top, corner, strict=True)), sum(abs(x - c) for x, c in zip(left, corner, strict=True))
    return left if toward_left < toward_top else top


def _clamp(x: int) -> int:
    return min(255, max(0, x))


def predict(mode: int, left, top, corner, right):
    """A pixel's prediction from its neighbours (left, top, top left, top right), each four channels."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode <= 9:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return [_clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    # the half of the difference is rounded toward zero
    half = mean(left, top)
    return [_clamp(m + int((m - c) / 2)) for m, c in zip(half, corner, strict=True)]


def invert_predictor(argb: np.ndarray, width: int, height: int, size_bits: int, modes: np.ndarray) -> np.ndarray:
    pixels = _channels(argb).reshape(height, width, 4).tolist()
    across = -(-width >> size_bits)
    for y in range(height):
        row, above = pixels[y], pixels[y - 1] if y else None
        for x in range(width):
            if above is None:
                guess = row[x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = above[0]
            else:
                mode = int(modes[(y >> size_bits) * across + (x >> size_bits)]) >> 8 & 15
                guess = predict(mode, row[x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < width else row[0])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], guess, strict=True)]
    return _values(np.array(pixels, np.int64)).reshape(-1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def invert_cross_colour(argb: np.ndarray, width: int, height: int, size_bits: int, factors: np.ndarray) -> np.ndarray:
    c = _channels(argb).reshape(height, width, 4)
    f = _channels(factors).reshape(-(-height >> size_bits), -(-width >> size_bits), 4)
    f = np.repeat(np.repeat(f, 1 << size_bits, axis=0), 1 << size_bits, axis=1)[:height, :width]
    part = lambda factor, colour: _signed(factor) * _signed(colour) >> 5
    green = c[..., 1]
    red = (c[..., 2] + part(f[..., 0], green)) & 255
    blue = (c[..., 0] + part(f[..., 1], green) + part(f[..., 2], red)) & 255
    return _values(np.stack([blue, green, red, c[..., 3]], axis=-1)).reshape(-1)


def invert_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb)
    c[:, 0] += c[:, 1]
    c[:, 2] += c[:, 1]
    return _values(c)


def invert_palette(argb: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    bundle = bundle_of(len(palette))
    green = (argb >> 8 & 255).reshape(height, -1)
    x = np.arange(width)
    index = green[:, x >> bundle] >> ((x & ((1 << bundle) - 1)) * (8 >> bundle)) & ((1 << (8 >> bundle)) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index].reshape(-1)


def payload(file: bytes) -> bytes:
    """The VP8L chunk of a RIFF file, also of one that has other chunks beside it (VP8X, metadata)."""
    if len(file) < 20 or file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(file):
        kind, n = struct.unpack_from("<4sI", file, at)
        if at + 8 + n > len(file):
            raise ValueError("the file ends early")
        if kind == b"VP8L" and n >= 5:
            return file[at + 8 : at + 8 + n]
        if kind in (b"VP8 ", b"ALPH", b"ANMF"):
            raise ValueError("not a single lossless image")
        at += 8 + n + (n & 1)
    raise ValueError("not a lossless WebP file")


PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: log2 of the pixels in one, and the palette sizes up to which there are so many.
BUNDLES = ((3, 2), (2, 4), (1, 16), (0, 256))


def bundle_of(colours: int) -> int:
    return next(b for b, n in BUNDLES if colours <= n)


@dataclass
class Transform:
    """kind; width of the image after it is undone; size_bits of its blocks; its own image (modes, factors or palette)."""

    kind: int
    width: int
    size_bits: int = 0
    image: np.ndarray | None = None

    def undo(self, argb: np.ndarray, height: int) -> np.ndarray:
        if self.kind == SUBTRACT_GREEN:
            return invert_subtract_green(argb)
        if self.kind == PALETTE:
            return invert_palette(argb, self.width, height, self.image)
        way = invert_cross_colour if self.kind == CROSS_COLOUR else invert_predictor
        return way(argb, self.width, height, self.size_bits, self.image)


def _start(file: bytes) -> tuple[Bits, int, int, list[Transform], int]:
    """Bits, width, height, transforms, and the width of the image that is stored."""
    bits = Bits(payload(file))
    if bits.read(8) != SIGNATURE:
        raise ValueError("no signature")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("an unknown version")
    found: list[Transform] = []
    now = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in {t.kind for t in found}:
            raise ValueError("a transform twice")
        if kind == SUBTRACT_GREEN:
            found.append(Transform(kind, now))
        elif kind == PALETTE:
            palette = _values(np.cumsum(_channels(read_pixels(bits, bits.read(8) + 1, 1, False)), axis=0))
            found.append(Transform(kind, now, 0, palette))
            now = -(-now >> bundle_of(len(palette)))
        else:
            size_bits = bits.read(3) + 2
            found.append(Transform(kind, now, size_bits, read_pixels(bits, -(-now >> size_bits), -(-height >> size_bits), False)))
    return bits, width, height, found, now


def decode(file: bytes) -> np.ndarray:
    """height x width x 4 samples: red, green, blue, alpha."""
    bits, width, height, transforms, now = _start(file)
    pixels = read_pixels(bits, now, height, True)
    for t in reversed(transforms):
        pixels = t.undo(pixels, height)
    return _channels(pixels).reshape(height, width, 4)[..., [2, 1, 0, 3]].astype(np.uint8)


def undo_green(samples: np.ndarray, t: Transform) -> np.ndarray | None:
    """The green samples (height x width) before a palette, or before a predictor of the one mode left or above; None for another."""
    if t.kind == PALETTE:
        bundle = bundle_of(len(t.image))
        x, table = np.arange(t.width), np.zeros(256, np.uint8)
        table[: len(t.image)] = t.image >> 8 & 255
        return table[samples[:, x >> bundle] >> (x & ((1 << bundle) - 1)) * (8 >> bundle) & ((1 << (8 >> bundle)) - 1)]
    out = samples.copy()
    if int(t.image[0]) >> 8 & 15 == ABOVE:
        out[0] = np.cumsum(out[0], dtype=np.uint8)
        return np.cumsum(out, axis=0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], dtype=np.uint8)
    return np.cumsum(out, axis=1, dtype=np.uint8)


LEFT, ABOVE = 1, 2


def _simple(t: Transform) -> bool:
    return t.kind == PALETTE or t.kind == PREDICTOR and len(t.image) == 1 and int(t.image[0]) >> 8 & 15 in (LEFT, ABOVE)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The green samples of each image, height x width. Plain images of one group of codes run in lanes."""
    out: list[np.ndarray | None] = [None] * len(files)
    lanes = []
    for i, file in enumerate(files):
        bits, _, height, transforms, width = _start(file)
        if all(map(_simple, transforms)):
            head = read_head(bits, width, height, True)
            codes = head.groups[0]
            plain = not head.cache_bits and head.group_of is None and all(codes[c].only is not None for c in (RED, BLUE, ALPHA))
            if plain and 0 < codes[GREEN].bits <= LANE_BITS:
                lanes.append((width * height, i, bits, codes, width, transforms))
                continue
        out[i] = decode(file)[..., 1]
    if not lanes:
        return out
    lanes.sort(key=lambda x: -x[0])
    n = len(lanes)
    lut = np.zeros((n, 1 << LANE_BITS), np.uint16)
    starts = np.cumsum([0, *(len(x[2].data) + 8 for x in lanes)])
    flat = b"".join(x[2].data + bytes(8) for x in lanes)
    window = np.ndarray((len(flat) - 3,), "<u4", flat, strides=(1,))
    for k, x in enumerate(lanes):
        x[3][GREEN].fill(lut[k])
    lut = lut.reshape(-1)
    ends = np.cumsum([x[0] for x in lanes])
    put, end = ends - np.array([x[0] for x in lanes]), ends.copy()
    samples = np.zeros(int(ends[-1]) + 1, np.uint8)
    at = starts[:-1] * 8 + np.array([x[2].at for x in lanes])
    base, lane = np.arange(n) << LANE_BITS, np.arange(n)
    low, seven, nibble = np.uint32((1 << LANE_BITS) - 1), 7, np.uint16(15)
    while len(lane):
        special = None
        for _ in range(int((end - put).min())):
            entry = lut[base + (window[at >> 3] >> (at & seven).astype(np.uint32) & low)]
            at += entry & nibble
            entry >>= np.uint16(4)
            if entry.max() > 255:
                special = entry
                break
            samples[put] = entry
            put += 1
        if special is not None:
            literal = special < 256
            samples[put[literal]] = special[literal]
            put[literal] += 1
            for k in np.flatnonzero(~literal):
                total, i, bits, codes, width, _ = lanes[lane[k]]
                bits.at = int(at[k]) - int(starts[lane[k]]) * 8
                length = prefixed(int(special[k]) - LITERALS, bits)
                back = distance_of(prefixed(codes[DISTANCE].read(bits), bits), width)
                p = int(put[k])
                if back > p - (int(end[k]) - total) or p + length > end[k]:
                    raise ValueError("a back-reference outside the image")
                for j in range(p, p + length, back):
                    m = min(back, p + length - j)
                    samples[j : j + m] = samples[p - back : p - back + m]
                put[k], at[k] = p + length, bits.at + int(starts[lane[k]]) * 8
        left = put < end
        if not left.all():
            at, put, end, base, lane = at[left], put[left], end[left], base[left], lane[left]
    for k, (total, i, _, _, width, transforms) in enumerate(lanes):
        out[i] = samples[ends[k] - total : ends[k]].reshape(-1, width)
        for t in reversed(transforms):
            out[i] = undo_green(out[i], t)
    return out


def code_lengths(counts: list[int], longest: int) -> list[int]:
    """Lengths of a prefix code of the counts, at most `longest` bits each."""
    used = [(n, s) for s, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[used[0][1]] = 1
        return lengths
    while True:
        heap = [(n, s, (s,)) for n, s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys((s for _, s in used), 0)
        while len(heap) > 1:
            a, i, left = heapq.heappop(heap)
            b, _, right = heap[0]
            for s in left + right:
                depth[s] += 1
            heapq.heapreplace(heap, (a + b, i, left + right))
        if max(depth.values()) <= longest:
            break
        used = [((n + 1) // 2 + 1, s) for n, s in used]
    for s, n in depth.items():
        lengths[s] = n
    return lengths


class BitSink:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def put_code(sink: BitSink, lengths: list[int]) -> None:
    """Write a prefix code: one or two small symbols simply, any other by run-length coded lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        sink.put(1, 1)
        sink.put(len(used) - 1, 1)
        sink.put(1, 1)
        for s in used:
            sink.put(s, 8)
        return
    tokens: list[tuple[int, int, int]] = []
    at, stop = 0, max(used) + 1
    while at < stop:
        if lengths[at]:
            tokens.append((lengths[at], 0, 0))
            at += 1
            continue
        run = at
        while run < stop and not lengths[run]:
            run += 1
        n = min(run - at, 138)
        if n < 3:
            tokens += [(0, 0, 0)] * n
        else:
            tokens.append((17, 3, n - 3) if n < 11 else (18, 7, n - 11))
        at += n
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    if sum(c > 0 for c in counts) == 1:
        counts[0 if not counts[0] else 1] += 1
    own = code_lengths(counts, 7)
    codes = {s: (code, n) for s, n, code in canonical(own)}
    last = max(i for i, k in enumerate(LENGTH_ORDER) if own[k]) + 1
    sink.put(0, 1)
    sink.put(max(last, 4) - 4, 4)
    for k in LENGTH_ORDER[: max(last, 4)]:
        sink.put(own[k], 3)
    sink.put(1, 1)
    wide = max(1, -(-(max(2, len(tokens)) - 2).bit_length() // 2))
    sink.put(wide - 1, 3)
    sink.put(max(2, len(tokens)) - 2, 2 * wide)
    for t, extra, value in [*tokens, *([(0, 0, 0)] if len(tokens) == 1 else [])]:
        sink.put(*codes[t])
        sink.put(value, extra)


def wrap(data: bytes) -> bytes:
    """A RIFF file of a VP8L chunk."""
    padded = data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(padded) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + padded


def bits_of(symbols: np.ndarray) -> float:
    """About how many bits symbols take: their entropy and the code that says so."""
    n = np.bincount(symbols.reshape(-1), minlength=256)
    n = n[n > 0]
    return float(n @ (np.log2(n.sum()) - np.log2(n))) + 6 * len(n)


def put_constants(sink: BitSink, *symbols: int) -> None:
    """Codes of one symbol each, which take no bits in the image."""
    for one in symbols:
        put_code(sink, [int(s == one) for s in range(256)])


def shortest(samples: np.ndarray) -> tuple[np.ndarray, BitSink, int]:
    """Symbols (height x width) to store for samples, the transform that they need, and the constant alpha."""
    above, left = np.diff(samples, axis=0, prepend=np.uint8(0)), np.diff(samples, axis=1, prepend=np.uint8(0))
    above[0], left[:, 0] = left[0], above[:, 0]  # the first row is predicted from the left, the first column from above
    ways = [(bits_of(samples), 0, samples, None), (bits_of(above) + 60, 1, above, ABOVE), (bits_of(left) + 60, 2, left, LEFT)]
    values = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))
    if 1 < len(values) <= 16:
        per, wide = 1 << bundle_of(len(values)), 8 >> bundle_of(len(values))
        index = np.searchsorted(values, samples).astype(np.uint8)
        index = np.pad(index, ((0, 0), (0, -samples.shape[1] % per))).reshape(len(samples), -1, per)
        packed = (index << (np.arange(per) * wide).astype(np.uint8)).sum(axis=2, dtype=np.uint8)
        ways.append((bits_of(packed) + 60 + 14 * len(values), 3, packed, values))
    _, kind, symbols, how = min(ways, key=lambda w: w[:2])
    sink = BitSink()
    if kind in (1, 2):
        sink.put(1, 1)
        sink.put(PREDICTOR, 2)
        sink.put(7, 3)  # blocks of 512 pixels: one mode for all
        sink.put(0, 1)
        put_constants(sink, how, 0, 0, 255, 0)
        return symbols, sink, 0
    if kind == 3:
        sink.put(1, 1)
        sink.put(PALETTE, 2)
        sink.put(len(how) - 1, 8)
        sink.put(0, 1)
        deltas = np.diff(how, prepend=0).tolist()
        lengths = code_lengths(np.bincount(deltas, minlength=LITERALS + LENGTHS).tolist(), LANE_BITS)
        codes = {symbol: (code, n) for symbol, n, code in canonical(lengths)}
        put_code(sink, lengths)
        put_constants(sink, 0, 0)
        put_code(sink, [int(s in (0, 255)) for s in range(256)])  # alpha: 255 first, then no difference
        put_constants(sink, 0)
        for i, d in enumerate(deltas):
            if len(codes) > 1:
                sink.put(*codes[d])
            sink.put(int(i == 0), 1)
    return symbols, sink, 255


def encode_samples(images: list[bytes], width: int) -> list[bytes]:
    """A file for each image: rows of `width` 8-bit samples, kept in the green channel."""
    out = []
    for data in images:
        n = len(data)
        if n == 0 or n % width:
            raise ValueError("whole rows are needed")
        samples, transform, alpha = shortest(np.frombuffer(data, np.uint8).reshape(-1, width))
        samples = np.ascontiguousarray(samples).reshape(-1)
        other = np.flatnonzero(samples != samples[-1])
        run = len(samples) - 1 - (int(other[-1]) + 1 if len(other) else 0)
        run = min(run, 4096) if run >= 4 else 0
        literal = samples[: len(samples) - run]
        counts = np.bincount(literal, minlength=LITERALS + LENGTHS)
        tail = prefix_of(run) if run else None
        if tail:
            counts[LITERALS + tail[0]] += 1
        lengths = code_lengths(counts.tolist(), LANE_BITS)
        sink = BitSink()
        sink.put(SIGNATURE, 8)
        sink.put(width - 1, 14)
        sink.put(n // width - 1, 14)
        sink.put(0, 4)  # alpha is not used, version 0
        sink.put(transform.value, transform.n)
        sink.put(0, 1)  # no more transforms
        sink.put(0, 2)  # no colour cache, one group of codes
        put_code(sink, lengths)
        put_constants(sink, 0, 0, alpha, 1)  # red, blue, alpha; the distance is that to the left neighbour
        table, sizes = np.zeros((LITERALS, LANE_BITS), np.uint8), np.zeros(LITERALS, np.int64)
        codes = canonical(lengths)
        for symbol, size, code in codes if len(codes) > 1 else ():
            if symbol < LITERALS:
                table[symbol, :size] = [code >> k & 1 for k in range(size)]
                sizes[symbol] = size
        body = table[literal][np.arange(LANE_BITS) < sizes[literal][:, None]]
        end = BitSink()
        if tail:
            if len(codes) > 1:
                end.put(*next((code, size) for s, size, code in codes if s == LITERALS + tail[0]))
            end.put(tail[2], tail[1])
        bits = np.concatenate([_as_bits(sink), body, _as_bits(end)])
        out.append(wrap(np.packbits(bits, bitorder="little").tobytes()))
    return out


def _as_bits(sink: BitSink) -> np.ndarray:
    data = np.frombuffer(sink.value.to_bytes(-(-sink.n // 8) or 1, "little"), np.uint8)
    return np.unpackbits(data, count=sink.n, bitorder="little")
