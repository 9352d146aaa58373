"""PNG files to and from B, G, R, A pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from bytequarry.functions.image import MOST_BYTES, Image, has_alpha

MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def save(image: Image) -> bytes:
    if len(image.pixels) != image.width * image.height * 4 or not image.pixels:
        raise ValueError("pixels do not fit the sides")
    rgba = np.frombuffer(image.pixels, np.uint8).reshape(image.height, image.width, 4)[..., [2, 1, 0, 3]]
    rows = np.concatenate([np.zeros((image.height, 1), np.uint8), rgba.reshape(image.height, -1)], axis=1)
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", image.width, image.height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


#: Channels of each colour type, and the bit depths that it may have: fixed values of the format.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First column and row, and steps, of the passes of an interlaced file: fixed values of the format.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def load(data: bytes) -> Image:
    """The pixels of a file of any colour type, depth and interlace; samples of 16 bits give their high byte."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, body, head, palette, clear = 8, [], None, None, b""
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            if len(part) < 13:
                raise ValueError("the PNG header ends early")
            head = struct.unpack_from(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part[: len(part) // 3 * 3], np.uint8).reshape(-1, 3)[:256]
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] not in DEPTHS.get(head[3], ()) or head[6] > 1:
        raise ValueError("a PNG header that the format does not have")
    width, height, depth, kind = head[:4]
    if not 0 < width or not 0 < height or 4 * width * height > MOST_BYTES:
        raise ValueError("an image that no row can hold")
    channels = CHANNELS[kind]
    passes = PASSES if head[6] else ((0, 0, 1, 1),)
    sides = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    sizes = [h * (1 + -(-w * channels * depth // 8)) if w > 0 and h > 0 else 0 for w, h in sides]
    try:
        # no more than the header asks for, whatever the stream would give
        raw = zlib.decompressobj().decompress(b"".join(body), sum(sizes))
    except zlib.error as e:
        raise ValueError(f"a damaged PNG stream: {e}") from None
    if len(raw) < sum(sizes):
        raise ValueError("the PNG stream ends early")
    samples, start = np.zeros((height, width, channels), np.uint16), 0
    for (x, y, dx, dy), (w, h), size in zip(passes, sides, sizes, strict=True):
        if size:
            samples[y::dy, x::dx] = _samples(raw[start : start + size], w, h, channels, depth)
            start += size
    return _picture(samples, kind, depth, palette, clear)


def _samples(raw: bytes, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    """height x width x channels samples of one pass's filtered rows."""
    size = -(-width * channels * depth // 8)
    lines = np.frombuffer(raw, np.uint8).reshape(height, 1 + size)
    rows, above, step = np.zeros((height, size), np.uint8), np.zeros(size, np.uint8), max(1, channels * depth // 8)
    for y in range(height):
        rows[y] = above = _unfilter(int(lines[y, 0]), lines[y, 1:], above, step)
    if depth == 16:
        return rows.view(">u2").reshape(height, width, channels)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits << np.arange(depth)[::-1].astype(np.uint8)).sum(axis=2)[:, : width * channels]
    return rows.reshape(height, width, channels)


def _picture(samples: np.ndarray, kind: int, depth: int, palette: np.ndarray | None, clear: bytes) -> Image:
    height, width, _ = samples.shape
    out = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        if palette is None or samples.max() >= len(palette):
            raise ValueError("a colour that the palette lacks")
        table = np.full((len(palette), 4), 255, np.uint8)
        table[:, :3] = palette[:, ::-1]
        table[: len(clear), 3] = np.frombuffer(clear[: len(palette)], np.uint8)
        out = table[samples[..., 0]]
    else:
        levels = (samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1))).astype(np.uint8)
        out[..., :3] = levels[..., :1] if kind in (0, 4) else levels[..., 2::-1]
        if kind in (4, 6):
            out[..., 3] = levels[..., -1]
        elif len(clear) >= 2 * samples.shape[2]:
            # one colour that is clear
            out[..., 3] = np.where((samples == np.frombuffer(clear[: 2 * samples.shape[2]], ">u2")).all(axis=2), 0, 255)
    return Image(width, height, has_alpha(out.tobytes()), out.tobytes())


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out = row.astype(int).tolist()
    up = above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
        if kind == 3:
            guess = (a + b) >> 1
        elif kind == 4:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        else:
            raise ValueError("an unknown PNG filter")
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)
