"""The compressed script codec: canonical prefix codes over literals and matches, lengths under a keystream."""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from operator import add

import numpy as np

from bytequarry.functions.binary import BitReader, decrypt, encrypt, pack_bits
from bytequarry.functions.formats import PACKED_SCRIPT_MAGIC

SYMBOLS = 512
LONGEST, NEAREST, FARTHEST = 257, 2, 4097
HEAD = 32


def is_packed(data: bytes) -> bool:
    return data[:16] == PACKED_SCRIPT_MAGIC


def codes_of(lengths) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits): shorter codes first, then lower symbols."""
    out, code, last = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        if code >> n:
            raise ValueError("too many codes of one length")
        out[symbol] = (code, n)
        code += 1
    return out


def decode(data: bytes) -> bytes:
    if len(data) < 33 or not is_packed(data):
        raise ValueError("not a compressed script")
    key, size = struct.unpack_from("<II", data, 16)
    if len(data) < HEAD + SYMBOLS:
        raise ValueError("the code lengths end early")
    codes = codes_of(decrypt(data[HEAD : HEAD + SYMBOLS], key))
    if not codes and size:
        raise ValueError("no codes")
    by_code = {(n, code): symbol for symbol, (code, n) in codes.items()}
    wide = min(12, max((n for _, n in codes.values()), default=1))
    table: list[tuple[int, int] | None] = [None] * (1 << wide)
    for symbol, (code, n) in codes.items():
        if n <= wide:
            table[code << (wide - n) : (code + 1) << (wide - n)] = [(symbol, n)] * (1 << (wide - n))
    reader, out = BitReader(data + bytes(8), HEAD + SYMBOLS), bytearray()
    end = 8 * len(data)
    while len(out) < size:
        at = reader.at
        ahead = int.from_bytes(reader.data[at >> 3 : (at >> 3) + 4], "big") >> (32 - (at & 7) - wide) & ((1 << wide) - 1)
        if found := table[ahead]:
            symbol, n = found
            reader.at += n
        else:
            n, code = wide, reader.bits(wide)
            while (n, code) not in by_code:
                n, code = n + 1, code << 1 | reader.bit()
                if n > 255:
                    raise ValueError("a code that stands for nothing")
            symbol = by_code[n, code]
        if symbol < 256:
            out.append(symbol)
        else:
            back, n = reader.bits(12) + NEAREST, symbol - 256 + 2
            if back > len(out):
                raise ValueError("a match before the start")
            start = len(out) - back
            while n > 0 and len(out) < size:
                part = out[start : start + min(n, back)]
                out += part
                n -= len(part)
        if reader.at > end:
            raise ValueError("the bit stream ends early")
    del out[size:]
    return bytes(out)


def matches(data: bytes, checks: int = 64) -> list[tuple[int, int]]:
    """(length, distance) of the longest match found at each position, (0, 0) for none."""
    out, last, before = [(0, 0)] * len(data), {}, [-1] * len(data)
    for i in range(len(data) - 2):
        head = data[i : i + 3]
        j, best, far, most = last.get(head, -1), 0, 0, min(LONGEST, len(data) - i)
        for _ in range(checks):
            if j < 0 or i - j > FARTHEST:
                break
            if i - j >= NEAREST and (not best or data[i : i + best + 1] == data[j : j + best + 1]):
                n = max(best, 3)
                while n < most and data[i + n] == data[j + n]:
                    n += 1
                if n > best:
                    best, far = n, i - j
                    if best == most:
                        break
            j = before[j]
        before[i], last[head] = last.get(head, -1), i
        if best >= 3:
            out[i] = (best, far)
    return out


def code_lengths(counts: dict[int, int]) -> list[int]:
    """Huffman code lengths; between equal weights the earlier made first; one symbol has length 1."""
    lengths = [0] * SYMBOLS
    heap = [(n, s, (s,)) for s, n in counts.items() if n]
    if len(heap) == 1:
        lengths[heap[0][1]] = 1
        return lengths
    heapq.heapify(heap)
    made = SYMBOLS
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for s in left + right:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, made, left + right))
        made += 1
    return lengths


def least(data: bytes, longest: list[int], price: list[int], after: list[int]) -> tuple[list[int], list[int]]:
    """The step of least cost at each position, of all lengths up to the longest match, and the costs; after: those behind the data."""
    cost = [0] * len(data) + after
    step = [1] * len(data)
    of_match = [n + 12 for n in price[254:]]
    # the same numbers once more, for long matches
    costs_too, matches_too = np.array(cost, np.int64), np.array(of_match, np.int64)
    for i in range(len(data) - 1, -1, -1):
        best, take = price[data[i]] + cost[i + 1], 1
        if (most := longest[i]) > 48:
            costs = matches_too[3 : most + 1] + costs_too[i + 3 : i + most + 1]
            k = int(costs.argmin())
            if (c := int(costs[k])) < best:
                best, take = c, 3 + k
        elif most:
            costs = list(map(add, of_match[3 : most + 1], cost[i + 3 : i + most + 1]))
            if (c := min(costs)) < best:
                best, take = c, 3 + costs.index(c)
        cost[i], step[i] = best, take
        costs_too[i] = best
    return step, cost


def parse(data: bytes, found: list[tuple[int, int]], price: list[int]) -> list[tuple[int, int]]:
    """(symbol, distance) tokens of least cost, of all lengths of the matches, at so many bits a symbol."""
    step, _ = least(data, [n for n, _ in found], price, [0])
    out, i = [], 0
    while i < len(data):
        n = step[i]
        out.append((data[i], 0) if n == 1 else (254 + n, found[i][1]))
        i += n
    return out


def encode(data: bytes, rounds: int = 4, checks: int = 64) -> bytes:
    if not data:
        raise ValueError("an empty script cannot be compressed")
    found, price = matches(data, checks), [9] * SYMBOLS
    for _ in range(rounds):
        tokens = parse(data, found, price)
        lengths = code_lengths(Counter(s for s, _ in tokens))
        # a symbol that is not in use keeps the price it had
        new = [n or p for n, p in zip(lengths, price, strict=True)]
        if new == price:
            break
        price = new
    codes = codes_of(lengths)
    values, sizes = [], []
    for symbol, back in tokens:
        code, n = codes[symbol]
        values.append(code)
        sizes.append(n)
        if symbol > 255:
            values.append(back - NEAREST)
            sizes.append(12)
    return PACKED_SCRIPT_MAGIC + struct.pack("<II8x", 0, len(data)) + encrypt(bytes(lengths), 0) + pack_bits(values, sizes)
