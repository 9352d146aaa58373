"""Bytes, bits and text lines: column expressions where Spark has them, plain functions for the codecs."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a file that is not as it should be makes a decoder raise: its row's error, never the query's.
FILE_ERRORS = (ValueError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error)


def as_column(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x


def le_u32(data: Column | str, offset: Column | int = 0) -> Column:
    """The little-endian unsigned 32-bit integer at a byte offset; 0 where it would pass the end."""
    data, offset = as_column(data), as_column(offset)
    digits = F.concat(*[F.hex(F.substring(data, offset + F.lit(k), F.lit(1))) for k in (4, 3, 2, 1)])
    return F.when((offset >= 0) & (F.octet_length(data) >= offset + 4), F.conv(digits, 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def le_u32_bytes(value: Column | str) -> Column:
    """A number's low 32 bits as four little-endian bytes."""
    digits = F.lpad(F.hex(as_column(value).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]))


def byte_values(data: Column | str) -> Column:
    """array<int> of a binary's bytes."""
    digits = F.hex(as_column(data))
    n = F.length(digits)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1, F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int")))


def sum_checksum(data: Column | str) -> Column:
    return (F.aggregate(byte_values(data), F.lit(0).cast("bigint"), lambda a, b: a + b) % 256).cast("int")


def xor_checksum(data: Column | str) -> Column:
    return F.aggregate(byte_values(data), F.lit(0), lambda a, b: a.bitwiseXOR(b))


def escape(text: Column | str) -> Column:
    """Backslash, line feed, carriage return and tab as two characters each."""
    out = F.replace(as_column(text), F.lit("\\"), F.lit("\\\\"))
    for raw, letter in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        out = F.replace(out, F.lit(raw), F.lit("\\" + letter))
    return out


def unescape(text: Column | str) -> Column:
    """The reverse, left to right: another escaped character is itself; a last lone backslash stays.

    A text is cut at its escaped backslashes, so that its pieces hold escapes of other characters only.
    """

    def piece(x: Column) -> Column:
        for raw, letter in (("\n", "n"), ("\r", "r"), ("\t", "t")):
            x = F.replace(x, F.lit("\\" + letter), F.lit(raw))
        return F.regexp_replace(x, r"\\(?s)(.)", "$1")

    return F.array_join(F.transform(F.split(as_column(text), r"\\\\", -1), piece), "\\")


def unescape_text(text: str) -> str:
    out, chars = [], iter(text)
    for c in chars:
        if c != "\\":
            out.append(c)
        elif (after := next(chars, None)) is None:
            out.append(c)
        else:
            out.append({"n": "\n", "r": "\r", "t": "\t"}.get(after, after))
    return "".join(out)


def trim(text: Column | str) -> Column:
    """Without space, tab, CR and LF at both ends."""
    return F.btrim(as_column(text), F.lit(" \t\r\n"))


def split_lines(text: Column | str) -> Column:
    """Lines at LF, every CR dropped, the last piece kept."""
    return F.split(F.replace(as_column(text), F.lit("\r"), F.lit("")), "\n", -1)


def hex_offsets(offsets: Column | str) -> Column:
    return F.array_join(F.transform(as_column(offsets), lambda x: F.lpad(F.hex(x), 8, "0")), ",")


def parse_offsets(text: Column | str) -> Column:
    return F.transform(F.filter(F.transform(F.split(as_column(text), ","), trim), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint"))


# The keystream's constants: fixed values.
KEY_LOW, KEY_HIGH = 20021, 346


def keystreams(keys: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes of the streams that 32-bit keys start, a row a key; a step of all of them at once."""
    key, out = np.asarray(keys, np.uint32), np.empty((len(keys), n), np.uint8)
    half, word = np.uint32(0xFFFF), np.uint32(16)
    for i in range(n):
        low = np.uint32(KEY_LOW) * (key & half)
        high = (np.uint32(KEY_LOW) * (key >> word) + np.uint32(KEY_HIGH) * key + (low >> word)) & half
        key = (high << word) + (low & half) + np.uint32(1)
        out[:, i] = high & np.uint32(0xFF)
    return out


def keystream(key: int, n: int) -> np.ndarray:
    """The first n bytes of the stream that a 32-bit key starts."""
    out, mask = bytearray(), 0xFFFFFFFF
    for _ in range(n):
        low = KEY_LOW * (key & 0xFFFF)
        high = (KEY_LOW * (key >> 16) + KEY_HIGH * key + (low >> 16)) & 0xFFFF
        key = ((high << 16) + (low & 0xFFFF) + 1) & mask
        out.append(high & 0xFF)
    return np.frombuffer(bytes(out), np.uint8)


def decrypt(data: bytes, key: int) -> bytes:
    return (np.frombuffer(data, np.uint8) - keystream(key, len(data))).tobytes()


def encrypt(data: bytes, key: int) -> bytes:
    return (np.frombuffer(data, np.uint8) + keystream(key, len(data))).tobytes()


def put_varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position); at most five bytes."""
    value = 0
    for shift in range(0, 35, 7):
        if at >= len(data):
            raise ValueError("a varint passes the end")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value & 0xFFFFFFFF, at
    raise ValueError("a varint is too long")


def put_varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The varints of unsigned 32-bit values, one after the other, and the size of each."""
    values = np.asarray(values, np.uint64)
    groups = np.stack([values >> np.uint64(7 * k) for k in range(5)], axis=1)
    sizes = np.maximum(1, (groups > 0).sum(axis=1))
    places = np.arange(5) < sizes[:, None]
    more = np.where(np.arange(5) < sizes[:, None] - 1, 0x80, 0)
    return ((groups & np.uint64(0x7F)).astype(np.uint8) | more.astype(np.uint8))[places].tobytes(), sizes


def get_varints(data: bytes) -> np.ndarray:
    """The values of varints that stand one after the other."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    last = np.flatnonzero(b < 0x80)
    if len(b) and (not len(last) or last[-1] != len(b) - 1):
        raise ValueError("a varint passes the end")
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    if len(last) and (last - first).max() > 4:
        raise ValueError("a varint is too long")
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & np.uint64(0x7F)) << (np.uint64(7) * place.astype(np.uint64)), first) & np.uint64(0xFFFFFFFF) if len(b) else b


class BitReader:
    """Bits of a byte string, highest first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.end = data, 8 * at, 8 * len(data)

    def bit(self) -> int:
        if self.at >= self.end:
            raise ValueError("the bit stream ends early")
        b = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return b

    def bits(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the bit stream ends early")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * (last - first) - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return value

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def pack_bits(values: list[int], sizes: list[int]) -> bytes:
    """Numbers of so many bits each, highest bit first, filled up with zeros to a whole byte."""
    text = "".join([f"{v:0{n}b}" for v, n in zip(values, sizes, strict=True) if n])
    return int(text + "0" * (-len(text) % 8), 2).to_bytes(-(-len(text) // 8), "big") if text else b""
