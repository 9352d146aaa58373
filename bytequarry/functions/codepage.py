"""Text in a legacy code page, character by character, with what it cannot decode as `&#XXXX`."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code page number -> Python's codec.
CODECS = {932: "cp932", 936: "gbk", 949: "cp949", 950: "cp950", 1252: "cp1252"}
ESCAPE = re.compile(r"&#([0-9A-Fa-f]{4})")


def codec(page: int) -> str:
    return CODECS.get(page, f"cp{page}")


def is_lead(byte: int, page: int = 932) -> bool:
    """Whether a byte starts a two-byte character."""
    if page == 932:
        return 0x81 <= byte <= 0x9F or 0xE0 <= byte <= 0xFC
    return page in (936, 949, 950) and 0x81 <= byte <= 0xFE


def decode(data: bytes, page: int = 932) -> str:
    if data.isascii():
        return data.decode("ascii")
    out, i, name = [], 0, codec(page)
    try:
        return data.decode(name)  # sound data in one go
    except UnicodeDecodeError:
        pass
    while i < len(data):
        n = 2 if is_lead(data[i], page) and i + 1 < len(data) else 1
        chunk = data[i : i + n]
        try:
            out.append(chunk.decode(name))
        except UnicodeDecodeError:
            out.append(f"&#{int.from_bytes(chunk, 'big'):04X}")
        i += n
    return "".join(out)


#: Rows of the code page that Windows writes where Python's codec writes another: U+2170 to U+2179 at FA40, by the rule.
_SMALL_ROMAN = {chr(0x2170 + i): bytes([0xFA, 0x40 + i]) for i in range(10)}


def encode(text: str, page: int = 932) -> bytes:
    """The reverse; raises UnicodeEncodeError for a character that the code page lacks."""
    if text.isascii() and "&#" not in text:
        return text.encode("ascii")
    out, at, name = bytearray(), 0, codec(page)

    def put(part: str) -> None:
        for c in part:
            out.extend(_SMALL_ROMAN[c] if page == 932 and c in _SMALL_ROMAN else c.encode(name))

    for found in ESCAPE.finditer(text):
        put(text[at : found.start()])
        value = int(found[1], 16)
        out.extend(bytes([value >> 8, value & 255] if value >> 8 else [value]))
        at = found.end()
    put(text[at:])
    return bytes(out)


def archive_name(data: bytes, page: int = 932) -> str:
    """Up to the first NUL, what cannot be decoded replaced."""
    return data.split(b"\0", 1)[0].decode(codec(page), "replace")


def decoded(data: Column | str, page: int = 932) -> Column:
    """decode() as a column; null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else decode(bytes(x), page))

    return run(data)


def encoder():
    """encode() as a function of (text, page) that gives struct<value binary, error string>."""

    @F.pandas_udf("value binary, error string")
    def run(values: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = []
        for x, page in zip(values, pages, strict=True):
            try:
                rows.append((None if x is None or pd.isna(page) else encode(x, int(page)), None))
            except UnicodeEncodeError as e:
                rows.append((None, f"not in code page {int(page)}: U+{ord(e.object[e.start]):04X}"))
            except LookupError:
                rows.append((None, f"code page {int(page)} is unknown"))
        return pd.DataFrame(rows, columns=["value", "error"])

    return run


def encoded(text: Column | str, page: Column | int = 932) -> Column:
    """encode() as a column of struct<value binary, error string>; a null text or page gives null in both."""
    return encoder()(text, F.lit(page) if isinstance(page, int) else page)
