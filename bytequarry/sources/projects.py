"""Text project files: rendered from entries, parsed into entries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions.binary import FILE_ERRORS, escape, hex_offsets, unescape_text
from bytequarry.functions.formats import PROJECT_MAGIC, RANK

BLANK = " \t\r\n"


def render(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """script, content: a project file a script.

    headers: script, container, decode_cp, encode_cp; entries: script, index, kind, text_offset,
    code_offsets, comment, original_text, translation_text.
    """
    block = F.concat_ws(
        "\n", F.lit("[ENTRY]"), F.concat(F.lit("id="), F.format_string("%04d", "index")), F.concat(F.lit("kind="), "kind"),
        F.concat(F.lit("text_offset="), F.lpad(F.hex("text_offset"), 8, "0")), F.concat(F.lit("code_offsets="), hex_offsets("code_offsets")),
        F.concat(F.lit("comment="), escape("comment")), F.concat(F.lit("src="), escape("original_text")), F.concat(F.lit("dst="), escape("translation_text")), F.lit("\n"),
    )
    blocks = entries.groupBy("script").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", block.alias("b")))), lambda x: x["b"]), "").alias("blocks"))
    head = F.concat_ws(
        "\n", F.lit(PROJECT_MAGIC), F.concat(F.lit("# script_name="), "script"), F.concat(F.lit("# container="), "container"),
        F.concat(F.lit("# decode_cp="), "decode_cp"), F.concat(F.lit("# encode_cp="), "encode_cp"), F.lit("\n"),
    )
    rows = headers.join(blocks, "script", "left")
    return rows.select("script", F.encode(F.concat(F.lit("\ufeff"), head, F.coalesce("blocks", F.lit(""))), "UTF-8").alias("content"))


def script_text(script: str, container: str, found: list[dict], page: int = 932, encode_page: int | None = None) -> bytes:
    """The project file of one script's entries; without an encode_page, texts go back by the page they came by."""
    mark = lambda x: x.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    out = [PROJECT_MAGIC, f"# script_name={script}", f"# container={container}", f"# decode_cp={page}", f"# encode_cp={encode_page or page}", ""]
    for e in found:
        out += ["[ENTRY]", f"id={e['index']:04d}", f"kind={e['kind']}", f"text_offset={e['text_offset']:08X}", "code_offsets=" + ",".join(f"{x:08X}" for x in e["code_offsets"])]
        out += [f"comment={mark(e['comment'])}", f"src={mark(e['original_text'])}", "dst=", ""]
    return ("\ufeff" + "\n".join(out) + "\n").encode()


def number(text: str, base: int = 10, most: int = 2**31 - 1) -> int:
    """A number of a project's line, from 0 to `most`."""
    value = int(text, base)
    if not 0 <= value <= most:
        raise ValueError(f"a number out of range: {text}")
    return value


def parse_text(text: str) -> tuple[dict, list[dict]]:
    """(header, entries) of a project's text.

    Lines lose blanks at both ends. A blank line or the next [ENTRY] ends an entry; fields outside one are
    ignored; a line that starts with # is a header line anywhere.
    """
    head = {"container": "dsc", "decode_cp": 932, "encode_cp": 932}
    lines = text.removeprefix("\ufeff").replace("\r", "").split("\n")
    if not lines or lines[0].strip(BLANK) != PROJECT_MAGIC:
        raise ValueError("not a text project")
    out: list[dict] = []
    entry: dict | None = None
    for raw in lines[1:]:
        line = raw.strip(BLANK)
        if not line:
            entry = None
        elif line.startswith("#"):
            key, _, value = line[1:].strip(BLANK).partition("=")
            if key == "container":
                head[key] = value if value in ("dsc", "compiled") else "dsc"
            elif key in ("decode_cp", "encode_cp"):
                head[key] = number(value)
        elif line == "[ENTRY]":
            entry = {"index": 0, "kind": "other", "text_offset": 0, "code_offsets": [], "comment": "", "original_text": "", "translation_text": ""}
            out.append(entry)
        elif entry is not None and "=" in line:
            key, _, value = line.partition("=")
            if key == "id":
                entry["index"] = number(value)
            elif key == "kind":
                entry["kind"] = value if value in RANK else "other"
            elif key == "text_offset":
                entry["text_offset"] = number(value, 16, 2**32 - 1)
            elif key == "code_offsets":
                entry["code_offsets"] = [number(x, 16, 2**32 - 1) for x in value.split(",") if x.strip(BLANK)]
            elif key in ("comment", "src", "dst"):
                entry[{"comment": "comment", "src": "original_text", "dst": "translation_text"}[key]] = unescape_text(value)
    return head, out


_SCHEMA = "script string, container string, decode_cp int, encode_cp int, entry_no int, index int, text_offset long, kind string, comment string, code_offsets array<bigint>, original_text string, translation_text string, error string"


def parse(projects: DataFrame) -> DataFrame:
    """A row an entry of projects (script, content); a project that cannot be read is one row with its error."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.string()]
    fields = ("index", "text_offset", "kind", "comment", "code_offsets", "original_text", "translation_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for script, content in zip(batch.column("script").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    head, found = parse_text((content or b"").decode("utf-8"))
                    rows += [(script, head["container"], head["decode_cp"], head["encode_cp"], i, *(e[f] for f in fields), None) for i, e in enumerate(found)]
                except FILE_ERRORS as e:
                    rows.append((script, *[None] * 11, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split(" ")[0] for c in _SCHEMA.split(", ")])

    return projects.select("script", "content").mapInArrow(run, _SCHEMA)
