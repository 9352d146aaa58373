"""Entries that are made and converted many at once, against one by one."""

from bytequarry.functions import dsc
from bytequarry.plans import fixtures, unpack


def documents() -> list[dict]:
    return [{"doc_id": i, "text": None if i == 8 else f"line {i} of {i * i} and more\n" * (i % 23)} for i in range(150)]


def test_entries_are_those_made_one_by_one():
    docs = documents()
    expected = [fixtures.entry_content(d["doc_id"], d["text"], True) for d in docs]
    expected = [dsc.encode(e) if d["doc_id"] % 6 == 2 else e for d, e in zip(docs, expected, strict=True)]
    assert fixtures.entry_contents(docs, True) == expected
    assert fixtures.entry_contents(docs, False) == [(d["text"] or "").encode() for d in docs]


def test_scripts_convert_together_as_one_by_one(spark, monkeypatch):
    files = dict(zip((f"{i:03d}.bin" for i in range(150)), fixtures.entry_contents(documents(), True), strict=True))
    files["cut.bin"] = files["014.bin"][:-3]
    archive = fixtures.write_archive(list(files.items()))
    rows = spark.createDataFrame([("a.arc", bytearray(archive))], "arc_path string, content binary")
    found = {r["path"]: r for r in unpack.unpack(rows).collect()}
    assert found["cut.bin"]["status"] == "error" and len(found) == 151
    scripts = [p for p, data in files.items() if dsc.is_packed(data) and p != "cut.bin"]
    assert len(scripts) == 25
    for path in scripts:
        data = files[path]
        assert bytes(found[path]["output"]) == unpack.convert("dsc", path, data) == unpack.convert("dsc", path, data, plain=dsc.decode(data))
