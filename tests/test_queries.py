import os

import pytest
from pyspark.sql import functions as F

from bytequarry import catalog
from bytequarry.functions import binary, image, png, registered
from bytequarry.operators import archive, classify, script
from bytequarry.plans import fixtures, tools, unpack
from bytequarry.sources import files
from bytequarry.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(names)
    at = [list(names).index(c) for c in order]
    return sorted(repr(["NULL" if r[i] is None else r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = catalog.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_guard_path(spark):
    cases = [("..\\x", None, "parent path"), ("C:\\x", None, "absolute path"), ("/x", None, "absolute path"), ("a/./b", "a/b", None), ("", None, "empty path"), ("a\\\\b", "a/b", None), (None, None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "p string").select(archive.guard_path("p").alias("g"))
    assert [(r.g.path, r.g.error) for r in df.collect()] == [c[1:] for c in cases]


def test_unique_names_collide(spark):
    df = spark.createDataFrame([("1/a.arc",), ("2/a.arc",), ("3/a_2.arc",), ("4/.arc",), ("5/b.arc",), ("6/b.arc",)], "path string")
    got = {r.path: r.output_dir for r in classify.unique_names(df).collect()}
    assert got == {"1/a.arc": "a", "2/a.arc": "a_2", "3/a_2.arc": "a_2_2", "4/.arc": "archive", "5/b.arc": "b", "6/b.arc": "b_2"}


def test_unescape(spark):
    cases = ["a\ufdd0b", "\ufdd0\\\\", "\\\\\\\\n", "\n\\\r", "\\n", "\\\\n", "\\x", "\\", "a\\\\\\t", "", "plain"]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", binary.unescape("t").alias("u"))
    assert [r.u for r in df.collect()] == [binary.unescape_text(c) for c in cases]


def test_bad_archives_stay_apart(spark):
    good = fixtures.write_archive([("a/b.txt", b"hi"), ("../x", b"no"), ("a/b.txt", b"again")])
    df = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(good[:50])), ("none", None)], "arc_path string, content binary")
    got = {(r.arc_path, r.entry_index): (r.path, r.error) for r in archive.extract_entries(df).collect()}
    assert got["good", 0] == ("a/b.txt", None) and got["good", 1] == (None, "parent path") and got["good", 2] == ("a/b.txt", None)
    assert got["bad", None][1] == "the entry table passes the end" and got["none", None][1] == "not an archive"
    with pytest.raises(Exception, match="passes the end"):
        archive.extract_entries(df.where("arc_path = 'bad'"), fail_fast=True).collect()


def test_relational_and_per_script_forms_agree(spark):
    rows = []
    for i, kinds in enumerate([["name", "text", "other"], ["file", "backlog", "ruby_kanji", "ruby_furigana", "text"], []]):
        for version in ("0.00", "1.00"):
            rows.append((f"s{i}{version}", bytearray(fixtures.write_script(version, [f"t{j}".encode() for j in range(len(kinds))], kinds))))
    df = spark.createDataFrame(rows, "script string, content binary")
    got = {(r.script, r["index"]): (r.text_offset, r.kind, r.comment, r.code_offsets, r.original_text) for r in script.entries(df).collect()}
    want = {(s, e["index"]): (e["text_offset"], e["kind"], e["comment"], e["code_offsets"], e["original_text"]) for s, c in rows for e in script.script_entries(bytes(c))[1]}
    assert got == want


def test_scan_and_directory_source(spark, tmp_path):
    data = fixtures.write_archive([("a.txt", b"hello"), ("b.txt", b"")])
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.ARC").write_bytes(data)
    (tmp_path / "two.arc").write_bytes(b"not an archive at all")
    (tmp_path / "three.txt").write_bytes(data)
    found = files.scan_archives(spark, str(tmp_path))
    assert [os.path.basename(r.arc_path) for r in found.collect()] == ["one.ARC"]
    spark.dataSource.register(files.ArchiveDirectory)
    got = spark.read.format("archive_directory").load(str(tmp_path)).orderBy("entry_index").collect()
    assert [(r.name, r.offset, r["size"]) for r in got] == [("a.txt", 0, 5), ("b.txt", 5, 0)]


def test_unpack_outputs(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i}", "s") for i in range(12)], "doc_id long, text string, source string")
    done = unpack.unpack(fixtures.archives(docs, mixed=True))
    out = {r.output_path: bytes(r.output) for r in unpack.write_outputs(done, str(tmp_path / "out")).collect()}
    assert len(out) == 6 and out["text/doc_00000001.bin.ogg"] == b"document 1"
    assert "src=document 2" in out["text/doc_00000002.bin.hazuki.txt"].decode()
    empty = unpack.summary(unpack.unpack(fixtures.archives(docs.limit(0), mixed=True))).first()
    assert empty.asDict() == {"archives": 0, "extracted": 0, "processed": 0, "converted": 0, "skipped": 0}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"OggS....")
    run = ingest.classified_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(60)
    assert [r.label for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["ogg-audio"]


def test_texts_out_and_in(spark):
    made = {v: fixtures.write_script(v, [b"one", b"two", b"three"], ["name", "text", "other"]) for v in ("0.00", "1.00")}
    files = spark.createDataFrame([*((f"s{v}", bytearray(c)) for v, c in made.items()), ("bad", bytearray(b"DSC FORMAT 1.00\0 too short")), ("none", None)], "path string, content binary")
    out = {r.path: r for r in tools.extract_texts(files).collect()}
    assert out["s1.00"].output_path == "s1.00.hazuki.txt" and out["s1.00"].status == "converted" and out["bad"].status == "error" and out["bad"].output is None
    assert "# encode_cp=936" in tools.extract_texts(files.where("path = 's1.00'"), encode_page=936).first().output.decode()
    text = out["s1.00"].output.decode().replace("dst=", "dst=あ!", 1)
    cases = [("s1.00.Hazuki.TXT", text), ("s0.00.hazuki.txt", "no project"), ("gone.hazuki.txt", text), ("s1.00.txt", text)]
    todo = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in cases], "path string, content binary")
    done = {r.path: r for r in tools.apply_texts(files, todo).collect()}
    assert [done[p].status for p, _ in cases] == ["converted", "error", "error", "error"] and done["s1.00.Hazuki.TXT"].output_path == "s1.00.patched"
    assert [done[p].error for p, _ in cases[1:]] == ["not a text project", "the script is missing", "not a project's name"]
    assert "あ!".encode("cp932") in done["s1.00.Hazuki.TXT"].output
    other = todo.limit(1).withColumn("content", F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("encode_cp=932"), F.lit("encode_cp=1252")), "UTF-8"))
    assert tools.apply_texts(files, other).first().error == "not in code page 1252: U+3042"
    assert tools.apply_texts(files, other, page=932).first().status == "converted"
    with pytest.raises(Exception, match="not a text project"):
        tools.apply_texts(files, todo.where("path like 's0%'"), fail_fast=True).collect()


def test_images_both_ways(spark):
    picture = image.Image(3, 2, False, bytes([1, 2, 3, 255]) * 6)
    rows = [("a/x.PNG", png.save(picture)), ("y.bin", image.encode(picture)), ("z.png", b"no"), ("w.txt", b"text")]
    df = spark.createDataFrame([*((p, bytearray(c)) for p, c in rows), ("v", None)], "path string, content binary")
    done = tools.convert_images(df)
    got = {r.path: r for r in done.collect()}
    assert [(got[p].status, got[p].output_path) for p in ("a/x.PNG", "y.bin", "z.png", "w.txt", "v")] == [("converted", "a/x.cbg"), ("converted", "y.bin.png"), ("error", None), ("skipped", None), ("skipped", None)]
    assert image.decode(got["a/x.PNG"].output) == picture and png.load(got["y.bin"].output) == picture
    assert tools.counted(done).first().asDict() == {"converted": 2, "skipped": 2, "failed": 1}
    assert tools.counted(tools.convert_images(df.limit(0))).first().asDict() == {"converted": 0, "skipped": 0, "failed": 0}


def test_registered_functions(spark):
    registered.register(spark)
    row = spark.sql("SELECT dsc_decode(dsc_encode(X'414243').value) AS d, dsc_decode(X'00') AS bad, dsc_decode(CAST(NULL AS BINARY)) AS n, codepage_decode(X'82A0', 932) AS t, codepage_encode('é', 932) AS e").first()
    assert bytes(row.d.value) == b"ABC" and row.bad.value is None and row.bad.error and row.n.value is None and row.n.error is None and row.t == "あ" and "U+00E9" in row.e.error
    row = spark.sql("SELECT image_decode(image_encode(1, 1, X'010203FF').value) AS i, image_decode(X'00') AS bad, image_encode(1, 1, X'00').error AS e").first()
    assert (row.i.width, row.i.height, row.i.has_alpha, bytes(row.i.pixels)) == (1, 1, False, b"\1\2\3\xff") and row.bad.width is None and row.bad.error and row.e
    archive_file = fixtures.write_archive([("a.txt", b"hi"), ("b.txt", b"")])
    script_file = fixtures.write_script("1.00", [b"one", b"two"], ["name", "text"])
    spark.createDataFrame([(bytearray(archive_file), bytearray(script_file)), (None, None)], "a binary, s binary").createOrReplaceTempView("files_of_test")
    assert [(r.name, r["size"]) for r in spark.sql("SELECT e.name, e.size FROM files_of_test, LATERAL archive_entries(a) e ORDER BY 1").collect()] == [("a.txt", 2), ("b.txt", 0)]
    assert [bytes(r.bytes) for r in spark.sql("SELECT x.bytes FROM files_of_test, LATERAL script_slots(s) x ORDER BY slot_no").collect()] == [b"one", b"two"]
    assert spark.sql("SELECT count(*) AS n FROM (SELECT encode(concat('# BGI_HAZUKI_DSC_TEXT_V1', chr(10), '[ENTRY]', chr(10), 'src=x'), 'UTF-8') AS p), LATERAL project_entries(p)").first().n == 1


def test_hot_family_of_names_needs_no_walk(spark):
    rows = [(f"{i:04d}/data_{i}.arc",) for i in range(300)] + [("x/b.arc",), ("y/b.arc",), ("z/b_2.arc",)]
    got = {r.path: r.output_dir for r in classify.unique_names(spark.createDataFrame(rows, "path string")).collect()}
    assert all(got[p] == f"data_{i}" for i, (p,) in enumerate(rows[:300])) and [got[p] for (p,) in rows[300:]] == ["b", "b_2", "b_2_2"]


def test_scan_takes_each_file_once(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.arc").write_bytes(fixtures.write_archive([]))
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "y.ARC").write_bytes(fixtures.write_archive([("n", b"1")]))
    found = files.scan_archives(spark, *(str(tmp_path / p) for p in ("a", "a/b", "a/b/x.arc", "ab", "ab/", "gone")))
    assert sorted(os.path.basename(r.arc_path) for r in found.collect()) == ["x.arc", "y.ARC"]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert files.scan(spark, str(tmp_path / "gone")).count() == 0
    assert unpack.work(found).first().asDict() == {"archives": 2, "total_entries": 1, "total_bytes": 1, "total_work": 2}
    assert unpack.summary(unpack.unpack(found), found).first().asDict() == {"archives": 2, "extracted": 1, "processed": 1, "converted": 0, "skipped": 1}


def test_directory_source_keeps_bad_archives_apart(spark, tmp_path):
    good = fixtures.write_archive([("a.txt", b"hello")])
    for name, data in (("a.arc", good), ("b.arc", good[:60]), ("c.arc", b"no"), ("d.arc", good[:-1])):
        (tmp_path / name).write_bytes(data)
    spark.dataSource.register(files.ArchiveDirectory)
    for path, each in ((str(tmp_path), 1), (f"file://{tmp_path}", 64)):
        rows = spark.read.format("archive_directory").option("archivesPerTask", each).load(path).collect()
        got = {os.path.basename(r.arc_path): (r.name, r.error) for r in rows}
        assert got == {"a.arc": ("a.txt", None), "b.arc": (None, "the entry table passes the end"), "d.arc": (None, "entry 0 passes the end")}


def test_files_in_a_folder(spark, tmp_path):
    out = tmp_path / "out"
    (out / "old").mkdir(parents=True)
    (out / "old" / "x").write_bytes(b"gone before")
    rows = [("a/b.txt", b"one"), ("../x", b"no"), ("a/b.txt", b"one"), (None, b"x"), ("c", None), ("d\\e", b"")]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    done = sorted(((r.path, r.bytes, r.error) for r in unpack.write_files(df, str(out)).collect()), key=str)
    assert done == [("../x", None, "parent path"), ("a/b.txt", 3, None), ("a/b.txt", 3, None), ("d/e", 0, None)]
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and "_files" not in p.parts) == ["a/b.txt", "d/e"]
    docs = spark.createDataFrame([(i, f"document {i}", "s") for i in range(12)], "doc_id long, text string, source string")
    unpack.write_unpacked(fixtures.archives(docs, mixed=True), str(out))
    names = {p.name for p in (out / "s-000000" / "text").iterdir()}
    assert (out / "s-000000" / "text" / "doc_00000001.bin.ogg").read_bytes() == b"document 1"
    assert "doc_00000000.bin" in names and "doc_00000003.bin.png" in names and "doc_00000003.bin" not in names and len(names) == 16


def test_assets_by_kind(spark):
    picture = image.Image(3, 2, False, bytes([1, 2, 3, 255]) * 6)
    rows = [("x", image.encode(picture)), ("y", fixtures.write_script("1.00", [b"one"], ["name"])), ("z", fixtures.write_audio(b"sound")), ("w", b"text"), ("bad", fixtures.write_audio(b"sound", size=9)), ("n", None)]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r.path: r for r in tools.convert_assets(df, encode_page=936).collect()}
    assert [(got[p].status, got[p].output_path) for p, _ in rows] == [("converted", "x.png"), ("converted", "y.hazuki.txt"), ("converted", "z.ogg"), ("skipped", None), ("error", None), ("skipped", None)]
    assert png.load(got["x"].output) == picture and bytes(got["z"].output) == b"sound" and "# encode_cp=936" in got["y"].output.decode()
    assert tools.counted(tools.convert_assets(df)).first().asDict() == {"converted": 3, "skipped": 2, "failed": 1}
    assert {r.path: r.suggested_extension for r in tools.probe(df).collect()}["z"] == ".ogg"
    with pytest.raises(Exception, match="passes the end"):
        tools.convert_assets(df, fail_fast=True).collect()


def test_scripts_in_error_stay_apart(spark):
    good = fixtures.write_script("0.00", [b"one", b"two"], ["name", "text"])
    df = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(b"DSC FORMAT 1.00\0")), ("none", None)], "script string, content binary")
    rows = {(r.script, r["index"]): r.error for r in script.entries(df).collect()}
    assert rows == {("good", 1): None, ("good", 2): None, ("bad", None): "not a compressed script"}
    with pytest.raises(Exception, match="not a compressed script"):
        script.entries(df, fail_fast=True).collect()
    registered.register(spark)
    df.createOrReplaceTempView("scripts_in_error")
    assert [r.error for r in spark.sql("SELECT x.error FROM scripts_in_error, LATERAL script_slots(content) x").collect()].count("not a compressed script") == 1
