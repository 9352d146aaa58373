"""The JVM's codecs against the Python ones: the same bytes, and nothing made of what is not sound."""

import random

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import dsc, image, jvm
from bytequarry.functions.formats import IMAGE_MAGIC
from bytequarry.plans import fixtures, unpack


def made(spark, what: str, items: list[bytes]) -> list[bytes | None]:
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(items)], "i int, x binary").repartition(4)
    return [None if r.y is None else bytes(r.y) for r in rows.select("i", jvm.column(spark, what, "x").alias("y")).orderBy("i").collect()]


def texts() -> list[bytes]:
    rng = random.Random(7)
    out = [bytes([7]) * n for n in (1, 2, 3, 4, 5, 300, 9000)]
    out += [bytes(rng.randrange(k) for _ in range(n)) for k in (1, 2, 3, 256) for n in (1, 3, 4, 7, 260, 5000)]
    out += [" ".join(rng.choice(["one", "two", "three", "four", "\n", "fünf"]) for _ in range(n)).encode() for n in (10, 300, 3000)]
    far = bytes(rng.randrange(256) for _ in range(4095))
    return [*out, (b"abcdefgh" * 40 + bytes(i % 256 for i in range(700))) * 5, far + far + b"xyz", b"a" + far + b"bc" + far[:300]]


def pictures() -> list[image.Image]:
    rng = random.Random(8)
    grey = [bytes([v]) * 4 * 64 for v in (0, 9, 255)]
    noise = [bytes(rng.randrange(k) for _ in range(4 * 8 * n)) for k in (2, 256) for n in (1, 3, 40)]
    out = [image.Image(8, len(p) // 32, image.has_alpha(p), p) for p in grey + noise]
    return [*out, image.Image(3, 2, True, noise[0][:24]), image.Image(1, 1, False, b"\1\2\3\xff"), *(fixtures.text_image(t) for t in texts()[-6:]), fixtures.text_image(b"")]


def outcome(f, x: bytes):
    try:
        return f(x)
    except Exception:
        return None


def damaged(files: list[bytes], start: int, n: int) -> list[bytes]:
    rng, out = random.Random(9), []
    for k in range(n):
        x = bytearray(files[k % len(files)])
        for _ in range(1 + k % 3):
            x[rng.randrange(start, len(x))] = rng.randrange(256)
        out.append(bytes(x[: rng.randrange(start, len(x))] if k % 4 == 0 else x))
    return out


def test_scripts_are_those_of_the_plain_codec(spark):
    packed = made(spark, "pack", texts())
    assert packed == [dsc.encode(t) for t in texts()]
    assert made(spark, "dsc", packed) == texts()
    assert made(spark, "pack", [b""]) == made(spark, "other", [b"x"]) == [None]


def test_damaged_scripts_give_the_plain_result_or_nothing(spark):
    files = [f for f in damaged([dsc.encode(t) for t in texts() if len(t) < 1000], 24, 300)]
    found = made(spark, "dsc", files)
    # what it leaves alone, a code length above 48 for one, goes to the plain codec
    assert all(a is None or a == b for a, b in zip(found, [outcome(dsc.decode, f) for f in files], strict=True)) and None in found and any(found)
    assert made(spark, "dsc", [b"", b"DSC FORMAT 1.00\0", b"x" * 600]) == [None] * 3


def test_images_are_those_of_the_plain_codec(spark):
    files = made(spark, "paint", [p.width.to_bytes(4, "little") + p.pixels for p in pictures()])
    assert files == [image.encode(p) for p in pictures()]
    assert made(spark, "image", files) == [p.pixels for p in pictures()]
    assert made(spark, "paint", [b"", bytes(8)[:7], (9).to_bytes(4, "little") + bytes(32)]) == [None] * 3


def test_damaged_images_give_the_plain_result_or_nothing(spark):
    files = damaged([image.encode(p) for p in pictures()], 48, 300)
    found = made(spark, "image", files)
    expected = [outcome(lambda x: image.decode(x).pixels, f) for f in files]
    assert all(a is None or a == b for a, b in zip(found, expected, strict=True)) and None in found and any(found)
    assert made(spark, "image", [b"", IMAGE_MAGIC, bytes(200)]) == [None] * 3


@pytest.fixture
def documents(spark):
    rows = [(i, None if i % 50 == 8 else f"line {i} of {i * i}, fünf\n" * (i % 23), "s%d" % (i % 2)) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_archives_and_their_unpack_use_no_plain_codec_and_are_the_same(spark, documents, monkeypatch):
    one = lambda: {r["arc_path"]: bytes(r["content"]) for r in fixtures.archives(documents, mixed=True).collect()}
    all_of = lambda: sorted(map(str, unpack.unpack(fixtures.archives(documents, mixed=True)).collect()))
    archives, done = one(), all_of()
    missing = documents.select(fixtures.entry_column(spark).alias("c")).where("c IS NULL").count()
    assert missing == 0 and len(archives) == 8
    monkeypatch.setattr(jvm, "_codec", lambda spark: None)
    assert one() == archives and all_of() == done


def test_paths_that_are_known_spare_a_second_making_of_the_archives(documents):
    paths = documents.select(fixtures.archive_path().alias("arc_path")).distinct()
    archives = fixtures.archives(documents, mixed=True)
    plans = [unpack.unpack(archives, **more)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for more in ({}, {"paths": paths})]
    # archives, their entries and what becomes of them
    assert plans[0] > plans[1] == 3
    assert unpack.unpack(archives, paths=paths).exceptAll(unpack.unpack(archives)).count() == 0


def test_ratio_compresses_every_text_in_the_jvm(spark, tmp_path, monkeypatch):
    from bytequarry import catalog

    rows = [("en", "word " * 900), ("en", ""), ("de", "xyz"), (None, None), (None, "again and again " * 99)]
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["dsc_ratio"](spark, str(tmp_path))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    expected = {("en", 2, 4500, True), ("de", 1, 3, False), (None, 2, 1584, True)}
    assert set(map(tuple, found.collect())) == expected
    monkeypatch.setattr(jvm, "_codec", lambda spark: None)
    assert set(map(tuple, catalog.queries()["dsc_ratio"](spark, str(tmp_path)).collect())) == expected
