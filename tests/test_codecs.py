import math
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytequarry.functions import binary, codepage, dsc, image, png
from bytequarry.operators import archive, script
from bytequarry.plans import fixtures
from bytequarry.sources import projects


@given(st.binary(min_size=1, max_size=600))
@settings(max_examples=60, deadline=None)
def test_script_codec_round_trip(data):
    assert dsc.decode(dsc.encode(data)) == data


@given(st.binary(max_size=400), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_keystream_round_trip(data, key):
    assert binary.decrypt(binary.encrypt(data, key), key) == data


@given(st.integers(0, 2**32 - 1))
def test_varint_round_trip(value):
    packed = binary.put_varint(value)
    assert binary.get_varint(packed, 0) == (value, len(packed))


@given(st.binary(max_size=300).map(lambda b: b.replace(b"\x01", b"\0\0\0\0\0\0")))
@settings(max_examples=60, deadline=None)
def test_run_lengths_round_trip(data):
    assert image.from_run_lengths(image.run_lengths(data), len(data)) == data


def test_run_length_threshold():
    assert image.run_lengths(b"a" + bytes(4) + b"b") == b"\x06a" + bytes(4) + b"b"
    assert image.run_lengths(b"a" + bytes(5) + b"b") == b"\x01a\x05\x01b"
    assert image.run_lengths(bytes(7)) == b"\x00\x07"


@pytest.mark.parametrize("size", [(1, 1), (3, 2), (8, 8), (9, 9), (17, 5)])
@pytest.mark.parametrize("clear", [False, True])
def test_image_round_trip(size, clear):
    width, height = size
    pixels = np.random.default_rng(width).integers(0, 256, (height, width, 4), dtype=np.uint8)
    pixels[..., 3] = 128 if clear else 255
    one = image.Image(width, height, clear, pixels.tobytes())
    assert image.decode(image.encode(one)) == one
    assert png.load(png.save(one)) == one


def test_image_of_one_symbol():
    one = image.Image(2, 2, True, bytes(16))
    assert image.decode(image.encode(one)) == one


def test_image_errors():
    data = bytearray(image.encode(image.Image(1, 1, False, b"\1\2\3\xff")))
    wrong = bytes(data[:44]) + bytes([data[44] ^ 1]) + bytes(data[45:])
    with pytest.raises(ValueError, match="checksum"):
        image.decode(wrong)
    data[46:48] = struct.pack("<H", 3)
    with pytest.raises(ValueError, match="version 3"):
        image.decode(bytes(data))
    with pytest.raises(ValueError):
        image.encode(image.Image(2, 1, False, b"\0\0\0\xff"))


def version_2(width, height, bits=24, alpha=b"", level=(8, 0)):
    """A stream of flat blocks: one DC step in the first block, none after it."""
    wide, high = -(-width // 8) * 8, -(-height // 8) * 8
    strips = high // 8
    table = bytes([1] * 128)
    # DC symbols 0 and 4, AC symbols 0 (end) and 15; equal weights: the first two join as 0 and 1
    dc, ac = [0] * 16, [0] * 176
    dc[0] = dc[4] = ac[0] = ac[15] = 1
    head = b"".join(map(binary.put_varint, dc + ac))
    blocks = 3 * wide // 8
    values, sizes = [1, level[0]], [1, 4]
    for _ in range(blocks - 1):
        values.append(0)
        sizes.append(1)
    body = binary.put_varint(blocks * 64) + binary.pack_bits(values, sizes) + binary.pack_bits([0] * blocks, [1] * blocks)
    skip = ((wide >> 3) + 7) >> 3
    strip = bytes(skip) + body
    start = len(head) + 4 * (strips + 1)
    offsets = [start + i * len(strip) for i in range(strips)] + [start + strips * len(strip)]
    data = head + struct.pack(f"<{strips + 1}i", *offsets) + strip * strips + alpha
    xor = 0
    for b in table:
        xor ^= b
    return image.HEAD.pack(image.IMAGE_MAGIC, width, height, bits, 0, 0, len(table), sum(table) & 255, xor, 2) + binary.encrypt(table, 0) + data


def test_version_2_flat_blocks():
    # DC 8 in all blocks (delta coded), scale 1: every sample is 128 + (8 >> 3) = 129
    out = image.decode(version_2(9, 9))
    y = cb = cr = np.float32(129)
    rgb = [y + np.float32(1.402) * cr - np.float32(178.956), y - np.float32(0.34414) * cb - np.float32(0.71414) * cr + np.float32(135.95984), y + np.float32(1.772) * cb - np.float32(226.316)]
    assert (out.width, out.height, out.has_alpha) == (9, 9, False)
    assert out.pixels == bytes([int(rgb[2]), int(rgb[1]), int(rgb[0]), 255]) * 81


def test_version_2_alpha():
    # 0b10: a literal, then a match of 3 from one to the left (x = -1)
    pair = struct.pack("<H", 63 | 0 << 9)
    out = image.decode(version_2(8, 8, 32, b"\1\0\0\0" + bytes([2, 7]) + pair))
    assert out.has_alpha and list(out.pixels[3:24:4]) == [7, 7, 7, 7, 255, 255]


def test_transform_agrees_with_cosines():
    rng = np.random.default_rng(3)
    c, scale = rng.integers(-20, 20, (2, 8, 8)), rng.integers(1, 9, (8, 8))
    got = image.inverse_transform(c, scale)
    for n, y, x in ((0, 0, 0), (0, 3, 7), (1, 7, 2), (1, 4, 4)):
        want = 0.0
        for v in range(8):
            for u in range(8):
                side = [1 if f == 0 else math.sqrt(2) * math.cos((2 * p + 1) * f * math.pi / 16) for f, p in ((v, y), (u, x))]
                want += c[n, v, u] * scale[v, u] * side[0] * side[1]
        assert abs(got[n, y, x] - want) < 1e-9


def test_version_2_terms_by_hand():
    """Codes of a block: 3 bits after no zero, a gap of 16, 2 bits after one zero, the end."""
    codes = [0x30, 0x0F, 0x21, 0x00]
    tree = image.WeightTree([1 if i in codes else 0 for i in range(176)])
    # equal weights: 0 and 15 are joined first, then 33 and 48; codes 00, 01, 10, 11
    bits = {0: "00", 15: "01", 33: "10", 48: "11"}
    text = bits[48] + "101" + bits[15] + bits[33] + "01" + bits[48] + "010" + bits[0]
    reader = binary.BitReader(int(text.ljust(40, "0"), 2).to_bytes(5, "big"))
    assert list(image.later_terms(reader, tree)) == [(1, 5), (19, -2), (20, -5)] and reader.at == len(text)
    assert image.zigzag()[:7] == [0, 1, 8, 16, 9, 2, 3]


@pytest.mark.parametrize("items,want", [
    ([7, 8, (-1, 0, 3)], [7, 8, 8, 8, 8]), ([*range(8), (0, -1, 3), 9], [*range(8), 0, 1, 2, 9]), ([1, (-1, 0, 130), 5], [1] * 64),
    ([*range(8), (2, -1, 4)], [*range(8), 2, 3, 4, 5]), ([1, (-2, 0, 3), 5], [1]), ([1, (1, 0, 3), 5], [1]), ([], []),
])
def test_version_2_alpha_by_hand(items, want):
    out, at = bytearray(b"\1\0\0\0"), 0
    for i, item in enumerate(items):
        if i % 8 == 0:
            at = len(out)
            out.append(0)
        if isinstance(item, tuple):
            across, up, n = item
            out[at] |= 1 << i % 8
            out += struct.pack("<H", across & 63 | (up & 7) << 6 | n - 3 << 9)
        else:
            out.append(item)
    assert list(image.alpha_samples(bytes(out), 8, 64)) == want
    short = list(image.alpha_samples(bytes(out[:-1]), 8, 64))
    assert short == want[: len(short)]
    assert image.alpha_samples(b"\2" + bytes(out[1:]), 8, 64) == b""


def test_crafted_headers_ask_for_no_memory():
    data = bytearray(image.encode(image.Image(1, 1, False, b"\1\2\3\xff")))
    head = list(image.HEAD.unpack_from(data))
    for at, value in ((4, 2**32 - 1), (1, 65535)):
        new = list(head)
        new[at] = value
        if at == 1:
            new[2] = 65535
        with pytest.raises(ValueError):
            image.decode(image.HEAD.pack(*new) + bytes(data[image.HEAD.size :]))


def test_weight_tree_ties():
    tree = image.WeightTree([1, 1, 2, 0])
    assert tree.children == {4: (0, 1), 5: (2, 4)}


@given(st.binary(max_size=12), st.sampled_from([932, 936, 949, 950, 1252]))
@settings(max_examples=300, deadline=None)
def test_sound_data_decode_as_character_by_character(data, page):
    got, out, i = codepage.decode(data, page), [], 0
    while i < len(data):
        n = 2 if codepage.is_lead(data[i], page) and i + 1 < len(data) else 1
        out.append(codepage.decode(data[i : i + n], page) if data[i : i + n] else "")
        i += n
    assert got == "".join(out)


def test_codepage_vectors():
    assert codepage.decode(b"\x82\xa0\x81\xad\x81") == "あ&#81AD&#0081"
    assert codepage.encode("あ&#81AD&#0041") == b"\x82\xa0\x81\xadA"
    assert codepage.encode("ⅰ") == b"\xfa\x40"
    with pytest.raises(UnicodeEncodeError):
        codepage.encode("é")


@pytest.mark.parametrize("text,slots", [(b"", []), (b"\0", []), (b"a\0\0b\0", [(0, b"a"), (2, b""), (3, b"b")]), (b"a", [(0, b"a")]), (b"a\0", [(0, b"a")])])
def test_slots(text, slots):
    assert script.split_slots(text) == slots


def test_layout_takes_the_last_mark():
    code = b"\x1b\0\0\0" + b"x" + b"\x1b\0\0\0"
    assert script.layout(code + b"t\0")[3:] == (code, b"t\0")
    assert script.layout(b"abc")[3:] == (b"abc", b"")


@pytest.mark.parametrize("version", ["0.00", "1.00"])
def test_all_kinds(version):
    texts = [f"t{i}".encode() for i in range(7)]
    data = fixtures.write_script(version, texts)
    found = script.script_entries(data)[1]
    assert [e["kind"] for e in found] == list(fixtures.SCRIPT_KINDS)
    assert found[1]["comment"] == "TEXT 【t0】"
    assert script.script_entries(dsc.encode(data)) == ("dsc", found)


def test_rebuild_moves_offsets():
    data = fixtures.write_script("1.00", [b"a", b"bb", b""])
    out = script.rebuild(data, {0: b"longer", 99: b"ignored"})
    assert script.layout(out)[4] == b"longer\0bb\0\0"
    assert [e["original_text"] for e in script.script_entries(out)[1]] == ["longer", "bb", ""]
    assert script.layout(script.rebuild(fixtures.write_script("1.00", [b"a"])[:-1], {}))[4] == b"a\0"


def test_project_rules():
    text = "\ufeff# BGI_HAZUKI_DSC_TEXT_V1\r\n# container=odd\n# decode_cp=936\n\n[ENTRY]\r\nid=0001\nkind=odd\ntext_offset=0000001A\ncode_offsets=10, ,0000001C\nsrc= a=b\\n \n# encode_cp=1252\ndst=x\\\\n\n\ncomment=lost\n[ENTRY]\nid=2\n[ENTRY]\nid=3\n"
    head, found = projects.parse_text(text)
    assert head == {"container": "dsc", "decode_cp": 936, "encode_cp": 1252}
    assert [e["index"] for e in found] == [1, 2, 3]
    assert found[0] == {"index": 1, "kind": "other", "text_offset": 26, "code_offsets": [16, 28], "comment": "", "original_text": " a=b\n", "translation_text": "x\\n"}
    with pytest.raises(ValueError):
        projects.parse_text("nothing")


def test_archive_errors():
    good = fixtures.write_archive([("a", b"12"), ("b", b"")])
    assert archive.read_directory(good) == [("a", 0, 2), ("b", 2, 0)]
    for bad in (b"", good[:100], good[:-1], b"X" + good[1:]):
        with pytest.raises(ValueError):
            archive.read_directory(bad)


def test_packed_script_errors():
    data = dsc.encode(b"hello hello hello")
    for bad in (data[:20], data[:300], data[:-2], b"x" * 40):
        with pytest.raises(ValueError):
            dsc.decode(bad)
    with pytest.raises(ValueError):
        dsc.encode(b"")


def test_random_text_round_trip():
    rng = random.Random(5)
    data = " ".join(rng.choice(["the", "of", "cat", "house"]) for _ in range(2000)).encode()
    packed = dsc.encode(data)
    assert dsc.decode(packed) == data and len(packed) < len(data)


def test_script_search_as_wide_as_the_reference():
    # forty nearer matches of three bytes stand before the long one
    far = b"abcdefghijklmnop"
    data = far + b"".join(b"abc" + bytes([128 + i]) for i in range(40)) + far
    assert dsc.matches(data)[len(data) - len(far)] == (len(far), len(data) - len(far))
    # a length above ten that is not the longest is the cheapest
    price = [9] * dsc.SYMBOLS
    price[254 + 20 : 254 + 31] = [1] + [200] * 10
    found = [(0, 0)] * 5 + [(30, 5)] + [(0, 0)] * 29
    assert dsc.parse(b"abcde" * 7, found, price) == [*((x, 0) for x in b"abcde"), (254 + 20, 5), *((x, 0) for x in b"abcde" * 2)]


def png_file(width, height, depth, kind, rows_of_passes, interlaced=0, extra=()):
    """A PNG file of unfiltered rows, given as bytes, with extra chunks before its data."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = zlib.compress(b"".join(b"\0" + r for rows in rows_of_passes for r in rows))
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlaced)) + b"".join(chunk(*e) for e in extra) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_png_of_few_bits(depth):
    most = (1 << depth) - 1
    grey = [[(3 * x + y) & most for x in range(5)] for y in range(3)]
    lines = [int("".join(f"{v:0{depth}b}" for v in row).ljust(-(-5 * depth // 8) * 8, "0"), 2).to_bytes(-(-5 * depth // 8), "big") for row in grey]
    got = png.load(png_file(5, 3, depth, 0, [lines], extra=[(b"tRNS", struct.pack(">H", most))]))
    assert [list(got.pixels[i : i + 4]) for i in range(0, 60, 4)] == [[v * 255 // most] * 3 + [0 if v == most else 255] for row in grey for v in row]
    palette = bytes(range(3 * (most + 1)))
    got = png.load(png_file(5, 3, depth, 3, [lines], extra=[(b"PLTE", palette), (b"tRNS", b"\x07")]))
    assert [list(got.pixels[i : i + 4]) for i in range(0, 60, 4)] == [[3 * v + 2, 3 * v + 1, 3 * v, 255 if v else 7] for row in grey for v in row]


def test_png_of_16_bits_and_interlace():
    rng = np.random.default_rng(2)
    px = rng.integers(0, 1 << 16, (7, 6, 4)).astype(">u2")
    want = (px >> 8).astype(np.uint8)[..., [2, 1, 0, 3]].tobytes()
    assert png.load(png_file(6, 7, 16, 6, [[r.tobytes() for r in px]])).pixels == want
    passes = []
    for p in range(7):
        x, y, dx, dy = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))[p]
        passes.append([r.tobytes() for r in px[y::dy, x::dx] if len(r)])
    assert png.load(png_file(6, 7, 16, 6, passes, 1)).pixels == want


def test_png_errors():
    good = png.save(image.Image(3, 2, False, bytes([1, 2, 3, 255]) * 6))
    at = good.index(b"IDAT")
    for bad in (b"", good[:12], good[:20], good[: at + 6], good[: at + 4] + b"\xff" + good[at + 5 :], good[:16] + b"\xff" * 8 + good[24:], good[:24] + b"\x03" + good[25:], good[:25] + b"\x03" + good[26:]):
        with pytest.raises(ValueError):
            png.load(bad)


def test_varint_arrays_and_keystreams():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**28 - 1, 2**28, 2**32 - 1], np.uint64)
    data, sizes = binary.put_varints(values)
    assert data == b"".join(binary.put_varint(int(v)) for v in values) and sizes.tolist() == [len(binary.put_varint(int(v))) for v in values]
    assert (binary.get_varints(data) == values).all() and len(binary.get_varints(b"")) == 0
    for bad in (b"\x80", b"\x80" * 5 + b"\1"):
        with pytest.raises(ValueError):
            binary.get_varints(bad)
    keys = [0, 1, 2**32 - 1, 123456789]
    assert [list(x) for x in binary.keystreams(np.array(keys, np.uint32), 40)] == [binary.keystream(k, 40).tolist() for k in keys]


def test_script_codec_vectors_by_hand():
    """Streams that the encoder did not write: literals, overlapping matches, the nearest and a longest match."""

    def packed(lengths, bits, size, key=0):
        table = bytearray(512)
        for symbol, n in lengths.items():
            table[symbol] = n
        return b"DSC FORMAT 1.00\0" + struct.pack("<II8x", key, size) + binary.encrypt(bytes(table), key) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

    # canonical codes by length, then symbol: a 0, b 10, match of 3 (257) 110, of 257 (511) 111
    codes = {97: 1, 98: 2, 257: 3, 511: 3}
    back = lambda n: f"{n - 2:012b}"
    assert dsc.decode(packed(codes, "0" + "10" + "110" + back(2), 5)) == b"ababa"
    assert dsc.decode(packed(codes, "0" + "10" + "111" + back(2), 259, 77)) == (b"ab" * 130)[:259]
    assert dsc.decode(packed(codes, "0" + "10" + "10" + "110" + back(3) + "0", 7)) == b"abbabba"
    assert dsc.decode(packed({120: 1}, "0000", 4)) == b"xxxx"
    with pytest.raises(ValueError):
        dsc.decode(packed(codes, "0" + "110" + back(2), 4))


def test_image_vector_by_hand():
    """A version 1 file that the encoder did not write: 2 x 2 pixels of 3 channels, residuals in two runs."""
    # bytes of the packed stream: a plain run of 7, its values, a run of 5 zeros
    residuals = [10, 20, 30, 1, 1, 1, 2]
    packed = bytes([7, *residuals, 5])
    counts = [0] * 256
    for b in packed:
        counts[b] += 1
    # 7:1 10:1 20:1 30:1 1:3 2:1 5:1; the two lightest are joined, by symbol: (2,5) (7,10) (20,30), then (1+...)
    table = b"".join(binary.put_varint(c) for c in counts)
    # joins in order: 2+5=A(2), 7+10=B(2), 20+30=C(2), then A+B=D(4), C+1=E(5), D+E
    bits = {2: "000", 5: "001", 7: "010", 10: "011", 20: "100", 30: "101", 1: "11"}
    # C has weight 2 and 1 has weight 3, so C is the 0 side of E and 1 the 1 side
    bits |= {20: "1" + "0" + "0", 30: "1" + "0" + "1", 1: "11"}
    text = "".join(bits[b] for b in packed)
    body = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    xor = 0
    for b in table:
        xor ^= b
    data = struct.pack("<16sHHI8xIIIBBH", b"CompressedBG___\0", 2, 2, 24, len(packed), 99, len(table), sum(table) & 255, xor, 1) + binary.encrypt(table, 99) + body
    # first pixel; its right neighbour is it plus 1 each; below: left alone is the upper plus (2, 0, 0); the last one is the mean
    first, right, below = (10, 20, 30), (11, 21, 31), (12, 20, 30)
    last = [(a + b) >> 1 for a, b in zip(below, right)]
    want = b"".join(bytes([*p, 255]) for p in (first, right, below, last))
    assert image.decode(data) == image.Image(2, 2, False, want)
