"""The batch codec of compressed scripts against the plain one, byte for byte."""

import random
import time

import numpy as np
import pytest

from bytequarry.functions import dsc, dsc_many
from bytequarry.operators import script
from bytequarry.plans import fixtures

WORDS = [w.encode() for w in "the a house of river stone walked under morning light and then over seven bridges quietly".split()]


def prose(seed: int, n: int) -> bytes:
    rnd = random.Random(seed)
    return b" ".join(rnd.choice(WORDS) + rnd.choice((b"", b"", b"s", b", %d" % rnd.randrange(99))) for _ in range(n))


def scripts() -> list[bytes]:
    rnd = random.Random(5)
    noise = [bytes(rnd.randrange(256) for _ in range(n)) for n in (1, 2, 3, 700, 3000)]
    runs = [b"a" * n for n in (1, 2, 3, 4, 5, 257, 258, 259, 6000)] + [b"ab" * 900, bytes(range(256)) * 4]
    # what repeats beyond a part leaves the costs behind its end open, so that parts are gone through again
    return [*noise, *runs, prose(1, 40) * 60, prose(2, 9000), *(prose(i, 20 * i) for i in range(3, 40)), *(bytes(rnd.choice(b"ab ") for _ in range(n)) for n in (64, 5000))]


def test_files_are_those_of_the_plain_codec(monkeypatch):
    again, plain = [], dsc.least
    held = scripts()
    expected = [dsc.encode(s) for s in held]
    monkeypatch.setattr(dsc, "least", lambda data, *rest: again.append(len(data)) or plain(data, *rest))
    assert dsc_many.encode(held) == expected
    assert again and max(again) <= dsc_many.PART
    assert dsc_many.decode(expected) == held
    assert dsc_many.encode(held[:2]) == expected[:2]
    assert dsc_many.encode([]) == [] and dsc_many.decode([]) == []
    with pytest.raises(ValueError, match="empty"):
        dsc_many.encode([b"a", b""])


def test_groups_of_any_size_give_the_same_files(monkeypatch):
    held = [prose(i, 5 + 40 * (i % 30)) for i in range(90)]
    expected = [dsc.encode(s) for s in held]
    for size, steps in ((9000, 1 << 30), (1 << 20, 20_000), (1 << 20, 300_000)):
        monkeypatch.setattr(dsc_many, "GROUP_BYTES", size)
        monkeypatch.setattr(dsc_many, "GROUP_STEPS", steps)
        assert dsc_many.encode(held) == expected
        assert dsc_many.decode(expected) == held


def test_matches_and_code_lengths_one_by_one():
    held = scripts()
    found = dsc_many.matches(np.frombuffer(b"".join(held), np.uint8), np.array([len(s) for s in held]))
    assert list(zip(*(c.tolist() for c in found), strict=True)) == [m for s in held for m in dsc.matches(s)]
    rnd = random.Random(9)
    counts = np.array([[rnd.randrange(rnd.choice((1, 2, 9, 4000))) for _ in range(dsc.SYMBOLS)] for _ in range(20)] + [[0] * 511 + [3], [1] * 512])
    assert dsc_many.code_lengths(counts).tolist() == [dsc.code_lengths(dict(enumerate(row))) for row in counts.tolist()]


def test_damaged_files_fail_as_the_plain_codec_says():
    rnd = random.Random(3)
    files = []
    for i in range(300):
        f = bytearray(dsc.encode(prose(i, 30)))
        if i % 3:
            f[rnd.randrange(16, len(f))] ^= 1 << rnd.randrange(8)
        files.append(bytes(f[: rnd.randrange(len(f))] if i % 5 == 1 else f))
    sound, failed = dsc_many.sound(files), 0
    for f, text in zip(files, sound, strict=True):
        try:
            assert text in (None, dsc.decode(f))
        except ValueError:
            failed += 1
            assert text is None
    assert failed > 20 and sum(t is not None for t in sound) >= 80


def test_many_scripts_take_far_less_time_than_one_by_one():
    held = [prose(i, 300) for i in range(120)]
    times = []
    for run in (lambda: [dsc.encode(s) for s in held], lambda: dsc_many.encode(held)):
        began = time.process_time()
        run()
        times.append(time.process_time() - began)
    assert times[1] < times[0] / 2


def test_scripts_are_opened_once_and_others_stay(spark):
    plain = fixtures.write_script("1.00", [b"one", b"two"])
    packed = dsc.encode(plain)
    held = {"plain": plain, "packed": packed, "cut": packed[:-1], "twice": dsc.encode(packed), "none": None}
    rows = spark.createDataFrame([(k, v if v is None else bytearray(v)) for k, v in held.items()], "script string, content binary")
    found = {r["script"]: r["content"] if r["content"] is None else bytes(r["content"]) for r in script.opened(rows).collect()}
    assert found == held | {"packed": plain}
