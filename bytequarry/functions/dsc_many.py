"""The compressed script codec over many scripts at once: the files and texts of dsc.encode and dsc.decode, byte for byte.

Scripts are taken in groups of like lengths. Chains of equal heads are followed for all positions together, and the
parse, the code lengths and the decoder go on in all scripts of a group by a step at once. What is too large for a
group, or is not a sound file, goes to the plain codec, one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from bytequarry.functions import dsc
from bytequarry.functions.binary import keystreams
from bytequarry.functions.dsc import FARTHEST, HEAD, LONGEST, NEAREST, SYMBOLS
from bytequarry.functions.formats import PACKED_SCRIPT_MAGIC

#: Bytes of a group for the matches, and steps of one (each length of each match) for the parse.
GROUP_BYTES = 1 << 20
GROUP_STEPS = 8 << 20
#: Scripts or parts of a group from which a step of all of them costs less than one after the other.
FEW = 4
#: Bytes of a script that the parse goes through at once, and those behind that it begins with.
PART, AHEAD = 2048, 768
#: Bits of a sum of code lengths: a code of more goes to the plain codec.
KRAFT = 48
#: Bits of the decoder's table.
WIDE = 12
#: The keystream of key 0 over the code lengths.
_STREAM = keystreams(np.zeros(1, np.uint32), SYMBOLS)[0]

#: Bits after each symbol, and the bytes that it stands for.
_EXTRA, _LENGTH = np.where(np.arange(SYMBOLS) > 255, 12, 0), np.concatenate([np.ones(256, np.int64), np.arange(2, 258)])


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each count n, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _groups(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to `most` at most, or single items."""
    out, at, ends = [], 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        out.append((at, to))
        at = to
    return out


def matches(data: np.ndarray, sizes: np.ndarray, checks: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """dsc.matches of scripts that stand one after the other: length and distance at each position, 0 for none."""
    n, ends = len(data), np.cumsum(sizes)
    far, best = np.zeros(n, np.int32), np.full(n, 2, np.int32)
    end = np.repeat(ends, sizes).astype(np.int32)
    every = np.arange(n, dtype=np.int32)
    at = every[every < end - 2]
    if not len(at):
        return np.zeros(n, np.int32), far
    padded = np.concatenate([data, np.zeros(LONGEST + 16, np.uint8)])
    low = padded[at].astype(np.uint16) | padded[at + 1].astype(np.uint16) << 8
    order = np.argsort(low, kind="stable")
    order = order[np.argsort(padded[at + 2][order], kind="stable")]
    same = (low[order[1:]] == low[order[:-1]]) & (padded[at[order[1:]] + 2] == padded[at[order[:-1]] + 2])
    before = np.full(n + 1, -1, np.int32)  # and -1 before -1
    before[at[order[1:]]] = np.where(same, at[order[:-1]], -1)
    eight = np.zeros(n + LONGEST + 8, np.uint64)
    for k in range(8):
        eight |= padded[k : k + len(eight)].astype(np.uint64) << np.uint64(8 * k)
    least = np.maximum(np.repeat(ends - sizes, sizes).astype(np.int32), every - FARTHEST)
    most = np.minimum(LONGEST, end - every)
    mine, other = at, before[at]
    bound = least[mine]
    for _ in range(checks):
        alive = other >= bound
        if (left := np.count_nonzero(alive)) < 0.85 * len(mine):
            if not left:
                break
            mine, other, bound = mine[alive], other[alive], bound[alive]
            alive = True
        length = best[mine]
        hit = np.flatnonzero((padded[mine + length] == padded[other + length]) & (mine - other >= NEAREST) & alive)
        a, b = mine[hit], other[hit]
        size, open_ = np.zeros(len(hit), np.int32), np.arange(len(hit))
        for _ in range(-(-LONGEST // 8)):
            x = eight[a[open_] + size[open_]] ^ eight[b[open_] + size[open_]]
            # whole equal bytes: the zeros below the lowest bit
            zeros = np.where(x == 0, 8, np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1 >> 3).astype(np.int32)
            size[open_] += zeros
            open_ = open_[(zeros == 8) & (size[open_] < most[a[open_]])]
            if not len(open_):
                break
        size = np.minimum(size, most[a])
        more = size > best[a]
        a, b, size = a[more], b[more], size[more]
        best[a], far[a] = size, a - b
        full = hit[more][size == most[a]]
        other = before[other]
        other[full] = -1
    best[far == 0] = 0
    return best, far


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """dsc.code_lengths of each row of counts (scripts x symbols)."""
    rows, out = len(counts), np.zeros(counts.shape, np.int64)
    used = (counts > 0).sum(axis=1)
    wide = max(int(used.max()), 1)
    # leaves by weight, then symbol; nodes come out in the order of their weights, so two queues do
    never = np.int64(1) << 60
    order = np.argsort(np.where(counts > 0, counts, never), axis=1, kind="stable")[:, :wide]
    leaf = np.concatenate([np.take_along_axis(np.where(counts > 0, counts, never), order, 1), np.full((rows, 2), never)], axis=1)
    node = np.full((rows, wide + 2), never)
    parent = np.zeros((rows, 2 * wide + 2), np.int64)  # leaves first, then nodes
    i, j, row = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.arange(rows)
    for k in range(wide - 1):
        some = np.flatnonzero(used > k + 1)
        total = np.zeros(len(some), np.int64)
        for _ in range(2):
            x, y = leaf[some, i[some]], node[some, j[some]]
            first = x <= y
            total += np.where(first, x, y)
            parent[some, np.where(first, i[some], wide + j[some])] = wide + k
            i[some] += first
            j[some] += ~first
        node[some, k] = total
    depth = np.zeros((rows, 2 * wide + 2), np.int64)
    for k in range(wide - 3, -1, -1):
        some = np.flatnonzero(used > k + 2)
        depth[some, wide + k] = depth[some, parent[some, wide + k]] + 1
    of_leaf = np.take_along_axis(depth, parent[:, :wide], 1) + 1
    real = np.arange(wide) < used[:, None]
    out[np.broadcast_to(row[:, None], order.shape)[real], order[real]] = of_leaf[real]
    return out


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """dsc.codes_of of each row of code lengths, and which rows are sound."""
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol]
    sound = np.ones(len(lengths), bool)
    sound[row[size > KRAFT]] = False
    order = np.lexsort((symbol, size, row))
    row, symbol, size = row[order], symbol[order], np.minimum(size[order], KRAFT)
    share = np.uint64(1) << (KRAFT - size).astype(np.uint64)
    before = np.cumsum(share, dtype=np.uint64) - share
    held = np.bincount(row, minlength=len(lengths))
    start = np.concatenate([before, np.zeros(1, np.uint64)])[np.cumsum(held) - held]
    codes = np.zeros(lengths.shape, np.int64)
    own = before - start[row]
    codes[row, symbol] = (own >> (KRAFT - size).astype(np.uint64)).astype(np.int64)
    sound[row[own + share > np.uint64(1) << np.uint64(KRAFT)]] = False
    return codes, sound


def pack(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of so many bits each, highest bit first; the sizes add up to whole bytes."""
    out = []
    for i in range(0, len(values), 1 << 17):
        size = sizes[i : i + (1 << 17)]
        out.append((np.repeat(values[i : i + (1 << 17)], size) >> (np.repeat(size, size) - 1 - _ragged(size)) & 1).astype(np.uint8))
    return np.packbits(np.concatenate(out)).tobytes() if out else b""


class Parse:
    """dsc.parse of scripts that stand one after the other, at other prices each time.

    A script is cut in parts that go on together: each begins AHEAD bytes behind its end as if the script ended there.
    Costs behind the end that differ from those of the next part by one and the same number lead to the same steps;
    where they do not, the plain parse goes through that part again.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, found: np.ndarray) -> None:
        self.data, self.sizes, self.found, self.starts = data, sizes, found, np.cumsum(sizes) - sizes
        count = -(-sizes // PART)
        script, number = np.repeat(np.arange(len(sizes)), count), _ragged(count)
        begin = self.starts[script] + number * PART
        stop = (self.starts + sizes)[script]
        self.own = np.minimum(PART, stop - begin)
        length = np.minimum(self.own + AHEAD, stop - begin)
        # the longest first
        order = np.argsort(-length, kind="stable")
        self.next = np.full(len(order), -1)  # a script's next part
        back = np.argsort(order)
        self.next[back[:-1]] = np.where(script[1:] == script[:-1], back[1:], -1)
        self.script, self.begin, self.own, length = script[order], begin[order], self.own[order], length[order]
        self.length, self.longest, n = length, int(length[0]), len(order)
        # places by what is left of a part, then part: those with r bytes left stand together
        active = n - np.searchsorted(length[::-1], np.arange(self.longest + 1))
        self.first = np.concatenate([[0], np.cumsum(active)])
        left = np.repeat(np.arange(self.longest + 1, dtype=np.int32), active)
        who = (np.arange(len(left)) - self.first[left]).astype(np.int32)
        at = (self.begin + length)[who] - left
        at[:n] = 0  # the ends
        match = np.minimum(found[at], left)
        match[match < 3] = 0
        steps = np.where(match > 0, match - 1, 1)
        steps[:n] = 0
        bounds = np.concatenate([[0], np.cumsum(steps)])
        take = (np.arange(bounds[-1], dtype=np.int32) - np.repeat(bounds[:-1].astype(np.int32), steps)) + 1
        take[take > 1] += 1
        self.to = self.first.astype(np.int32)[np.repeat(left, steps) - take]
        self.to += np.repeat(who, steps)
        self.symbol = np.where(take == 1, np.repeat(data[at], steps), 254 + take).astype(np.int32)
        self.symbol += np.repeat(self.script[who].astype(np.int32) * SYMBOLS, steps)
        self.edges, self.places, self.inner = bounds[self.first].tolist(), self.first.tolist(), bounds[:-1] - bounds[self.first[left]]
        mine = at < (self.begin + self.own)[who]
        mine[:n] = False
        self.mine, self.mine_at = np.flatnonzero(mine), at[mine]

    def steps(self, price: np.ndarray) -> np.ndarray:
        """The length that each position's best step has, at so many bits a script's symbol."""
        # a cost and the length that it is for in one number: of equal costs, the least length
        ask = ((price + _EXTRA) << 9 | _LENGTH).reshape(-1)
        cost, step = np.zeros(self.places[-1], np.int64), np.ones(self.places[-1], np.int16)
        for k in range(1, self.longest + 1):
            a, b, p, q = self.edges[k], self.edges[k + 1], self.places[k], self.places[k + 1]
            each = cost.take(self.to[a:b])
            each += ask.take(self.symbol[a:b])
            best = np.minimum.reduceat(each, self.inner[p:q])
            step[p:q] = best & 511
            best &= -512
            cost[p:q] = best
        out = np.empty(len(self.data), np.int16)
        out[self.mine_at] = step[self.mine]
        # behind a part's end, as far as its matches reach
        part = np.flatnonzero(self.next >= 0)
        after = self.next[part]
        reach = np.minimum(LONGEST - 1, np.minimum(self.length[part] - self.own[part], self.length[after]))
        owner, far = np.repeat(np.arange(len(part)), reach + 1), _ragged(reach + 1)
        apart = cost[self.first[(self.length - self.own)[part][owner] - far] + part[owner]] - cost[self.first[self.length[after][owner] - far] + after[owner]]
        wrong = set(part[owner[apart != apart[np.cumsum(reach + 1) - reach - 1][owner]]].tolist())
        before = dict(zip(after.tolist(), part.tolist(), strict=True))
        behind: dict[int, list[int]] = {}  # costs from the start of the parts that are done again, the last of a script first
        while wrong:
            k = max(wrong, key=lambda k: self.begin[k])
            wrong.remove(k)
            p, n, near = int(self.begin[k]), int(self.own[k]), int(self.next[k])
            known = behind.get(near) or (cost[self.first[self.length[near] - np.arange(min(LONGEST - 1, self.length[near]) + 1)] + near] >> 9).tolist()
            own, costs = dsc.least(self.data[p : p + n].tobytes(), self.found[p : p + n].tolist(), price[self.script[k]].tolist(), known)
            out[p : p + n] = own
            behind[k] = costs[:LONGEST]
            if (last := before.get(k)) is not None:
                m = min(LONGEST - 1, int(self.length[last] - self.own[last]), len(behind[k]) - 1) + 1
                then = (cost[self.first[self.length[last] - self.own[last] - np.arange(m)] + last] >> 9) - np.array(behind[k][:m])
                wrong.discard(last)
                if (then != then[0]).any():
                    wrong.add(last)
        return out


def _taken(step: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of the steps that are taken, of many scripts at once while there are many."""
    at, stop, out = starts.astype(np.int64), starts + sizes, []
    while len(at) > 24:
        out.append(at)
        at = at + step[at]
        if not (more := at < stop).all():
            at, stop = at[more], stop[more]
    for p, q in zip(at.tolist(), stop.tolist(), strict=True):
        own, i, base, taken = step[p:q].tolist(), 0, p, []
        while i < len(own):
            taken.append(base + i)
            i += own[i]
        out.append(np.array(taken, np.int64))
    return np.sort(np.concatenate(out))


def _parsed(data: np.ndarray, sizes: np.ndarray, found: np.ndarray, far: np.ndarray, rounds: int) -> list[bytes]:
    """The files of scripts that stand one after the other."""
    n, starts = len(sizes), np.cumsum(sizes) - sizes
    parse, price = Parse(data, sizes, found), np.full((n, SYMBOLS), 9, np.int64)
    for _ in range(rounds):
        step = parse.steps(price)
        source = _taken(step, starts, sizes)
        size, owner = step[source].astype(np.int64), np.searchsorted(starts, source, "right") - 1
        names = np.where(size == 1, data[source], 254 + size)
        lengths = code_lengths(np.bincount(owner * SYMBOLS + names, minlength=n * SYMBOLS).reshape(n, SYMBOLS))
        new = np.where(lengths > 0, lengths, price)
        if (new == price).all():
            break
        price = new
    del parse
    codes, sound = codes_of(lengths)
    # each followed by its distance (of no bits after a literal), and zeros up to whole bytes
    values = np.stack([codes[owner, names], np.where(names > 255, far[source] - NEAREST, 0)], axis=1)
    bits = np.stack([lengths[owner, names], _EXTRA[names]], axis=1)
    total = np.bincount(owner, bits.sum(axis=1), n).astype(np.int64)
    last = np.cumsum(2 * np.bincount(owner, minlength=n))
    body = pack(np.insert(values.reshape(-1), last, 0), np.insert(bits.reshape(-1), last, -total % 8))
    ends = np.cumsum(-(-total // 8)).tolist()
    heads = (lengths.astype(np.uint8) + _STREAM).astype(np.uint8)
    out = []
    for i in range(n):
        if sound[i]:
            out.append(PACKED_SCRIPT_MAGIC + bytes(4) + int(sizes[i]).to_bytes(4, "little") + bytes(8) + heads[i].tobytes() + body[ends[i - 1] if i else 0 : ends[i]])
        else:
            out.append(dsc.encode(data[starts[i] : starts[i] + sizes[i]].tobytes(), rounds))
    return out


def encode(scripts: Sequence[bytes], rounds: int = 4, checks: int = 64) -> list[bytes]:
    """dsc.encode of each script."""
    if not all(scripts):
        raise ValueError("an empty script cannot be compressed")
    out: list[bytes] = [b""] * len(scripts)
    order = sorted(range(len(scripts)), key=lambda i: -len(scripts[i]))
    lengths = np.array([len(scripts[i]) for i in order], np.int64)
    for i, j in _groups(lengths, GROUP_BYTES):
        data, sizes = b"".join([scripts[k] for k in order[i:j]]), lengths[i:j]
        few = not FEW * PART <= len(data) <= 4 * GROUP_BYTES
        found, far = (sizes, sizes) if few else matches(np.frombuffer(data, np.uint8), sizes, checks)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        steps = sizes if few else np.add.reduceat(np.maximum(found, 1).astype(np.int64), ends[:-1])
        for a, b in _groups(steps, GROUP_STEPS):
            p, q, own = ends[a], ends[b], order[i + a : i + b]
            if few or steps[a:b].sum() > 2 * GROUP_STEPS:
                done = [dsc.encode(scripts[k], rounds, checks) for k in own]
            else:
                done = _parsed(np.frombuffer(data, np.uint8)[p:q], sizes[a:b], found[p:q], far[p:q], rounds)
            for k, packed in zip(own, done, strict=True):
                out[k] = packed
    return out


def decode(files: Sequence[bytes]) -> list[bytes]:
    """dsc.decode of each file; it fails where that does."""
    return [dsc.decode(f) if text is None else text for f, text in zip(files, sound(files), strict=True)]


def sound(files: Sequence[bytes]) -> list[bytes | None]:
    """dsc.decode of each file, or None for what is left to that: files that are not plainly sound, too large, or too few."""
    out: list[bytes | None] = [None] * len(files)
    good = [i for i, f in enumerate(files) if len(f) > HEAD + SYMBOLS and dsc.is_packed(f) and f[16:20] == bytes(4) and 0 < int.from_bytes(f[20:24], "little") <= GROUP_BYTES]
    good.sort(key=lambda i: int.from_bytes(files[i][20:24], "little"))
    sizes = np.array([int.from_bytes(files[i][20:24], "little") for i in good], np.int64)
    # the tables of a script count as well
    for i, j in _groups(np.maximum(sizes, 1 << WIDE), GROUP_BYTES):
        if j - i >= FEW:
            for k, text in zip(good[i:j], _unpacked([files[k] for k in good[i:j]], sizes[i:j]), strict=True):
                out[k] = text
    return out


def _unpacked(files: list[bytes], sizes: np.ndarray) -> list[bytes | None]:
    """The texts of files under key 0; None for one that is not plainly sound."""
    n = len(files)
    lengths = np.stack([np.frombuffer(f, np.uint8, SYMBOLS, HEAD) for f in files]) - _STREAM
    codes, sound = codes_of(lengths.astype(np.int64))
    table = np.zeros((n, 1 << WIDE), np.int16)  # bits and symbol: 0 for none
    row, symbol = np.nonzero((lengths > 0) & (lengths <= WIDE) & sound[:, None])
    size = lengths[row, symbol].astype(np.int64)
    spread = np.int64(1) << (WIDE - size)
    slot = np.repeat(row * (1 << WIDE) + (codes[row, symbol] << (WIDE - size)), spread) + _ragged(spread)
    table.reshape(-1)[slot] = np.repeat(size << 9 | symbol, spread)
    flat = table.reshape(-1)
    long = [{(int(lengths[i, s]), int(codes[i, s])): int(s) for s in np.flatnonzero(lengths[i] > WIDE)} for i in range(n)]
    body = np.frombuffer(b"".join([f[HEAD + SYMBOLS :] + bytes(8) for f in files]), np.uint8)
    held = np.array([len(f) - HEAD - SYMBOLS for f in files], np.int64)
    starts = np.cumsum(held + 8) - held - 8
    four = np.zeros(len(body) - 3, np.uint32)
    for k in range(4):
        four |= body[k : k + len(four)].astype(np.uint32) << np.uint32(24 - 8 * k)
    base = np.cumsum(sizes) - sizes
    # of each byte: itself, or how far back its copy is
    back, text = np.zeros(int(sizes.sum()), np.int32), np.zeros(int(sizes.sum()), np.uint8)
    ids, at, done = np.flatnonzero(sound), 8 * starts[sound], np.zeros(int(sound.sum()), np.int64)
    size, end = sizes[ids], 8 * (starts + held)[ids]
    copies = []
    while len(ids):
        found = flat[(ids << WIDE) + (four[at >> 3] >> (32 - WIDE - (at & 7)).astype(np.uint32) & np.uint32((1 << WIDE) - 1))].astype(np.int64)
        for k in np.flatnonzero(found == 0).tolist():
            p, who = int(at[k]), int(ids[k])
            ahead = int.from_bytes(body[p >> 3 : (p >> 3) + 8].tobytes().ljust(8, b"\0"), "big") << (p & 7) & (1 << 64) - 1
            for bits in range(WIDE + 1, KRAFT + 1):
                if (name := long[who].get((bits, ahead >> 64 - bits))) is not None:
                    found[k] = bits << 9 | name
                    break
            else:
                sound[who] = False
        at = at + (found >> 9)
        name = found & 511
        match = np.flatnonzero(name > 255)
        plain = name < 256
        n_out = np.ones(len(ids), np.int64)
        text[(base[ids] + done)[plain]] = name[plain]
        if len(match):
            ok = at[match] < end[match]
            sound[ids[match[~ok]]] = False
            match = match[ok]
            p = at[match]
            distance = (four[p >> 3] >> (20 - (p & 7)).astype(np.uint32) & np.uint32(4095)).astype(np.int64) + NEAREST
            at[match] = p + 12
            sound[ids[match[distance > done[match]]]] = False
            n_out[match] = np.minimum(name[match] - 254, (size - done)[match])
            copies.append((base[ids[match]] + done[match], distance, n_out[match]))
        done = done + n_out
        sound[ids[at > end]] = False
        go = (done < size) & sound[ids]
        if not go.all():
            ids, at, done, size, end = ids[go], at[go], done[go], size[go], end[go]
    if copies:
        place, distance, length = (np.concatenate(c) for c in zip(*copies, strict=True))
        back[np.repeat(place, length) + _ragged(length)] = np.repeat(distance, length)
    origin = np.maximum(np.arange(len(back), dtype=np.int32) - back, 0)
    while True:
        further = origin[origin]
        if (further == origin).all():
            break
        origin = further
    text = text[origin].tobytes()
    return [text[base[i] : base[i] + sizes[i]] if sound[i] else None for i in range(n)]
