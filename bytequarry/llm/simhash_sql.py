"""SimHash components in SQL: XXH64 by its published steps, the fingerprints' bits, and what links reach.

Numbers of 64 bits are kept in 128, so that products do not overflow. Each step is a column of a table of its
own, over the distinct shingles.
"""

from __future__ import annotations

#: The primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED = 42
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in PRIMES)
_ALL = f"{2**64 - 1}::UHUGEINT"


def _low(x: str) -> str:
    return f"(({x}) & {_ALL})"


def _turned(x: str, by: int) -> str:
    return _low(f"(({x}) << {by}) | (({x}) >> {64 - by})")


def _number(at: str, size: int) -> str:
    """The little-endian number of so many bytes at a byte position, from the column hx of hex digits."""
    digits = " || ".join(f"substr(hx, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size)))
    return f"('0x' || {digits})::UBIGINT::UHUGEINT"


def _round(acc: str, lane: str) -> str:
    return _low(f"{_turned(f'{_low(f'{acc} + {_low(f'{lane} * {_P2}')}')}', 31)} * {_P1}")


def _lanes(k: int) -> str:
    """The accumulator k after all whole stripes of 32 bytes."""
    start = ((SEED + PRIMES[0] + PRIMES[1]) % 2**64, (SEED + PRIMES[1]) % 2**64, SEED, (SEED - PRIMES[0]) % 2**64)[k]
    lanes = f"[{_number(f'32 * j + {8 * k}', 8)} for j in range(0, n // 32)]"
    return f"list_reduce(list_prepend({start}::UHUGEINT, {lanes}), lambda a, x: {_round('a', 'x')})"


def _merged(h: str, acc: str) -> str:
    return _low(f"{_low(f'xor({h}, {_round('0::UHUGEINT', acc)}) * {_P1}')} + {_P4}")


def _over(numbers: str, step: str) -> str:
    """h after a step for each of the numbers, in which a is h and x the number."""
    return f"list_reduce(list_prepend(h, {numbers}), lambda a, x: {step})"


def _bits(k: int) -> str:
    return f"CASE WHEN 2 * sum((h >> {k}) & 1::UHUGEINT) > count(*) THEN {2**k}::UHUGEINT ELSE 0::UHUGEINT END"


def oracle(radius: int = 4) -> str:
    """doc_id, fingerprint and component_id of the documents, for four-word shingles."""
    eights = f"[{_number('p + 8 * j', 8)} for j in range(0, (n - p) // 8)]"
    ones = f"[{_number('j', 1)} for j in range(n - n % 4, n)]"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS k FROM documents),
u AS (SELECT doc_id, unnest(k) AS w1, generate_subscripts(k, 1) AS i FROM w),
v AS (SELECT doc_id, i, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, concat_ws(' ', w1, w2, w3, w4) AS s FROM v WHERE w4 IS NOT NULL OR i = 1),
x0 AS (SELECT s, hex(s) AS hx, strlen(s)::BIGINT AS n, 32 * (strlen(s)::BIGINT // 32) AS p FROM (SELECT DISTINCT s FROM s)),
x1 AS (SELECT s, hx, n, p, {_lanes(0)} AS a1, {_lanes(1)} AS a2, {_lanes(2)} AS a3, {_lanes(3)} AS a4 FROM x0),
x2 AS (SELECT *, {_low(' + '.join(_turned(a, r) for a, r in (('a1', 1), ('a2', 7), ('a3', 12), ('a4', 18))))} AS h FROM x1),
x3 AS (SELECT * REPLACE ({_merged('h', 'a1')} AS h) FROM x2),
x4 AS (SELECT * REPLACE ({_merged('h', 'a2')} AS h) FROM x3),
x5 AS (SELECT * REPLACE ({_merged('h', 'a3')} AS h) FROM x4),
x6 AS (SELECT * REPLACE ({_merged('h', 'a4')} AS h) FROM x5),
x7 AS (SELECT s, hx, n, p, {_low(f'CASE WHEN n >= 32 THEN h ELSE {(SEED + PRIMES[4]) % 2**64}::UHUGEINT END + n::UHUGEINT')} AS h FROM x6),
x8 AS (SELECT * REPLACE ({_over(eights, _low(f"{_low(f'{_turned(f'xor(a, {_round('0::UHUGEINT', 'x')})', 27)} * {_P1}')} + {_P4}"))} AS h) FROM x7),
x9 AS (SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {_low(f"{_low(f'{_turned(f'xor(h, {_low(f'{_number('n - n % 8', 4)} * {_P1}')})', 23)} * {_P2}')} + {_P3}")} ELSE h END AS h) FROM x8),
x10 AS (SELECT * REPLACE ({_over(ones, _low(f"{_turned(f'xor(a, {_low(f'x * {_P5}')})', 11)} * {_P1}"))} AS h) FROM x9),
x11 AS (SELECT * REPLACE ({_low(f'xor(h, h >> 33) * {_P2}')} AS h) FROM x10),
x12 AS (SELECT * REPLACE ({_low(f'xor(h, h >> 29) * {_P3}')} AS h) FROM x11),
x AS (SELECT s, xor(h, h >> 32) AS h FROM x12),
f AS (SELECT doc_id, ({' + '.join(map(_bits, range(64)))})::UBIGINT AS fp FROM s JOIN x USING (s) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents LEFT JOIN f USING (doc_id)),
c AS (SELECT fp, min(doc_id) AS least FROM d GROUP BY fp),
e AS (SELECT a.fp AS a, b.fp AS b FROM c a JOIN c b ON bit_count(xor(a.fp, b.fp)::BIT) <= {radius}),
r AS (SELECT fp, fp AS at FROM c UNION SELECT r.fp, e.b FROM r JOIN e ON r.at = e.a),
g AS (SELECT r.fp, min(c.least) AS component_id FROM r JOIN c ON c.fp = r.at GROUP BY r.fp)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM d JOIN g USING (fp)
"""
