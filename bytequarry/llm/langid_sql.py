"""Language ID in SQL: the sample, the n-gram filter and the corrected shares of the query, step by step.

Numbers of 64 bits are kept in 128, so that products do not overflow.
"""

from __future__ import annotations

from bytequarry.llm import langid
from bytequarry.llm.simhash_sql import _P1, _P2, _P3, _P4, _P5, PRIMES, _low, _round, _turned

_MIX = f"{0x9E3779B97F4A7C15}::UHUGEINT"


def _avalanche(name: str, source: str, keep: str) -> str:
    """CTEs <name>1 to <name>3 that end XXH64's hash h of the table source, with the columns to keep."""
    return f"""{name}1 AS (SELECT {keep}, {_low(f'xor(h, h >> 33) * {_P2}')} AS h FROM {source}),
{name}2 AS (SELECT {keep}, {_low(f'xor(h, h >> 29) * {_P3}')} AS h FROM {name}1),
{name} AS (SELECT {keep}, xor(h, h >> 32) AS h FROM {name}2)"""


def _byte(h: str, letter: str) -> str:
    return _low(f"{_turned(f'xor({h}, {ord(letter) * PRIMES[4] % 2**64}::UHUGEINT)', 11)} * {_P1}")


def _gram(n: int) -> str:
    """CTEs g1 to gn: the hash h of the letters' codes c1 to cn, one after the other."""
    out, columns = [], ", ".join(f"c{k}" for k in range(1, n + 1))
    for k in range(1, n + 1):
        before, source = ("h", f"g{k - 1}") if k > 1 else ("0::UHUGEINT", "distinct_grams")
        out.append(f"m{k} AS (SELECT {columns}, {_low(f'xor({before}, c{k}::UHUGEINT) * {_MIX}')} AS h FROM {source})")
        out.append(f"g{k} AS (SELECT {columns}, xor(h, h >> 29) AS h FROM m{k})")
    return ",\n".join(out)


def oracle(fit_rows: int = langid.FIT_ROWS, slots: int = langid.SLOTS, least_docs: int = 3) -> str:
    """doc_id, held_out, lang_pred and score of the documents, for 4-grams and two probes."""
    lang = int.from_bytes(b"lang", "little")  # the string that is hashed after the id is "langid"
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    crc = "a"
    for _ in range(8):
        crc = f"list_transform([{crc}], lambda a: {step})[1]"
    crc32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hx, 2 * j + 1, 2))::BIGINT for j in range(0, strlen(hx) // 2)]), lambda p, x: list_transform([xor(p, x)], lambda a: {crc})[1]), 4294967295)"
    columns = "c1, c2, c3, c4"
    return rf"""
WITH ids AS (SELECT DISTINCT doc_id, hex(doc_id::VARCHAR) AS hx, (doc_id::HUGEINT & {2**64 - 1}::HUGEINT)::UHUGEINT AS id FROM documents WHERE doc_id IS NOT NULL),
i1 AS (SELECT doc_id, {crc32} % 4 = 2 AS held_out, {_low(f"{_turned(f'xor({(42 + PRIMES[4] + 8) % 2**64}::UHUGEINT, {_round('0::UHUGEINT', 'id')})', 27)} * {_P1} + {_P4}")} AS h FROM ids),
{_avalanche('i2', 'i1', 'doc_id, held_out')},
i3 AS (SELECT doc_id, held_out, xor({_low(f'h + {_P5} + 6')}, {lang * PRIMES[0] % 2**64}::UHUGEINT) AS h FROM i2),
i4 AS (SELECT doc_id, held_out, {_low(f"{_low(f'{_turned('h', 23)} * {_P2}')} + {_P3}")} AS h FROM i3),
i5 AS (SELECT doc_id, held_out, {_byte('h', 'i')} AS h FROM i4),
i6 AS (SELECT doc_id, held_out, {_byte('h', 'd')} AS h FROM i5),
{_avalanche('i7', 'i6', 'doc_id, held_out')},
i AS MATERIALIZED (SELECT doc_id, held_out, ((h::HUGEINT - CASE WHEN h >= {2**63}::UHUGEINT THEN {2**64}::HUGEINT ELSE 0 END) % 1000000 + 1000000) % 1000000 / 1000000::DOUBLE AS share FROM i7),
sizes AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS place FROM documents JOIN i USING (doc_id) WHERE NOT held_out AND lang <> '' GROUP BY lang),
sample AS (SELECT doc_id, lang FROM documents JOIN i USING (doc_id) JOIN sizes USING (lang) WHERE NOT held_out AND share < {fit_rows}::DOUBLE / n),
u0 AS (SELECT doc_id, regexp_extract_all(' ' || lower(coalesce(text, '')) || ' ', '(?s).') AS k FROM documents),
u1 AS (SELECT doc_id, unnest(k) AS c, generate_subscripts(k, 1) AS pos FROM u0),
u2 AS MATERIALIZED (SELECT doc_id, pos, unicode(c) AS c, regexp_matches(c, '\p{{L}}') AS letter FROM u1),
u3 AS (SELECT *, lag(letter) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM u2),
u4 AS (SELECT doc_id, pos, CASE WHEN letter THEN c ELSE 32 END AS c1 FROM u3 WHERE letter OR coalesce(before, true)),
u5 AS (SELECT doc_id, c1, lead(c1, 1) OVER w AS c2, lead(c1, 2) OVER w AS c3, lead(c1, 3) OVER w AS c4 FROM u4 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS MATERIALIZED (SELECT doc_id, {columns}, count(*) AS n FROM u5 WHERE c4 IS NOT NULL GROUP BY ALL),
distinct_grams AS (SELECT DISTINCT {columns} FROM grams),
{_gram(4)},
hashed AS MATERIALIZED (SELECT {columns}, (h % {slots}::UHUGEINT)::BIGINT AS s0, ({_low('h + ((h >> 32) | 1::UHUGEINT)')} % {slots}::UHUGEINT)::BIGINT AS s1 FROM g4),
held AS (SELECT {columns}, lang FROM grams JOIN sample USING (doc_id) GROUP BY {columns}, lang HAVING count(DISTINCT doc_id) >= {least_docs}),
filled AS MATERIALIZED (SELECT lang, s0 AS slot FROM held JOIN hashed USING ({columns}) UNION SELECT lang, s1 FROM held JOIN hashed USING ({columns})),
rates AS (SELECT lang, place, least(fill * fill, 0.99::DOUBLE) AS rate FROM (SELECT s.lang, s.place, count(f.slot) / {slots}::DOUBLE AS fill FROM sizes s LEFT JOIN filled f ON f.lang = s.lang GROUP BY s.lang, s.place)),
slotted AS MATERIALIZED (SELECT slot, list(lang) AS langs FROM filled GROUP BY slot),
has AS MATERIALIZED (SELECT {columns}, unnest(list_intersect(a.langs, b.langs)) AS lang FROM hashed JOIN slotted a ON a.slot = s0 JOIN slotted b ON b.slot = s1),
hits AS (SELECT doc_id, lang, sum(n)::BIGINT AS hits FROM grams JOIN has USING ({columns}) GROUP BY doc_id, lang),
total AS (SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN grams g ON g.doc_id = d.doc_id GROUP BY d.doc_id),
scored AS (SELECT t.doc_id, r.lang, r.place, greatest(0, least(1, (coalesce(h.hits, 0)::DOUBLE / greatest(t.total, 1) - r.rate) / (1 - r.rate))) AS score
           FROM total t CROSS JOIN rates r LEFT JOIN hits h ON h.doc_id = t.doc_id AND h.lang = r.lang),
best AS (SELECT doc_id, lang, score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1),
lettered AS (SELECT DISTINCT doc_id FROM u2 WHERE letter)
SELECT d.doc_id, i.held_out, CASE WHEN l.doc_id IS NULL OR b.lang IS NULL THEN 'und' ELSE b.lang END AS lang_pred, CASE WHEN l.doc_id IS NULL OR b.lang IS NULL THEN 0::DOUBLE ELSE b.score END AS score
FROM documents d JOIN i USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN lettered l USING (doc_id)
"""
