"""Byte-pair encoding in SQL: texts into pieces by regular expressions, pieces by merges in rounds, ids from the vocabulary file.

A piece is a string of its symbols with a space before and after each. A round merges, in every piece that still
has a pair of the file's merges, all places of its pair of the lowest rank. The expressions have no look-ahead, so
a mark stands in the text where a run of white space leaves its last character to the next word.
"""

from __future__ import annotations

from bytequarry.llm.tokens import byte_letters, vocabulary

#: White space of Unicode: fixed values.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A private character that stands for a border within white space.
MARK = r"\x{10FFFD}"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _letters() -> str:
    """A list literal of the letters of the 256 bytes."""
    of_byte = {b: letter for letter, b in byte_letters().items()}
    return "[" + ", ".join(_text(of_byte[b]) for b in range(256)) + "]"


def pieces_to_ids(path: str, last: str = "") -> str:
    """CTEs from pieces (column piece) to encoded: piece, n and hex of its ids as little-endian 32-bit numbers.

    last: what a piece's last symbol has at its end.
    """
    return rf"""
file AS MATERIALIZED (SELECT content::JSON AS j FROM read_text({_text(path)})),
vocab AS MATERIALIZED (SELECT unnest(json_keys(j, '$.model.vocab')) AS token, unnest(json_extract(j, '$.model.vocab.*'))::BIGINT AS id FROM file),
merges AS MATERIALIZED (SELECT m[1] AS a, m[2] AS b, place FROM (SELECT unnest(k) AS m, generate_subscripts(k, 1) AS place FROM (SELECT (j->'$.model.merges')::VARCHAR[][] AS k FROM file))),
start AS (SELECT piece, hex(piece) AS hx FROM (SELECT DISTINCT piece FROM pieces)),
letters AS (SELECT {_letters()} AS letter_of),
spelled AS (SELECT piece, unnest(range(0, strlen(hx) // 2)) AS i, hx FROM start),
symbols AS (SELECT piece, i, letter_of[('0x' || substr(hx, 2 * i + 1, 2))::INT + 1] || CASE WHEN 2 * i + 2 = strlen(hx) THEN {_text(last)} ELSE '' END AS symbol FROM spelled, letters),
rounds AS (
  SELECT piece, ' ' || string_agg(symbol, '  ' ORDER BY i) || ' ' AS s, 0 AS round FROM symbols GROUP BY piece
  UNION ALL
  SELECT piece, replace(s, ' ' || arg_min(a, place) || '  ' || arg_min(b, place) || ' ', ' ' || arg_min(a, place) || arg_min(b, place) || ' '), round + 1
  FROM (SELECT piece, s, round, unnest(k[1:len(k) - 1]) AS x, unnest(k[2:]) AS y FROM (SELECT piece, s, round, string_split(trim(s, ' '), '  ') AS k FROM rounds) WHERE len(k) > 1) p
  JOIN merges ON a = x AND b = y GROUP BY piece, s, round),
merged AS (SELECT piece, string_split(trim(arg_max(s, round), ' '), '  ') AS k FROM rounds GROUP BY piece),
tokens AS (SELECT piece, unnest(k) AS token, generate_subscripts(k, 1) AS i FROM merged),
encoded AS MATERIALIZED (SELECT piece, count(*) AS n, string_agg({_hex('id')}, '' ORDER BY i) AS hex FROM tokens JOIN vocab USING (token) GROUP BY piece)"""


def _hex(number: str) -> str:
    """Eight hex digits of a number's four bytes, the lowest first."""
    digits = f"printf('%08X', {number})"
    return " || ".join(f"substr({digits}, {at}, 2)" for at in (7, 5, 3, 1))


def round_trip(name: str = "byte_bpe_50k.json", special: str = "<|endoftext|>", special_id: int = 50256) -> str:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; bytes of valid text decode to the text itself."""
    cut = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}{MARK}]+|[{SPACE}]+"
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, string_split(coalesce(text, ''), {_text(special)}) AS k, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, unnest(k) AS part, generate_subscripts(k, 1) AS g, len(k) AS parts FROM docs),
cuts AS (SELECT doc_id, g, regexp_extract_all(regexp_replace(part, {_text(rf"([{SPACE}])([{SPACE}][^{SPACE}])")}, '\1' || chr(1114109) || '\2', 'g'), {_text(cut)}) AS k FROM parts),
pieces AS MATERIALIZED (SELECT doc_id, g, unnest(k) AS piece, generate_subscripts(k, 1) AS i FROM cuts),
{pieces_to_ids(vocabulary(name))},
each AS (SELECT doc_id, g, i, n, hex FROM pieces JOIN encoded USING (piece) UNION ALL SELECT doc_id, g, 1::BIGINT << 40, 1, {_hex(f'{special_id}')} FROM parts WHERE g < parts),
found AS (SELECT doc_id, sum(n)::BIGINT AS n_tokens, sha256(unhex(string_agg(hex, '' ORDER BY g, i))) AS ids_sha256 FROM each GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(ids_sha256, sha256(unhex(''))) AS ids_sha256, sha256(text) AS decoded_sha256 FROM docs LEFT JOIN found USING (doc_id)
"""


def _crc_tables() -> list[list[int]]:
    """What each byte adds to a CRC-32 that has 0 to 3 more bytes of the same number before it."""
    first = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        first.append(value)
    tables = [first]
    for _ in range(3):
        tables.append([x >> 8 ^ first[x & 255] for x in tables[-1]])
    return tables


def _crc(numbers: str) -> str:
    """The CRC-32 of a list of numbers as little-endian 32-bit integers."""
    tables = [f"[{', '.join(f'{x}::BIGINT' if i == 0 else str(x) for i, x in enumerate(t))}]" for t in _crc_tables()]
    mixed = [f"{tables[3 - k]}[(xor(a, x) >> {8 * k} & 255) + 1]" for k in range(4)]
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda a, x: xor(xor({mixed[0]}, {mixed[1]}), xor({mixed[2]}, {mixed[3]}))), 4294967295)"


def shards(name: str = "word_bpe_49k.json", end_id: int = 1) -> str:
    """doc_id, start, n_tokens and ids_crc32 of the documents' ids, each with the end id, in ascending doc_id order."""
    cut = rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
    special = r"<\|startoftext\|>|<\|endoftext\|>"
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, unnest(k) AS part, generate_subscripts(k, 1) AS g FROM (SELECT doc_id, string_split_regex(text, {_text(special)}) AS k FROM docs)),
specials AS (SELECT doc_id, unnest(k) AS token, generate_subscripts(k, 1) AS g FROM (SELECT doc_id, regexp_extract_all(text, {_text(special)}) AS k FROM docs)),
pieces AS MATERIALIZED (SELECT doc_id, g, unnest(k) AS piece, generate_subscripts(k, 1) AS i FROM (SELECT doc_id, g, regexp_extract_all(lower(nfc_normalize(part)), {_text(cut)}) AS k FROM parts)),
{pieces_to_ids(vocabulary(name), "</w>")},
added AS (SELECT x->>'content' AS token, (x->>'id')::BIGINT AS id FROM (SELECT unnest(json_extract(j, '$.added_tokens[*]')) AS x FROM file)),
ids AS (SELECT piece, list(id ORDER BY i) AS ids FROM tokens JOIN vocab USING (token) GROUP BY piece),
each AS (SELECT doc_id, g, i, ids FROM pieces JOIN ids USING (piece) UNION ALL SELECT doc_id, g, 1::BIGINT << 40, [id] FROM specials JOIN added USING (token)
         UNION ALL SELECT doc_id, 1::BIGINT << 40, 0, [{end_id}::BIGINT] FROM docs),
found AS (SELECT doc_id, flatten(list(ids ORDER BY g, i)) AS ids FROM each GROUP BY doc_id)
SELECT doc_id, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, len(ids)::BIGINT AS n_tokens, {_crc('ids')}::BIGINT AS ids_crc32 FROM found
"""
