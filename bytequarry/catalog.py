"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytequarry.functions import binary, codepage, dsc_many, image, jvm, png, registered
from bytequarry.operators import archive, classify, script
from bytequarry.plans import fixtures, tools, unpack
from bytequarry.sources import projects

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query of (table reader) under its function's name, with its SQL."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        _QUERIES[fn.__name__] = run
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


ARC = "printf('%s-%06d.arc', source, doc_id // 64)"
ENTRY = f"""e AS (SELECT {ARC} AS arc_path, (row_number() OVER w - 1)::INT AS entry_index, printf('text/doc_%08d.bin', doc_id) AS path, text, doc_id, source,
  (coalesce(sum(strlen(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", strlen(text)::BIGINT AS size
  FROM documents WINDOW w AS (PARTITION BY source, doc_id // 64 ORDER BY doc_id))"""


@query(f"WITH {ENTRY} SELECT arc_path, entry_index, path, \"offset\", size FROM e")
def archive_listing(table):
    """Directory of archives built from documents."""
    return archive.list_entries(fixtures.archives(table("documents"))).select("arc_path", "entry_index", "path", "offset", "size")


@query(f"WITH {ENTRY} SELECT arc_path, entry_index, replace(path, '/', chr(92)) AS name, \"offset\", size FROM e")
def archive_directory_columns(table):
    """The same directory in column functions alone, names as stored."""
    return archive.directory_columns(fixtures.archives(table("documents")))


@query(f"WITH {ENTRY} SELECT arc_path, entry_index, path, text FROM e")
def archive_extract(table):
    rows = archive.extract_entries(fixtures.archives(table("documents")))
    return rows.select("arc_path", "entry_index", "path", F.decode("content", "UTF-8").alias("text"))


@query("""SELECT count(DISTINCT source || '/' || (doc_id // 64)) + 1 AS archives, count(*) AS extracted, count(*) AS processed,
  count(*) FILTER (WHERE doc_id % 6 IN (1, 2, 3)) AS converted, count(*) FILTER (WHERE doc_id % 6 NOT IN (1, 2, 3)) AS skipped FROM documents""")
def archive_summary(table):
    """Run summary of a full unpack of archives with six kinds of entries, one without entries and a damaged one."""
    # the archives of a run are scanned for their paths alone, which the fixture gives without their content
    names = table("documents").select(fixtures.archive_path().alias("arc_path")).distinct()
    odd = names.sparkSession.createDataFrame([("empty.arc",), ("bad.arc",)], "arc_path string")
    names = names.unionByName(odd)
    return unpack.summary(unpack.unpack(_archives_and_odd(table, mixed=True), paths=names), names)


def _archives_and_odd(table, mixed=False):
    made = fixtures.archives(table("documents"), mixed)
    none = fixtures.write_archive([])
    odd = made.sparkSession.createDataFrame([("empty.arc", bytearray(none)), ("bad.arc", bytearray(none[:12] + b"\7\0\0\0"))], "arc_path string, content binary")
    return made.unionByName(odd)


@query("""SELECT count(DISTINCT source || '/' || (doc_id // 64)) + 2 AS archives, count(*) AS total_entries, sum(strlen(coalesce(text, '')))::BIGINT AS total_bytes, 2 * count(*) AS total_work FROM documents""")
def archive_work(table):
    """Entries, bytes and steps ahead of a run over the same archives, from their directories."""
    return unpack.work(_archives_and_odd(table))


@query(f"""SELECT {ARC} AS arc_path, printf('text/doc_%08d.bin', doc_id) AS path,
  ['unknown', 'bgi-audio', 'dsc-script', 'cbg-image', 'png-image', 'bgi-audio'][doc_id % 6 + 1] AS label,
  ['skipped', 'converted', 'converted', 'converted', 'skipped', 'error'][doc_id % 6 + 1] AS status,
  CASE doc_id % 6 WHEN 1 THEN printf('text/doc_%08d.bin.ogg', doc_id) WHEN 2 THEN printf('text/doc_%08d.bin.hazuki.txt', doc_id)
    WHEN 3 THEN printf('text/doc_%08d.bin.png', doc_id) END AS output_path, doc_id % 6 <> 3 AS retained FROM documents""")
def unpack_conversions(table):
    """What the full unpack does with each entry."""
    return unpack.unpack(fixtures.archives(table("documents"), mixed=True)).select("arc_path", "path", "label", "status", "output_path", "retained")


SIGNATURES = [
    (b"CompressedBG___\0", "cbg-image", ".png"), (b"DSC FORMAT 1.00\0", "dsc-script", ".hazuki.txt"), (b"BurikoCompiledScriptVer1.00\0", "compiled-script", ".hazuki.txt"),
    (b"@\0\0\0bw  ", "bgi-audio", ".ogg"), (b"\x89PNG\r\n\x1a\n", "png-image", ".png"), (b"\xff\xd8\xff", "jpeg-image", ".jpg"), (b"BM", "bmp-image", ".bmp"),
    (b"OggS", "ogg-audio", ".ogg"), (b"RIFF0000WAVE", "wav-audio", ".wav"), (b"RIFF0000", "unknown", ""), (b"#", "unknown", ""),
]


@query(f"""SELECT printf('%s/%d', t, id) AS path, {[s[1] for s in SIGNATURES]}[id % 11 + 1] AS label, {[s[2] for s in SIGNATURES]}[id % 11 + 1] AS suggested_extension
  FROM (SELECT 'doc' AS t, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages)""")
def asset_classify(table):
    """Documents and pages with a signature before them."""
    rows = table("documents").select(F.lit("doc").alias("t"), F.col("doc_id").alias("id"), "text").unionByName(table("pages").select(F.lit("page").alias("t"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    head = F.array(*[F.lit(s[0]) for s in SIGNATURES])[F.pmod("id", F.lit(11)).cast("int")]
    files = rows.select(F.format_string("%s/%d", "t", "id").alias("path"), F.concat(head, F.encode("text", "UTF-8")).alias("content"))
    return classify.classify(files).select("path", "label", "suggested_extension")


@query("""WITH p AS (SELECT page_id, ['', './/a' || chr(92), '../', '/', 'C:' || chr(92)][page_id % 5 + 1] || url AS raw FROM pages)
SELECT page_id, CASE WHEN page_id % 5 < 2 THEN array_to_string(list_filter(string_split(replace(raw, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') END AS path,
  [NULL, NULL, 'parent path', 'absolute path', 'absolute path'][page_id % 5 + 1] AS error FROM p""")
def path_guard(table):
    raw = F.concat(F.array(*[F.lit(x) for x in ("", ".//a\\", "../", "/", "C:\\")])[F.pmod("page_id", F.lit(5)).cast("int")], "url")
    return table("pages").select("page_id", archive.guard_path(raw).alias("g")).select("page_id", "g.path", "g.error")


@query("""WITH p AS (SELECT printf('%04d/part%d.arc', page_id, page_id % 40) AS path, 'part' || (page_id % 40) AS stem FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS k FROM p) SELECT path, CASE WHEN k = 1 THEN stem ELSE stem || '_' || k END AS output_dir FROM r""")
def unique_output_names(table):
    paths = table("pages").select(F.format_string("%04d/part%d.arc", "page_id", F.pmod("page_id", F.lit(40))).alias("path"))
    return classify.unique_names(paths)


@query("""SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '.Hazuki.TXT' ELSE '.png' END AS path, p_partkey % 2 = 0 AS is_project,
  CASE WHEN p_partkey % 2 = 0 THEN p_name END AS script, regexp_replace(p_name || CASE WHEN p_partkey % 2 = 0 THEN '.Hazuki.TXT' ELSE '.png' END, '[.][^./]*$', '') || '.cbg' AS encoded FROM part""")
def suffix_naming(table):
    rows = table("part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".Hazuki.TXT").otherwise(".png")).alias("path"))
    return rows.select("p_partkey", "path", classify.has_suffix("path", ".hazuki.txt").alias("is_project"), classify.script_of_project("path").alias("script"), classify.encoded_image_name("path").alias("encoded"))


@query("SELECT o_orderkey, o_orderkey % 4294967296 AS value, 0::BIGINT AS beyond FROM orders")
def le_u32_decode(table):
    data = F.concat(F.lit(b"\x01"), binary.le_u32_bytes("o_orderkey"))
    return table("orders").select("o_orderkey", binary.le_u32(data, 1).alias("value"), binary.le_u32(data, 2).alias("beyond"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey * 1000 + l_suppkey AS value,
  CASE WHEN l_partkey * 1000 + l_suppkey < 128 THEN 1 WHEN l_partkey * 1000 + l_suppkey < 16384 THEN 2 WHEN l_partkey * 1000 + l_suppkey < 2097152 THEN 3 WHEN l_partkey * 1000 + l_suppkey < 268435456 THEN 4 ELSE 5 END AS bytes FROM lineitem""")
def varint_roundtrip(table):
    @F.pandas_udf("value long, bytes int")
    def there_and_back(values: pd.Series) -> pd.DataFrame:
        packed, sizes = binary.put_varints(values.to_numpy())
        return pd.DataFrame({"value": binary.get_varints(packed).astype("int64"), "bytes": sizes.astype("int32")})

    return table("lineitem").select("l_orderkey", "l_linenumber", there_and_back(F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("v")).select("l_orderkey", "l_linenumber", "v.value", "v.bytes")


KEYS = """WITH RECURSIVE k(n_nationkey, i, key, byte) AS (
  SELECT n_nationkey, -1, (n_nationkey::BIGINT * 2654435761) % 4294967296, 0::BIGINT FROM nation
  UNION ALL SELECT n_nationkey, i + 1, ((h * 65536) + (l % 65536) + 1) % 4294967296, h % 256 FROM (
    SELECT n_nationkey, i, l, (20021 * (key // 65536) + 346 * key + l // 65536) % 65536 AS h FROM (SELECT *, 20021 * (key % 65536) AS l FROM k WHERE i < 63)))
SELECT n_nationkey, i AS position, byte::INT AS byte FROM k WHERE i >= 0"""


@query(KEYS)
def keystream(table):
    """The first 64 bytes of the stream of a key a nation."""

    def run(batches):
        for pdf in batches:
            keys = pdf["n_nationkey"].to_numpy()
            streams = binary.keystreams(keys.astype("int64") * 2654435761 % 2**32, 64)
            yield pd.DataFrame({"n_nationkey": keys.repeat(64), "position": np.tile(np.arange(64, dtype="int32"), len(keys)), "byte": streams.reshape(-1).astype("int32")})

    return table("nation").select("n_nationkey").mapInPandas(run, "n_nationkey int, position int, byte int")


@query("SELECT p_partkey, p_name, strlen(p_name)::INT AS size FROM part")
def keystream_roundtrip(table):
    @F.pandas_udf("p_name string, size int")
    def run(names: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = [(binary.decrypt(e, k).decode(), len(e)) for n, k in zip(names, keys, strict=True) for e in [binary.encrypt(n.encode(), k)]]
        return pd.DataFrame(out, columns=["p_name", "size"])

    return table("part").select("p_partkey", run("p_name", F.pmod("p_partkey", F.lit(2**32))).alias("r")).select("p_partkey", "r.*")


HEX_BYTES = "unnest([('0x' || substr(hex(encode(p_name)), 2 * i + 1, 2))::INT for i in range(strlen(p_name))])"


@query(f"SELECT b AS byte, count(*) AS n FROM (SELECT {HEX_BYTES} AS b FROM part) GROUP BY b")
def byte_histogram(table):
    rows = table("part").select(F.explode(binary.byte_values(F.encode("p_name", "UTF-8"))).alias("byte"))
    return rows.groupBy("byte").agg(F.count("*").alias("n"))


@query(f"""SELECT p_partkey, (sum(b) % 256)::INT AS byte_sum, bit_xor(b)::INT AS byte_xor FROM (SELECT p_partkey, {HEX_BYTES} AS b FROM part) GROUP BY p_partkey""")
def checksum_sum_xor(table):
    data = F.encode("p_name", "UTF-8")
    return table("part").select("p_partkey", binary.sum_checksum(data).alias("byte_sum"), binary.xor_checksum(data).alias("byte_xor"))


@query(r"SELECT doc_id, replace(replace(replace(replace(text || chr(92) || 'n' || chr(9), chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS escaped FROM documents")
def escape_text(table):
    return table("documents").select("doc_id", binary.escape(F.concat("text", F.lit("\\n\t"))).alias("escaped"))


@query("SELECT doc_id, text || chr(64976) || chr(92) || 'n' || chr(9) || chr(92) AS text FROM documents")
def unescape_text(table):
    return table("documents").select("doc_id", binary.unescape(binary.escape(F.concat("text", F.lit("\ufdd0\\n\t\\")))).alias("text"))


@query("SELECT doc_id, trim(chr(9) || ' ' || text || chr(13) || chr(10) || ' ', ' ' || chr(9) || chr(10) || chr(13)) AS trimmed FROM documents")
def trim_text(table):
    return table("documents").select("doc_id", binary.trim(F.concat(F.lit("\t "), "text", F.lit("\r\n "))).alias("trimmed"))


@query("SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents")
def split_lines(table):
    rows = table("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text"))
    return rows.select("doc_id", F.posexplode(binary.split_lines("text")).alias("line_no", "line"))


@query("SELECT user_id, string_agg(printf('%08X', event_id), ',' ORDER BY event_id) AS offsets, sum(event_id)::BIGINT AS total FROM events GROUP BY user_id")
def hex_offsets(table):
    rows = table("events").groupBy("user_id").agg(binary.hex_offsets(F.array_sort(F.collect_list("event_id"))).alias("offsets"))
    return rows.select("user_id", "offsets", F.aggregate(binary.parse_offsets("offsets"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


# Scripts: a conversation a script, a slot a turn; see fixtures.write_script for where the references are.
TURNS = """plain AS (SELECT conv_id, turn, array_to_string([CASE WHEN unicode(c) < 128 THEN c ELSE printf('{%04X}', unicode(c)) END for c in string_split(coalesce(text, ''), '')], '') AS text FROM conversations),
t AS (SELECT printf('conv_%06d', conv_id) AS script, conv_id % 2 AS v, text, row_number() OVER w - 1 AS k, first_value(text) OVER w AS speaker, count(*) OVER (PARTITION BY conv_id) AS n,
  coalesce(sum(strlen(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS text_offset
  FROM plain WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT script, 4 * (96 + k * CASE v WHEN 1 THEN 8 ELSE 16 END + 2) AS pos, text_offset,
        ['name', 'text', 'ruby_kanji', 'ruby_furigana', 'backlog', 'file', 'other'][k % 7 + 1] AS kind, text, speaker FROM t
      UNION ALL SELECT script, 4 * (96 + k * CASE v WHEN 1 THEN 8 ELSE 16 END + CASE v WHEN 1 THEN 0 ELSE 4 END), 0, 'other', speaker, speaker FROM t WHERE k % 7 = 1),
c AS (SELECT *, CASE kind WHEN 'name' THEN 7 WHEN 'text' THEN 6 WHEN 'ruby_kanji' THEN 5 WHEN 'ruby_furigana' THEN 4 WHEN 'backlog' THEN 3 WHEN 'file' THEN 2 ELSE 1 END AS rank,
        CASE kind WHEN 'name' THEN 'NAME' WHEN 'text' THEN 'TEXT 【' || speaker || '】' WHEN 'ruby_kanji' THEN 'TEXT RUBY KANJI' WHEN 'ruby_furigana' THEN 'TEXT RUBY FURIGANA'
          WHEN 'backlog' THEN 'TEXT BACKLOG' WHEN 'file' THEN 'FILE' ELSE 'OTHER' END AS comment FROM r),
e AS (SELECT script, (row_number() OVER (PARTITION BY script ORDER BY text_offset))::INT AS "index", * EXCLUDE (script) FROM (
        SELECT script, text_offset, arg_max(kind, rank * 1000000 - pos) AS kind, arg_max(comment, rank * 1000000 - pos) AS comment,
          string_agg(printf('%08X', pos), ',' ORDER BY pos) AS code_offsets, any_value(text) AS original_text FROM c GROUP BY script, text_offset))"""


@query(f"WITH {TURNS} SELECT script, k::INT AS slot_no, text_offset AS slot_offset, text FROM t")
def slot_split(table):
    return script.slots(fixtures.scripts(table("conversations"))).select("script", "slot_no", "slot_offset", F.decode("bytes", "UTF-8").alias("text"))


def _references(table, packed=False):
    scripts = fixtures.scripts(table("conversations"), packed)
    return script.references(script.words(scripts), script.slots(scripts))


@query(f"WITH {TURNS} SELECT script, pos, text_offset FROM r")
def string_refs(table):
    return _references(table).select("script", "pos", "text_offset")


@query(f"WITH {TURNS} SELECT script, pos, kind FROM r")
def ref_classify(table):
    return _references(table).select("script", "pos", "kind")


@query(f"""WITH {TURNS} SELECT script, "index", text_offset, kind, code_offsets, original_text FROM e""")
def entry_merge(table):
    return script.entries(fixtures.scripts(table("conversations"))).select("script", "index", "text_offset", "kind", binary.hex_offsets("code_offsets").alias("code_offsets"), "original_text")


@query(f"WITH {TURNS} SELECT script, text_offset, comment FROM e WHERE kind = 'text'")
def speaker_comment(table):
    return script.entries(fixtures.scripts(table("conversations"))).where("kind = 'text'").select("script", "text_offset", "comment")


def _projects(table):
    scripts = fixtures.scripts(table("conversations"))
    found = script.entries(scripts).withColumn("translation_text", F.when(F.col("index") % 2 == 1, F.concat(F.upper("original_text"), F.lit("!"))).otherwise(""))
    heads = scripts.select("script", F.lit("compiled").alias("container"), F.lit(932).alias("decode_cp"), F.lit(932).alias("encode_cp"))
    return scripts, projects.render(heads, found)


LF = "chr(10)"


@query(f"""WITH {TURNS} SELECT script, chr(65279) || '# BGI_HAZUKI_DSC_TEXT_V1' || {LF} || '# script_name=' || script || {LF} || '# container=compiled' || {LF} || '# decode_cp=932' || {LF} || '# encode_cp=932' || {LF} || {LF}
  || string_agg('[ENTRY]' || {LF} || printf('id=%04d', "index") || {LF} || 'kind=' || kind || {LF} || printf('text_offset=%08X', text_offset) || {LF} || 'code_offsets=' || code_offsets || {LF}
  || 'comment=' || replace(comment, {LF}, chr(92) || 'n') || {LF} || 'src=' || replace(original_text, {LF}, chr(92) || 'n') || {LF} || 'dst=' || CASE WHEN "index" % 2 = 1 THEN replace(upper(original_text), {LF}, chr(92) || 'n') || '!' ELSE '' END || {LF} || {LF}, '' ORDER BY "index") AS content
  FROM e GROUP BY script""")
def project_render(table):
    return _projects(table)[1].select("script", F.decode("content", "UTF-8").alias("content"))


@query(f"""WITH {TURNS} SELECT script, "index", text_offset, kind, comment, code_offsets, rtrim(original_text, ' ' || chr(9)) AS original_text,
  CASE WHEN "index" % 2 = 1 THEN upper(original_text) || '!' ELSE '' END AS translation_text FROM e""")
def project_parse(table):
    rows = projects.parse(_projects(table)[1])
    return rows.select("script", "index", "text_offset", "kind", "comment", binary.hex_offsets("code_offsets").alias("code_offsets"), "original_text", "translation_text")


PATCHED = """p AS (SELECT script, k::INT AS slot_no, CASE WHEN k % 2 = 0 THEN upper(text) || '!' ELSE text END AS text FROM t)"""


@query(f"""WITH {TURNS}, {PATCHED} SELECT script, slot_no, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY script ORDER BY slot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS slot_offset, text FROM p""")
def patch_relocate(table):
    """Slots of the scripts that their projects were applied to."""
    scripts, files = _projects(table)
    done = script.apply_project(scripts, projects.parse(files)).select("script", F.col("patched").alias("content"))
    return script.slots(done).select("script", "slot_no", "slot_offset", F.decode("bytes", "UTF-8").alias("text"))


@query(f"""WITH {TURNS}, {PATCHED}, m AS (SELECT script, slot_no, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY script ORDER BY slot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_offset FROM p)
SELECT t.script, 4 * (96 + k * CASE v WHEN 1 THEN 8 ELSE 16 END + 2) AS pos, 4 * (96 + n * CASE v WHEN 1 THEN 8 ELSE 16 END) + 4 + new_offset AS value FROM t JOIN m ON t.script = m.script AND t.k = m.slot_no""")
def patched_references(table):
    """Code words of the references to the moved slots, by joins and windows alone."""
    scripts, files = _projects(table)
    found, held = script.words(scripts), script.slots(scripts)
    moved = script.relocated(held, script.replacements(projects.parse(files)))
    rows = script.patched_words(found, moved).join(held.select("script", F.col("slot_offset").alias("old")).distinct(), "script", "left_semi")
    first = F.when(F.col("version") == "1.00", F.lit(8)).otherwise(16)
    return rows.where((F.col("word_no") >= 96) & (F.pmod(F.col("word_no") - 96, first) == 2)).where("value >= code_len").select("script", (F.col("word_no").cast("long") * 4).alias("pos"), "value")


def _through_dsc(docs: DataFrame) -> DataFrame:
    """The rows with d: size of their text when compressed and sha256 of what comes back; null for an empty text, which the format cannot hold."""
    packed = jvm.column(docs.sparkSession, "pack", F.when(F.col("text") != "", F.col("text").cast("binary")))
    if packed is None:
        return docs.withColumn("d", _through_python("text"))
    back = F.sha2(jvm.column(docs.sparkSession, "dsc", "packed"), 256)
    return docs.withColumn("packed", packed).withColumn("d", F.struct(F.octet_length("packed").cast("long").alias("size"), back.alias("sha256"))).drop("packed")


def _through_python(text: str) -> Column:
    """_through_dsc's d in a session without the JVM's codecs."""

    @F.pandas_udf("size long, sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        packed = dsc_many.encode([t.encode() for t in texts if t])
        done = iter([(len(p), hashlib.sha256(text).hexdigest()) for p, text in zip(packed, dsc_many.decode(packed), strict=True)])
        rows = [next(done) if t else (None, None) for t in texts]
        return pd.DataFrame({"size": pd.Series([r[0] for r in rows], dtype="Int64"), "sha256": pd.Series([r[1] for r in rows], dtype=object)})

    return run(text)


def _spread(docs: DataFrame) -> DataFrame:
    """Documents dealt out to all partitions: packing costs far more than their bytes."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@query("SELECT doc_id, CASE WHEN text <> '' THEN sha256(text) END AS sha256 FROM documents")
def dsc_roundtrip(table):
    return _through_dsc(_spread(table("documents").select("doc_id", "text"))).select("doc_id", "d.sha256")


@query("SELECT lang, count(*) AS docs, sum(strlen(coalesce(text, '')))::BIGINT AS plain, true AS smaller FROM documents GROUP BY lang")
def dsc_ratio(table):
    """Whether all of a language's documents take less room compressed (each with its own table of 512 bytes), and come back."""
    whole = F.coalesce(F.col("d.sha256") == F.sha2(F.col("text").cast("binary"), 256), F.coalesce("text", F.lit("")) == "")
    rows = _through_dsc(_spread(table("documents").select("lang", "text"))).select("lang", F.coalesce(F.octet_length("text"), F.lit(0)).alias("plain"), "d.size", whole.alias("whole"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("plain").alias("plain"), ((F.sum("size") < F.sum("plain")) & F.bool_and("whole")).alias("smaller"))


@query(f"""WITH {TURNS} SELECT script, "index", kind, original_text FROM e""")
def dsc_script_entries(table):
    """Entries of compressed scripts."""
    return script.entries(fixtures.scripts(table("conversations"), packed=True)).select("script", "index", "kind", "original_text")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM r GROUP BY user_id, event_type, g""")
def rle_runs(table):
    """Runs of one event type a user, by the difference of two row numbers."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return table("events").withColumn("g", k).groupBy("user_id", "event_type", "g").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).drop("g")


SAMPLES = "s AS (SELECT vec_id, [floor((x::DOUBLE + 1) * 127.5)::INT for x in embedding] AS a FROM embeddings)"


@query(f"WITH {SAMPLES} SELECT vec_id, array_to_string([CASE WHEN x < 120 THEN 0 ELSE x END for x in a], ',') AS samples FROM s")
def rle_roundtrip(table):
    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: list(image.from_run_lengths(image.run_lengths(bytes(0 if x < 120 else x for x in v)), len(v))))

    return fixtures.quantised(table("embeddings")).select("vec_id", F.array_join(run("samples"), ",").alias("samples"))


@query(f"""WITH {SAMPLES}, p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(a) AS px FROM s),
l AS (SELECT vec_id, i, px, lag(px, 1) OVER w AS le, lag(px, 8) OVER w AS up FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, ((px - CASE WHEN i = 0 THEN 0 WHEN i < 8 THEN le WHEN i % 8 = 0 THEN up ELSE (le + up) // 2 END + 256) % 256)::INT AS residual FROM l""")
def predictor_residual(table):
    """The forward predictor by two lags over exploded pixels."""
    rows = fixtures.quantised(table("embeddings")).select("vec_id", F.posexplode("samples").alias("i", "px"))
    order = Window.partitionBy("vec_id").orderBy("i")
    left, up, i = F.lag("px", 1).over(order), F.lag("px", 8).over(order), F.col("i")
    guess = F.when(i == 0, 0).when(i < 8, left).when(i % 8 == 0, up).otherwise(F.shiftright(left + up, 1))
    return rows.select("vec_id", F.floor(i / 8).cast("int").alias("y"), (i % 8).cast("int").alias("x"), F.pmod(F.col("px") - guess, F.lit(256)).cast("int").alias("residual"))


def _decoded_images(table):
    @F.pandas_udf("width int, height int, has_alpha boolean, pixels binary")
    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(i.width, i.height, i.has_alpha, i.pixels) for i in map(image.decode, files)], columns=["width", "height", "has_alpha", "pixels"])

    return fixtures.grey_images(fixtures.quantised(table("embeddings"))).select("vec_id", run("content").alias("i")).select("vec_id", "i.*")


@query(f"""WITH {SAMPLES} SELECT vec_id, 8 AS width, 8 AS height, array_to_string([repeat(printf('%02X', x), 3) || 'FF' for x in a], '') AS pixels FROM s""")
def cbg_roundtrip(table):
    return _decoded_images(table).select("vec_id", "width", "height", F.hex("pixels").alias("pixels"))


@query(f"WITH {SAMPLES} SELECT vec_id, false AS has_alpha, len(list_distinct(a))::INT AS levels, list_max(a)::INT AS highest FROM s")
def cbg_stats(table):
    rows = _decoded_images(table)
    values = binary.byte_values("pixels")
    grey = F.filter(values, lambda _, i: i % 4 == 0)
    return rows.select("vec_id", "has_alpha", F.size(F.array_distinct(grey)).alias("levels"), F.array_max(grey).alias("highest"))


@query(f"""WITH {SAMPLES}, p AS (SELECT vec_id, a, unnest(range(16)) AS x FROM s),
v AS (SELECT vec_id, x, a[3] AS alpha, CASE WHEN x < 8 THEN 128 + (trunc(8 * (a[1] - 128) + 3 * (a[4] % 41 - 20) * sqrt(2) * cos((2 * x + 1) * pi() / 16))::BIGINT >> 3) ELSE a[2] END AS y FROM p)
SELECT vec_id, x::INT AS x, greatest(0, least(255, y))::INT AS grey, alpha::INT AS alpha, 8 AS rows_alike FROM v""")
def cbg_v2_waves(table):
    """Version 2 images decoded: each column's grey and alpha, and how many of the 8 rows have them."""

    def run(batches):
        for batch in batches:
            for vec_id, content in zip(batch["vec_id"], batch["content"], strict=True):
                px = np.frombuffer(image.decode(bytes(content)).pixels, np.uint8).reshape(8, 16, 4)
                alike = (px == px[:1]).all(axis=2).sum(axis=0) * (px[0, :, 0] == px[0, :, 1]) * (px[0, :, 1] == px[0, :, 2])
                yield pd.DataFrame({"vec_id": vec_id, "x": np.arange(16), "grey": px[0, :, 0], "alpha": px[0, :, 3], "rows_alike": alike})

    return fixtures.wave_images(fixtures.quantised(table("embeddings"))).mapInPandas(run, "vec_id long, x int, grey int, alpha int, rows_alike int")


@query(f"""WITH {SAMPLES} SELECT vec_id, 8 AS width, 8 AS height, list_max(a) > 0 AS has_alpha, array_to_string([printf('%02X%02X%02X%02X', x, 255 - x, x, 255 - x) for x in a], '') AS pixels FROM s""")
def png_roundtrip(table):
    @F.pandas_udf("width int, height int, has_alpha boolean, pixels binary")
    def run(values: pd.Series) -> pd.DataFrame:
        back = [png.load(png.save(image.Image(8, 8, True, bytes(b for x in v for b in (x, 255 - x, x, 255 - x))))) for v in values]
        return pd.DataFrame([(i.width, i.height, i.has_alpha, i.pixels) for i in back], columns=["width", "height", "has_alpha", "pixels"])

    return fixtures.quantised(table("embeddings")).select("vec_id", run("samples").alias("i")).select("vec_id", "i.width", "i.height", "i.has_alpha", F.hex("i.pixels").alias("pixels"))


def _named(rows: DataFrame, view: str) -> SparkSession:
    rows.createOrReplaceTempView(view)
    registered.register(rows.sparkSession)
    return rows.sparkSession


@query(f"WITH {ENTRY} SELECT arc_path, entry_index, replace(path, '/', chr(92)) AS name, \"offset\", size FROM e")
def sql_archive_entries(table):
    """The listing by the table function's SQL name."""
    return _named(fixtures.archives(table("documents")), "archives_of_documents").sql("SELECT a.arc_path, e.entry_index, e.name, e.offset, e.size FROM archives_of_documents a, LATERAL archive_entries(a.content) e")


@query(f"WITH {TURNS} SELECT script, k::INT AS slot_no, text_offset AS slot_offset, text FROM t")
def sql_script_slots(table):
    """Slots of compressed scripts by the table function's SQL name."""
    return _named(fixtures.scripts(table("conversations"), packed=True), "scripts_of_conversations").sql("SELECT s.script, x.slot_no, x.slot_offset, codepage_decode(x.bytes, 932) AS text FROM scripts_of_conversations s, LATERAL script_slots(s.content) x")


@query("SELECT p_partkey, p_name AS text, true AS smaller_than_a_kilobyte FROM part")
def sql_codecs(table):
    """Names of parts through the script codec and the code page by their SQL names."""
    return _named(table("part"), "part_names").sql("""SELECT p_partkey, codepage_decode(dsc_decode(c.value).value, 932) AS text, octet_length(c.value) < 1024 AS smaller_than_a_kilobyte
      FROM (SELECT p_partkey, dsc_encode(codepage_encode(p_name, 932).value) AS c FROM part_names)""")


@query("""SELECT printf('%08d.%s', doc_id, ['dsc', 'png', 'bin', 'bw', 'bw', 'txt'][doc_id % 6 + 1]) AS path, ['dsc-script', 'png-image', 'compiled-script', 'bgi-audio', 'bgi-audio', 'unknown'][doc_id % 6 + 1] AS label,
  ['error', 'skipped', 'error', 'error', 'converted', 'skipped'][doc_id % 6 + 1] AS status, CASE WHEN doc_id % 6 = 4 THEN coalesce(text, '') END AS output FROM documents""")
def asset_job(table):
    """Loose files by their first bytes: damaged scripts and audio are errors of their own, sound audio gives its payload."""
    return tools.convert_assets(_loose(table)).select("path", "label", "status", F.decode("output", "UTF-8").alias("output"))


@query("""SELECT printf('%08d.%s', doc_id, ['dsc', 'png', 'bin', 'bw', 'bw', 'txt'][doc_id % 6 + 1]) AS path, CASE WHEN doc_id % 6 = 1 THEN 'error' ELSE 'skipped' END AS status FROM documents""")
def image_job_errors(table):
    """Damaged PNG files fail alone."""
    return tools.convert_images(_loose(table)).select("path", "status")


def _loose(table) -> DataFrame:
    text, turn = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.pmod("doc_id", F.lit(6)).cast("int")
    # a script too short, a PNG without chunks, a header beyond the code, audio beyond its end and whole, and none of these
    heads = [b"DSC FORMAT 1.00\0", b"\x89PNG\r\n\x1a\n", b"BurikoCompiledScriptVer1.00\0\xff\xff\xff\x7f"]
    audio = fixtures.audio_column(text)
    cut = F.substring(audio, F.lit(1), F.octet_length(audio) - 1)
    content = F.when(turn == 0, F.lit(heads[0])).when(turn == 1, F.concat(F.lit(heads[1]), F.lit(b"\0\0"), text)).when(turn == 2, F.lit(heads[2])).when(turn == 3, F.when(F.octet_length(text) > 0, cut).otherwise(F.substring(audio, 1, 11)))
    name = F.format_string("%08d.%s", "doc_id", F.array(*map(F.lit, ("dsc", "png", "bin", "bw", "bw", "txt")))[turn])
    return table("documents").select(name.alias("path"), content.when(turn == 4, audio).otherwise(F.concat(F.lit(b"no "), text)).alias("content"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id::INT END AS entry, doc_id % 2 = 1 AS failed FROM documents")
def project_errors(table):
    """Projects of which every second has a number out of range: each fails alone."""
    index = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.lit(99999999999))
    text = F.concat(F.lit("# BGI_HAZUKI_DSC_TEXT_V1\n\n[ENTRY]\nid="), index.cast("string"), F.lit("\nsrc=a\n"))
    rows = projects.parse(table("documents").select(F.col("doc_id").cast("string").alias("script"), F.encode(text, "UTF-8").alias("content")))
    return rows.select(F.col("script").cast("long").alias("doc_id"), F.col("index").alias("entry"), F.col("error").isNotNull().alias("failed"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 END AS entry, doc_id % 2 = 1 AS failed FROM documents")
def script_errors(table):
    """Scripts of which every second is damaged: each fails alone."""

    def run(batches):
        for pdf in batches:
            made = [fixtures.write_script("1.00", [b"text"], ["name"]) if d % 2 == 0 else b"DSC FORMAT 1.00\0 too short" for d in pdf["doc_id"]]
            yield pd.DataFrame({"script": pdf["doc_id"].astype(str), "content": made})

    rows = script.entries(table("documents").select("doc_id").mapInPandas(run, "script string, content binary"))
    return rows.select(F.col("script").cast("long").alias("doc_id"), F.col("index").alias("entry"), F.col("error").isNotNull().alias("failed"))


@query("SELECT doc_id, text, strlen(text)::INT AS size FROM documents")
def audio_payload(table):
    """The payload of audio containers, in column functions alone."""
    rows = table("documents").select("doc_id", classify.audio_payload(fixtures.audio_column(F.encode("text", "UTF-8"))).alias("a"))
    return rows.select("doc_id", F.decode("a.payload", "UTF-8").alias("text"), F.octet_length("a.payload").alias("size"))


VECTORS = [(-1, b"\x82\xa0", "あ"), (-2, b"\x81\xad", "&#81AD"), (-3, b"\x81", "&#0081"), (-4, b"A\x82\xa0\x81\xadB", "Aあ&#81ADB"), (-5, b"\xb1", "ｱ")]


@query(f"SELECT p_partkey::BIGINT AS id, p_name AS text FROM part UNION ALL SELECT * FROM (VALUES {', '.join(f'({i}, {t!r})' for i, _, t in VECTORS)})")
def codepage_decode(table):
    part = table("part")
    rows = part.select(F.col("p_partkey").alias("id"), F.encode("p_name", "US-ASCII").alias("data"))
    fixed = part.sparkSession.createDataFrame([(i, bytearray(d)) for i, d, _ in VECTORS], "id long, data binary")
    return rows.unionByName(fixed).select("id", codepage.decoded("data").alias("text"))


@query("""SELECT regexp_matches(text, '[^\\x00-\\x7F]') AS failed, count(*) AS n, sum(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 0 ELSE strlen(text) END)::BIGINT AS bytes FROM documents GROUP BY 1""")
def error_isolation(table):
    """Encoding errors as a column: rows that the code page lacks fail alone."""
    rows = table("documents").select(codepage.encoded("text").alias("e"))
    return rows.groupBy(F.col("e.error").isNotNull().alias("failed")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("e.value"), F.lit(0))).cast("long").alias("bytes"))
