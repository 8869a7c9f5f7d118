"""Queries over names: versions, labels, safety, volume names, attributes, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..plans.catalog import Catalog
from ..sources.tables import blocks, members, read

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

_SPELLINGS = "element_at(array('RAR-5.0', 'rar4', 'Rar_7', 'rar 13', 'rar14', 'RAR1.5', 'rar20', 'rar2.9', 'rar30', 'zip'), CAST(doc_id % 10 AS INT) + 1)"
_SPELLINGS_D = "(['RAR-5.0', 'rar4', 'Rar_7', 'rar 13', 'rar14', 'RAR1.5', 'rar20', 'rar2.9', 'rar30', 'zip'])[(doc_id % 10 + 1)::INT]"
_PLAIN_D = f"regexp_replace(lower({_SPELLINGS_D}), '[-_. ]', '', 'g')"
_VERSION_D = f"CASE {_PLAIN_D} WHEN 'rar4' THEN 'rar40' WHEN 'rar5' THEN 'rar50' WHEN 'rar7' THEN 'rar70' ELSE CASE WHEN {_PLAIN_D} IN ('rar13','rar14','rar15','rar20','rar29','rar30','rar40','rar50','rar70') THEN {_PLAIN_D} END END"


@CATALOG.add("f22_version_from_name", f"SELECT doc_id, {_VERSION_D} AS version FROM documents")
def f22(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.version_from_name(F.expr(_SPELLINGS)).alias("version"))


@CATALOG.add("f23_version_family", f"WITH v AS (SELECT {_VERSION_D} AS version FROM documents) SELECT version, CASE WHEN version IN ('rar13','rar14') THEN '1.3' WHEN version IN ('rar50','rar70') THEN '5+' ELSE '1.5-4' END AS family, count(*) AS n FROM v WHERE version IS NOT NULL GROUP BY ALL")
def f23(spark, folder):
    v = read(spark, folder, "documents").select(N.version_from_name(F.expr(_SPELLINGS)).alias("version")).where("version is not null")
    return v.groupBy("version", N.family(F.col("version")).alias("family")).agg(F.count("*").alias("n"))


_ENC = "element_at(array('CP437', 'cp850', 'Cp852', 'cp866', 'windows-1251', 'CP1251', 'cp1252', 'Windows-1252', 'UTF8', 'utf-8', 'koi8'), CAST(doc_id % 11 AS INT) + 1)"
_ENC_D = "lower((['CP437', 'cp850', 'Cp852', 'cp866', 'windows-1251', 'CP1251', 'cp1252', 'Windows-1252', 'UTF8', 'utf-8', 'koi8'])[(doc_id % 11 + 1)::INT])"


@CATALOG.add("f02_encoding_from_name", f"SELECT doc_id, CASE {_ENC_D} WHEN 'cp1251' THEN 'windows-1251' WHEN 'cp1252' THEN 'windows-1252' WHEN 'utf8' THEN 'utf-8' WHEN 'koi8' THEN NULL ELSE {_ENC_D} END AS encoding FROM documents")
def f02(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.encoding_from_name(F.expr(_ENC)).alias("encoding"))


@CATALOG.add("f03_unicode_name_first", "SELECT member_index, CASE WHEN (flags & 128) <> 0 THEN name ELSE upper(name) END AS shown FROM {members}")
def f03(spark, folder):
    """A name stored as Unicode is used as it is; only others go through the chosen encoding (upper case stands for it)."""
    return members(spark, folder).select("member_index", F.when(F.expr("flags & 128") != 0, F.col("name")).otherwise(F.upper("name")).alias("shown"))


@CATALOG.add("f25_service_label", "SELECT label, CASE label WHEN 'QO' THEN 'quick-open' WHEN 'RR' THEN 'recovery' WHEN 'CMT' THEN 'comment' WHEN 'ACL' THEN 'acl' WHEN 'STM' THEN 'stream' ELSE label END AS shown, count(*) AS n FROM {blocks} GROUP BY ALL")
def f25(spark, folder):
    return blocks(spark, folder).groupBy("label", N.service_label(F.col("label")).alias("shown")).agg(F.count("*").alias("n"))


_RAW = "CASE page_id % 9 WHEN 0 THEN '/abs/' || url WHEN 1 THEN 'c:' || url WHEN 2 THEN 'a/../' || url WHEN 3 THEN 'a//./b/' || url WHEN 4 THEN '././' WHEN 5 THEN replace(url, '/', chr(92)) WHEN 6 THEN 'x..y/' || url WHEN 7 THEN '' ELSE url END"


@CATALOG.add("p21_path_safety", f"WITH p AS (SELECT page_id, {_RAW} AS raw FROM pages) SELECT page_id, raw, (regexp_matches(raw, '^[/\\\\]') OR regexp_matches(raw, '^[A-Za-z]:') OR list_contains(regexp_split_to_array(raw, '[/\\\\]'), '..')) AS unsafe, len(list_filter(regexp_split_to_array(raw, '[/\\\\]'), lambda x: x <> '' AND x <> '.')) = 0 AS empty FROM p")
def p21(spark, folder):
    p = read(spark, folder, "pages").select("page_id", F.expr(_RAW).alias("raw"))
    return p.select("page_id", "raw", N.is_unsafe(F.col("raw")).alias("unsafe"), N.is_empty_path(F.col("raw")).alias("empty"))


@CATALOG.add("f08_relative_path", f"WITH p AS (SELECT page_id, {_RAW} AS raw FROM pages), q AS (SELECT *, string_split(raw, '/') AS parts FROM p) SELECT page_id, CASE WHEN raw LIKE '/%' OR regexp_matches(raw, '^[A-Za-z]:') OR list_contains(parts, '..') OR len(list_filter(parts, lambda x: x <> '' AND x <> '.')) = 0 THEN NULL ELSE array_to_string(list_filter(parts, lambda x: x <> '' AND x <> '.'), '/') END AS path FROM q")
def f08(spark, folder):
    return read(spark, folder, "pages").select("page_id", N.relative_path(F.expr(_RAW)).alias("path"))


@CATALOG.add("f10_entry_name_valid", f"WITH p AS (SELECT page_id, {_RAW} AS raw FROM pages) SELECT page_id, NOT (regexp_matches(raw, '^[/\\\\]') OR regexp_matches(raw, '^[A-Za-z]:') OR list_contains(regexp_split_to_array(raw, '[/\\\\]'), '..')) AND len(list_filter(regexp_split_to_array(raw, '[/\\\\]'), lambda x: x <> '' AND x <> '.')) > 0 AS valid FROM p")
def f10(spark, folder):
    return read(spark, folder, "pages").select("page_id", F.expr(_RAW).alias("raw")).select("page_id", (~N.is_unsafe(F.col("raw")) & ~N.is_empty_path(F.col("raw"))).alias("valid"))


@CATALOG.add("k06_flat_names", "SELECT archive, base, count(*) AS claimants, count(*) > 1 AS refused FROM (SELECT archive, list_extract(string_split(name, '/'), -1) AS base FROM {members}) GROUP BY ALL")
def k06(spark, folder):
    m = members(spark, folder).select("archive", N.flat_name(F.col("name")).alias("base"))
    return m.groupBy("archive", "base").agg(F.count("*").alias("claimants"), (F.count("*") > 1).alias("refused"))


@CATALOG.add("f26_numbered_name", "SELECT member_index, CASE member_index % 3 WHEN 0 THEN archive || '/' || lang_ || '/f' || n97 || '(' || n || ').txt' WHEN 1 THEN archive || '/noext(' || n || ')' ELSE '.hidden' || '(' || n || ')' END AS numbered FROM (SELECT member_index, archive, split_part(name, '/', 2) AS lang_, member_index % 97 AS n97, member_index % 5 + 1 AS n FROM {members})")
def f26(spark, folder):
    m = members(spark, folder).selectExpr("member_index", "CASE member_index % 3 WHEN 0 THEN name WHEN 1 THEN concat(archive, '/noext') ELSE '.hidden' END AS name", "member_index % 5 + 1 AS n")
    return m.select("member_index", N.numbered(F.col("name"), F.col("n")).alias("numbered"))


_FIRST = "CASE doc_id % 5 WHEN 0 THEN concat('dir/s', doc_id % 9, '.part01.rar') WHEN 1 THEN concat('s', doc_id % 9, '.part1.EXE') WHEN 2 THEN concat('s', doc_id % 9, '.RAR') WHEN 3 THEN concat('a.b/s', doc_id % 9, '.rar') ELSE concat('s', doc_id % 9, '.part001.sfx') END"


@CATALOG.add("f14_old_style_name", f"SELECT doc_id, CASE WHEN i = 0 THEN f WHEN (i - 1) // 100 <= 8 THEN regexp_replace(f, '\\.[^./]*$', '') || '.' || chr((CASE WHEN regexp_matches(f, '\\.[A-Z][^./]*$') THEN 82 ELSE 114 END + (i - 1) // 100)::INT) || lpad(((i - 1) % 100)::VARCHAR, 2, '0') END AS volume FROM (SELECT doc_id, {_FIRST} AS f, (doc_id * 13) % 1100 AS i FROM documents)")
def f14(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.old_style(F.expr(_FIRST), F.expr("(doc_id * 13) % 1100")).alias("volume"))


_EXT = "concat(element_at(array('r', 'S', 'z', 'q', 'x', 'R'), CAST(doc_id % 6 AS INT) + 1), lpad(CAST(doc_id % 120 AS STRING), 2, '0'))"
_EXT_D = "(['r', 'S', 'z', 'q', 'x', 'R'])[(doc_id % 6 + 1)::INT] || CASE WHEN doc_id % 120 > 99 THEN left((doc_id % 120)::VARCHAR, 2) ELSE lpad((doc_id % 120)::VARCHAR, 2, '0') END"


@CATALOG.add("f15_old_style_index", f"SELECT doc_id, CASE WHEN regexp_matches(lower(e), '^[r-z][0-9][0-9]$') THEN 1 + (ascii(lower(e)) - 114) * 100 + substr(e, 2, 2)::INT END AS volume_index FROM (SELECT doc_id, {_EXT_D} AS e FROM documents)")
def f15(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.old_style_index(F.expr(_EXT)).alias("volume_index"))


@CATALOG.add("f16_part_style_name", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'dir/s' || doc_id % 9 || '.part' || lpad(i, greatest(2, len(i))::INT, '0') || '.rar' WHEN 1 THEN 's' || doc_id % 9 || '.part' || lpad(i, greatest(1, len(i))::INT, '0') || '.RAR' WHEN 2 THEN 's' || doc_id % 9 || '.part' || lpad(i, greatest(3, len(i))::INT, '0') || '.RAR' WHEN 3 THEN 'a.b/s' || doc_id % 9 || '.part' || lpad(i, greatest(3, len(i))::INT, '0') || '.rar' ELSE 's' || doc_id % 9 || '.part' || lpad(i, greatest(3, len(i))::INT, '0') || '.rar' END AS volume FROM (SELECT doc_id, ((doc_id * 7) % 1500 + 1)::VARCHAR AS i FROM documents)")
def f16(spark, folder):
    first = F.expr(_FIRST)
    return read(spark, folder, "documents").select("doc_id", N.part_style(first, F.expr("(doc_id * 7) % 1500"), F.coalesce(N.part_width(first), F.lit(3))).alias("volume"))


@CATALOG.add("f17_part_width", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 4 THEN 3 END AS width FROM documents")
def f17(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.part_width(F.expr(_FIRST)).alias("width"))


@CATALOG.add("f18_sfx_extension", "SELECT doc_id, doc_id % 4 IN (0, 1) AS sfx FROM documents")
def f18(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.is_sfx_extension(F.expr("element_at(array('.EXE', '.Sfx', '.rar', 'exe'), CAST(doc_id % 4 AS INT) + 1)")).alias("sfx"))


_VOLUME = "CASE doc_id % 6 WHEN 0 THEN concat('set', doc_id % 3, '.part', doc_id % 20 + 1, '.rar') WHEN 1 THEN concat('old', doc_id % 3, '.r', lpad(CAST(doc_id % 40 AS STRING), 2, '0')) WHEN 2 THEN concat('old', doc_id % 3, '.RAR') WHEN 3 THEN concat('old', doc_id % 3, '.s', lpad(CAST(doc_id % 100 AS STRING), 2, '0')) WHEN 4 THEN 'readme.txt' ELSE concat('Set', doc_id % 3, '.PART0', doc_id % 9 + 1, '.RAR') END"
_KEYS_D = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'part:set' || doc_id % 3 WHEN 1 THEN 'old:old' || doc_id % 3 WHEN 2 THEN 'old:old' || doc_id % 3 WHEN 3 THEN 'old:old' || doc_id % 3 WHEN 5 THEN 'part:Set' || doc_id % 3 END AS set_key, CASE doc_id % 6 WHEN 0 THEN doc_id % 20 WHEN 1 THEN doc_id % 40 + 1 WHEN 2 THEN 0 WHEN 3 THEN 101 + doc_id % 100 WHEN 5 THEN doc_id % 9 END AS position FROM documents"


@CATALOG.add("f19_set_and_sort_key", _KEYS_D)
def f19(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.set_key(F.expr(_VOLUME)).alias("set_key"), N.set_position(F.expr(_VOLUME)).alias("position"))


@CATALOG.add("s23_volume_discovery", f"WITH k AS ({_KEYS_D}), u AS (SELECT DISTINCT set_key, position FROM k WHERE set_key IS NOT NULL), g AS (SELECT *, count(*) OVER (PARTITION BY set_key ORDER BY position) - 1 AS before FROM u), m AS (SELECT *, max(CASE WHEN position <= 100 AND set_key LIKE 'old:%' THEN position END) OVER (PARTITION BY set_key) AS last_r FROM g) SELECT set_key, position FROM m WHERE set_key NOT LIKE 'old:%' OR position <= 100 OR (position - before = 0)")
def s23(spark, folder):
    """Volumes of each set by position; past .r99, names .s00 and on belong only while they number on from the start without a gap."""
    from pyspark.sql import Window

    v = F.expr(_VOLUME)
    k = read(spark, folder, "documents").select(N.set_key(v).alias("set_key"), N.set_position(v).alias("position")).where("set_key is not null").distinct()
    k = k.withColumn("before", F.row_number().over(Window.partitionBy("set_key").orderBy("position")) - 1)
    return k.where(~F.col("set_key").startswith("old:") | (F.col("position") <= 100) | (F.col("position") == F.col("before"))).select("set_key", "position")


@CATALOG.add("t01_volume_path_sort", f"SELECT row_number() OVER (ORDER BY position NULLS FIRST, path, doc_id) AS place, path FROM (SELECT doc_id, position, CASE doc_id % 6 WHEN 0 THEN 'set' || doc_id % 3 || '.part' || doc_id % 20 + 1 || '.rar' WHEN 1 THEN 'old' || doc_id % 3 || '.r' || lpad((doc_id % 40)::VARCHAR, 2, '0') WHEN 2 THEN 'old' || doc_id % 3 || '.RAR' WHEN 3 THEN 'old' || doc_id % 3 || '.s' || lpad((doc_id % 100)::VARCHAR, 2, '0') WHEN 4 THEN 'readme.txt' ELSE 'Set' || doc_id % 3 || '.PART0' || doc_id % 9 + 1 || '.RAR' END AS path FROM ({_KEYS_D}))".replace("doc_id % 20 + 1", "(doc_id % 20 + 1)").replace("doc_id % 9 + 1", "(doc_id % 9 + 1)"))
def t01(spark, folder):
    """Volume paths by number, then by path; the place is given by a range sort with counted partitions, not by one task."""
    v = F.expr(_VOLUME)
    d = read(spark, folder, "documents").select("doc_id", v.alias("path"), N.set_position(v).alias("position"))
    from .ordering import ranked

    return ranked(d, [F.col("position").asc_nulls_first(), F.col("path"), F.col("doc_id")], "place").select("place", "path")


@CATALOG.add("f20_attribute_string", "SELECT member_index, CASE WHEN host_os = 3 THEN (CASE file_attr & 61440 WHEN 16384 THEN 'd' WHEN 40960 THEN 'l' ELSE '-' END) || (CASE WHEN file_attr & 256 <> 0 THEN 'r' ELSE '-' END) || (CASE WHEN file_attr & 128 <> 0 THEN 'w' ELSE '-' END) || (CASE WHEN file_attr & 64 <> 0 THEN 'x' ELSE '-' END) || (CASE WHEN file_attr & 32 <> 0 THEN 'r' ELSE '-' END) || (CASE WHEN file_attr & 16 <> 0 THEN 'w' ELSE '-' END) || (CASE WHEN file_attr & 8 <> 0 THEN 'x' ELSE '-' END) || (CASE WHEN file_attr & 4 <> 0 THEN 'r' ELSE '-' END) || (CASE WHEN file_attr & 2 <> 0 THEN 'w' ELSE '-' END) || (CASE WHEN file_attr & 1 <> 0 THEN 'x' ELSE '-' END) ELSE (CASE WHEN file_attr & 16 <> 0 THEN 'D' ELSE '.' END) || (CASE WHEN file_attr & 1 <> 0 THEN 'R' ELSE '.' END) || (CASE WHEN file_attr & 2 <> 0 THEN 'H' ELSE '.' END) || (CASE WHEN file_attr & 4 <> 0 THEN 'S' ELSE '.' END) || (CASE WHEN file_attr & 32 <> 0 THEN 'A' ELSE '.' END) END AS attributes FROM {members}")
def f20(spark, folder):
    return members(spark, folder).select("member_index", N.attribute_string(F.col("file_attr"), F.col("host_os") == 3).alias("attributes"))


@CATALOG.add("f21_attribute_source", "SELECT member_index, fam, CASE WHEN fam = '1.3' THEN 'dos' WHEN fam = '5+' THEN (CASE host_os WHEN 0 THEN 'dos' WHEN 1 THEN 'unix' ELSE 'unknown' END) ELSE (CASE WHEN host_os IN (0,1,2,4) THEN 'dos' WHEN host_os IN (3,5) THEN 'unix' ELSE 'unknown' END) END AS source FROM (SELECT member_index, host_os, (['1.3','1.5-4','5+'])[(member_index % 3 + 1)::INT] AS fam FROM {members})")
def f21(spark, folder):
    m = members(spark, folder).selectExpr("member_index", "host_os", "element_at(array('1.3','1.5-4','5+'), CAST(member_index % 3 AS INT) + 1) AS fam")
    return m.select("member_index", "fam", N.attribute_source(F.col("fam"), F.col("host_os")).alias("source"))


@CATALOG.add("f24_parse_size", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN doc_id WHEN 1 THEN doc_id * 1024 WHEN 2 THEN doc_id * 1048576 WHEN 3 THEN doc_id * 1073741824 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE NULL END AS bytes FROM documents")
def f24(spark, folder):
    text = F.expr("CASE doc_id % 7 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN concat(' ', doc_id, 'k') WHEN 2 THEN concat(doc_id, 'M ') WHEN 3 THEN concat(doc_id, 'g') WHEN 4 THEN 'k' WHEN 5 THEN concat(doc_id, 'x') ELSE concat('9223372036854775', lpad(CAST(doc_id % 800 AS STRING), 3, '0'), 'g') END")
    return read(spark, folder, "documents").select("doc_id", N.parse_size(text).alias("bytes"))


@CATALOG.add("f27_clamp_password", "SELECT doc_id, substring(text, 1, 127) AS password FROM documents")
def f27(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.clamp_password(F.col("text")).alias("password"))


@CATALOG.add("f28_volume_path", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'v' || doc_id % 9 || '.part' || lpad((i + 1)::VARCHAR, greatest(2, len((i + 1)::VARCHAR))::INT, '0') || '.rar' WHEN i = 0 THEN 'v' || doc_id % 9 || '.rar' WHEN i > 900 THEN NULL ELSE 'v' || doc_id % 9 || '.' || chr((114 + (i - 1) // 100)::INT) || lpad(((i - 1) % 100)::VARCHAR, 2, '0') END AS path FROM (SELECT doc_id, (doc_id * 11) % 950 AS i FROM documents)")
def f28(spark, folder):
    """The naming of a set picks the rule: part style, or old style."""
    d = read(spark, folder, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN concat('v', doc_id % 9, '.part01.rar') ELSE concat('v', doc_id % 9, '.rar') END AS first", "(doc_id * 11) % 950 AS i")
    return d.select("doc_id", F.when(F.expr("doc_id % 2 = 0"), N.part_style(F.col("first"), F.col("i"), N.part_width(F.col("first")))).otherwise(N.old_style(F.col("first"), F.col("i"))).alias("path"))


@CATALOG.add("f13_display_text", "SELECT doc_id, replace(replace(replace(replace(text, chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r'), chr(27), '\\u{1b}') AS shown FROM documents")
def f13(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.display_text(F.col("text")).alias("shown"))


@CATALOG.add("f12_comment_text", "SELECT doc_id, replace(regexp_replace(text || chr(27) || chr(10) || chr(10), '[\\n\\r]+$', ''), chr(27), '\\x1b') AS shown FROM documents")
def f12(spark, folder):
    return read(spark, folder, "documents").select("doc_id", N.comment_text(F.concat("text", F.lit("\x1b\n\n"))).alias("shown"))


MASKS = ["src1*/en/*", "f1?.txt", "*/de/f9*"]


@CATALOG.add("p06_name_masks", "SELECT member_index, name FROM {members} WHERE name LIKE 'src1%/en/%' OR name LIKE '%/de/f9%' OR list_extract(string_split(name, '/'), -1) LIKE 'f1_.txt'")
def p06(spark, folder):
    return members(spark, folder).where(N.selected(F.col("name"), MASKS)).select("member_index", "name")


@CATALOG.add("p07_wildcard", "SELECT member_index, name LIKE 'src%\\_%' ESCAPE '\\' OR name LIKE '%/e_/f%' AS matches FROM {members}")
def p07(spark, folder):
    return members(spark, folder).select("member_index", (F.col("name").like(N.like_mask("src*_*")) | F.col("name").like(N.like_mask("*/e?/f*"))).alias("matches"))


@CATALOG.add("j05_decoded_name_lookup", "SELECT lower(name) AS decoded, max(member_index) AS member_index, count(*) AS holders, count(*) > 1 AS ambiguous FROM {members} GROUP BY lower(name)")
def j05(spark, folder):
    """A decoded name that several stored names share is ambiguous and must be refused."""
    return members(spark, folder).groupBy(F.lower("name").alias("decoded")).agg(F.max("member_index").alias("member_index"), F.count("*").alias("holders"), (F.count("*") > 1).alias("ambiguous"))
