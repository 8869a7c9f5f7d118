"""Listings and predicates over members and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..sources.tables import members
from .running import running

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

sql = CATALOG.sql

sql("p01_terse_listing", "SELECT archive, member_index, unpacked_size, packed_size, CASE WHEN is_redirection THEN concat(name, ' -> ', link_target) ELSE name END AS shown FROM {members}")
sql(
    "p02_verbose_listing_5",
    "SELECT member_index, CASE WHEN is_stored THEN 'store' ELSE concat('m', member_index % 5 + 1) END AS method, is_solid, lower(hex(file_attr)) AS attr, lower(hex(flags)) AS flags FROM {members}",
    "SELECT member_index, CASE WHEN is_stored THEN 'store' ELSE concat('m', member_index % 5 + 1) END AS method, is_solid, lower(hex(file_attr)) AS attr, lower(hex(flags)) AS flags FROM {members}",
)
sql("p03_verbose_listing_4", "SELECT archive_id, line, part, supp, kind, label, flags, concat(kind, ':', label) AS shown FROM {blocks}")
sql("p04_verbose_listing_1", "SELECT member_index, name, packed_size, unpacked_size, file_attr % 256 AS attr, flags % 32 AS flags, CASE WHEN flags & 8 <> 0 THEN 'comment' ELSE '' END AS comment FROM {members}")
sql(
    "p05_listing_with_total",
    "SELECT archive, name, sum(unpacked_size) AS size, count(*) AS n FROM {members} GROUP BY GROUPING SETS ((archive, name), (archive))",
    "SELECT archive, name, sum(unpacked_size)::BIGINT AS size, count(*) AS n FROM {members} GROUP BY GROUPING SETS ((archive, name), (archive))",
)
sql("p08_directories", "SELECT member_index, CASE WHEN host_os = 3 THEN file_attr & 61440 = 16384 ELSE file_attr & 16 <> 0 END AS is_dir FROM {members}")
sql("p09_redirections", "SELECT member_index, name, link_target FROM {members} WHERE is_redirection AND NOT is_directory")
sql("p10_split_flags", "SELECT member_index, flags & 1 <> 0 AS split_before, flags & 2 <> 0 AS split_after FROM {members}")
sql("p11_solid", "SELECT m.archive, m.member_index, m.is_solid OR a.solid AS solid FROM {members} m JOIN (SELECT archive, bool_or(flags & 256 <> 0) AS solid FROM {members} GROUP BY archive) a ON m.archive = a.archive")
sql("p12_stored_encrypted", "SELECT is_stored, is_encrypted, count(*) AS n FROM {members} GROUP BY is_stored, is_encrypted")
sql("p13_supported_links", "SELECT member_index, link_type BETWEEN 1 AND 5 AND link_flags IN (0, 1) AND (link_type < 4 OR link_flags = 0) AND length(link_target) > 0 AS supported FROM {members}")
sql("p14_extraction_selector", "SELECT m.archive, m.member_index FROM {members} m JOIN (SELECT archive, min(CASE WHEN is_damaged AND is_encrypted THEN member_index END) AS stop FROM {members} GROUP BY archive) s ON m.archive = s.archive WHERE (stop IS NULL OR m.member_index < stop) AND NOT m.is_directory".replace("JOIN (SELECT archive", "JOIN (SELECT archive"))
sql("p16_needs_password", "SELECT archive, bool_or(is_encrypted) AS needs_password, count(*) AS members FROM {members} GROUP BY archive")
sql("p17_first_volume", "SELECT set_id, volume, CASE WHEN packed_size % 10 = 0 THEN NULL ELSE volume = 0 END AS is_first FROM {fragments}")
sql("p22_safe_links", "SELECT page_id, depth_min >= 0 AS inside FROM (SELECT page_id, array_min(transform(sequence(1, size(parts)), i -> aggregate(slice(parts, 1, i), CAST(2 AS INT), (d, p) -> d + CASE WHEN p = '..' THEN -1 WHEN p IN ('', '.') THEN 0 ELSE 1 END))) AS depth_min FROM (SELECT page_id, split(concat(CASE page_id % 4 WHEN 0 THEN '../../../' WHEN 1 THEN '../../' WHEN 2 THEN 'a/../../' ELSE './../' END, 'x/', page_id % 5), '/') AS parts FROM {pages}))", "SELECT page_id, page_id % 4 <> 0 AS inside FROM pages")
sql("p27_dictionary_limit", "SELECT member_index, NOT is_stored AND NOT is_directory AND NOT is_redirection AND 131072 * (1 + member_index % 64) > 4194304 AS refused FROM {members}")
sql("p28_output_limit", "SELECT member_index, unpacked_size > 5000 AS refused, unpacked_size AS required FROM {members}")
sql("p29_link_header", "SELECT member_index, CASE WHEN NOT (link_type BETWEEN 1 AND 5 AND link_flags IN (0, 1) AND (link_type < 4 OR link_flags = 0)) THEN false WHEN link_type = 1 THEN host_os = 1 AND file_attr & 61440 = 40960 AND NOT is_directory WHEN link_type <= 3 THEN host_os = 0 AND file_attr & 1024 <> 0 AND (file_attr & 16 <> 0) = is_directory AND (link_type <> 3 OR link_flags = 1) AND is_directory = (link_flags = 1) ELSE NOT is_directory AND CASE host_os WHEN 0 THEN file_attr & 1040 = 0 WHEN 1 THEN file_attr & 61440 = 32768 ELSE false END END AS consistent FROM {members}")
sql("p30_legacy_symlinks", "SELECT member_index, host_os = 3 AND file_attr & 61440 = 40960 AS is_symlink FROM {members}")
sql("s18_member_cursor", "SELECT archive_id, line, part, supp, row_number() OVER (PARTITION BY archive_id ORDER BY line, part, supp) - 1 AS member_index FROM {blocks} WHERE kind = 'file'")
sql("s19_member_rows", "SELECT member_index, name, unpacked_size, packed_size, host_os, file_attr, is_directory, is_encrypted, is_stored, is_solid FROM {members}")
sql("s20_services", "SELECT archive_id, label, count(*) AS n FROM {blocks} WHERE kind = 'service' GROUP BY archive_id, label")
sql("s21_newsubs", "SELECT archive_id, count(*) AS n FROM {blocks} WHERE kind = 'newsub' GROUP BY archive_id")
sql("s22_protect_records", "SELECT archive_id, line, part, supp, size FROM {blocks} WHERE kind = 'protect'")
sql("s32_next_volume_flag", "SELECT archive_id, line, part, supp, flags & 1 <> 0 AS has_next FROM {blocks}")
sql("s35_sub_block_kind", "SELECT label, CASE label WHEN 'CMT' THEN 'comment' WHEN 'RR' THEN 'recovery' ELSE 'unknown' END AS kind, count(*) AS n FROM {blocks} GROUP BY label")

# Fixed values of the formats: which writer option each version supports, single (s) or as a volume set (v)
_OLD, _MID, _NEW = ("rar13", "rar14"), ("rar29", "rar30", "rar40"), ("rar50", "rar70")
VERSIONS = (*_OLD, "rar15", "rar20", *_MID, *_NEW)
OPTIONS = {
    "header_encryption": lambda v, vol: v in _MID + _NEW,
    "quick_open": lambda v, vol: v in _NEW and not vol,
    "level": lambda v, vol: True,
    "method": lambda v, vol: v in _MID and not vol,
    "dictionary": lambda v, vol: v not in _OLD,
    "filter": lambda v, vol: v in _NEW or (v in _MID and not vol),
    "recovery": lambda v, vol: v in _NEW,
    "volume_size": lambda v, vol: True,
    "archive_comment": lambda v, vol: not vol or v in _MID,
    "file_comment": lambda v, vol: not vol,
    "metadata": lambda v, vol: v in _NEW and not vol,
    "password": lambda v, vol: not (v in _OLD and vol),
    "memory_limit": lambda v, vol: v in _NEW or not vol,
}
FILTERS = {"delta": _MID + _NEW, "e8": _MID + _NEW, "e8e9": _MID + _NEW, "arm": _NEW, "itanium": _MID, "rgb": _MID, "audio": _MID}


def option_matrix(spark):
    """version, option, volumes, supported: a dimension of a few hundred rows."""
    return spark.createDataFrame([(v, o, vol, bool(f(v, vol))) for v in VERSIONS for o, f in OPTIONS.items() for vol in (False, True)], "version string, option string, volumes boolean, supported boolean")


def filter_matrix(spark):
    return spark.createDataFrame([(v, k, v in own) for v in VERSIONS for k, own in FILTERS.items()], "version string, filter string, supported boolean")


_PICK = f"([{', '.join(repr(v) for v in VERSIONS)}])[(member_index % 9 + 1)::INT]"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@CATALOG.add("p23_option_support", f"SELECT version, volumes, count(*) AS members, bool_and(CASE WHEN volumes THEN version IN {_IN(_NEW)} ELSE version IN {_IN(_MID + _NEW)} END) AS filter_supported FROM (SELECT {_PICK} AS version, is_solid AS volumes FROM {{members}}) GROUP BY ALL")
def p23(spark, folder):
    """Members by planned version and shape, joined to the option matrix."""
    m = members(spark, folder).select(F.expr(f"element_at(array({', '.join(repr(v) for v in VERSIONS)}), CAST(member_index % 9 AS INT) + 1)").alias("version"), F.col("is_solid").alias("volumes"))
    x = option_matrix(spark).where("option = 'filter'")
    return m.join(x, ["version", "volumes"]).groupBy("version", "volumes").agg(F.count("*").alias("members"), F.bool_and("supported").alias("filter_supported"))


@CATALOG.add("p24_filter_support", f"SELECT version, filter, count(*) AS members FROM (SELECT {_PICK} AS version FROM {{members}}), (VALUES ('delta'), ('e8'), ('e8e9'), ('arm'), ('itanium'), ('rgb'), ('audio')) f(filter) WHERE (version IN {_IN(_NEW)} AND filter IN ('delta','e8','e8e9','arm')) OR (version IN {_IN(_MID)} AND filter <> 'arm') GROUP BY ALL")
def p24(spark, folder):
    m = members(spark, folder).select(F.expr(f"element_at(array({', '.join(repr(v) for v in VERSIONS)}), CAST(member_index % 9 AS INT) + 1)").alias("version"))
    return m.groupBy("version").agg(F.count("*").alias("members")).join(filter_matrix(spark).where("supported"), "version").select("version", "filter", "members")


@CATALOG.add("p15_solid_skip_budget", "SELECT archive, member_index, skipped <= 200000 AS allowed FROM (SELECT archive, member_index, is_directory, sum(CASE WHEN is_directory THEN unpacked_size ELSE 0 END) OVER (PARTITION BY archive ORDER BY member_index) AS skipped FROM {members}) x WHERE is_directory")
def p15(spark, folder):
    """Skipped members of a solid archive must be decoded all the same; their running size is held against a budget."""
    m = running(members(spark, folder), ["archive"], "member_index", {"skipped": F.when(F.col("is_directory"), F.col("unpacked_size")).otherwise(0)})
    return m.where("is_directory").select("archive", "member_index", (F.col("skipped") <= 200000).alias("allowed"))


@CATALOG.add("k05_overwrite_rename", "SELECT member_index, CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '\\.txt$', '(' || n || ').txt') END AS written FROM (SELECT member_index, name, row_number() OVER (PARTITION BY name ORDER BY member_index) - 1 AS n FROM {members})")
def k05(spark, folder):
    """Policy 'rename': the later claimants of a name get a number before the extension."""
    from ..functions.names import numbered

    m = running(members(spark, folder), ["name"], "member_index", {"n": F.lit(1)}, before=True)
    return m.select("member_index", F.when(F.col("n") == 0, F.col("name")).otherwise(numbered(F.col("name"), F.col("n"))).alias("written"))


sql("k17_test_verdicts", "SELECT archive, count(*) AS tested, count_if(is_damaged) AS damaged, count_if(is_encrypted) AS locked FROM {members} WHERE NOT is_directory GROUP BY archive", "SELECT archive, count(*) AS tested, count(*) FILTER (is_damaged) AS damaged, count(*) FILTER (is_encrypted) AS locked FROM {members} WHERE NOT is_directory GROUP BY archive")
