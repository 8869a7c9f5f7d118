"""Edits of members as DataFrame operations: insert, rename, delete, set metadata, preservation issues.

An edit table holds one row for each id; ids are stable, so edits commute with renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..sources.tables import members, read

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


def insert(m: DataFrame, new: DataFrame) -> DataFrame:
    """Members with new rows appended; columns that only one side has are null on the other."""
    return m.unionByName(new, allowMissingColumns=True)


def delete(m: DataFrame, ids: DataFrame) -> DataFrame:
    return m.join(ids, "member_index", "left_anti")


def update(m: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """Columns replaced where the edit table (member_index and some of the columns) has a value."""
    e = edits.select("member_index", *(F.col(c).alias(f"_{c}") for c in columns))
    j = m.join(e, "member_index", "left")
    return j.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in m.columns))


def _edits(spark, folder: str) -> DataFrame:
    """Members with a label are edited."""
    e = read(spark, folder, "labels").groupBy(F.col("doc_id").alias("member_index")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return e


_EDITS_D = "(SELECT doc_id AS member_index, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)"


@CATALOG.add("b02_insert_bytes", "SELECT name, unpacked_size FROM {members} UNION ALL SELECT concat('new/', page_id), octet_length(encode(html))::BIGINT FROM pages")
def b02(spark, folder):
    new = read(spark, folder, "pages").select(F.concat(F.lit("new/"), "page_id").alias("name"), F.octet_length("html").cast("long").alias("unpacked_size"))
    return insert(members(spark, folder), new).select("name", "unpacked_size")


@CATALOG.add("b03_insert_directories", "SELECT name, is_directory FROM {members} UNION ALL SELECT DISTINCT concat('dir/', split_part(url, '/', 3)), true FROM pages")
def b03(spark, folder):
    new = read(spark, folder, "pages").select(F.concat(F.lit("dir/"), F.split_part("url", F.lit("/"), F.lit(3))).alias("name"), F.lit(True).alias("is_directory")).distinct()
    return insert(members(spark, folder), new).select("name", "is_directory")


@CATALOG.add("b04_insert_symlinks", "SELECT name, is_redirection, link_target FROM {members} UNION ALL SELECT concat('link/', page_id), true, url FROM pages")
def b04(spark, folder):
    new = read(spark, folder, "pages").select(F.concat(F.lit("link/"), "page_id").alias("name"), F.lit(True).alias("is_redirection"), F.col("url").alias("link_target"))
    return insert(members(spark, folder), new).select("name", "is_redirection", "link_target")


@CATALOG.add("b05_update_source", f"SELECT m.member_index, coalesce(e.quality * 1000::BIGINT, m.unpacked_size) AS unpacked_size FROM {{members}} m LEFT JOIN {_EDITS_D} e USING (member_index)")
def b05(spark, folder):
    e = _edits(spark, folder).select("member_index", (F.col("quality") * F.lit(1000).cast("long")).alias("unpacked_size"))
    return update(members(spark, folder), e, ["unpacked_size"]).select("member_index", "unpacked_size")


@CATALOG.add("b06_rename", f"SELECT m.member_index, CASE WHEN e.member_index IS NOT NULL THEN concat('renamed/', m.name) ELSE m.name END AS name FROM {{members}} m LEFT JOIN {_EDITS_D} e USING (member_index)")
def b06(spark, folder):
    m = members(spark, folder)
    e = m.join(_edits(spark, folder).select("member_index"), "member_index").select("member_index", F.concat(F.lit("renamed/"), "name").alias("name"))
    return update(m, e, ["name"]).select("member_index", "name")


@CATALOG.add("b07_delete", f"SELECT m.member_index FROM {{members}} m LEFT JOIN {_EDITS_D} e USING (member_index) WHERE e.member_index IS NULL")
def b07(spark, folder):
    return delete(members(spark, folder), _edits(spark, folder).select("member_index")).select("member_index")


@CATALOG.add("b08_set_metadata", f"SELECT m.member_index, CASE WHEN e.member_index IS NULL THEN m.flags ELSE e.toxic END AS flags, CASE WHEN e.member_index IS NULL THEN m.host_os ELSE 3 END AS host_os FROM {{members}} m LEFT JOIN {_EDITS_D} e USING (member_index)")
def b08(spark, folder):
    e = _edits(spark, folder).select("member_index", F.col("toxic").cast("long").alias("flags"), F.lit(3).cast("long").alias("host_os"))
    return update(members(spark, folder), e, ["flags", "host_os"]).select("member_index", "flags", "host_os")


@CATALOG.add("b14_retained_links", "SELECT archive, name, link_target FROM {members} WHERE is_redirection AND link_type BETWEEN 1 AND 5 AND link_flags IN (0, 1) AND (link_type < 4 OR link_flags = 0)")
def b14(spark, folder):
    """Links of a source archive that the writer can keep."""
    return members(spark, folder).where("is_redirection and link_type between 1 and 5 and link_flags in (0, 1) and (link_type < 4 or link_flags = 0)").select("archive", "name", "link_target")


@CATALOG.add("b17_member_comment", f"SELECT m.member_index, CASE WHEN e.member_index IS NOT NULL AND m.unpack_version <> 29 THEN concat('q', e.quality) END AS comment FROM {{members}} m LEFT JOIN {_EDITS_D} e USING (member_index)")
def b17(spark, folder):
    """Comments of members; formats of version 29 take none."""
    j = members(spark, folder).join(_edits(spark, folder), "member_index", "left")
    return j.select("member_index", F.when(F.col("quality").isNotNull() & (F.col("unpack_version") != 29), F.concat(F.lit("q"), "quality")).alias("comment"))


@CATALOG.add("b18_set_dos_attributes", f"SELECT m.member_index, CASE WHEN e.member_index IS NULL THEN m.file_attr ELSE 32 + e.quality END AS file_attr FROM {{members}} m LEFT JOIN {_EDITS_D} e USING (member_index)")
def b18(spark, folder):
    e = _edits(spark, folder).select("member_index", (F.col("quality") + 32).cast("long").alias("file_attr"))
    return update(members(spark, folder), e, ["file_attr"]).select("member_index", "file_attr")


_ISSUES = {"encrypted member": "is_encrypted", "damaged member": "is_damaged", "unsupported link": "is_redirection AND NOT (link_type BETWEEN 1 AND 5)", "unknown host": "host_os > 5 OR host_os = 4"}


@CATALOG.add("b11_preservation_issues", "SELECT archive, issue, count(*) AS members FROM (" + " UNION ALL ".join(f"SELECT archive, '{k}' AS issue FROM {{members}} WHERE {v}" for k, v in _ISSUES.items()) + ") GROUP BY ALL")
def b11(spark, folder):
    """Reasons why a rewrite would lose something: every rule is tried in one pass over the members."""
    rules = F.filter(F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in _ISSUES.items())), lambda x: x.isNotNull())
    return members(spark, folder).select("archive", F.explode(rules).alias("issue")).groupBy("archive", "issue").agg(F.count("*").alias("members"))
