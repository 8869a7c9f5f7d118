"""The places where two row sets are matched: lookups, requests, links, services, ranges, edits, shards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..sources.tables import blocks, members, read
from .running import running

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles
sql = CATALOG.sql


def latest(m):
    """The last entry of each name of an archive."""
    return m.groupBy("archive", "name").agg(F.max("member_index").alias("member_index"))


@CATALOG.add("j01_name_lookup", "SELECT p.page_id, m.name, m.member_index FROM (SELECT page_id, concat('src', page_id % 25, '/en/f', page_id % 97, '.txt') AS name FROM pages) p JOIN (SELECT name, max(member_index) AS member_index FROM {members} GROUP BY name) m USING (name)")
def j01(spark, folder):
    """Requested names matched to the last member of each name."""
    asked = read(spark, folder, "pages").selectExpr("page_id", "concat('src', page_id % 25, '/en/f', page_id % 97, '.txt') AS name")
    found = members(spark, folder).groupBy("name").agg(F.max("member_index").alias("member_index"))
    return asked.join(found, "name").select("page_id", "name", "member_index")


@CATALOG.add("j02_payload_lookup", "SELECT name, max(member_index) AS member_index FROM {members} WHERE NOT is_directory AND NOT is_redirection GROUP BY name")
def j02(spark, folder):
    """The last entry of a name that has a payload."""
    return members(spark, folder).where("not is_directory and not is_redirection").groupBy("name").agg(F.max("member_index").alias("member_index"))


@CATALOG.add("j03_multi_read", "SELECT r.page_id, r.pos, m.unpacked_size FROM (SELECT page_id, unnest([page_id * 3, page_id, page_id * 3, page_id + 100000000]) AS want, unnest([0, 1, 2, 3]) AS pos FROM pages) r LEFT JOIN {members} m ON m.member_index = r.want")
def j03(spark, folder):
    """A list of indices: order and repeats are kept, a missing member is null."""
    asked = read(spark, folder, "pages").select("page_id", F.posexplode(F.expr("array(page_id * 3, page_id, page_id * 3, page_id + 100000000)")).alias("pos", "member_index"))
    return asked.join(members(spark, folder).select("member_index", "unpacked_size"), "member_index", "left").select("page_id", "pos", "unpacked_size")


@CATALOG.add("j06_link_targets", "SELECT l.archive, l.member_index, t.target FROM {members} l LEFT JOIN LATERAL (SELECT max(m.member_index) AS target FROM {members} m WHERE m.archive = l.archive AND m.name = l.link_target AND m.member_index < l.member_index) t ON true WHERE l.is_redirection")
def j06(spark, folder):
    """A hard link or copy must name an earlier member of its archive; the last such member, or null for a violation."""
    m = members(spark, folder)
    links = m.where("is_redirection").select("archive", "member_index", F.col("link_target").alias("name"), F.lit(True).alias("link"))
    own = m.select("archive", "member_index", "name", F.lit(False).alias("link"))
    # an as-of join as one window: links and members of a name in order, links carry the last member before them
    w = Window.partitionBy("archive", "name").orderBy("member_index").rangeBetween(Window.unboundedPreceding, -1)
    both = links.unionByName(own).withColumn("target", F.max(F.when(~F.col("link"), F.col("member_index"))).over(w))
    return both.where("link").select("archive", "member_index", "target")


@CATALOG.add("j09_shards_with_checks", "SELECT s.s_suppkey AS shard, s.s_nationkey IS NOT DISTINCT FROM f.n AND f.n IS NOT NULL AS valid, f.n IS NOT NULL AS present FROM supplier s LEFT JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 1 THEN NULL WHEN s_suppkey % 9 = 2 THEN s_nationkey + 1 ELSE s_nationkey END AS n FROM supplier) f ON f.k = s.s_suppkey")
def j09(spark, folder):
    """A shard table joined to the files that arrived: present, and with the right check value."""
    s = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("shard"), F.col("s_nationkey").alias("want"))
    f = read(spark, folder, "supplier").selectExpr("s_suppkey AS shard", "CASE WHEN s_suppkey % 5 = 1 THEN NULL WHEN s_suppkey % 9 = 2 THEN s_nationkey + 1 ELSE s_nationkey END AS got")
    return s.join(f, "shard", "left").select("shard", (F.col("want").eqNullSafe(F.col("got")) & F.col("got").isNotNull()).alias("valid"), F.col("got").isNotNull().alias("present"))


@CATALOG.add("j10_service_parent", "SELECT archive_id, line, part, supp, label, last_value(CASE WHEN kind = 'file' THEN n END IGNORE NULLS) OVER (PARTITION BY archive_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY line, part, supp) AS n FROM {blocks}) QUALIFY kind <> 'file'")
def j10(spark, folder):
    """A service block belongs to the file block before it."""
    w = Window.partitionBy("archive_id").orderBy("line", "part", "supp")
    b = blocks(spark, folder).withColumn("n", F.row_number().over(w))
    parent = F.last(F.when(F.col("kind") == "file", F.col("n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("parent", parent).where("kind <> 'file'").select("archive_id", "line", "part", "supp", "label", "parent")


@CATALOG.add("j12_filter_ranges", "SELECT d.doc_id, b.i AS block, greatest(f.s, b.i * 512) AS start, least(f.e, (b.i + 1) * 512) AS end_ FROM documents d, LATERAL (SELECT d.n_chars // 3 AS s, d.n_chars // 3 + d.doc_id % 2000 AS e) f, LATERAL (SELECT unnest(range(((d.n_chars + 511) // 512)::BIGINT)) AS i) b WHERE f.e > f.s AND f.s < (b.i + 1) * 512 AND f.e > b.i * 512")
def j12(spark, folder):
    """Blocks of 512 bytes that meet a pending filter's range: the overlapping block numbers are computed, not searched for."""
    d = read(spark, folder, "documents").selectExpr("doc_id", "n_chars", "n_chars div 3 AS s", "n_chars div 3 + doc_id % 2000 AS e").where("e > s and n_chars > s")
    d = d.withColumn("block", F.explode(F.expr("sequence(s div 512, least((e - 1) div 512, (n_chars + 511) div 512 - 1))")))
    return d.select("doc_id", "block", F.greatest("s", F.col("block") * 512).alias("start"), F.least("e", (F.col("block") + 1) * 512).alias("end_"))


@CATALOG.add("j13_unique_edit_targets", "SELECT e.name, count(m.member_index) AS holders, count(m.member_index) = 1 AS accepted FROM (SELECT DISTINCT concat('src', page_id % 25, '/en/f', page_id % 97, '.txt') AS name FROM pages) e LEFT JOIN {members} m USING (name) GROUP BY e.name")
def j13(spark, folder):
    """An edit by name is accepted when exactly one member has it."""
    e = read(spark, folder, "pages").selectExpr("concat('src', page_id % 25, '/en/f', page_id % 97, '.txt') AS name").distinct()
    j = e.join(members(spark, folder).select("name", "member_index"), "name", "left")
    return j.groupBy("name").agg(F.count("member_index").alias("holders"), (F.count("member_index") == 1).alias("accepted"))


sql("j14_read_by_name", "SELECT name, max_by(unpacked_size, member_index) AS unpacked_size FROM {members} WHERE NOT is_directory AND NOT is_redirection GROUP BY name", "SELECT name, arg_max(unpacked_size, member_index) AS unpacked_size FROM {members} WHERE NOT is_directory AND NOT is_redirection GROUP BY name")


@CATALOG.add("j15_read_by_index", "SELECT l.doc_id, m.archive, sum(x.unpacked_size)::BIGINT AS decoded_bytes FROM (SELECT DISTINCT doc_id FROM labels) l JOIN {members} m ON m.member_index = l.doc_id JOIN {members} x ON x.archive = m.archive AND (x.member_index = m.member_index OR (m.is_solid AND x.member_index < m.member_index)) GROUP BY ALL")
def j15(spark, folder):
    """Bytes decoded to read one member: a solid one needs all members before it (a running sum, not a join)."""
    m = running(members(spark, folder), ["archive"], "member_index", {"upto": F.col("unpacked_size")})
    m = m.withColumn("decoded_bytes", F.when(F.col("is_solid"), F.col("upto")).otherwise(F.col("unpacked_size")))
    asked = read(spark, folder, "labels").select("doc_id").distinct()
    return m.join(asked, m.member_index == asked.doc_id).select("doc_id", "archive", "decoded_bytes")
