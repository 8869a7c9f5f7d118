"""Sorts, limits and top-k: global ranks without a single task, order-dependent stops, smallest candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..plans.storage import cut
from ..sources.tables import blocks, members, read
from .running import running

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


def ranked(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """1-based place in a total order: a range sort, a row number inside each range, and the ranges' counts added up.

    Only one count for each range meets in one place, so the rank works on any number of rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))  # ranges are sampled once
    local = spread.withColumn("_local", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    counts = spread.groupBy("_range").agg(F.count("*").alias("_n"))
    base = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_base"))
    return local.join(base, "_range").withColumn(name, F.col("_base") + F.col("_local")).drop("_range", "_local", "_base")


@CATALOG.add("t02_directory_sort", "SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY child, page_id) AS place, child FROM (SELECT page_id, split_part(url, '/', 3) AS parent, list_extract(string_split(url, '/'), -1) AS child FROM pages)")
def t02(spark, folder):
    """Children of a directory by name."""
    p = read(spark, folder, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("parent"), F.element_at(F.split("url", "/"), -1).alias("child"))
    return p.select("parent", F.row_number().over(Window.partitionBy("parent").orderBy("child", "page_id")).alias("place"), "child")


@CATALOG.add("t03_top_k_regions", "SELECT cust, n, length, start FROM (SELECT o_custkey AS cust, count(*) AS n, (max(o_orderkey) - min(o_orderkey))::BIGINT AS length, min(o_orderkey) AS start FROM orders GROUP BY o_custkey) ORDER BY n DESC, length, start LIMIT 8")
def t03(spark, folder):
    """Regions by count downwards, then length, then start; eight are kept."""
    r = read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.count("*").alias("n"), (F.max("o_orderkey") - F.min("o_orderkey")).alias("length"), F.min("o_orderkey").alias("start"))
    return r.orderBy(F.desc("n"), "length", "start").limit(8)


@CATALOG.add("t04_smallest_candidate", "SELECT archive_id, arg_min(part, (size, part)) AS chosen, min(size) AS packed FROM {blocks} GROUP BY archive_id")
def t04(spark, folder):
    """The candidate with the smallest packed size; ties go to the first."""
    return blocks(spark, folder).groupBy("archive_id").agg(F.min_by("part", F.struct("size", "part")).alias("chosen"), F.min("size").alias("packed"))


@CATALOG.add("t05_early_stop", "WITH last AS (SELECT archive, max(member_index) AS m FROM {members} JOIN (SELECT DISTINCT doc_id FROM labels) ON doc_id = member_index GROUP BY archive) SELECT x.archive, count(*) AS read_members, sum(unpacked_size)::BIGINT AS bytes FROM {members} x JOIN last ON x.archive = last.archive AND x.member_index <= last.m GROUP BY x.archive")
def t05(spark, folder):
    """Labelled members are requested; reading stops after the last requested member of an archive."""
    m = members(spark, folder)
    asked = read(spark, folder, "labels").select(F.col("doc_id").alias("member_index")).distinct()
    last = m.join(asked, "member_index", "left_semi").groupBy("archive").agg(F.max("member_index").alias("last"))
    return m.join(last, "archive").where("member_index <= last").groupBy("archive").agg(F.count("*").alias("read_members"), F.sum("unpacked_size").alias("bytes"))


@CATALOG.add("t08_payload_order", "SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY member_index) - 1 AS place, member_index FROM {members} WHERE NOT is_directory")
def t08(spark, folder):
    """Payloads for a rewrite, in source order."""
    m = members(spark, folder).where("not is_directory")
    return running(m, ["archive"], "member_index", {"place": F.lit(1)}, before=True).select("archive", "place", "member_index")
