"""Set operations: appends, duplicate policies, removals, input dedupe, interval subtraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..sources.tables import members, read

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


@CATALOG.add("u01_add_members", "SELECT name, origin FROM (SELECT name, 'archive' AS origin FROM {members} UNION ALL SELECT concat('added/', url), 'new' FROM pages)")
def u01(spark, folder):
    new = read(spark, folder, "pages").select(F.concat(F.lit("added/"), "url").alias("name"), F.lit("new").alias("origin"))
    return members(spark, folder).select("name", F.lit("archive").alias("origin")).unionByName(new)


@CATALOG.add("u02_duplicate_names", "SELECT archive, name, count(*) AS entries FROM {members} GROUP BY ALL HAVING count(*) > 1")
def u02(spark, folder):
    return members(spark, folder).groupBy("archive", "name").agg(F.count("*").alias("entries")).where("entries > 1")


@CATALOG.add("u03_remove_members", "SELECT archive, member_index FROM {members} WHERE member_index NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def u03(spark, folder):
    gone = read(spark, folder, "labels").select(F.col("doc_id").alias("member_index"))
    return members(spark, folder).select("archive", "member_index").join(gone, "member_index", "left_anti").select("archive", "member_index")


@CATALOG.add("u05_input_paths", "SELECT DISTINCT split_part(url, '?', 1) AS path FROM pages")
def u05(spark, folder):
    return read(spark, folder, "pages").select(F.split_part("url", F.lit("?"), F.lit(1)).alias("path")).distinct()


def subtract(keep: DataFrame, remove: DataFrame) -> DataFrame:
    """Intervals (k, s, e) of `keep` without those of `remove`: a sweep over the borders of a key with running counts."""
    from pyspark.sql import Window

    def borders(r: DataFrame, a: str, b: str) -> DataFrame:
        r = r.where("e > s")
        ins = r.select("k", F.col("s").alias("p"), F.lit(1).alias(a), F.lit(0).alias(b))
        return ins.union(r.select("k", F.col("e").alias("p"), F.lit(-1).alias(a), F.lit(0).alias(b)))

    x = borders(keep, "own", "cut").unionByName(borders(remove, "cut", "own").select("k", "p", "own", "cut"))
    x = x.groupBy("k", "p").agg(F.sum("own").alias("own"), F.sum("cut").alias("cut"))
    w = Window.partitionBy("k").orderBy("p")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("k", "p", F.lead("p").over(w).alias("q"), ((F.sum("own").over(upto) > 0) & (F.sum("cut").over(upto) == 0)).alias("kept"))
    # neighbours that are both kept are one interval
    x = x.withColumn("new", F.when(F.coalesce(F.lag("kept").over(w), F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(upto))
    return x.where("kept and q is not null").groupBy("k", "island").agg(F.min("p").alias("s"), F.max("q").alias("e")).drop("island")


_KEEP = "SELECT o_custkey AS k, o_orderkey % 50 * 40 AS s, o_orderkey % 50 * 40 + 200 AS e FROM orders"
_CUT = "SELECT o_custkey AS k, (o_orderkey * 7) % 2000 AS s, (o_orderkey * 7) % 2000 + 30 + o_orderkey % 60 AS e FROM orders"
_SUBTRACT = f"""WITH b AS (SELECT k, p, sum(own) AS own, sum(cut) AS cut FROM (
  SELECT k, s AS p, 1 AS own, 0 AS cut FROM ({_KEEP}) UNION ALL SELECT k, e, -1, 0 FROM ({_KEEP})
  UNION ALL SELECT k, s, 0, 1 FROM ({_CUT}) UNION ALL SELECT k, e, 0, -1 FROM ({_CUT})) GROUP BY k, p),
c AS (SELECT k, p, lead(p) OVER w AS q, sum(own) OVER w > 0 AND sum(cut) OVER w = 0 AS kept FROM b WINDOW w AS (PARTITION BY k ORDER BY p)),
d AS (SELECT *, sum(CASE WHEN coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY p) AS island FROM (SELECT *, lag(kept) OVER (PARTITION BY k ORDER BY p) AS before FROM c))
SELECT k, min(p) AS s, max(q) AS e FROM d WHERE kept AND q IS NOT NULL GROUP BY k, island"""


@CATALOG.add("u06_subtract_regions", _SUBTRACT)
def u06(spark, folder):
    o = read(spark, folder, "orders")
    keep = o.selectExpr("o_custkey AS k", "o_orderkey % 50 * 40 AS s", "o_orderkey % 50 * 40 + 200 AS e")
    cut = o.selectExpr("o_custkey AS k", "(o_orderkey * 7) % 2000 AS s", "(o_orderkey * 7) % 2000 + 30 + o_orderkey % 60 AS e")
    return subtract(keep, cut)


@CATALOG.add("g07_tables_outside_code", f"SELECT k, s, e FROM ({_SUBTRACT}) WHERE e - s >= 32")
def g07(spark, folder):
    """What is left of table regions outside code regions, with the short rests dropped."""
    return u06(spark, folder).where("e - s >= 32")


@CATALOG.add("g06_graft_filters", f"SELECT k, s, e, 'delta' AS kind FROM ({_SUBTRACT}) UNION ALL SELECT DISTINCT k, s, e, 'e8' FROM ({_CUT})")
def g06(spark, folder):
    """One list of filters: code ranges, and tables cut to what code leaves."""
    code = read(spark, folder, "orders").selectExpr("o_custkey AS k", "(o_orderkey * 7) % 2000 AS s", "(o_orderkey * 7) % 2000 + 30 + o_orderkey % 60 AS e").distinct()
    return u06(spark, folder).withColumn("kind", F.lit("delta")).unionByName(code.withColumn("kind", F.lit("e8")))
