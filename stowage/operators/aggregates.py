"""Aggregations and order-dependent folds over members."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..sources.tables import members, read
from .running import running

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles
sql = CATALOG.sql

sql("a01_listing_totals", "SELECT archive, sum(unpacked_size) AS bytes, count(*) AS members FROM {members} GROUP BY archive", "SELECT archive, sum(unpacked_size)::BIGINT AS bytes, count(*) AS members FROM {members} GROUP BY archive")
sql("a03_distinct_salts", "SELECT DISTINCT member_index % 53 AS salt, member_index % 4 AS rounds FROM {members} WHERE is_encrypted")
sql("a13_largest_and_total", "SELECT archive, max(unpacked_size) AS largest, sum(unpacked_size) AS total, CASE WHEN bool_or(is_solid) THEN sum(unpacked_size) ELSE max(unpacked_size) END AS content FROM {members} GROUP BY archive", "SELECT archive, max(unpacked_size) AS largest, sum(unpacked_size)::BIGINT AS total, CASE WHEN bool_or(is_solid) THEN sum(unpacked_size) ELSE max(unpacked_size) END::BIGINT AS content FROM {members} GROUP BY archive")
sql("a14_archive_flags", "SELECT archive, bool_or(is_solid) AS any_solid, bool_or(is_encrypted) AS any_encrypted, bool_and(is_stored) AS all_stored FROM {members} GROUP BY archive")
sql("a15_damage_counters", "SELECT archive, count_if(is_damaged) AS damaged, count_if(is_encrypted AND NOT is_damaged) AS locked, count_if(is_directory) AS skipped FROM {members} GROUP BY archive", "SELECT archive, count(*) FILTER (is_damaged) AS damaged, count(*) FILTER (is_encrypted AND NOT is_damaged) AS locked, count(*) FILTER (is_directory) AS skipped FROM {members} GROUP BY archive")
sql("a17_preservation_version", "SELECT archive, max(unpack_version) AS newest, CASE WHEN max(unpack_version) >= 29 THEN 'rar29' WHEN max(unpack_version) >= 20 THEN 'rar20' ELSE 'rar15' END AS version FROM {members} GROUP BY archive")
sql("b12_staged_bytes", "SELECT archive, sum(unpacked_size) AS staged FROM {members} WHERE NOT is_directory AND NOT is_redirection GROUP BY archive", "SELECT archive, sum(unpacked_size)::BIGINT AS staged FROM {members} WHERE NOT is_directory AND NOT is_redirection GROUP BY archive")


@CATALOG.add("w01_last_entry", "SELECT archive, name, max(member_index) AS member_index, count(*) AS entries FROM {members} GROUP BY archive, name")
def w01(spark, folder):
    """The last of equal names wins: an aggregate, so that a name with very many entries stays one row."""
    return members(spark, folder).groupBy("archive", "name").agg(F.max("member_index").alias("member_index"), F.count("*").alias("entries"))


@CATALOG.add("w06_rename_counters", "SELECT member_index, row_number() OVER (PARTITION BY archive, name ORDER BY member_index) - 1 AS counter FROM {members}")
def w06(spark, folder):
    return running(members(spark, folder), ["archive", "name"], "member_index", {"counter": F.lit(1)}, before=True).select("member_index", "counter")


@CATALOG.add("w11_solid_chain_state", "SELECT archive, member_index, chain, sum(is_damaged::INT) OVER (PARTITION BY archive, chain ORDER BY member_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS broken FROM (SELECT *, sum((NOT is_solid)::INT) OVER (PARTITION BY archive ORDER BY member_index)::BIGINT AS chain FROM {members})")
def w11(spark, folder):
    """A failed member breaks its solid chain up to the next independent member."""
    m = running(members(spark, folder), ["archive"], "member_index", {"chain": (~F.col("is_solid")).cast("long")})
    m = running(m, ["archive", "chain"], "member_index", {"failed": F.col("is_damaged").cast("long"), "earlier": F.lit(1)}, before=True)
    return m.select("archive", "member_index", "chain", F.when(F.col("earlier") > 0, F.col("failed") > 0).alias("broken"))


@CATALOG.add("w12_output_budget", "SELECT archive, member_index, total, total <= 100000 AS admitted FROM (SELECT archive, member_index, (sum(unpacked_size) OVER (PARTITION BY archive ORDER BY member_index))::BIGINT AS total FROM {members})")
def w12(spark, folder):
    """Members are admitted while the running total of output stays within the budget, which counts as reached only beyond it."""
    m = running(members(spark, folder), ["archive"], "member_index", {"total": F.col("unpacked_size")})
    return m.select("archive", "member_index", "total", (F.col("total") <= 100000).alias("admitted"))


@CATALOG.add("w13_header_budget", "SELECT archive, member_index, n <= 20 AND bytes <= 800 AS admitted FROM (SELECT archive, member_index, row_number() OVER w AS n, sum(length(name) + 21) OVER w AS bytes FROM {members} WINDOW w AS (PARTITION BY archive ORDER BY member_index))")
def w13(spark, folder):
    m = running(members(spark, folder), ["archive"], "member_index", {"n": F.lit(1), "bytes": F.length("name") + 21})
    return m.select("archive", "member_index", ((F.col("n") <= 20) & (F.col("bytes") <= 800)).alias("admitted"))


_RANGES = "SELECT o_custkey AS k, (o_orderkey * 37) % 5000 AS s, (o_orderkey * 37) % 5000 + o_orderkey % 400 AS e FROM {orders}"
_RANGES_D = _RANGES.replace("{orders}", "orders")


@CATALOG.add("w09_merge_ranges", f"SELECT k, min(s) AS start, max(e) AS end_ FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ({_RANGES_D}))) GROUP BY k, island")
def w09(spark, folder):
    """Overlapping and touching ranges of a key are merged."""
    r = spark.sql(_RANGES, orders=read(spark, folder, "orders"))
    w = Window.partitionBy("k").orderBy("s", "e")
    new = F.when(F.col("s") <= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    r = r.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("k", "island").agg(F.min("s").alias("start"), F.max("e").alias("end_")).drop("island")


@CATALOG.add("w10_merge_equal_strides", "SELECT k, stride, min(line) * 16384 AS start, (max(line) + 1) * 16384 AS end_ FROM (SELECT k, line, stride, line - row_number() OVER (PARTITION BY k, stride ORDER BY line) AS run FROM (SELECT DISTINCT user_id AS k, event_id % 50 AS line, min(event_id % 3) OVER (PARTITION BY user_id, event_id % 50) AS stride FROM events)) GROUP BY k, stride, run HAVING count(*) >= 2")
def w10(spark, folder):
    """Windows of 16 KiB with one stride that follow each other are one region; regions under 32 KiB are dropped."""
    e = read(spark, folder, "events").selectExpr("user_id AS k", "event_id % 50 AS line", "event_id % 3 AS s").groupBy("k", "line").agg(F.min("s").alias("stride"))
    e = e.withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("k", "stride").orderBy("line")))
    g = e.groupBy("k", "stride", "run").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count("*").alias("n")).where("n >= 2")
    return g.selectExpr("k", "stride", "a * 16384 AS start", "(b + 1) * 16384 AS end_")


@CATALOG.add("w08_cluster_positions", "SELECT k, count(*) AS n, min(p) AS first_pos, max(p) AS last_pos FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY p ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= 4096 THEN 0 ELSE 1 END AS new FROM (SELECT user_id AS k, event_id * 97 AS p FROM events))) GROUP BY k, c HAVING count(*) >= 2")
def w08(spark, folder):
    """Positions within 4096 bytes of the one before share a cluster; single ones are dropped."""
    w = Window.partitionBy("k").orderBy("p")
    e = read(spark, folder, "events").selectExpr("user_id AS k", "event_id * 97 AS p")
    e = e.withColumn("new", F.when(F.col("p") - F.lag("p").over(w) <= 4096, 0).otherwise(1)).withColumn("c", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("k", "c").agg(F.count("*").alias("n"), F.min("p").alias("first_pos"), F.max("p").alias("last_pos")).where("n >= 2").drop("c")


@CATALOG.add("x09_write_progress", "SELECT user_id, event_type AS phase, count(*) AS events, max(event_id) AS completed, count(*) FILTER (value > 50) AS large FROM events GROUP BY ALL")
def x09(spark, folder):
    return read(spark, folder, "events").groupBy("user_id", F.col("event_type").alias("phase")).agg(F.count("*").alias("events"), F.max("event_id").alias("completed"), F.count_if(F.col("value") > 50).alias("large"))


@CATALOG.add("x10_read_progress", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS completed, count(*) OVER (PARTITION BY user_id) AS total FROM events")
def x10(spark, folder):
    e = read(spark, folder, "events").select("user_id", "event_id")
    total = e.groupBy("user_id").agg(F.count("*").alias("total"))
    return running(e, ["user_id"], "event_id", {"completed": F.lit(1)}).join(total, "user_id").select("user_id", "event_id", "completed", "total")


@CATALOG.add("x15_windows_over_progress", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x15(spark, folder):
    e = read(spark, folder, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n")
