"""Queries over header bits, sizes and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..plans.catalog import Catalog
from ..sources.tables import read

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

_WORD = "CAST((o_orderkey * 2654435761) % 2097152 AS BIGINT)"
_WORD_D = "((o_orderkey * 2654435761) % 2097152)::BIGINT"


@CATALOG.add("s14_compression_info", f"SELECT o_orderkey, a AS algorithm, (w & 64) <> 0 AS solid, (w >> 7) & 7 AS method, p AS power, f AS fraction, c AS compatible, CASE WHEN a = 1 THEN (f + 32) << (p + 12) ELSE 131072 << p END AS dictionary FROM (SELECT o_orderkey, w, w & 63 AS a, (w >> 10) & 31 AS p, (w >> 15) & 31 AS f, (w & 1048576) <> 0 AS c FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ({_WORD_D} & 2097088) | (o_orderkey % 3) ELSE {_WORD_D} & 16320 END AS w FROM orders)) WHERE a <= 1 AND NOT (a = 0 AND (f <> 0 OR c OR p > 15))")
def s14(spark, folder):
    raw = F.expr(f"CASE WHEN o_orderkey % 2 = 0 THEN ({_WORD} & 2097088) | (o_orderkey % 3) ELSE {_WORD} & 16320 END")
    return read(spark, folder, "orders").select("o_orderkey", B.compression_info(raw).alias("x")).where("x is not null").select("o_orderkey", "x.*")


_HEX = "lpad(hex(CAST(o_orderkey * 48271 * (o_orderkey % 1000) AS BIGINT)), 16, '0')"
_BYTES_D = "list_transform(range(8), lambda i: ('0x' || substr(lpad(hex(o_orderkey * 48271 * (o_orderkey % 1000)), 16, '0'), (2 * i + 1)::INT, 2))::BIGINT)"


@CATALOG.add("s13_vint_decode", f"SELECT o_orderkey, list_reduce(list_prepend(0::BIGINT, list_reverse(list_slice(b, 1, n))), lambda s, x: s * 128 + (x & 127)) AS value, n AS length FROM (SELECT o_orderkey, b, list_position(list_transform(b, lambda x: x < 128), true)::BIGINT AS n FROM (SELECT o_orderkey, {_BYTES_D} AS b FROM orders)) WHERE n > 0")
def s13(spark, folder):
    data = B.byte_values(F.unhex(F.expr(_HEX)))
    return read(spark, folder, "orders").select("o_orderkey", B.vint(data).alias("x")).where("x is not null").select("o_orderkey", "x.*")


@CATALOG.add("m01_little_endian_fields", f"SELECT o_orderkey, b[1] + 256 * b[2] AS u16, b[1] + 256 * b[2] + 65536 * b[3] + 16777216 * b[4] AS u32 FROM (SELECT o_orderkey, {_BYTES_D} AS b FROM orders)")
def m01(spark, folder):
    data = B.byte_values(F.unhex(F.expr(_HEX)))
    return read(spark, folder, "orders").select("o_orderkey", B.little_endian(F.slice(data, 1, 2)).alias("u16"), B.little_endian(F.slice(data, 1, 4)).alias("u32"))


@CATALOG.add("m02_fitted_dictionary", "SELECT o_orderkey, least(coalesce(list_filter(list_transform(range(16), lambda k: 131072::BIGINT << k), lambda s: s > c)[1], 4294967296), 4194304 << (o_orderkey % 4)) AS dictionary FROM (SELECT o_orderkey, (o_orderkey * 7919) % 40000000 AS c FROM orders)")
def m02(spark, folder):
    return read(spark, folder, "orders").select("o_orderkey", B.fitted_dictionary(F.expr("(o_orderkey * 7919) % 40000000"), F.expr("CAST(4194304 * pow(2, o_orderkey % 4) AS BIGINT)")).alias("dictionary"))


@CATALOG.add("m03_dictionary_fields", "SELECT o_orderkey, p AS power, (size // (4096 << p))::BIGINT AS mantissa FROM (SELECT o_orderkey, size, list_filter(range(32), lambda k: size % (4096::BIGINT << k) = 0 AND size >= (131072::BIGINT << k) AND size <= (258048::BIGINT << k))[1] AS p FROM (SELECT o_orderkey, ((o_orderkey % 40) + 30) * (4096::BIGINT << (o_orderkey % 11)) AS size FROM orders)) WHERE p IS NOT NULL")
def m03(spark, folder):
    size = F.expr("((o_orderkey % 40) + 30) * 4096 * CAST(pow(2, o_orderkey % 11) AS BIGINT)")
    return read(spark, folder, "orders").select("o_orderkey", B.dictionary_fields(size).alias("x")).where("x is not null").select("o_orderkey", "x.*")


_PLAN_D = "SELECT k, size, pct, data, CASE WHEN par = 0 AND size < 204800 THEN 1 ELSE par END AS parity, g + (g & 1) AS groups FROM (SELECT *, least((2 * least(pct, 100) * data) // 200, data) AS par, (size + data - 1) // data AS g FROM (SELECT *, CASE WHEN size >= 204800 THEN 200 ELSE greatest((size + 1023) // 1024, 1) END AS data FROM (SELECT o_orderkey AS k, (o_orderkey * 7919) % 3000000 AS size, o_orderkey % 120 AS pct FROM orders)))"


@CATALOG.add("m04_recovery_plan", f"SELECT k, data AS data_shards, parity AS recovery_shards, groups AS group_count, data * 8 + 72 AS header_size, data * 8 + 72 + groups AS shard_size FROM ({_PLAN_D})")
def m04(spark, folder):
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), B.recovery_plan(F.expr("(o_orderkey * 7919) % 3000000"), F.expr("o_orderkey % 120")).alias("x")).select("k", "x.*")


@CATALOG.add("m05_shard_ranges", "SELECT k, i AS shard, least(i * groups, size) AS start, least((i + 1) * groups, size) AS end_ FROM (SELECT *, unnest(range(data)) AS i FROM (SELECT k, size, data, g + (g & 1) AS groups FROM (SELECT *, (size + data - 1) // data AS g FROM (SELECT *, CASE WHEN size >= 204800 THEN 200 ELSE greatest((size + 1023) // 1024, 1) END AS data FROM (SELECT s_suppkey AS k, (s_suppkey * 7919) % 300000 AS size FROM supplier)))))")
def m05(spark, folder):
    """Byte ranges of the data shards of an archive's prefix."""
    o = read(spark, folder, "supplier").selectExpr("s_suppkey AS k", "(s_suppkey * 7919) % 300000 AS size")
    p = o.select("k", "size", B.recovery_plan(F.col("size"), F.lit(5)).alias("p")).select("k", "size", "p.data_shards", "p.group_count")
    p = p.select("k", "size", "group_count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("data_shards") - 1)).alias("shard"))
    return p.select("k", "shard", F.least(F.col("shard") * F.col("group_count"), "size").alias("start"), F.least((F.col("shard") + 1) * F.col("group_count"), "size").alias("end_"))


@CATALOG.add("m08_progress_percentage", "SELECT event_id, CASE WHEN total > 0 THEN 100.0::DOUBLE * done / total END AS percentage FROM (SELECT event_id, event_id % 7 AS total, (event_id % 7) * (event_id % 3) // 2 AS done FROM events)")
def m08(spark, folder):
    return read(spark, folder, "events").selectExpr("event_id", "try_divide(100D * ((event_id % 7) * (event_id % 3) div 2), event_id % 7) AS percentage")


@CATALOG.add("m09_delta_range", "SELECT doc_id, s AS start, e AS end_ FROM (SELECT doc_id, n, c, s, (n - 64) - ((n - 64) - s) % c AS e FROM (SELECT doc_id, n_chars AS n, doc_id % 12 + 1 AS c, 64 + (c - 64 % c) % c AS s FROM documents)) WHERE n > 128 + c * 8 AND s + c * 8 <= e")
def m09(spark, folder):
    d = read(spark, folder, "documents").select("doc_id", B.delta_range(F.col("n_chars"), F.expr("doc_id % 12 + 1")).alias("x")).where("x is not null")
    return d.select("doc_id", F.col("x.start").alias("start"), F.col("x.end").alias("end_"))


@CATALOG.add("m10_sample_range", "SELECT o_orderkey, CASE WHEN n <= 131072 THEN 0 ELSE (n - 131072) // 2 // 12 * 12 END AS start, CASE WHEN n <= 131072 THEN n ELSE (n - 131072) // 2 // 12 * 12 + 131072 END AS end_ FROM (SELECT o_orderkey, (o_orderkey * 7919) % 500000 AS n FROM orders)")
def m10(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", B.sample_range(F.expr("(o_orderkey * 7919) % 500000")).alias("x"))
    return o.select("o_orderkey", F.col("x.start").alias("start"), F.col("x.end").alias("end_"))


CATALOG.sql("m11_screen_margin", "SELECT o_orderkey, (o_orderkey * 31) % 1000 * 100 < (o_orderkey * 17) % 1000 * 99 AS wins FROM {orders}")
CATALOG.sql("m12_level_effort", "SELECT o_orderkey, element_at(array(0, 8, 32, 128, 256, 512), CAST(o_orderkey % 6 AS INT) + 1) AS candidates FROM {orders}", "SELECT o_orderkey, ([0, 8, 32, 128, 256, 512])[(o_orderkey % 6 + 1)::INT] AS candidates FROM orders")
CATALOG.sql("p20_store_or_compress", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (l_partkey * 31) % 1000 >= (l_partkey * 17) % 1000 AND l_suppkey % 3 <> 0 THEN 'stored' ELSE 'compressed' END AS method FROM {lineitem}")
