"""Queries over stored times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as T
from ..plans.catalog import Catalog
from ..sources.tables import read

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

_RAW = "CAST((o_orderkey * 2654435761) % 4294967296 AS BIGINT)"
_RAW_D = "((o_orderkey * 2654435761) % 4294967296)::BIGINT"
_FIELDS_D = f"SELECT o_orderkey, raw, 1980 + ((raw >> 25) & 127) AS y, (raw >> 21) & 15 AS mo, (raw >> 16) & 31 AS d, (raw >> 11) & 31 AS h, (raw >> 5) & 63 AS mi, (raw & 31) * 2 AS s FROM (SELECT o_orderkey, {_RAW_D} AS raw FROM orders)"


@CATALOG.add("d01_dos_fields", f"SELECT o_orderkey, y AS year, mo AS month, d AS day, h AS hour, mi AS minute, s AS second FROM ({_FIELDS_D}) WHERE mo <> 0 AND d <> 0")
def d01(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", T.dos_fields(F.expr(_RAW)).alias("f")).where("f is not null")
    return o.select("o_orderkey", "f.*")


_UNIX_D = f"SELECT o_orderkey, raw, CASE WHEN raw <> 0 AND mo BETWEEN 1 AND 12 AND d > 0 AND h <= 23 AND mi <= 59 AND s <= 59 THEN date_diff('second', TIMESTAMP '1970-01-01', make_timestamp(y, mo, 1, h, mi, s::DOUBLE) + to_days((d - 1)::INT)) END AS t FROM ({_FIELDS_D})"


@CATALOG.add("d02_dos_to_instant", f"SELECT o_orderkey, t AS unix_seconds FROM ({_UNIX_D})")
def d02(spark, folder):
    return read(spark, folder, "orders").select("o_orderkey", T.dos_to_unix(F.expr(_RAW)).alias("unix_seconds"))


_SEC = "CAST(o_orderkey * 104729 + 200000000 AS BIGINT)"


@CATALOG.add("d03_instant_to_dos", "SELECT o_orderkey, CASE WHEN year(t) BETWEEN 1980 AND 2107 THEN ((year(t) - 1980) << 25) + (month(t) << 21) + (day(t) << 16) + (hour(t) << 11) + (minute(t) << 5) + second(t) // 2 END::BIGINT AS dos FROM (SELECT o_orderkey, TIMESTAMP '1970-01-01' + to_seconds(o_orderkey * 104729 + 200000000) AS t FROM orders)")
def d03(spark, folder):
    return read(spark, folder, "orders").select("o_orderkey", T.unix_to_dos(F.expr(_SEC)).alias("dos"))


@CATALOG.add("d04_stored_to_unix", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN raw ELSE t END AS unix_seconds FROM ({_UNIX_D})")
def d04(spark, folder):
    """Format 5+ stores Unix seconds, the others DOS words."""
    raw = F.expr(_RAW)
    return read(spark, folder, "orders").select("o_orderkey", F.when(F.expr("o_orderkey % 3 = 0"), raw).otherwise(T.dos_to_unix(raw)).alias("unix_seconds"))


_TICKS = "CAST(o_orderkey * 7919 * 1000003 + 116444736000000000 AS BIGINT)"


@CATALOG.add("d05_ticks_to_nanoseconds", "SELECT o_orderkey, ((o_orderkey * 7919 * 1000003)::HUGEINT * 100)::BIGINT AS ns FROM orders")
def d05(spark, folder):
    return read(spark, folder, "orders").select("o_orderkey", T.ticks_to_ns(F.expr(_TICKS)).cast("long").alias("ns"))


@CATALOG.add("d06_format_ticks", "SELECT o_orderkey, strftime(TIMESTAMP '1970-01-01' + to_seconds((t // 10000000)::BIGINT), '%Y-%m-%d %H:%M:%S') || '.' || lpad((t % 10000000)::VARCHAR, 7, '0') AS shown FROM (SELECT o_orderkey, o_orderkey * 7919 * 1000003 AS t FROM orders)")
def d06(spark, folder):
    return read(spark, folder, "orders").select("o_orderkey", T.format_ticks(F.expr(_TICKS)).alias("shown"))


@CATALOG.add("d07_unix_fields", "SELECT o_orderkey, year(t) AS year, month(t) AS month, day(t) AS day, hour(t) AS hour, minute(t) AS minute, second(t)::BIGINT AS second FROM (SELECT o_orderkey, TIMESTAMP '1970-01-01' + to_seconds(o_orderkey * 104729 + 200000000) AS t FROM orders)")
def d07(spark, folder):
    t = F.timestamp_seconds(F.expr(_SEC))
    return read(spark, folder, "orders").select("o_orderkey", F.year(t).alias("year"), F.month(t).alias("month"), F.day(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second"))


_KEY = "CAST(o_orderkey AS DECIMAL(20,0))"  # products of it may exceed 64 bits
_NS = f"CAST(({_KEY} - 7000) * CAST(1234567891011 AS DECIMAL(13,0)) AS DECIMAL(38,0))"


@CATALOG.add("d10_split_nanoseconds", "SELECT o_orderkey, ((ns - r) // 1000000000)::BIGINT AS seconds, r::BIGINT AS nanoseconds FROM (SELECT o_orderkey, ns, ((ns % 1000000000) + 1000000000) % 1000000000 AS r FROM (SELECT o_orderkey, ((o_orderkey - 7000) * 1234567891011)::HUGEINT AS ns FROM orders))")
def d10(spark, folder):
    o = read(spark, folder, "orders").select("o_orderkey", T.split_ns(F.expr(_NS)).alias("x"))
    return o.select("o_orderkey", "x.*")


@CATALOG.add("d11_time_record_choice", "SELECT o_orderkey, CASE WHEN least(a, b, c) >= 0 AND greatest(a, b, c) // 1000000000 <= 4294967295 THEN 'unix' WHEN a % 100 = 0 AND b % 100 = 0 AND c % 100 = 0 THEN 'ticks' ELSE 'refused' END AS form FROM (SELECT o_orderkey, ((o_orderkey - 7000) * 1234567891011)::HUGEINT AS a, (o_orderkey * 1000000007)::HUGEINT AS b, (o_orderkey * 100)::HUGEINT AS c FROM orders)")
def d11(spark, folder):
    """Unix form where all times fit unsigned seconds; else ticks, which need a precision of 100 ns."""
    o = read(spark, folder, "orders").selectExpr("o_orderkey", f"{_NS} AS a", f"CAST({_KEY} * 1000000007 AS DECIMAL(38,0)) AS b", f"CAST({_KEY} * 100 AS DECIMAL(38,0)) AS c")
    return o.selectExpr("o_orderkey", "CASE WHEN least(a, b, c) >= 0 AND greatest(a, b, c) < CAST(4294967296000000000 AS DECIMAL(38,0)) THEN 'unix' WHEN a % 100 = 0 AND b % 100 = 0 AND c % 100 = 0 THEN 'ticks' ELSE 'refused' END AS form")


@CATALOG.add("d12_local_offset", "SELECT o_orderkey, ((date_diff('second', TIMESTAMP '1970-01-01', timezone('Europe/Berlin', timezone('UTC', o_orderdate)))) - date_diff('second', TIMESTAMP '1970-01-01', o_orderdate))::BIGINT AS seconds_east FROM orders")
def d12(spark, folder):
    """Offset of a zone at an instant, from the engine's own zone rules."""
    t = F.col("o_orderdate").cast("timestamp")
    return read(spark, folder, "orders").select("o_orderkey", (F.unix_timestamp(F.from_utc_timestamp(t, "Europe/Berlin")) - F.unix_timestamp(t)).alias("seconds_east"))
