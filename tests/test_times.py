"""Stored times whose nanoseconds exceed 64 bits, against whole numbers."""

import pytest
from pyspark.sql import functions as F

from stowage.functions import times as T
from stowage.operators.times import QUERIES

KEYS = [0, 1, 6999, 7000, 7001, 8_000_000, 8_999_999, 9_300_000_000]


@pytest.fixture
def orders(spark, tmp_path):
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_record_choice_beyond_64_bits(spark, orders):
    def form(k):
        times = [(k - 7000) * 1234567891011, k * 1000000007, k * 100]
        if min(times) >= 0 and max(times) // 10**9 <= 4294967295:
            return "unix"
        return "refused" if any(t % 100 for t in times) else "ticks"

    assert {r.o_orderkey: r.form for r in QUERIES["d11_time_record_choice"](spark, orders).collect()} == {k: form(k) for k in KEYS}


def test_split_nanoseconds_beyond_64_bits(spark, orders):
    want = {k: divmod((k - 7000) * 1234567891011, 10**9) for k in KEYS}
    assert {r.o_orderkey: (r.seconds, r.nanoseconds) for r in QUERIES["d10_split_nanoseconds"](spark, orders).collect()} == want


def test_split_nanoseconds_just_before_a_second(spark):
    """A remainder that six digits of a quotient would round up."""
    ns = [10**9 - 28, -28, 1152409866999999972, -(10**18) - 1, 0]
    df = spark.createDataFrame([(str(x),) for x in ns], "ns string").select("ns", T.split_ns(F.col("ns").cast("decimal(38,0)")).alias("x"))
    assert {int(r.ns): (r.x.seconds, r.x.nanoseconds) for r in df.collect()} == {x: divmod(x, 10**9) for x in ns}
