"""Running totals in buckets against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from stowage.operators.ordering import ranked
from stowage.operators.running import running


def test_running(spark):
    r = random.Random(1)
    order = r.sample(range(-500, 5000), 600)
    df = spark.createDataFrame([("hot" if k % 3 else f"k{k % 7}", o, r.randrange(9)) for k, o in enumerate(order)], "key string, o long, v long")
    for before in (False, True):
        got = running(df, ["key"], "o", {"total": F.col("v"), "n": F.lit(1)}, width=16, before=before)
        w = Window.partitionBy("key").orderBy("o").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        want = df.select("key", "o", "v", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("total"), F.coalesce(F.count("*").over(w), F.lit(0)).alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ranked(spark):
    df = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("s"))
    got = [r.s for r in ranked(df, [F.col("s")], "place", 5).orderBy("place").collect()]
    assert got == sorted(r.s for r in df.collect())
