"""Volume sets: folding, order checks, gaps, continuation checks, incomplete members, arriving volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..sources.tables import fragments
from .running import running

CATALOG = Catalog()
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


def _by_set():
    return Window.partitionBy("set_id").orderBy("volume")


def runs(f: DataFrame) -> DataFrame:
    """`run` numbers the stretches of consecutive volumes of a set (gaps and islands)."""
    return f.withColumn("run", F.col("volume") - F.row_number().over(_by_set()))


def fold(f: DataFrame) -> DataFrame:
    """Runs of consecutive volumes of a set are one logical member: packed sizes are summed, the split flag comes from the last fragment."""
    g = runs(f).groupBy("set_id", "run").agg(F.min("volume").alias("first_volume"), F.max("volume").alias("last_volume"), F.count("*").alias("fragments"), F.sum("packed_size").alias("packed_size"))
    return g.select("set_id", "first_volume", "last_volume", "fragments", "packed_size", (F.col("last_volume") < F.max("last_volume").over(Window.partitionBy("set_id"))).alias("split_after"))


_RUNS = "(SELECT *, volume - row_number() OVER (PARTITION BY set_id ORDER BY volume) AS run FROM {fragments})"
_FOLD = f"(SELECT set_id, run, min(volume) AS first_volume, max(volume) AS last_volume, count(*) AS fragments, sum(packed_size)::BIGINT AS packed_size FROM {_RUNS} GROUP BY set_id, run)"


@CATALOG.add("a02_volume_set_fold", f"SELECT set_id, first_volume, last_volume, fragments, packed_size, last_volume < max(last_volume) OVER (PARTITION BY set_id) AS split_after FROM {_FOLD}")
def a02(spark, folder):
    return fold(fragments(spark, folder))


@CATALOG.add("w02_volume_order_check", "SELECT set_id, volume, volume = min(volume) OVER (PARTITION BY set_id) + row_number() OVER (PARTITION BY set_id ORDER BY volume) - 1 AS in_order FROM {fragments}")
def w02(spark, folder):
    """Format 5+: a volume's number is the first number plus its place."""
    return fragments(spark, folder).select("set_id", "volume", (F.col("volume") == F.first("volume").over(_by_set()) + F.row_number().over(_by_set()) - 1).alias("in_order"))


@CATALOG.add("w03_volume_number_check", "SELECT set_id, volume, n IS NULL OR coalesce(prev IS NULL OR n = (prev + 1) % 65536, true) AS in_order FROM (SELECT set_id, volume, n, lag(n) OVER (PARTITION BY set_id ORDER BY volume) AS prev FROM (SELECT set_id, volume, CASE WHEN packed_size % 7 = 0 THEN NULL ELSE (volume + 65530) % 65536 END AS n FROM {fragments}))")
def w03(spark, folder):
    """Format 3: numbers run modulo 65536; volumes without a number are allowed."""
    f = fragments(spark, folder).withColumn("n", F.expr("CASE WHEN packed_size % 7 = 0 THEN NULL ELSE (volume + 65530) % 65536 END"))
    prev = F.lag("n").over(_by_set())
    return f.select("set_id", "volume", F.coalesce(F.col("n").isNull() | prev.isNull() | (F.col("n") == (prev + 1) % 65536), F.lit(True)).alias("in_order"))


@CATALOG.add("w04_gap_split", f"SELECT set_id, first_volume, last_volume, lag(last_volume) OVER w + 1 AS missing_from, CASE WHEN lag(last_volume) OVER w IS NOT NULL THEN first_volume - 1 END AS missing_to FROM {_FOLD} WINDOW w AS (PARTITION BY set_id ORDER BY first_volume)")
def w04(spark, folder):
    """Runs of consecutive volumes, with the first and last number missing before each."""
    g = runs(fragments(spark, folder)).groupBy("set_id", "run").agg(F.min("volume").alias("first_volume"), F.max("volume").alias("last_volume"))
    before = F.lag("last_volume").over(Window.partitionBy("set_id").orderBy("first_volume"))
    return g.select("set_id", "first_volume", "last_volume", (before + 1).alias("missing_from"), F.when(before.isNotNull(), F.col("first_volume") - 1).alias("missing_to"))


@CATALOG.add("w05_incomplete_members", f"SELECT set_id, first_volume, CASE WHEN first_volume > lo AND last_volume < hi THEN 'both' WHEN first_volume > lo THEN 'start' ELSE 'end' END AS missing FROM (SELECT *, min(first_volume) OVER (PARTITION BY set_id) AS lo, max(last_volume) OVER (PARTITION BY set_id) AS hi FROM {_FOLD}) WHERE first_volume > lo OR last_volume < hi")
def w05(spark, folder):
    """Members whose start or end lies in a missing volume."""
    s = Window.partitionBy("set_id")
    g = fold(fragments(spark, folder)).withColumn("lo", F.min("first_volume").over(s)).withColumn("hi", F.max("last_volume").over(s))
    start, end = F.col("first_volume") > F.col("lo"), F.col("last_volume") < F.col("hi")
    return g.where(start | end).select("set_id", "first_volume", F.when(start & end, "both").when(start, "start").otherwise("end").alias("missing"))


@CATALOG.add("x12_salvage_remainder", f"SELECT set_id, first_volume, last_volume, packed_size FROM (SELECT *, min(first_volume) OVER (PARTITION BY set_id) AS lo, max(last_volume) OVER (PARTITION BY set_id) AS hi FROM {_FOLD}) WHERE first_volume = lo AND last_volume = hi")
def x12(spark, folder):
    """What is left after incomplete members are dropped."""
    g, bad = fold(fragments(spark, folder)), w05(spark, folder).select("set_id", "first_volume")
    return g.join(bad, ["set_id", "first_volume"], "left_anti").select("set_id", "first_volume", "last_volume", "packed_size")


@CATALOG.add("j07_continuation_match", "SELECT a.set_id, a.volume, b.volume IS NOT NULL AS has_next, coalesce(a.role = b.role, false) AS same_kind, b.packed_size IS NOT DISTINCT FROM a.packed_size AS same_size FROM {fragments} a LEFT JOIN {fragments} b ON a.set_id = b.set_id AND b.volume = a.volume + 1")
def j07(spark, folder):
    """A continuation in the next volume must agree with the fragment before it."""
    a = fragments(spark, folder).alias("a")
    b = fragments(spark, folder).alias("b")
    j = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("b.volume") == F.col("a.volume") + 1), "left")
    return j.select("a.set_id", "a.volume", F.col("b.volume").isNotNull().alias("has_next"), F.coalesce(F.col("a.role") == F.col("b.role"), F.lit(False)).alias("same_kind"), F.col("b.packed_size").eqNullSafe(F.col("a.packed_size")).alias("same_size"))


@CATALOG.add("u04_volume_set_union", "SELECT set_id, count(*) AS volumes, count(DISTINCT role) = 1 AS one_family, string_agg(volume::VARCHAR, ',' ORDER BY volume) AS volumes_in_order FROM {fragments} GROUP BY set_id")
def u04(spark, folder):
    """Volumes of a set in order; a set must be of one family."""
    g = fragments(spark, folder).groupBy("set_id").agg(F.count("*").alias("volumes"), (F.count_distinct("role") == 1).alias("one_family"), F.array_sort(F.collect_list("volume")).alias("v"))
    return g.select("set_id", "volumes", "one_family", F.array_join("v", ",").alias("volumes_in_order"))


@CATALOG.add("j04_multi_read_on_set", f"SELECT a.set_id, a.pos, b.packed_size FROM (SELECT DISTINCT set_id, unnest([0, 1, 0]) AS want, unnest([0, 1, 2]) AS pos FROM {{fragments}}) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY first_volume) - 1 AS i FROM {_FOLD}) b ON a.set_id = b.set_id AND a.want = b.i")
def j04(spark, folder):
    """Logical members of a set by a list of indices: order and repeats are kept, missing ones are null."""
    f = fragments(spark, folder)
    asked = f.select("set_id").distinct().select("set_id", F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(0))).alias("pos", "i"))
    m = fold(f).withColumn("i", F.row_number().over(Window.partitionBy("set_id").orderBy("first_volume")) - 1)
    return asked.join(m.select("set_id", "i", "packed_size"), ["set_id", "i"], "left").select("set_id", "pos", "packed_size")


@CATALOG.add("j16_set_member_by_index", f"SELECT set_id, packed_size FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY first_volume) - 1 AS i FROM {_FOLD}) WHERE i = 1")
def j16(spark, folder):
    m = fold(fragments(spark, folder)).withColumn("i", F.row_number().over(Window.partitionBy("set_id").orderBy("first_volume")) - 1)
    return m.where("i = 1").select("set_id", "packed_size")


@CATALOG.add("w14_volume_split", "SELECT archive, member_index, v AS volume, least(e, (v + 1) * 20000) - greatest(s, v * 20000) AS bytes, s < v * 20000 AS split_before, e > (v + 1) * 20000 AS split_after FROM (SELECT archive, member_index, s, e, unnest(range((s // 20000)::BIGINT, ((e - 1) // 20000 + 1)::BIGINT)) AS v FROM (SELECT archive, member_index, (sum(packed_size) OVER w - packed_size)::BIGINT AS s, (sum(packed_size) OVER w)::BIGINT AS e FROM {members} WHERE packed_size > 0 WINDOW w AS (PARTITION BY archive ORDER BY member_index)))")
def w14(spark, folder):
    """Packed members of an archive cut into volumes of 20,000 bytes."""
    from ..sources.tables import members

    size = 20000
    m = running(members(spark, folder).where("packed_size > 0"), ["archive"], "member_index", {"e": F.col("packed_size")})
    m = m.select("archive", "member_index", (F.col("e") - F.col("packed_size")).alias("s"), "e")
    m = m.withColumn("volume", F.explode(F.expr(f"sequence(s div {size}, (e - 1) div {size})")))
    lo, hi = F.col("volume") * size, (F.col("volume") + 1) * size
    return m.select("archive", "member_index", "volume", (F.least("e", hi) - F.greatest("s", lo)).alias("bytes"), (F.col("s") < lo).alias("split_before"), (F.col("e") > hi).alias("split_after"))
