"""Mixing sources to target weights with a low-discrepancy source schedule (native: no Python on the executors).

Golden-ratio points (i * K mod M) are mapped through the cumulative weights of the
sources; the slots that fall to a source are ranked, and slot r of a source draws block
r mod n of the n equal-token blocks of that source's shuffled documents. A source stops
when its target is reached (its last block is cut there), and the points go on until every
source has stopped. What a document gives, and where it first comes in the mix, is summed up from these slots alone.

A block has 256 words, or as many more as keep the schedule within 2**26 blocks.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last;
a null doc_id shuffles as the word 'null'; repeated rows are documents of their own;
sources without words have target 0; an empty table gives an empty result. Extra columns
are ignored, whatever their names. Weights and the repeat cap are positive integers.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Modulus and multiplier of the golden-ratio points: the odd number next to 2**31 / 1.618...
POINTS, STEP = 1 << 31, 1327217885
#: Points are found by equi-join on their high bits; documents are shuffled in so many hash buckets.
SHIFT, CHUNK = 20, 4096

_DEC = "decimal(38,0)"


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast(_DEC), b.cast(_DEC))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffle key, in one scan of the texts."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("shuffle"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """One row per source: sid, source, source_size, weight, target.

    Targets share the sum of all sizes by weight, stop at `repeats` times the source's size, and
    the excess is shared again by weight: water-filling over sources sorted by cap / weight.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("sid", F.row_number().over(order) - 1)
    w = F.array(*map(F.lit, weights))[F.col("sid") % len(weights)].cast("long")
    s = s.withColumn("weight", w).withColumn("cap", F.col("source_size") * repeats)
    rising = Window.orderBy(F.col("cap").cast(_DEC) * (F.lit(lcm(*weights)) / F.col("weight")).cast("long"), "sid")
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    s = s.select("*", F.sum("source_size").over(whole).alias("total"), F.sum("weight").over(whole).alias("all_weight"), so_far("cap").alias("cap_before"), so_far("weight").alias("weight_before"))
    fits = (F.col("total") - F.col("cap_before")).cast(_DEC) * F.col("weight") >= F.col("cap").cast(_DEC) * (F.col("all_weight") - F.col("weight_before"))
    s = s.withColumn("fits", fits.cast("int")).withColumn("capped", F.min("fits").over(rising.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(whole), F.lit(0))
    s = s.select("*", (F.col("total") - kept("cap")).alias("rest"), (F.col("all_weight") - kept("weight")).alias("rest_weight"))
    shared = (F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight")
    return s.select("sid", "source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def block_size(targets: DataFrame, least: int = 256, most_blocks: int = 1 << 26) -> int:
    """Words of a block."""
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    return max(least, -(-int(total) // most_blocks))


def _hits(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """slot, sid, chunk: the source into whose part of the cumulative weights each point falls."""
    points = points.select(F.col("id").alias("slot"), ((F.col("id") % POINTS) * STEP % POINTS).alias("x"))
    points = points.withColumn("high", F.expr(f"x >> {SHIFT}"))
    return points.join(ranges, "high").where("x >= lo and x < hi").select("slot", "sid", F.expr(f"slot div {CHUNK}").alias("chunk"))


def schedule(targets: DataFrame, block: int = 256) -> DataFrame:
    """One row per slot: slot (its order), sid, rank, epoch, block_no, words (that it takes from the block).

    The number of slots follows the sum of the targets; the number of sources is that of `targets`.
    """
    spark = targets.sparkSession
    s = targets.select("sid", "source_size", F.floor("target").cast("long").alias("want")).where("source_size > 0 and want > 0")
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    need = F.expr(f"(want div source_size) * blocks + (want % source_size + {block - 1}) div {block}")
    s = s.withColumn("need", need)
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("*", F.sum("need").over(upto).alias("upto"), F.sum("need").over(Window.partitionBy()).alias("all_need"))
    cutpoint = lambda x: _div(x * F.lit(POINTS).cast(_DEC), F.col("all_need")).cast("long")
    s = s.withColumn("lo", cutpoint(F.col("upto") - F.col("need"))).withColumn("hi", cutpoint(F.col("upto")))
    s = cut(s.select("sid", "source_size", "want", "blocks", "need", "lo", "hi"))
    past = s.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    ranges = cut(s.withColumn("high", F.explode(F.expr(f"sequence(lo >> {SHIFT}, (hi - 1) >> {SHIFT})"))).select("sid", "lo", "hi", "high"))
    hit = cut(_hits(spark.range(past), ranges))
    while True:  # gaps between the points shrink as their number grows, so each source gets its slots
        got = hit.groupBy("sid").agg(F.count("*").alias("got"))
        short = cut(s.join(got, "sid", "left").where("coalesce(got, 0) < need").select("sid"))
        if short.isEmpty():
            break
        hit = cut(hit.unionByName(_hits(spark.range(past, 2 * past + 64), ranges.join(short, "sid", "left_semi"))))
        past = 2 * past + 64
    counts = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("local", local).join(counts, ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("local")).alias("rank"))
    slots = ranked.join(s, "sid").where("rank < need")
    slots = slots.select("slot", "sid", "rank", F.expr("rank div blocks").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block_no"), "source_size", "want")
    start = F.col("epoch") * F.col("source_size") + F.col("block_no") * block
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block_no") * block)
    slots = slots.withColumn("whole", whole).withColumn("words", F.least(whole, F.col("want") - start))
    return slots.select("slot", "sid", "rank", "epoch", "block_no", "whole", "words")


def positions(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each document starts in its source's shuffled stream of words: sums of hash buckets, then within a bucket, so that a hot source is spread over many tasks."""
    d = sized.join(targets.select("sid", F.col("source").alias("at"), "source_size", "target"), F.col("source").eqNullSafe(F.col("at")))
    d = d.select("doc_id", "size", "shuffle", "sid", "source_size", "target", F.substring("shuffle", 1, 3).alias("bucket"))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return d.join(sums, ["sid", "bucket"]).withColumn("first", F.col("base") + F.col("before")).withColumn("row", F.monotonically_increasing_id())


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, block: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (the first slot that draws from the document, null if none) for every document."""
    sized = cut(sizes(docs))
    targets = cut(source_targets(sized, weights, repeats))
    block = block or block_size(targets)
    whole = F.col("words") == F.col("whole")
    slots = schedule(targets, block)
    draws = slots.groupBy("sid", "block_no").agg(F.sum(whole.cast("long")).alias("times"), F.sum(F.when(whole, 0).otherwise(F.col("words"))).alias("part"), F.min(F.when(whole, F.col("slot"))).alias("whole_slot"), F.min(F.when(~whole, F.col("slot"))).alias("part_slot"))
    d = cut(positions(sized, targets))
    per = d.where("size > 0").select("row", "sid", "first", "size", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("block_no"))
    per = per.join(draws, ["sid", "block_no"])
    begin, end, at = F.greatest(F.col("first"), F.col("block_no") * block), F.least(F.col("first") + F.col("size"), (F.col("block_no") + 1) * block), F.col("block_no") * block
    reached = F.greatest(F.lit(0), F.least(end, at + F.col("part")) - begin)
    first_slot = F.least("whole_slot", F.when(reached > 0, F.col("part_slot")))
    taken = per.groupBy("row").agg(F.sum(F.col("times") * (end - begin) + reached).alias("taken"), F.min(first_slot).alias("first_slot"))
    out = d.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("first_slot").cast("long").alias("first_slot"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, 'null')) AS shuffle FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
             coalesce(sum(cap) OVER r, 0) AS cap_before, coalesce(sum(weight) OVER r, 0) AS weight_before FROM w
      WINDOW r AS (ORDER BY cap * (10 // weight), sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(((total - cap_before) * weight >= cap * (all_weight - weight_before))::INT)
             OVER (ORDER BY cap * (10 // weight), sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS capped FROM o),
t AS (SELECT source, sid, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
             (weight * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)))::DOUBLE
             / (all_weight - coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0))::DOUBLE END AS target FROM f),
p AS (SELECT row_number() OVER () AS r, d.doc_id, d.size, t.sid, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY t.sid ORDER BY d.shuffle, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT greatest(256, ceil(coalesce(sum(size), 0) / 67108864))::BIGINT AS block FROM d),
k AS (SELECT sid, source_size::BIGINT AS source_size, floor(target)::BIGINT AS want, block, (source_size::BIGINT + block - 1) // block AS blocks FROM t, b WHERE source_size > 0 AND target >= 1),
q AS (SELECT *, (want // source_size) * blocks + (want % source_size + block - 1) // block AS need FROM k),
u AS (SELECT *, sum(need) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(need) OVER () AS all_need FROM q),
g AS (SELECT *, (upto - need) * 2147483648 // all_need AS lo, upto * 2147483648 // all_need AS hi FROM u),
x AS (SELECT i AS slot, (i % 2147483648) * 1327217885 % 2147483648 AS x FROM (SELECT unnest(range(0, (SELECT 8 * sum(need) + 64 FROM q)::BIGINT)) AS i)),
h AS (SELECT slot, g.*, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM x JOIN g ON x.x >= lo AND x.x < hi QUALIFY rank < need),
z AS (SELECT slot, sid, rank % blocks AS block_no, least(block, source_size - (rank % blocks) * block) AS whole,
             least(block, source_size - (rank % blocks) * block, want - (rank // blocks) * source_size - (rank % blocks) * block) AS words FROM h),
y AS (SELECT sid, block_no, sum((words = whole)::INT) AS times, sum(CASE WHEN words < whole THEN words ELSE 0 END) AS part,
             min(CASE WHEN words = whole THEN slot END) AS whole_slot, min(CASE WHEN words < whole THEN slot END) AS part_slot FROM z GROUP BY sid, block_no),
e AS (SELECT r, sid, block_no, greatest(first, block_no * block) AS lo, least(first + size, (block_no + 1) * block) AS hi, block_no * block AS origin
      FROM (SELECT r, sid, first, size, block, unnest(range(first // block, (first + size - 1) // block + 1)) AS block_no FROM p, b WHERE size > 0)),
w2 AS (SELECT r, sum(times * (hi - lo) + greatest(0, least(hi, origin + part) - lo)) AS taken,
              min(least(whole_slot, CASE WHEN least(hi, origin + part) > lo THEN part_slot END)) AS first_slot
       FROM e JOIN y USING (sid, block_no) GROUP BY r)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot
FROM p LEFT JOIN w2 USING (r)
"""
