"""Running totals that a hot key does not bring into one task.

A key's rows are cut into buckets of `width` order values. Totals of buckets are pre-aggregated and added up
(one row a bucket), and only the rows of one bucket are ordered together. Buckets come from the order
value itself, so the result does not depend on partitioning, and a lost executor recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], order: str, totals: dict[str, Column], width: int = 4096, before: bool = False) -> DataFrame:
    """df with inclusive (or, with before=True, exclusive) running sums of `totals` for each key in the order of an integer column without repeats in a key."""
    d = df.select("*", F.floor(F.col(order) / width).alias("_bucket"), *(v.alias(f"_{k}") for k, v in totals.items()))
    at = [*keys, "_bucket"]
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*at).agg(*(F.sum(f"_{k}").alias(k) for k in totals))
    base = base.select(*at, *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_base_{k}") for k in totals))
    inside = Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    d = d.select("*", *(F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)).alias(f"_own_{k}") for k in totals))
    out = d.join(base, at)
    return out.select(*df.columns, *((F.col(f"_base_{k}") + F.col(f"_own_{k}")).alias(k) for k in totals))

