"""Positions of values in the order of their group, for columns of any number of distinct values.

Two passes over a range partitioning by group and value: totals of each partition, their running sums per group as a carry (one row a
partition and group), and running sums inside a partition joined with the carry. No sort or window holds a whole group: the largest is one
range partition, whose size the shuffle's settings bound, and a group that holds most rows is spread over many of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.scratch import materialize


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def join_on(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on ``names``, where null equals null."""
    if not names:
        return left.crossJoin(right)  # the right side is one row
    other = right.select(*(F.col(n).alias(f"_r_{n}") for n in names), *(c for c in right.columns if c not in names))
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names))
    return left.join(other, on).drop(*(f"_r_{n}" for n in names))


def positions(counts: DataFrame, keys: Sequence[str], v: str, weights: Sequence[str]) -> DataFrame:
    """``counts`` (one row a group and value) with, for each of ``weights``, ``before_<weight>``: its sum over the smaller values of the group.

    Nulls in ``keys`` are a group. Values must not be null; minus zero and zero are two values, so add 0.0 before.
    """
    ks = list(keys)
    rows = materialize(counts.repartitionByRange(*ks, v).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = rows.groupBy(*ks, "_part").agg(*(F.sum(w).alias(w) for w in weights))
    earlier = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    carry = totals.select(*ks, "_part", *(F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"_c_{w}") for w in weights))
    smaller = Window.partitionBy(*ks, "_part").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)  # one partition's rows
    own = rows.withColumns({f"_b_{w}": F.coalesce(F.sum(w).over(smaller), F.lit(0)) for w in weights})
    out = join_on(own, carry, [*ks, "_part"])
    return out.withColumns({f"before_{w}": F.col(f"_b_{w}") + F.col(f"_c_{w}") for w in weights}).select(*counts.columns, *(f"before_{w}" for w in weights))


def mean_ranks(counts: DataFrame, keys: Sequence[str], v: str, n: str = "_n") -> DataFrame:
    """``counts`` with ``rank``, the mean rank (from 1) of the rows that share a value."""
    return positions(counts, keys, v, [n]).withColumn("rank", F.col(f"before_{n}") + (F.col(n) + 1) / 2.0).drop(f"before_{n}")


def medians(rows: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Exact median of ``v`` per group (the mean of the middle two of an even number), null values left out."""
    ks = list(keys)
    counts = rows.where(F.col(v).isNotNull()).groupBy(*ks, (F.col(v) + 0.0).alias(v)).agg(F.count("*").alias("_n"))
    placed = positions(counts, ks, v, ["_n"])
    total = counts.groupBy(*ks).agg(F.sum("_n").alias("_total"))
    x = join_on(placed, total, ks)
    # zero-based places of the middle rows that this value covers
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    covers = lambda at: (F.col("before__n") <= at) & (at < F.col("before__n") + F.col("_n"))
    # halves of the two middle values, in either order
    part = F.when(covers(low), F.col(v) / 2).otherwise(0.0) + F.when(covers(high), F.col(v) / 2).otherwise(0.0)
    return x.where(covers(low) | covers(high)).groupBy(*ks).agg(F.sum(part).alias("median"))
