"""Equality and difference of keyed sets by multiset fingerprints (SET-06, SET-07).

A group's fingerprint is the sum of 128 bits of hash of its items with their number, so it is added
up before the shuffle and does not depend on order.  Only groups whose fingerprints differ are
compared item by item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(items: DataFrame, group: str, item: str, name: str) -> DataFrame:
    """group and a struct ``name`` of the number of items and two sums; null items count as items."""
    part = lambda salt: F.sum(F.xxhash64(F.lit(salt), F.isnull(item), F.col(item)).cast("decimal(38,0)"))
    return items.groupBy(group).agg(F.struct(F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b")).alias(name))


def unequal_groups(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """Groups whose items are not the same on both sides, each as often; a group of one side only differs."""
    x = fingerprints(left, group, item, "_l").join(fingerprints(right, group, item, "_r"), group, "full_outer")
    return x.filter(~F.col("_l").eqNullSafe(F.col("_r"))).select(group)


def set_differences(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """SET-06: (group, item, side, n): how often more an item is on the side ``left`` or ``right``.

    Items of equal groups are not compared.
    """
    differ = unequal_groups(left, right, group, item)
    side = lambda df, n: df.select(group, item, F.lit(n).alias("_n")).join(differ, group, "left_semi")
    x = side(left, 1).union(side(right, -1)).groupBy(group, item).agg(F.sum("_n").cast("long").alias("_n")).filter("_n <> 0")
    return x.select(group, item, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("n"))


def uncovered(selected: DataFrame, covers: list[DataFrame], key: str) -> DataFrame:
    """SET-07: selected keys that none of the covers holds; one exchange of each, whatever their number."""
    marked = selected.select(key, F.lit(True).alias("_s"))
    for c in covers:
        marked = marked.union(c.select(key, F.lit(False)))
    return marked.groupBy(key).agg(F.bool_and("_s").alias("_s")).filter("_s").select(key)
