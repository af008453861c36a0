"""Frequent itemsets by levels: exact global counts, no driver-side candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.storage import materialize


def baskets(df: DataFrame, key: str, item: str, more_than: int = 0) -> DataFrame:
    """Distinct (key, item) rows of the keys that hold more than `more_than` items (strictly)."""
    rows = df.select(F.col(key).alias("key"), F.col(item).alias("item")).where("key IS NOT NULL AND item IS NOT NULL").distinct()
    if more_than <= 0:
        return rows
    big = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("key")
    return rows.join(big, "key", "left_semi")


def next_level(rows: DataFrame, level: DataFrame, support: Column | int) -> DataFrame:
    """Itemsets one larger than those of `level` (items, n) with at least `support` baskets.

    Every basket's sets of the last level are extended by a larger frequent item; since all subsets of a
    frequent set are frequent, both sides are pruned before the join.
    """
    wide = level.select("items")
    first = wide.withColumn("last", F.element_at("items", -1))
    carriers = first.join(rows.withColumnRenamed("item", "last"), "last")
    size = level.select(F.size("items").alias("k")).first()
    for j in range((size[0] if size else 1) - 1):
        carriers = carriers.withColumn("need", F.get("items", j)).join(rows.withColumnRenamed("item", "need"), ["key", "need"], "left_semi").drop("need")
    grown = carriers.join(rows, "key").where("item > last").select("key", F.concat("items", F.array("item")).alias("items"))
    return grown.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def frequent_itemsets(rows: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """(items, n): all itemsets in at least `support` baskets, items in order.

    Baskets are cut to frequent items first. Each level is written once; the loop ends at the first empty one.
    """
    single = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    rows = materialize(rows.join(single.select("item"), "item", "left_semi").select("key", "item"), "baskets")
    levels = [materialize(single.select(F.array("item").alias("items"), "n"), "level")]
    while (max_size is None or len(levels) < max_size) and not levels[-1].isEmpty():
        levels.append(materialize(next_level(rows, levels[-1], support), "level"))
    return reduce(DataFrame.unionByName, levels)


def report(itemsets: DataFrame) -> DataFrame:
    """One line a size, in order: the sets as ('a', 'b'), sorted and joined by commas."""
    shown = itemsets.select(F.size("items").alias("size"), F.col("items"), F.concat(F.lit("("), F.array_join(F.transform("items", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", "), F.lit(")")).alias("text"))
    lines = shown.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("items", "text"))).alias("s"))
    return lines.select("size", F.array_join(F.col("s.text"), ",").alias("line"))
