"""Joins, windows and aggregates that the queries share; plans for Catalyst, lazy but for ranges written once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.storage import materialize


def top(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n most frequent keys, ties by key: one partial aggregate and a take-ordered."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)


def forward_fill(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """`value` carried forward over nulls in each partition."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Null-aware NOT IN: no rows at all if `other` has a null key, none for a null key of df unless `other` is empty."""
    spark = df.sparkSession
    return spark.sql(f"SELECT * FROM {{a}} WHERE {key} NOT IN (SELECT {other_key} FROM {{b}})", a=df, b=other)


def missing_keys(fact: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows of fact whose non-null key has no row in dim: what a foreign key would forbid."""
    return fact.where(F.col(key).isNotNull()).join(dim, F.col(key) == F.col(dim_key), "left_anti")


def any_token(names: Column, keywords: list[str]) -> Column:
    """Whether a space-separated token of a name equals one of the keywords, in any case."""
    return F.arrays_overlap(F.split(F.lower(names), " "), F.array(*(F.lit(k.lower()) for k in keywords)))


def first_or_last_token(names: Column, keywords: list[str]) -> Column:
    """LIKE '% kw' or LIKE 'kw %', in any case, for any of the keywords."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.lower(names).like(f"% {k.lower()}") | F.lower(names).like(f"{k.lower()} %")
    return out


def _ranges(df: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """df with `_part`, its range partition by (group, order), written once so that every reader sees the same ranges."""
    return materialize(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "index") -> DataFrame:
    """df with each row's 0-based position by `order` in its group, without sorting a group in one task.

    Rows are range-partitioned, counted by partition, and numbered within; only the partitions' counts, one row
    each, meet in one window. Rows that tie in `order` get positions in no certain order.
    """
    group = group or []
    rows = _ranges(df, order, group)
    sizes = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    out = rows.join(before, [*group, "_part"]).withColumn(name, (at + F.col("_before")).cast("long"))
    return out.select(*df.columns, name)


def totals_below(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """df, of one row a key, with v_below for each of `values`: its sum over smaller keys, without one task for all."""
    rows = _ranges(df, [key], [])
    sums = rows.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    within = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    below = [(F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"_{v}")).alias(f"{v}_below") for v in values]
    return rows.join(before, "_part").select(*df.columns, *below)


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """(key, index): 0-based positions of the distinct keys in order, without sorting all in one task."""
    return numbered(df.select(key).distinct(), [key])


def bind_columns(a: DataFrame, by_a: list[str], b: DataFrame, by_b: list[str]) -> DataFrame:
    """The columns of two tables side by side, row by row in the orders given; rows without a partner stay, with nulls."""
    one, two = numbered(a, by_a, name="position"), numbered(b, by_b, name="position")
    return one.join(two, "position", "full")


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, value): exact quantiles, linear between neighbours, from positions over range partitions; null values are left out."""
    rows = numbered(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v")), ["_v"])
    n = rows.agg(F.count("*").alias("n"))
    wanted = n.select("n", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    wanted = wanted.select("share", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("index"))
    hit = rows.join(F.broadcast(wanted), "index")  # two rows a share
    low, high = F.min_by("_v", "index"), F.max_by("_v", "index")
    return hit.groupBy("share").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("value"))


def check_range(start: str, end: str, first: str, last: str) -> tuple[str, str]:
    """The ISO days of a range if it is one and lies within [first, last]; else ValueError says what is wrong."""
    try:
        days = [date.fromisoformat(x) for x in (start, end, first, last)]
    except ValueError as e:
        raise ValueError(f"not a day: {e}") from None
    if days[0] > days[1]:
        raise ValueError(f"the range starts on {start}, after its end {end}")
    if days[0] < days[2] or days[1] > days[3]:
        raise ValueError(f"{start} to {end} is not within {first} to {last}")
    return start, end


def check_choice(value: str, choices: list[str], what: str) -> str:
    """The one of `choices` that equals `value` in any case; else ValueError names them."""
    found = [c for c in choices if c.lower() == value.strip().lower()]
    if not found:
        raise ValueError(f"unknown {what} {value!r}; known are {', '.join(choices)}")
    return found[0]


def head_by_group(group: str, order: list[str], n: int) -> Column:
    """Whether a row is among the first n of its group."""
    return F.row_number().over(Window.partitionBy(group).orderBy(*order)) <= n


def sliding_windows(text: Column, width: int) -> Column:
    """All substrings of `width` characters, in order."""
    n = F.length(text) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def arithmetic_hash(key: Column, seed: int, modulus: int = 1_000_003) -> Column:
    """A spread-out value of an integer key, the same in any SQL engine; for repeatable samples and folds."""
    return (F.pmod(key.cast("long"), F.lit(modulus)) * 7919 + seed) * 104729 % modulus
