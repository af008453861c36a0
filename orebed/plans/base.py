"""Registration of queries, and the logical datasets that they read from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a (spark, sf_dir) function under `name`, with the SQL that it must agree with."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews: user_id, business_id, stars (1 to 5), dt; a user may rate a business many times."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("dt"))
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("business_id"), (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("stars"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("user_id", "business_id", "stars", "dt")


RATINGS = "ratings AS (SELECT o_custkey AS user_id, l_suppkey AS business_id, 1 + CAST(l_quantity AS INTEGER) % 5 AS stars, o_orderdate AS dt FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """One rating a (user, business): the mean of its reviews."""
    return ratings(spark, sf).groupBy("user_id", "business_id").agg(F.avg("stars").alias("rating"))


RATED = RATINGS + ", rated AS (SELECT user_id, business_id, avg(stars) AS rating FROM ratings GROUP BY ALL)"


def businesses(spark: SparkSession, sf: str) -> DataFrame:
    """business_id and city."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("business_id"), F.col("n_name").alias("city"))


BUSINESSES = "businesses AS (SELECT s_suppkey AS business_id, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Country, day and three counts a day: orders by status stand for confirmed, recovered and deaths."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    daily = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.to_date("o_orderdate").alias("day"))
    daily = daily.agg(*(F.count_if(F.col("o_orderstatus") == s).alias(m) for s, m in (("O", "confirmed"), ("F", "recovered"), ("P", "deaths"))))
    return daily.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("country", "day", "confirmed", "recovered", "deaths")


HISTORY = """history AS (SELECT n_name AS country, CAST(o_orderdate AS DATE) AS day,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS confirmed, count(*) FILTER (WHERE o_orderstatus = 'F') AS recovered,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS deaths
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def countries(spark: SparkSession, sf: str) -> DataFrame:
    """country and continent."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("continent"))


COUNTRIES = "countries AS (SELECT n_name AS country, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey)"
