"""Tables side by side, one-hot columns, maps a key, checked ranges, unit vectors, titles, and itemsets by another algorithm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.functions import text as T
from orebed.operators import relational as R
from orebed.operators import sketches as K
from orebed.operators import stats as S
from orebed.plans import mining, streams
from orebed.plans.base import HISTORY, RATINGS, history, query, ratings, table
from orebed.sources import readers, writers
from orebed.storage import new_path


@query("bind_columns", """WITH a AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer), b AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier)
SELECT position, c_name, s_name FROM a FULL JOIN b USING (position)""")
def bind_columns(spark: SparkSession, sf: str) -> DataFrame:
    c, s = table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return R.bind_columns(c, ["c_custkey"], s, ["s_suppkey"]).select("position", "c_name", "s_name")


@query("one_hot", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS INTEGER) AS is_{s.lower()}" for s in "FOP") + " FROM orders")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", *((F.col("o_orderstatus") == s).cast("int").alias(f"is_{s.lower()}") for s in "FOP"))


@query("stars_map", f"""WITH {RATINGS}, g AS (SELECT business_id, stars, count(*) AS n FROM ratings GROUP BY ALL)
SELECT business_id, string_agg(stars || ':' || n, ' ' ORDER BY stars) AS counts, max(CASE WHEN stars = 5 THEN n END) AS fives FROM g GROUP BY 1""")
def stars_map(spark: SparkSession, sf: str) -> DataFrame:
    """A map from stars to reviews for each business, written out and looked up; keys are five at most."""
    g = ratings(spark, sf).groupBy("business_id", "stars").agg(F.count("*").alias("n"))
    m = g.groupBy("business_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stars", "n")))).alias("m"))
    shown = F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e.key.cast("string"), e.value.cast("string")))
    return m.select("business_id", F.array_join(shown, " ").alias("counts"), F.try_element_at("m", F.lit(5)).alias("fives"))


@query("history_range", f"WITH {HISTORY} SELECT country, day, confirmed FROM history WHERE country = 'NATION_3' AND day BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
def history_range(spark: SparkSession, sf: str) -> DataFrame:
    """A checked request: a country in any case, and days within those that the table has."""
    h = history(spark, sf)
    first, last = (str(x) for x in h.agg(F.min("day"), F.max("day")).first())
    known = [r.n_name for r in table(spark, sf, "nation").select("n_name").collect()]  # a row a nation
    country = R.check_choice(" nation_3", known, "country")
    start, end = R.check_range("1996-01-01", "1996-06-30", first, last)
    return h.where((F.col("country") == country) & F.col("day").between(start, end)).select("country", "day", "confirmed")


@query("unit_vectors", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum([pow(CAST(x AS DOUBLE), 2) FOR x IN embedding])), 7) + 0.0 AS first FROM embeddings")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", (F.round(F.get(S.unit(F.col("embedding")), 0), 7) + F.lit(0.0)).alias("first"))


@query("title_names", "SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') AS title FROM part")
def title_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.title_of_words(F.col("p_name")).alias("title"))


@query("pixel_grey", """WITH p AS (SELECT vec_id, i - 1 AS i, CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 1000) AS BIGINT) % 256 AS x FROM embeddings, range(1, 49) AS r(i))
SELECT vec_id, CAST(i // 3 AS INTEGER) AS pixel, CAST((i // 3) // 4 AS INTEGER) AS row, CAST((i // 3) % 4 AS INTEGER) AS col, CAST(round(sum(x * CASE i % 3 WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END), 4) AS DOUBLE) AS grey FROM p GROUP BY ALL""")
def pixel_grey(spark: SparkSession, sf: str) -> DataFrame:
    """Channels numbered in a row: the pixel, its place in an image four wide, and its grey."""
    p = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 48)).alias("i", "e"))
    x = F.floor(F.abs(F.col("e").cast("double")) * 1000) % 256
    weight = F.when(F.col("i") % 3 == 0, 0.299).when(F.col("i") % 3 == 1, 0.587).otherwise(0.114)
    p = p.select("vec_id", F.floor(F.col("i") / 3).cast("int").alias("pixel"), (x * weight).alias("g")).groupBy("vec_id", "pixel").agg(F.round(F.sum("g"), 4).alias("grey"))
    return p.select("vec_id", "pixel", F.floor(F.col("pixel") / 4).cast("int").alias("row"), (F.col("pixel") % 4).cast("int").alias("col"), "grey")


@query("scan_json_inferred", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_json_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines and read back with the types that the values show."""
    path = new_path(spark, "jsonl")
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.json(path)
    return readers.read_json_inferred(spark, path).select("s_suppkey", "s_name", "s_acctbal")


@query("scan_several_inputs", "SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region")
def scan_several_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Two folders of text read as one table."""
    paths = [new_path(spark, "text"), new_path(spark, "text")]
    for path, (name, column) in zip(paths, (("nation", "n_name"), ("region", "r_name")), strict=True):
        writers.write_text(table(spark, sf, name).select(F.col(column).alias("value")), "value", path)
    return spark.read.text(paths)


@query("fpgrowth_pairs", f"WITH {mining._BASKETS}, {mining._PAIRS} SELECT i || ',' || j AS items, n FROM f2")
def fpgrowth_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """MLlib's FP-growth over the same baskets: a check of the level-wise search by another algorithm."""
    from pyspark.ml.fpm import FPGrowth

    rows, support = mining.brand_baskets(spark, sf)
    baskets = rows.groupBy("key").agg(F.collect_set("item").alias("items"))
    n = baskets.count()
    found = FPGrowth(itemsCol="items", minSupport=(support - 0.5) / max(1, n)).fit(baskets).freqItemsets
    return found.where(F.size("items") == 2).select(F.array_join(F.array_sort("items"), ",").alias("items"), F.col("freq").alias("n"))


@query("fm_overall", f"WITH f AS ({streams._fm()}) SELECT sum(truth) AS truth, sum(estimate) AS estimate, round(sum(estimate) / sum(truth), 8) AS ratio FROM f")
def fm_overall(spark: SparkSession, sf: str) -> DataFrame:
    """All batches' estimates over all their true counts."""
    f = K.fm_estimate(streams.stream(spark, sf).select("batch", "id"))
    return f.agg(F.sum("truth").alias("truth"), F.sum("estimate").alias("estimate")).withColumn("ratio", F.round(F.col("estimate") / F.col("truth"), 8))


@query("exact_sample", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY (((c_custkey % 1000003) * 7919 + 23) * 104729 % 1000003), c_custkey) AS k, count(*) OVER () AS n FROM customer) WHERE k <= n // 10")
def exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the customers, exactly, by the rank of a hash over range partitions."""
    c = table(spark, sf, "customer").select("c_custkey")
    return K.exact_sample(c, "c_custkey", c.count() // 10, 23)
