"""Text index, itemsets, similar items and recommendations on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.functions import text as T
from orebed.operators import itemsets as I
from orebed.operators import recommend as C
from orebed.operators import relational as R
from orebed.operators import similarity as S
from orebed.plans.base import RATED, RATINGS, query, rated, ratings, table

_TOKENS = f"""t AS (SELECT conv_id, turn, unnest(flatten([CASE WHEN regexp_full_match(regexp_replace(x, '[,.]$', ''), '[0-9]+') THEN [regexp_replace(x, '[,.]$', '')]
  ELSE regexp_split_to_array(x, '[^{T.TOKEN_CHARS}]+') END FOR x IN string_split(replace(replace(text, chr(10), ''), chr(9), ''), ' ')])) AS token FROM conversations),
tokens AS (SELECT * FROM t WHERE token <> '')"""


def conversation_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(T.tokens(F.col("text"))).alias("token"))


@query("tokenize", f"WITH {_TOKENS} SELECT conv_id, turn, token, count(*) AS n FROM tokens GROUP BY ALL")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_tokens(spark, sf).groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))


@query("inverted_index", f"WITH {_TOKENS} SELECT DISTINCT token, conv_id AS which, turn AS place FROM tokens")
def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_tokens(spark, sf).select("token", F.col("conv_id").alias("which"), F.col("turn").alias("place")).distinct()


@query("index_search", f"""WITH {_TOKENS}, p AS (SELECT DISTINCT token, conv_id AS which, turn AS place FROM tokens), q AS (SELECT unnest(['und', 'thation', 'Nowhere']) AS word)
SELECT DISTINCT which, place, c.text AS found FROM q JOIN p ON word = token JOIN conversations c ON which = conv_id AND place = turn
UNION ALL SELECT NULL, NULL, 'No such tokens: ' || word FROM q WHERE word NOT IN (SELECT token FROM p)""")
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """OR over keywords, elements once each; a line for each word that no element holds."""
    words = spark.range(1).select(F.explode(F.array(F.lit("und"), F.lit("thation"), F.lit("Nowhere"))).alias("token"))
    hits = words.join(inverted_index(spark, sf), "token", "left")
    docs = table(spark, sf, "conversations").select(F.col("conv_id").alias("which"), F.col("turn").alias("place"), F.col("text").alias("found"))
    misses = hits.where("which IS NULL").select("which", "place", F.concat(F.lit("No such tokens: "), "token").alias("found"))
    return hits.where("which IS NOT NULL").select("which", "place").distinct().join(docs, ["which", "place"]).unionByName(misses)


@query("baskets", f"WITH {RATINGS}, d AS (SELECT DISTINCT user_id, business_id FROM ratings) SELECT user_id, string_agg(business_id, ',' ORDER BY business_id) AS items FROM d GROUP BY 1")
def baskets(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.baskets(ratings(spark, sf), "user_id", "business_id")
    return rows.groupBy(F.col("key").alias("user_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda x: x.cast("string")), ",").alias("items"))


@query("basket_filter", f"WITH {RATINGS} SELECT user_id, count(DISTINCT business_id) AS n FROM ratings GROUP BY 1 HAVING count(DISTINCT business_id) > 35")
def basket_filter(spark: SparkSession, sf: str) -> DataFrame:
    return I.baskets(ratings(spark, sf), "user_id", "business_id", more_than=35).groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("n"))


@query("basket_key", """WITH q AS (SELECT o_orderkey, '"' || month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) || '"' AS d, '"000' || o_custkey || '"' AS c FROM orders)
SELECT o_orderkey, trim(d, '"')[:length(trim(d, '"')) - 4] || right(trim(d, '"'), 2) || '-' || trim(c, '"') AS key, ltrim(trim(c, '"'), '0') AS product FROM q""")
def basket_key(spark: SparkSession, sf: str) -> DataFrame:
    """Text keys as `M/D/YY-customer`, made from quoted fields; leading zeros leave the product only."""
    o = table(spark, sf, "orders")
    d = F.concat(F.lit('"'), F.date_format("o_orderdate", "M/d/yyyy"), F.lit('"'))
    q = o.select("o_orderkey", F.btrim(d, F.lit('"')).alias("d"), F.btrim(F.concat(F.lit('"000'), F.col("o_custkey").cast("string"), F.lit('"')), F.lit('"')).alias("c"))
    short = F.concat(F.substr("d", F.lit(1), F.length("d") - 4), F.right("d", F.lit(2)))
    return q.select("o_orderkey", F.concat(short, F.lit("-"), "c").alias("key"), F.ltrim("c", F.lit("0")).alias("product"))


#: Share of the baskets that an itemset has to be in.
SUPPORT = 0.0021

_BASKETS = "b AS (SELECT DISTINCT l_orderkey AS key, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT CAST(ceil(0.0021 * count(DISTINCT key)) AS BIGINT) AS support FROM b)"
_SINGLES = "f1 AS (SELECT item, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= (SELECT support FROM s))"
_PAIRS = "f2 AS (SELECT x.item AS i, y.item AS j, count(*) AS n FROM b x JOIN b y ON x.key = y.key AND x.item < y.item GROUP BY ALL HAVING count(*) >= (SELECT support FROM s))"
_TRIPLES = "f3 AS (SELECT x.item AS i, y.item AS j, z.item AS k, count(*) AS n FROM b x JOIN b y ON x.key = y.key AND x.item < y.item JOIN b z ON y.key = z.key AND y.item < z.item GROUP BY ALL HAVING count(*) >= (SELECT support FROM s))"


def brand_baskets(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Orders and the brands in them, and the support that is asked for."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    rows = I.baskets(li.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand")
    n = li.select("l_orderkey").distinct().count()
    return rows, -int(-SUPPORT * n // 1)


@query("frequent_items", f"WITH {_BASKETS}, {_SINGLES} SELECT item, n FROM f1")
def frequent_items(spark: SparkSession, sf: str) -> DataFrame:
    return I.frequent_itemsets(*brand_baskets(spark, sf), max_size=1).select(F.get("items", 0).alias("item"), "n")


@query("frequent_pairs", f"WITH {_BASKETS}, {_PAIRS} SELECT i || ',' || j AS items, n FROM f2")
def frequent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return I.frequent_itemsets(*brand_baskets(spark, sf), max_size=2).where(F.size("items") == 2).select(F.array_join("items", ",").alias("items"), "n")


@query("frequent_triples", f"WITH {_BASKETS}, {_TRIPLES} SELECT i || ',' || j || ',' || k AS items, n FROM f3")
def frequent_triples(spark: SparkSession, sf: str) -> DataFrame:
    return I.frequent_itemsets(*brand_baskets(spark, sf), max_size=3).where(F.size("items") == 3).select(F.array_join("items", ",").alias("items"), "n")


@query("itemset_report", f"""WITH {_BASKETS}, {_SINGLES}, {_PAIRS}, {_TRIPLES}
SELECT CAST(1 AS INTEGER) AS size, string_agg('(''' || item || ''')', ',' ORDER BY item) AS line FROM f1 UNION ALL
SELECT 2, string_agg('(''' || i || ''', ''' || j || ''')', ',' ORDER BY i, j) FROM f2 UNION ALL
SELECT 3, string_agg('(''' || i || ''', ''' || j || ''', ''' || k || ''')', ',' ORDER BY i, j, k) FROM f3""")
def itemset_report(spark: SparkSession, sf: str) -> DataFrame:
    return I.report(I.frequent_itemsets(*brand_baskets(spark, sf), max_size=3))


def rater_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (key: user, item: business)."""
    return I.baskets(ratings(spark, sf), "user_id", "business_id")


def _signatures(spark: SparkSession, sf: str) -> DataFrame:
    rows = rater_rows(spark, sf)
    index = R.dense_index(rows, "key").withColumnRenamed("index", "u")
    return S.signatures(rows.join(index, "key").select("item", "u"), rows.select("key").distinct().count())


_SIGNED = f"""{RATINGS}, r AS (SELECT DISTINCT user_id, business_id FROM ratings), ix AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS u, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM r)),
sig AS (SELECT business_id, i, min((i * i * u + 5 * (i + 1) + 13) % n) AS h FROM r JOIN ix USING (user_id), range({S.HASHES}) AS g(i) GROUP BY ALL)"""


@query("minhash_signatures", f"WITH {_SIGNED} SELECT business_id, string_agg(h, ',' ORDER BY i) AS sig FROM sig GROUP BY 1")
def minhash_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return _signatures(spark, sf).select(F.col("item").alias("business_id"), F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("sig"))


_BANDED = _SIGNED + ", bands AS (SELECT business_id, i // 2 AS band, string_agg(h, ',' ORDER BY i) AS part FROM sig GROUP BY ALL), cand AS (SELECT DISTINCT x.business_id AS a, y.business_id AS b FROM bands x JOIN bands y USING (band, part) WHERE x.business_id < y.business_id)"


@query("lsh_candidates", f"WITH {_BANDED} SELECT a, b FROM cand")
def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return S.lsh_candidates(_signatures(spark, sf))


_JACCARD = "z AS (SELECT business_id, count(*) AS n FROM r GROUP BY 1), c AS (SELECT x.business_id AS a, y.business_id AS b, count(*) AS n FROM r x JOIN r y USING (user_id) WHERE x.business_id < y.business_id GROUP BY ALL), jac AS (SELECT a, b, round(c.n / (p.n + q.n - c.n), 8) AS similarity FROM c JOIN z p ON a = p.business_id JOIN z q ON b = q.business_id)"

#: Least similarity of similar items.
SIMILAR = 0.22


@query("lsh_similar_items", f"WITH {_BANDED}, {_JACCARD} SELECT a, b, similarity FROM jac JOIN cand USING (a, b) WHERE similarity >= 0.22")
def lsh_similar_items(spark: SparkSession, sf: str) -> DataFrame:
    return S.jaccard(rater_rows(spark, sf), SIMILAR, lsh_candidates(spark, sf))


@query("jaccard_pairs", f"WITH {RATINGS}, r AS (SELECT DISTINCT user_id, business_id FROM ratings), {_JACCARD} SELECT a, b, similarity FROM jac WHERE similarity >= 0.22")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.jaccard(rater_rows(spark, sf), SIMILAR)


def _sims(train: str) -> str:
    return f"""im AS (SELECT business_id, avg(rating) AS mean FROM {train} GROUP BY 1), dv AS (SELECT user_id, business_id, rating - mean AS x FROM {train} JOIN im USING (business_id)),
ss AS (SELECT p.business_id AS a, q.business_id AS b, sum(p.x * q.x) AS n, sum(p.x * p.x) AS p, sum(q.x * q.x) AS q FROM dv p JOIN dv q USING (user_id) WHERE p.business_id < q.business_id GROUP BY ALL),
sims AS (SELECT a, b, CASE WHEN p * q > 1e-18 THEN n / sqrt(p * q) WHEN abs(n) < 1e-9 THEN 1.0 ELSE -1.0 END AS weight FROM ss)"""


@query("item_similarity", f"WITH {RATED}, {_sims('rated')} SELECT a, b, round(weight, 5) + 0.0 AS weight FROM sims")
def item_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return C.item_similarity(rated(spark, sf)).select("a", "b", (F.round("weight", 5) + F.lit(0.0)).alias("weight"))


def train_test(spark: SparkSession, sf: str, train_before: str, test_from: str) -> tuple[DataFrame, DataFrame]:
    r = ratings(spark, sf)
    train = r.where(F.col("dt") < train_before).groupBy("user_id", "business_id").agg(F.avg("stars").alias("rating"))
    return train, r.where(F.col("dt") >= test_from).select("user_id", "business_id").distinct()


def _predicted(before: str, after: str) -> str:
    return f"""{RATINGS}, train AS (SELECT user_id, business_id, avg(stars) AS rating FROM ratings WHERE dt < '{before}' GROUP BY ALL), {_sims('train')},
um AS (SELECT user_id, avg(rating) AS mean FROM train GROUP BY 1), test AS (SELECT DISTINCT user_id, business_id FROM ratings WHERE dt >= '{after}'),
t AS (SELECT test.*, im.mean AS item_mean, um.mean AS user_mean FROM test LEFT JOIN im USING (business_id) LEFT JOIN um USING (user_id)),
s2 AS (SELECT a, b, weight FROM sims UNION ALL SELECT b, a, weight FROM sims),
w0 AS (SELECT t.user_id, t.business_id, tr.business_id AS b, tr.rating, coalesce(weight, t.item_mean / im.mean) AS w FROM t JOIN train tr ON t.user_id = tr.user_id AND tr.business_id <> t.business_id
  JOIN im ON im.business_id = tr.business_id LEFT JOIN s2 ON a = t.business_id AND s2.b = tr.business_id WHERE t.item_mean IS NOT NULL AND t.user_mean IS NOT NULL),
w1 AS (SELECT user_id, business_id, b, rating, round(CASE WHEN w > 1 THEN 1 / w ELSE w END, 9) AS w FROM w0 WHERE w > 0),
w2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, business_id ORDER BY w DESC, b) AS k FROM w1),
best AS (SELECT user_id, business_id, sum(w * rating) / sum(w) AS p FROM w2 WHERE k <= {C.NEIGHBOURS} GROUP BY ALL), o AS (SELECT avg(rating) AS overall FROM train),
pred AS (SELECT t.user_id, t.business_id, round(least(5.0, greatest(0.0, CASE WHEN item_mean IS NULL AND user_mean IS NULL THEN overall WHEN item_mean IS NULL THEN user_mean WHEN user_mean IS NULL THEN item_mean ELSE coalesce(p, overall) END)), 6) AS prediction,
  CASE WHEN item_mean IS NULL AND user_mean IS NULL THEN 'new_both' WHEN item_mean IS NULL THEN 'new_item' WHEN user_mean IS NULL THEN 'new_user' WHEN p IS NULL THEN 'none' ELSE 'neighbours' END AS kind
  FROM t LEFT JOIN best USING (user_id, business_id), o)"""


_WARM, _COLD = ("2001-07-01", "2001-07-01"), ("1995-02-01", "2001-07-01")


@query("cf_predict", f"WITH {_predicted(*_WARM)} SELECT user_id, business_id, prediction, kind FROM pred")
def cf_predict(spark: SparkSession, sf: str) -> DataFrame:
    return C.predict(*train_test(spark, sf, *_WARM))


@query("cf_cold_start", f"WITH {_predicted(*_COLD)} SELECT user_id, business_id, prediction, kind FROM pred")
def cf_cold_start(spark: SparkSession, sf: str) -> DataFrame:
    return C.predict(*train_test(spark, sf, *_COLD))


@query("hybrid_blend", f"WITH {_predicted(*_WARM)}, m AS (SELECT user_id, business_id, coalesce(user_mean, overall) * 0.5 + coalesce(item_mean, overall) * 0.5 AS y FROM t, o) SELECT user_id, business_id, round({C.ITEM_SHARE} * prediction + {1 - C.ITEM_SHARE} * y, 5) AS prediction FROM pred JOIN m USING (user_id, business_id)")
def hybrid_blend(spark: SparkSession, sf: str) -> DataFrame:
    """The model here is the mean of the user's and the item's means."""
    train, test = train_test(spark, sf, *_WARM)
    overall = train.agg(F.avg("rating")).scalar()
    um, im = (train.groupBy(k).agg(F.avg("rating").alias(f"{k}_mean")) for k in ("user_id", "business_id"))
    model = test.join(um, "user_id", "left").join(im, "business_id", "left").withColumn("o", overall)
    model = model.select("user_id", "business_id", (F.coalesce("user_id_mean", "o") * 0.5 + F.coalesce("business_id_mean", "o") * 0.5).alias("prediction"))
    return C.blend(C.predict(train, test), model)


@query("gbt_predict")
def gbt_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on user and item profiles; the last month is predicted."""
    from orebed.operators.ml import boosted_ratings

    train, test = train_test(spark, sf, *_WARM)
    return boosted_ratings(train, test)
