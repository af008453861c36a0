"""Statistics and models on the embeddings and the numeric columns of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebed.operators import ml as M
from orebed.operators import stats as S
from orebed.operators.relational import arithmetic_hash, numbered
from orebed.plans.base import query, table

#: Every FIFTH row of each label, in order of vec_id, is a query; the rest are the points they are held against.
FIFTH, K, KS = 5, 5, [1, 3, 5, 7, 9, 11, 15]

_SPLIT = f"""p0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
qs AS (SELECT vec_id AS q, v, label FROM p0 WHERE k % {FIFTH} = 1), ps AS (SELECT vec_id AS id, v, label FROM p0 WHERE k % {FIFTH} <> 1),
nn AS (SELECT q, id, ps.label, round(list_distance(qs.v, ps.v), 6) AS d FROM qs, ps),
nr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM nn),
gs AS (SELECT q, label AS guess FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) AS k FROM nr WHERE rank <= {K} GROUP BY q, label) WHERE k = 1),
pr AS (SELECT q, qs.label, guess FROM qs JOIN gs USING (q))"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries: q, v, label), (points: id, v, label)."""
    p = numbered(points(spark, sf), ["id"], ["label"], "k")
    query = F.col("k") % FIFTH == 0
    return p.where(query).select(F.col("id").alias("q"), "v", "label"), p.where(~query).select("id", "v", "label")


def knn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    q, p = split(spark, sf)
    return S.vote(S.nearest(q, p, K)).withColumnRenamed("label", "guess").join(q.select("q", "label"), "q").select("q", "label", "guess")


@query("knn_classify", f"WITH {_SPLIT} SELECT q, label, guess FROM pr")
def knn_classify(spark: SparkSession, sf: str) -> DataFrame:
    return knn_pairs(spark, sf)


@query("knn_metrics", f"""WITH {_SPLIT}, c AS (SELECT count(*) FILTER (WHERE label = 0 AND guess = 0) AS tp, count(*) FILTER (WHERE label <> 0 AND guess <> 0) AS tn,
  count(*) FILTER (WHERE label <> 0 AND guess = 0) AS fp, count(*) FILTER (WHERE label = 0 AND guess <> 0) AS fn FROM pr)
SELECT round(tp / (tp + fn), 6) AS tpr, round(tn / (tn + fp), 6) AS tnr, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def knn_metrics(spark: SparkSession, sf: str) -> DataFrame:
    yes, said = F.col("label") == 0, F.col("guess") == 0
    c = knn_pairs(spark, sf).agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & ~said).alias("tn"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"))
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return c.select(F.round(F.try_divide(tp, tp + fn), 6).alias("tpr"), F.round(F.try_divide(tn, tn + fp), 6).alias("tnr"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


@query("knn_error_curve", f"""WITH {_SPLIT}, ks AS (SELECT unnest({KS}) AS k), vt AS (SELECT q, k, label, count(*) AS n FROM nr JOIN ks ON rank <= k GROUP BY ALL),
b AS (SELECT q, k, label AS guess FROM (SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY n DESC, label) AS r FROM vt) WHERE r = 1)
SELECT k, count(*) FILTER (WHERE guess <> label) AS errors, round(avg(CASE WHEN guess <> label THEN 1.0 ELSE 0.0 END), 6) AS error FROM b JOIN qs USING (q) GROUP BY k""")
def knn_error_curve(spark: SparkSession, sf: str) -> DataFrame:
    q, p = split(spark, sf)
    return S.error_curve(S.nearest(q, p, max(KS)), q.select("q", "label"), KS)


@query("knn_regress", f"WITH {_SPLIT} SELECT q, round(avg(ps.v[1]), 5) AS prediction FROM nr JOIN ps USING (id) WHERE rank <= {K} GROUP BY q")
def knn_regress(spark: SparkSession, sf: str) -> DataFrame:
    q, p = split(spark, sf)
    target = p.select("id", F.get("v", 0).cast("double").alias("y"))
    return S.nearest(q, p, K).join(target, "id").groupBy("q").agg(F.round(F.avg("y"), 5).alias("prediction"))


@query("confusion_matrix", f"WITH {_SPLIT} SELECT label, guess, count(*) AS n FROM pr GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return knn_pairs(spark, sf).groupBy("label", "guess").agg(F.count("*").alias("n"))


@query("clf_report", f"""WITH {_SPLIT}, a AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = guess) AS hit FROM pr GROUP BY 1), g AS (SELECT guess AS label, count(*) AS said FROM pr GROUP BY 1),
m AS (SELECT label, support, coalesce(hit / said, 0.0) AS p, hit / support AS r FROM a LEFT JOIN g USING (label))
SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM m""")
def clf_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.class_report(knn_pairs(spark, sf))


@query("roc_auc", """WITH s AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y, l_quantity AS x FROM lineitem), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS k FROM s),
t AS (SELECT sum(CASE WHEN y = 1 THEN k END) AS ranks, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM r) SELECT round((ranks - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM t""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return S.roc_auc(table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("label"), F.col("l_quantity").alias("score")))


@query("hamming_exact_match", """WITH f AS (SELECT l_suppkey, mode_f, mode_s FROM (SELECT l_suppkey, l_returnflag AS mode_f, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY l_suppkey, l_returnflag)
 JOIN (SELECT l_suppkey, l_linestatus AS mode_s, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linestatus) AS j FROM lineitem GROUP BY l_suppkey, l_linestatus) USING (l_suppkey) WHERE k = 1 AND j = 1),
m AS (SELECT CASE WHEN l_returnflag <> mode_f THEN 1 ELSE 0 END AS a, CASE WHEN l_linestatus <> mode_s THEN 1 ELSE 0 END AS b FROM lineitem JOIN f USING (l_suppkey))
SELECT round(avg((a + b) / 2), 8) AS hamming_loss, round(avg(CASE WHEN a + b = 0 THEN 1.0 ELSE 0.0 END), 8) AS exact_match FROM m""")
def hamming_exact_match(spark: SparkSession, sf: str) -> DataFrame:
    """Two labels a row, guessed as the supplier's most frequent ones."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")

    def mode(c: str, name: str) -> DataFrame:
        n = li.groupBy("l_suppkey", c).agg(F.count("*").alias("n"))
        w = Window.partitionBy("l_suppkey").orderBy(F.desc("n"), c)
        return n.withColumn("k", F.row_number().over(w)).where("k = 1").select("l_suppkey", F.col(c).alias(name))

    m = li.join(mode("l_returnflag", "f"), "l_suppkey").join(mode("l_linestatus", "s"), "l_suppkey")
    miss = (F.col("l_returnflag") != F.col("f")).cast("int") + (F.col("l_linestatus") != F.col("s")).cast("int")
    return m.agg(F.round(F.avg(miss / 2), 8).alias("hamming_loss"), F.round(F.avg((miss == 0).cast("double")), 8).alias("exact_match"))


_CLUSTERED = "cl AS (SELECT vec_id, label, CAST(list_position(embedding[1:5], list_max(embedding[1:5])) - 1 AS INTEGER) AS cluster FROM embeddings)"


@query("cluster_majority", f"WITH {_CLUSTERED} SELECT cluster, label AS guess FROM (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) AS k FROM cl GROUP BY cluster, label) WHERE k = 1")
def cluster_majority(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by the largest of the first five dimensions."""
    v = F.slice("v", 1, 5)
    return M.majority(points(spark, sf).withColumn("cluster", (F.array_position(v, F.array_max(v)) - 1).cast("int")))


@query("silhouette", """WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT x.vec_id, x.label, y.label AS other, sum(pow(list_distance(x.v, y.v), 2)) AS s, count(*) AS n FROM p x, p y GROUP BY ALL),
m AS (SELECT vec_id, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY 1)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0.0)), 6) AS silhouette FROM m""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return S.silhouette(points(spark, sf))


_XY = "xy AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"


def xy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@query("simple_ols", f"WITH {_XY} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM xy")
def simple_ols(spark: SparkSession, sf: str) -> DataFrame:
    return S.simple_ols(xy(spark, sf), "x", "y").select(*(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")))


@query("mse", f"WITH {_XY}, c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM xy) SELECT round(avg(pow(y - a - b * x, 2)), 6) AS mse, round(sqrt(avg(pow(y - a - b * x, 2))), 6) AS rmse FROM xy, c")
def mse(spark: SparkSession, sf: str) -> DataFrame:
    """From the sums alone: the residual mean square of one predictor needs no second pass."""
    s = xy(spark, sf).agg(F.regr_syy("y", "x").alias("yy"), F.regr_sxy("y", "x").alias("xy"), F.regr_sxx("y", "x").alias("xx"), F.count("*").alias("n"))
    m = (F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")) / F.col("n")
    return s.select(F.round(m, 6).alias("mse"), F.round(F.sqrt(m), 6).alias("rmse"))


@query("cooks_outliers", f"""WITH {_XY}, c AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, (regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) AS s2 FROM xy),
d AS (SELECT l_orderkey, l_linenumber, x, n, 1 / n + pow(x - mx, 2) / sxx AS h, y - a - b * x AS e, s2 FROM xy, c)
SELECT l_orderkey, l_linenumber, round(e * e * h / (2 * s2 * (1 - h) * (1 - h)), 9) AS cook FROM d WHERE e * e * h / (2 * s2 * (1 - h) * (1 - h)) > 4 / n""")
def cooks_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return S.cooks_distance(xy(spark, sf), "x", "y").where(F.col("cook") > 4 / F.col("n")).select("l_orderkey", "l_linenumber", F.round("cook", 9).alias("cook"))


_NUM = ["l_quantity", "price", "l_discount", "l_tax"]
_COV = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 7) + 0.0 AS value FROM nums" for i, a in enumerate(_NUM) for b in _NUM[i:])


@query("covariance", f"WITH nums AS (SELECT l_quantity, l_extendedprice / 1000 AS price, l_discount, l_tax FROM lineitem) {_COV}")
def covariance(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    return S.covariance(d, _NUM).withColumn("value", F.round("value", 7) + F.lit(0.0))


@query("scalers", """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sd FROM customer)
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 8) AS minmax, round((c_acctbal - mu) / sd, 8) AS standard FROM customer, s""")
def scalers(spark: SparkSession, sf: str) -> DataFrame:
    d = S.scaled(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return d.select("c_custkey", F.round("c_acctbal_minmax", 8).alias("minmax"), F.round("c_acctbal_standard", 8).alias("standard"))


@query("poly_interactions", "SELECT p_partkey, p_size * p_size AS size2, p_size * p_size * p_size AS size3, round(p_size * p_retailprice, 4) AS size_price, round(p_retailprice * p_retailprice, 4) AS price2 FROM part")
def poly_interactions(spark: SparkSession, sf: str) -> DataFrame:
    s, p = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", (s * s).alias("size2"), (s * s * s).alias("size3"), F.round(s * p, 4).alias("size_price"), F.round(p * p, 4).alias("price2"))


_HASH = "(((vec_id % 1000003) * 7919 + {0}) * 104729 % 1000003)"


@query("stratified_split", f"WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(3)}, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, CASE WHEN k <= n // 5 THEN 'test' ELSE 'train' END AS part FROM r")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", arithmetic_hash(F.col("vec_id"), 3).alias("h"))
    rows = numbered(e, ["h", "vec_id"], ["label"], "k").join(e.groupBy("label").agg(F.count("*").alias("n")), "label")
    return rows.select("vec_id", "label", F.when(F.col("k") < F.floor(F.col("n") / 5), "test").otherwise("train").alias("part"))


@query("stratified_folds", f"SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(11)} * 10000000 + vec_id) - 1) % 10 AS INTEGER) AS fold FROM embeddings")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    key = arithmetic_hash(F.col("vec_id"), 11) * 10_000_000 + F.col("vec_id")
    return S.folds(table(spark, sf, "embeddings").select("vec_id", "label"), "label", key, 10)


_LONG = "lg AS (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS r(i))"


@query("bfr_statistics", f"WITH {_LONG} SELECT label, CAST(i AS INTEGER) AS i, count(*) AS n, round(sum(x), 5) + 0.0 AS total, round(sum(x * x), 5) AS squares FROM lg GROUP BY ALL")
def bfr_statistics(spark: SparkSession, sf: str) -> DataFrame:
    long = points(spark, sf).select("label", F.posexplode("v").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy("label", "i").agg(F.count("*").alias("n"), (F.round(F.sum("x"), 5) + F.lit(0.0)).alias("total"), F.round(F.sum(F.col("x") * F.col("x")), 5).alias("squares"))


@query("mahalanobis_assign", f"""WITH {_LONG}, st AS (SELECT label AS c, i, avg(x) AS m, stddev_pop(x) AS s FROM lg GROUP BY ALL),
d AS (SELECT vec_id, c, round(sqrt(sum(pow((x - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END, 2))), 9) AS d FROM lg JOIN st USING (i) GROUP BY ALL),
b AS (SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS k FROM d)
SELECT vec_id AS id, CAST(CASE WHEN d < 8.0 THEN c ELSE -1 END AS INTEGER) AS cluster, round(d, 5) AS d FROM b WHERE k = 1""")
def mahalanobis_assign(spark: SparkSession, sf: str) -> DataFrame:
    """The labels' own statistics as clusters; half of the usual limit of twice the root of the dimensions."""
    p = points(spark, sf)
    return M.assign(p.select("id", "v"), M.cluster_statistics(p, "label"), F.lit(8.0)).select("id", "cluster", F.round("d", 5).alias("d"))


#: Colours that pixels are mapped to: navy, red, gold, white.
PALETTE = [(0, 32, 96), (200, 16, 46), (255, 200, 44), (255, 255, 255)]


@query("nearest_palette", f"""WITH px AS (SELECT vec_id, [floor(abs(embedding[j]) * 1000) % 256 FOR j IN [1, 2, 3]] AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)),
d AS (SELECT vec_id, c.i, round(list_distance(CAST(v AS DOUBLE[]), CAST(c.p AS DOUBLE[])), 6) AS d FROM px, (VALUES {', '.join(f'({i}, {list(c)})' for i, c in enumerate(PALETTE))}) AS c(i, p))
SELECT vec_id AS id, CAST(i AS INTEGER) AS colour FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, i) AS k FROM d) WHERE k = 1""")
def nearest_palette(spark: SparkSession, sf: str) -> DataFrame:
    px = points(spark, sf).select("id", F.transform(F.slice("v", 1, 3), lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("double")).alias("v"))
    return M.nearest_palette(px, PALETTE)


def train_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(train, test), four fifths and a fifth of each label, as stratified_split has them."""
    p = points(spark, sf).join(stratified_split(spark, sf).select(F.col("vec_id").alias("id"), "part"), "id")
    return p.where("part = 'train'").drop("part"), p.where("part = 'test'").drop("part")


@query("l1_classifier")
def l1_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return M.l1_classifier(*train_test(spark, sf))


@query("rbf_svm")
def rbf_svm(spark: SparkSession, sf: str) -> DataFrame:
    return M.rbf_svm(*train_test(spark, sf), dims=64)


@query("grid_search")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    return M.grid_search(points(spark, sf), [0.003, 0.03], k=3)


@query("smote")
def smote(spark: SparkSession, sf: str) -> DataFrame:
    return M.smote(points(spark, sf), minority=3)


@query("kmeans_choose_k")
def kmeans_choose_k(spark: SparkSession, sf: str) -> DataFrame:
    return M.choose_k(points(spark, sf), [2, 5, 10])


@query("kmeans_monte_carlo")
def kmeans_monte_carlo(spark: SparkSession, sf: str) -> DataFrame:
    return M.kmeans_monte_carlo(points(spark, sf), 10, runs=3)


@query("cluster_classifier")
def cluster_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return M.cluster_classifier(*train_test(spark, sf), k=10)


@query("spectral")
def spectral(spark: SparkSession, sf: str) -> DataFrame:
    return M.spectral(points(spark, sf), 10).select("id", "label", "cluster")


@query("self_training")
def self_training(spark: SparkSession, sf: str) -> DataFrame:
    q, p = split(spark, sf)
    return M.self_training(q.withColumnRenamed("q", "id"), p, batch=100).select("id", "label")


@query("active_learning")
def active_learning(spark: SparkSession, sf: str) -> DataFrame:
    return M.active_learning(*train_test(spark, sf), start=60, step=20)


@query("passive_learning")
def passive_learning(spark: SparkSession, sf: str) -> DataFrame:
    return M.active_learning(*train_test(spark, sf), start=60, step=20, active=False)


@query("bfr")
def bfr(spark: SparkSession, sf: str) -> DataFrame:
    return M.bfr(points(spark, sf).select("id", "v"), k=10, dims=64)[0]


@query("bfr_report")
def bfr_report(spark: SparkSession, sf: str) -> DataFrame:
    """A line a round: points in discard sets, compressed sets and their points, retained points."""
    lines = M.bfr(points(spark, sf).select("id", "v"), k=10, dims=64)[1]
    return spark.createDataFrame(lines, "round int, discard long, sets long, compressed long, retained long")
