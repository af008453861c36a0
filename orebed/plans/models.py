"""Regression by several predictors, neighbours by other metrics and weights, learning curves, summaries of classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.operators import ml as M
from orebed.operators import stats as S
from orebed.operators.relational import arithmetic_hash
from orebed.plans.base import query, table
from orebed.plans.ml import _SPLIT, K, knn_pairs, split


def _ols(source: str, terms: list[str], y: str) -> str:
    """CTEs ending in `beta` (one row): least squares by orthogonal residuals, each predictor freed from those before it."""
    a, b, c = terms
    return f"""o0 AS (SELECT avg({a}) AS ma, avg({b}) AS mb, avg({c}) AS mc, avg({y}) AS my FROM {source}),
o1 AS (SELECT {a} - ma AS a, {b} - mb AS b, {c} - mc AS c, {y} - my AS y FROM {source}, o0), o2 AS (SELECT sum(a * b) / sum(a * a) AS ab, sum(a * c) / sum(a * a) AS ac, sum(a * y) / sum(a * a) AS ay FROM o1),
o3 AS (SELECT a, b - ab * a AS b, c - ac * a AS c, y - ay * a AS y FROM o1, o2), o4 AS (SELECT sum(b * c) / sum(b * b) AS bc, sum(b * y) / sum(b * b) AS by_ FROM o3),
o5 AS (SELECT c - bc * b AS c, y - by_ * b AS y FROM o3, o4), o6 AS (SELECT sum(c * y) / sum(c * c) AS cy, sum(pow(y, 2)) - pow(sum(c * y), 2) / sum(c * c) AS rest FROM o5),
o7 AS (SELECT sum(pow(y, 2)) AS total FROM o1), o8 AS (SELECT cy AS c3, by_ - cy * bc AS c2 FROM o6, o4), o9 AS (SELECT c3, c2, ay - c2 * ab - c3 * ac AS c1 FROM o8, o2),
beta AS (SELECT c1, c2, c3, my - c1 * ma - c2 * mb - c3 * mc AS c0, 1 - rest / total AS r2 FROM o9, o0, o6, o7)"""


_PRICED = "d AS (SELECT l_orderkey, l_quantity, l_quantity * l_quantity AS q2, l_discount, l_tax, l_extendedprice / 1000 AS price FROM lineitem)"


@query("multi_ols", f"""WITH {_PRICED}, {_ols('d', ['l_quantity', 'l_discount', 'l_tax'], 'price')}
SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'intercept']) AS term, round(unnest([c1, c2, c3, c0]), 6) + 0.0 AS coefficient, round(r2, 6) AS r2 FROM beta""")
def multi_ols(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    return M.linear_fit(d, ["l_quantity", "l_discount", "l_tax"], "price").select("term", (F.round("coefficient", 6) + F.lit(0.0)).alias("coefficient"), F.round("r2", 6).alias("r2"))


@query("linear_mse", f"""WITH {_PRICED}, s AS (SELECT *, (((l_orderkey % 1000003) * 7919 + 13) * 104729 % 1000003) < 700002 AS train FROM d), t AS (SELECT * FROM s WHERE train), {_ols('t', ['l_quantity', 'q2', 'l_discount'], 'price')}
SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part, round(avg(pow(price - c0 - c1 * l_quantity - c2 * q2 - c3 * l_discount, 2)), 5) AS mse FROM s, beta GROUP BY 1""")
def linear_mse(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000).withColumn("q2", F.col("l_quantity") * F.col("l_quantity"))
    train = arithmetic_hash(F.col("l_orderkey"), 13) < 700_002
    return M.linear_mse(d.where(train), d.where(~train), ["l_quantity", "q2", "l_discount"], "price").withColumn("mse", F.round("mse", 5))


def _voted(distance: str, weighted: bool) -> str:
    weight = "sum(1 / greatest(d, 1e-9))" if weighted else "count(*)"
    return f"""WITH {_SPLIT}, m AS (SELECT q, id, ps.label, round({distance}, 6) AS d FROM qs, ps), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM m),
v AS (SELECT q, label, round({weight}, 7) AS w FROM n WHERE rank <= {K} GROUP BY ALL), b AS (SELECT q, label AS guess, row_number() OVER (PARTITION BY q ORDER BY w DESC, label) AS r FROM v)
SELECT q, label, guess FROM b JOIN qs USING (q) WHERE r = 1"""


def _voted_plan(spark: SparkSession, sf: str, metric: str, weighted: bool) -> DataFrame:
    q, p = split(spark, sf)
    return S.vote(S.nearest(q, p, K, metric), weighted).withColumnRenamed("label", "guess").join(q.select("q", "label"), "q").select("q", "label", "guess")


@query("knn_manhattan", _voted("list_sum([abs(qs.v[i] - ps.v[i]) FOR i IN range(1, 65)])", False))
def knn_manhattan(spark: SparkSession, sf: str) -> DataFrame:
    return _voted_plan(spark, sf, "manhattan", False)


@query("knn_chebyshev", _voted("list_max([abs(qs.v[i] - ps.v[i]) FOR i IN range(1, 65)])", False))
def knn_chebyshev(spark: SparkSession, sf: str) -> DataFrame:
    return _voted_plan(spark, sf, "chebyshev", False)


@query("knn_minkowski", _voted("pow(list_sum([pow(abs(qs.v[i] - ps.v[i]), 3.0) FOR i IN range(1, 65)]), 1.0 / 3.0)", False))
def knn_minkowski(spark: SparkSession, sf: str) -> DataFrame:
    return _voted_plan(spark, sf, "minkowski", False)


@query("knn_weighted", _voted("list_distance(qs.v, ps.v)", True))
def knn_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Votes weigh the inverse of the distance."""
    return _voted_plan(spark, sf, "euclidean", True)


@query("knn_weighted_manhattan", _voted("list_sum([abs(qs.v[i] - ps.v[i]) FOR i IN range(1, 65)])", True))
def knn_weighted_manhattan(spark: SparkSession, sf: str) -> DataFrame:
    return _voted_plan(spark, sf, "manhattan", True)


@query("knn_mahalanobis", f"""WITH {_SPLIT}, c AS (SELECT var_samp(v[1]) AS s, var_samp(v[2]) AS t, covar_samp(v[1], v[2]) AS u FROM ps),
m AS (SELECT q, id, ps.label, round(sqrt((t * pow(qs.v[1] - ps.v[1], 2) - 2 * u * (qs.v[1] - ps.v[1]) * (qs.v[2] - ps.v[2]) + s * pow(qs.v[2] - ps.v[2], 2)) / (s * t - u * u)), 6) AS d FROM qs, ps, c),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM m) SELECT q, round(avg(d), 5) AS mean_distance FROM n WHERE rank <= {K} GROUP BY 1""")
def knn_mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance to the nearest by the covariance of the points; two dimensions, so that SQL can invert it."""
    q, p = split(spark, sf)
    near = S.nearest(S.whitened(q.select("q", F.slice("v", 1, 2).alias("v")), p, 2), S.whitened(p.select("id", F.slice("v", 1, 2).alias("v"), "label"), p, 2), K)
    return near.groupBy("q").agg(F.round(F.avg("d"), 5).alias("mean_distance"))


#: Tenths of the points that a learning curve takes.
TENTHS = [2, 4, 6, 8, 10]


@query("learning_curve", f"""WITH {_SPLIT}, tn AS (SELECT unnest({TENTHS}) AS tenths), u AS (SELECT tenths, nn.* FROM nn JOIN tn ON (((id % 1000003) * 7919 + 19) * 104729 % 1000003) % 10 < tenths),
n AS (SELECT *, row_number() OVER (PARTITION BY tenths, q ORDER BY d, id) AS rank FROM u), v AS (SELECT tenths, q, label, count(*) AS w FROM n WHERE rank <= {K} GROUP BY ALL),
b AS (SELECT tenths, q, label AS guess, row_number() OVER (PARTITION BY tenths, q ORDER BY w DESC, label) AS r FROM v)
SELECT tenths, count(*) AS n, round(avg(CASE WHEN guess <> label THEN 1.0 ELSE 0.0 END), 6) AS error FROM b JOIN qs USING (q) WHERE r = 1 GROUP BY 1""")
def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Error by how many tenths of the points, by a hash of their id, the classifier knows."""
    q, p = split(spark, sf)
    out = None
    for t in TENTHS:
        guess = S.vote(S.nearest(q, p.where(arithmetic_hash(F.col("id"), 19) % 10 < t), K)).withColumnRenamed("label", "guess").join(q.select("q", "label"), "q")
        one = guess.agg(F.count("*").alias("n"), F.round(F.avg((F.col("guess") != F.col("label")).cast("double")), 6).alias("error")).select(F.lit(t).alias("tenths"), "n", "error")
        out = one if out is None else out.unionByName(one)
    return out


@query("knn_regress_curve", f"""WITH {_SPLIT}, b AS (SELECT i, min(v[i]) AS lo, max(v[i]) AS hi FROM ps, range(2, 9) AS r(i) GROUP BY 1), h AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM b),
qn AS (SELECT q, v[1] AS y, [(v[i + 1] - lo[i]) / (hi[i] - lo[i]) FOR i IN range(1, 8)] AS v FROM qs, h), pn AS (SELECT id, v[1] AS y, [(v[i + 1] - lo[i]) / (hi[i] - lo[i]) FOR i IN range(1, 8)] AS v FROM ps, h),
m AS (SELECT q, qn.y, pn.y AS z, row_number() OVER (PARTITION BY q ORDER BY round(list_distance(qn.v, pn.v), 6), id) AS rank FROM qn, pn), k AS (SELECT unnest(range(1, 100, 7)) AS k),
a AS (SELECT k, q, any_value(y) AS y, avg(z) AS p FROM m JOIN k ON rank <= k GROUP BY ALL) SELECT CAST(k AS INTEGER) AS k, round(avg(pow(y - p, 2)), 6) AS mse FROM a GROUP BY 1""")
def knn_regress_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Error of regression on features scaled to [0, 1] by the points, for k up to 99; one ranked table serves every k."""
    q, p = split(spark, sf)
    dims = range(1, 8)
    box = p.agg(*(f(F.get("v", i).cast("double")).alias(f"{n}{i}") for i in dims for n, f in (("lo", F.min), ("hi", F.max)))).first()
    scaled = F.array(*((F.get("v", i).cast("double") - box[f"lo{i}"]) / (box[f"hi{i}"] - box[f"lo{i}"]) for i in dims))
    y = F.get("v", 0).cast("double")
    near = S.nearest(q.select("q", scaled.alias("v")), p.select("id", scaled.alias("v"), y.alias("label")), 99)
    ks = F.explode(F.array(*map(F.lit, range(1, 100, 7))))
    guess = near.withColumn("k", ks).where(F.col("rank") <= F.col("k")).groupBy("k", "q").agg(F.avg("label").alias("p"))
    return guess.join(q.select("q", y.alias("y")), "q").groupBy("k").agg(F.round(F.avg((F.col("y") - F.col("p")) ** 2), 6).alias("mse"))


@query("clf_summary", f"""WITH {_SPLIT}, a AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = guess) AS hit FROM pr GROUP BY 1), g AS (SELECT guess AS label, count(*) AS said FROM pr GROUP BY 1),
m AS (SELECT support, coalesce(hit / said, 0.0) AS p, hit / support AS r FROM a LEFT JOIN g USING (label)), f AS (SELECT support, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM m)
SELECT (SELECT count(*) FROM pr) AS n, (SELECT round(avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END), 6) FROM pr) AS accuracy, round(avg(f1), 5) AS macro_f1, round(sum(f1 * support) / sum(support), 5) AS weighted_f1 FROM f""")
def clf_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.class_summary(knn_pairs(spark, sf))


@query("roc_points", """WITH s AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y, l_quantity AS x FROM lineitem), t AS (SELECT sum(y) AS p, count(*) - sum(y) AS f FROM s), g AS (SELECT x, sum(y) AS p, count(*) - sum(y) AS f FROM s GROUP BY 1)
SELECT x AS threshold, round(sum(g.f) OVER w / t.f, 8) AS fpr, round(sum(g.p) OVER w / t.p, 8) AS tpr FROM g, t WINDOW w AS (ORDER BY x DESC)""")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return S.roc_points(table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("label"), F.col("l_quantity").alias("score")))
