"""Statistics as aggregates: regression, outliers, scalers, neighbours, classifier reports, cluster scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.operators.relational import numbered, totals_below
from orebed.storage import materialize


def simple_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, r2 of one predictor."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def cooks_distance(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with `cook`, each row's Cook's distance in the regression of y on x, in closed form from six sums."""
    s = df.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    s = s.select("n", "mx", "a", "b", "sxx", ((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2)).alias("s2"))
    m = df.crossJoin(F.broadcast(s))  # one row
    h = 1 / F.col("n") + (F.col(x) - F.col("mx")) ** 2 / F.col("sxx")
    e = F.col(y) - F.col("a") - F.col("b") * F.col(x)
    return m.withColumn("cook", e * e * h / (2 * F.col("s2") * (1 - h) * (1 - h))).drop("mx", "a", "b", "sxx", "s2")


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, value): the sample covariance matrix, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("value")) for a, b in pairs))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def scaled(df: DataFrame, columns: list[str], population: bool = True) -> DataFrame:
    """df with each column c also as c_minmax and c_standard (population deviation, or the sample's)."""
    dev = F.stddev_pop if population else F.stddev_samp
    s = df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("mu", F.avg), ("sd", dev))))
    m = df.crossJoin(F.broadcast(s))  # one row
    out = {}
    for c in columns:
        out[f"{c}_minmax"] = F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo"))
        out[f"{c}_standard"] = F.try_divide(F.col(c) - F.col(f"{c}_mu"), F.col(f"{c}_sd"))
    return m.withColumns(out).select(*df.columns, *out)


def unit(v: Column) -> Column:
    """A vector scaled to length one."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 3.0) -> Column:
    """Distance of two vectors: euclidean, manhattan, chebyshev or minkowski of power p."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if metric == "chebyshev":
        return F.array_max(gaps)
    if metric == "manhattan":
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
    if metric == "minkowski":
        return F.pow(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + F.pow(g, F.lit(p))), F.lit(1 / p))
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric}")
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))


#: Queries that are held against all points in one scan; queries and points that a task compares at once.
QUERY_BLOCK, AT_ONCE = 1 << 14, (1024, 4096)


def _distances(q: np.ndarray, v: np.ndarray, metric: str, p: float) -> np.ndarray:
    """(queries, points) distances, added up dimension by dimension."""
    out = np.zeros((len(q), len(v)))
    for j in range(q.shape[1]):
        gap = np.abs(q[:, j, None] - v[None, :, j])
        if metric == "chebyshev":
            np.maximum(out, gap, out=out)
        else:
            out += gap if metric == "manhattan" else gap**p if metric == "minkowski" else gap * gap
    return out ** (1 / p) if metric == "minkowski" else np.sqrt(out) if metric == "euclidean" else out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _near(names: np.ndarray, q: np.ndarray, k: int, metric: str, p: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k nearest of a task's points to each query, exactly: others are ruled out by a bound that is never too low."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [None] * len(range(0, len(q), AT_ONCE[0]))
        kind = None
        for b in batches:
            kind = b.column(2).type
            for lo in range(0, b.num_rows if len(q) else 0, AT_ONCE[1]):
                part = b.slice(lo, AT_ONCE[1])
                ids, labels, v = part.column(0).to_numpy(zero_copy_only=False), np.array(part.column(2).to_pylist(), object), _matrix(part.column(1))
                for n in range(len(best)):
                    some = q[n * AT_ONCE[0] : (n + 1) * AT_ONCE[0]]
                    at, d, i, label = best[n] or (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, object))
                    bound = np.full(len(some), np.inf)  # the k-th distance so far
                    full = np.flatnonzero(np.bincount(at, minlength=len(some)) == k)
                    bound[full] = np.nan_to_num(d[np.searchsorted(at, full, side="right") - 1], nan=np.inf)
                    if metric == "euclidean":
                        a2, b2 = (some * some).sum(axis=1), (v * v).sum(axis=1)
                        gap = a2[:, None] + b2 - 2 * (some @ v.T)
                        off = 1e-12 * (np.nan_to_num(a2).max() + np.nan_to_num(b2).max()) + 1e-300  # more than the error of the sums
                    else:
                        gap, off = _distances(some, v, metric, p), 0.0
                    if not np.isfinite(gap).all():
                        gap = np.nan_to_num(gap, nan=np.inf, posinf=np.inf)
                    limit = bound + 2e-6  # distances are compared as rounded to six places
                    if metric == "euclidean":
                        limit = limit**2 + off
                    if len(full) < len(some) and len(v) >= k:
                        kth = np.partition(gap, k - 1, axis=1)[:, k - 1]
                        limit = np.minimum(limit, (np.sqrt(np.maximum(kth, 0) + off) + 2e-6) ** 2 + off if metric == "euclidean" else kth + 2e-6)
                    x, y = np.nonzero(gap <= limit[:, None])
                    if not len(x):
                        continue
                    new = np.sqrt(reduce(lambda s, j: s + (some[x, j] - v[y, j]) ** 2, range(q.shape[1]), np.zeros(len(x)))) if metric == "euclidean" else gap[x, y]
                    at, d, i, label = np.r_[at, x], np.r_[d, np.round(new, 6)], np.r_[i, ids[y]], np.r_[label, labels[y]]
                    order = np.lexsort((i, d, at))
                    at, d, i, label = at[order], d[order], i[order], label[order]
                    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                    best[n] = at[kept], d[kept], i[kept], label[kept]
        for n, found in enumerate(best):
            if found:
                yield pa.RecordBatch.from_pydict({"q": names[n * AT_ONCE[0] + found[0]], "id": found[2], "label": pa.array(found[3].tolist(), kind), "d": found[1]})

    return scan


def nearest(queries: DataFrame, points: DataFrame, k: int, metric: str = "euclidean", p: float = 3.0) -> DataFrame:
    """(q, id, label, d, rank) of the k nearest points (id, v, label) of each query (q, v); ties by id.

    The queries are a stated set. They are taken in blocks of a bounded size, the points scanned once a block:
    every task keeps the k nearest of each query that it has seen, so k rows a query and task are shuffled and no
    pairs are formed. Euclidean distances are bounded by matrix products, and added up only where the bound leaves a
    point in question. d is rounded to six places. No queries or no points give no rows.
    """
    if metric not in ("euclidean", "manhattan", "chebyshev", "minkowski"):
        raise ValueError(f"unknown metric {metric}")
    points = materialize(points.select(F.col("id").cast("long"), F.transform("v", lambda x: x.cast("double")).alias("v"), "label"), "points")
    queries = materialize(queries.select(F.col("q").cast("long"), F.transform("v", lambda x: x.cast("double")).alias("v")), "queries")
    blocks = -(-max(1, queries.count()) // (QUERY_BLOCK // 2))  # dealt by hash, half full on average
    found, schema = None, f"q long, id long, label {points.schema['label'].dataType.simpleString()}, d double"
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not len(rows) and block:
            continue
        names, q = rows.column("q").to_numpy(), _matrix(rows.column("v").combine_chunks()) if len(rows) else np.empty((0, 0))
        part = points.mapInArrow(_near(names, q, k, metric, p), schema)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def whitened(df: DataFrame, reference: DataFrame, dims: int) -> DataFrame:
    """df with v turned so that Euclidean distance is the Mahalanobis distance of `reference`'s sample covariance.

    The covariance is one aggregate over `reference`; its dims x dims values are inverted on the driver.
    """
    cols = [F.get("v", j).cast("double").alias(f"x{j}") for j in range(dims)]
    cov = np.zeros((dims, dims))
    for a, b, value in covariance(reference.select(*cols), [f"x{j}" for j in range(dims)]).collect():
        cov[int(a[1:]), int(b[1:])] = cov[int(b[1:]), int(a[1:])] = value
    root = np.linalg.cholesky(np.linalg.pinv(cov) + 1e-15 * np.eye(dims))
    turned = [F.aggregate(F.zip_with("v", F.array(*map(F.lit, map(float, root[:, j]))), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x) for j in range(dims)]
    return df.withColumn("v", F.array(*turned))


def vote(neighbours: DataFrame, weighted: bool = False) -> DataFrame:
    """(q, label) by most votes, or by most votes over distance; ties to the smallest label."""
    w = F.sum(1 / F.greatest("d", F.lit(1e-9))) if weighted else F.count("*").cast("double")
    votes = neighbours.groupBy("q", "label").agg(w.alias("w"))
    return votes.groupBy("q").agg(F.max(F.struct("w", -F.col("label"))).alias("top")).select("q", (-F.col("top.col2")).alias("label"))


def error_curve(neighbours: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, errors, error): one ranked table of neighbours gives the votes of every k at once."""
    each = neighbours.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    votes = each.groupBy("q", "k", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("q", "k").agg(F.max(F.struct("n", -F.col("label"))).alias("top")).select("q", "k", (-F.col("top.col2")).alias("guess"))
    return best.join(truth, "q").groupBy("k").agg(F.count_if(F.col("guess") != F.col("label")).alias("errors"), F.round(F.avg((F.col("guess") != F.col("label")).cast("double")), 6).alias("error"))


def class_report(pairs: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from (label, guess)."""
    c = pairs.groupBy("label", "guess").agg(F.count("*").alias("n"))
    real = c.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(0)).alias("hit"))
    said = c.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("said"))
    m = real.join(said, "label", "left")
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return m.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def class_summary(pairs: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro_f1 and weighted_f1 (by support) of (label, guess)."""
    c = class_report(pairs)
    hits = pairs.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("guess")).cast("double")), 6).alias("accuracy"))
    f1 = c.agg(F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 5).alias("weighted_f1"))
    return hits.crossJoin(F.broadcast(f1))  # one row each


def _by_score(scored: DataFrame) -> DataFrame:
    g = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    return totals_below(g, "score", ["pos", "n"])


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: auc of (label 0/1, score), ties counted half, by pre-aggregated scores over range partitions."""
    g = _by_score(scored)
    s = g.agg(F.sum(F.col("pos") * (F.col("n_below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return s.select(F.round((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auc"))


def roc_points(scored: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) of the curve that `score >= threshold` gives, a row a different score."""
    g = _by_score(scored)
    t = g.agg(F.sum("pos").alias("p"), F.sum("n").alias("all"))
    g = g.crossJoin(F.broadcast(t))  # one row
    false = F.col("all") - F.col("p")
    return g.select(F.col("score").alias("threshold"), F.round((false - (F.col("n_below") - F.col("pos_below"))) / false, 8).alias("fpr"), F.round((F.col("p") - F.col("pos_below")) / F.col("p"), 8).alias("tpr"))


def silhouette(points: DataFrame, centres_only: bool = False) -> DataFrame:
    """One row: the mean silhouette of (id, v, label), squared Euclidean, from the clusters' sums alone.

    The mean squared distance of a point to a cluster follows from the cluster's size, sum vector and sum of
    squares, so no pairs of points are formed.
    """
    dims = F.posexplode("v").alias("i", "x")
    long = points.select("id", "label", dims)
    sums = long.groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") ** 2).alias("s2"))
    clusters = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e.s).alias("sum"), F.sum("s2").alias("squares"))
    clusters = clusters.join(points.groupBy("label").agg(F.count("*").alias("n")), "label").select(F.col("label").alias("other"), "sum", "squares", F.col("n").alias("size"))
    m = points.select("id", "label", F.transform("v", lambda x: x.cast("double")).alias("v")).join(F.broadcast(clusters), F.lit(True))  # a row a cluster
    own = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    dot = F.aggregate(F.zip_with("v", "sum", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    total = F.col("size") * own - 2 * dot + F.col("squares")
    d = m.withColumn("d", F.when(F.col("label") == F.col("other"), F.try_divide(total, F.col("size") - 1)).otherwise(total / F.col("size")))
    s = d.groupBy("id").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    return s.agg(F.round(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))), 6).alias("silhouette"))


def folds(df: DataFrame, label: str, key: Column, k: int) -> DataFrame:
    """df with `fold`, 0 to k - 1, each label spread evenly, by rank of a hash of the key over range partitions."""
    rows = numbered(df.withColumn("_key", key), ["_key"], [label], "_at")
    return rows.withColumn("fold", (F.col("_at") % k).cast("int")).drop("_key", "_at")
