"""Model fitting with MLlib, and loops over it."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.operators.relational import arithmetic_hash, dense_index
from orebed.operators.stats import distance, folds, nearest, vote
from orebed.storage import materialize


def vectors(df: DataFrame, column: str = "v") -> DataFrame:
    """df with the array column also as an MLlib vector `features`."""
    return df.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def boosted_ratings(train: DataFrame, test: DataFrame, rate: float = 0.4) -> DataFrame:
    """(user_id, business_id, prediction) of boosted trees on profiles; missing profiles take the overall mean and zero counts."""
    u = train.groupBy("user_id").agg(F.count("*").cast("double").alias("u_n"), F.avg("rating").alias("u_mean"))
    b = train.groupBy("business_id").agg(F.count("*").cast("double").alias("b_n"), F.avg("rating").alias("b_mean"))
    mean = train.agg(F.avg("rating")).first()[0]
    fill = {"u_n": 0.0, "b_n": 0.0, "u_mean": mean, "b_mean": mean}
    feats = lambda d: VectorAssembler(inputCols=list(fill), outputCol="features").transform(d.join(u, "user_id", "left").join(b, "business_id", "left").fillna(fill))
    model = GBTRegressor(labelCol="rating", stepSize=rate, maxIter=10, maxDepth=4, seed=1).fit(feats(train))
    return model.transform(feats(test)).select("user_id", "business_id", F.round("prediction", 6).alias("prediction"))


def linear_fit(df: DataFrame, predictors: list[str], y: str) -> DataFrame:
    """(term, coefficient, p_value, r2) of ordinary least squares by the normal equations, intercept included."""
    data = VectorAssembler(inputCols=predictors, outputCol="features").transform(df)
    m = LinearRegression(labelCol=y, solver="normal").fit(data)
    rows = list(zip([*predictors, "intercept"], [*map(float, m.coefficients), float(m.intercept)], map(float, m.summary.pValues), strict=True))
    return df.sparkSession.createDataFrame([(t, c, p, float(m.summary.r2)) for t, c, p in rows], "term string, coefficient double, p_value double, r2 double")


def linear_mse(train: DataFrame, test: DataFrame, predictors: list[str], y: str) -> DataFrame:
    """(part, mse) of a linear model on its training rows and on others."""
    asm = VectorAssembler(inputCols=predictors, outputCol="features")
    m = LinearRegression(labelCol=y, solver="normal").fit(asm.transform(train))
    mse = lambda part, d: m.transform(asm.transform(d)).agg(F.avg((F.col("prediction") - F.col(y)) ** 2).alias("mse")).select(F.lit(part).alias("part"), "mse")
    return mse("train", train).unionByName(mse("test", test))


def l1_classifier(train: DataFrame, test: DataFrame, strength: float = 0.01) -> DataFrame:
    """(id, label, guess) of an L1-regularised logistic model on (id, v, label), features scaled on train only."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(vectors(train))
    model = LogisticRegression(featuresCol="scaled", regParam=strength, elasticNetParam=1.0, maxIter=50).fit(scaler.transform(vectors(train)))
    return model.transform(scaler.transform(vectors(test))).select("id", "label", F.col("prediction").cast("int").alias("guess"))


def rbf_features(df: DataFrame, dims: int, gamma: float, n: int = 128, seed: int = 3) -> DataFrame:
    """Random Fourier features of a Gaussian kernel, as `features`; dims is the length of v."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 * gamma) ** 0.5, (n, dims)), rng.uniform(0, 2 * np.pi, n)
    rows = F.lit(";".join(" ".join(map(repr, map(float, [*r, s]))) for r, s in zip(w, b, strict=True)))
    parsed = F.transform(F.split(rows, ";"), lambda r: F.split(r, " ").cast("array<double>"))
    one = lambda v: F.transform(parsed, lambda r: F.cos(F.aggregate(F.zip_with(v, F.slice(r, 1, dims), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) + F.get(r, dims)) * (2 / n) ** 0.5)
    return df.withColumn("features", array_to_vector(one(F.col("v"))))


def rbf_svm(train: DataFrame, test: DataFrame, dims: int, gamma: float = 0.5, strength: float = 1e-3) -> DataFrame:
    """(id, label, guess): one linear SVM a class on random Fourier features stands for a Gaussian-kernel SVM."""
    fit = OneVsRest(classifier=LinearSVC(regParam=strength, maxIter=30)).fit(rbf_features(train, dims, gamma))
    return fit.transform(rbf_features(test, dims, gamma)).select("id", "label", F.col("prediction").cast("int").alias("guess"))


def grid_search(df: DataFrame, strengths: list[float], k: int = 5) -> DataFrame:
    """(strength, f1): stratified k-fold weighted F1 of the L1 model for each strength, over (id, v, label)."""
    data = folds(vectors(df), "label", arithmetic_hash(F.col("id"), 11), k)
    model = LogisticRegression(elasticNetParam=1.0, maxIter=30)
    grid = ParamGridBuilder().addGrid(model.regParam, strengths).build()
    cv = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=k, foldCol="fold").fit(data.drop("v"))
    return df.sparkSession.createDataFrame([(s, float(m)) for s, m in zip(strengths, cv.avgMetrics, strict=True)], "strength double, f1 double")


def smote(df: DataFrame, minority: int, k: int = 5, copies: int = 1) -> DataFrame:
    """New points (id, v, label) of the minority class, each between a point and one of its k nearest of the class."""
    few = df.where(F.col("label") == minority)
    near = nearest(few.select(F.col("id").alias("q"), "v"), few, k + 1).where("q <> id")
    near = near.join(few.select(F.col("id").alias("q"), F.col("v").alias("from")), "q").join(few.select("id", F.col("v").alias("to")), "id")
    out = None
    for c in range(copies):
        pick = near.groupBy("q").agg(F.min_by(F.struct("id", "from", "to"), arithmetic_hash(F.col("id") + c, 17)).alias("m"))
        part = arithmetic_hash(F.col("q") + c, 29) / 1_000_003.0
        made = pick.select((-F.col("q") - 1 - c * (1 << 40)).alias("id"), F.zip_with("m.from", "m.to", lambda a, b: (a + (b - a) * part).cast("double")).alias("v"), F.lit(minority).alias("label"))
        out = made if out is None else out.unionByName(made)
    return out


def kmeans(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(id, v, label, cluster) by k-means."""
    data = vectors(df)
    return KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("id", "v", "label", F.col("prediction").alias("cluster"))


def choose_k(df: DataFrame, ks: list[int], seed: int = 1) -> DataFrame:
    """(k, silhouette) of k-means for each k."""
    data = vectors(df)
    score = ClusteringEvaluator()
    rows = [(k, float(score.evaluate(KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data)))) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def majority(clustered: DataFrame) -> DataFrame:
    """(cluster, label): each cluster's most frequent label, ties to the smallest."""
    c = clustered.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    return c.groupBy("cluster").agg(F.max(F.struct("n", -F.col("label"))).alias("t")).select("cluster", (-F.col("t.col2")).alias("guess"))


def kmeans_monte_carlo(df: DataFrame, k: int, runs: int) -> DataFrame:
    """(runs, mean_loss, std_loss): Hamming loss of the clusters' majority labels over seeded runs."""
    losses = []
    for seed in range(runs):
        c = kmeans(df, k, seed)
        losses.append(c.join(majority(c), "cluster").agg(F.avg((F.col("guess") != F.col("label")).cast("double")).alias("loss")))
    return reduce(DataFrame.unionByName, losses).agg(F.count("*").alias("runs"), F.round(F.avg("loss"), 6).alias("mean_loss"), F.round(F.stddev_pop("loss"), 6).alias("std_loss"))


def spectral(df: DataFrame, k: int, gamma: float = 1.0, neighbours: int = 10) -> DataFrame:
    """(id, v, label, cluster) by power iteration on Gaussian affinities of nearest neighbours."""
    near = nearest(df.select(F.col("id").alias("q"), "v"), df, neighbours + 1).where("q <> id")
    edges = near.select(F.least("q", "id").alias("src"), F.greatest("q", "id").alias("dst"), F.exp(-gamma * F.col("d") * F.col("d")).alias("weight")).distinct()
    edges = materialize(edges, "affinities")  # read several times
    got = PowerIterationClustering(k=k, maxIter=20, weightCol="weight").assignClusters(edges)
    return df.join(got, "id").select("id", "v", "label", "cluster")


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The rows of the n least keys `order` (tied rows go together), without gathering n rows in one task."""
    keyed = materialize(df.withColumn("_key", F.struct(*order)), "keyed")
    return keyed.join(dense_index(keyed, "_key").where(F.col("index") < n).select("_key"), "_key", "left_semi").drop("_key")


def self_training(labelled: DataFrame, unlabelled: DataFrame, batch: int, rounds: int = 10) -> DataFrame:
    """(id, v, label): labelled points and all others as the model took them in, the most confident ones first.

    A round takes in a share of 1 / rounds of the unlabelled points, `batch` at least, until none is left.
    """
    have, rest = materialize(labelled.select("id", "v", "label"), "labelled"), materialize(unlabelled.select("id", "v"), "unlabelled")
    n = rest.count()
    batch = max(batch, ceil(n / rounds))
    for left in range(n, 0, -batch):
        scored = LogisticRegression(regParam=0.01, maxIter=30).fit(vectors(have)).transform(vectors(rest))
        sure = scored.select("id", "v", F.col("prediction").cast("int").alias("label"), F.array_max(vector_to_array("probability")).alias("p"))
        new = sure if left <= batch else first_rows(sure, [-F.col("p"), F.col("id")], batch)
        new = materialize(new.select("id", "v", "label"), "new")
        have, rest = materialize(have.unionByName(new), "labelled"), materialize(rest.join(new.select("id"), "id", "left_anti"), "unlabelled")
    return have


def active_learning(pool: DataFrame, test: DataFrame, start: int, step: int, rounds: int = 20, active: bool = True) -> DataFrame:
    """(known, error) after each round, from `start` points to the whole pool.

    The points nearest the margin, or random ones, join a round: a share of 1 / rounds of the rest, `step` at least.
    """
    order = arithmetic_hash(F.col("id"), 41)
    have = materialize(pool.orderBy(order, "id").limit(start), "known")
    n = max(0, pool.count() - start)
    step = max(step, ceil(n / rounds))
    out = []
    for left in [*range(n, 0, -step), 0]:
        model = LogisticRegression(regParam=0.01, maxIter=30).fit(vectors(have))
        error = model.transform(vectors(test)).agg(F.avg((F.col("prediction") != F.col("label")).cast("double"))).first()[0]
        out.append((have.count(), float(error)))
        if not left:
            break
        picked = pool.join(have.select("id"), "id", "left_anti")
        if active and left > step:
            margin = model.transform(vectors(picked)).withColumn("margin", F.array_max(vector_to_array("probability")))
            picked = first_rows(margin.select(*have.columns, "margin"), [F.col("margin"), F.col("id")], step)
        elif left > step:
            picked = first_rows(picked, [order, F.col("id")], step)
        have = materialize(have.unionByName(picked.select(have.columns)), "known")
    return pool.sparkSession.createDataFrame(out, "known long, error double")


def cluster_classifier(train: DataFrame, test: DataFrame, k: int, near: int = 30) -> DataFrame:
    """(id, label, guess): a cluster's label is that of most of the `near` points nearest its centre."""
    model = KMeans(k=k, seed=1, maxIter=20).fit(vectors(train))
    centres = train.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "q long, v array<double>")
    names = vote(nearest(centres, train.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"), "label"), near))
    got = model.transform(vectors(test)).select("id", "label", F.col("prediction").cast("long").alias("q"))
    return got.join(names.withColumnRenamed("label", "guess"), "q").select("id", "label", "guess")


def normalized_distance(v: Column, centre: Column, spread: Column) -> Column:
    """Mahalanobis distance with a diagonal covariance; dimensions without spread count as they are."""
    parts = F.zip_with(F.zip_with(v, centre, lambda a, b: a.cast("double") - b), spread, lambda d, s: d / F.when(s > 0, s).otherwise(1.0))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x))


def cluster_statistics(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, n, centre, spread) from (v, cluster): sums and squares by dimension, then mean and deviation."""
    long = df.select(F.col(cluster).alias("cluster"), F.posexplode("v").alias("i", "x"))
    g = long.groupBy("cluster", "i").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    g = g.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("a"))
    return g.select("cluster", "n", F.col("a.m").alias("centre"), F.col("a.s").alias("spread"))


def assign(points: DataFrame, stats: DataFrame, limit: Column) -> DataFrame:
    """(id, v, cluster): the nearest cluster by normalized distance, -1 beyond `limit`; stats has a row a cluster."""
    d = points.join(F.broadcast(stats), F.lit(True)).withColumn("d", F.round(normalized_distance(F.col("v"), F.col("centre"), F.col("spread")), 9))
    best = d.groupBy("id").agg(F.min(F.struct("d", "cluster")).alias("b"), F.first("v").alias("v"))
    return best.select("id", "v", F.when(F.col("b.d") < limit, F.col("b.cluster")).otherwise(-1).alias("cluster"), F.col("b.d").alias("d"))


def bfr(points: DataFrame, k: int, dims: int, chunks: int = 5) -> tuple[DataFrame, list[tuple[int, int, int, int, int]]]:
    """Clusters of (id, v) by chunks, and (round, discard points, compressed sets, compressed points, retained) lines.

    The first chunk is clustered finely; clusters of one point are retained, the rest give the k discard sets.
    Each chunk's points join a discard set within twice the root of the dimensions, else a compressed set, else
    are retained and clustered anew. Statistics are updated once a chunk. At the end compressed sets join their
    nearest discard set within reach. Result: (id, cluster), -1 for outliers.
    """
    spark = points.sparkSession
    limit = F.lit(2 * dims**0.5)
    pts = materialize(points.select("id", "v", F.lit(0).alias("label"), F.pmod(arithmetic_hash(F.col("id"), 5), F.lit(chunks)).alias("chunk")), "points")

    def fine(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """Clusters of several points, and the lone points."""
        c = kmeans(df, n)
        size = c.groupBy("cluster").agg(F.count("*").alias("n"))
        c = materialize(c.join(size, "cluster"), "fine")
        return c.where("n > 1").select("id", "v", "cluster"), c.where("n = 1").select("id", "v")

    many, lone = fine(pts.where("chunk = 0"), 5 * k)
    discard = materialize(kmeans(many.withColumn("label", F.lit(0)), k).select("id", "v", "cluster"), "discard")
    empty = spark.createDataFrame([], discard.schema)
    compressed, retained, lines = empty, materialize(lone, "retained"), []
    for r in range(chunks):
        if r:
            got = materialize(assign(pts.where(F.col("chunk") == r), cluster_statistics(discard), limit), "assigned")
            discard = materialize(discard.unionByName(got.where("cluster >= 0").select("id", "v", "cluster")), "discard")
            rest = got.where("cluster < 0").select("id", "v")
            if not compressed.isEmpty():
                near = materialize(assign(rest, cluster_statistics(compressed), limit), "assigned")
                compressed = compressed.unionByName(near.where("cluster >= 0").select("id", "v", "cluster"))
                rest = near.where("cluster < 0").select("id", "v")
            retained = materialize(retained.unionByName(rest), "retained")
        n = retained.count()
        if n > 3:
            groups, lone = fine(retained.withColumn("label", F.lit(0)), n // 2 + 1)
            retained = materialize(lone, "retained")
            compressed = materialize(compressed.unionByName(groups.select("id", "v", (F.col("cluster") + 1000 * (r + 1)).cast("int").alias("cluster"))), "compressed")
        lines.append((r + 1, discard.count(), compressed.select("cluster").distinct().count(), compressed.count(), retained.count()))
    out = discard.select("id", "cluster").unionByName(retained.select("id", F.lit(-1).alias("cluster")))
    if not compressed.isEmpty():
        sets = cluster_statistics(compressed).select(F.col("cluster").cast("long").alias("id"), F.col("centre").alias("v"))
        home = assign(sets, cluster_statistics(discard), limit).select(F.col("id").cast("int").alias("set"), F.col("cluster").alias("home"))
        out = out.unionByName(compressed.join(home, F.col("cluster") == F.col("set")).select("id", F.col("home").alias("cluster")))
    return out, lines


def nearest_palette(pixels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """(id, colour): the palette index nearest each (id, v) pixel, ties to the first."""
    rows = F.array(*(F.struct(F.array(*map(F.lit, map(float, c))).alias("c"), F.lit(i).alias("i")) for i, c in enumerate(palette)))
    return pixels.select("id", F.array_min(F.transform(rows, lambda r: F.struct(F.round(distance(F.col("v"), r.c), 6).alias("d"), r.i.alias("i")))).i.alias("colour"))
