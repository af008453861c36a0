"""Hand-made fixtures: text functions, readers, itemsets, graphs, sketches, neighbours."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orebed.functions import text as T
from orebed.operators import graph as G
from orebed.operators import itemsets as I
from orebed.operators import ml as M
from orebed.operators import recommend as C
from orebed.operators import relational as R
from orebed.operators import sketches as K
from orebed.operators import stats as S
from orebed.plans.registry import ORACLE_SQL, QUERIES
from orebed.sources import readers, writers
from tests.conftest import DATA
from tests.parity import assert_same


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_tokens_keep_integers_and_cut_the_rest(spark):
    got = one(spark, T.tokens(F.lit("In 1,996. of\n12, x-y 上海 1996.")))
    assert got == ["In", "1", "996", "of12", "x", "y", "上海", "1996"]


def test_flip_name(spark):
    assert one(spark, T.flip_name(F.lit(" Doe ,  Jane "))) == "Jane Doe"
    assert one(spark, T.flip_name(F.lit("Plato"))) == "Plato"


def test_utf8_mod_matches_integers(spark):
    for text in ("abc", "é上", "", "user-17"):
        assert one(spark, T.utf8_mod(F.lit(text), 69997)) == int.from_bytes(text.encode(), "big") % 69997


def test_trailing_zeros_of_zero_is_one(spark):
    assert [one(spark, T.trailing_zeros(F.lit(x))) for x in (0, 1, 2, 12)] == [1, 0, 1, 2]


def test_double_encoded_json_and_missing_keys(spark, tmp_path):
    data = {"A": {"All": {"n": "1,996", "c": None}, "P": {"n": 7}}}
    (tmp_path / "x.json").write_text(json.dumps(json.dumps(data)))
    rows = readers.read_json_maps(spark, str(tmp_path)).select("outer", "inner", readers.number(readers.field(F.col("fields"), "n", "-1")).alias("n"), readers.field(F.col("fields"), "c", "-1").alias("c")).collect()
    assert sorted(map(tuple, rows), key=str) == [("A", "All", 1996.0, None), ("A", "P", 7.0, "-1")]


def test_json_array_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\"b"), (2, None)], "k int, s string")
    for twice in (False, True):
        path = str(tmp_path / str(twice))
        writers.write_text(writers.json_array(df, twice), "value", path)
        assert sorted(map(tuple, readers.read_json_array(spark, path, "k:int,s:string").collect())) == [(1, 'a"b'), (2, None)]


def test_xml_walk_visits_children_of_empty_elements(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<a k='1' m='2'><b><c>text</c></b>t</a>".replace("<a ", "<a ").replace("t</a>", "</a>"))
    got = sorted((r.path, r.text) for r in readers.read_xml_dir(spark, str(tmp_path)).collect())
    assert got == [("a.@k", "1"), ("a.@m", "2"), ("a.b.c", "text")]
    docs = spark.createDataFrame([(1, "<a><b><c>x</c></b></a>"), (2, None), (3, "<a")], "id int, doc string")
    assert readers.xml_elements(docs, "id", "doc", strict=True).count() == 0


def test_not_in_is_null_aware(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,)], "j int")
    assert [r.k for r in R.not_in(a, "k", b, "j").collect()] == [2]
    assert R.not_in(a, "k", b.union(spark.createDataFrame([(None,)], "j int")), "j").count() == 0


def test_dense_index_has_no_gaps(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)] * 2, "k int").repartition(7)
    rows = R.dense_index(df, "k").orderBy("k").collect()
    assert [r["index"] for r in rows] == list(range(300))


def test_itemsets_are_exact_and_monotone(spark):
    rng = random.Random(3)
    baskets = {b: {i for i in "abcde" if rng.random() < 0.5} for b in range(60)}
    rows = spark.createDataFrame([(b, i) for b, s in baskets.items() for i in s], "key int, item string")
    got = {tuple(r["items"]): r.n for r in I.frequent_itemsets(rows, 8).collect()}
    from itertools import combinations

    want = {c: n for k in range(1, 6) for c in combinations("abcde", k) if (n := sum(set(c) <= s for s in baskets.values())) >= 8}
    assert got == want


def test_basket_size_is_strict(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, i string")
    assert {r.key for r in I.baskets(rows, "k", "i", more_than=1).collect()} == {1}


def _graph(spark, pairs):
    return spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "src long, dst long")


@pytest.mark.parametrize("least", [1, 2, 5, 70])
def test_shared_item_edges_equal_pairs_of_sets(spark, least):
    rnd = random.Random(3)
    held = {k: {0, *rnd.sample(range(150), rnd.choice((0, 1, 4, 9, 90, 140)))} for k in range(40)}  # all hold item 0
    held |= {100: set(range(150)), 101: set(range(150)), 102: {500}}
    rows = spark.createDataFrame([(k, i) for k, items in held.items() for i in items], "key int, item int")
    want = sorted((a, b) for a in held for b in held if a != b and len(held[a] & held[b]) >= least)
    assert sorted(map(tuple, G.shared_item_edges(rows, least).collect())) == want
    assert G.shared_item_edges(rows.limit(0), least).count() == 0


@pytest.mark.parametrize("common", [0, 6, 30])
def test_shared_items_are_counted_in_cells_without_rows_of_candidates(spark, common, monkeypatch):
    rnd = random.Random(5)
    held = {k: {*range(common), *rnd.sample(range(30, 400), 25)} for k in range(60)} | {90: set(range(40)), 91: set(range(40))}
    rows = spark.createDataFrame([(k, i) for k, items in held.items() for i in items], "key long, item int")
    want = sorted((a, b) for a in held for b in held if a != b and len(held[a] & held[b]) >= 7)
    monkeypatch.setattr(G, "CELL", 4)
    edges = G.shared_item_edges(rows, 7)
    assert sorted(map(tuple, edges.collect())) == want
    assert "a < b" not in (plan := edges._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan


def test_two_triangles_and_a_bridge(spark):
    e = _graph(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)])
    top = G.edge_betweenness(e).orderBy(F.desc("betweenness")).first()
    assert (top.a, top.b, top.betweenness) == (3, 4, 9.0)
    assert [r.members for r in G.girvan_newman(e).collect()] == ["'1', '2', '3'", "'4', '5', '6'"]
    assert {r.component for r in G.connected_components(e).collect()} == {1}


def test_four_cycle_shares_paths(spark):
    e = _graph(spark, [(1, 2), (2, 3), (3, 4), (1, 4)])
    assert {r.betweenness for r in G.edge_betweenness(e).collect()} == {2.0}
    assert {(r.root, r.node): r.paths for r in G.bfs_levels(e).collect()}[(1, 3)] == 2


def test_modularity_matches_pairs(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5)]
    labels = {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    deg = {v: sum(v in p for p in pairs) for v in labels}
    m2 = 2 * len(pairs)
    want = sum((((i, j) in pairs or (j, i) in pairs) - deg[i] * deg[j] / m2) / m2 for i in labels for j in labels if i != j and labels[i] == labels[j])
    got = G.modularity(_graph(spark, pairs), spark.createDataFrame(list(labels.items()), "id long, label int")).first()[0]
    assert got == pytest.approx(want, abs=1e-7)


def test_cold_starts(spark):
    train = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0), (2, 2, 2.0)], "user_id long, business_id long, rating double")
    test = spark.createDataFrame([(1, 9), (9, 1), (9, 9), (1, 1)], "user_id long, business_id long")
    got = {(r.user_id, r.business_id): (r.prediction, r.kind) for r in C.predict(train, test).collect()}
    assert got[1, 9] == (4.0, "new_item") and got[9, 1] == (4.5, "new_user") and got[9, 9] == (3.5, "new_both")
    assert got[1, 1] == (3.0, "neighbours")


def test_bloom_equals_a_simulation(spark):
    rng = random.Random(5)
    ids = [f"u{rng.randrange(60)}" for _ in range(200)]
    bits, on, seen, want = 97, set(), set(), {}
    for s, x in enumerate(ids):
        fp_tn = want.setdefault(s // 50, [0, 0])
        n, hit = int.from_bytes(x.encode(), "big"), True
        for a, b in K.AFFINE[: K.BLOOM_HASHES]:
            if (bit := (a * n + b) % bits) not in on:
                hit = False
                on.add(bit)
        if x not in seen:
            fp_tn[not hit] += 1
            seen.add(x)
    df = spark.createDataFrame([(s, s // 50, x) for s, x in enumerate(ids)], "seq long, batch long, id string")
    assert {r.batch: [r.fp, r.tn] for r in K.bloom_fpr(df, bits).collect()} == want


def test_nearest_neighbours_by_hand(spark):
    pts = spark.createDataFrame([(1, [0.0, 3.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 1.0], 1), (4, [0.0, 1.0], 1), (5, [-1.0, 0.0], 1), (6, [1.0, 1.0], 0)], "id long, v array<double>, label int")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "q long, v array<double>")
    near = S.nearest(q, pts, 3).orderBy("rank").collect()
    assert [r.id for r in near] == [3, 4, 5]
    assert S.vote(S.nearest(q, pts, 1)).first().label == 1
    for metric, d in (("manhattan", 2.0), ("chebyshev", 1.0), ("minkowski", 2 ** (1 / 3))):
        assert one(spark, S.distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)), metric)) == pytest.approx(d)
    with pytest.raises(ValueError):
        S.distance(F.lit(0), F.lit(0), "none")


def test_training_loops_take_in_every_point(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(4.0 * (i % 2), 1.0), rng.gauss(0.0, 1.0)], i % 2) for i in range(130)]
    points = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = M.self_training(points.where("id < 10"), points.where("id >= 10"), batch=50).collect()
    assert sorted(r.id for r in got) == list(range(130))
    for active in (True, False):
        curve = M.active_learning(points.where("id >= 30"), points.where("id < 30"), start=20, step=30, active=active).collect()
        assert [r.known for r in curve] == [20, 50, 80, 100]


def test_training_queries_take_in_every_row(spark):
    from orebed.plans.registry import QUERIES

    sf = f"{DATA}/sf0.001"
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    got = [r.id for r in QUERIES["self_training"](spark, sf).collect()]
    assert len(got) == len(ids) and set(got) == ids


def test_the_test_rows_of_models_grow_with_the_table(spark):
    from orebed.plans.ml import train_test

    train, test = (x.count() for x in train_test(spark, f"{DATA}/sf0.1"))
    n = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").count()
    assert train + test == n and abs(test - n / 5) <= 10


def test_numbered_and_totals_over_ranges(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(10_000), i) for i in range(400) for g in ("a", "b", None)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(5)
    got = R.numbered(df, ["k", "i"], ["g"]).where("g IS NOT NULL").collect()
    for g in ("a", "b"):
        want = sorted((k, i) for h, k, i in rows if h == g)
        assert [(r.k, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r["index"])] == want
    one = spark.createDataFrame([(float(k), k % 7) for k in range(300)], "k double, n int").repartition(4)
    assert all(r.n_below == sum(x % 7 for x in range(int(r.k))) for r in R.totals_below(one, "k", ["n"]).collect())
    assert R.numbered(df.limit(0), ["k"]).count() == 0


def test_quantiles_are_linear_between_neighbours(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 16)] + [(None,)], "x double").repartition(3)
    assert {r.share: r.value for r in R.quantiles(df, "x", [0.0, 0.3, 0.5, 1.0]).collect()} == {0.0: 1.0, 0.3: pytest.approx(2.4), 0.5: 4.0, 1.0: 16.0}


def test_bind_columns_keeps_rows_without_a_partner(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "x int"), spark.createDataFrame([("p",), ("q",)], "y string")
    assert sorted(map(tuple, R.bind_columns(a, ["x"], b, ["y"]).collect())) == [(0, 1, "p"), (1, 2, "q"), (2, 3, None)]


def test_requests_are_checked():
    assert R.check_range("2020-01-02", "2020-01-03", "2020-01-01", "2020-12-31") == ("2020-01-02", "2020-01-03")
    for bad in (("2020-01-03", "2020-01-02"), ("2019-12-31", "2020-01-02"), ("2020-13-01", "2020-01-02"), ("2020-01-02", "2021-01-01")):
        with pytest.raises(ValueError):
            R.check_range(*bad, "2020-01-01", "2020-12-31")
    assert R.check_choice(" us ", ["DE", "US"], "country") == "US"
    with pytest.raises(ValueError, match="DE, US"):
        R.check_choice("x", ["DE", "US"], "country")


def test_nearest_in_several_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 16)
    rng = random.Random(5)
    pts = [(i, [round(rng.random(), 1) for _ in range(3)], i % 3) for i in range(700)]
    q = [(1000 + i, [rng.random() for _ in range(3)]) for i in range(40)]
    p, qs = spark.createDataFrame(pts, "id long, v array<double>, label int").repartition(4), spark.createDataFrame(q, "q long, v array<double>")
    for metric, dist in (("euclidean", lambda g: sum(x * x for x in g) ** 0.5), ("manhattan", sum), ("chebyshev", max), ("minkowski", lambda g: sum(x**3 for x in g) ** (1 / 3))):
        got = {}
        for r in S.nearest(qs, p, 4, metric).collect():
            got.setdefault(r.q, {})[r["rank"]] = (r.d, r.id, r.label)
        for name, v in q:
            want = sorted((round(dist([abs(a - b) for a, b in zip(v, w, strict=True)]), 6), i, c) for i, w, c in pts)[:4]
            assert [got[name][k] for k in (1, 2, 3, 4)] == [(pytest.approx(d), i, c) for d, i, c in want]
    assert S.nearest(qs.limit(0), p, 4).count() == 0 and S.nearest(qs, p.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        S.nearest(qs, p, 1, "none")


def test_whitened_distance_is_mahalanobis(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.2]])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, v array<double>, label int")
    near = S.nearest(S.whitened(df.limit(60).select(F.col("id").alias("q"), "v"), df, 3), S.whitened(df, df, 3), 60).collect()
    inv = np.linalg.inv(np.cov(x.T))
    assert all(abs(r.d - np.sqrt((x[r.q] - x[r.id]) @ inv @ (x[r.q] - x[r.id]))) < 1e-4 for r in near)


def test_texts_paths_and_indented_json(spark, tmp_path):
    assert one(spark, T.list_text(F.array(F.lit("a"), F.lit("b")))) == "'a', 'b'"
    assert one(spark, T.xpath_of(T.dotted_path(F.array(F.lit("country"), F.lit("@id"))))) == "/country/@id"
    df = spark.createDataFrame([(1, None, [["u", "3"], ["v", "2"]])], "n int, s string, top array<array<string>>")
    writers.write_json_object(df, str(tmp_path / "o"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "o"), wholetext=True).collect())
    assert json.loads(text) == {"n": 1, "s": None, "top": [["u", "3"], ["v", "2"]]} and text.count("\n") > 3


def blobs(spark, n=240, k=3, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [rng.gauss(6.0 * (i % k == j), 1.0) for j in range(4)], i % k) for i in range(n)], "id long, v array<double>, label int")


def right(pairs):
    rows = pairs.collect()
    return sum(r.label == r.guess for r in rows) / len(rows)


def test_classifiers_and_search_tell_blobs_apart(spark):
    train, test = blobs(spark), blobs(spark, 90, seed=2)
    assert right(M.l1_classifier(train, test)) >= 0.95
    assert right(M.rbf_svm(train, test, dims=4, gamma=0.05)) >= 0.95
    assert right(M.cluster_classifier(train, test, k=3)) >= 0.95
    assert max(r.f1 for r in M.grid_search(train, [0.003, 0.03], k=3).collect()) >= 0.95


def test_clusters_and_spectral_find_blobs(spark):
    df = blobs(spark)
    scores = {r.k: r.silhouette for r in M.choose_k(df, [2, 3, 6]).collect()}
    assert max(scores, key=scores.get) == 3
    loss = M.kmeans_monte_carlo(df, 3, runs=3).first()
    assert loss.runs == 3 and 0 <= loss.mean_loss <= 0.4
    two = blobs(spark, 120, k=2)
    got = M.spectral(two, 2, gamma=0.05)
    assert got.count() == 120
    assert right(got.join(M.majority(got), "cluster")) >= 0.9


def test_smote_points_lie_between_neighbours_of_the_class(spark):
    df = blobs(spark, 60)
    made = M.smote(df, minority=1, k=3, copies=2).collect()
    few = {r.id: r.v for r in df.where("label = 1").collect()}
    assert len(made) == 2 * len(few) and len({r.id for r in made}) == len(made) and {r.label for r in made} == {1}
    for r in made:
        on = lambda a, b, v=r.v: max(abs((b[j] - a[j]) * (v[0] - a[0]) - (b[0] - a[0]) * (v[j] - a[j])) for j in range(4)) < 1e-6 and min(a[0], b[0]) - 1e-9 <= v[0] <= max(a[0], b[0]) + 1e-9
        assert any(on(a, b) for x, a in few.items() for y, b in few.items() if x != y)


def test_boosted_trees_beat_the_overall_mean(spark):
    rng = random.Random(3)
    rows = [(u, b, min(5.0, max(1.0, 3 + (u % 3 - 1) + (b % 3 - 1) * 0.7 + rng.gauss(0, 0.3)))) for u in range(40) for b in range(25) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "user_id long, business_id long, rating double")
    test = df.where("(user_id * 7 + business_id) % 5 = 0")
    train = df.where("(user_id * 7 + business_id) % 5 <> 0")
    got = M.boosted_ratings(train, test.select("user_id", "business_id")).join(test, ["user_id", "business_id"]).collect()
    mean = train.agg(F.avg("rating")).first()[0]
    assert len(got) == test.count()
    assert sum((r.prediction - r.rating) ** 2 for r in got) < 0.3 * sum((mean - r.rating) ** 2 for r in got)


def test_bfr_puts_every_point_once_and_reports_each_round(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(30.0 * (i % 3), 1.0), rng.gauss(-20.0 * (i % 3), 1.0)]) for i in range(600)] + [(900 + i, [500.0 + 200 * i, 900.0]) for i in range(3)]
    found, lines = M.bfr(spark.createDataFrame(rows, "id long, v array<double>"), k=3, dims=2)
    got = {r.id: r.cluster for r in found.collect()}
    assert len(got) == found.count() == 603
    assert len(lines) == 5 and [x[0] for x in lines] == [1, 2, 3, 4, 5] and lines[-1][1] + lines[-1][3] + lines[-1][4] == 603
    groups = [{got[i] for i in range(600) if i % 3 == g and got[i] >= 0} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert all(got[900 + i] == -1 for i in range(3))


def _plain_sums(users):
    want = {}
    for r in users:
        for a, x in r:
            for b, y in r:
                if a < b:
                    n, p, q = want.setdefault((a, b), [None, None, None])
                    add = lambda s, *v: s if None in v else (s or 0.0) + v[0] * v[-1]
                    want[a, b] = [add(n, x, y), add(p, x, x), add(q, y, y)]
    return want


@pytest.mark.parametrize("dense", [1 << 22, 150, 0])
def test_pair_sums_are_added_up_before_the_shuffle(dense, monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    monkeypatch.setattr(C, "DENSE", dense)
    monkeypatch.setattr(C, "CHUNK", 300)
    users = [[(i, rng.choice((None, 0.5, -1.25, 2.0))) for i in sorted(rng.sample(range(12 * (k // 100), 12 * (k // 100) + 12), rng.randrange(2, 9)))] for k in range(300)]
    kind = pa.schema([("la", pa.list_(pa.int64())), ("lx", pa.list_(pa.float64())), ("ra", pa.list_(pa.int64())), ("rx", pa.list_(pa.float64()))])
    cut = lambda r, c: [math.nan if c and x[c] is None else x[c] for x in r]
    rows = [{"la": cut(r, 0), "lx": cut(r, 1), "ra": None, "rx": None} for r in users]
    rows += [{"la": cut(r[:2], 0), "lx": cut(r[:2], 1), "ra": cut(r[2:], 0), "rx": cut(r[2:], 1)} for r in users if len(r) > 2]
    whole = users + [[p, q] for r in users for p in r[:2] for q in r[2:]]
    got, n = {}, 0
    for b in C._sums(iter([pa.RecordBatch.from_pylist(rows[lo : lo + 60], schema=kind) for lo in range(0, len(rows), 60)])):
        for r in b.to_pylist():
            s = got.setdefault((r["a"], r["b"]), [None, None, None])
            got[r["a"], r["b"]] = [t if r[c] is None else (t or 0.0) + r[c] for t, c in zip(s, "npq", strict=True)]
            n += 1
    want = _plain_sums(whole)
    assert got.keys() == want.keys()
    assert all(g == (pytest.approx(w) if w is not None else None) for k in want for g, w in zip(got[k], want[k], strict=True))
    if dense > 1000:
        assert n == len(want)  # a pair leaves a task once, not once a user


def test_long_lists_of_ratings_are_paired_by_slices(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(u, b, rng.choice((None, 1.0, 2.5, 4.0, 5.0))) for u in [*range(20), None] for b in rng.sample(range(30), rng.randrange(1, 20))]
    train = spark.createDataFrame(rows, "user_id long, business_id int, rating double")
    whole = sorted(map(tuple, C.item_similarity(train).selectExpr("a", "b", "round(weight, 9)").collect()))
    monkeypatch.setattr(C, "SIDE", 3)
    assert sorted(map(tuple, C.item_similarity(train).selectExpr("a", "b", "round(weight, 9)").collect())) == whole
    by = {u: {b: r for v, b, r in rows if v == u} for u in range(20)}
    assert [w[:2] for w in whole] == sorted({(a, b) for r in by.values() for a in r for b in r if a < b})


def _with_twins(seed, n=14, p=0.2):
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p]
    copies = {v: [v + 100 * c for c in range(rng.choice((1, 1, 3)))] for v in range(n)}
    return [(x, y) for a, b in pairs for x in copies[a] for y in copies[b]] + [(x, y) for c in copies.values() for x in c for y in c if x < y]


def _plain_betweenness(adjacent):
    total = {}
    for root in adjacent:
        level, paths, order = {root: 0}, {root: 1}, [root]
        for v in order:
            for w in adjacent[v]:
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for v in adjacent[w]:
                if level[v] == level[w] - 1:
                    credit[v] += (flow := credit[w] * paths[v] / paths[w])
                    total[min(v, w), max(v, w)] = total.get((min(v, w), max(v, w)), 0.0) + flow / 2
    return total


def _neighbours(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_of_a_held_graph_equals_plain_and_tables(spark, seed, monkeypatch):
    pairs = _with_twins(seed)
    want = {k: pytest.approx(x, abs=2e-5) for k, x in _plain_betweenness(_neighbours(pairs)).items()}
    rows = lambda **k: {(r.a, r.b): r.betweenness for r in G.edge_betweenness(_graph(spark, pairs), **k).collect()}
    monkeypatch.setattr(G, "bfs_levels", None)  # no table of all roots and vertices
    assert rows() == want
    compat = rows(compat=True)
    monkeypatch.undo()
    monkeypatch.setattr(G, "HELD_EDGES", 0)
    assert rows(compat=True) == {k: pytest.approx(x, abs=2e-5) for k, x in compat.items()}


@pytest.mark.parametrize("seed", range(4))
def test_divisive_search_over_classes_equals_the_plain_one(spark, seed, monkeypatch):
    pairs = _with_twins(seed)
    whole, adjacent, m2 = _neighbours(pairs), _neighbours(pairs), 2 * len(pairs)

    def parts():
        left, out = set(adjacent), []
        while left:
            todo = [left.pop()]
            for v in todo:
                todo += (new := adjacent[v] & left)
                left -= new
            out.append(sorted(todo))
        return sorted(out, key=lambda p: (len(p), p))

    best, found = float("-inf"), parts()
    while any(adjacent.values()):
        between = _plain_betweenness(adjacent)
        for (a, b), x in between.items():
            if x > max(between.values()) - 1e-9:
                adjacent[a].discard(b)
                adjacent[b].discard(a)
        q = sum(sum((j in whole[i]) - len(whole[i]) * len(whole[j]) / m2 for i in p for j in p if i != j) for p in parts()) / m2
        if q > best + 1e-12:
            best, found = q, parts()
    asked, plain = [], G._betweenness
    monkeypatch.setattr(G, "_betweenness", lambda adjacent, size, nodes: asked.append(len(nodes)) or plain(adjacent, size, nodes))
    assert [r.members for r in G.girvan_newman(_graph(spark, pairs)).collect()] == [", ".join(f"'{v}'" for v in p) for p in found]
    assert max(asked) < len(whole)  # copies count as one


def test_predictions_write_the_training_rows_once_and_join_pairs_in_one_order(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(u, b, float(rng.randrange(1, 6))) for u in range(12) for b in rng.sample(range(9), 5)]
    train = spark.createDataFrame(rows, "user_id long, business_id long, rating double")
    wrote, plain = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: wrote.append(name) or plain(df, name))
    got = C.predict(train, train.select("user_id", "business_id").where("business_id < 3"))
    assert sorted(wrote) == ["ratings", "train"]
    assert got.count() == len({(u, b) for u, b, _ in rows if b < 3})
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()  # similarities are not doubled


@pytest.fixture(scope="module")
def copied_users(tmp_path_factory):
    """A folder whose events are those of the smallest tables, each user's places held by three users; and DuckDB on it."""
    to = tmp_path_factory.mktemp("copied")
    con = duckdb.connect()
    con.sql(f"COPY (SELECT event_id + 1000 * c AS event_id, ts, user_id + 15 * c AS user_id, event_type, value, props FROM '{DATA}/sf0.001/events.parquet', range(3) AS r(c)) TO '{to}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{to}/events.parquet'")
    return str(to), con


class Counted:
    """A function that counts its calls."""

    def __init__(self, f):
        self.f, self.calls = f, 0

    def __call__(self, *args):
        self.calls += 1
        return self.f(*args)


def _sparse_sets(seed):
    rnd = random.Random(seed)
    sets = [frozenset(rnd.sample(range(14), 5)) for _ in range(16)] + [frozenset(range(50, 55)), frozenset(range(60, 65))]
    return [*sets * 2, *sets[:-1], frozenset(range(70, 75))], 3  # copies, a class without another, two lone keys


def _classes_and_edges(spark, seed):
    sets, least = _sparse_sets(seed)
    rows = spark.createDataFrame([(k, i) for k, s in enumerate(sets) for i in s], "key long, item int")
    pairs = sorted((a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and len(sets[a] & sets[b]) >= least)
    return G.shared_item_classes(rows, least), pairs, rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("held", [1 << 21, 0])
def test_levels_of_classes_equal_those_of_their_members(spark, seed, held, monkeypatch):
    (links, members), pairs, rows = _classes_and_edges(spark, seed)
    assert sorted(map(tuple, G.shared_item_edges(rows, 3).collect())) == pairs
    assert links.count() * 4 <= len(pairs)  # copies are compared once
    monkeypatch.setattr(G, "HELD_EDGES", held)
    near, want = _neighbours(pairs), []
    for root in near:
        level, paths, order = {root: 0}, {root: 1}, [root]
        for v in order:
            for w in near[v]:
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        want += [(root, v, level[v], paths[v]) for v in order]
    assert sorted(map(tuple, G.bfs_levels(links, members).collect())) == sorted(want)
    assert sorted(map(tuple, G.bfs_levels(spark.createDataFrame(pairs, "src long, dst long")).collect())) == sorted(want)


def test_more_shortest_paths_than_a_long_are_an_error(spark):
    pairs = [(a, b) for level in range(6) for a in (10 * level, 10 * level + 1) for b in (10 * level + 10, 10 * level + 11)]
    members = spark.createDataFrame([(v, v, 10**4) for p in pairs for v in p], "id long, class long, n long").distinct()
    with pytest.raises(Exception, match="more shortest paths"):
        G.bfs_levels(_graph(spark, pairs), members).count()


def test_levels_of_copied_users_agree_with_sql(spark, copied_users, monkeypatch):
    monkeypatch.setattr(G, "_by_member", _counted := Counted(G._by_member))
    assert_same(QUERIES["bfs_levels"](spark, copied_users[0]), copied_users[1], ORACLE_SQL["bfs_levels"])
    assert _counted.calls == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_classes_equal_those_of_their_members(spark, seed):
    (links, members), pairs, _ = _classes_and_edges(spark, seed)
    want = sorted(map(tuple, G.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()))
    assert sorted(map(tuple, G.connected_components(links, members).collect())) == want


def test_components_of_copied_users_agree_with_sql_without_their_edges(spark, copied_users, monkeypatch):
    monkeypatch.setattr(G, "_by_member", None)
    assert_same(QUERIES["connected_components"](spark, copied_users[0]), copied_users[1], ORACLE_SQL["connected_components"])


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("rounds", [1, 3])
def test_labels_of_classes_equal_those_of_their_members(spark, seed, rounds):
    (links, members), pairs, _ = _classes_and_edges(spark, seed)
    near = _neighbours(pairs)
    label = {v: v for v in near}
    for _ in range(rounds):
        counts = {v: Counter(label[w] for w in near[v]) for v in near}
        label = {v: min(c, key=lambda x: (-c[x], x)) for v, c in counts.items()}
    assert dict(map(tuple, G.label_propagation(links, rounds, members).collect())) == label


def test_labels_of_copied_users_agree_with_sql_without_their_edges(spark, copied_users, monkeypatch):
    monkeypatch.setattr(G, "_by_member", None)
    assert_same(QUERIES["label_propagation"](spark, copied_users[0]), copied_users[1], ORACLE_SQL["label_propagation"])


@pytest.mark.parametrize("seed", [1, 2])
def test_modularity_of_classes_equals_that_of_their_members(spark, seed):
    (links, members), pairs, _ = _classes_and_edges(spark, seed)
    labels = spark.createDataFrame([(r.id, r.id % 4) for r in members.collect()], "id long, label long")
    want = G.modularity(spark.createDataFrame(pairs, "src long, dst long"), labels).first()[0]
    assert G.modularity(links, labels, members).first()[0] == pytest.approx(want, abs=2e-8)


def test_modularity_of_copied_users_agrees_with_sql_without_their_edges(spark, copied_users, monkeypatch):
    monkeypatch.setattr(G, "_by_member", None)
    assert_same(QUERIES["modularity"](spark, copied_users[0]), copied_users[1], ORACLE_SQL["modularity"])


def test_nearest_adds_up_few_distances_and_keeps_the_exact_order(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=(900, 6)) * rng.choice([1e-4, 1.0, 30.0], size=(900, 1)), 3)  # ties and copies among them
    v[5], v[17, 2] = v[4], np.nan  # and a distance that is none
    q = rng.choice(v, 300)
    ids = rng.permutation(900)
    batches = [pa.RecordBatch.from_pydict({"id": ids[n : n + 250], "v": pa.array(v[n : n + 250].tolist()), "label": pa.array([int(i) % 3 for i in ids[n : n + 250]])}) for n in range(0, 900, 250)]
    monkeypatch.setattr(S, "AT_ONCE", (64, 128))
    tables = {}
    for metric in ("euclidean", "manhattan"):
        tables[metric] = [r for b in S._near(np.arange(300), q, 7, metric, 3.0)(iter(batches)) for r in b.to_pylist()]
        full = np.round(S._distances(q, v, metric, 3.0), 6)
        want = [(a, ids[j], full[a, j]) for a in range(300) for j in np.lexsort((ids, full[a]))[:7]]
        got = sorted(((r["q"], r["d"], r["id"]) for r in tables[metric]), key=lambda r: (r[0], np.nan_to_num(r[1], nan=np.inf), r[2]))
        assert [(a, i) for a, _, i in got] == [(a, i) for a, i, _ in want]
        np.testing.assert_array_equal([d for _, d, _ in got], [d for *_, d in want])
        assert all(r["label"] == r["id"] % 3 for r in tables[metric])
    added, plain = [], S.reduce
    monkeypatch.setattr(S, "reduce", lambda f, xs, start: added.append(len(start)) or plain(f, xs, start))
    monkeypatch.setattr(S, "AT_ONCE", (1024, 4096))
    v = rng.normal(size=(900, 6))
    one = pa.RecordBatch.from_pydict({"id": ids, "v": pa.array(v.tolist()), "label": pa.array([0] * 900)})
    list(S._near(np.arange(300), v[:300], 7, "euclidean", 3.0)(iter([one])))
    assert sum(added) < 300 * 8  # of 300 x 900
