"""Fits on every column, search, contributions and the neighborhood model, on tables with a planted signal."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import boosting as B
from verdigris.operators import hops as H
from verdigris.operators import models as L
from verdigris.operators import neighborhood as N
from verdigris.operators import tree_contributions as C
from verdigris.operators import tuning as T
from verdigris.operators.evaluation import auc_metrics
from verdigris.operators.tuning import draw_points, successive_halving
from verdigris.plans.catalog import learning_queries as Q

COLUMNS = [f"c{k}" for k in range(8)]


@pytest.fixture(scope="module")
def accounts(spark):
    """600 accounts; the label follows c5, c6 and the neighbors' c7, which a model on the first columns misses."""
    rng = random.Random(9)
    inner = [rng.random() < 0.25 for _ in range(600)]
    links = []
    for i in range(600):
        for _ in range(3):
            j = rng.choice([k for k in range(600) if inner[k] == inner[i]]) if rng.random() < 0.8 else rng.randrange(600)
            if i != j:
                links.append((min(i, j), max(i, j)))
    rows = []
    for i in range(600):
        x = [rng.gauss(0, 1) for _ in range(8)]
        x[5] += 1.2 * inner[i]
        x[6] *= 1 + inner[i]
        x[7] += 1.0 * inner[i]
        rows.append((i, float(inner[i]), ["train", "train", "train", "val", "test"][i % 5], i % 5, *x))
    schema = "account_id INT, label DOUBLE, split STRING, fold INT, " + ", ".join(f"{c} DOUBLE" for c in COLUMNS)
    table = spark.createDataFrame(rows, schema).coalesce(2).cache()
    edges = spark.createDataFrame(sorted(set(links)), "account_id_1 INT, account_id_2 INT").cache()
    return table, edges


def precision(df, score):
    rows = df.select(F.lit("m").alias("model"), F.col("label").cast("int").alias("label"), F.col(score).alias("score"))
    return auc_metrics(rows, ["model"]).first()["pr_auc"]


@pytest.fixture(scope="module")
def fitted(accounts):
    return L.fit_stopped(accounts[0], COLUMNS, maxIter=25, maxDepth=3)


def test_fit_stops_and_beats_few_columns(accounts, fitted):
    table, _ = accounts
    held = table.filter("split = 'val'")
    small = L.fit_stopped(table, COLUMNS[:4], maxIter=25, maxDepth=3)
    whole, few = (L.fit_report(m, held, c, n).first() for m, c, n in ((fitted, COLUMNS, "whole"), (small, COLUMNS[:4], "small")))
    assert whole["pr_auc"] > few["pr_auc"] + 0.1
    assert whole["columns"] == 8 and few["trees"] < 25  # noise alone stops early
    assert L.bounded_rows(table, 100).count() < 200 and L.bounded_rows(table, 600).count() == 600
    assert L.fit_stopped(table.filter("split <> 'val'"), COLUMNS, maxIter=3).stages[-1].getNumTrees == 3  # nothing to watch


def test_fits_read_every_labelled_row(accounts, monkeypatch):
    def cut(*_, **__):
        raise AssertionError("labelled rows are cut")

    table, edges = accounts
    for module in (L, N, T):
        monkeypatch.setattr(module, "bounded_rows", cut, raising=False)
    assert L.fit_stopped(table, COLUMNS, maxIter=2, maxDepth=2).stages[-1].getNumTrees == 2
    wide = N.hop_layers(table.select("account_id", "label", "split", *COLUMNS[:3]), edges, COLUMNS[:3], table.filter("split = 'train'"))
    assert len(N.fit_neighborhood(wide, COLUMNS[:3], epochs=4).history) == 1
    monkeypatch.setattr(Q, "PART_ROWS", 30)  # the partitions follow the rows, so that none grows with the table
    assert Q.fit_parts(table.repartition(40)).rdd.getNumPartitions() == 20


def test_contributions_add_up(accounts, fitted, spark):
    table, _ = accounts
    odd = spark.createDataFrame([(1000, *[0.0] * 8), (1001, *[1e9] * 8), (1001, *[1e9] * 8), (1002, *[-1e9] * 8)], "account_id INT, " + ", ".join(f"{c} DOUBLE" for c in COLUMNS))
    rows = table.select("account_id", *COLUMNS).unionByName(odd)
    found = C.tree_contributions(fitted, rows, COLUMNS)
    scored = L.score(fitted, rows, COLUMNS).select("account_id", "proba").distinct()
    for r in found.join(scored, "account_id").collect():
        assert math.isclose(r.base + sum(r["values"]), r.raw, abs_tol=1e-9)
        assert math.isclose(1 / (1 + math.exp(-2 * r.raw)), r.proba, abs_tol=1e-12)
    assert found.count() == 604
    # One account by hand: walk every tree of the node table.
    nodes = {(n.tree, n.node): n for n in C.tree_nodes(fitted).collect()}
    one = table.filter("account_id = 17").first()
    want = dict.fromkeys(COLUMNS, 0.0)
    for tree in range(fitted.stages[-1].getNumTrees):
        n = nodes[tree, 0]
        while n.feature >= 0:
            after = nodes[tree, n.left if one[COLUMNS[n.feature]] <= n.threshold else n.right]
            want[COLUMNS[n.feature]] += n.weight * (after.value - n.value)
            n = after
    long = {r.feature: r.value for r in C.by_feature(found.filter("account_id = 17"), COLUMNS).collect()}
    assert all(math.isclose(long.get(c, 0.0), v, abs_tol=1e-12) for c, v in want.items())
    top = C.strongest(C.by_feature(found, COLUMNS), 2).filter("account_id = 17").orderBy("place").collect()
    assert [r.feature for r in top] == sorted(long, key=lambda c: (-abs(long[c]), c))[:2]
    sizes = {r.feature: r.mean_abs for r in C.mean_sizes(C.by_feature(found, COLUMNS), 604).collect()}
    assert max(sizes, key=sizes.get) in ("c5", "c7")
    assert C.tree_contributions(fitted, rows.limit(0), COLUMNS).count() == 0
    with pytest.raises(Exception, match="null"):
        C.tree_contributions(fitted, rows.withColumn("c3", F.lit(None).cast("double")), COLUMNS).collect()


def test_wanted_ablation(accounts, fitted, spark):
    table, _ = accounts
    wanted = spark.createDataFrame([(3, "c5"), (3, "c0"), (8, "c7")], "account_id INT, feature STRING")
    medians = L.medians(table, ["c0", "c5", "c7"])
    got = {(r.account_id, r.feature): r.proba for r in L.ablate_wanted(fitted, table, COLUMNS, wanted, medians).collect()}
    every = L.ablate(fitted, table, COLUMNS, ["c0", "c5", "c7"], medians, ["account_id"])
    whole = {(r.account_id, r.feature): r.proba for r in every.collect()}
    assert set(got) == {(3, ""), (3, "c5"), (3, "c0"), (8, ""), (8, "c7")} and all(whole[k] == v for k, v in got.items())


def test_halving_keeps_the_best(accounts):
    table, _ = accounts
    points = draw_points(4)
    assert points == draw_points(6)[:4] and draw_points(4, seed=1) != points
    found = successive_halving(table.filter("split = 'train'"), COLUMNS, points, trees=1, rungs=2, folds=3).collect()
    first, last = ([r for r in found if r.rung == k] for k in (0, 1))
    assert len(first) == 12 and len(last) == 6 and {r.trees for r in last} == {2}
    mean = {r.point: r.mean_pr_auc for r in first}
    assert {r.point for r in last} == set(sorted(mean, key=lambda p: (-mean[p], p))[:2])
    for p in mean:
        assert math.isclose(mean[p], np.mean([r.pr_auc for r in first if r.point == p]))
    best = [r for r in last if r.kept]
    assert len({r.point for r in best}) == 1 and best[0].mean_pr_auc == max(r.mean_pr_auc for r in last)


def test_the_whole_space_is_drawn():
    points = draw_points(Q.POINTS)
    seen = {name: [p[name] for p in points] for name in points[0]}
    assert len(points) == 50 and set(seen) == set(T.SPACE)
    assert min(seen["max_depth"]) <= 6 and max(seen["max_depth"]) >= 14  # no draw is cut to a flatter tree
    assert min(seen["n_estimators"]) < 300 and max(seen["n_estimators"]) > 900
    for name, (low, high, _, _) in T.SPACE.items():
        assert low <= min(seen[name]) and max(seen[name]) <= high and len(set(seen[name])) > 10


def test_a_rung_ends_with_the_trees_asked_for(accounts):
    table, _ = accounts
    points = [{**p, "n_estimators": 5 + k} for k, p in enumerate(draw_points(2))]
    found = successive_halving(table.filter("split = 'train'"), COLUMNS, points, rungs=2, folds=3).collect()
    assert {(r.rung, r.point, r.trees) for r in found} == {(0, 0, 2), (0, 1, 3), (1, *next((r.point, 5 + r.point) for r in found if r.rung == 1))}


def test_binned_trees(accounts):
    """Against every split tried by hand, over a layout of the same rows, and carried on from fewer trees."""
    table, _ = accounts
    rows = table.toPandas()
    x = np.stack([np.searchsorted(np.sort(rows[c].unique())[::4], rows[c]) for c in COLUMNS], axis=1).astype(np.uint8)
    rng = np.random.default_rng(1)
    g, h, bag = rng.normal(size=600), rng.random(600) + 0.1, rng.random(600) < 0.8
    point = {**draw_points(1)[0], "num_leaves": 2, "max_depth": 1, "min_child_samples": 20, "reg_alpha": 0.5, "reg_lambda": 2.0}
    value = lambda at: np.sign(g[at].sum()) * max(abs(g[at].sum()) - 0.5, 0) / (h[at].sum() + 2)
    worth = lambda at: value(at) ** 2 * (h[at].sum() + 2)
    sides = [(x[:, c] <= b) for c in range(8) for b in range(x.max())]
    best = max((worth(s & bag) + worth(~s & bag) for s in sides if min((s & bag).sum(), (~s & bag).sum()) >= 20))
    leaves = B.grow_tree(x, g, h, bag, int(x.max()) + 1, point)
    masks = [np.isin(np.arange(600), rows) & bag for rows, _ in leaves]
    assert math.isclose(sum(worth(m) for m in masks), best) and all(math.isclose(v, -value(m)) for m, (_, v) in zip(masks, leaves, strict=True))
    deep = {**point, "num_leaves": 20, "max_depth": 4, "min_child_samples": 5, "learning_rate": 0.1}
    leaves = B.grow_tree(x, g, h, bag, int(x.max()) + 1, deep)
    assert sorted(np.concatenate([r for r, _ in leaves])) == list(range(600)) and 2 < len(leaves) <= 16
    assert all(math.isclose(v, -value(np.isin(np.arange(600), r) & bag), abs_tol=1e-9) and (bag[r]).sum() >= 5 for r, v in leaves)
    y, learn = rows["label"].to_numpy().astype(np.uint8), rows["fold"].to_numpy() != 1
    whole, few = B.boosted_margins(x, y, learn, deep, 9), B.boosted_margins(x, y, learn, deep, 4)
    assert np.array_equal(B.boosted_margins(x, y, learn, deep, 9, raw=few[0], made=few[1])[0], whole[0]) and whole[1] == 9
    p = 1 / (1 + np.exp(-B.boosted_margins(x, y, learn, deep, 40)[0]))
    assert p[~learn & (y == 1)].mean() > p[~learn & (y == 0)].mean() + 0.1  # it learns
    doubled = table.unionByName(table.limit(50).withColumn("c1", F.lit(0.0)))
    found = [
        sorted(map(tuple, successive_halving(t, COLUMNS, draw_points(2), trees=2, rungs=2).select("rung", "point", "fold", "pr_auc").collect()))
        for t in (doubled.coalesce(1), doubled.repartition(7, "c2"))
    ]
    assert found[0] == found[1]
    with pytest.raises(Exception, match="null"):
        successive_halving(table.withColumn("c3", F.lit(None).cast("double")), COLUMNS, draw_points(2), trees=1).collect()


def test_bins_follow_all_values(spark):
    rows = spark.createDataFrame([(float(k), float(k % 7), float(k > 10)) for k in range(1, 1001)], "a DOUBLE, b DOUBLE, c DOUBLE")
    a, b, c = B.bin_edges(rows, ["a", "b", "c"])
    assert list(b) == list(range(7)) and list(c) == [0.0, 1.0]
    sizes = np.diff(a, prepend=0)
    assert len(a) == 255 and a[-1] == 1000 and sizes.min() >= 3 and sizes.max() <= 5


@pytest.mark.parametrize("kind", ["int", "string"])
@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_linked_means_are_those_of_a_join(spark, kind, slice_rows):
    """Against join and ``avg``, with nulls, repeated rows and links, and accounts on one side only; no join of links and vectors."""
    rng = random.Random(3)
    rows = [(k % 45, rng.gauss(0, 1), None if k % 3 == 0 else float(k), rng.randrange(9)) for k in range(50)] + [(None, 1.0, 1.0, 1), (60, None, None, None)]
    layer = spark.createDataFrame(rows, "account_id INT, a DOUBLE, b DOUBLE, c INT").withColumn("account_id", F.col("account_id").cast(kind))
    pairs = [(rng.randrange(55), rng.randrange(55)) for _ in range(400)] + [(3, 4), (3, 4), (3, None), (58, 60), (59, 59)]
    links = spark.createDataFrame(pairs, "src INT, dst INT").select(F.col("src").cast(kind), F.col("dst").cast(kind))
    joined = links.join(layer.withColumnRenamed("account_id", "dst"), "dst").groupBy(F.col("src").alias("account_id"))
    want = {r.account_id: r for r in joined.agg(*[F.avg(c).alias(c) for c in "abc"]).collect()}
    means = H.linked_means(links, layer, ["a", "b", "c"], slice_rows)
    assert means.dtypes == [("account_id", kind), ("a", "double"), ("b", "double"), ("c", "double")]
    got = {r.account_id: r for r in means.collect()}
    assert set(got) == set(want) and len(got) == means.count()
    for k, r in want.items():
        assert all((x is None and y is None) or math.isclose(x, y, abs_tol=1e-12) for x, y in zip(r[1:], got[k][1:], strict=True))
    assert "Join" not in means._sc._jvm.PythonSQLUtils.explainString(means._jdf.queryExecution(), "simple")
    assert H.linked_means(links.limit(0), layer, ["a"], slice_rows).count() == 0 == H.linked_means(links, layer.limit(0), ["a"], slice_rows).count()


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(size=(30, 3, 5)), (rng.random(30) < 0.4).astype(float), rng.random(30) + 0.5
    theta = N.start_parameters(5, 3, 4) + 0.1 * rng.normal(size=N.parameter_count(5, 3, 4))
    loss, gradient = N.loss_and_gradient(theta, x, y, w, 3, 4)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        up, down = (N.loss_and_gradient(theta + s * step, x, y, w, 3, 4)[0] for s in (1, -1))
        assert math.isclose((up - down) / 2e-6, gradient[k], rel_tol=1e-4, abs_tol=1e-5)
    a, b = (N.loss_and_gradient(theta, x[s], y[s], w[s], 3, 4) for s in (slice(0, 11), slice(11, 30)))
    assert math.isclose(a[0] + b[0], loss) and np.allclose(a[1] + b[1], gradient)  # sums over blocks


def test_neighborhood_model(accounts):
    table, edges = accounts
    held = table.filter("split = 'val'").select("account_id", "label")
    seen = {}
    for name, columns in (("whole", COLUMNS), ("few", COLUMNS[:3])):
        wide = N.hop_layers(table.select("account_id", "label", "split", *columns), edges, columns, table.filter("split = 'train'"))
        model = N.fit_neighborhood(wide, columns, epochs=60)
        out = N.predict(model, wide)
        assert out.columns == ["account_id", "label", "split", "proba_neighborhood"] and out.count() == 600
        seen[name] = precision(out.join(held.select("account_id"), "account_id"), "proba_neighborhood")
        looks = [p for _, _, p in model.history]
        assert math.isclose(seen[name], max(looks), rel_tol=1e-9)  # the best parameters are kept
        assert len(looks) == 15 or looks.index(max(looks)) == len(looks) - 6  # stopped after five looks without a rise
    assert seen["whole"] > seen["few"] + 0.1
