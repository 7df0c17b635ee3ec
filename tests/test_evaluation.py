"""Exact metrics, ranks and quantiles against numpy."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from verdigris.functions.running import quantiles, ranked, running_sums
from verdigris.operators import evaluation as M
from verdigris.operators import rings, splits


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    data = [(i, "m", int(rng.random() < 0.2), rng.randrange(12) / 12) for i in range(300)]
    return data, spark.createDataFrame(data, "account_id INT, model STRING, label INT, score DOUBLE")


def test_auc_and_average_precision_with_ties(scored):
    data, df = scored
    y, s = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, seen = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        recall, precision = y[s >= t].sum() / y.sum(), y[s >= t].mean()
        ap += (recall - seen) * precision
        seen = recall
    got = M.auc_metrics(df, ["model"]).first()
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)


def test_one_class_and_equal_scores(spark):
    one = spark.createDataFrame([("m", 1, 0.3), ("m", 1, 0.4)], "model STRING, label INT, score DOUBLE")
    assert M.auc_metrics(one, ["model"]).first()["roc_auc"] == 0.0
    flat = spark.createDataFrame([("m", 1, 0.3), ("m", 0, 0.3)], "model STRING, label INT, score DOUBLE")
    assert M.auc_metrics(flat, ["model"]).first()["roc_auc"] == 0.5
    # every threshold up to 0.3 costs the same: the first wins
    assert M.best_threshold(flat, ["model"]).first()["threshold"] == pytest.approx(0.01)


@pytest.mark.parametrize("points", [199, 197])
def test_threshold_costs_every_grid_point(scored, points):
    data, df = scored
    y, s = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    for r in M.threshold_costs(df, ["model"], points).collect():
        flag = s >= r["threshold"]
        assert (r["tp"], r["fp"]) == ((flag & (y == 1)).sum(), (flag & (y == 0)).sum())


def test_operating_point_falls_back_to_f1(scored):
    _, df = scored
    curve = M.top_k_curve(df, ["model"])
    best = M.operating_point(curve, ["model"], min_recall=2.0).first()
    assert best["f1"] == pytest.approx(max(r["f1"] for r in curve.collect()))


def test_running_sums_and_ranks_per_group(spark):
    rng = random.Random(9)
    data = [("big" if rng.random() < 0.6 else f"g{rng.randrange(5)}", i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(data, "g STRING, i INT, v BIGINT")
    got = {(r["g"], r["i"]): (r["n"], r["total"]) for r in running_sums(df, [F.col("v").desc(), F.col("i").asc()], {"n": F.lit(1).cast("bigint"), "total": F.col("v")}, ["g"]).collect()}
    for g in {d[0] for d in data}:
        total = 0
        for n, (_, i, v) in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (-d[2], d[1])), 1):
            total += v
            assert got[(g, i)] == (n, total)
    assert sorted(r[0] for r in ranked(df, [F.col("i").asc()]).select("rank").collect()) == list(range(1, 501))


def test_quantiles_interpolate(spark):
    vals = [1.0, 2.0, 4.0, 4.0, 9.5]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 7.0)], "g STRING, v DOUBLE")
    got = {r[0]: r[1:] for r in rows(quantiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9, "p25": 0.25}), "g", "p50", "p90", "p25")}
    assert got["a"] == pytest.approx(tuple(np.quantile(vals, [0.5, 0.9, 0.25]))) and got["b"] == (7.0, 7.0, 7.0)


def test_candidate_needs_two_members_of_a_ring(spark):
    m = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 3), ("c2", 9)], "candidate_id STRING, account_id INT")
    truth = spark.createDataFrame([(1, "R", True), (2, "R", True), (3, "R", True), (9, None, False)], "account_id INT, abuse_ring_id STRING, true_ring_member BOOLEAN")
    assert rows(rings.candidate_labels(m, rings.positive_rings(m, truth))) == [("c1", 1, 1), ("c2", 0, 0)]


def test_candidates_sharing_rings_form_one_group(spark):
    c = spark.createDataFrame([(f"c{i}",) for i in range(1, 5)], "candidate_id STRING")
    p = spark.createDataFrame([("c1", "A"), ("c2", "B"), ("c3", "A"), ("c3", "B")], "candidate_id STRING, abuse_ring_id STRING")
    got = dict(rows(splits.candidate_groups(c, p)))
    assert got["c1"] == got["c2"] == got["c3"] != got["c4"]
