"""Queries that must cover their whole input, against brute force."""

import numpy as np
import pytest

from verdigris.operators.cleansing import numeric_columns
from verdigris.plans.catalog import QUERIES
from verdigris.plans.catalog import whole_queries as W
from verdigris.plans.catalog.graph_queries import edges
from verdigris.plans.catalog.registry import staged

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return staged(spark, FOLDER)


def test_audit_takes_every_numeric_column(spark, data):
    m = W.whole_matrix(data)
    names = numeric_columns(m)
    assert {"shared_device_count", "accounts_per_phone", "triangle_count", "pagerank", "eigenvector_centrality"} <= set(names)
    truth = {r.account_id: r.true_ring_member for r in data.truth.collect()}
    table = W._ties_kept(m).toPandas()
    member = table["account_id"].map(truth).to_numpy(bool)
    want = {}
    for c in names:
        v = table[c].to_numpy(float)
        if len(set(v)) > 1:
            a, b = v[member][:, None], v[~member][None, :]
            auc = ((a > b) + 0.5 * (a == b)).mean()
            want[c] = (max(auc, 1 - auc), len(set(v)))
    got = {r.feature: (r.single_feature_auc, r.unique_values) for r in QUERIES["m10_feature_audit_all"](spark, FOLDER).collect()}
    assert set(got) == set(want)
    assert all(abs(got[c][0] - want[c][0]) < 2e-6 and got[c][1] == want[c][1] for c in want)
    gate = QUERIES["m12_shortcut_gate_all"](spark, FOLDER).first()
    assert gate.max_auc >= max(a for a, _ in got.values()) and gate.passed == (gate.max_auc <= 0.80)


def test_every_table_domain_and_key_is_checked(spark):
    tables = {r.table_name for r in QUERIES["q1_required_columns_all"](spark, FOLDER).collect()}
    assert tables == {"accounts", "devices", "addresses", "phones", "instruments", "orders"}
    broken = {r.check_name for r in QUERIES["q6_orphans_all"](spark, FOLDER).collect() if r.violations}
    assert {"orders.address", "orders.phone", "orders.instrument"} <= broken
    outside = {r.column_name: r.outside for r in QUERIES["q5_domains_all"](spark, FOLDER).collect()}
    assert outside["instrument_type"] > 0


def test_input_report_takes_every_numeric_column(spark, data):
    names = set(numeric_columns(W.whole_matrix(data), ("account_id", "community_id")))
    assert {r.feature for r in QUERIES["p3_input_report_all"](spark, FOLDER).collect()} == names


def test_iterated_metrics_are_converged(spark, data):
    ids = [r.account_id for r in data.accounts.collect()]
    at = {a: k for k, a in enumerate(ids)}
    n = len(ids)
    link = np.zeros((n, n))
    for r in edges(data).collect():
        a, b = at[r.account_id_1], at[r.account_id_2]
        link[a, b] = link[b, a] = r.weight
    out = link.sum(1)
    rank = np.full(n, 1 / n)
    for _ in range(2_000):
        rank = 0.15 / n + 0.85 * (rank[out == 0].sum() / n + link @ np.divide(rank, out, out=np.zeros(n), where=out > 0))
    centre = np.full(n, 1 / n)
    for _ in range(20_000):
        centre = centre + link @ centre
        centre /= np.sqrt((centre**2).sum())
    rows = {r.account_id: r for r in QUERIES["h5_graph_matrix_all"](spark, FOLDER).collect()}
    shown = {"pagerank": n, "eigenvector_centrality": 1}  # PageRank is shown times the number of accounts
    got_rank, got_centre = (np.array([rows[a][c] for a in ids]) / shown[c] for c in W.ITERATIVE)
    assert np.abs(got_rank - rank).sum() < n * 1e-5 and np.abs(got_centre - centre).sum() < n * 1e-3
    metrics = QUERIES["g13_node_metrics_all"](spark, FOLDER)
    assert set(W.ITERATIVE) <= set(metrics.columns) and metrics.count() == n
    for name, column, want in (("g4_pagerank", "pagerank", rank), ("g5_eigenvector", "eigenvector_centrality", centre)):
        fixed = {r.account_id: r[column] for r in QUERIES[name](spark, FOLDER).collect()}
        whole = np.array([rows[a][column] for a in ids]) / shown[column]
        assert np.abs(whole - want).sum() < np.abs(np.array([fixed[a] for a in ids]) - want).sum()
