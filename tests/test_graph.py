"""Graph metrics on small graphs with known answers, and against brute force."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verdigris.operators import communities, community_features, components, graph_metrics, neighborhood
from verdigris.operators.components import account_components, component_labels
from verdigris.plans import graph_plan
from verdigris.session import materialize


def graph(spark, pairs, n=None):
    e = spark.createDataFrame([(a, b, "shares_device", 1.0) for a, b in pairs], "account_id_1 INT, account_id_2 INT, edge_type STRING, weight DOUBLE")
    ids = sorted({v for p in pairs for v in p} | set(range(n or 0)))
    return spark.createDataFrame([(i,) for i in ids], "account_id INT"), e


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 40)],
    [tuple(sorted(random.Random(1).sample(range(50), 2))) for _ in range(1)] + [(a, a + 25) for a in range(0, 25, 2)],
])
def test_components(spark, pairs):
    _, e = graph(spark, pairs)
    assert dict(rows(component_labels(e))) == union_find(pairs)


def test_edges_are_cut_to_local_forests_first(spark, monkeypatch):
    """Same components, and no more links kept than a task has vertices, in runs of a few links too."""
    rng = random.Random(5)
    pairs = [tuple(sorted(rng.sample(range(k * 40, k * 40 + 40), 2))) for k in range(5) for _ in range(300)] + [(39, 45), (900, 901), (7, 7)]
    batches = [pa.RecordBatch.from_arrays([pa.array([p[0] for p in part]), pa.array([p[1] for p in part])], ["u", "w"]) for part in (pairs[:700], pairs[700:])]
    want = union_find([p for p in pairs if p[0] != p[1]])
    for limit in (1 << 20, 100):
        monkeypatch.setattr(components, "FOREST_LINKS", limit)
        kept = [(u, w) for b in components._forest(iter(batches)) for u, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert union_find(kept) == want and all(u < w for u, w in kept)
        assert limit == 100 or len(kept) == 5 * 39 + 1 + 1
    e = spark.createDataFrame([*pairs, (None, 3)], "account_id_1 BIGINT, account_id_2 BIGINT").repartition(3)
    assert components._spanning(e.toDF("u", "w")).count() < len(pairs) / 2
    for limit in (1 << 20, 30, 0):  # in one run, after some rounds, in rounds only
        monkeypatch.setattr(components, "FOREST_LINKS", limit)
        assert dict(rows(component_labels(e))) == want


@pytest.mark.parametrize("fn", [components._forest, neighborhood.loss_and_gradient])
def test_task_functions_need_no_package(fn, tmp_path):
    """What tasks run can be read where this package is not installed."""
    (tmp_path / "fn").write_bytes(cloudpickle.dumps(fn))
    code = "from pyspark import cloudpickle; print(callable(cloudpickle.load(open('fn', 'rb'))))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60, check=True)
    assert found.stdout.strip() == "True"


def test_no_edges(spark):
    a, e = graph(spark, [(1, 2)], 4)
    got = rows(account_components(a, e.filter("false")))
    assert [r[2] for r in got] == [1] * 4


def test_triangles_and_clustering(spark):
    # triangle 0-1-2, 4-cycle 10..13, star around 20, isolated 30
    pairs = [(0, 1), (1, 2), (0, 2), (10, 11), (11, 12), (12, 13), (10, 13), (20, 21), (20, 22), (20, 23)]
    a, e = graph(spark, pairs)
    a = a.union(spark.createDataFrame([(30,)], "account_id INT"))
    got = {r[0]: (r[1], r[2]) for r in rows(graph_metrics.triangle_metrics(a, e))}
    assert got[0] == (1, 1.0) and got[10] == (0, 0.0) and got[20] == (0, 0.0) and got[30] == (0, 0.0)


def test_pagerank_converges_and_sums_to_one(spark):
    a, e = graph(spark, [(0, 1), (1, 2), (2, 3), (0, 2)], 6)
    got = dict(rows(graph_metrics.pagerank(a, e)))
    assert abs(sum(got.values()) - 1) < 1e-6 and got[2] == max(got.values()) and got[4] == pytest.approx(got[5])


def test_eigenvector_of_star(spark):
    a, e = graph(spark, [(0, 1), (0, 2), (0, 3), (0, 4)])
    got = dict(rows(graph_metrics.eigenvector_centrality(a, e)))
    assert got[0] == pytest.approx(0.7071, abs=1e-3) and got[1] == pytest.approx(0.3536, abs=1e-3)


def test_eigenvector_stores_one_table_per_compared_round(spark, monkeypatch):
    """Same values as plain power iteration, with a link to itself and one to no account among the edges."""
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 3), (4, 5)]
    a, e = graph(spark, pairs, 8)
    e = e.unionByName(e.limit(1).withColumn("account_id_2", F.lit(None).cast("int")))
    stored = []
    monkeypatch.setattr(graph_metrics, "materialize", lambda df, label: stored.append(label) or materialize(df, label))
    got = dict(rows(graph_metrics.eigenvector_centrality(a, e, max_iter=12, fixed=True)))
    m = np.eye(8)
    for u, w in pairs:
        m[u, w] += 1
        m[w, u] += 1
    x = np.linalg.matrix_power(m, 12) @ np.full(8, 1 / 8)
    x /= np.linalg.norm(x)
    assert [got[i] for i in range(8)] == pytest.approx(list(x))
    assert stored == ["ev-nodes", "ev-links", "ev", "ev", "ev"]  # after rounds 5, 10 and 12


def test_dealt_links_lie_sorted(spark):
    """A round joins the links by source without sorting them again."""
    links = graph_metrics._dealt(spark.createDataFrame([(i % 7, i) for i in range(50)], "src INT, dst INT"))
    ranks = spark.createDataFrame([(i, 1.0) for i in range(7)], "v INT, r DOUBLE")
    text = links.hint("merge").join(ranks, links["src"] == ranks["v"])._jdf.queryExecution().executedPlan().toString()
    links.unpersist()
    plan = text.split("InMemoryRelation")[0]
    assert "SortMergeJoin" in plan and "Sort [src" not in plan


def test_graph_matrix_makes_its_parts_once(spark, monkeypatch):
    """The checks of the joins read stored parts, they do not make them again."""
    made = {}

    def counted(name):
        real, made[name] = getattr(graph_plan, name), spark.sparkContext.accumulator(0)

        def run(*args):
            out, seen = real(*args), made[name]

            def pass_on(batches):
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return out.mapInArrow(pass_on, out.schema)

        monkeypatch.setattr(graph_plan, name, run)

    for name in ("node_metrics", "community_features", "neighbor_return_rates"):
        counted(name)
    a, e = graph(spark, [(0, 1), (1, 2), (0, 2), (3, 4)], 8)
    used = {*community_features._SOURCE.values(), "coupon_usage_rate", "shared_address_count"} - {"account_id"}
    features = materialize(a.select("account_id", *[(F.col("account_id") / 10).alias(c) for c in sorted(used)]), "features")
    groups = materialize(a.select("account_id", (F.col("account_id") % 3).cast("long").alias("community_id")), "communities")
    found = graph_plan.graph_matrix(features, materialize(e, "edges"), groups, iterative=False)
    assert found.count() == 8 and {k: v.value for k, v in made.items()} == dict.fromkeys(made, 8)


def test_louvain_finds_cliques(spark):
    pairs = [(b + i, b + j) for b in (0, 10, 20) for i in range(6) for j in range(i)] + [(0, 10), (10, 20)]
    a, e = graph(spark, [tuple(sorted(p)) for p in pairs], 32)
    got = communities.louvain(a, e)
    labels = dict(rows(got))
    assert set(labels) == {r[0] for r in rows(a)}
    for b in (0, 10, 20):
        assert len({labels[b + i] for i in range(6)}) == 1
    assert sorted(set(labels.values())) == list(range(len(set(labels.values()))))
    alone = a.select("account_id", F.col("account_id").cast("bigint").alias("community_id"))
    assert communities.modularity(e, got).first()[0] > communities.modularity(e, alone).first()[0] + 0.5


def test_louvain_moves_small_components_in_one_step(spark, monkeypatch):
    """Components moved whole by a task end as those moved turn by turn, in far fewer stored steps."""
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(b * 100, b * 100 + 12 * (b + 1)), 2))) for b in range(3) for _ in range(25 * (b + 1))}
    a, e = graph(spark, sorted(pairs), 300)
    e = e.withColumn("weight", F.element_at(F.array(F.lit(0.3), F.lit(0.7), F.lit(1.0)), (F.col("account_id_1") % 3 + 1).cast("int")))
    stored, keep = [], communities.materialize
    monkeypatch.setattr(communities, "materialize", lambda df, label="stage": (stored.append(label), keep(df, label))[1])
    got = [sorted(rows(communities.louvain(a, e, group_rows=n))) for n in (100, 100_000)]
    assert got[0] == got[1] and "lv-step" in stored
    stored.clear()
    assert sorted(rows(communities.louvain(a, e))) == got[0]
    assert "lv-step" not in stored


def test_louvain_looks_again_beside_changes_only(monkeypatch):
    """A star that moves one leaf per turn beside cliques at rest: late turns read the star's links alone."""
    pairs = [(0, k) for k in range(1, 61)] + [(100 + 10 * b + i, 100 + 10 * b + j) for b in range(30) for i in range(8) for j in range(i)]
    a, b = np.array(pairs + [(y, x) for x, y in pairs]).T
    links = pa.table({"src": a, "dst": b, "weight": np.ones(len(a)), "rests": a * 7919 % 256})
    read, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda v, **kw: (read.append(len(v)), unique(v, **kw))[1])
    found = communities._group_mover(1 / len(a), 1_000)(links)
    assert read[1] == len(a) and read[-1] <= 120 and sum(read[1:]) < len(a) * (len(read) - 1) / 2
    of = dict(zip(found["v"].to_pylist(), found["c"].to_pylist(), strict=True))
    assert len({of[k] for k in range(61)}) == 1 and all(len({of[100 + 10 * b + i] for i in range(8)}) == 1 for b in range(30))


@pytest.mark.parametrize("cell_rows", [2, 8, 10_000])
def test_triangles_around_a_hub(spark, cell_rows):
    """A clique whose first vertex in (degree, id) order has the largest out-degree, and hubs beside it."""
    rng = random.Random(2)
    pairs = {(i, j) for j in range(30) for i in range(j)} | {(100, 101 + k) for k in range(40)} | {(101 + k, 102 + k) for k in range(0, 39, 2)}
    pairs |= {tuple(sorted(rng.sample(range(200, 240), 2))) for _ in range(150)}
    _, e = graph(spark, sorted(pairs))
    got = {tuple(sorted(r[:3])) for r in graph_metrics.triangles(e, cell_rows).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(a, b, c) for a, b in pairs for c in near[a] & near[b] if c > b}
    assert got == want and graph_metrics.triangles(e, cell_rows).count() == len(want)


def test_a_round_moves_ranks_only(spark):
    """Three rounds over the dealt links: one exchange each, beside that of the first ranks."""
    links = graph_metrics._dealt(spark.range(400).selectExpr("id AS src", "(id * 7) % 400 AS dst", "1D AS share"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranks = spark.range(400).selectExpr("id AS v", "1D AS r")
        for _ in range(3):
            ranks = graph_metrics._inflow(links, ranks).selectExpr("dst AS v", "inflow AS r")
        text = ranks._sc._jvm.PythonSQLUtils.explainString(ranks._jdf.queryExecution(), "simple")
        shown = [line for line in text.splitlines() if " Exchange hashpartitioning" in line and "REPARTITION" not in line]
        assert len(shown) == 4 and ranks.agg(F.sum("r")).first()[0] == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        links.unpersist()
