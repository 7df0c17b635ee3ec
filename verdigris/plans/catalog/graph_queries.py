"""Edge, graph, community and rule queries."""

from pyspark.sql import functions as F

from verdigris.constants import EDGE_WEIGHTS
from verdigris.operators import communities as L
from verdigris.operators import community_features as H
from verdigris.operators import edges as E
from verdigris.operators import graph_metrics as G
from verdigris.operators import rules as R
from verdigris.operators.components import account_components
from verdigris.operators.evaluation import confusion
from verdigris.plans.catalog.base_queries import (
    FEATURE_REALS, features, pre_devices, pre_orders, rounded, sql_round,
)
from verdigris.plans.catalog.registry import query
from verdigris.plans.graph_plan import graph_matrix
from verdigris.session import materialize
from verdigris.sources.fixtures import CUTOFF
from verdigris.operators.cleansing import known_at


def edges(d):
    """The merged edge table, stored once per run."""
    if not hasattr(d, "_edges"):
        orders = known_at(d.stored_orders, "order_timestamp", CUTOFF)
        d._edges = materialize(E.final_edges(orders, pre_devices(d)), "edges")
    return d._edges


def stored_features(d):
    if not hasattr(d, "_features"):
        d._features = materialize(features(d), "features")
    return d._features


@query("e0_canonical_pairs", """
SELECT DISTINCT least(l_partkey, l_suppkey) AS account_id_1, greatest(l_partkey, l_suppkey) AS account_id_2
FROM lineitem WHERE l_partkey <> l_suppkey""")
def e0(d):
    pairs = E.canonical_pairs(d.raw("lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")
    return pairs.select("account_id_1", "account_id_2").distinct()


@query("e1_identity_edges", "SELECT * FROM e1")
def e1(d):
    return E.identity_edges(pre_orders(d))


@query("e2_ip_edges", "SELECT *, 'shares_ip_prefix' AS edge_type FROM e2_pairs")
def e2(d):
    return E.ip_edges(pre_orders(d), pre_devices(d))


@query("e3_coupon_edges", "SELECT * FROM e3")
def e3(d):
    return E.coupon_edges(pre_orders(d))


@query("e4_raw_counts", "SELECT edge_type, count(*) AS candidate_edges FROM raw_edges GROUP BY 1")
def e4(d):
    orders = known_at(d.stored_orders, "order_timestamp", CUTOFF)
    return E.raw_counts(E.raw_edges(orders, pre_devices(d)))


@query("e5_merged_evidence", """
SELECT e.*, t.edge_types FROM edges e JOIN (SELECT account_id_1, account_id_2,
  string_agg(edge_type, ',' ORDER BY edge_type) AS edge_types FROM raw_edges GROUP BY 1, 2) t
USING (account_id_1, account_id_2)""")
def e5(d):
    orders = known_at(d.stored_orders, "order_timestamp", CUTOFF)
    merged = E.merge_evidence(E.raw_edges(orders, pre_devices(d)))
    return merged.withColumn("edge_types", F.array_join("edge_types", ","))


@query("e6_edge_table", "SELECT * FROM edges")
def e6(d):
    return E.sorted_edges(edges(d))


_TYPE_COUNTS = ", ".join(f"count(*) FILTER (edge_type = '{t}') AS n_{t}" for t in EDGE_WEIGHTS)


@query("e7_edge_checks", f"""
SELECT count(*) AS n_edges, 0::BIGINT AS self_loops, 0::BIGINT AS duplicate_pairs, 0::BIGINT AS bad_weights,
  {_TYPE_COUNTS} FROM edges""")
def e7(d):
    return E.edge_violations(edges(d))


@query("e8_vertices", """
SELECT a.account_id, coalesce(n, 0) AS degree FROM fx_accounts a
LEFT JOIN (SELECT src, count(*) AS n FROM sym GROUP BY 1) s ON a.account_id = s.src""")
def e8(d):
    return E.vertices(d.accounts, edges(d))


# ------------------------------------------------------------------ graph
_NODE_SQL = """
SELECT a.account_id, coalesce(n, 0) AS shared_edge_count, round(coalesce(w, 0), 9) AS shared_edge_weight_sum,
  round(coalesce(n, 0) / ((SELECT count(*) FROM fx_accounts) - 1)::DOUBLE, 9) AS degree_centrality,
  {types}
FROM fx_accounts a LEFT JOIN (SELECT src, count(*) AS n, sum(weight) AS w, {counts} FROM sym GROUP BY 1) s
ON a.account_id = s.src""".format(
    types=", ".join(f"coalesce(x_{t}, 0) AS edge_{t}" for t in EDGE_WEIGHTS),
    counts=", ".join(f"count(*) FILTER (edge_type = '{t}') AS x_{t}" for t in EDGE_WEIGHTS),
)


def degree(d):
    return rounded(G.degree_metrics(d.accounts, edges(d)), ["shared_edge_weight_sum", "degree_centrality"])


@query("g1_degree_weight", f"SELECT account_id, shared_edge_count, shared_edge_weight_sum FROM ({_NODE_SQL})")
def g1(d):
    return degree(d).select("account_id", "shared_edge_count", "shared_edge_weight_sum")


@query("g2_degree_centrality", f"SELECT account_id, degree_centrality FROM ({_NODE_SQL})")
def g2(d):
    return degree(d).select("account_id", "degree_centrality")


_EDGE_COLS = [f"edge_{t}" for t in EDGE_WEIGHTS]


@query("g3_edge_type_counts", f"SELECT account_id, {', '.join(_EDGE_COLS)} FROM ({_NODE_SQL})")
def g3(d):
    return degree(d).select("account_id", *_EDGE_COLS)


PR_ROUNDS = 8
EV_ROUNDS = 5


def _pagerank_sql(rounds):
    steps = [
        "WITH pr_w AS MATERIALIZED (SELECT src, sum(weight) AS w FROM sym GROUP BY 1)",
        "pr_0 AS MATERIALIZED (SELECT account_id AS v, 1.0::DOUBLE / (SELECT count(*) FROM fx_accounts) AS r FROM fx_accounts)",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"""pr_{i} AS MATERIALIZED (SELECT p.v, (1 - 0.85::DOUBLE) / (SELECT count(*) FROM fx_accounts)
  + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM pr_{i-1} WHERE v NOT IN (SELECT src FROM pr_w)) / (SELECT count(*) FROM fx_accounts)
  + 0.85::DOUBLE * coalesce(f, 0) AS r
  FROM pr_{i-1} p LEFT JOIN (SELECT dst, sum(r * weight / w) AS f FROM sym JOIN pr_{i-1} ON src = v JOIN pr_w USING (src) GROUP BY 1) x ON p.v = x.dst)"""
        )
    return ",\n".join(steps) + f" SELECT v AS account_id, round(r, 12) AS pagerank FROM pr_{rounds}"


@query("g4_pagerank", _pagerank_sql(PR_ROUNDS))
def g4(d):
    """A set number of rounds, so that the values can be compared digit by digit."""
    ranks = G.pagerank(d.accounts, edges(d), max_iter=PR_ROUNDS, tol=0.0)
    return ranks.select("account_id", F.round("pagerank", 12).alias("pagerank"))


def _eigen_sql(rounds):
    steps = ["WITH ev_0 AS MATERIALIZED (SELECT account_id AS v, 1.0::DOUBLE / (SELECT count(*) FROM fx_accounts) AS x FROM fx_accounts)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"""ey_{i} AS MATERIALIZED (SELECT p.v, p.x + coalesce(f, 0) AS y FROM ev_{i-1} p
  LEFT JOIN (SELECT dst, sum(x * weight) AS f FROM sym JOIN ev_{i-1} ON src = v GROUP BY 1) q ON p.v = q.dst),
ev_{i} AS MATERIALIZED (SELECT v, y / (SELECT sqrt(sum(y * y)) FROM ey_{i}) AS x FROM ey_{i})"""
        )
    return ",\n".join(steps) + f" SELECT v AS account_id, round(x, 10) AS eigenvector_centrality FROM ev_{rounds}"


@query("g5_eigenvector", _eigen_sql(EV_ROUNDS))
def g5(d):
    ev = G.eigenvector_centrality(d.accounts, edges(d), max_iter=EV_ROUNDS, fixed=True)
    return ev.select("account_id", F.round("eigenvector_centrality", 10).alias("eigenvector_centrality"))


_TRI_SQL = """
SELECT a.account_id, coalesce(t, 0) AS triangle_count,
  round(CASE WHEN deg > 1 THEN 2 * coalesce(s, 0) / (deg * (deg - 1)) ELSE 0 END, 9) AS clustering_coefficient
FROM fx_accounts a
LEFT JOIN (SELECT src, count(*) AS deg FROM sym GROUP BY 1) g ON g.src = a.account_id
LEFT JOIN (SELECT x.src, count(*) AS t, sum(power((x.weight / m) * (y.weight / m) * (z.weight / m), 1.0::DOUBLE / 3)) AS s
  FROM sym x JOIN sym y ON x.src = y.src AND x.dst < y.dst
  JOIN edges z ON z.account_id_1 = x.dst AND z.account_id_2 = y.dst
  JOIN (SELECT max(weight) AS m FROM edges) ON true GROUP BY 1) t ON t.src = a.account_id"""


@query("g6_triangles", f"SELECT account_id, triangle_count FROM ({_TRI_SQL})")
def g6(d):
    return G.triangle_metrics(d.accounts, edges(d)).select("account_id", "triangle_count")


@query("g7_clustering", f"SELECT account_id, clustering_coefficient FROM ({_TRI_SQL})")
def g7(d):
    return rounded(
        G.triangle_metrics(d.accounts, edges(d)).select("account_id", "clustering_coefficient"),
        ["clustering_coefficient"],
    )


# Spreads the smallest label for 60 rounds, above the diameter of the test graphs.
CC_SQL = """cc AS MATERIALIZED (
  WITH RECURSIVE lab(v, l, n) AS (
    SELECT account_id, account_id, 0 FROM fx_accounts
    UNION ALL
    SELECT v, min(l), min(n) + 1 FROM (
      SELECT v, l, n FROM lab UNION ALL SELECT s.dst, a.l, a.n FROM lab a JOIN sym s ON s.src = a.v)
    WHERE n < 60 GROUP BY v)
  SELECT v AS account_id, min(l) AS component FROM lab GROUP BY 1)"""


@query("g8_components", f"""WITH {CC_SQL}
SELECT account_id, component, count(*) OVER (PARTITION BY component) AS component_size FROM cc""")
def g8(d):
    return account_components(d.accounts, edges(d))


@query("g9_integrity", f"""WITH {CC_SQL}
SELECT (SELECT count(*) FROM fx_accounts) AS nodes, (SELECT count(*) FROM edges) AS edges, 0::BIGINT AS self_loops,
  (SELECT count(*) FROM fx_accounts WHERE account_id NOT IN (SELECT src FROM sym)) AS isolated_nodes,
  count(*) AS connected_components, max(n) AS largest_component,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM sym GROUP BY src)) AS max_degree,
  max(n) = (SELECT count(*) FROM fx_accounts) AS fully_connected_warning,
  (SELECT count(*) FROM fx_accounts WHERE account_id NOT IN (SELECT src FROM sym)) > 0.9 * (SELECT count(*) FROM fx_accounts) AS mostly_isolated_warning
FROM (SELECT component, count(*) AS n FROM cc GROUP BY 1)""")
def g9(d):
    return G.integrity_report(d.accounts, edges(d), account_components(d.accounts, edges(d)))


@query("g10_louvain")
def g10(d):
    if not hasattr(d, "_louvain"):
        d._louvain = materialize(L.louvain(d.accounts, edges(d)), "communities")
    return d._louvain


@query("g11_modularity", """
SELECT round(sum(inside / m - power(deg / (2 * m), 2)), 9) AS modularity FROM (
  SELECT c, sum(i) AS inside, sum(k) AS deg FROM (
    SELECT community_id AS c, 0::DOUBLE AS i, weight AS k FROM sym JOIN fx_communities ON src = account_id
    UNION ALL SELECT a.community_id, weight, 0 FROM edges JOIN fx_communities a ON a.account_id = account_id_1
      JOIN fx_communities b ON b.account_id = account_id_2 AND a.community_id = b.community_id)
  GROUP BY 1), (SELECT sum(weight) AS m FROM edges)""")
def g11(d):
    return rounded(L.modularity(edges(d), d.communities), ["modularity"])


@query("g12_community_sizes", """
SELECT count(*) AS n_communities, max(n) AS largest_community, count(*) FILTER (n = 1) AS singleton_communities,
  CAST(sum(n) AS BIGINT) AS n_accounts FROM (SELECT community_id, count(*) AS n FROM fx_communities GROUP BY 1)""")
def g12(d):
    return L.community_sizes(d.communities)


@query("g13_node_metrics", f"""WITH {CC_SQL}
SELECT n.*, t.triangle_count, t.clustering_coefficient, c.connected_component_size
FROM ({_NODE_SQL}) n JOIN ({_TRI_SQL}) t USING (account_id)
JOIN (SELECT account_id, count(*) OVER (PARTITION BY component) AS connected_component_size FROM cc) c USING (account_id)""")
def g13(d):
    out = G.node_metrics(d.accounts, edges(d), iterative=False)
    return rounded(out, ["shared_edge_weight_sum", "degree_centrality", "clustering_coefficient"])


# ------------------------------------------------------------------ communities and rules
_COMM_SQL = """
SELECT account_id, community_id, count(*) OVER w AS community_size, avg(return_rate) OVER w AS community_return_rate,
  avg(refund_rate) OVER w AS community_refund_rate, avg(avg_order_value) OVER w AS community_avg_order_value,
  avg(dispute_rate) OVER w AS community_dispute_rate, avg(coupon_usage_rate) OVER w AS community_coupon_usage,
  CAST(sum(total_orders) OVER w AS BIGINT) AS community_total_orders, max(return_rate) OVER w AS community_max_return_rate
FROM behavior JOIN fx_communities USING (account_id) WINDOW w AS (PARTITION BY community_id)"""
_COMM_REALS = [
    "community_return_rate", "community_refund_rate", "community_avg_order_value", "community_dispute_rate",
    "community_coupon_usage", "community_max_return_rate",
]


def _behavior(d):
    from verdigris.plans.catalog.base_queries import behavior

    return behavior(d)


@query("h1_community_features", f"""
SELECT account_id, community_id, community_size, community_total_orders, {sql_round(*_COMM_REALS)} FROM ({_COMM_SQL})""")
def h1(d):
    return rounded(H.community_features(_behavior(d), d.communities), _COMM_REALS)


@query("h2_join_contract", """
SELECT (SELECT count(*) FROM (SELECT account_id FROM fx_orders GROUP BY 1 HAVING count(*) > 1)) AS left_duplicates,
  0::BIGINT AS right_duplicates,
  (SELECT count(DISTINCT account_id) FROM fx_orders WHERE account_id NOT IN (SELECT account_id FROM fx_accounts)) AS left_without_match""")
def h2(d):
    return H.join_contract(d.orders, d.accounts, ["account_id"])


_NEIGHBOR_SQL = """
SELECT f.account_id, coalesce(r, 0) AS neighbor_avg_return_rate FROM behavior f LEFT JOIN (
  SELECT src, avg(return_rate) AS r FROM sym JOIN behavior ON dst = account_id GROUP BY 1) n ON n.src = f.account_id"""


@query("h3_neighbor_return_rate", f"SELECT account_id, {sql_round('neighbor_avg_return_rate')} FROM ({_NEIGHBOR_SQL})")
def h3(d):
    return rounded(H.neighbor_return_rates(_behavior(d), edges(d)), ["neighbor_avg_return_rate"])


_FLAG_SQL = """
SELECT account_id, CAST(coupon_usage_rate > 0.4 AND return_rate < 0.2 AS BIGINT) AS looks_bargain,
  CAST(shared_address_count > 0 AND return_rate < 0.1 AS BIGINT) AS looks_office FROM features"""


@query("h4_context_flags", _FLAG_SQL)
def h4(d):
    return H.add_context_flags(stored_features(d)).select("account_id", "looks_bargain", "looks_office")


def matrix(d):
    """Graph matrix with the given community table and the closed-form node metrics."""
    if not hasattr(d, "_matrix"):
        d._matrix = materialize(
            graph_matrix(stored_features(d), edges(d), d.communities, iterative=False), "matrix"
        )
    return d._matrix


H5_SQL = f"""WITH {CC_SQL}
SELECT f.* REPLACE ({sql_round(*FEATURE_REALS).replace("round(", "round(f.")}), n.* EXCLUDE (account_id), t.* EXCLUDE (account_id),
  c.connected_component_size, m.community_id, m.community_size, m.community_total_orders, {sql_round(*_COMM_REALS).replace("round(", "round(m.")},
  round(nb.neighbor_avg_return_rate, 9) AS neighbor_avg_return_rate, fl.looks_bargain, fl.looks_office
FROM features f JOIN ({_NODE_SQL}) n USING (account_id) JOIN ({_TRI_SQL}) t USING (account_id)
JOIN (SELECT account_id, count(*) OVER (PARTITION BY component) AS connected_component_size FROM cc) c USING (account_id)
JOIN ({_COMM_SQL}) m USING (account_id) JOIN ({_NEIGHBOR_SQL}) nb USING (account_id) JOIN ({_FLAG_SQL}) fl USING (account_id)"""


@query("h5_graph_matrix", H5_SQL)
def h5(d):
    reals = [*FEATURE_REALS, *_COMM_REALS, "shared_edge_weight_sum", "degree_centrality", "clustering_coefficient", "neighbor_avg_return_rate"]
    return rounded(matrix(d), reals)


RULE_SQL = f"""
SELECT account_id, CAST(return_rate > 0.5 AND total_orders >= 2 AS BIGINT) AS rule_1,
  CAST(shared_device_count >= 1 AND return_rate > 0.3 AS BIGINT) AS rule_2,
  CAST(account_creation_burst_score >= 5 AND coupon_usage_rate > 0.5 AS BIGINT) AS rule_3,
  CAST(community_size >= 4 AND community_return_rate > 0.4 AS BIGINT) AS rule_4,
  CAST(dispute_rate > 0.3 AS BIGINT) AS rule_5,
  CAST((return_rate > 0.5 AND total_orders >= 2) OR (shared_device_count >= 1 AND return_rate > 0.3)
    OR (account_creation_burst_score >= 5 AND coupon_usage_rate > 0.5)
    OR (community_size >= 4 AND community_return_rate > 0.4) OR dispute_rate > 0.3 AS BIGINT) AS baseline_flag
FROM features JOIN (SELECT account_id, community_size, community_return_rate FROM ({_COMM_SQL})) USING (account_id)"""


def flagged(d):
    both = stored_features(d).join(H.community_features(stored_features(d), d.communities), "account_id")
    return R.apply_rules(both)


@query("h6_rules", RULE_SQL)
def h6(d):
    return flagged(d).select("account_id", *R.RULES, "baseline_flag")


@query("h7_rule_counts", f"""SELECT {', '.join(f'CAST(sum({r}) AS BIGINT) AS {r}_count' for r in R.RULES)},
CAST(sum(baseline_flag) AS BIGINT) AS total_flagged FROM ({RULE_SQL})""")
def h7(d):
    return R.rule_counts(flagged(d))


@query("h8_run_gate", f"""
SELECT tp > 0 AND fp > 0 AND fn > 0 AS passed, concat_ws('; ',
   CASE WHEN tp = 0 OR fp = 0 THEN 'trivial precision' END, CASE WHEN tp = 0 OR fn = 0 THEN 'trivial recall' END,
   CASE WHEN tp = 0 THEN 'no true member caught' END, CASE WHEN tp + fp = 0 THEN 'no account flagged' END) AS stop_reasons,
  n AS matrix_rows, 0::BIGINT AS null_cells FROM (
  SELECT count(*) AS n, count(*) FILTER (baseline_flag = 1 AND true_ring_member) AS tp,
    count(*) FILTER (baseline_flag = 1 AND NOT true_ring_member) AS fp,
    count(*) FILTER (baseline_flag = 0 AND true_ring_member) AS fn
  FROM ({RULE_SQL}) JOIN fx_truth USING (account_id))""")
def h8(d):
    rows = flagged(d).select("account_id", "baseline_flag")
    judged = rows.join(d.truth.select("account_id", F.col("true_ring_member").cast("int").alias("label")), "account_id")
    gate = R.run_gate(d.accounts.count(), rows, confusion(judged, "label", "baseline_flag"))
    return gate.withColumn("stop_reasons", F.array_join("stop_reasons", "; "))
