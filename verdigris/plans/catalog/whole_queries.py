"""Queries over whole inputs: every numeric matrix column, every required table, domain and key."""

from pyspark.sql import functions as F

from verdigris.functions.exprs import nonblank
from verdigris.operators import cleansing as C
from verdigris.operators import evaluation as M
from verdigris.operators import graph_metrics as G
from verdigris.operators import investigation as N
from verdigris.operators import quality as Q
from verdigris.operators import splits as P
from verdigris.operators.cleansing import numeric_columns
from verdigris.operators.community_features import community_features
from verdigris.plans.catalog.base_queries import FEATURE_REALS, pre_disputes, pre_orders, rounded
from verdigris.plans.catalog.case_queries import contributors, links, queue, reports
from verdigris.plans.catalog.graph_queries import _COMM_REALS, _COMM_SQL, _NODE_SQL, _TRI_SQL, CC_SQL, H5_SQL, edges, stored_features
from verdigris.plans.catalog.model_queries import _audit_sql, signals, split
from verdigris.plans.catalog.prelude import CUT, PRELUDE
from verdigris.plans.catalog.quality_queries import used
from verdigris.plans.catalog.registry import query
from verdigris.plans.graph_plan import graph_matrix
from verdigris.session import materialize
from verdigris.sources.fixtures import CUTOFF

ITERATIVE = ["pagerank", "eigenvector_centrality"]


def whole_matrix(d):
    """Graph matrix with PageRank and eigenvector centrality run to convergence; stored once."""
    if not hasattr(d, "_whole_matrix"):
        d._whole_matrix = materialize(graph_matrix(stored_features(d), edges(d), d.communities), "whole-matrix")
    return d._whole_matrix


# The iterations of the two metrics until their own tests of convergence hold, checked in the same rounds.
PRELUDE["pr_whole"] = """
WITH RECURSIVE w AS (SELECT src, sum(weight) AS w FROM sym GROUP BY 1),
links AS (SELECT s.src, s.dst, s.weight / w.w AS share FROM sym s JOIN w USING (src)),
nn AS (SELECT count(*)::DOUBLE AS n FROM fx_accounts),
it(turn, v, r, moved) AS (
  SELECT 0, account_id, 1.0::DOUBLE / n, 1e9::DOUBLE FROM fx_accounts, nn
  UNION ALL
  SELECT turn + 1, v, fresh, sum(abs(fresh - r)) OVER () FROM (
    SELECT i.turn, i.v, i.r, 0.15::DOUBLE / n + 0.85::DOUBLE * idle / n + 0.85::DOUBLE * coalesce(f, 0) AS fresh
    FROM it i CROSS JOIN nn CROSS JOIN (SELECT coalesce(sum(r), 0) AS idle FROM it WHERE v NOT IN (SELECT src FROM w)) z
    LEFT JOIN (SELECT l.dst, sum(j.r * l.share) AS f FROM it j JOIN links l ON l.src = j.v GROUP BY 1) x ON x.dst = i.v
    WHERE i.turn < 100 AND NOT (i.turn > 0 AND i.turn % 4 = 0 AND i.moved < n * 1e-6)))
SELECT v AS account_id, r AS pagerank FROM it WHERE turn = (SELECT max(turn) FROM it)"""
PRELUDE["ev_whole"] = """
WITH RECURSIVE nn AS (SELECT count(*)::DOUBLE AS n FROM fx_accounts),
it(turn, v, x, moved) AS (
  SELECT 0, account_id, 1.0::DOUBLE / n, 1e9::DOUBLE FROM fx_accounts, nn
  UNION ALL
  SELECT turn + 1, v, fresh, sum(abs(fresh - x)) OVER () FROM (
    SELECT turn, v, x, y / sqrt(sum(y * y) OVER ()) AS fresh FROM (
      SELECT i.turn, i.v, i.x, i.x + coalesce(f, 0) AS y FROM it i CROSS JOIN nn
      LEFT JOIN (SELECT s.dst, sum(j.x * s.weight) AS f FROM it j JOIN sym s ON s.src = j.v GROUP BY 1) q ON q.dst = i.v
      WHERE i.turn < 1000 AND NOT (i.turn > 0 AND i.turn % 5 = 0 AND i.moved < n * 1e-6))))
SELECT v AS account_id, x AS eigenvector_centrality FROM it WHERE turn = (SELECT max(turn) FROM it)"""
# PageRank times the number of accounts is 1 on average, so its digits do not vanish as the table grows.
_ITERATED = "round(pagerank * (SELECT count(*) FROM fx_accounts), 7) AS pagerank, round(eigenvector_centrality, 8) AS eigenvector_centrality"
PRELUDE["whole_matrix"] = f"""
SELECT h.*, {_ITERATED} FROM ({H5_SQL}) h JOIN pr_whole USING (account_id) JOIN ev_whole USING (account_id)"""


def _iterated_rounded(df, n):
    return df.withColumns({"pagerank": F.round(F.col("pagerank") * F.lit(float(n)), 7), "eigenvector_centrality": F.round("eigenvector_centrality", 8)})


def _ties_kept(df):
    """Sums, ratios and iterated values rounded, so that float noise splits no ties."""
    reals = [*FEATURE_REALS, *_COMM_REALS, "shared_edge_weight_sum", "degree_centrality", "clustering_coefficient", "neighbor_avg_return_rate"]
    return _iterated_rounded(rounded(df, reals), df.count())


def compared_matrix(d):
    """The whole matrix with its values rounded; stored once."""
    if not hasattr(d, "_compared_matrix"):
        d._compared_matrix = materialize(_ties_kept(whole_matrix(d)), "compared-matrix")
    return d._compared_matrix


@query("g13_node_metrics_all", f"""WITH {CC_SQL}
SELECT n.*, t.triangle_count, t.clustering_coefficient, c.connected_component_size, {_ITERATED}
FROM ({_NODE_SQL}) n JOIN ({_TRI_SQL}) t USING (account_id)
JOIN (SELECT account_id, count(*) OVER (PARTITION BY component) AS connected_component_size FROM cc) c USING (account_id)
JOIN pr_whole USING (account_id) JOIN ev_whole USING (account_id)""")
def g13_all(d):
    """All node metrics, the iterated ones converged (PageRank times the number of accounts)."""
    out = G.node_metrics(d.accounts, edges(d))
    return _iterated_rounded(rounded(out, ["shared_edge_weight_sum", "degree_centrality", "clustering_coefficient"]), d.accounts.count())


@query("h5_graph_matrix_all", "SELECT * FROM whole_matrix")
def h5_all(d):
    """Every column of the graph matrix, the iterated ones converged (PageRank times the number of accounts)."""
    return compared_matrix(d)


@query("g4_pagerank_converged", "SELECT account_id, round(pagerank * (SELECT count(*) FROM fx_accounts), 7) AS pagerank FROM pr_whole")
def g4_converged(d):
    """PageRank times the number of accounts."""
    ranks = G.pagerank(d.accounts, edges(d))
    return ranks.select("account_id", F.round(F.col("pagerank") * F.lit(float(d.accounts.count())), 7).alias("pagerank"))


@query("g5_eigenvector_converged", "SELECT account_id, round(eigenvector_centrality, 8) AS eigenvector_centrality FROM ev_whole")
def g5_converged(d):
    found = G.eigenvector_centrality(d.accounts, edges(d))
    return found.select("account_id", F.round("eigenvector_centrality", 8).alias("eigenvector_centrality"))


_WHOLE_AUDIT = """
SELECT feature, round(greatest(auc, 1 - auc), 6) AS single_feature_auc, unique_values FROM (
  SELECT feature, sum(pos * (neg_upto - neg + 0.5::DOUBLE * neg)) / (sum(pos) * sum(neg)::DOUBLE) AS auc, count(*) AS unique_values FROM (
    SELECT feature, value, pos, neg, sum(neg) OVER (PARTITION BY feature ORDER BY value) AS neg_upto FROM (
      SELECT feature, value, count(*) FILTER (true_ring_member) AS pos, count(*) FILTER (NOT true_ring_member) AS neg
      FROM (UNPIVOT (SELECT account_id, COLUMNS(* EXCLUDE (account_id))::DOUBLE FROM whole_matrix) ON COLUMNS(* EXCLUDE (account_id)) INTO NAME feature VALUE value)
      JOIN fx_truth USING (account_id) GROUP BY 1, 2)) GROUP BY 1) WHERE unique_values >= 2"""


def _whole_audit(d):
    m = compared_matrix(d)
    return M.feature_audit(m, d.truth, numeric_columns(m))


@query("m10_feature_audit_all", _WHOLE_AUDIT)
def m10_all(d):
    """Every numeric column of the graph matrix, which holds the feature matrix."""
    return _whole_audit(d)


@query("m12_shortcut_gate_all", f"""
SELECT max(single_feature_auc) AS max_auc, max(single_feature_auc) <= 0.80 AS passed FROM (
  {_audit_sql('raw_signals', M.RAW_SIGNALS)} UNION ALL SELECT feature, single_feature_auc, unique_values FROM ({_WHOLE_AUDIT}))""")
def m12_all(d):
    raw = M.feature_audit(materialize(signals(d), "signals"), d.truth, M.RAW_SIGNALS)
    return M.shortcut_gate(raw.unionByName(_whole_audit(d)))


@query("p3_input_report_all", """
SELECT feature, min(value) FILTER (split = 'train') = max(value) FILTER (split = 'train') AS constant_in_train, count(*) FILTER (value IS NULL) AS null_values,
  count(*) FILTER (NOT isfinite(value)) AS not_finite_values
FROM (UNPIVOT (SELECT account_id, COLUMNS(* EXCLUDE (account_id, community_id))::DOUBLE FROM whole_matrix) ON COLUMNS(* EXCLUDE (account_id)) INTO NAME feature VALUE value)
JOIN split USING (account_id) GROUP BY 1""")
def p3_all(d):
    m = compared_matrix(d)
    inputs = numeric_columns(m, ("account_id", "community_id"))
    return P.input_report(m.select("account_id", *inputs), split(d))


# Entity tables of the star schema: what orders refer to besides accounts and devices. Addresses
# and instruments of one customer group are missing in some suppliers, so orphans occur.
_FIRST = "MIN(order_timestamp) AS first_seen_at"
PRELUDE["fx_order_addresses"] = f"SELECT address_id, {_FIRST} FROM fx_orders WHERE address_id % 40 <> 7 GROUP BY 1"
PRELUDE["fx_phones"] = f"SELECT phone_hash, {_FIRST} FROM fx_orders WHERE CAST(phone_hash AS BIGINT) % 10 <> 3 GROUP BY 1"
PRELUDE["fx_instruments"] = f"""
SELECT instrument_id, ['card', 'upi', 'netbanking', 'wallet', 'cheque'][CAST(instrument_id % 5 AS INTEGER) + 1] AS instrument_type, {_FIRST}
FROM fx_orders WHERE instrument_id % 20 <> 5 GROUP BY 1"""


def entities(d):
    """Address, phone and instrument tables derived from the stored orders."""
    first = F.min("order_timestamp").alias("first_seen_at")
    o = d.stored_orders
    kinds = F.array(*[F.lit(k) for k in ("card", "upi", "netbanking", "wallet", "cheque")])
    return {
        "addresses": o.filter("address_id % 40 <> 7").groupBy("address_id").agg(first),
        "phones": o.filter("CAST(phone_hash AS BIGINT) % 10 <> 3").groupBy("phone_hash").agg(first),
        "instruments": o.filter("instrument_id % 20 <> 5").groupBy("instrument_id").agg(first)
        .withColumn("instrument_type", F.element_at(kinds, (F.col("instrument_id") % 5 + 1).cast("int"))),
    }


# Systems of the devices: one in seven is outside the domain, one in 29 is unknown.
_SYSTEMS = ["Android", "iOS", "Windows", "macOS", "Linux", "Android", "Tizen"]
PRELUDE["fx_device_systems"] = f"SELECT device_id, CASE WHEN device_id % 29 <> 3 THEN {_SYSTEMS}[CAST(device_id % 7 AS INTEGER) + 1] END AS os_family FROM fx_devices"


def device_systems(d):
    names = F.array(*[F.lit(s) for s in _SYSTEMS])
    system = F.element_at(names, (F.col("device_id") % 7 + 1).cast("int"))
    return d.devices.select("device_id", F.when(F.col("device_id") % 29 != 3, system).alias("os_family"))


# Columns by table; False where the derived tables lack one.
_TABLES = {
    "accounts": ("fx_accounts", {"account_id": True, "account_created_at": True, "customer_type": True}),
    "devices": ("fx_devices", {"device_id": True, "os_family": False, "browser_family": False, "ip_prefix": True, "first_seen_at": True}),
    "addresses": ("fx_order_addresses", {"address_id": True, "canonical_address": False, "city": False, "pincode": False, "is_drop_address": False, "first_seen_at": True}),
    "phones": ("fx_phones", {"phone_hash": True, "first_seen_at": True}),
    "instruments": ("fx_instruments", {"instrument_id": True, "instrument_type": True, "bin_or_vpa_hash": False, "first_seen_at": True}),
    "orders": ("fx_orders", {c: True for c in (
        "order_id", "account_id", "device_id", "address_id", "phone_hash", "instrument_id", "amount", "discount_amount", "category",
        "order_timestamp", "delivery_status", "delivery_timestamp", "rto_flag", "return_flag", "refund_flag", "dispute_flag")}),
}


@query("q1_required_columns_all", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS column_name, {str(there).lower()} AS present, {f'count({c})' if there else 'CASE WHEN count(*) < 0 THEN 0 END'} AS filled_rows FROM {t}"
    for n, (t, cols) in _TABLES.items() for c, there in cols.items()))
def q1_all(d):
    """Every required column of the six tables."""
    frames = {"accounts": d.accounts, "devices": d.devices, "orders": d.stored_orders, **entities(d)}
    return Q.missing_columns(frames, {n: list(cols) for n, (_, cols) in _TABLES.items()})


@query("q5_domains_all", """
SELECT 'os_family' AS column_name, count(*) FILTER (os_family IS NULL OR os_family NOT IN ('Android', 'iOS', 'Windows', 'macOS', 'Linux')) AS outside FROM fx_device_systems
UNION ALL SELECT 'customer_type' AS column_name, count(*) FILTER (customer_type IS NULL OR customer_type NOT IN ('regular', 'new', 'guest')) AS outside FROM fx_accounts
UNION ALL SELECT 'instrument_type', count(*) FILTER (instrument_type IS NULL OR instrument_type NOT IN ('card', 'upi', 'netbanking', 'wallet')) FROM fx_instruments""")
def q5_all(d):
    """Domains of accounts, instruments and devices."""
    types = Q.outside_domain(d.accounts, {"customer_type": ["regular", "new", "guest"]})
    systems = Q.outside_domain(device_systems(d), {"os_family": ["Android", "iOS", "Windows", "macOS", "Linux"]})
    return types.unionByName(systems).unionByName(Q.outside_domain(entities(d)["instruments"], {"instrument_type": ["card", "upi", "netbanking", "wallet"]}))


_KEYS = [
    ("orders.account", "fx_orders", "account_id", "fx_accounts"), ("orders.device", "fx_orders", "device_id", "fx_devices"),
    ("orders.address", "fx_orders", "address_id", "fx_order_addresses"), ("orders.phone", "fx_orders", "phone_hash", "fx_phones"),
    ("orders.instrument", "fx_orders", "instrument_id", "fx_instruments"),
    ("refunds.order", "fx_refunds", "order_id", "fx_orders"), ("refunds.account", "fx_refunds", "account_id", "fx_accounts"),
    ("disputes.order", "fx_disputes", "order_id", "fx_orders"), ("disputes.account", "fx_disputes", "account_id", "fx_accounts"),
]


@query("q6_orphans_all", " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, count(*) AS violations FROM {child} WHERE {k} IS NULL OR {k} NOT IN (SELECT {k} FROM {parent})" for n, child, k, parent in _KEYS))
def q6_all(d):
    """All nine foreign keys."""
    own = entities(d)
    frames = {
        "fx_orders": d.stored_orders, "fx_accounts": d.accounts, "fx_devices": d.devices, "fx_refunds": d.refunds, "fx_disputes": d.disputes,
        "fx_order_addresses": own["addresses"], "fx_phones": own["phones"], "fx_instruments": own["instruments"],
    }
    return Q.orphan_rows([(n, frames[child], k, frames[parent], k) for n, child, k, parent in _KEYS])


_LATE = {"addresses": "fx_order_addresses", "phones": "fx_phones", "instruments": "fx_instruments"}
PRELUDE["used_entities"] = "SELECT * FROM used_rows WHERE table_name IN ('orders', 'devices') UNION ALL " + " UNION ALL ".join(
    f"SELECT '{n}', max(first_seen_at) FILTER (first_seen_at <= {CUT}), count(*) FILTER (first_seen_at <= {CUT}), count(*) FILTER (first_seen_at > {CUT}) FROM {t}"
    for n, t in _LATE.items())


@query("q13_graph_leakage_all", """
SELECT max(max_timestamp_used) AS max_timestamp_used, CAST(sum(rows_after_cutoff) AS BIGINT) AS rows_excluded, (SELECT count(*) FROM fx_accounts) AS matrix_rows, 0::BIGINT AS missing_values, 0::BIGINT AS forbidden_columns, 'PASSED' AS leakage_check,
  (SELECT count(*) FROM fx_accounts) AS graph_nodes, (SELECT count(*) FROM edges) AS graph_edges, (SELECT count(*) FROM pre_orders WHERE trim(coupon_code) <> '') AS coupon_rows FROM used_entities""")
def q13_all(d):
    """Orders, devices, addresses, phones and instruments, and the graph matrix."""
    late = Q.excluded_rows({n: (t, "first_seen_at") for n, t in entities(d).items()}, CUTOFF)
    coupons = pre_orders(d).filter(nonblank("coupon_code"))
    both = used(d, ["orders", "devices"]).unionByName(late)
    return Q.graph_leakage_report(both, whole_matrix(d), d.accounts, edges(d), coupons, CUTOFF).drop("matrix_columns")


_ENTITY_TABLES = {"addresses": "fx_order_addresses", "phones": "fx_phones", "payment_instruments": "fx_instruments"}


@query("f1b_entity_cutoff", f"""
SELECT 'devices' AS table_name, count(*) AS n, max(first_seen_at) AS latest FROM pre_devices UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{n}', count(*), max(first_seen_at) FROM {t} WHERE first_seen_at <= {CUT}" for n, t in _ENTITY_TABLES.items()))
def f1b(d):
    """Every entity table as it was at the cutoff."""
    own = entities(d)
    tables = {"devices": d.devices, "addresses": own["addresses"], "phones": own["phones"], "payment_instruments": own["instruments"]}
    parts = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n"), F.max(C.CUTOFF_COLUMN[n]).alias("latest")) for n, df in C.filter_tables(tables, CUTOFF).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_MONEY = ["total_amount", "total_refund_amount"]


@query("n19b_account_record", f"""
WITH pg AS (SELECT account_id, 0::INTEGER AS page, case_report_text FROM reports),
lp AS (SELECT account_id, CAST((link_no - 1) // {N.PAGE_LINKS} AS INTEGER) AS page, string_agg(link_text, ' | ' ORDER BY link_no) AS linked_accounts FROM linktext GROUP BY 1, 2),
pages AS (SELECT account_id, page, case_report_text, linked_accounts FROM pg FULL JOIN lp USING (account_id, page))
SELECT q.account_id, rank, (SELECT count(*) FROM queue) AS rank_total, '{N.MODEL_VERSION}' AS model_version, round(proba, 9) AS proba, risk_tier, recommended_action,
  {", ".join(f"round(f.{c}::DOUBLE, 2) AS {c}" if c in _MONEY else f"round(f.{c}::DOUBLE, 9) AS {c}" if c.endswith("_rate") else f"f.{c}" for c in N.RECORD_FACTS if c != "community_size")}, k.community_size,
  has_dispute_at_cutoff, missing_evidence_count, total_graph_links, strongest_edge_type, round(strongest_edge_weight, 9) AS strongest_edge_weight, number_of_device_links, number_of_ip_links, number_of_coupon_links,
  (SELECT string_agg(feature || ':' || direction, ',' ORDER BY place) FROM contrib c WHERE c.account_id = q.account_id) AS contributors, page, case_report_text, linked_accounts
FROM queue q JOIN features f USING (account_id) JOIN (SELECT account_id, community_size FROM ({_COMM_SQL})) k USING (account_id)
JOIN evidence USING (account_id) JOIN gevidence USING (account_id) JOIN pages USING (account_id)""")
def n19b(d):
    """The whole record of every queued account."""
    f = stored_features(d)
    facts = f.join(community_features(f, d.communities).select("account_id", "community_size"), "account_id").select("account_id", *N.RECORD_FACTS)
    record = N.account_record(
        queue(d), facts, N.evidence_gap(queue(d), pre_disputes(d)), N.graph_evidence(queue(d), edges(d)), links(d), contributors(d), reports(d)
    )
    flat = record.select(
        "account_id", "rank", "rank_total", "model_version", "proba", "risk_tier", "recommended_action", "observed_facts.*",
        "evidence_status.has_dispute_at_cutoff", "evidence_status.missing_evidence_count", "graph_evidence.*",
        F.array_join(F.transform("contributors", lambda x: F.concat(x["feature"], F.lit(":"), x["direction"])), ",").alias("contributors"),
        "page", "case_report_text", "linked_accounts",
    )
    for c in _MONEY:
        flat = flat.withColumn(c, F.round(c, 2))
    return rounded(flat, ["proba", "return_rate", "refund_rate", "dispute_rate", "strongest_edge_weight"])
