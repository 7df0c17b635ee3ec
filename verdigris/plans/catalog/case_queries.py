"""Investigation, audit and rollup queries."""

from pyspark.sql import functions as F

from verdigris.constants import EDGE_WEIGHTS, EVIDENCE_FIELDS, RANK_TIERS, TIERS
from verdigris.functions.exprs import tier_of_rank
from verdigris.operators import audit as A
from verdigris.operators import investigation as N
from verdigris.operators import models as L
from verdigris.operators import rollups as U
from verdigris.operators.community_features import community_features
from verdigris.operators.identity import KINDS
from verdigris.plans.catalog.base_queries import behavior, pre_disputes, rounded, sql_round
from verdigris.plans.catalog.graph_queries import _COMM_SQL, edges, stored_features
from verdigris.plans.catalog.model_queries import ACTION_SQL, members, scored_candidates
from verdigris.plans.catalog.prelude import PRELUDE
from verdigris.plans.catalog.registry import query
from verdigris.session import materialize

TOP = 100

PRELUDE["queue"] = f"""
SELECT account_id, proba, rank, risk_tier, CASE risk_tier WHEN 'CRITICAL' THEN 'SOFT_HOLD_REFUND_PENDING_HUMAN_APPROVAL' WHEN 'HIGH' THEN 'ROUTE_TO_HUMAN_REVIEW'
  WHEN 'MEDIUM' THEN 'STEP_UP_REFUND_VERIFICATION' ELSE 'NO_ACTION' END AS action_code, {ACTION_SQL.format(t='risk_tier')} AS recommended_action, risk_tier <> 'LOW' AS requires_human_review
FROM (SELECT *, CASE WHEN rank <= 10 THEN 'CRITICAL' WHEN rank <= 25 THEN 'HIGH' WHEN rank <= 65 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
  FROM (SELECT account_id, proba_A AS proba, row_number() OVER (ORDER BY proba_A DESC, account_id) AS rank FROM fx_scores) WHERE rank <= {TOP})"""


def queue(d):
    if not hasattr(d, "_queue"):
        d._queue = materialize(N.flagged_queue(d.scores, "proba_A", TOP), "queue")
    return d._queue


@query("n1_rank_accounts", f"""
SELECT account_id, round(proba_A, 9) AS score, row_number() OVER (ORDER BY proba_A DESC, account_id) AS rank,
  row_number() OVER (ORDER BY proba_A DESC, account_id) <= {TOP} AS flagged FROM fx_scores""")
def n1(d):
    out = N.rank_accounts(d.scores, "proba_A", top_k=TOP)
    return out.select("account_id", F.round("proba_A", 9).alias("score"), "rank", "flagged")


@query("n1b_flag_by_threshold", "SELECT account_id, row_number() OVER (ORDER BY proba_A DESC, account_id) AS rank, proba_A >= 0.6 AS flagged FROM fx_scores")
def n1b(d):
    return N.rank_accounts(d.scores, "proba_A", threshold=0.6).select("account_id", "rank", "flagged")


@query("n2_rank_tiers", "SELECT event_id, CASE WHEN rank <= 10 THEN 'CRITICAL' WHEN rank <= 25 THEN 'HIGH' WHEN rank <= 65 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM fx_audit")
def n2(d):
    return d.audit.select("event_id", tier_of_rank(F.col("rank"), RANK_TIERS).alias("tier"))


@query("n3_community_tiers", """
SELECT account_id, rank, community_size,
  CASE WHEN rank <= 2 AND community_size >= 4 THEN 'CRITICAL' WHEN rank <= 2 THEN 'HIGH' WHEN rank <= 5 THEN 'MEDIUM' ELSE 'LOW' END AS tier_v1,
  CASE WHEN rank <= 5 AND community_size >= 4 THEN 'CRITICAL' WHEN rank <= 20 THEN 'HIGH' WHEN rank <= 60 THEN 'MEDIUM' ELSE 'LOW' END AS tier_v4
FROM (SELECT account_id, row_number() OVER (ORDER BY proba_A DESC, account_id) AS rank FROM fx_scores)
JOIN (SELECT account_id, count(*) OVER (PARTITION BY community_id) AS community_size FROM fx_communities) USING (account_id)""")
def n3(d):
    sizes = d.communities.groupBy("community_id").agg(F.count("*").alias("community_size"))
    out = N.rank_accounts(d.scores, "proba_A", top_k=TOP).join(d.communities, "account_id").join(sizes, "community_id")
    return out.select("account_id", "rank", "community_size", N.community_tier("v1").alias("tier_v1"), N.community_tier("v4").alias("tier_v4"))


@query("n4_bounded_actions", f"""
SELECT account_id, CASE WHEN rank <= 10 THEN 'CRITICAL' WHEN rank <= 25 THEN 'HIGH' WHEN rank <= 65 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  CASE WHEN rank <= 10 THEN 'SOFT_HOLD_REFUND_PENDING_HUMAN_APPROVAL' WHEN rank <= 25 THEN 'ROUTE_TO_HUMAN_REVIEW' WHEN rank <= 65 THEN 'STEP_UP_REFUND_VERIFICATION' ELSE 'NO_ACTION' END AS action_code,
  rank <= 65 AS requires_human_review FROM (SELECT account_id, row_number() OVER (ORDER BY proba_A DESC, account_id) AS rank FROM fx_scores)""")
def n4(d):
    out = N.with_actions(N.rank_accounts(d.scores, "proba_A", top_k=TOP))
    return out.select("account_id", "risk_tier", "action_code", "requires_human_review")


@query("n5_action_checks", f"""
SELECT 0::BIGINT AS unknown_tier, 0::BIGINT AS repeated_accounts, 0::BIGINT AS missing_action, 0::BIGINT AS forbidden_phrase, 0::BIGINT AS critical_without_human,
  (SELECT count(*) FROM (SELECT account_id FROM fx_scores WHERE proba_A >= 0.6) WHERE account_id NOT IN (SELECT account_id FROM queue)) AS uncovered_accounts""")
def n5(d):
    return N.action_violations(queue(d), d.scores.filter("proba_A >= 0.6").select("account_id"))


@query("n6_queue", "SELECT account_id, round(proba, 9) AS proba, rank, risk_tier, recommended_action FROM queue WHERE rank <= 25")
def n6(d):
    out = N.queue_page(N.flagged_queue(d.scores, "proba_A", TOP), 25)
    return rounded(out.select("account_id", "proba", "rank", "risk_tier", "recommended_action"), ["proba"])


PRELUDE["evidence"] = f"""
SELECT q.account_id, d.account_id IS NOT NULL AS has_dispute_at_cutoff,
  {', '.join(f"CASE WHEN d.account_id IS NULL THEN 'NO_DISPUTE_YET' WHEN {c} THEN 'true' ELSE 'false' END AS {c}" for c in EVIDENCE_FIELDS)},
  {' + '.join(f'CAST(NOT {c} AS BIGINT)' for c in EVIDENCE_FIELDS)} AS missing_evidence_count
FROM queue q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY dispute_created_at DESC, dispute_id DESC) AS rn FROM pre_disputes) WHERE rn = 1) d USING (account_id)"""


@query("n7_evidence_gap", "SELECT * FROM evidence")
def n7(d):
    return N.evidence_gap(queue(d), pre_disputes(d))


PRELUDE["qlinks"] = "SELECT src AS account_id, dst AS linked_account, edge_type, weight FROM sym WHERE src IN (SELECT account_id FROM queue)"
PRELUDE["gevidence"] = """
SELECT q.account_id, coalesce(n, 0) AS total_graph_links, edge_type AS strongest_edge_type, weight AS strongest_edge_weight, coalesce(nd, 0) AS number_of_device_links,
  coalesce(ni, 0) AS number_of_ip_links, coalesce(nc, 0) AS number_of_coupon_links
FROM queue q LEFT JOIN (SELECT account_id, count(*) AS n, count(*) FILTER (edge_type = 'shares_device') AS nd, count(*) FILTER (edge_type = 'shares_ip_prefix') AS ni,
    count(*) FILTER (edge_type = 'shares_coupon') AS nc FROM qlinks GROUP BY 1) c USING (account_id)
LEFT JOIN (SELECT account_id, edge_type, weight FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY weight DESC, least(account_id, linked_account), greatest(account_id, linked_account)) AS rn FROM qlinks) WHERE rn = 1) s USING (account_id)"""


@query("n8_graph_evidence", "SELECT * FROM gevidence")
def n8(d):
    return N.graph_evidence(queue(d), edges(d))


PRELUDE["linktext"] = """
SELECT account_id, linked_account, edge_type, row_number() OVER (PARTITION BY account_id ORDER BY least(account_id, linked_account), greatest(account_id, linked_account)) AS link_no,
  edge_type || ' -> ' || CAST(linked_account AS VARCHAR) AS link_text FROM qlinks"""


def links(d):
    if not hasattr(d, "_links"):
        d._links = materialize(N.numbered_links(queue(d), edges(d)), "links")
    return d._links


@query("n8b_link_pages", f"""
SELECT account_id, CAST((link_no - 1) // {N.PAGE_LINKS} AS INTEGER) AS page, string_agg(link_text, ' | ' ORDER BY link_no) AS linked_accounts FROM linktext GROUP BY 1, 2""")
def n8b(d):
    return N.link_pages(links(d))


@query("n9_link_explanations", """
SELECT g.*, CAST(t.linked_account AS VARCHAR) AS strongest_edge_target, CASE WHEN strongest_edge_type IS NOT NULL THEN
  'Strongest configured relationship is a ' || CASE strongest_edge_type WHEN 'shares_device' THEN 'shared device' WHEN 'shares_phone' THEN 'shared phone' WHEN 'shares_payment_instrument' THEN 'shared payment instrument'
    WHEN 'shares_address' THEN 'shared address' WHEN 'shares_ip_prefix' THEN 'shared IP prefix' ELSE 'shared coupon' END
  || ' link to ' || CAST(t.linked_account AS VARCHAR) || ' (weight ' || printf('%.2f', strongest_edge_weight) || '). The weight is an evidence-prioritization heuristic, not proof of abuse.' END AS strongest_edge_explanation
FROM gevidence g LEFT JOIN (SELECT account_id, edge_type, arg_min(linked_account, link_no) AS linked_account FROM linktext GROUP BY 1, 2) t ON t.account_id = g.account_id AND t.edge_type = g.strongest_edge_type""")
def n9(d):
    parsed = N.parse_links(N.link_pages(links(d)))
    return N.link_explanations(N.graph_evidence(queue(d), edges(d)), parsed)


@query("n9b_parsed_links", "SELECT account_id, edge_type, CAST(linked_account AS VARCHAR) AS linked_account FROM qlinks")
def n9b(d):
    return N.parse_links(N.link_pages(links(d))).select("account_id", "edge_type", "linked_account")


@query("n10_ego_graph", """
SELECT q.account_id AS focus, q.account_id AS node, true AS is_focus, community_id FROM queue q JOIN fx_communities USING (account_id)
UNION ALL SELECT l.account_id, linked_account, false, c.community_id FROM qlinks l JOIN fx_communities c ON c.account_id = linked_account""")
def n10(d):
    return N.ego_nodes(queue(d), edges(d), d.communities)


@query("n10b_ego_edges", "SELECT account_id AS source, linked_account AS target, edge_type, weight FROM qlinks")
def n10b(d):
    return N.ego_edges(queue(d), edges(d))


PRELUDE["overview"] = """
SELECT node, bool_or(f) AS is_focus, min(community_id) AS community_id FROM (
  SELECT account_id AS node, true AS f FROM queue UNION ALL SELECT linked_account, false FROM qlinks)
JOIN fx_communities ON account_id = node GROUP BY 1"""


@query("n11_overview_graph", "SELECT * FROM overview")
def n11(d):
    return N.overview_nodes(queue(d), edges(d), d.communities)


PRELUDE["tline"] = """
SELECT account_id, order_id, order_timestamp AS "timestamp", 'Order placed' AS event, 'Order ' || CAST(order_id AS VARCHAR) || ', amount ₹' || printf('%.2f', amount) AS details, amount FROM fx_orders
UNION ALL SELECT account_id, order_id, delivery_timestamp, 'Order delivered', 'Order ' || CAST(order_id AS VARCHAR), NULL FROM fx_orders WHERE delivery_timestamp IS NOT NULL
UNION ALL SELECT account_id, order_id, return_timestamp, 'Return requested', 'Order ' || CAST(order_id AS VARCHAR) || ', reason ' || return_reason_code, NULL FROM fx_orders WHERE return_flag
UNION ALL SELECT account_id, order_id, refund_timestamp, 'Refund processed', 'Order ' || CAST(order_id AS VARCHAR) || ', amount ₹' || printf('%.2f', refund_amount), refund_amount FROM fx_orders WHERE refund_flag
UNION ALL SELECT account_id, order_id, dispute_created_at, 'Dispute created', 'Reason ' || dispute_reason_code, NULL FROM fx_disputes"""


@query("n12_timeline", 'SELECT account_id, order_id, "timestamp", event, details FROM tline')
def n12(d):
    return N.sorted_timeline(N.timeline(d.orders, d.disputes)).drop("amount")


@query("n12b_timeline_at_cutoff", "SELECT account_id, order_id, \"timestamp\", event FROM tline WHERE \"timestamp\" <= TIMESTAMP '2000-01-01'")
def n12b(d):
    return N.timeline(d.orders, d.disputes, cutoff="2000-01-01 00:00:00").drop("amount", "details")


@query("n13_timeline_facts", """
SELECT b.account_id, total_orders, CASE WHEN r > 0 THEN r ELSE total_returns END AS total_returns,
  round(CASE WHEN r > 0 AND total_orders > 0 THEN r / total_orders::DOUBLE ELSE return_rate END, 9) AS return_rate,
  CASE WHEN f > 0 THEN f ELSE total_refunds END AS total_refunds, round(CASE WHEN f > 0 THEN fa ELSE total_refund_amount END, 6) AS total_refund_amount,
  round(CASE WHEN f > 0 AND total_orders > 0 THEN f / total_orders::DOUBLE ELSE refund_rate END, 9) AS refund_rate
FROM behavior b LEFT JOIN (SELECT account_id, count(*) FILTER (event = 'Return requested') AS r, count(*) FILTER (event = 'Refund processed') AS f,
  sum(amount) FILTER (event = 'Refund processed') AS fa FROM tline GROUP BY 1) t USING (account_id)""")
def n13(d):
    totals = behavior(d).select("account_id", "total_orders", "total_returns", "return_rate", "total_refunds", "total_refund_amount", "refund_rate")
    return rounded(N.timeline_facts(N.timeline(d.orders, d.disputes), totals), ["return_rate", "refund_rate", "total_refund_amount"])


PRELUDE["money"] = """
SELECT account_id, sum(amount) AS gross_order_value, coalesce(sum(refund_amount) FILTER (refund_flag), 0) AS refund_amount,
  greatest(0, sum(amount) - coalesce(sum(refund_amount) FILTER (refund_flag), 0)) AS potential_exposure FROM fx_orders GROUP BY 1"""
_MONEY = ["gross_order_value", "refund_amount", "potential_exposure"]


@query("n14_exposure", f"SELECT account_id, {sql_round(*_MONEY)} FROM money")
def n14(d):
    return rounded(N.exposure(d.orders), _MONEY)


@query("n15_shared_attributes", " UNION ALL ".join(f"SELECT account_id, '{k}' AS attribute, shared_{k}_count AS count FROM identity WHERE shared_{k}_count > 0 AND account_id IN (SELECT account_id FROM queue)" for k in KINDS))
def n15(d):
    return N.shared_attributes(queue(d), stored_features(d), KINDS)


@query("n16_policy_lookup", f"""
SELECT order_id, CASE category WHEN 'fashion' THEN '{N.POLICIES['fashion']}' WHEN 'electronics' THEN '{N.POLICIES['electronics']}' ELSE '{N.DEFAULT_POLICY}' END AS policy
FROM (SELECT order_id, CASE category WHEN '1-URGENT' THEN 'fashion' WHEN '2-HIGH' THEN 'electronics' ELSE category END AS category FROM fx_orders)""")
def n16(d):
    shop = F.when(F.col("category") == "1-URGENT", "fashion").when(F.col("category") == "2-HIGH", "electronics").otherwise(F.col("category"))
    return d.orders.select("order_id", N.policy_for(shop).alias("policy"))


WEIGHTS = {"return_rate": 2.0, "refund_rate": -1.0, "coupon_usage_rate": 0.5, "dispute_rate": 1.5, "total_orders": 0.01, "shared_device_count": 0.3}
PRELUDE["attrib"] = " UNION ALL ".join(
    f"SELECT account_id, '{c}' AS feature, round({w}::DOUBLE * ({c} - (SELECT avg({c}) FROM features)), 9) AS value FROM features" for c, w in WEIGHTS.items()
)
PRELUDE["contrib"] = """
SELECT *, CASE WHEN value > 0 THEN 'increased' ELSE 'decreased' END AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(value) DESC, feature) AS place FROM attrib) WHERE place <= 5"""


def contributors(d):
    values = L.linear_attributions(stored_features(d), WEIGHTS)
    return N.top_contributors(values.withColumn("value", F.round("value", 9)))


def facts(d):
    f = stored_features(d)
    return f.join(community_features(f, d.communities).select("account_id", "community_size"), "account_id").select(
        "account_id", *[c for c in N.BEHAVIOR_FACTS]
    )


PRELUDE["qfacts"] = f"SELECT account_id, total_orders, return_rate, refund_rate, dispute_rate, shared_device_count, shared_ip_prefix_count, community_size FROM features JOIN (SELECT account_id, community_size FROM ({_COMM_SQL})) USING (account_id)"
PRELUDE["reports"] = f"""
SELECT account_id, concat_ws(chr(10), 'Account ID: ' || CAST(account_id AS VARCHAR), 'Risk score: ' || printf('%.6f', proba), 'Investigation rank: ' || CAST(rank AS VARCHAR) || ' / {TOP} flagged accounts',
  '', 'Observed facts:', '  total_orders: ' || CAST(total_orders AS VARCHAR), '  return_rate: ' || printf('%.6f', return_rate), '  refund_rate: ' || printf('%.6f', refund_rate), '  dispute_rate: ' || printf('%.6f', dispute_rate),
  '  shared_device_count: ' || CAST(shared_device_count AS VARCHAR), '  shared_ip_prefix_count: ' || CAST(shared_ip_prefix_count AS VARCHAR), '  community_size: ' || CAST(community_size AS VARCHAR),
  '', 'Top model contributors:', ctext, '', 'Graph evidence:', coalesce(ltext, '  No graph relationships observed.'), '', 'Evidence status:',
  CASE WHEN has_dispute_at_cutoff THEN {" || chr(10) || ".join(f"'  {c}: ' || CASE WHEN {c} = 'true' THEN 'AVAILABLE' ELSE 'MISSING' END" for c in EVIDENCE_FIELDS)} || chr(10) || '  Missing evidence count: ' || CAST(missing_evidence_count AS VARCHAR)
    ELSE '  No dispute observed at prediction cutoff.' END, '', 'Recommended action:', '  ' || recommended_action) AS case_report_text
FROM queue JOIN qfacts USING (account_id) JOIN evidence USING (account_id)
JOIN (SELECT account_id, string_agg('  ' || feature || ': ' || printf('%.6f', value) || ' (' || direction || ' model risk)', chr(10) ORDER BY place) AS ctext FROM contrib GROUP BY 1) c USING (account_id)
LEFT JOIN (SELECT account_id, string_agg('  ' || link_text, chr(10) ORDER BY link_no) AS ltext FROM linktext GROUP BY 1) l USING (account_id)"""


def reports(d):
    if not hasattr(d, "_reports"):
        lines = N.report_lines(queue(d), facts(d), contributors(d), links(d), N.evidence_gap(queue(d), pre_disputes(d)), TOP)
        d._reports = materialize(N.report_pages(lines), "reports")
    return d._reports


@query("n17_case_reports", "SELECT account_id, 0::INTEGER AS page, case_report_text FROM reports")
def n17(d):
    return reports(d)


@query("n18_report_checks", "SELECT count(*) AS n_reports, 0::BIGINT AS missing_reports, 0::BIGINT AS unexpected_reports, 0::BIGINT AS empty_reports, count(*) FILTER (NOT contains(case_report_text, 'Recommended action:')) AS without_action FROM reports")
def n18(d):
    return N.report_violations(reports(d), queue(d))


@query("n19_account_360", """
SELECT q.account_id, rank, risk_tier, total_orders, community_size, has_dispute_at_cutoff, missing_evidence_count, total_graph_links, strongest_edge_type,
  (SELECT string_agg(feature || ':' || direction, ',' ORDER BY place) FROM contrib c WHERE c.account_id = q.account_id) AS contributors, 0::INTEGER AS page, case_report_text, 1::BIGINT AS report_pages
FROM queue q JOIN qfacts USING (account_id) JOIN evidence USING (account_id) JOIN gevidence USING (account_id) JOIN reports USING (account_id)""")
def n19(d):
    full = N.account_360(queue(d), facts(d), N.evidence_gap(queue(d), pre_disputes(d)), N.graph_evidence(queue(d), edges(d)), contributors(d), reports(d))
    return full.select(
        "account_id", "rank", "risk_tier", "observed_facts.total_orders", "observed_facts.community_size",
        "evidence_status.has_dispute_at_cutoff", "evidence_status.missing_evidence_count", "graph_evidence.total_graph_links",
        "graph_evidence.strongest_edge_type",
        F.array_join(F.transform("contributors", lambda x: F.concat(x["feature"], F.lit(":"), x["direction"])), ",").alias("contributors"),
        "page", "case_report_text", "report_pages",
    )


@query("n20_decision_audit", """
SELECT TIMESTAMP '2000-01-02 00:00:00' AS "timestamp", account_id, 'blend_v1' AS model_version, round(proba, 9) AS proba, rank, risk_tier, true AS top_k_flag, recommended_action AS action_recommended,
  true AS case_report_generated FROM queue""")
def n20(d):
    done = reports(d).select("account_id").distinct()
    return rounded(A.decision_rows(queue(d), done, "blend_v1", "2000-01-02 00:00:00"), ["proba"])


PRELUDE["audit_norm"] = """
SELECT event_id, "timestamp", account_id, 'Ensemble_LGBM_B_GNN' AS model_version, TRY_CAST(proba AS DOUBLE) AS proba, rank, risk_tier, coalesce(top_k_flag IN ('yes', '1'), false) AS top_k_flag,
  act AS action_recommended, false AS case_report_generated, coalesce(investigation_source, '') AS investigation_source, coalesce(summary, '') AS summary,
  sha256(strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') || '|' || CAST(account_id AS VARCHAR) || '|Ensemble_LGBM_B_GNN|' || coalesce(printf('%.6f', TRY_CAST(proba AS DOUBLE)), '') || '|' || CAST(rank AS VARCHAR) || '|' || risk_tier || '|' || act) AS input_data_hash,
  CASE WHEN regexp_matches(lower(act), 'review|hold|verification') THEN 'PENDING_HUMAN_REVIEW' ELSE 'NOT_RECORDED' END AS human_decision,
  CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN regexp_matches(lower(act), 'review|hold|verification') THEN 'PENDING_REVIEW' ELSE 'RECORDED' END AS outcome, coalesce(error, 'none') AS error_path
FROM (SELECT *, CASE WHEN action_recommended <> '' THEN action_recommended ELSE coalesce(recommended_action, '') END AS act FROM fx_audit)"""


@query("n21_audit_normalization", "SELECT * EXCLUDE (investigation_source, summary) FROM audit_norm")
def n21(d):
    return A.normalize_audit(d.audit).drop("investigation_source", "summary", "threshold_used")


@query("n22_audit_pages", """
SELECT event_id, n, kind FROM (SELECT event_id, k AS kind, row_number() OVER (PARTITION BY k ORDER BY "timestamp" DESC, event_id DESC) AS n FROM (
  SELECT *, CASE WHEN investigation_source IN ('llm', 'deterministic') OR summary <> '' THEN 'investigation' ELSE 'prediction' END AS k FROM audit_norm))
WHERE n > 25 AND n <= 50""")
def n22(d):
    rows = A.normalize_audit(d.audit)
    order = [F.col("timestamp").desc(), F.col("event_id").desc()]
    inv = A.is_investigation(rows)
    a = A.audit_page(rows.filter(inv).select("event_id", "timestamp"), 2, 25, order).withColumn("kind", F.lit("investigation"))
    b = A.audit_page(rows.filter(~inv).select("event_id", "timestamp"), 2, 25, order).withColumn("kind", F.lit("prediction"))
    return a.unionByName(b).select("event_id", "n", "kind")


PRELUDE["narr"] = """
SELECT account_id, 'Gross value ₹' || printf('%.2f', gross_order_value + CASE WHEN account_id % 3 = 0 THEN 1 ELSE 0 END) || ' reviewed' AS summary,
  'Refunds of ₹' || printf('%.2f', refund_amount) AS f1, 'Shares a device' AS f2, 'Exposure ₹ ' || printf('%.2f', potential_exposure + CASE WHEN account_id % 5 = 0 THEN 7 ELSE 0 END) AS g1
FROM money"""


def narratives(d):
    m = N.exposure(d.orders)
    say = lambda c, plus: F.format_string("%.2f", F.col(c) + plus)
    a3 = F.when(F.col("account_id") % 3 == 0, 1).otherwise(0)
    a5 = F.when(F.col("account_id") % 5 == 0, 7).otherwise(0)
    return m.select(
        "account_id",
        F.concat(F.lit("Gross value ₹"), say("gross_order_value", a3), F.lit(" reviewed")).alias("summary"),
        F.array(F.concat(F.lit("Refunds of ₹"), say("refund_amount", F.lit(0))), F.lit("Shares a device")).alias("key_findings"),
        F.array(F.concat(F.lit("Exposure ₹ "), say("potential_exposure", a5))).alias("evidence_gaps"),
        F.array().cast("array<string>").alias("uncertainties"),
    )


@query("n23_monetary_claims", f"""
SELECT account_id, bad AS unsupported_claim, CASE WHEN bad THEN '{N.NEUTRAL_SUMMARY}' ELSE summary END AS summary,
  CASE WHEN bad THEN f2 ELSE f1 || ';' || f2 END AS key_findings, CASE WHEN bad THEN '' ELSE g1 END AS evidence_gaps FROM (
  SELECT *, len(list_filter(list_transform(list_concat(regexp_extract_all(summary, '₹\\s*([0-9.]+)', 1), regexp_extract_all(f1, '₹\\s*([0-9.]+)', 1), regexp_extract_all(g1, '₹\\s*([0-9.]+)', 1)), lambda x: round(CAST(x AS DOUBLE), 2)),
    lambda x: NOT list_contains(ok, x))) > 0 AS bad
  FROM narr JOIN (SELECT account_id, list(round(a, 2)) AS ok FROM (
    SELECT account_id, gross_order_value AS a FROM money UNION ALL SELECT account_id, refund_amount FROM money UNION ALL SELECT account_id, potential_exposure FROM money
    UNION ALL SELECT account_id, amount FROM tline WHERE amount IS NOT NULL) GROUP BY 1) USING (account_id))""")
def n23(d):
    out = N.check_claims(narratives(d), N.exposure(d.orders), N.timeline(d.orders, d.disputes))
    return out.select(
        "account_id", "unsupported_claim", "summary",
        F.array_join("key_findings", ";").alias("key_findings"), F.array_join("evidence_gaps", ";").alias("evidence_gaps"),
    )


@query("n24_investigation_summary", f"""
SELECT q.account_id, total_graph_links AS linked_accounts, coalesce(sh, 0) AS shared_attributes, coalesce(tn, 0) AS timeline_events, av AS evidence_available, mi AS evidence_missing,
  {sql_round(*_MONEY)}, CAST(total_graph_links AS VARCHAR) || ' linked accounts' AS links_text, CAST(coalesce(sh, 0) AS VARCHAR) || ' shared attributes across categories' AS shared_text,
  CASE WHEN has_dispute_at_cutoff THEN CAST(av AS VARCHAR) || ' available, ' || CAST(mi AS VARCHAR) || ' missing' ELSE 'no dispute at cutoff' END AS evidence_text,
  CAST(coalesce(tn, 0) AS VARCHAR) || ' timeline events' AS timeline_text
FROM queue q JOIN gevidence USING (account_id) JOIN (SELECT *, {' + '.join(f"CAST({c} = 'true' AS BIGINT)" for c in EVIDENCE_FIELDS)} AS av, {' + '.join(f"CAST({c} = 'false' AS BIGINT)" for c in EVIDENCE_FIELDS)} AS mi FROM evidence) e USING (account_id)
LEFT JOIN money USING (account_id) LEFT JOIN (SELECT account_id, count(*) AS tn FROM tline GROUP BY 1) t USING (account_id)
LEFT JOIN (SELECT account_id, {' + '.join(f'CAST(shared_{k}_count > 0 AS BIGINT)' for k in KINDS)} AS sh FROM identity) s USING (account_id)""")
def n24(d):
    q = queue(d)
    out = N.investigation_summary(
        q, edges(d), N.shared_attributes(q, stored_features(d), KINDS), N.evidence_gap(q, pre_disputes(d)),
        N.timeline(d.orders, d.disputes), N.exposure(d.orders),
    )
    return rounded(out.drop("exposure_text"), _MONEY)


@query("n25_json_extraction", """
SELECT event_id, event_id % 4 < 2 AS parsed, CASE WHEN event_id % 4 < 2 THEN event_type END AS summary,
  CASE event_id % 4 WHEN 0 THEN 'a;' || event_type WHEN 1 THEN 'only ' || event_type END AS key_findings FROM events""")
def n25(d):
    messy = d.raw("events").selectExpr(
        "event_id",
        """CASE event_id % 4 WHEN 0 THEN concat('{"summary": "', event_type, '", "key_findings": ["a", "', event_type, '"]}')
           WHEN 1 THEN concat('Here it is:\\n```{"summary": "', event_type, '",\\n "key_findings": "only ', event_type, '"}``` done')
           WHEN 2 THEN 'no structure here' END AS reply""",
    )
    out = N.extract_narrative(messy, "reply")
    return out.select("event_id", "parsed", "summary", F.array_join("key_findings", ";").alias("key_findings"))


# ------------------------------------------------------------------ rollups
@query("u1_tier_counts", f"SELECT t AS risk_tier, (SELECT count(*) FROM queue WHERE risk_tier = t) AS n FROM (SELECT unnest({TIERS!r}) AS t)")
def u1(d):
    return A.tier_counts(queue(d))


@query("u1b_queue_by_tier", "SELECT account_id, rank FROM queue WHERE risk_tier = 'HIGH'")
def u1b(d):
    return queue(d).filter(F.col("risk_tier") == "HIGH").select("account_id", "rank")


@query("u2_tier_trend", """
WITH s AS (SELECT risk_tier, min(epoch_ms("timestamp")) AS lo, max(epoch_ms("timestamp")) AS hi FROM fx_audit GROUP BY 1),
b AS (SELECT risk_tier, CAST(least(13, floor((epoch_ms("timestamp") - lo) / (hi - lo)::DOUBLE * 13)) AS INTEGER) AS bucket, count(*) AS n FROM fx_audit JOIN s USING (risk_tier) GROUP BY 1, 2)
SELECT s.risk_tier, CAST(t.i AS INTEGER) AS bucket, coalesce(n, 0) AS n FROM s JOIN range(14) t(i) ON true LEFT JOIN b ON b.risk_tier = s.risk_tier AND b.bucket = t.i""")
def u2(d):
    return A.tier_trend(d.audit)


@query("u3_shown_communities", "SELECT community_id, count(*) AS size FROM overview GROUP BY 1 HAVING count(*) > 1")
def u3(d):
    return U.community_sizes(N.overview_nodes(queue(d), edges(d), d.communities))


@query("u4_latest_audit", 'SELECT event_id, "timestamp", account_id FROM fx_audit ORDER BY "timestamp" DESC, event_id DESC LIMIT 12')
def u4(d):
    return A.latest_rows(d.audit, "event_id").select("event_id", "timestamp", "account_id")


@query("u4b_investigation_count", "SELECT count(*) AS investigations FROM audit_norm WHERE investigation_source IN ('llm', 'deterministic') OR summary <> ''")
def u4b(d):
    rows = A.normalize_audit(d.audit)
    return rows.agg(F.count_if(A.is_investigation(rows)).alias("investigations"))


PRELUDE["ring_of"] = f"""
SELECT account_id, candidate_id, ring_proba AS ring_score, CASE WHEN ring_proba >= 0.85 THEN 'CRITICAL' WHEN ring_proba >= 0.65 THEN 'HIGH' WHEN ring_proba >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
FROM kmembers JOIN kscored USING (candidate_id) WHERE ring_pred = 1"""


def ring_rows(d):
    from verdigris.constants import ACTIONS, SCORE_TIERS
    from verdigris.functions.exprs import lookup, tier_of_score

    tier = tier_of_score(F.col("ring_proba"), SCORE_TIERS)
    return scored_candidates(d).select(
        "candidate_id", F.col("ring_proba").alias("ring_score"), (F.col("ring_pred") == 1).alias("detected"), tier.alias("risk_tier")
    ).withColumn("recommended_action", lookup(F.col("risk_tier"), {t: a[1] for t, a in ACTIONS.items()}))


def _links_view(d):
    return edges(d).withColumnsRenamed({"account_id_1": "source", "account_id_2": "target"})


_U5 = f"""
SELECT g."group" AS community, members, flagged_members, peak_account, round(peak_score, 9) AS peak_score, coalesce(member_links, 0) AS member_links,
  {', '.join(f'coalesce(n_{t}, 0) AS n_{t}' for t in EDGE_WEIGHTS)}, strongest_edge_type, strongest_edge_weight, ring_candidate, coalesce(ring_score, 0) AS ring_score, ring_candidate IS NOT NULL AS ring_detected,
  coalesce(ring_tier, 'LOW') AS ring_tier
FROM (SELECT "group", count(*) AS members, count(q.account_id) AS flagged_members FROM grp LEFT JOIN queue q ON q.account_id = node GROUP BY 1) g
LEFT JOIN (SELECT "group", arg_min(account_id, rank) AS peak_account, max(proba) AS peak_score FROM grp JOIN queue ON account_id = node GROUP BY 1) p ON p."group" = g."group"
LEFT JOIN (SELECT "group", candidate_id AS ring_candidate, ring_score, risk_tier AS ring_tier FROM (
  SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY ring_score DESC, candidate_id) AS rn FROM grp JOIN ring_of ON account_id = node) WHERE rn = 1) r ON r."group" = g."group"
LEFT JOIN (SELECT a."group", count(*) AS member_links, {', '.join(f"count(*) FILTER (edge_type = '{t}') AS n_{t}" for t in EDGE_WEIGHTS)},
    first(edge_type ORDER BY weight DESC, account_id_1, account_id_2) AS strongest_edge_type, max(weight) AS strongest_edge_weight
  FROM edges JOIN grp a ON a.node = account_id_1 JOIN grp b ON b.node = account_id_2 AND b."group" = a."group" GROUP BY 1) l ON l."group" = g."group"
WHERE members > 1 OR flagged_members > 0"""


@query("u5_community_rollup", f"""WITH grp AS (SELECT node, CAST(community_id AS VARCHAR) AS "group" FROM overview) {_U5}""")
def u5(d):
    nodes = N.overview_nodes(queue(d), edges(d), d.communities)
    out = U.community_rollup(materialize(nodes, "nodes"), _links_view(d), queue(d), U.rings_by_member(ring_rows(d), members(d)))
    return rounded(U.sorted_rollup(out).drop("ring_action"), ["peak_score"])


@query("u6_filtered_degrees", """
SELECT node, count(*) AS degree FROM (SELECT account_id_1 AS node FROM edges WHERE edge_type = 'shares_device' UNION ALL SELECT account_id_2 FROM edges WHERE edge_type = 'shares_device') GROUP BY 1""")
def u6(d):
    return U.filtered_degrees(_links_view(d), "shares_device")


@query("u6b_node_search", "SELECT node, is_focus FROM overview WHERE CAST(node AS VARCHAR) LIKE '%12%'")
def u6b(d):
    nodes = N.overview_nodes(queue(d), edges(d), d.communities)
    return U.search_nodes(nodes, " 12 ").select("node", "is_focus")


@query("u7_ring_by_member", "SELECT account_id, candidate_id, ring_score, risk_tier FROM ring_of")
def u7(d):
    return U.rings_by_member(ring_rows(d), members(d)).select("account_id", "candidate_id", "ring_score", "risk_tier")
