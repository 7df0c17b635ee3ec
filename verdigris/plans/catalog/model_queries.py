"""Evaluation, split and ring-candidate queries."""

from pyspark.sql import functions as F

from verdigris.constants import ACTIONS, RING_GRID, RING_TYPES
from verdigris.operators import evaluation as M
from verdigris.operators import rings as K
from verdigris.operators import splits as P
from verdigris.operators.cleansing import numeric_columns
from verdigris.plans.catalog.base_queries import FEATURE_REALS, behavior, pre_orders, rounded, sql_round
from verdigris.plans.catalog.graph_queries import RULE_SQL, _COMM_SQL, edges, flagged, matrix, stored_features
from verdigris.plans.catalog.prelude import PRELUDE
from verdigris.plans.catalog.registry import query
from verdigris.session import materialize

PRELUDE["preds"] = """
SELECT *, CAST(proba_A >= 0.6 AS INTEGER) AS pred_A, CAST(proba_B >= 0.6 AS INTEGER) AS pred_B,
  CAST(proba_A + proba_B >= 1.2 AS INTEGER) AS pred_baseline FROM fx_scores"""
PRELUDE["melted"] = """
SELECT account_id, 'model_A' AS model, true_label AS label, proba_A AS score FROM fx_scores
UNION ALL SELECT account_id, 'model_B', true_label, proba_B FROM fx_scores"""
PRELUDE["topk"] = """
SELECT model, k, score AS prob_cutoff, tp, k - tp AS fp, p - tp AS fn, tp / k::DOUBLE AS precision, tp / p::DOUBLE AS recall,
  2.0::DOUBLE * tp / (k + p) AS f1, CAST((k - tp) * 2000 + (p - tp) * 15000 AS DOUBLE) AS cost
FROM (SELECT model, score, row_number() OVER w AS k, CAST(sum(label) OVER w AS BIGINT) AS tp, sum(label) OVER (PARTITION BY model)::BIGINT AS p
  FROM melted WINDOW w AS (PARTITION BY model ORDER BY score DESC, account_id ROWS UNBOUNDED PRECEDING))"""
PRELUDE["auc"] = """
SELECT model, wins / (p * n::DOUBLE) AS roc_auc, ap / p AS pr_auc FROM (
  SELECT model, (SELECT sum(CASE WHEN x.score > y.score THEN 1.0::DOUBLE WHEN x.score = y.score THEN 0.5::DOUBLE ELSE 0 END)
      FROM melted x JOIN melted y ON x.model = y.model WHERE x.model = g.model AND x.label = 1 AND y.label = 0) AS wins,
    (SELECT sum(pos * tp / (tp + fp)::DOUBLE) FROM (
      SELECT score, sum(label) AS pos, sum(sum(label)) OVER (ORDER BY score DESC) AS tp,
        sum(sum(1 - label)) OVER (ORDER BY score DESC) AS fp FROM melted x WHERE x.model = g.model GROUP BY score)) AS ap,
    sum(label) AS p, sum(1 - label) AS n
  FROM melted g GROUP BY model)"""

MODELS = {"model_A": "proba_A", "model_B": "proba_B"}


def predictions(d):
    s = d.scores
    return s.withColumns(
        {
            "pred_A": (F.col("proba_A") >= 0.6).cast("int"),
            "pred_B": (F.col("proba_B") >= 0.6).cast("int"),
            "pred_baseline": (F.col("proba_A") + F.col("proba_B") >= 1.2).cast("int"),
        }
    )


def melted(d):
    return M.melt_scores(d.scores, "true_label", MODELS, keep=("account_id",))


_CONF = """count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn"""
_CONF_SQL = f"""
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
  (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy, CAST(fp * 2000 + fn * 15000 AS DOUBLE) AS cost
FROM (SELECT model, {_CONF} FROM (
  SELECT 'model_A' AS model, true_label = 1 AS y, pred_A = 1 AS p FROM preds
  UNION ALL SELECT 'model_B', true_label = 1, pred_B = 1 FROM preds
  UNION ALL SELECT 'baseline', true_label = 1, pred_baseline = 1 FROM preds) GROUP BY 1)"""
RATES = ["precision", "recall", "f1", "accuracy"]


def model_confusion(d):
    long = M.melt_scores(predictions(d), "true_label", {"model_A": "pred_A", "model_B": "pred_B", "baseline": "pred_baseline"})
    return M.confusion(long, "label", "score", ["model"])


@query("m1_confusion", f"SELECT model, tp, fp, tn, fn, {sql_round(*RATES)}, cost FROM ({_CONF_SQL})")
def m1(d):
    return rounded(model_confusion(d), RATES)


@query("m2_roc_auc", "SELECT model, round(roc_auc, 9) AS roc_auc FROM auc")
def m2(d):
    return rounded(M.auc_metrics(melted(d), ["model"]).select("model", "roc_auc"), ["roc_auc"])


@query("m3_pr_auc", "SELECT model, round(pr_auc, 9) AS pr_auc FROM auc")
def m3(d):
    return rounded(M.auc_metrics(melted(d), ["model"]).select("model", "pr_auc"), ["pr_auc"])


_GRID_SQL = """
SELECT model, i, thr, CAST(sum(CASE WHEN score >= thr AND label = 0 THEN 2000 WHEN score < thr AND label = 1 THEN 15000 ELSE 0 END) AS DOUBLE) AS cost
FROM melted JOIN (SELECT i, 0.01::DOUBLE + i::DOUBLE * 0.98::DOUBLE / {last}::DOUBLE AS thr FROM range({n}) t(i)) ON true GROUP BY 1, 2, 3"""


@query("m4_cost_threshold", f"""
SELECT model, round(arg_min(thr, cost * 1000 + i), 9) AS threshold, min(cost) AS cost FROM ({_GRID_SQL.format(n=199, last=198)}) GROUP BY 1""")
def m4(d):
    return rounded(M.best_threshold(melted(d), ["model"]), ["threshold"])


@query("m4b_threshold_costs", f"SELECT model, i, round(thr, 9) AS threshold, cost FROM ({_GRID_SQL.format(n=197, last=196)})")
def m4b(d):
    grid = M.threshold_costs(melted(d), ["model"], RING_GRID).select("model", F.col("i").cast("bigint").alias("i"), "threshold", "cost")
    return rounded(grid, ["threshold"])


@query("m5_topk_curves", "SELECT model, k, round(precision, 9) AS precision, round(recall, 9) AS recall, round(cost, 2) AS cost FROM topk")
def m5(d):
    c = M.top_k_curve(melted(d), ["model"])
    return rounded(c.select("model", "k", "precision", "recall", F.round("cost", 2).alias("cost")), ["precision", "recall"])


@query("m6_operating_point", """
SELECT model, k, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, cost, round(prob_cutoff, 9) AS prob_cutoff
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY cost, k) AS rn FROM topk WHERE recall >= 0.6) WHERE rn = 1""")
def m6(d):
    return rounded(M.operating_point(M.top_k_curve(melted(d), ["model"]), ["model"]), ["precision", "recall", "f1", "prob_cutoff"])


@query("m7_evaluate_topk", """
SELECT model, k, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, cost,
  round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM topk JOIN auc USING (model) WHERE k = 100""")
def m7(d):
    return rounded(M.evaluate_top_k(melted(d), 100, ["model"]), ["precision", "recall", "f1", "roc_auc", "pr_auc"])


@query("m8_curve_points", """
SELECT model, round(score, 9) AS score, round(fp / n::DOUBLE, 9) AS fpr, round(tp / p::DOUBLE, 9) AS tpr, round(tp / (tp + fp)::DOUBLE, 9) AS precision
FROM (SELECT model, score, sum(sum(label)) OVER w AS tp, sum(sum(1 - label)) OVER w AS fp FROM melted GROUP BY model, score
  WINDOW w AS (PARTITION BY model ORDER BY score DESC))
JOIN (SELECT model, sum(label) AS p, sum(1 - label) AS n FROM melted GROUP BY 1) USING (model)""")
def m8(d):
    return rounded(M.curve_points(melted(d), ["model"]), ["score", "fpr", "tpr", "precision"])


@query("m9_score_histogram", """
WITH s AS (SELECT model, label, min(score) AS lo, (max(score) - min(score)) / 50.0::DOUBLE AS w, count(*) AS total FROM melted GROUP BY 1, 2),
b AS (SELECT model, label, least(floor((score - lo) / w), 49)::INTEGER AS bin, count(*) AS n FROM melted JOIN s USING (model, label) GROUP BY 1, 2, 3)
SELECT s.model, s.label, CAST(t.i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * w), 9) AS density
FROM s JOIN range(50) t(i) ON true LEFT JOIN b ON b.model = s.model AND b.label = s.label AND b.bin = t.i""")
def m9(d):
    return rounded(M.score_histogram(melted(d), ["model", "label"]), ["density"])


AUDITED = [
    "total_orders", "distinct_devices", "distinct_addresses", "distinct_phones", "distinct_payment_instruments",
    "total_delivered_orders", "total_failed_orders", "total_pending_orders", "distinct_coupon_count",
    "rare_coupon_count", "total_returns", "total_refunds", "total_disputes", "total_amount", "coupon_usage_rate",
    "max_discount_ratio", "return_rate", "refund_rate", "dispute_rate", "account_creation_burst_score",
]


def _audit_sql(table, columns):
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce(f.{c}, 0)::DOUBLE AS v, true_ring_member AS y FROM fx_truth LEFT JOIN {table} f USING (account_id)"
        for c in columns
    )
    return f"""
SELECT feature, round(greatest(auc, 1 - auc), 6) AS single_feature_auc, unique_values FROM (
  SELECT feature, count(DISTINCT v) AS unique_values,
    (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y))::DOUBLE AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS r FROM ({long}))
  GROUP BY 1) WHERE unique_values >= 2"""


def _audited_matrix(d):
    # Money and ratio sums are rounded before ranking: float noise would split ties.
    f = stored_features(d).select("account_id", *AUDITED)
    return rounded(f, [c for c in AUDITED if c in FEATURE_REALS])


_ROUNDED_FEATURES = f"(SELECT account_id, {', '.join(sql_round(c) if c in FEATURE_REALS else c for c in AUDITED)} FROM features)"
PRELUDE["audit_features"] = _ROUNDED_FEATURES[1:-1]


@query("m10_feature_audit", _audit_sql("audit_features", AUDITED))
def m10(d):
    return M.feature_audit(_audited_matrix(d), d.truth, AUDITED)


PRELUDE["raw_signals"] = f"""
SELECT a.account_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in M.RAW_SIGNALS if c not in ('total_amount', 'avg_order_value'))},
  round(coalesce(total_amount, 0), 6) AS total_amount, round(coalesce(avg_order_value, 0), 6) AS avg_order_value
FROM fx_accounts a LEFT JOIN (
  SELECT account_id, count(order_id) AS total_orders, sum(amount) AS total_amount, avg(amount) AS avg_order_value,
    avg(CAST(return_flag AS DOUBLE)) AS return_rate, avg(CAST(refund_flag AS DOUBLE)) AS refund_rate,
    avg(CAST(dispute_flag AS DOUBLE)) AS dispute_rate, count(DISTINCT device_id) AS distinct_devices,
    count(DISTINCT address_id) AS distinct_addresses, count(DISTINCT phone_hash) AS distinct_phones,
    count(DISTINCT instrument_id) AS distinct_instruments, avg(CAST(coupon_code IS NOT NULL AS DOUBLE)) AS coupon_usage_rate
  FROM pre_orders GROUP BY 1) o USING (account_id)"""
_SIGNAL_RATES = ["return_rate", "refund_rate", "dispute_rate", "coupon_usage_rate"]


def signals(d):
    return rounded(M.raw_signals(d.accounts, pre_orders(d), d.truth), ["total_amount", "avg_order_value"])


@query("m11_raw_signals", f"""
SELECT s.* REPLACE ({sql_round(*_SIGNAL_RATES)}), true_ring_member FROM raw_signals s JOIN fx_truth USING (account_id)""")
def m11(d):
    return rounded(signals(d), _SIGNAL_RATES)


@query("m12_shortcut_gate", f"""
SELECT max(single_feature_auc) AS max_auc, max(single_feature_auc) <= 0.80 AS passed FROM (
  {_audit_sql('raw_signals', M.RAW_SIGNALS)} UNION ALL {_audit_sql('audit_features', AUDITED)})""")
def m12(d):
    raw = M.feature_audit(materialize(signals(d), "signals"), d.truth, M.RAW_SIGNALS)
    return M.shortcut_gate(raw.unionByName(M.feature_audit(_audited_matrix(d), d.truth, AUDITED)))


@query("m13_hard_negative_fps", """
SELECT count(DISTINCT account_id) AS hard_negative_fps FROM preds JOIN fx_truth USING (account_id)
WHERE pred_B = 1 AND NOT true_ring_member AND population_type = 'hard_negative'""")
def m13(d):
    return M.hard_negative_hits(predictions(d), d.truth, "pred_B").agg(F.countDistinct("account_id").alias("hard_negative_fps"))


_PROFILE = ["return_rate", "coupon_usage_rate", "shared_device_count", "shared_address_count"]
_DESC = ["mean", "std", "min", "max", "q25", "q50", "q75"]


@query("m14_hard_negative_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(*) AS count, round(avg({c}::DOUBLE), 9) AS mean, round(stddev_samp({c}::DOUBLE), 9) AS std, round(min({c})::DOUBLE, 9) AS min,
  round(max({c})::DOUBLE, 9) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 9) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 9) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 9) AS q75
FROM features JOIN preds USING (account_id) JOIN fx_truth USING (account_id) WHERE pred_B = 1 AND population_type = 'hard_negative'""" for c in _PROFILE))
def m14(d):
    hits = M.hard_negative_hits(predictions(d), d.truth, "pred_B").select("account_id")
    return rounded(M.describe(stored_features(d).join(hits, "account_id", "left_semi"), _PROFILE), _DESC)


@query("m15_ring_type_recall", f"""
SELECT ring_type, count(*) AS total_ring_members, count(*) FILTER (pred_A = 1) AS "tp_A", count(*) FILTER (pred_B = 1) AS "tp_B",
  round(count(*) FILTER (pred_A = 1) / count(*)::DOUBLE, 9) AS "recall_A", round(count(*) FILTER (pred_B = 1) / count(*)::DOUBLE, 9) AS "recall_B"
FROM preds JOIN fx_truth USING (account_id) WHERE true_ring_member GROUP BY 1
UNION ALL SELECT t, 0, 0, 0, 0, 0 FROM (SELECT unnest({RING_TYPES!r}) AS t) WHERE t NOT IN (SELECT ring_type FROM fx_truth WHERE true_ring_member)""")
def m15(d):
    r = M.ring_type_recall(predictions(d), d.truth, {"A": "pred_A", "B": "pred_B"}, RING_TYPES)
    return rounded(r, ["recall_A", "recall_B"])


@query("m15b_false_positives", """
SELECT count(*) FILTER (NOT true_ring_member) AS non_ring_accounts, count(*) FILTER (NOT true_ring_member AND pred_A = 1) AS "fp_A",
  count(*) FILTER (NOT true_ring_member AND pred_B = 1) AS "fp_B", 0::BIGINT AS label_mismatches FROM preds JOIN fx_truth USING (account_id)""")
def m15b(d):
    return M.false_positives(predictions(d), d.truth, {"A": "pred_A", "B": "pred_B"})


@query("m16_label_match", """
SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT account_id FROM fx_truth)) AS n_both,
  (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT account_id FROM fx_truth)) AS predictions_only,
  (SELECT count(*) FROM fx_truth WHERE account_id NOT IN (SELECT o_custkey FROM orders)) AS truth_only""")
def m16(d):
    return M.label_match(d.orders.select("account_id").distinct(), d.truth)


def model_metrics(d):
    areas = M.auc_metrics(melted(d), ["model"]).select("model", "roc_auc", "pr_auc")
    return model_confusion(d).join(areas, "model", "left").fillna(0.0, ["roc_auc", "pr_auc"])


_DELTAS = ["delta_f1", "delta_pr_auc", "delta_roc_auc", "delta_cost", "cost_reduction_pct"]


@query("m17_model_comparison", f"""
WITH m AS (SELECT c.*, coalesce(roc_auc, 0) AS roc_auc, coalesce(pr_auc, 0) AS pr_auc FROM ({_CONF_SQL}) c LEFT JOIN auc USING (model))
SELECT m.model, round(m.f1 - b.f1, 9) AS delta_f1, round(m.pr_auc - b.pr_auc, 9) AS delta_pr_auc, round(m.roc_auc - b.roc_auc, 9) AS delta_roc_auc,
  round(m.cost - b.cost, 6) AS delta_cost, round((b.cost - m.cost) / b.cost * 100, 6) AS cost_reduction_pct,
  m.model = (SELECT model FROM m WHERE model <> 'baseline' ORDER BY f1 DESC, cost LIMIT 1) AS is_best
FROM m JOIN m b ON b.model = 'baseline'""")
def m17(d):
    return rounded(M.compare_models(model_metrics(d), "baseline"), _DELTAS)


@query("m18_metric_normalization", f"""
SELECT model, tp::DOUBLE AS tp, fp::DOUBLE AS fp, tn::DOUBLE AS tn, fn::DOUBLE AS fn, {sql_round('precision', 'recall', 'f1')}, cost FROM ({_CONF_SQL})""")
def m18(d):
    c = model_confusion(d)
    def packed(upper, with_cost):
        names = ["tp", "fp", "tn", "fn", "precision", "recall", "f1"] + (["cost"] if with_cost else [])
        return F.create_map(*[x for n in names for x in (F.lit(n.upper() if upper and len(n) == 2 else n), F.col(n).cast("double"))])

    raw = c.select("model", F.when(F.col("model") == "baseline", packed(False, True)).otherwise(packed(True, False)).alias("m"))
    return rounded(M.normalize_metrics(raw), ["precision", "recall", "f1"])


@query("m19_prediction_merge", """
SELECT account_id, true_label, "proba_A" AS model_A, coalesce((CASE WHEN account_id % 3 = 0 THEN NULL ELSE proba_A END + proba_B) / 2, 0) AS ensemble FROM fx_scores""")
def m19(d):
    base = d.scores.select("account_id", "true_label", "proba_A")
    extra = d.scores.filter(F.col("account_id") % 3 != 0).select(
        "account_id", ((F.col("proba_A") + F.col("proba_B")) / 2).alias("ensemble_proba")
    )
    return M.merge_predictions(
        base, extra, {"model_A": ["proba_A"], "gnn": ["proba_GNN", "gnn_proba"], "ensemble": ["proba_ensemble", "ensemble_proba"]}
    )


# ------------------------------------------------------------------ splits
PRELUDE["split"] = """
SELECT account_id, CASE WHEN p <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM fx_truth JOIN (SELECT abuse_ring_id, row_number() OVER (ORDER BY md5(abuse_ring_id || '|42')) AS p, count(*) OVER () AS n
  FROM (SELECT DISTINCT abuse_ring_id FROM fx_truth WHERE true_ring_member)) USING (abuse_ring_id) WHERE true_ring_member
UNION ALL
SELECT account_id, CASE WHEN p <= n - h THEN 'train' WHEN p <= n - h + (h - ceil(h * 0.5)) THEN 'val' ELSE 'test' END FROM (
  SELECT account_id, row_number() OVER (ORDER BY md5(CAST(account_id AS VARCHAR) || '|42')) AS p, count(*) OVER () AS n,
    ceil(count(*) OVER () * 0.3::DOUBLE) AS h FROM fx_truth WHERE NOT true_ring_member)"""


def split(d):
    return P.ring_aware_split(d.truth)


@query("p1_ring_split", "SELECT account_id, split FROM split")
def p1(d):
    return split(d)


@query("p1b_named_ring_split", """
SELECT account_id, CASE WHEN abuse_ring_id = 'R0' THEN 'val' WHEN abuse_ring_id = 'R1' THEN 'test' ELSE 'train' END AS split
FROM fx_truth WHERE true_ring_member
UNION ALL SELECT account_id, CASE WHEN p <= floor(n * 0.5::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.5::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END FROM (
  SELECT account_id, row_number() OVER (ORDER BY md5(CAST(account_id AS VARCHAR) || '|42')) AS p, count(*) OVER () AS n FROM fx_truth WHERE NOT true_ring_member)""")
def p1b(d):
    return P.named_ring_split(d.truth, {"val": ["R0"], "test": ["R1"]}, unnamed="train")


@query("p2_split_checks", """
SELECT (SELECT count(*) FROM (SELECT account_id FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS accounts_in_two_splits,
  (SELECT count(*) FROM fx_truth) - (SELECT count(DISTINCT account_id) FROM split) AS missing_accounts,
  (SELECT count(*) FROM (SELECT abuse_ring_id FROM fx_truth JOIN split USING (account_id) WHERE true_ring_member GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS rings_cut""")
def p2(d):
    return P.split_violations(materialize(split(d), "split"), d.truth)


_INPUTS = ["orders_last_24h", "evening_order_ratio", "total_orders", "total_disputes", "return_rate", "total_returns", "shared_ip_prefix_count"]


@query("p3_input_report", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, min({c}) FILTER (split = 'train') = max({c}) FILTER (split = 'train') AS constant_in_train,
  count(*) FILTER ({c} IS NULL) AS null_values, 0::BIGINT AS not_finite_values FROM features JOIN split USING (account_id)""" for c in _INPUTS))
def p3(d):
    return P.input_report(stored_features(d).select("account_id", *_INPUTS), split(d))


# ------------------------------------------------------------------ ring candidates
PRELUDE["kedges"] = """
SELECT * FROM edges WHERE weight >= 0.7 AND account_id_1 IN (SELECT account_id FROM fx_scores WHERE proba_A >= 0.7)
  AND account_id_2 IN (SELECT account_id FROM fx_scores WHERE proba_A >= 0.7)"""
PRELUDE["kmembers"] = """
WITH RECURSIVE lab(v, l, n) AS (
  SELECT v, v, 0 FROM (SELECT account_id_1 AS v FROM kedges UNION SELECT account_id_2 FROM kedges)
  UNION ALL
  SELECT v, min(l), min(n) + 1 FROM (
    SELECT v, l, n FROM lab UNION ALL SELECT e.account_id_2, a.l, a.n FROM lab a JOIN kedges e ON e.account_id_1 = a.v
    UNION ALL SELECT e.account_id_1, a.l, a.n FROM lab a JOIN kedges e ON e.account_id_2 = a.v)
  WHERE n < 40 GROUP BY v)
SELECT printf('RING-C%04d', dense_rank() OVER (ORDER BY l)) AS candidate_id, v AS account_id
FROM (SELECT v, min(l) AS l FROM lab GROUP BY 1)"""
PRELUDE["kstats"] = """
SELECT candidate_id, count(*) AS member_count, avg(proba_A) AS mean_account_risk, median(proba_A) AS median_account_risk, max(proba_A) AS max_account_risk,
  min(proba_A) AS min_account_risk, stddev_pop(proba_A) AS std_account_risk, quantile_cont(proba_A, 0.9) AS p90_account_risk
FROM kmembers JOIN fx_scores USING (account_id) GROUP BY 1"""
PRELUDE["kinside"] = """
SELECT m.candidate_id, e.* FROM edges e JOIN kmembers m ON m.account_id = e.account_id_1
JOIN kmembers n ON n.account_id = e.account_id_2 AND n.candidate_id = m.candidate_id"""
PRELUDE["kstrongest"] = """
SELECT candidate_id, edge_type AS strongest_edge_type, weight AS strongest_edge_weight, account_id_1 AS strongest_source, account_id_2 AS strongest_target,
  CASE edge_type WHEN 'shares_device' THEN 'shared device' WHEN 'shares_phone' THEN 'shared phone' WHEN 'shares_payment_instrument' THEN 'shared payment instrument'
    WHEN 'shares_address' THEN 'shared address' WHEN 'shares_ip_prefix' THEN 'shared IP prefix' ELSE 'shared coupon' END AS strongest_label
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY weight DESC, account_id_1, account_id_2) AS rn FROM kinside) WHERE rn = 1"""
_ED = {"internal_edge_count": "coalesce(c, 0)", "internal_edge_density": "round(coalesce(c, 0) / (n * (n - 1) / 2.0::DOUBLE), 9)",
       "mean_edge_weight": "round(coalesce(mw, 0), 9)", "max_edge_weight": "coalesce(xw, 0)"}
PRELUDE["kedge_stats"] = f"""
SELECT s.candidate_id, {', '.join(f'{e} AS {n}' for n, e in _ED.items())}, {', '.join(f'coalesce(x_{t}, 0) AS {n}' for t, n in K.EDGE_COUNT_NAMES.items())}
FROM (SELECT candidate_id, count(*) AS n FROM kmembers GROUP BY 1) s LEFT JOIN (
  SELECT candidate_id, count(*) AS c, avg(weight) AS mw, max(weight) AS xw, {', '.join(f"count(*) FILTER (edge_type = '{t}') AS x_{t}" for t in K.EDGE_COUNT_NAMES)}
  FROM kinside WHERE weight >= 0.7 GROUP BY 1) e USING (candidate_id)"""
PRELUDE["kpositive"] = """
SELECT candidate_id, abuse_ring_id, count(*) AS n_members FROM kmembers JOIN fx_truth USING (account_id) WHERE true_ring_member
GROUP BY 1, 2 HAVING count(*) >= 2"""

STATS = ["mean_account_risk", "median_account_risk", "max_account_risk", "min_account_risk", "std_account_risk", "p90_account_risk"]


def members(d):
    if not hasattr(d, "_members"):
        d._members = materialize(K.candidate_members(K.candidate_edges(d.scores, edges(d), "proba_A")), "members")
    return d._members


@query("k1_candidate_graph", "SELECT account_id_1, account_id_2, edge_type, weight FROM kedges")
def k1(d):
    return K.candidate_edges(d.scores, edges(d), "proba_A")


@query("k2_candidates", "SELECT candidate_id, account_id FROM kmembers")
def k2(d):
    return members(d)


@query("k2b_member_lists", "SELECT candidate_id, 0::INTEGER AS page, string_agg(CAST(account_id AS VARCHAR), ',' ORDER BY account_id) AS member_ids FROM kmembers GROUP BY 1")
def k2b(d):
    return K.member_pages(members(d)).withColumn("member_ids", F.array_join(F.col("member_ids").cast("array<string>"), ","))


@query("k3_score_stats", f"SELECT candidate_id, member_count, {sql_round(*STATS)} FROM kstats")
def k3(d):
    return rounded(K.score_stats(members(d), d.scores, "proba_A"), STATS)


@query("k4_edge_stats", "SELECT * FROM kedge_stats")
def k4(d):
    return rounded(K.edge_stats(members(d), edges(d)), ["internal_edge_density", "mean_edge_weight"])


@query("k5_community_mix", """
SELECT candidate_id, community_id, count(*) AS n_members, count(*) OVER (PARTITION BY candidate_id) AS candidate_community_count
FROM kmembers JOIN fx_communities USING (account_id) GROUP BY 1, 2""")
def k5(d):
    return K.community_mix(members(d), d.communities)


_AGG_SQL = ", ".join(
    f"round({'sum' if how == 'sum' else 'avg'}({c}::DOUBLE), 6) AS ring_{c}_{how}" for c, how in K.MEMBER_AGGREGATES.items()
)
_KMATRIX_SQL = f"""SELECT f.*, coalesce(w, 0) AS shared_edge_weight_sum, community_return_rate, community_refund_rate, community_avg_order_value
FROM features f LEFT JOIN (SELECT src, sum(weight) AS w FROM sym GROUP BY 1) g ON g.src = f.account_id JOIN ({_COMM_SQL}) c USING (account_id)"""


@query("k6_member_aggregates", f"SELECT candidate_id, {_AGG_SQL} FROM kmembers JOIN ({_KMATRIX_SQL}) USING (account_id) GROUP BY 1")
def k6(d):
    a = K.member_aggregates(members(d), matrix(d))
    return a.withColumns({c: F.round(c, 6) for c in a.columns if c != "candidate_id"})


@query("k7_candidate_labels", """
SELECT c.candidate_id, CAST(p.n IS NOT NULL AS BIGINT) AS is_abuse_ring, coalesce(p.n, 0) AS n_positive_rings, q.abuse_ring_id
FROM (SELECT DISTINCT candidate_id FROM kmembers) c LEFT JOIN (SELECT candidate_id, count(*) AS n FROM kpositive GROUP BY 1) p USING (candidate_id)
LEFT JOIN kpositive q USING (candidate_id)""")
def k7(d):
    pos = K.positive_rings(members(d), d.truth)
    return K.candidate_labels(members(d), pos).join(pos.select("candidate_id", "abuse_ring_id"), "candidate_id", "left")


PRELUDE["kscored"] = """
SELECT candidate_id, round(0.5::DOUBLE * mean_account_risk + 0.5::DOUBLE * max_account_risk, 9) AS ring_proba,
  CAST(round(0.5::DOUBLE * mean_account_risk + 0.5::DOUBLE * max_account_risk, 9) >= 0.8 AS INTEGER) AS ring_pred FROM kstats"""


def scored_candidates(d):
    """A plain blend of member scores stands in for a trained ring score where values are compared."""
    if not hasattr(d, "_scored"):
        s = K.score_stats(members(d), d.scores, "proba_A")
        s = s.withColumn("ring_proba", F.round(0.5 * F.col("mean_account_risk") + 0.5 * F.col("max_account_risk"), 9))
        d._scored = materialize(s.withColumn("ring_pred", (F.col("ring_proba") >= 0.8).cast("int")), "scored")
    return d._scored


PRELUDE["kgroups"] = """
WITH RECURSIVE lab(c, l, n) AS (
  SELECT candidate_id, candidate_id, 0 FROM (SELECT DISTINCT candidate_id FROM kmembers)
  UNION ALL
  SELECT c, min(l), min(n) + 1 FROM (SELECT c, l, n FROM lab UNION ALL
    SELECT q.candidate_id, a.l, a.n FROM lab a JOIN kpositive p ON p.candidate_id = a.c JOIN kpositive q ON q.abuse_ring_id = p.abuse_ring_id)
  WHERE n < 20 GROUP BY c)
SELECT c AS candidate_id, 'c:' || min(l) AS split_group FROM lab GROUP BY 1"""
PRELUDE["ksplit"] = """
SELECT candidate_id, split_group, CASE WHEN p <= nt THEN 'train' WHEN p <= nt + nv THEN 'val' ELSE 'test' END AS split FROM kgroups JOIN (
  SELECT split_group, p, CASE WHEN t0 + v0 >= n THEN greatest(1, n - 2) ELSE t0 END AS nt, CASE WHEN t0 + v0 >= n THEN 1 ELSE v0 END AS nv FROM (
    SELECT split_group, row_number() OVER (ORDER BY md5(split_group || '|42')) AS p, count(*) OVER () AS n,
      greatest(1, round_even(count(*) OVER () * 0.70::DOUBLE, 0)) AS t0, greatest(1, round_even(count(*) OVER () * 0.15::DOUBLE, 0)) AS v0
    FROM (SELECT DISTINCT split_group FROM kgroups))) USING (split_group)"""


def groups(d):
    return P.candidate_groups(members(d).select("candidate_id").distinct(), K.positive_rings(members(d), d.truth))


@query("p4_candidate_split", "SELECT candidate_id, split_group, split FROM ksplit")
def p4(d):
    return P.candidate_split(materialize(groups(d), "groups"))


@query("p5_group_folds", """
SELECT account_id, CAST(p % 5 AS INTEGER) AS fold FROM (SELECT account_id, CASE WHEN true_ring_member THEN abuse_ring_id ELSE 'a:' || CAST(account_id AS VARCHAR) END AS g FROM fx_truth)
JOIN (SELECT g, row_number() OVER (ORDER BY n DESC, md5(g || '|42'), g) AS p FROM (
  SELECT CASE WHEN true_ring_member THEN abuse_ring_id ELSE 'a:' || CAST(account_id AS VARCHAR) END AS g, count(*) AS n FROM fx_truth GROUP BY 1)) USING (g)""")
def p5(d):
    return P.group_folds(d.truth)


@query("k9_ring_coverage", """
SELECT (SELECT count(DISTINCT abuse_ring_id) FROM fx_truth WHERE true_ring_member) AS true_rings, count(DISTINCT abuse_ring_id) AS represented_rings,
  count(DISTINCT abuse_ring_id) FILTER (split = 'test') AS test_rings, count(DISTINCT abuse_ring_id) FILTER (split = 'test' AND ring_pred = 1) AS detected_test_rings,
  round(coalesce(count(DISTINCT abuse_ring_id) FILTER (split = 'test' AND ring_pred = 1) / nullif(count(DISTINCT abuse_ring_id) FILTER (split = 'test'), 0)::DOUBLE, 0), 9) AS ring_recall
FROM kpositive JOIN ksplit USING (candidate_id) JOIN kscored USING (candidate_id)""")
def k9(d):
    sp = P.candidate_split(materialize(groups(d), "groups"))
    scored = scored_candidates(d).select("candidate_id", "ring_pred").join(sp, "candidate_id")
    return rounded(K.ring_coverage(d.truth, K.positive_rings(members(d), d.truth), scored), ["ring_recall"])


@query("k10_input_leakage", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, false AS present, count(*) * 0 AS filled_rows FROM kmembers" for c in K.FORBIDDEN_COLUMNS))
def k10(d):
    """The table a ring model would learn from holds none of the columns it must not have."""
    m = members(d)
    model_table = scored_candidates(d).join(K.edge_stats(m, edges(d)), "candidate_id").join(K.member_aggregates(m, behavior(d)), "candidate_id")
    return K.leaked_inputs(model_table)


_TIER = "CASE WHEN ring_proba >= 0.85 THEN 'CRITICAL' WHEN ring_proba >= 0.65 THEN 'HIGH' WHEN ring_proba >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END"
ACTION_SQL = "CASE {t} " + " ".join(f"WHEN '{t}' THEN '{a[1]}'" for t, a in ACTIONS.items()) + " END"


@query("k11_ring_list", f"""
SELECT candidate_id, ring_proba AS ring_score, ring_pred = 1 AS detected, {_TIER} AS risk_tier, {ACTION_SQL.format(t='(' + _TIER + ')')} AS recommended_action,
  member_count, round(x, 6) AS exposure, round(mean_account_risk, 9) AS mean_account_risk, round(max_account_risk, 9) AS max_account_risk, internal_edge_count, strongest_edge_type, strongest_edge_weight
FROM kscored JOIN kstats USING (candidate_id) JOIN kedge_stats USING (candidate_id) JOIN kstrongest USING (candidate_id)
JOIN (SELECT candidate_id, sum(total_refund_amount) AS x FROM kmembers JOIN behavior USING (account_id) GROUP BY 1) USING (candidate_id)
WHERE ring_pred = 1 ORDER BY ring_proba DESC, candidate_id LIMIT 25""")
def k11(d):
    m = members(d)
    table = (
        scored_candidates(d)
        .join(K.edge_stats(m, edges(d)), "candidate_id")
        .join(K.member_aggregates(m, behavior(d)), "candidate_id")
    )
    out = K.list_rings(table, K.strongest_internal(m, edges(d)), limit=25, detected_only=True)
    return rounded(out, ["exposure", "mean_account_risk", "max_account_risk"])


@query("k12_ring_detail", """
SELECT candidate_id, account_id, round(proba_A, 9) AS account_risk, row_number() OVER (PARTITION BY candidate_id ORDER BY proba_A DESC, account_id) AS rank_in_ring,
  s.strongest_edge_type, s.strongest_edge_weight, s.strongest_source, s.strongest_target, s.strongest_label,
  c.* EXCLUDE (candidate_id)
FROM kmembers JOIN fx_scores USING (account_id) JOIN kstrongest s USING (candidate_id)
JOIN (SELECT candidate_id, """ + ", ".join(f"count(*) FILTER (edge_type = '{t}') AS n_{t}" for t in K.EDGE_WEIGHTS) + """ FROM kinside GROUP BY 1) c USING (candidate_id)""")
def k12(d):
    m = members(d)
    out = K.ranked_members(m, d.scores, "proba_A").join(K.strongest_internal(m, edges(d)), "candidate_id")
    return rounded(out.join(K.ring_edge_counts(m, edges(d)), "candidate_id"), ["account_risk"])
