"""Payment intake and data-quality queries."""

from pyspark.sql import functions as F

from verdigris.functions.exprs import mask_contact, mask_email, nonblank, pseudonym
from verdigris.operators import payments as V
from verdigris.operators import quality as Q
from verdigris.plans.catalog.base_queries import pre_orders, rounded, sql_round
from verdigris.plans.catalog.graph_queries import edges, stored_features
from verdigris.plans.catalog.prelude import CUT, PRELUDE
from verdigris.plans.catalog.registry import query
from verdigris.sources.fixtures import CUTOFF

PRELUDE["checked"] = """
SELECT *, id IS NULL AS bad_id, coalesce(amount <= 0, true) AS bad_amount, coalesce(currency = '', true) AS bad_currency, status IS NULL AS bad_status FROM fx_payments"""


@query("v1_payment_validation", """
SELECT row_number, concat_ws(',', CASE WHEN bad_id THEN 'id:MISSING_REQUIRED_FIELD' END, CASE WHEN bad_amount THEN 'amount:INVALID_AMOUNT' END,
  CASE WHEN bad_currency THEN 'currency:MISSING_CURRENCY' END, CASE WHEN bad_status THEN 'status:MISSING_STATUS' END) AS errors,
  NOT (bad_id OR bad_amount OR bad_currency OR bad_status) AS valid FROM checked""")
def v1(d):
    out = V.validate(d.payments)
    text = F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["code"]))
    return out.select("row_number", F.array_join(text, ",").alias("errors"), "valid")


@query("v2_quarantine", """
SELECT row_number, id AS record_id, 'QUARANTINED' AS status, 'HUMAN_REVIEW' AS action, CASE WHEN bad_id THEN 'Payment ID is missing or invalid.' WHEN bad_amount THEN 'Payment amount must be a positive number.'
  WHEN bad_currency THEN 'Currency is missing or invalid.' ELSE 'Payment status is missing or invalid.' END AS quarantine_reason,
  amount, 'u***' || right(split_part(email, '@', 1), 1) || '@example.com' AS email, '***' || right(contact, 4) AS contact FROM checked WHERE bad_id OR bad_amount OR bad_currency OR bad_status""")
def v2(d):
    out = V.quarantined(V.validate(d.payments), "req", "batch")
    return out.select("row_number", "record_id", "status", "action", "quarantine_reason", "original_input.amount", "original_input.email", "original_input.contact")


@query("v2b_processed", "SELECT row_number, id AS record_id, 'PROCESSED' AS status, amount, currency, status AS payment_status, method FROM checked WHERE NOT (bad_id OR bad_amount OR bad_currency OR bad_status)")
def v2b(d):
    return V.processed(V.validate(d.payments), "req", "batch").drop("request_id", "batch_id")


@query("v3_pii_masking", """
SELECT row_number, CASE row_number % 4 WHEN 0 THEN '***' WHEN 1 THEN '**@x' WHEN 2 THEN NULL ELSE 'u***' || right(split_part(email, '@', 1), 1) || '@example.com' END AS email,
  CASE WHEN row_number % 5 = 0 THEN '***' ELSE '***' || right(contact, 4) END AS contact FROM fx_payments""")
def v3(d):
    odd = d.payments.selectExpr(
        "row_number",
        "CASE row_number % 4 WHEN 0 THEN 'no at sign' WHEN 1 THEN 'ab@x' WHEN 2 THEN NULL ELSE email END AS email",
        "CASE WHEN row_number % 5 = 0 THEN '12-a' ELSE contact END AS contact",
    )
    return odd.select("row_number", mask_email("email").alias("email"), mask_contact("contact").alias("contact"))


@query("v4_batch_summary", """
SELECT count(*) AS batch_size, count(*) FILTER (b) AS malformed_rows, count(*) FILTER (b) AS quarantined, count(*) FILTER (NOT b) AS valid_processed, count(*) FILTER (b) AS human_review_routed
FROM (SELECT bad_id OR bad_amount OR bad_currency OR bad_status AS b FROM checked)""")
def v4(d):
    return V.batch_summary(V.validate(d.payments))


@query("v4b_audit_trail", """
WITH s AS (SELECT CAST(count(*) AS VARCHAR) AS n, CAST(count(*) FILTER (bad_id OR bad_amount OR bad_currency OR bad_status) AS VARCHAR) AS b,
  CAST(count(*) FILTER (NOT (bad_id OR bad_amount OR bad_currency OR bad_status)) AS VARCHAR) AS g FROM checked)
SELECT 0::INTEGER AS step, 'Payment batch received' AS event, n || ' payments' AS details FROM s UNION ALL SELECT 1, 'Validation completed', b || ' records failed validation' FROM s
UNION ALL SELECT 2, 'Quarantined', b || ' records' FROM s UNION ALL SELECT 3, 'Human review routed', b || ' records' FROM s UNION ALL SELECT 4, 'Valid rows processed', g || ' records' FROM s""")
def v4b(d):
    return V.audit_trail(V.batch_summary(V.validate(d.payments)))


@query("v5_fault_tagging", """
SELECT row_number, CASE WHEN row_number < 10 THEN ['amount', 'currency', 'status', 'id'][CAST(row_number % 4 AS INTEGER) + 1] END AS fault_field,
  CASE WHEN row_number < 10 AND row_number % 4 = 0 THEN NULL ELSE amount END AS amount, CASE WHEN row_number < 10 AND row_number % 4 = 3 THEN NULL ELSE id END AS id FROM fx_payments""")
def v5(d):
    return V.tag_faults(d.payments, "row_number").select("row_number", "fault_field", "amount", "id")


@query("v6_pseudonyms", "SELECT order_id, substr(sha256('phone_' || phone_hash), 1, 16) AS phone_key, substr(sha256('instrument_' || CAST(instrument_id AS VARCHAR)), 1, 16) AS instrument_key FROM fx_orders")
def v6(d):
    return d.orders.select("order_id", pseudonym("phone_", "phone_hash").alias("phone_key"), pseudonym("instrument_", "instrument_id").alias("instrument_key"))


# ------------------------------------------------------------------ quality
_REQUIRED = ["order_id", "account_id", "device_id", "amount", "order_timestamp", "warehouse_id"]


@query("q1_required_columns", " UNION ALL ".join(
    f"SELECT 'orders' AS table_name, '{c}' AS column_name, {'false' if c == 'warehouse_id' else 'true'} AS present, {'CASE WHEN count(*) < 0 THEN 0 END' if c == 'warehouse_id' else f'count({c})'} AS filled_rows FROM fx_orders" for c in _REQUIRED))
def q1(d):
    return Q.missing_columns({"orders": d.orders}, {"orders": _REQUIRED})


@query("q2_repeated_keys", """
SELECT 'accounts.account_id' AS check_name, count(*) AS violations FROM (SELECT account_id FROM fx_accounts GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'orders.order_id', count(*) FROM (SELECT order_id FROM fx_orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""")
def q2(d):
    return Q.repeated_keys({"accounts": (d.accounts, "account_id"), "orders": (d.orders, "order_id"), "lineitem": (d.raw("lineitem"), "l_orderkey")})


_NOT_NULL = ["order_id", "account_id", "device_id", "address_id", "phone_hash", "instrument_id", "amount", "category", "order_timestamp", "delivery_status"]


@query("q3_null_counts", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM fx_orders" for c in _NOT_NULL))
def q3(d):
    return Q.null_counts(d.orders, _NOT_NULL)


_TIMES = ["order_timestamp", "delivery_timestamp", "return_timestamp"]


@query("q4_time_window", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} < TIMESTAMP '1996-01-01' OR {c} > {CUT}) AS outside FROM fx_orders" for c in _TIMES))
def q4(d):
    return Q.outside_window(d.orders, _TIMES, "1996-01-01 00:00:00", CUTOFF)


@query("q5_domains", """
SELECT 'customer_type' AS column_name, count(*) FILTER (customer_type NOT IN ('regular', 'new')) AS outside FROM fx_accounts""")
def q5(d):
    return Q.outside_domain(d.accounts, {"customer_type": ["regular", "new"]})


@query("q6_orphans", """
SELECT 'orders.account' AS check_name, count(*) AS violations FROM fx_orders WHERE account_id NOT IN (SELECT account_id FROM fx_accounts)
UNION ALL SELECT 'orders.device', count(*) FROM fx_orders WHERE device_id IS NULL OR device_id NOT IN (SELECT device_id FROM fx_devices)
UNION ALL SELECT 'refunds.order', count(*) FROM fx_refunds WHERE order_id NOT IN (SELECT order_id FROM fx_orders)
UNION ALL SELECT 'disputes.order', count(*) FROM fx_disputes WHERE order_id NOT IN (SELECT order_id FROM fx_orders)
UNION ALL SELECT 'orders.refund', count(*) FROM fx_orders WHERE order_id NOT IN (SELECT order_id FROM fx_refunds)""")
def q6(d):
    return Q.orphan_rows([
        ("orders.account", d.orders, "account_id", d.accounts, "account_id"),
        ("orders.device", d.orders, "device_id", d.devices, "device_id"),
        ("refunds.order", d.refunds, "order_id", d.orders, "order_id"),
        ("disputes.order", d.disputes, "order_id", d.orders, "order_id"),
        ("orders.refund", d.orders, "order_id", d.refunds, "order_id"),
    ])


@query("q7_flag_conflicts", """
SELECT 'refund_without_flag' AS check_name, count(*) FILTER (NOT refund_flag) AS violations FROM fx_refunds JOIN fx_orders USING (order_id)
UNION ALL SELECT 'dispute_without_flag', count(*) FILTER (NOT dispute_flag) FROM fx_disputes JOIN fx_orders USING (order_id)
UNION ALL SELECT 'rto_flag_mismatch', count(*) FILTER ((delivery_status = 'failed') <> rto_flag) FROM fx_orders
UNION ALL SELECT 'undelivered_with_time', count(*) FILTER (delivery_status IN ('pending', 'failed') AND delivery_timestamp IS NOT NULL) FROM fx_orders""")
def q7(d):
    return Q.flag_conflicts(d.orders, d.refunds, d.disputes)


@query("q8_time_conflicts", """
SELECT 'order_before_account' AS check_name, count(*) AS violations FROM fx_orders JOIN fx_accounts USING (account_id) WHERE order_timestamp < account_created_at
UNION ALL SELECT 'delivery_before_order', count(*) FROM fx_orders WHERE delivery_status = 'delivered' AND (delivery_timestamp IS NULL OR delivery_timestamp < order_timestamp)
UNION ALL SELECT 'return_before_delivery', count(*) FROM fx_orders WHERE return_flag AND return_timestamp < delivery_timestamp
UNION ALL SELECT 'refund_before_return', count(*) FROM fx_orders WHERE refund_flag AND refund_timestamp < return_timestamp
UNION ALL SELECT 'dispute_before_refund_or_delivery', count(*) FROM fx_disputes d JOIN fx_orders o USING (order_id) WHERE d.dispute_created_at < coalesce(o.refund_timestamp, o.delivery_timestamp)
UNION ALL SELECT 'respond_before_dispute', count(*) FROM fx_disputes WHERE respond_by < dispute_created_at""")
def q8(d):
    return Q.time_conflicts(d.accounts, d.orders, d.disputes)


@query("q9_label_conflicts", """
SELECT 'member_without_ring' AS check_name, count(*) AS violations FROM fx_truth WHERE true_ring_member AND abuse_ring_id IS NULL
UNION ALL SELECT 'hard_negative_member', count(*) FROM fx_truth WHERE true_ring_member AND population_type = 'hard_negative'
UNION ALL SELECT 'member_without_orders', count(*) FROM fx_truth WHERE true_ring_member AND account_id NOT IN (SELECT account_id FROM fx_orders)""")
def q9(d):
    return Q.label_conflicts(d.truth, d.orders)


@query("q10_internal_columns", """
SELECT 'accounts' AS table_name, 0::BIGINT AS internal_columns, 0::BIGINT AS filled_cells, count(*) AS n_rows FROM fx_accounts
UNION ALL SELECT 'orders', 1, count(device_id), count(*) FROM fx_orders""")
def q10(d):
    return Q.internal_columns({"accounts": d.accounts, "orders": d.orders.withColumn("_latent", F.col("device_id"))})


_SHARES = ["delivered_share", "pending_share", "failed_share", "mean_order_value", "return_rate", "refund_rate", "dispute_rate"]


@query("q11_dataset_summary", """
SELECT count(*) AS n_orders, count(DISTINCT account_id) AS n_accounts, round(avg(CAST(delivery_status = 'delivered' AS DOUBLE)), 9) AS delivered_share, round(avg(CAST(delivery_status = 'pending' AS DOUBLE)), 9) AS pending_share,
  round(avg(CAST(delivery_status = 'failed' AS DOUBLE)), 9) AS failed_share, round(avg(amount), 6) AS mean_order_value, round(avg(CAST(return_flag AS DOUBLE)), 9) AS return_rate,
  round(avg(CAST(refund_flag AS DOUBLE)), 9) AS refund_rate, round(avg(CAST(dispute_flag AS DOUBLE)), 9) AS dispute_rate FROM fx_orders""")
def q11(d):
    return rounded(Q.dataset_summary(d.orders), _SHARES)


@query("q11b_category_means", "SELECT category, round(avg(amount), 2) AS mean_amount, count(*) AS n_orders FROM fx_orders GROUP BY 1")
def q11b(d):
    return Q.category_means(d.orders)


_STAMPED = {"orders": ("fx_orders", "order_timestamp"), "refunds": ("fx_refunds", "refund_timestamp"), "disputes": ("fx_disputes", "dispute_created_at"), "devices": ("fx_devices", "first_seen_at")}
PRELUDE["used_rows"] = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, max({c}) FILTER ({c} <= {CUT}) AS max_timestamp_used, count(*) FILTER ({c} <= {CUT}) AS rows_used, count(*) FILTER ({c} > {CUT}) AS rows_after_cutoff FROM {t}"
    for n, (t, c) in _STAMPED.items()
)


def used(d, names):
    frames = {"orders": d.orders, "refunds": d.refunds, "disputes": d.disputes, "devices": d.devices}
    return Q.excluded_rows({n: (frames[n], _STAMPED[n][1]) for n in names}, CUTOFF)


@query("q12_feature_leakage", """
SELECT max(max_timestamp_used) AS max_timestamp_used, CAST(sum(rows_after_cutoff) AS BIGINT) AS rows_excluded, (SELECT count(*) FROM fx_accounts) AS matrix_rows, 0::BIGINT AS missing_values, 0::BIGINT AS forbidden_columns, 'PASSED' AS leakage_check
FROM used_rows WHERE table_name <> 'devices'""")
def q12(d):
    return Q.feature_leakage_report(used(d, ["orders", "refunds", "disputes"]), stored_features(d), CUTOFF).drop("matrix_columns")


@query("q12b_rows_after_cutoff", "SELECT * FROM used_rows")
def q12b(d):
    return used(d, list(_STAMPED))


@query("q13_graph_leakage", """
SELECT max(max_timestamp_used) AS max_timestamp_used, CAST(sum(rows_after_cutoff) AS BIGINT) AS rows_excluded, (SELECT count(*) FROM fx_accounts) AS matrix_rows, 0::BIGINT AS missing_values, 0::BIGINT AS forbidden_columns, 'PASSED' AS leakage_check,
  (SELECT count(*) FROM fx_accounts) AS graph_nodes, (SELECT count(*) FROM edges) AS graph_edges, (SELECT count(*) FROM pre_orders WHERE trim(coupon_code) <> '') AS coupon_rows FROM used_rows WHERE table_name IN ('orders', 'devices')""")
def q13(d):
    coupons = pre_orders(d).filter(nonblank("coupon_code"))
    return Q.graph_leakage_report(used(d, ["orders", "devices"]), stored_features(d), d.accounts, edges(d), coupons, CUTOFF).drop("matrix_columns")


_SUMMARY = ["mean_total_orders", "mean_return_rate", "mean_refund_rate", "mean_dispute_rate", "mean_shared_devices"]


@query("q14_feature_summary", f"""
SELECT n_rows, {sql_round(*_SUMMARY)}, max_shared_devices FROM (SELECT count(*) AS n_rows, avg(total_orders) AS mean_total_orders, avg(return_rate) AS mean_return_rate, avg(refund_rate) AS mean_refund_rate,
  avg(dispute_rate) AS mean_dispute_rate, avg(shared_device_count) AS mean_shared_devices, max(shared_device_count) AS max_shared_devices FROM features)""")
def q14(d):
    return rounded(Q.feature_summary(stored_features(d)), _SUMMARY)
