"""Shared SQL table definitions for the checks, written from the semantics, not from the jobs.

Names are in dependency order. All of it is plain DuckDB SQL over the given tables.
"""

from verdigris.constants import EVIDENCE_FIELDS, RING_TYPES

CUT = "TIMESTAMP '2000-01-01 00:00:00'"

_evidence = ",\n".join(
    f"(order_id // {11 * 2**i}) % 2 = 0 AS {name}" for i, name in enumerate(EVIDENCE_FIELDS)
)
_ring_types = ", ".join(f"'{t}'" for t in RING_TYPES)

PRELUDE: dict[str, str] = {}

PRELUDE["fx_accounts"] = """
SELECT c_custkey AS account_id,
  TIMESTAMP '1994-12-01 00:00:00' + to_hours(CAST((c_custkey * 37) % 720
    + CASE WHEN c_custkey % 50 = 49 THEN 60000 ELSE 0 END AS INTEGER)) AS account_created_at,
  ['regular', 'new', 'guest'][CAST(c_custkey % 3 AS INTEGER) + 1] AS customer_type
FROM customer"""

PRELUDE["fx_lines"] = """
SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_ret,
  min(l_partkey) AS min_part, max(l_partkey) AS max_part, min(l_suppkey) AS min_supp,
  max(l_suppkey) AS max_supp, avg(l_discount) AS avg_disc
FROM lineitem GROUP BY 1"""

PRELUDE["fx_o1"] = """
SELECT o_orderkey AS order_id, o_custkey AS account_id, min_part AS device_id,
  min_supp * 40 + o_custkey % 40 AS address_id, CAST(max_part AS VARCHAR) AS phone_hash,
  max_supp * 20 + o_custkey % 20 AS instrument_id, o_totalprice AS amount,
  o_totalprice * avg_disc AS discount_amount,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
    ELSE 'C' || CAST(((o_orderkey % 997) * (o_orderkey % 997)) // 500 AS VARCHAR) END AS coupon_code,
  o_orderpriority AS category, o_orderdate AS order_timestamp,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' ELSE 'failed' END AS delivery_status,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(1 + o_orderkey % 5 AS INTEGER)) END AS delivery_timestamp,
  coalesce(o_orderstatus = 'F' AND 2 * n_ret >= n_lines, false) AS return_flag,
  o_orderstatus = 'F' AND o_orderkey % 11 = 0 AS dispute_flag
FROM orders LEFT JOIN fx_lines ON o_orderkey = l_orderkey"""

PRELUDE["fx_orders"] = """
SELECT *, delivery_status = 'failed' AS rto_flag,
  CASE WHEN return_flag THEN delivery_timestamp + to_days(CAST(1 + order_id % 7 AS INTEGER)) END AS return_timestamp,
  CASE WHEN return_flag THEN CAST(24 * (1 + order_id % 7) AS DOUBLE) END AS return_lag_hours,
  CASE WHEN return_flag THEN 'RC' || CAST(order_id % 4 AS VARCHAR) END AS return_reason_code,
  return_flag AND order_id % 3 <> 0 AS refund_flag,
  CASE WHEN dispute_flag THEN delivery_timestamp + to_days(5) END AS dispute_created_at,
  CASE WHEN dispute_flag THEN 'D' || CAST(order_id % 5 AS VARCHAR) END AS dispute_reason_code,
  CASE WHEN return_flag AND order_id % 3 <> 0
    THEN delivery_timestamp + to_days(CAST(3 + order_id % 7 AS INTEGER)) END AS refund_timestamp,
  CASE WHEN return_flag AND order_id % 3 <> 0 THEN amount END AS refund_amount
FROM fx_o1"""

PRELUDE["fx_refunds"] = """
SELECT order_id AS refund_id, order_id, account_id, refund_timestamp, refund_amount
FROM fx_orders WHERE refund_flag"""

PRELUDE["fx_disputes"] = f"""
SELECT order_id AS dispute_id, order_id, account_id, dispute_created_at, dispute_reason_code,
  dispute_created_at + to_days(7) AS respond_by, {_evidence}
FROM fx_orders WHERE dispute_flag"""

PRELUDE["fx_devices"] = """
SELECT p_partkey AS device_id, p_brand || '-' || CAST(p_size AS VARCHAR) AS ip_prefix,
  TIMESTAMP '1994-11-01 00:00:00' + to_days(CAST(p_partkey % 2200 AS INTEGER)) AS first_seen_at
FROM part"""

PRELUDE["fx_truth"] = f"""
SELECT c_custkey AS account_id,
  CASE WHEN c_custkey % 20 = 0 THEN 'R' || CAST(c_custkey // 100 AS VARCHAR) END AS abuse_ring_id,
  c_custkey % 20 = 0 AS true_ring_member,
  CASE WHEN c_custkey % 20 = 0 THEN [{_ring_types}][CAST((c_custkey // 100) % 4 AS INTEGER) + 1] END AS ring_type,
  CASE WHEN c_custkey % 20 = 0 THEN 'ring' WHEN c_custkey % 20 <= 3 THEN 'hard_negative' ELSE 'normal' END AS population_type
FROM customer"""

PRELUDE["fx_scores"] = """
SELECT c_custkey AS account_id, CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END AS true_label,
  CAST((c_custkey * 7919) % 701 + CASE WHEN c_custkey % 20 = 0 THEN 300 ELSE 150 END AS DOUBLE) / CAST(1001 AS DOUBLE) AS proba_A,
  CAST((c_custkey * 104729) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS proba_B
FROM customer"""

PRELUDE["fx_communities"] = "SELECT c_custkey AS account_id, c_custkey // 7 AS community_id FROM customer"

PRELUDE["fx_payments"] = """
SELECT event_id AS row_number,
  CASE WHEN event_id % 41 <> 0 THEN 'pay_' || CAST(event_id AS VARCHAR) END AS id,
  'payment' AS entity, CASE WHEN event_id % 43 = 0 THEN -value ELSE value END AS amount,
  CASE WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 53 = 0 THEN '' ELSE 'INR' END AS currency,
  CASE WHEN event_type <> 'error' THEN event_type END AS status,
  ['card', 'upi', 'netbanking', 'wallet'][CAST(event_id % 4 AS INTEGER) + 1] AS method,
  'order_' || CAST(event_id AS VARCHAR) AS order_id,
  'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
  '+9198' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS contact
FROM events"""

PRELUDE["fx_audit"] = """
SELECT event_id, ts AS "timestamp", user_id AS account_id, event_id % 100 + 1 AS rank,
  CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(event_id % 1000 AS VARCHAR) END AS proba,
  CASE WHEN event_id % 100 < 10 THEN 'CRITICAL' WHEN event_id % 100 < 25 THEN 'HIGH'
    WHEN event_id % 100 < 65 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  CASE event_type WHEN 'view' THEN 'yes' WHEN 'click' THEN '1' WHEN 'error' THEN NULL ELSE 'no' END AS top_k_flag,
  CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 100 < 10 THEN 'Soft-hold refund pending human approval'
    WHEN event_id % 100 < 65 THEN 'Route to human investigation/review'
    ELSE 'Monitor — no immediate refund action' END AS action_recommended,
  CASE WHEN event_id % 3 = 0 THEN 'Require step-up verification before processing refund' END AS recommended_action,
  CASE WHEN event_type = 'error' THEN 'tool failed' END AS error,
  CASE WHEN event_type = 'view' THEN 'deterministic' END AS investigation_source,
  CASE WHEN event_type = 'click' THEN props END AS summary
FROM events"""

PRELUDE["fx_addresses"] = """
SELECT k AS address_id, CAST(1 + k % 97 AS VARCHAR) || ', ' || p_name || ' Road, Sector '
    || CAST(1 + k % 60 AS VARCHAR) || ', ' || city || ', ' || state || ' ' || pincode AS canonical_address,
  city, pincode, p_name, state
FROM (SELECT c_custkey AS k,
    ['Bengaluru', 'Mumbai', 'Chennai', 'Kolkata', 'Pune'][c_nationkey % 5 + 1] AS city,
    ['Karnataka', 'Maharashtra', 'Tamil Nadu', 'West Bengal', 'Maharashtra'][c_nationkey % 5 + 1] AS state,
    CAST(560000 + c_custkey % 200 AS VARCHAR) AS pincode FROM customer) c
JOIN part ON p_partkey = k % (SELECT count(*) FROM part)"""

PRELUDE["fx_address_queries"] = """
SELECT address_id AS query_id, CASE address_id % 4 WHEN 0 THEN canonical_address
  WHEN 1 THEN lower(canonical_address)
  WHEN 2 THEN regexp_replace(canonical_address, ' [0-9]{6}$', '')
  ELSE replace(canonical_address, 'Road', 'Rd') END AS raw_address
FROM fx_addresses"""

# --- state at the cutoff -------------------------------------------------------------
PRELUDE["pre_orders"] = f"""
SELECT *, CASE WHEN delivery_status = 'failed' THEN 'failed' WHEN delivery_timestamp <= {CUT}
  THEN 'delivered' ELSE 'pending' END AS status_at_cut
FROM fx_orders WHERE order_timestamp <= {CUT}"""
PRELUDE["pre_refunds"] = f"SELECT * FROM fx_refunds WHERE refund_timestamp <= {CUT}"
PRELUDE["pre_disputes"] = f"SELECT * FROM fx_disputes WHERE dispute_created_at <= {CUT}"
PRELUDE["pre_devices"] = f"SELECT * FROM fx_devices WHERE first_seen_at <= {CUT}"

# --- behavior ------------------------------------------------------------------------
PRELUDE["rare_counts"] = """
SELECT account_id, CAST(count(*) AS BIGINT) AS rare_coupon_count FROM pre_orders
WHERE coupon_code IN (SELECT coupon_code FROM pre_orders WHERE coupon_code IS NOT NULL
                      GROUP BY 1 HAVING count(*) < 10)
GROUP BY 1"""

PRELUDE["ord_agg"] = f"""
SELECT account_id, count(order_id) AS total_orders, sum(amount) AS total_amount,
  avg(amount) AS avg_order_value, count(DISTINCT device_id) AS distinct_devices,
  count(DISTINCT address_id) AS distinct_addresses, count(DISTINCT phone_hash) AS distinct_phones,
  count(DISTINCT instrument_id) AS distinct_payment_instruments,
  count(*) FILTER (status_at_cut = 'delivered') AS total_delivered_orders,
  count(*) FILTER (status_at_cut = 'failed') AS total_failed_orders,
  count(*) FILTER (status_at_cut = 'pending') AS total_pending_orders,
  avg(CASE WHEN trim(coupon_code) <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coupon_usage_rate,
  avg(CASE WHEN amount > 0 THEN coalesce(discount_amount / amount, NULL) ELSE 0 END) AS discount_dependency_score,
  count(DISTINCT coupon_code) AS distinct_coupon_count,
  max(CASE WHEN amount > 0 THEN discount_amount / amount ELSE 0 END) AS max_discount_ratio,
  count(*) FILTER (return_flag AND return_timestamp <= {CUT}) AS total_returns,
  avg(return_lag_hours) FILTER (return_flag AND return_timestamp <= {CUT}) AS avg_return_lag_hours
FROM pre_orders GROUP BY 1"""

PRELUDE["behavior"] = """
SELECT a.account_id, a.account_created_at,
  coalesce(total_orders, 0) AS total_orders, coalesce(total_amount, 0) AS total_amount,
  coalesce(avg_order_value, 0) AS avg_order_value, coalesce(distinct_devices, 0) AS distinct_devices,
  coalesce(distinct_addresses, 0) AS distinct_addresses, coalesce(distinct_phones, 0) AS distinct_phones,
  coalesce(distinct_payment_instruments, 0) AS distinct_payment_instruments,
  coalesce(total_delivered_orders, 0) AS total_delivered_orders,
  coalesce(total_failed_orders, 0) AS total_failed_orders,
  coalesce(total_pending_orders, 0) AS total_pending_orders,
  coalesce(coupon_usage_rate, 0) AS coupon_usage_rate,
  coalesce(discount_dependency_score, 0) AS discount_dependency_score,
  coalesce(distinct_coupon_count, 0) AS distinct_coupon_count,
  coalesce(max_discount_ratio, 0) AS max_discount_ratio,
  coalesce(rare_coupon_count, 0) AS rare_coupon_count,
  coalesce(total_returns, 0) AS total_returns, coalesce(avg_return_lag_hours, 0) AS avg_return_lag_hours,
  coalesce(total_refunds, 0) AS total_refunds, coalesce(total_refund_amount, 0) AS total_refund_amount,
  coalesce(total_disputes, 0) AS total_disputes,
  CASE WHEN total_delivered_orders > 0 THEN total_returns / total_delivered_orders::DOUBLE ELSE 0 END AS return_rate,
  CASE WHEN total_orders > 0 THEN coalesce(total_refunds, 0) / total_orders::DOUBLE ELSE 0 END AS refund_rate,
  CASE WHEN total_orders > 0 THEN coalesce(total_disputes, 0) / total_orders::DOUBLE ELSE 0 END AS dispute_rate
FROM fx_accounts a LEFT JOIN ord_agg USING (account_id) LEFT JOIN rare_counts USING (account_id)
LEFT JOIN (SELECT account_id, count(*) AS total_refunds, sum(refund_amount) AS total_refund_amount
           FROM pre_refunds GROUP BY 1) r USING (account_id)
LEFT JOIN (SELECT account_id, count(*) AS total_disputes FROM pre_disputes GROUP BY 1) d USING (account_id)"""

# --- time ----------------------------------------------------------------------------
PRELUDE["temporal"] = f"""
SELECT b.account_id,
  greatest((epoch_us({CUT}) - epoch_us(b.account_created_at)) / 86400000000.0::DOUBLE, 0) AS account_age_days,
  coalesce(o24, 0) AS orders_last_24h, coalesce(o7, 0) AS orders_last_7d, coalesce(o30, 0) AS orders_last_30d,
  coalesce(r24, 0) AS refunds_last_24h, coalesce(r7, 0) AS refunds_last_7d, coalesce(r30, 0) AS refunds_last_30d,
  CASE WHEN o30 > 0 THEN ret30 / o30::DOUBLE ELSE 0 END AS return_rate_last_30d,
  coalesce(life, 0) AS account_lifetime_days, coalesce(gap, 0) AS avg_order_gap_days,
  coalesce(o7, 0) / greatest(b.total_orders, 1)::DOUBLE AS recent_activity_ratio,
  coalesce(evening, 0) AS evening_order_ratio,
  coalesce(o24, 0) / greatest(coalesce(o30, 0) / 30.0::DOUBLE, 1) AS transaction_burst_score,
  coalesce(r24, 0) / greatest(coalesce(r30, 0) / 30.0::DOUBLE, 1) AS refund_burst_score,
  (SELECT count(*) FROM fx_accounts x WHERE x.account_id <> b.account_id AND b.account_created_at <= {CUT}
     AND x.account_created_at <= {CUT}
     AND x.account_created_at BETWEEN b.account_created_at - INTERVAL 1 HOUR AND b.account_created_at + INTERVAL 1 HOUR
  ) AS account_creation_burst_score
FROM behavior b
LEFT JOIN (SELECT account_id,
    count(*) FILTER (order_timestamp > {CUT} - INTERVAL 24 HOUR) AS o24,
    count(*) FILTER (order_timestamp > {CUT} - INTERVAL 7 DAY) AS o7,
    count(*) FILTER (order_timestamp > {CUT} - INTERVAL 30 DAY) AS o30,
    count(*) FILTER (order_timestamp > {CUT} - INTERVAL 30 DAY AND return_flag AND return_timestamp <= {CUT}) AS ret30,
    (epoch_us(max(order_timestamp)) - epoch_us(min(order_timestamp))) / 86400000000.0::DOUBLE AS life,
    avg(CASE WHEN hour(order_timestamp) BETWEEN 18 AND 22 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS evening
  FROM pre_orders GROUP BY 1) o USING (account_id)
LEFT JOIN (SELECT account_id, avg(d / 86400000000.0::DOUBLE) AS gap FROM (
    SELECT account_id, epoch_us(order_timestamp) - epoch_us(lag(order_timestamp) OVER (PARTITION BY account_id ORDER BY order_timestamp)) AS d
    FROM pre_orders) GROUP BY 1) g USING (account_id)
LEFT JOIN (SELECT account_id,
    count(*) FILTER (refund_timestamp > {CUT} - INTERVAL 24 HOUR) AS r24,
    count(*) FILTER (refund_timestamp > {CUT} - INTERVAL 7 DAY) AS r7,
    count(*) FILTER (refund_timestamp > {CUT} - INTERVAL 30 DAY) AS r30
  FROM pre_refunds GROUP BY 1) r USING (account_id)"""

# --- identity ------------------------------------------------------------------------
PRELUDE["links"] = """
SELECT DISTINCT kind, entity, account_id FROM (
  SELECT 'device' AS kind, CAST(device_id AS VARCHAR) AS entity, account_id FROM pre_orders
  UNION ALL SELECT 'address', CAST(address_id AS VARCHAR), account_id FROM pre_orders
  UNION ALL SELECT 'phone', phone_hash, account_id FROM pre_orders
  UNION ALL SELECT 'instrument', CAST(instrument_id AS VARCHAR), account_id FROM pre_orders)
WHERE entity IS NOT NULL"""

PRELUDE["sharers"] = """
SELECT DISTINCT l.kind, l.account_id AS a, r.account_id AS b
FROM links l JOIN links r ON l.kind = r.kind AND l.entity = r.entity AND l.account_id <> r.account_id"""

PRELUDE["e2_pairs"] = """
SELECT DISTINCT x.account_id AS account_id_1, y.account_id AS account_id_2
FROM (SELECT ip_prefix, account_id, order_timestamp AS t FROM pre_orders JOIN pre_devices USING (device_id)) x
JOIN (SELECT ip_prefix, account_id, order_timestamp AS t FROM pre_orders JOIN pre_devices USING (device_id)) y
  ON x.ip_prefix = y.ip_prefix AND x.account_id < y.account_id
  AND abs(epoch_us(x.t) - epoch_us(y.t)) <= 86400000000"""

PRELUDE["identity"] = """
SELECT a.account_id,
  coalesce(pd, 0) AS accounts_per_device, coalesce(pa, 0) AS accounts_per_address,
  coalesce(pp, 0) AS accounts_per_phone, coalesce(pi_, 0) AS accounts_per_instrument,
  coalesce(sd, 0) AS shared_device_count, coalesce(sa, 0) AS shared_address_count,
  coalesce(sp, 0) AS shared_phone_count, coalesce(si, 0) AS shared_instrument_count,
  CAST(coalesce(da, 0) AS BIGINT) AS has_shared_device_and_address, CAST(coalesce(ip, 0) AS BIGINT) AS has_shared_payment_and_phone,
  coalesce(kinds, 0) AS shared_entity_types_count, coalesce(ipn, 0) AS shared_ip_prefix_count
FROM fx_accounts a
LEFT JOIN (SELECT account_id, avg(n) FILTER (kind = 'device') AS pd, avg(n) FILTER (kind = 'address') AS pa,
    avg(n) FILTER (kind = 'phone') AS pp, avg(n) FILTER (kind = 'instrument') AS pi_
  FROM links JOIN (SELECT kind, entity, count(*) AS n FROM links GROUP BY 1, 2) s USING (kind, entity)
  GROUP BY 1) p USING (account_id)
LEFT JOIN (SELECT a AS account_id, count(*) FILTER (kind = 'device') AS sd, count(*) FILTER (kind = 'address') AS sa,
    count(*) FILTER (kind = 'phone') AS sp, count(*) FILTER (kind = 'instrument') AS si,
    count(DISTINCT kind) AS kinds FROM sharers GROUP BY 1) c USING (account_id)
LEFT JOIN (SELECT a AS account_id, max(CASE WHEN d AND ad THEN 1 ELSE 0 END) AS da,
    max(CASE WHEN i AND ph THEN 1 ELSE 0 END) AS ip
  FROM (SELECT a, b, bool_or(kind = 'device') AS d, bool_or(kind = 'address') AS ad,
      bool_or(kind = 'instrument') AS i, bool_or(kind = 'phone') AS ph FROM sharers GROUP BY 1, 2)
  GROUP BY 1) f USING (account_id)
LEFT JOIN (SELECT account_id, count(*) AS ipn FROM (
    SELECT account_id_1 AS account_id FROM e2_pairs UNION ALL SELECT account_id_2 FROM e2_pairs)
  GROUP BY 1) q USING (account_id)"""

PRELUDE["features"] = """
SELECT b.* EXCLUDE (account_created_at), t.* EXCLUDE (account_id), i.* EXCLUDE (account_id)
FROM behavior b JOIN temporal t USING (account_id) JOIN identity i USING (account_id)"""

# --- edges ---------------------------------------------------------------------------
PRELUDE["e1_long"] = """
SELECT * FROM (
  SELECT 'shares_device' AS edge_type, CAST(device_id AS VARCHAR) AS entity, account_id, epoch_us(order_timestamp) AS t FROM pre_orders
  UNION ALL SELECT 'shares_address', CAST(address_id AS VARCHAR), account_id, epoch_us(order_timestamp) FROM pre_orders
  UNION ALL SELECT 'shares_phone', phone_hash, account_id, epoch_us(order_timestamp) FROM pre_orders
  UNION ALL SELECT 'shares_payment_instrument', CAST(instrument_id AS VARCHAR), account_id, epoch_us(order_timestamp) FROM pre_orders)
WHERE entity IS NOT NULL"""

PRELUDE["e1"] = """
SELECT DISTINCT x.account_id AS account_id_1, y.account_id AS account_id_2, x.edge_type
FROM e1_long x JOIN e1_long y ON x.edge_type = y.edge_type AND x.entity = y.entity
  AND x.account_id < y.account_id AND abs(x.t - y.t) <= 604800000000"""

PRELUDE["e3"] = """
SELECT DISTINCT x.account_id AS account_id_1, y.account_id AS account_id_2, 'shares_coupon' AS edge_type
FROM pre_orders x JOIN pre_orders y ON x.coupon_code = y.coupon_code AND x.account_id < y.account_id
WHERE x.coupon_code IN (SELECT coupon_code FROM pre_orders WHERE trim(coupon_code) <> ''
                        GROUP BY 1 HAVING count(*) < 10)"""

PRELUDE["raw_edges"] = """
SELECT account_id_1, account_id_2, edge_type FROM e1
UNION ALL SELECT account_id_1, account_id_2, 'shares_ip_prefix' FROM e2_pairs
UNION ALL SELECT account_id_1, account_id_2, edge_type FROM e3"""

PRELUDE["edge_rank"] = """
SELECT *, CASE edge_type WHEN 'shares_address' THEN 0.7::DOUBLE WHEN 'shares_ip_prefix' THEN 0.3::DOUBLE
    WHEN 'shares_coupon' THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM raw_edges"""

PRELUDE["edges"] = """
SELECT account_id_1, account_id_2, edge_type, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id_1, account_id_2 ORDER BY weight DESC, edge_type) AS rn
  FROM edge_rank) WHERE rn = 1"""

PRELUDE["sym"] = """
SELECT account_id_1 AS src, account_id_2 AS dst, edge_type, weight FROM edges
UNION ALL SELECT account_id_2, account_id_1, edge_type, weight FROM edges"""
