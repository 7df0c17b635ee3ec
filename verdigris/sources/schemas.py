"""Explicit schemas of the commerce tables."""

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(), "TIMESTAMP": T.TimestampType(), "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "INT": T.IntegerType(), "BIGINT": T.LongType(),
}


def _struct(text: str) -> T.StructType:
    """"name TYPE, ..." without needing a running session."""
    parts = [p.split() for p in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in parts])


ACCOUNTS = _struct("account_id STRING, account_created_at TIMESTAMP, customer_type STRING")
DEVICES = _struct(
    "device_id STRING, os_family STRING, browser_family STRING, ip_prefix STRING,"
    " first_seen_at TIMESTAMP"
)
ADDRESSES = _struct(
    "address_id STRING, canonical_address STRING, city STRING, pincode STRING,"
    " is_drop_address BOOLEAN, first_seen_at TIMESTAMP"
)
PHONES = _struct("phone_hash STRING, first_seen_at TIMESTAMP")
PAYMENT_INSTRUMENTS = _struct(
    "instrument_id STRING, instrument_type STRING, bin_or_vpa_hash STRING,"
    " first_seen_at TIMESTAMP"
)
ORDERS = _struct(
    "order_id STRING, account_id STRING, device_id STRING, address_id STRING,"
    " phone_hash STRING, instrument_id STRING, amount DOUBLE, discount_amount DOUBLE,"
    " coupon_code STRING, category STRING, order_timestamp TIMESTAMP, delivery_status STRING,"
    " delivery_attempts INT, delivery_timestamp TIMESTAMP, rto_flag BOOLEAN,"
    " return_flag BOOLEAN, return_reason_code STRING, return_timestamp TIMESTAMP,"
    " return_lag_hours DOUBLE, refund_flag BOOLEAN, refund_amount DOUBLE,"
    " refund_timestamp TIMESTAMP, dispute_flag BOOLEAN, dispute_created_at TIMESTAMP,"
    " dispute_phase STRING, dispute_reason_code STRING, dispute_reason_category STRING,"
    " evidence_availability STRING"
)
REFUNDS = _struct(
    "refund_id STRING, order_id STRING, account_id STRING, refund_timestamp TIMESTAMP,"
    " refund_amount DOUBLE, refund_reason STRING, refund_status STRING, refund_method STRING"
)
DISPUTES = _struct(
    "dispute_id STRING, order_id STRING, account_id STRING, dispute_created_at TIMESTAMP,"
    " dispute_phase STRING, dispute_reason_code STRING, dispute_reason_category STRING,"
    " respond_by TIMESTAMP, proof_of_service BOOLEAN, explanation_letter BOOLEAN,"
    " refund_confirmation BOOLEAN, access_activity_log BOOLEAN,"
    " refund_cancellation_policy BOOLEAN, terms_and_conditions BOOLEAN"
)
GROUND_TRUTH = _struct(
    "account_id STRING, abuse_ring_id STRING, true_ring_member BOOLEAN, ring_type STRING,"
    " ring_start_time TIMESTAMP, ring_end_time TIMESTAMP"
)
EDGES = _struct("account_id_1 STRING, account_id_2 STRING, edge_type STRING, weight DOUBLE")
COMMUNITIES = _struct("account_id STRING, community_id BIGINT")
AUDIT = _struct(
    "timestamp STRING, account_id STRING, model_version STRING, rank STRING, proba STRING,"
    " risk_tier STRING, recommended_action STRING, action_recommended STRING,"
    " top_k_flag STRING, case_report_generated STRING, investigation_source STRING,"
    " tool_calls STRING, summary STRING, action_source STRING, error STRING,"
    " input_data_hash STRING, threshold_used DOUBLE, feature_snapshot STRING,"
    " evidence_subgraph STRING, human_decision STRING, outcome STRING, error_path STRING"
)

SOURCE_TABLES = {
    "accounts": ACCOUNTS,
    "devices": DEVICES,
    "addresses": ADDRESSES,
    "phones": PHONES,
    "payment_instruments": PAYMENT_INSTRUMENTS,
    "orders": ORDERS,
    "refunds": REFUNDS,
    "disputes": DISPUTES,
}
