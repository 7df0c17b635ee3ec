"""Sources, cleansing, behavior, time and identity queries."""

from pyspark.sql import functions as F

from verdigris.constants import EVIDENCE_FIELDS
from verdigris.functions.exprs import micros, safe_div, truthy
from verdigris.operators import behavior as B
from verdigris.operators import cleansing as C
from verdigris.operators import identity as I
from verdigris.operators import temporal as T
from verdigris.plans.catalog.prelude import CUT
from verdigris.plans.catalog.registry import query
from verdigris.plans.feature_plan import feature_matrix
from verdigris.session import scratch_path
from verdigris.sources import schemas, tables
from verdigris.sources.versioned import VersionedTable
from verdigris.sources.fixtures import CUTOFF


def pre_orders(d):
    return C.known_at(d.stored_orders, "order_timestamp", CUTOFF)


def pre_refunds(d):
    return C.known_at(d.refunds, "refund_timestamp", CUTOFF)


def pre_disputes(d):
    return C.known_at(d.disputes, "dispute_created_at", CUTOFF)


def pre_devices(d):
    return C.known_at(d.devices, "first_seen_at", CUTOFF)


def features(d):
    return feature_matrix(d.accounts, d.stored_orders, d.refunds, d.disputes, d.devices, CUTOFF)


def behavior(d):
    return B.behavior_features(d.accounts, pre_orders(d), pre_refunds(d), pre_disputes(d), CUTOFF)


def timed(d):
    base = B.behavior_features(
        d.accounts, pre_orders(d), pre_refunds(d), pre_disputes(d), CUTOFF,
        T.order_time_aggregates(CUTOFF),
    )
    return T.add_temporal(base, d.accounts, pre_refunds(d), CUTOFF)


def digits(name):
    """Places kept in comparisons: money sums carry more float noise than ratios."""
    return 6 if any(w in name for w in ("amount", "value", "exposure", "cost")) else 9


def rounded(df, columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits(c)) for c in columns})


def sql_round(*names):
    return ", ".join(f"round({n}::DOUBLE, {digits(n)}) AS {n}" for n in names)


# ------------------------------------------------------------------ sources and sinks
def _orders_csv(d):
    path = scratch_path(d.spark, "orders-csv")
    wide = d.orders.withColumns(
        {
            c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
            for c in ("order_timestamp", "delivery_timestamp", "return_timestamp", "refund_timestamp", "dispute_created_at")
        }
    ).withColumns(
        {
            "delivery_attempts": F.lit(1),
            "dispute_phase": F.lit(None).cast("string"),
            "dispute_reason_category": F.lit(None).cast("string"),
            "evidence_availability": F.lit(None).cast("string"),
        }
    )
    tables.write_csv(wide.select(schemas.ORDERS.fieldNames()), path)
    return path


@query("s1_csv_scan", """
SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(account_id AS VARCHAR) AS account_id, amount,
  order_timestamp, delivery_timestamp, return_flag FROM fx_orders""")
def s1(d):
    orders = tables.read_csv(d.spark, _orders_csv(d), schemas.ORDERS)
    return orders.select(
        "order_id", "account_id", "amount", "order_timestamp", "delivery_timestamp", "return_flag"
    )


@query("s2_timestamp_coercion", """
SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', ts) END AS ts FROM events""")
def s2(d):
    text = d.raw("events").select(
        "event_id",
        F.when(F.col("event_id") % 13 == 0, "not a time")
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("ts"),
    )
    return tables.coerce_timestamps(text, ["ts"])


@query("s3_projected_scan", "SELECT c_custkey AS account_id, c_custkey // 7 AS community_id FROM customer")
def s3(d):
    return d.communities.select("account_id", "community_id")


@query("s4_csv_sink", "SELECT account_id, CAST(count(*) AS BIGINT) AS n_orders FROM fx_orders GROUP BY 1")
def s4(d):
    path = scratch_path(d.spark, "report-csv")
    tables.write_csv(d.orders.groupBy("account_id").agg(F.count("*").alias("n_orders")), path)
    return d.spark.read.schema("account_id BIGINT, n_orders BIGINT").csv(path, header=True)


@query("s5_json_metrics", "SELECT count(*) AS n_orders, round(avg(amount), 6) AS avg_amount FROM fx_orders")
def s5(d):
    path = scratch_path(d.spark, "metrics-json")
    report = d.orders.agg(F.count("*").alias("n_orders"), F.round(F.avg("amount"), 6).alias("avg_amount"))
    tables.write_metrics(report, path)
    return tables.read_metrics(d.spark, path, report.schema)


@query("s6_tolerant_read", """
SELECT CAST(account_id AS VARCHAR) AS account_id, community_id FROM fx_communities""")
def s6(d):
    path = scratch_path(d.spark, "communities-csv")
    tables.write_csv(d.communities, path)
    there = tables.read_or_empty(d.spark, path, schemas.COMMUNITIES)
    absent = tables.read_or_empty(d.spark, path + "-absent", schemas.COMMUNITIES)
    return there.unionByName(absent)


@query("s7_required_artifacts", """
SELECT 'absent_table' AS artifact, false AS present, NULL::BIGINT AS n_rows UNION ALL SELECT 'customer', true, count(*) FROM customer
UNION ALL SELECT 'lineitem', true, count(*) FROM lineitem UNION ALL SELECT 'orders', true, count(*) FROM orders""")
def s7(d):
    names = ["customer", "orders", "lineitem", "absent_table"]
    return tables.artifact_report(d.spark, {n: f"{d.folder}/{n}.parquet" for n in names})


@query("s8_append_widening", """
SELECT event_id, account_id, NULL::VARCHAR AS note FROM fx_audit
UNION ALL SELECT event_id, account_id, 'investigated' FROM fx_audit WHERE error IS NOT NULL""")
def s8(d):
    old = d.audit.select("event_id", "account_id")
    new = d.audit.filter("error IS NOT NULL").select("event_id", "account_id", F.lit("investigated").alias("note"))
    table = VersionedTable(d.spark, scratch_path(d.spark, "audit"))
    table.append(old)
    table.append(new)
    return table.read()


@query("s9_truncate_keep_schema", """
SELECT c AS column_name, count(*) AS rows_before, 0::BIGINT AS rows_after FROM fx_audit, (VALUES ('account_id'), ('rank'), ('risk_tier')) AS v(c) GROUP BY 1""")
def s9(d):
    table = VersionedTable(d.spark, scratch_path(d.spark, "audit-empty"))
    table.append(d.audit.select("account_id", "rank", "risk_tier"))
    before = table.read().count()
    table.truncate()
    left = table.read()
    names = F.explode(F.array(*[F.lit(c) for c in left.columns])).alias("column_name")
    return left.agg(F.count("*").alias("rows_after")).select(names, F.lit(before).cast("bigint").alias("rows_before"), "rows_after")


@query("s10_account_lookup", """
SELECT 'order' AS source, order_id AS row_id, account_id FROM fx_orders WHERE account_id IN (SELECT account_id FROM fx_truth WHERE true_ring_member)
UNION ALL SELECT 'refund', refund_id, account_id FROM fx_refunds WHERE account_id IN (SELECT account_id FROM fx_truth WHERE true_ring_member)
UNION ALL SELECT 'dispute', dispute_id, account_id FROM fx_disputes WHERE account_id IN (SELECT account_id FROM fx_truth WHERE true_ring_member)""")
def s10(d):
    wanted = d.truth.filter("true_ring_member")
    parts = [
        tables.rows_for_accounts(df, wanted).select(F.lit(n).alias("source"), F.col(k).alias("row_id"), "account_id")
        for n, df, k in (
            ("order", d.orders, "order_id"), ("refund", d.refunds, "refund_id"), ("dispute", d.disputes, "dispute_id"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ cleansing
@query("f1_cutoff_filter", """
SELECT 'orders' AS table_name, count(*) AS n, max(order_timestamp) AS latest FROM pre_orders
UNION ALL SELECT 'refunds', count(*), max(refund_timestamp) FROM pre_refunds
UNION ALL SELECT 'disputes', count(*), max(dispute_created_at) FROM pre_disputes
UNION ALL SELECT 'devices', count(*), max(first_seen_at) FROM pre_devices
UNION ALL SELECT 'accounts', count(*), max(account_created_at) FROM fx_accounts""")
def f1(d):
    cut = C.filter_tables(
        {"orders": d.orders, "refunds": d.refunds, "disputes": d.disputes, "devices": d.devices, "accounts": d.accounts},
        CUTOFF,
    )
    out = None
    for name, df in cut.items():
        c = C.CUTOFF_COLUMN.get(name, "account_created_at")
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.max(c).alias("latest"))
        out = one if out is None else out.unionByName(one)
    return out


@query("f2_delivery_status", "SELECT order_id, status_at_cut AS status FROM pre_orders")
def f2(d):
    return pre_orders(d).select("order_id", C.status_as_of(CUTOFF).alias("status"))


@query("f3_drop_leakage", "SELECT account_id FROM fx_truth")
def f3(d):
    return C.drop_leakage(d.truth)


@query("f4_finite_fill", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0::DOUBLE WHEN event_id % 7 = 0 THEN 0::DOUBLE
  WHEN event_id % 6 = 0 THEN 0::DOUBLE ELSE round(value, 6) END AS value FROM events""")
def f4(d):
    dirty = d.raw("events").selectExpr(
        "event_id",
        """CASE WHEN event_id % 10 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 7 = 0
           THEN CAST('NaN' AS DOUBLE) WHEN event_id % 6 = 0 THEN NULL ELSE round(value, 6) END AS value""",
    )
    return C.fill_finite(dirty, skip=("event_id",))


@query("f5_matrix_checks", """
SELECT count(*) AS n_rows, count(*) - count(DISTINCT account_id) AS duplicate_accounts, 0::BIGINT AS null_cells,
  count(*) FILTER (return_rate > 0 AND total_delivered_orders = 0) AS rate_without_delivery FROM behavior""")
def f5(d):
    return C.matrix_violations(behavior(d))


@query("f6_numeric_coercion", """
SELECT event_id, coalesce(TRY_CAST(proba AS DOUBLE), 0) AS proba FROM fx_audit""")
def f6(d):
    return C.coerce_numbers(d.audit.select("event_id", "proba"), ["proba"])


@query("f7_truthy_evidence", """
SELECT event_id, CASE WHEN event_type = 'view' THEN true WHEN event_type = 'click' THEN false
  WHEN event_type = 'error' THEN false WHEN event_type = 'signup' THEN true
  ELSE value <> 0 END AS available FROM events""")
def f7(d):
    raw = d.raw("events").selectExpr(
        "event_id",
        """CASE event_type WHEN 'view' THEN ' Yes ' WHEN 'click' THEN 'Missing' WHEN 'error' THEN NULL
           WHEN 'signup' THEN 'on file' ELSE CAST(value AS STRING) END AS raw_value""",
    )
    return raw.select("event_id", truthy("raw_value").alias("available"))


@query("f8_guarded_division", """
SELECT order_id, round(CASE WHEN n_lines > 0 THEN amount / n_lines ELSE 0 END, 6) AS per_line
FROM fx_orders LEFT JOIN (SELECT l_orderkey, n_lines FROM fx_lines) ON order_id = l_orderkey""")
def f8(d):
    lines = d.raw("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    joined = d.raw("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("order_id"),
        F.round(safe_div(F.col("o_totalprice"), F.col("n_lines")), 6).alias("per_line"),
    )


# ------------------------------------------------------------------ behavior
def _behavior_query(name, whole, real):
    cols = ", ".join([*whole, *[sql_round(c) for c in real]])

    @query(name, f"SELECT account_id, {cols} FROM behavior")
    def run(d):
        return rounded(behavior(d).select("account_id", *whole, *real), real)


_behavior_query(
    "b1_order_aggregates",
    ["total_orders", "distinct_devices", "distinct_addresses", "distinct_phones", "distinct_payment_instruments"],
    ["total_amount", "avg_order_value"],
)
_behavior_query("b2_status_pivot", ["total_delivered_orders", "total_failed_orders", "total_pending_orders"], [])
_behavior_query("b3_coupon_discount", [], ["coupon_usage_rate", "discount_dependency_score"])
_behavior_query("b4_distinct_coupons", ["distinct_coupon_count"], [])
_behavior_query("b5_max_discount", [], ["max_discount_ratio"])
_behavior_query("b6_rare_coupons", ["rare_coupon_count"], [])
_behavior_query("b7_returns", ["total_returns"], ["avg_return_lag_hours"])
_behavior_query("b8_refunds", ["total_refunds"], ["total_refund_amount"])
_behavior_query("b9_disputes", ["total_disputes"], [])
_behavior_query("b10_default_fill", B.ZERO_COUNTS, B.ZERO_AMOUNTS)
_behavior_query("b11_rates", [], ["return_rate", "refund_rate", "dispute_rate"])


# ------------------------------------------------------------------ time
def _time_query(name, whole, real):
    cols = ", ".join([*whole, *[sql_round(c) for c in real]])

    @query(name, f"SELECT account_id, {cols} FROM temporal")
    def run(d):
        return rounded(timed(d).select("account_id", *whole, *real), real)


_time_query("t1_account_age", [], ["account_age_days"])
_time_query("t2_order_windows", ["orders_last_24h", "orders_last_7d", "orders_last_30d"], [])
_time_query("t3_refund_windows", ["refunds_last_24h", "refunds_last_7d", "refunds_last_30d"], [])
_time_query("t4_recent_return_rate", [], ["return_rate_last_30d"])
_time_query("t5_lifetime", [], ["account_lifetime_days"])
_time_query("t6_order_gap", [], ["avg_order_gap_days"])
_time_query("t7_recent_activity", [], ["recent_activity_ratio"])


@query("t8_evening_ratio", """
SELECT user_id AS account_id, round(avg(CASE WHEN hour(ts) BETWEEN 18 AND 22 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS evening_order_ratio
FROM events GROUP BY 1""")
def t8(d):
    hour = F.hour("order_timestamp")
    return d.clock_orders.groupBy("account_id").agg(
        F.round(F.avg(hour.between(18, 22).cast("double")), 6).alias("evening_order_ratio")
    )


_time_query("t9_burst_scores", [], ["transaction_burst_score", "refund_burst_score"])


@query("t10_creation_burst", "SELECT account_id, account_creation_burst_score FROM temporal")
def t10(d):
    return T.creation_bursts(d.accounts, CUTOFF)


# ------------------------------------------------------------------ identity
@query("i1_entity_map", "SELECT kind, entity, count(*) AS n_accounts FROM links GROUP BY 1, 2")
def i1(d):
    return I.entity_links(pre_orders(d)).groupBy("kind", "entity").agg(F.count("*").alias("n_accounts"))


@query("i2_accounts_per_entity", f"""
SELECT account_id, {sql_round(*[f'accounts_per_{k}' for k in I.KINDS])} FROM identity
WHERE account_id IN (SELECT account_id FROM links)""")
def i2(d):
    sized = I.sized_links(I.entity_links(pre_orders(d)))
    return rounded(I.accounts_per_entity(sized), [f"accounts_per_{k}" for k in I.KINDS])


def _sharing(d):
    return I.sharing_features(I.stored_links(pre_orders(d)))


_WITH_LINKS = "FROM identity WHERE account_id IN (SELECT account_id FROM links)"


@query("i3_shared_counts", f"SELECT account_id, {', '.join(f'shared_{k}_count' for k in I.KINDS)} {_WITH_LINKS}")
def i3(d):
    return _sharing(d).select("account_id", *[f"shared_{k}_count" for k in I.KINDS])


@query("i4_joint_sharing", f"SELECT account_id, has_shared_device_and_address, has_shared_payment_and_phone {_WITH_LINKS}")
def i4(d):
    return _sharing(d).select("account_id", "has_shared_device_and_address", "has_shared_payment_and_phone")


@query("i5_shared_kinds", f"SELECT account_id, shared_entity_types_count {_WITH_LINKS}")
def i5(d):
    return _sharing(d).select("account_id", "shared_entity_types_count")


@query("i6_shared_ip", "SELECT account_id, shared_ip_prefix_count FROM identity WHERE shared_ip_prefix_count > 0")
def i6(d):
    return I.shared_ip_counts(I.ip_pairs(pre_orders(d), pre_devices(d)))


FEATURE_REALS = [
    "total_amount", "avg_order_value", "coupon_usage_rate", "discount_dependency_score", "max_discount_ratio",
    "avg_return_lag_hours", "total_refund_amount", "return_rate", "refund_rate", "dispute_rate",
    "account_age_days", "return_rate_last_30d", "account_lifetime_days", "avg_order_gap_days",
    "recent_activity_ratio", "evening_order_ratio", "transaction_burst_score", "refund_burst_score",
    *[f"accounts_per_{k}" for k in I.KINDS],
]


@query("i7_feature_matrix", f"SELECT * REPLACE ({sql_round(*FEATURE_REALS)}) FROM features")
def i7(d):
    return rounded(features(d), FEATURE_REALS)
