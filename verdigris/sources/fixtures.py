"""Commerce-shaped tables derived from the star-schema test data (whole tables, no samples)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.constants import EVIDENCE_FIELDS, RING_TYPES
from verdigris.session import materialize, prepare

CUTOFF = "2000-01-01 00:00:00"


def _days(expr: str) -> str:
    return f"make_dt_interval(int({expr}))"


class Data:
    """Lazy access to the derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def accounts(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS account_id",
            """TIMESTAMP'1994-12-01 00:00:00' + make_dt_interval(0, int((c_custkey * 37) % 720
               + CASE WHEN c_custkey % 50 = 49 THEN 60000 ELSE 0 END)) AS account_created_at""",
            "element_at(array('regular', 'new', 'guest'), int(c_custkey % 3) + 1) AS customer_type",
        )

    @cached_property
    def orders(self) -> DataFrame:
        lines = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.count("*").alias("n_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
            F.min("l_partkey").alias("min_part"),
            F.max("l_partkey").alias("max_part"),
            F.min("l_suppkey").alias("min_supp"),
            F.max("l_suppkey").alias("max_supp"),
            F.avg("l_discount").alias("avg_disc"),
        )
        base = self.raw("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        first = base.selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS account_id",
            "min_part AS device_id",
            "min_supp * 40 + o_custkey % 40 AS address_id",
            "CAST(max_part AS STRING) AS phone_hash",
            "max_supp * 20 + o_custkey % 20 AS instrument_id",
            "o_totalprice AS amount",
            "o_totalprice * avg_disc AS discount_amount",
            """CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
               ELSE concat('C', ((o_orderkey % 997) * (o_orderkey % 997)) div 500) END
               AS coupon_code""",
            "o_orderpriority AS category",
            "CAST(o_orderdate AS TIMESTAMP) AS order_timestamp",
            """CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending'
               ELSE 'failed' END AS delivery_status""",
            "n_lines",
            "n_ret",
        )
        second = first.selectExpr(
            "*",
            f"""CASE WHEN delivery_status = 'delivered'
                THEN order_timestamp + {_days('1 + order_id % 5')} END AS delivery_timestamp""",
            "delivery_status = 'failed' AS rto_flag",
            """coalesce(delivery_status = 'delivered' AND 2 * n_ret >= n_lines, false)
               AS return_flag""",
            "delivery_status = 'delivered' AND order_id % 11 = 0 AS dispute_flag",
        ).drop("n_lines", "n_ret")
        third = second.selectExpr(
            "*",
            f"""CASE WHEN return_flag THEN delivery_timestamp + {_days('1 + order_id % 7')} END
                AS return_timestamp""",
            "CASE WHEN return_flag THEN CAST(24 * (1 + order_id % 7) AS DOUBLE) END AS return_lag_hours",
            "CASE WHEN return_flag THEN concat('RC', order_id % 4) END AS return_reason_code",
            "return_flag AND order_id % 3 <> 0 AS refund_flag",
            f"""CASE WHEN dispute_flag THEN delivery_timestamp + {_days('5')} END
                AS dispute_created_at""",
            "CASE WHEN dispute_flag THEN concat('D', order_id % 5) END AS dispute_reason_code",
        )
        return third.selectExpr(
            "*",
            f"CASE WHEN refund_flag THEN return_timestamp + {_days('2')} END AS refund_timestamp",
            "CASE WHEN refund_flag THEN amount END AS refund_amount",
        )

    @cached_property
    def stored_orders(self) -> DataFrame:
        """The orders written once, for jobs that read them several times."""
        return materialize(self.orders, "orders")

    @cached_property
    def refunds(self) -> DataFrame:
        return self.stored_orders.filter("refund_flag").selectExpr(
            "order_id AS refund_id", "order_id", "account_id", "refund_timestamp", "refund_amount"
        )

    @cached_property
    def disputes(self) -> DataFrame:
        evidence = [
            f"(order_id div {11 * 2**i}) % 2 = 0 AS {name}" for i, name in enumerate(EVIDENCE_FIELDS)
        ]
        return self.stored_orders.filter("dispute_flag").selectExpr(
            "order_id AS dispute_id",
            "order_id",
            "account_id",
            "dispute_created_at",
            "dispute_reason_code",
            f"dispute_created_at + {_days('7')} AS respond_by",
            *evidence,
        )

    @cached_property
    def devices(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS device_id",
            "concat(p_brand, '-', p_size) AS ip_prefix",
            f"TIMESTAMP'1994-11-01 00:00:00' + {_days('p_partkey % 2200')} AS first_seen_at",
        )

    @cached_property
    def truth(self) -> DataFrame:
        types = ", ".join(f"'{t}'" for t in RING_TYPES)
        member = "c_custkey % 20 = 0"
        return self.raw("customer").selectExpr(
            "c_custkey AS account_id",
            f"CASE WHEN {member} THEN concat('R', c_custkey div 100) END AS abuse_ring_id",
            f"{member} AS true_ring_member",
            f"CASE WHEN {member} THEN element_at(array({types}), int((c_custkey div 100) % 4) + 1) END AS ring_type",
            f"""CASE WHEN {member} THEN 'ring' WHEN c_custkey % 20 <= 3 THEN 'hard_negative'
                ELSE 'normal' END AS population_type""",
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Two score columns with many ties, and the label they are judged by."""
        return self.raw("customer").selectExpr(
            "c_custkey AS account_id",
            "CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END AS true_label",
            """CAST((c_custkey * 7919) % 701 + CASE WHEN c_custkey % 20 = 0 THEN 300 ELSE 150 END
               AS DOUBLE) / CAST(1001 AS DOUBLE) AS proba_A""",
            "CAST((c_custkey * 104729) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS proba_B",
        )

    @cached_property
    def communities(self) -> DataFrame:
        """A community table of small groups, for the jobs that take one as input."""
        return self.raw("customer").selectExpr(
            "c_custkey AS account_id", "c_custkey div 7 AS community_id"
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS row_number",
            "CASE WHEN event_id % 41 <> 0 THEN concat('pay_', event_id) END AS id",
            "'payment' AS entity",
            "CASE WHEN event_id % 43 = 0 THEN -value ELSE value END AS amount",
            """CASE WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 53 = 0 THEN ''
               ELSE 'INR' END AS currency""",
            "CASE WHEN event_type <> 'error' THEN event_type END AS status",
            "element_at(array('card', 'upi', 'netbanking', 'wallet'), int(event_id % 4) + 1) AS method",
            "concat('order_', event_id) AS order_id",
            "concat('user', user_id, '@example.com') AS email",
            "concat('+9198', lpad(CAST(user_id AS STRING), 8, '0')) AS contact",
        )

    @cached_property
    def audit(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id",
            "CAST(ts AS TIMESTAMP) AS timestamp",
            "user_id AS account_id",
            "event_id % 100 + 1 AS rank",
            "CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(event_id % 1000 AS STRING) END AS proba",
            """CASE WHEN event_id % 100 < 10 THEN 'CRITICAL' WHEN event_id % 100 < 25 THEN 'HIGH'
               WHEN event_id % 100 < 65 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier""",
            "CASE event_type WHEN 'view' THEN 'yes' WHEN 'click' THEN '1' WHEN 'error' THEN NULL ELSE 'no' END AS top_k_flag",
            """CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 100 < 10
               THEN 'Soft-hold refund pending human approval'
               WHEN event_id % 100 < 65 THEN 'Route to human investigation/review'
               ELSE 'Monitor — no immediate refund action' END AS action_recommended""",
            "CASE WHEN event_id % 3 = 0 THEN 'Require step-up verification before processing refund' END AS recommended_action",
            "CASE WHEN event_type = 'error' THEN 'tool failed' END AS error",
            "CASE WHEN event_type = 'view' THEN 'deterministic' END AS investigation_source",
            "CASE WHEN event_type = 'click' THEN props END AS summary",
        )

    @cached_property
    def addresses(self) -> DataFrame:
        cities = "array('Bengaluru', 'Mumbai', 'Chennai', 'Kolkata', 'Pune')"
        states = "array('Karnataka', 'Maharashtra', 'Tamil Nadu', 'West Bengal', 'Maharashtra')"
        part = self.raw("part").select("p_partkey", "p_name")
        n_parts = part.count()
        keyed = (
            self.raw("customer")
            .selectExpr("c_custkey AS k", "c_nationkey", f"c_custkey % {n_parts} AS pk")
            .join(part, F.col("pk") == F.col("p_partkey"))
        )
        return keyed.selectExpr(
            "k",
            "p_name",
            f"element_at({cities}, int(c_nationkey % 5) + 1) AS city",
            f"element_at({states}, int(c_nationkey % 5) + 1) AS state",
            "CAST(560000 + k % 200 AS STRING) AS pincode",
        ).selectExpr(
            "k AS address_id",
            """concat(1 + k % 97, ', ', p_name, ' Road, Sector ', 1 + k % 60, ', ', city, ', ',
               state, ' ', pincode) AS canonical_address""",
            "city",
            "pincode",
        )

    @cached_property
    def address_queries(self) -> DataFrame:
        return self.addresses.selectExpr(
            "address_id AS query_id",
            """CASE address_id % 4 WHEN 0 THEN canonical_address WHEN 1 THEN lower(canonical_address)
               WHEN 2 THEN regexp_replace(canonical_address, ' [0-9]{6}$', '')
               ELSE replace(canonical_address, 'Road', 'Rd') END AS raw_address""",
        )

    @cached_property
    def clock_orders(self) -> DataFrame:
        """Orders with a time of day, from the event stream."""
        return self.raw("events").selectExpr(
            "event_id AS order_id", "user_id AS account_id", "CAST(ts AS TIMESTAMP) AS order_timestamp"
        )
