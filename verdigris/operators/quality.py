"""Data-quality and leakage checks. Each check is a small table of violation counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.constants import CUTOFF, FORBIDDEN_COLUMNS
from verdigris.functions.exprs import ts


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _one(name: str, df: DataFrame, count: F.Column) -> DataFrame:
    return df.agg(F.lit(name).alias("check_name"), count.cast("bigint").alias("violations"))


def missing_columns(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """(table, column, present, filled_rows) for every required column; one pass per table."""
    parts = []
    for name, cols in required.items():
        df = tables[name]
        items = F.array(*[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"),
                (F.count(c) if c in df.columns else F.lit(None)).cast("bigint").alias("filled_rows"),
            )
            for c in cols
        ])
        row = df.agg(items.alias("x"))
        parts.append(row.select(F.lit(name).alias("table_name"), F.explode("x").alias("x")).select("table_name", "x.*"))
    return _union(parts)


def repeated_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Keys that occur more than once, per table."""
    parts = []
    for name, (df, key) in tables.items():
        again = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        parts.append(_one(f"{name}.{key}", again, F.count("*")))
    return _union(parts)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns])
    return df.agg(items.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def outside_window(df: DataFrame, columns: list[str], start: str, end: str) -> DataFrame:
    """Timestamps before start or after end, per column; nulls are not counted."""
    items = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.count_if(~F.col(c).between(ts(start), ts(end))).alias("outside"))
        for c in columns
    ])
    return df.agg(items.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def outside_domain(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    items = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.count_if(~F.coalesce(F.col(c).isin(v), F.lit(False))).alias("outside"))
        for c, v in domains.items()
    ])
    return df.agg(items.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def _keys_once(columns: list[tuple[DataFrame, list[tuple[str, str]]]]) -> DataFrame:
    """(check_name, k, n): every key value of every check with its rows; one scan per table."""
    parts = []
    for df, named in columns:
        items = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(c).cast("string").alias("k")) for n, c in named])
        parts.append(df.select(F.explode(items).alias("x")).select("x.*"))
    return _union(parts).groupBy("check_name", "k").agg(F.count("*").alias("n"))


def _by_table(pairs: list[tuple[DataFrame, str, str]]) -> list[tuple[DataFrame, list[tuple[str, str]]]]:
    tables: dict[int, tuple[DataFrame, list[tuple[str, str]]]] = {}
    for df, name, column in pairs:
        tables.setdefault(id(df), (df, []))[1].append((name, column))
    return list(tables.values())


def orphan_rows(links: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows whose key has no parent, one line per (name, child, key, parent, parent key).

    Null keys count as orphans. All keys of a table ride on one scan of it, folded per check
    and value before one anti-join for all checks.
    """
    children = _keys_once(_by_table([(child, name, key) for name, child, key, _, _ in links]))
    parents = _keys_once(_by_table([(parent, name, key) for name, _, _, parent, key in links])).select("check_name", "k")
    lost = children.join(parents, ["check_name", "k"], "left_anti").groupBy("check_name").agg(F.sum("n").alias("violations"))
    names = links[0][1].sparkSession.createDataFrame([(n,) for n, *_ in links], "check_name STRING")
    return names.join(lost, "check_name", "left").select("check_name", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))


def _lines(row: DataFrame, checks: dict[str, str]) -> DataFrame:
    """One line per check from one row of counts."""
    items = F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations")) for n, c in checks.items()])
    return row.select(F.explode(items).alias("x")).select("x.*")


def flag_conflicts(orders: DataFrame, refunds: DataFrame, disputes: DataFrame) -> DataFrame:
    """Rows that contradict their flags; one scan per table.

    Refund and dispute rows are counted per order and meet the orders once.
    """
    marks = refunds.select("order_id", F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(
        disputes.select("order_id", F.lit(0).alias("r"), F.lit(1).alias("s"))
    ).groupBy("order_id").agg(F.sum("r").alias("refund_rows"), F.sum("s").alias("dispute_rows"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    status = F.col("delivery_status")
    row = orders.select("order_id", "refund_flag", "dispute_flag", "delivery_status", "rto_flag", "delivery_timestamp").join(marks, "order_id", "left").agg(
        F.sum(F.when(no("refund_flag"), F.col("refund_rows"))).alias("refund"),
        F.sum(F.when(no("dispute_flag"), F.col("dispute_rows"))).alias("dispute"),
        F.count_if((status == "failed") != F.col("rto_flag")).alias("rto"),
        F.count_if(status.isin("pending", "failed") & F.col("delivery_timestamp").isNotNull()).alias("early"),
    )
    return _lines(row, {
        "refund_without_flag": "refund", "dispute_without_flag": "dispute", "rto_flag_mismatch": "rto", "undelivered_with_time": "early",
    })


def time_conflicts(accounts: DataFrame, orders: DataFrame, disputes: DataFrame) -> DataFrame:
    """Events out of order."""
    created = accounts.select("account_id", "account_created_at")
    early = orders.select("account_id", "order_timestamp").join(created, "account_id")
    c = F.col
    own = orders.agg(
        F.count_if((c("delivery_status") == "delivered") & (c("delivery_timestamp").isNull() | (c("delivery_timestamp") < c("order_timestamp")))).alias("delivery"),
        F.count_if(c("return_flag") & (c("return_timestamp") < c("delivery_timestamp"))).alias("returned"),
        F.count_if(c("refund_flag") & (c("refund_timestamp") < c("return_timestamp"))).alias("refunded"),
    )
    base = orders.select("order_id", F.coalesce("refund_timestamp", "delivery_timestamp").alias("base"))
    raised = disputes.join(base, "order_id", "left")
    return _union([
        _one("order_before_account", early, F.count_if(c("order_timestamp") < c("account_created_at"))),
        own.select(F.lit("delivery_before_order").alias("check_name"), c("delivery").alias("violations")),
        own.select(F.lit("return_before_delivery").alias("check_name"), c("returned").alias("violations")),
        own.select(F.lit("refund_before_return").alias("check_name"), c("refunded").alias("violations")),
        _one("dispute_before_refund_or_delivery", raised, F.count_if(c("dispute_created_at") < c("base"))),
        _one("respond_before_dispute", disputes, F.count_if(c("respond_by") < c("dispute_created_at"))),
    ])


def label_conflicts(truth: DataFrame, orders: DataFrame) -> DataFrame:
    member = F.col("true_ring_member")
    silent = truth.filter(member).join(orders.select("account_id").distinct(), "account_id", "left_anti")
    return _union([
        _one("member_without_ring", truth, F.count_if(member & F.col("abuse_ring_id").isNull())),
        _one("hard_negative_member", truth, F.count_if(member & (F.col("population_type") == "hard_negative"))),
        _one("member_without_orders", silent, F.count("*")),
    ])


def internal_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows filled in columns whose name starts with an underscore (latent values that leaked)."""
    parts = []
    for name, df in tables.items():
        hidden = [c for c in df.columns if c.startswith("_")]
        filled = sum((F.count(c) for c in hidden), F.lit(0).cast("bigint"))
        parts.append(df.agg(
            F.lit(name).alias("table_name"), F.lit(len(hidden)).cast("bigint").alias("internal_columns"),
            filled.alias("filled_cells"), F.count("*").alias("n_rows"),
        ))
    return _union(parts)


def dataset_summary(orders: DataFrame) -> DataFrame:
    """One row: counts, status shares, mean order value, flag rates."""
    share = lambda s: F.avg((F.col("delivery_status") == s).cast("double"))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return orders.agg(
        F.count("*").alias("n_orders"), F.countDistinct("account_id").alias("n_accounts"),
        share("delivered").alias("delivered_share"), share("pending").alias("pending_share"), share("failed").alias("failed_share"),
        F.avg("amount").alias("mean_order_value"), rate("return_flag").alias("return_rate"),
        rate("refund_flag").alias("refund_rate"), rate("dispute_flag").alias("dispute_rate"),
    )


def category_means(orders: DataFrame) -> DataFrame:
    return orders.groupBy("category").agg(F.round(F.avg("amount"), 2).alias("mean_amount"), F.count("*").alias("n_orders"))


def excluded_rows(tables: dict[str, tuple[DataFrame, str]], cutoff: str = CUTOFF) -> DataFrame:
    """Per table: newest timestamp used, rows used, rows after the cutoff."""
    used = lambda c: F.col(c) <= ts(cutoff)
    return _union([
        df.agg(
            F.lit(name).alias("table_name"), F.max(F.when(used(c), F.col(c))).alias("max_timestamp_used"),
            F.count_if(used(c)).alias("rows_used"), F.count_if(F.col(c) > ts(cutoff)).alias("rows_after_cutoff"),
        )
        for name, (df, c) in tables.items()
    ])


def feature_leakage_report(used: DataFrame, matrix: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """One row; ``used`` comes from ``excluded_rows``."""
    forbidden = [c for c in FORBIDDEN_COLUMNS if c in matrix.columns]
    one = F.lit(1).alias("one")
    a = used.agg(F.max("max_timestamp_used").alias("max_timestamp_used"), F.sum("rows_after_cutoff").alias("rows_excluded"), one)
    b = matrix.agg(
        F.count("*").alias("matrix_rows"),
        sum((F.count_if(F.col(c).isNull()) for c in matrix.columns), F.lit(0).cast("bigint")).alias("missing_values"), one,
    )
    ok = (F.col("max_timestamp_used") <= ts(cutoff)) & F.lit(not forbidden)
    return a.join(b, "one").drop("one").select(
        "*", F.lit(len(matrix.columns)).cast("bigint").alias("matrix_columns"),
        F.lit(len(forbidden)).cast("bigint").alias("forbidden_columns"),
        F.when(F.coalesce(ok, F.lit(True)), "PASSED").otherwise("FAILED").alias("leakage_check"),
    )


def graph_leakage_report(used: DataFrame, matrix: DataFrame, n_nodes: DataFrame, edges: DataFrame, coupon_rows: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """One row: all inputs before the cutoff, one node per matrix row, nothing forbidden."""
    base = feature_leakage_report(used, matrix, cutoff).withColumn("one", F.lit(1))
    a = n_nodes.agg(F.count("*").alias("graph_nodes"), F.lit(1).alias("one"))
    b = edges.agg(F.count("*").alias("graph_edges"), F.lit(1).alias("one"))
    c = coupon_rows.agg(F.count("*").alias("coupon_rows"), F.lit(1).alias("one"))
    j = base.join(a, "one").join(b, "one").join(c, "one").drop("one")
    ok = (F.col("leakage_check") == "PASSED") & (F.col("graph_nodes") == F.col("matrix_rows"))
    return j.withColumn("leakage_check", F.when(ok, "PASSED").otherwise("FAILED"))


def feature_summary(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        F.count("*").alias("n_rows"), F.avg("total_orders").alias("mean_total_orders"),
        F.avg("return_rate").alias("mean_return_rate"), F.avg("refund_rate").alias("mean_refund_rate"),
        F.avg("dispute_rate").alias("mean_dispute_rate"), F.avg("shared_device_count").alias("mean_shared_devices"),
        F.max("shared_device_count").alias("max_shared_devices"),
    )
