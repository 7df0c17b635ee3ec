"""Reproducible train/validation/test splits that keep rings whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.running import ranked
from verdigris.operators.components import component_labels


def shuffle_key(id_col: str, seed: int) -> F.Column:
    """A pseudo-random order any engine can reproduce."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def _cut(position: F.Column, n_train: F.Column, n_val: F.Column) -> F.Column:
    return (
        F.when(position <= n_train, "train").when(position <= n_train + n_val, "val").otherwise("test")
    )


def _with_total(df: DataFrame) -> DataFrame:
    total = df.agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    return df.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")


def ring_aware_split(truth: DataFrame, seed: int = 42, train: float = 0.70, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """(account_id, split). Rings go whole; other accounts by hashed order."""
    member = F.col("true_ring_member")
    rings = truth.filter(member).select("abuse_ring_id").distinct()
    order = [shuffle_key("abuse_ring_id", seed).asc(), F.col("abuse_ring_id").asc()]
    rings = _with_total(ranked(rings, order, name="p"))
    ring_split = rings.select(
        "abuse_ring_id",
        _cut(
            F.col("p"),
            F.floor(F.col("n") * F.lit(train)),
            F.floor(F.col("n") * F.lit(val)),
        ).alias("split"),
    )
    inside = truth.filter(member).join(ring_split, "abuse_ring_id").select("account_id", "split")
    others = truth.filter(~member).select("account_id")
    order = [shuffle_key("account_id", seed).asc(), F.col("account_id").asc()]
    others = _with_total(ranked(others, order, name="p"))
    holdout = F.ceil(F.col("n") * F.lit(val + test))
    n_test = F.ceil(holdout * F.lit(test / (val + test)))
    outside = others.select(
        "account_id", _cut(F.col("p"), F.col("n") - holdout, holdout - n_test).alias("split")
    )
    return inside.unionByName(outside)


def named_ring_split(
    truth: DataFrame, rings: dict[str, list[str]], seed: int = 42, train: float = 0.5, val: float = 0.2, unnamed: str | None = None
) -> DataFrame:
    """Older variant: the rings of each split are named, other accounts split 50/20/30.

    Rings that no split names go to ``unnamed``; without it, meeting one is an error.
    """
    member = F.col("true_ring_member")
    lost = F.concat(F.lit("no split names ring "), F.coalesce("abuse_ring_id", F.lit("null")))
    named = F.lit(unnamed) if unnamed is not None else F.raise_error(lost).cast("string")
    for split, ids in rings.items():
        named = F.when(F.col("abuse_ring_id").isin(ids), split).otherwise(named)
    inside = truth.filter(member).select("account_id", named.alias("split"))
    order = [shuffle_key("account_id", seed).asc(), F.col("account_id").asc()]
    others = _with_total(ranked(truth.filter(~member).select("account_id"), order, name="p"))
    outside = others.select(
        "account_id",
        _cut(F.col("p"), F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(val))).alias("split"),
    )
    return inside.unionByName(outside)


def split_violations(split: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: accounts in two splits, missing accounts, rings cut apart."""
    per_account = split.groupBy("account_id").agg(F.countDistinct("split").alias("k"))
    rings = (
        truth.filter("true_ring_member").join(split, "account_id")
        .groupBy("abuse_ring_id").agg(F.countDistinct("split").alias("k"))
    )
    one = F.lit(1).alias("one")
    a = per_account.agg(F.count_if(F.col("k") > 1).alias("accounts_in_two_splits"), F.count("*").alias("n_split"), one)
    b = truth.agg(F.count("*").alias("n_truth"), one)
    c = rings.agg(F.count_if(F.col("k") > 1).alias("rings_cut"), one)
    return a.join(b, "one").join(c, "one").select(
        "accounts_in_two_splits", (F.col("n_truth") - F.col("n_split")).alias("missing_accounts"), "rings_cut"
    )


MODEL_EXCLUDED = [
    "account_id", "community_id", "population_type", "abuse_ring_id", "true_ring_member", "ring_type",
    "ring_start_time", "ring_end_time", "split", "label",
]


def input_columns(matrix: DataFrame) -> list[str]:
    """Numeric model inputs; ids, labels and community ids are left out."""
    return [
        f.name for f in matrix.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in MODEL_EXCLUDED
    ]


def input_report(matrix: DataFrame, split: DataFrame) -> DataFrame:
    """Per input column: constant in train (to be dropped), nulls, non-finite values.

    Constant means min = max, one pass without distinct counts.
    """
    cols = input_columns(matrix)
    joined = matrix.join(split, "account_id")
    train = F.col("split") == "train"
    value = lambda c: F.col(c).cast("double")
    row = joined.agg(
        *[
            F.struct(
                (F.coalesce(F.min(F.when(train, value(c))) == F.max(F.when(train, value(c))), F.lit(True))).alias("constant"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.count_if(F.isnan(value(c)) | (F.abs(value(c)) == float("inf"))).alias("not_finite"),
            ).alias(c)
            for c in cols
        ]
    )
    packed = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols])
    return row.select(F.explode(packed).alias("p")).select(
        "p.feature", F.col("p.x.constant").alias("constant_in_train"), F.col("p.x.nulls").alias("null_values"), F.col("p.x.not_finite").alias("not_finite_values")
    )


def usable_columns(matrix: DataFrame, split: DataFrame) -> list[str]:
    """Model inputs without the columns constant in train."""
    report = input_report(matrix, split).filter(~F.col("constant_in_train"))
    return [r["feature"] for r in report.select("feature").collect()]


def candidate_groups(candidates: DataFrame, positive_rings: DataFrame) -> DataFrame:
    """(candidate_id, split_group): candidates linked by common true rings form one group."""
    links = positive_rings.select(
        F.concat(F.lit("c:"), F.col("candidate_id")).alias("a"),
        F.concat(F.lit("r:"), F.col("abuse_ring_id")).alias("b"),
    )
    labels = component_labels(links, "a", "b").filter(F.col("id").startswith("c:"))
    labels = labels.select(F.expr("substring(id, 3)").alias("candidate_id"), F.col("component").alias("split_group"))
    return candidates.select("candidate_id").join(labels, "candidate_id", "left").select(
        "candidate_id",
        F.coalesce("split_group", F.concat(F.lit("c:"), F.col("candidate_id"))).alias("split_group"),
    )


def candidate_split(groups: DataFrame, seed: int = 42) -> DataFrame:
    """(candidate_id, split_group, split): grouped 70/15/15 with at least one group each."""
    distinct = groups.select("split_group").distinct()
    order = [shuffle_key("split_group", seed).asc(), F.col("split_group").asc()]
    g = _with_total(ranked(distinct, order, name="p"))
    t0 = F.greatest(F.lit(1), F.bround(F.col("n") * 0.70).cast("bigint"))
    v0 = F.greatest(F.lit(1), F.bround(F.col("n") * 0.15).cast("bigint"))
    crowded = t0 + v0 >= F.col("n")
    n_train = F.when(crowded, F.greatest(F.lit(1), F.col("n") - 2)).otherwise(t0)
    n_val = F.when(crowded, F.lit(1)).otherwise(v0)
    placed = g.select("split_group", _cut(F.col("p"), n_train, n_val).alias("split"))
    return groups.join(placed, "split_group").select("candidate_id", "split_group", "split")


def group_folds(truth: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """(account_id, fold): rings stay in one fold, other accounts are their own group.

    Groups are dealt to folds in order of size, then hashed order.
    """
    grouped = truth.select(
        "account_id",
        F.coalesce(
            F.when(F.col("true_ring_member"), F.col("abuse_ring_id")),
            F.concat(F.lit("a:"), F.col("account_id").cast("string")),
        ).alias("g"),
    )
    sizes = grouped.groupBy("g").agg(F.count("*").alias("n"))
    dealt = ranked(sizes, [F.col("n").desc(), shuffle_key("g", seed).asc(), F.col("g").asc()], name="p")
    return grouped.join(dealt.select("g", (F.col("p") % folds).cast("int").alias("fold")), "g").select("account_id", "fold")
