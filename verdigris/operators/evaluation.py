"""Exact model metrics from per-score counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.constants import ACCOUNT_GRID, COST_FN, COST_FP
from verdigris.functions.exprs import safe_div
from verdigris.functions.running import quantiles, running_sums


def _rates(df: DataFrame, cost_fp: float, cost_fn: float) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    return df.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": safe_div(2 * tp, 2 * tp + fp + fn),
            "accuracy": safe_div(tp + tn, tp + fp + fn + tn),
            "cost": (fp * F.lit(cost_fp) + fn * F.lit(cost_fn)).cast("double"),
        }
    )


def confusion(
    df: DataFrame, label: str, pred: str, by: list[str] | None = None,
    cost_fp: float = COST_FP, cost_fn: float = COST_FN,
) -> DataFrame:
    """Counts, precision, recall, F1, accuracy and cost, per group if asked."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(y & ~p).alias("fn"),
    )
    return _rates(counts, cost_fp, cost_fn)


def melt_scores(df: DataFrame, label: str, models: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form (model, label, score); one pass, unreadable scores are 0."""
    items = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias("score"))
            for m, c in models.items()
        ]
    )
    return df.select(*keep, F.col(label).cast("int").alias("label"), F.explode(items).alias("s")).select(
        *keep, "label", "s.model", "s.score"
    )


def score_counts(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, pos, neg): ties collapse before anything is sorted."""
    return scores.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )


def cumulative(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct score, counts of rows scored at least that high."""
    return running_sums(
        score_counts(scores, by), [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, by
    )


def auc_metrics(scores: DataFrame, by: list[str]) -> DataFrame:
    """ROC AUC (ties count half) and average precision (ties grouped) per group.

    One class only gives 0 for both.
    """
    c = cumulative(scores, by)
    # At each score: its positives beat the negatives below it and tie with those beside it.
    sums = c.groupBy(*by).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") * 0.5).alias("wins"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(
        *by,
        F.when(both, F.col("wins") / (F.col("positives").cast("double") * F.col("negatives"))).otherwise(0.0).alias("roc_auc"),
        F.when(both, F.col("ap") / F.col("positives")).otherwise(0.0).alias("pr_auc"),
        "positives",
        "negatives",
    )


def grid_value(i: F.Column, points: int) -> F.Column:
    return F.lit(0.01) + i * F.lit(0.98) / F.lit(float(points - 1))


def threshold_costs(
    scores: DataFrame, by: list[str], points: int = ACCOUNT_GRID,
    cost_fp: float = COST_FP, cost_fn: float = COST_FN,
) -> DataFrame:
    """Cost at every grid threshold, from one bucket count per score.

    A row is flagged at threshold i iff score >= t_i, so it belongs to the bucket of the last
    threshold it reaches. Suffix sums over the (at most ``points`` + 1) buckets give each
    threshold's counts without pairing rows with thresholds.
    """
    # Nearest index below by arithmetic, then corrected against the same formula the grid uses.
    guess = F.floor((F.col("score") - 0.01) * F.lit(float(points - 1)) / 0.98).cast("int")
    up = F.when(grid_value((guess + 1).cast("double"), points) <= F.col("score"), guess + 1).otherwise(guess)
    last = F.when(grid_value(up.cast("double"), points) > F.col("score"), up - 1).otherwise(up)
    bucket = F.greatest(F.least(last, F.lit(points - 1)), F.lit(-1))
    counts = scores.groupBy(*by, bucket.alias("bucket")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    # A bucket row feeds every threshold up to it: at most ``points`` rows per bucket.
    reached = counts.select(
        *by, "pos", "neg", "bucket", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    )
    hit = F.col("bucket") >= F.col("i")
    table = reached.groupBy(*by, "i").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
    )
    priced = table.withColumns(
        {
            "threshold": grid_value(F.col("i").cast("double"), points),
            "cost": (F.col("fp") * F.lit(cost_fp) + F.col("fn") * F.lit(cost_fn)).cast("double"),
        }
    )
    return priced


def best_threshold(scores: DataFrame, by: list[str], points: int = ACCOUNT_GRID, **costs) -> DataFrame:
    """First grid threshold of least cost per group."""
    c = threshold_costs(scores, by, points, **costs)
    return c.groupBy(*by).agg(
        F.min_by("threshold", F.struct("cost", "i")).alias("threshold"), F.min("cost").alias("cost")
    )


def top_k_curve(
    scores: DataFrame, by: list[str], tie: str = "account_id", cost_fp: float = COST_FP, cost_fn: float = COST_FN
) -> DataFrame:
    """Precision, recall, F1 and cost when the k best-scored rows are flagged, for every k."""
    run = running_sums(
        scores,
        [F.col("score").desc(), F.col(tie).asc()],
        {"k": F.lit(1).cast("bigint"), "tp": (F.col("label") == 1).cast("bigint")},
        by,
    )
    total = scores.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("positives"))
    joined = run.join(total, by)
    fp, fn = F.col("k") - F.col("tp"), F.col("positives") - F.col("tp")
    return joined.select(
        *by,
        "k",
        F.col("score").alias("prob_cutoff"),
        "tp",
        fp.alias("fp"),
        fn.alias("fn"),
        safe_div(F.col("tp"), F.col("k")).alias("precision"),
        safe_div(F.col("tp"), F.col("positives")).alias("recall"),
        safe_div(2 * F.col("tp"), F.col("k") + F.col("positives")).alias("f1"),
        (fp * F.lit(cost_fp) + fn * F.lit(cost_fn)).cast("double").alias("cost"),
    )


def operating_point(curve: DataFrame, by: list[str], min_recall: float = 0.6) -> DataFrame:
    """Cheapest k that reaches the recall; if none does, the best (F1, -cost)."""
    fields = ["k", "tp", "fp", "fn", "precision", "recall", "f1", "cost", "prob_cutoff"]
    row = F.struct(*fields)
    ok = F.col("recall") >= min_recall
    picked = curve.groupBy(*by).agg(
        F.min_by(F.when(ok, row), F.when(ok, F.struct("cost", "k"))).alias("good"),
        F.max_by(row, F.struct(F.col("f1"), -F.col("cost"), -F.col("k"))).alias("fallback"),
    )
    best = F.coalesce("good", "fallback")
    return picked.select(*by, best.alias("b")).select(*by, *[F.col(f"b.{f}").alias(f) for f in fields])


def evaluate_top_k(scores: DataFrame, k: int, by: list[str], tie: str = "account_id", **costs) -> DataFrame:
    """Metrics when exactly the k best-scored rows of each group are flagged."""
    point = top_k_curve(scores, by, tie, **costs).filter(F.col("k") == k)
    return point.drop("prob_cutoff").join(auc_metrics(scores, by), by).drop("positives", "negatives")


def curve_points(scores: DataFrame, by: list[str]) -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    c = cumulative(scores, by)
    totals = scores.groupBy(*by).agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n")
    )
    return c.join(totals, by).select(
        *by,
        "score",
        safe_div(F.col("fp"), F.col("n")).alias("fpr"),
        safe_div(F.col("tp"), F.col("p")).alias("tpr"),
        safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def score_histogram(scores: DataFrame, by: list[str], bins: int = 50) -> DataFrame:
    """Density of scores in equal-width bins over each group's own range, empty bins included."""
    span = scores.groupBy(*by).agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("total")
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    slot = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    filled = scores.join(span, by).groupBy(*by, slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    dense = span.select(*by, "lo", "hi", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.join(filled, [*by, "bin"], "left").select(
        *by,
        "bin",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        F.when(width > 0, F.coalesce("n", F.lit(0)) / (F.col("total") * width)).otherwise(F.lit(0.0)).alias("density"),
    )


def feature_audit(matrix: DataFrame, truth: DataFrame, columns: list[str]) -> DataFrame:
    """AUC of every numeric column alone, folded to at least 0.5; constant columns left out."""
    labelled = truth.select("account_id", F.col("true_ring_member").cast("int").alias("label")).join(
        matrix.select("account_id", *columns), "account_id", "left"
    )
    values = melt_scores(labelled, "label", {c: c for c in columns}).withColumnRenamed("model", "feature")
    c = cumulative(values, ["feature"])
    sums = c.groupBy("feature").agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") * 0.5).alias("wins"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.count("*").alias("unique_values"),
    ).filter(F.col("unique_values") >= 2)
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p").cast("double") * F.col("n"))).otherwise(0.5)
    return sums.select(
        "feature", F.round(F.greatest(auc, 1 - auc), 6).alias("single_feature_auc"), "unique_values"
    )


def raw_signals(accounts: DataFrame, orders: DataFrame, truth: DataFrame) -> DataFrame:
    """Per-account totals and flag means straight from the (cut off) orders."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    per = orders.groupBy("account_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_order_value"),
        mean("return_flag").alias("return_rate"),
        mean("refund_flag").alias("refund_rate"),
        mean("dispute_flag").alias("dispute_rate"),
        F.countDistinct("device_id").alias("distinct_devices"),
        F.countDistinct("address_id").alias("distinct_addresses"),
        F.countDistinct("phone_hash").alias("distinct_phones"),
        F.countDistinct("instrument_id").alias("distinct_instruments"),
        F.avg(F.col("coupon_code").isNotNull().cast("double")).alias("coupon_usage_rate"),
    )
    out = accounts.select("account_id").join(per, "account_id", "left").fillna(0)
    return out.join(truth.select("account_id", "true_ring_member"), "account_id", "left")


RAW_SIGNALS = [
    "total_orders", "total_amount", "avg_order_value", "return_rate", "refund_rate", "dispute_rate",
    "distinct_devices", "distinct_addresses", "distinct_phones", "distinct_instruments", "coupon_usage_rate",
]


def shortcut_gate(audits: DataFrame, limit: float = 0.80) -> DataFrame:
    """Passes when no single column separates the classes too well."""
    top = F.coalesce(F.max("single_feature_auc"), F.lit(0.5))
    return audits.agg(top.alias("max_auc"), (top <= limit).alias("passed"))


def hard_negative_hits(predictions: DataFrame, truth: DataFrame, pred: str) -> DataFrame:
    """Flagged accounts that are hard negatives and not ring members."""
    hard = truth.filter((F.col("population_type") == "hard_negative") & ~F.col("true_ring_member"))
    return predictions.filter(F.col(pred) == 1).join(hard.select("account_id"), "account_id", "left_semi")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")
    long = long.filter(F.col("value").isNotNull())
    base = long.groupBy("feature").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quart = quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return base.join(quart, "feature")


def ring_type_recall(predictions: DataFrame, truth: DataFrame, models: dict[str, str], ring_types: list[str]) -> DataFrame:
    """Per ring type: members and, per model, hits and recall; types without members show 0."""
    members = predictions.join(truth.filter("true_ring_member"), "account_id")
    found = members.groupBy("ring_type").agg(
        F.count("*").alias("members"),
        *[F.count_if(F.col(c) == 1).alias(f"tp_{m}") for m, c in models.items()],
    )
    kinds = predictions.sparkSession.createDataFrame([(t,) for t in ring_types], "ring_type STRING")
    zero = F.lit(0).cast("bigint")
    out = kinds.join(found, "ring_type", "left")
    return out.select(
        "ring_type",
        F.coalesce("members", zero).alias("total_ring_members"),
        *[F.coalesce(f"tp_{m}", zero).alias(f"tp_{m}") for m in models],
        *[safe_div(F.col(f"tp_{m}"), F.col("members")).alias(f"recall_{m}") for m in models],
    )


def false_positives(predictions: DataFrame, truth: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row: non-ring accounts, false positives per model, labels that disagree with the truth."""
    joined = predictions.join(truth.select("account_id", "true_ring_member"), "account_id", "left")
    out = ~F.coalesce(F.col("true_ring_member"), F.lit(False))
    return joined.agg(
        F.count_if(out).alias("non_ring_accounts"),
        *[F.count_if(out & (F.col(c) == 1)).alias(f"fp_{m}") for m, c in models.items()],
        F.count_if(F.col("true_ring_member").isNull() | (F.col("true_ring_member").cast("int") != F.col("true_label"))).alias("label_mismatches"),
    )


def label_match(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Full outer comparison of the two key sets."""
    a = predictions.select("account_id", F.lit(1).alias("l"))
    b = truth.select("account_id", F.lit(1).alias("r"))
    j = a.join(b, "account_id", "full")
    return j.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"),
        F.count_if(F.col("r").isNull()).alias("predictions_only"),
        F.count_if(F.col("l").isNull()).alias("truth_only"),
    )


def compare_models(metrics: DataFrame, baseline: str) -> DataFrame:
    """Each model against the baseline: deltas, cost reduction percent, and the best F1."""
    base = metrics.filter(F.col("model") == baseline).select(
        F.lit(1).alias("one"), *[F.col(c).alias(f"b_{c}") for c in ("f1", "pr_auc", "roc_auc", "cost")]
    )
    best = metrics.filter(F.col("model") != baseline).agg(
        F.max_by("model", F.struct(F.col("f1"), -F.col("cost"))).alias("best_model"), F.lit(1).alias("one")
    )
    j = metrics.withColumn("one", F.lit(1)).join(base, "one").join(best, "one")
    return j.select(
        "model",
        *[(F.col(c) - F.col(f"b_{c}")).alias(f"delta_{c}") for c in ("f1", "pr_auc", "roc_auc", "cost")],
        F.when(F.col("b_cost") > 0, (F.col("b_cost") - F.col("cost")) / F.col("b_cost") * 100).alias("cost_reduction_pct"),
        (F.col("model") == F.col("best_model")).alias("is_best"),
    )


def normalize_metrics(raw: DataFrame, cost_fp: float = COST_FP, cost_fn: float = COST_FN) -> DataFrame:
    """(model, map of metrics) with keys in either case; a missing cost is derived."""
    def pick(name: str) -> F.Column:
        return F.coalesce(F.try_element_at("m", F.lit(name)), F.try_element_at("m", F.lit(name.upper())))

    derived = pick("fp") * cost_fp + pick("fn") * cost_fn
    return raw.select(
        "model",
        *[pick(c).alias(c) for c in ("tp", "fp", "tn", "fn", "precision", "recall", "f1")],
        F.coalesce(pick("cost"), derived).alias("cost"),
    )


def merge_predictions(base: DataFrame, extra: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Left-join extra score columns; keep, per model, the first alias that exists."""
    new = [c for c in extra.columns if c not in base.columns]
    joined = base.join(extra.select("account_id", *new), "account_id", "left")
    chosen = {
        m: next((a for a in names if a in joined.columns), None) for m, names in aliases.items()
    }
    return joined.select(
        "account_id", "true_label",
        *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(m) for m, c in chosen.items() if c],
    )
