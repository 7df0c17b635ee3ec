"""Audit rows: written at decision time, normalized for reading, paged and rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.constants import TIERS
from verdigris.functions.exprs import ts, truthy_flag
from verdigris.functions.running import ranked

DEFAULT_MODEL = "Ensemble_LGBM_B_GNN"


def decision_rows(queue: DataFrame, reports: DataFrame, model_version: str, at: str) -> DataFrame:
    """One audit row per queued account."""
    done = reports.select("account_id").distinct().withColumn("done", F.lit(True))
    return queue.join(done, "account_id", "left").select(
        ts(at).alias("timestamp"), "account_id", F.lit(model_version).alias("model_version"), "proba", "rank",
        "risk_tier", F.lit(True).alias("top_k_flag"), F.col("recommended_action").alias("action_recommended"),
        F.coalesce("done", F.lit(False)).alias("case_report_generated"),
    )


def _text(df: DataFrame, name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _time_text(df: DataFrame) -> F.Column:
    if dict(df.dtypes)["timestamp"].startswith("timestamp"):
        return F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.col("timestamp")


def canonical_text(fields: list[F.Column]) -> F.Column:
    """Fields joined by ``|`` with empty text for nulls; the text the audit hash covers."""
    return F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def normalize_audit(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Old and new audit rows in one shape, with hash, human decision and outcome."""
    new, old = _text(df, "action_recommended"), _text(df, "recommended_action")
    action = F.when(new != "", new).otherwise(old)
    proba = F.col("proba").try_cast("double")
    rank = F.coalesce(F.col("rank").try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))
    tier = F.coalesce(F.col("risk_tier").cast("string"), F.lit("UNKNOWN"))
    model = F.col("model_version") if "model_version" in df.columns else F.lit(None).cast("string")
    model = F.coalesce(model, F.lit(DEFAULT_MODEL))
    error = _text(df, "error")
    when = _time_text(df)
    pending = F.lower(action).rlike("review|hold|verification")
    decision = F.when(pending, "PENDING_HUMAN_REVIEW").otherwise("NOT_RECORDED")
    keep = [c for c in ("event_id", "investigation_source", "tool_calls", "summary", "action_source") if c in df.columns]
    hashed = canonical_text([when, F.col("account_id"), model, F.when(proba.isNotNull(), F.format_string("%.6f", proba)), rank, tier, action])
    flag = lambda c: truthy_flag(c) if c in df.columns else F.lit(False)
    return df.select(
        *keep, "timestamp", "account_id", model.alias("model_version"), proba.alias("proba"), rank.alias("rank"),
        tier.alias("risk_tier"), flag("top_k_flag").alias("top_k_flag"), action.alias("action_recommended"),
        flag("case_report_generated").alias("case_report_generated"),
        F.sha2(hashed, 256).alias("input_data_hash"), F.lit(threshold).cast("double").alias("threshold_used"),
        decision.alias("human_decision"),
        F.when(error != "", "ERROR").when(pending, "PENDING_REVIEW").otherwise("RECORDED").alias("outcome"),
        F.when(error != "", error).otherwise("none").alias("error_path"),
    )


def is_investigation(df: DataFrame) -> F.Column:
    source = _text(df, "investigation_source")
    return source.isin("llm", "deterministic") | (_text(df, "tool_calls") != "") | (_text(df, "summary") != "")


def audit_page(rows: DataFrame, page: int, per_page: int, order: list[F.Column]) -> DataFrame:
    """Rows of one page, without sorting everything in one task."""
    numbered = ranked(rows, order, name="n")
    return numbered.filter((F.col("n") > (page - 1) * per_page) & (F.col("n") <= page * per_page))


def tier_counts(queue: DataFrame) -> DataFrame:
    """Rows per tier, zero tiers included."""
    per = queue.groupBy("risk_tier").agg(F.count("*").alias("n"))
    tiers = queue.sparkSession.createDataFrame([(t,) for t in TIERS], "risk_tier STRING")
    return tiers.join(per, "risk_tier", "left").select("risk_tier", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def tier_trend(rows: DataFrame, buckets: int = 14) -> DataFrame:
    """Audit rows per tier in equal time slices of the tier's own span, empty slices included."""
    t = F.unix_millis(F.col("timestamp").cast("timestamp"))
    timed = rows.filter(F.col("timestamp").isNotNull()).select("risk_tier", t.alias("t"))
    span = timed.groupBy("risk_tier").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1))
    slot = F.least(F.lit(buckets - 1), F.floor((F.col("t") - F.col("lo")) / width * (buckets - 1)))
    filled = timed.join(span, "risk_tier").groupBy("risk_tier", slot.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    dense = span.select("risk_tier", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return dense.join(filled, ["risk_tier", "bucket"], "left").select(
        "risk_tier", "bucket", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def latest_rows(rows: DataFrame, tie: str, n: int = 12) -> DataFrame:
    """The n newest rows (a distributed top-k)."""
    return rows.filter(F.col("timestamp").isNotNull()).orderBy(F.col("timestamp").desc(), F.col(tie).desc()).limit(n)
