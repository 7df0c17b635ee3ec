"""Payment intake: validation, quarantine, masking, batch summary.

Everything that looks at one row is a projection or a filter, so it accepts a streaming frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.exprs import mask_contact, mask_email, non_null_array

# Field, error code, message.
CHECKS = {
    "id": ("MISSING_REQUIRED_FIELD", "Payment ID is missing or invalid."),
    "amount": ("INVALID_AMOUNT", "Payment amount must be a positive number."),
    "currency": ("MISSING_CURRENCY", "Currency is missing or invalid."),
    "status": ("MISSING_STATUS", "Payment status is missing or invalid."),
}
FAULT_FIELDS = ["amount", "currency", "status", "id"]


def _failed(field: str) -> F.Column:
    if field == "amount":
        value = F.col("amount").try_cast("double")
        return F.coalesce(F.isnan(value) | (value <= 0), F.lit(True))
    return F.coalesce(F.col(field) == "", F.lit(True))


def validate(payments: DataFrame) -> DataFrame:
    """Add ``errors`` (array of field, code, message) and ``valid``."""
    items = [
        F.when(_failed(f), F.struct(F.lit(f).alias("field"), F.lit(code).alias("code"), F.lit(msg).alias("message")))
        for f, (code, msg) in CHECKS.items()
    ]
    return payments.withColumn("errors", non_null_array(items)).withColumn("valid", F.size("errors") == 0)


def processed(validated: DataFrame, request_id: str, batch_id: str) -> DataFrame:
    return validated.filter("valid").select(
        "row_number", F.col("id").alias("record_id"), F.lit("PROCESSED").alias("status"),
        F.lit(request_id).alias("request_id"), F.lit(batch_id).alias("batch_id"), "amount", "currency",
        F.col("status").alias("payment_status"), "method",
    )


def quarantined(validated: DataFrame, request_id: str, batch_id: str) -> DataFrame:
    """Rejected rows with all errors, the first as reason, and the masked original input."""
    original = F.struct(
        "id", "entity", "amount", "currency", "status", "method", "order_id",
        mask_email("email").alias("email"), mask_contact("contact").alias("contact"),
    )
    return validated.filter(~F.col("valid")).select(
        "row_number", F.col("id").alias("record_id"), F.lit("QUARANTINED").alias("status"),
        F.lit("HUMAN_REVIEW").alias("action"), F.lit(request_id).alias("request_id"),
        F.lit(batch_id).alias("batch_id"), F.col("errors").alias("failed_fields"),
        original.alias("original_input"), F.col("errors")[0]["message"].alias("quarantine_reason"),
    )


def batch_summary(validated: DataFrame) -> DataFrame:
    bad = F.count_if(~F.col("valid"))
    return validated.agg(
        F.count("*").alias("batch_size"), bad.alias("malformed_rows"), bad.alias("quarantined"),
        F.count_if("valid").alias("valid_processed"), bad.alias("human_review_routed"),
    )


def audit_trail(summary: DataFrame) -> DataFrame:
    """The batch's audit events in order."""
    n = lambda c: F.col(c).cast("string")
    items = [
        ("Payment batch received", F.concat(n("batch_size"), F.lit(" payments"))),
        ("Validation completed", F.concat(n("malformed_rows"), F.lit(" records failed validation"))),
        ("Quarantined", F.concat(n("quarantined"), F.lit(" records"))),
        ("Human review routed", F.concat(n("human_review_routed"), F.lit(" records"))),
        ("Valid rows processed", F.concat(n("valid_processed"), F.lit(" records"))),
    ]
    rows = F.array(*[F.struct(F.lit(e).alias("event"), d.alias("details")) for e, d in items])
    return summary.select(F.posexplode(rows).alias("step", "x")).select("step", "x.event", "x.details")


def tag_faults(payments: DataFrame, index: str, first: int = 10) -> DataFrame:
    """Test aid: blank one of four fields, in turn, on the first rows by 0-based index."""
    hit = F.col(index) < first
    turn = F.pmod(F.col(index), F.lit(len(FAULT_FIELDS)))
    fault = F.when(hit, F.element_at(F.array(*[F.lit(f) for f in FAULT_FIELDS]), (turn + 1).cast("int")))
    out = payments.withColumn("fault_field", fault)
    return out.withColumns(
        {f: F.when(F.col("fault_field") == f, F.lit(None)).otherwise(F.col(f)) for f in FAULT_FIELDS}
    )
