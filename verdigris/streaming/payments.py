"""The payment split on an unbounded input: stateless, so each micro-batch is final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.payments import processed, quarantined, validate


def split_stream(payments: DataFrame, good_path: str, bad_path: str, checkpoint: str, request_id: str) -> tuple[StreamingQuery, StreamingQuery]:
    """Write valid and quarantined payments to two tables; batch id is fixed per stream."""
    checked = validate(payments)
    out = []
    for name, rows, path in (
        ("valid", processed(checked, request_id, request_id), good_path),
        ("quarantine", quarantined(checked, request_id, request_id), bad_path),
    ):
        out.append(
            rows.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True)
            .start()
        )
    return out[0], out[1]
