"""Evidence, queue, sources, streaming split and the query registry."""

import os

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from verdigris.constants import EVIDENCE_FIELDS
from verdigris.operators import investigation as N
from verdigris.operators.community_features import checked_join
from verdigris.sources import schemas, tables
from verdigris.streaming.payments import split_stream

SMALL = "/root/testdata/sf0.001"


def test_latest_dispute_tie_goes_to_larger_id(spark):
    data = [(1, 5, "2000-01-01 00:00:00", True), (1, 9, "2000-01-01 00:00:00", False), (1, 2, "1999-01-01 00:00:00", True)]
    df = spark.createDataFrame(data, "account_id INT, dispute_id INT, s STRING, ok BOOLEAN").select(
        "account_id", "dispute_id", F.col("s").cast("timestamp").alias("dispute_created_at"), *[F.col("ok").alias(c) for c in EVIDENCE_FIELDS]
    )
    flagged = spark.createDataFrame([(1,), (2,)], "account_id INT")
    got = {r["account_id"]: r for r in N.evidence_gap(flagged, df).collect()}
    assert got[1]["missing_evidence_count"] == 6 and got[2]["proof_of_service"] == "NO_DISPUTE_YET" and got[2]["missing_evidence_count"] is None


def test_link_pages_keep_every_link(spark):
    edges = spark.createDataFrame([(0, i, "shares_device", 1.0) for i in range(1, 26)], "account_id_1 INT, account_id_2 INT, edge_type STRING, weight DOUBLE")
    focus = spark.createDataFrame([(0,)], "account_id INT")
    pages = N.link_pages(N.numbered_links(focus, edges), page_size=10)
    assert pages.count() == 3 and N.parse_links(pages).count() == 25


def test_checked_join_refuses_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "account_id INT")
    with pytest.raises(ValueError):
        checked_join(a, a.distinct(), ["account_id"])
    assert checked_join(a, a.distinct(), ["account_id"], validate="many_to_one").count() == 2


def test_tolerant_reads(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w") as f:
        f.write("account_id,account_created_at,customer_type\nA1,2020-01-01 00:00:00,new\nA2,not a time,new\n")
    got = rows(tables.read_csv(spark, path, schemas.ACCOUNTS).select("account_id", F.col("account_created_at").isNull().alias("bad")))
    assert got == [("A1", False), ("A2", True)]
    assert tables.read_or_empty(spark, path + ".none", schemas.ACCOUNTS).count() == 0
    broken = str(tmp_path / "m.json")
    with open(broken, "w") as f:
        f.write('{"n": 1}\n{oops\n')
    schema = spark.range(1).selectExpr("id AS n").schema
    assert rows(tables.read_metrics(spark, broken, schema)) == [(1,)]


def test_payment_stream_splits_everything(spark, tmp_path):
    src = str(tmp_path / "in")
    data = [(1, "p1", "payment", 5.0, "INR", "ok", "card", "o", "abc@x", "+911234"), (2, None, "payment", -1.0, "INR", "ok", "card", "o", None, None)]
    cols = "row_number BIGINT, id STRING, entity STRING, amount DOUBLE, currency STRING, status STRING, method STRING, order_id STRING, email STRING, contact STRING"
    spark.createDataFrame(data, cols).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    good, bad, state = (str(tmp_path / n) for n in ("good", "bad", "state"))
    for q in split_stream(stream, good, bad, state, "req"):
        q.awaitTermination(60)
    assert spark.read.parquet(good).count() == 1
    row = spark.read.parquet(bad).first()
    assert row["row_number"] == 2 and len(row["failed_fields"]) == 2


def test_registry_shape():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 193


FAST = [
    "s2_timestamp_coercion", "f2_delivery_status", "b11_rates", "t10_creation_burst", "i1_entity_map", "e1_identity_edges",
    "m4_cost_threshold", "p1_ring_split", "n7_evidence_gap", "v1_payment_validation", "q8_time_conflicts", "u2_tier_trend", "a10b_parsed_text",
]


@pytest.mark.parametrize("name", FAST if not os.environ.get("ALL_QUERIES") else sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    from tools.check_oracle import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"
