"""Faults found in review, each with the input that showed it."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators import address, cleansing, graph_metrics, rings, splits
from verdigris.session import discard, materialize
from verdigris.sources import tables

SCHEMA = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("community_id", T.LongType()),
    T.StructField("seen", T.TimestampType()),
])


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("extra,community_id,seen,account_id\nx,7,2024-01-02 03:04:05,a1\ny,oops,never,a2\n")
    got = {r.account_id: (r.community_id, r.seen) for r in tables.read_csv(spark, str(path), SCHEMA).collect()}
    assert got["a1"][0] == 7 and got["a1"][1] is not None and got["a2"] == (None, None)


def test_csv_without_a_required_column_is_an_error(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("account_id,seen\na1,2024-01-02\n")
    with pytest.raises(ValueError, match="community_id"):
        tables.read_csv(spark, str(path), SCHEMA)


def test_corrupt_parquet_reads_as_empty(spark, tmp_path):
    folder = tmp_path / "t.parquet"
    folder.mkdir()
    (folder / "part-0.parquet").write_bytes(b"not a parquet file at all")
    assert tables.read_or_empty(spark, str(folder), SCHEMA, "parquet").count() == 0


def test_truncate_keeps_the_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).withColumn("x", F.lit("a")).write.parquet(path)
    tables.truncate_table(spark, path)
    left = spark.read.parquet(path)
    assert left.count() == 0 and left.columns == ["id", "x"]


def test_null_address_text_gets_a_decision(spark):
    records = spark.createDataFrame([("r1", "12 mg road, indiranagar, bengaluru 560038", "bengaluru", "karnataka", "560038")], "address_id string, canonical_address string, city string, state string, pincode string")
    asked = spark.createDataFrame([("1", "12 mg road, indiranagar, bengaluru 560038"), ("2", None), ("3", None)], "query_id string, raw_address string")
    got = {r.query_id: r for r in address.resolve(asked, records).collect()}
    assert set(got) == {"1", "2", "3"} and got["2"].candidate_address_id is None and got["3"].candidate_address_id is None


def test_matrix_check_on_the_real_column(spark):
    m = spark.createDataFrame([("a", 0.5, 0), ("b", 0.5, 2)], "account_id string, return_rate double, total_delivered_orders long")
    assert cleansing.matrix_violations(m).first()["rate_without_delivery"] == 1


def test_unnamed_rings_are_not_dropped(spark):
    truth = spark.createDataFrame([("a", True, "R0"), ("b", True, "R9"), ("c", False, None)], "account_id string, true_ring_member boolean, abuse_ring_id string")
    assert splits.named_ring_split(truth, {"val": ["R0"]}, unnamed="train").count() == 3
    with pytest.raises(Exception, match="R9"):
        splits.named_ring_split(truth, {"val": ["R0"]}).collect()


def test_pagerank_without_convergence_raises(spark):
    accounts = spark.createDataFrame([(k,) for k in range(4)], "account_id long")
    edges = spark.createDataFrame([(0, 1, 1.0, "x"), (1, 2, 1.0, "x"), (2, 3, 1.0, "x")], "account_id_1 long, account_id_2 long, weight double, edge_type string")
    with pytest.raises(RuntimeError, match="converge"):
        graph_metrics.pagerank(accounts, edges, max_iter=2, tol=1e-12)


def test_forbidden_columns_are_reported(spark):
    table = spark.createDataFrame([(1, "x")], f"candidate_id long, {rings.FORBIDDEN_COLUMNS[0]} string")
    found = {r.column_name: (r.present, r.filled_rows) for r in rings.leaked_inputs(table).collect()}
    assert found[rings.FORBIDDEN_COLUMNS[0]] == (True, 1) and not found[rings.FORBIDDEN_COLUMNS[-1]][0]


def test_discarded_tables_are_gone(spark):
    stored = materialize(spark.range(3), "gone")
    path = stored._stored_at
    discard(stored)
    assert not tables.path_exists(spark, path)
