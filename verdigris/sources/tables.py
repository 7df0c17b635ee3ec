"""Reading and writing the commerce tables and result artifacts."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.exprs import to_timestamp_or_null


def coerce_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unreadable timestamps become null, in one projection."""
    return df.withColumns({c: to_timestamp_or_null(c) for c in columns if c in df.columns})


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema, columns found by name; unreadable values turn into nulls.

    Columns may come in any order and more may be there; a missing one is an error.
    """
    raw = spark.read.csv(path, header=True)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return raw.select(
        *[
            (to_timestamp_or_null(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    return read_csv(spark, path, schema) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """The table, or an empty frame of the same schema when it is absent or not readable.

    Parquet and ORC footers are read when opening, so a corrupt file shows here and not later.
    """
    try:
        if path_exists(spark, path):
            if fmt in ("parquet", "orc"):
                spark.read.option("mergeSchema", True).format(fmt).load(path)
            return read_table(spark, path, schema, fmt)
    except (PySparkException, Py4JJavaError):
        pass
    return spark.createDataFrame([], schema)


def missing_artifacts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row per required input with its presence."""
    rows = [(name, path_exists(spark, p)) for name, p in sorted(paths.items())]
    return spark.createDataFrame(rows, "artifact STRING, present BOOLEAN")


def artifact_report(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Presence of each required input and, where present, its row count."""
    out = missing_artifacts(spark, paths)
    counts = None
    for name, path in paths.items():
        if path_exists(spark, path):
            one = spark.read.format(fmt).load(path).agg(F.lit(name).alias("artifact"), F.count("*").alias("n_rows"))
            counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        return out.withColumn("n_rows", F.lit(None).cast("bigint"))
    return out.join(counts, "artifact", "left")


def write_csv(df: DataFrame, path: str, single_file: bool = False, partition_by: list[str] | None = None) -> None:
    """CSV with header. ``single_file`` is for small reports only."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON metrics; an absent file or corrupt lines give no rows."""
    try:
        if not path_exists(spark, path):
            return spark.createDataFrame([], schema)
        full = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
        raw = (
            spark.read.schema(full)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt")
            .json(path)
        )
        return raw.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_widening(existing: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Union by name; columns only one side has are null on the other."""
    return existing.unionByName(new_rows, allowMissingColumns=True)


def truncate_table(spark: SparkSession, path: str) -> None:
    """Remove the rows of a stored table and keep its schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def rows_for_account(df: DataFrame, account_id) -> DataFrame:
    """One account, as a filter the scan can take. For many accounts join instead."""
    return df.filter(F.col("account_id") == F.lit(account_id))


def rows_for_accounts(df: DataFrame, accounts: DataFrame) -> DataFrame:
    return df.join(accounts.select("account_id").distinct(), "account_id", "left_semi")
