"""Session settings and shared scratch storage for long jobs."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN_ROOTS: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """UTC session clock, adaptive execution with skew splitting."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored/{spark.sparkContext.applicationId}"
    if root not in _OWN_ROOTS:
        _OWN_ROOTS.add(root)
        # Nobody asked for these files to stay; a local session takes them along when it ends.
        atexit.register(shutil.rmtree, root.removeprefix("file://").removeprefix("file:"), True)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once to shared storage and read back.

    Cuts the lineage of iterative jobs. Later reads survive the loss of any executor and
    prune columns, which an RDD checkpoint cannot.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and no later step reads."""
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path is not None:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            df._stored_at = None
