"""Arrow batch functions that also run where the package is not installed."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIPPED: set[str] = set()
pa.set_memory_pool(pa.system_memory_pool())  # returns freed batches at once, so idle workers stay small


def row_ids(docs: DataFrame) -> Column:
    """The place of each row in a stored table, alike in every scan of it.

    How files are split follows the number of registered cores unless that is fixed, and cores
    come and go; so it is fixed once per session. Large tables are split by size anyway.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return F.monotonically_increasing_id()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    # Batches of whole documents lie outside the JVM's heap, so their bytes are bounded too.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    root = pathlib.Path(__file__).resolve().parents[1]
    path = pathlib.Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with the package's code at hand on every executor."""
    ship(df.sparkSession)
    if isinstance(schema, list):
        schema = T.StructType(schema)
    return df.mapInArrow(fn, schema)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column has yet."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def groups(batches, key: str):
    """Complete runs of rows with equal ``key`` from batches sorted by it, one table each.

    Runs must be of bounded size; only the last run of a batch waits for the next one.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        keys = table.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts, starts[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(starts[-1]) if len(keys) else rest
    if rest is not None and rest.num_rows:
        yield rest


def matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long binary values as a matrix of numbers."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    rows = values.to_pylist()
    width = max(map(len, rows), default=0)
    data = b"".join(r if len(r) == width else r.ljust(width, b"\0") for r in rows)
    return np.frombuffer(data, kind).reshape(len(rows), -1)


def good_vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors are present and hold finite numbers only, and those vectors."""
    keep, out = np.zeros(len(column), bool), []
    for k, v in enumerate(column):
        if not v.is_valid:
            continue
        x = v.values
        if x.null_count:
            continue
        x = x.to_numpy(zero_copy_only=False)
        if np.isfinite(x).all():
            keep[k] = True
            out.append(x)
    return keep, out
