"""Two-way grids for joins on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_ROWS = 8_192


def grid_sides(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, cell_rows: int = CELL_ROWS
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join on ``keys``, cut for it, and the columns to join on.

    The rows of a crowded key form a grid: left rows are cut into slices and copied to every
    slice of the right, right rows likewise, so that no cell holds more than about
    ``cell_rows`` of either side while each pair of rows meets in exactly one cell. Both sides
    are read twice and should be stored tables; other keys stay whole. Crowded keys are at most
    a share of 1 / ``cell_rows`` of the rows; they are joined like any table.
    """
    slices = lambda df, name: (
        df.groupBy(*keys).count().filter(F.col("count") > cell_rows)
        .select(*keys, F.ceil(F.col("count") / F.lit(cell_rows)).cast("int").alias(name))
    )
    many_left, many_right = slices(left, "_rows"), slices(right, "_cols")
    crowded = many_left.join(many_right, keys, "full")
    on = [*keys, "_row", "_col"]
    if crowded.isEmpty():
        zero = [F.lit(0).alias("_row"), F.lit(0).alias("_col")]
        return left.select("*", *zero), right.select("*", *zero), on
    rows, cols = F.coalesce("_rows", F.lit(1)), F.coalesce("_cols", F.lit(1))
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l = left.join(crowded, keys, "left").withColumn("_row", place(left_id, rows)).withColumn("_col", every(cols))
    r = right.join(crowded, keys, "left").withColumn("_col", place(right_id, cols)).withColumn("_row", every(rows))
    return l.drop("_rows", "_cols"), r.drop("_rows", "_cols"), on
