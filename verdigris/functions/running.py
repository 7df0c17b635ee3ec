"""Running sums and ranks over a total order, without one task holding a whole group.

``Window.orderBy`` with no partition (or with one giant partition) sorts everything in one
task. Here rows are range-partitioned on (group, order), summed locally, and each partition
gets the totals of the partitions before it. At most one group can continue across a
partition boundary, so the offsets are never more rows than there are partitions and are
safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.session import materialize


def running_sums(
    df: DataFrame, order: list[Column], sums: dict[str, Column], group: list[str] | None = None
) -> DataFrame:
    """Add inclusive running sums. ``order`` plus ``group`` must be a total order."""
    group = group or []
    keys = [F.col(g) for g in group]
    names = list(sums)
    staged = df.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()])
    staged = staged.repartitionByRange(*[k.asc() for k in keys], *order)
    staged = materialize(staged.withColumn("_pid", F.spark_partition_id()), "range")

    local = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = staged.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in names])

    parts = staged.groupBy("_pid", *group).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_pid")
    offsets = (
        parts.select(
            "_pid",
            *group,
            F.row_number().over(first).alias("_nth"),
            *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in names],
        )
        .filter("_nth > 1")
        .drop("_nth")
    )
    cond = rows["_pid"] == offsets["_pid"]
    for g in group:
        cond = cond & rows[g].eqNullSafe(offsets[g])
    joined = rows.join(F.broadcast(offsets), cond, "left")
    keep = [rows[c] for c in df.columns]
    return joined.select(
        *keep,
        *[(rows[f"_l_{n}"] + F.coalesce(offsets[f"_o_{n}"], F.lit(0))).alias(n) for n in names],
    )


def ranked(
    df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "rank"
) -> DataFrame:
    """1-based row number over a total order, whole table or per group."""
    return running_sums(df, order, {name: F.lit(1).cast("bigint")}, group)


def top_rows(df: DataFrame, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows with their rank: a distributed top-k, then a window over n rows."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group.

    Values are folded to counts and located by running totals, so no task holds a group the
    way the ``percentile`` aggregate does.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    run = running_sums(counts, [F.col(value).asc()], {"_upto": F.col("_n")}, group)
    totals = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("_total"))
    j = run.join(totals, group)

    def at(index: Column) -> Column:
        return F.max(F.when((index >= F.col("_upto") - F.col("_n")) & (index < F.col("_upto")), F.col(value)))

    aggs = []
    for name, q in wanted.items():
        place = (F.col("_total") - 1) * F.lit(float(q))
        aggs += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    found = j.groupBy(*group).agg(F.first("_total").alias("_total"), *aggs)
    cols = []
    for name, q in wanted.items():
        place = (F.col("_total") - 1) * F.lit(float(q))
        part = place - F.floor(place)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * part).alias(name))
    return found.select(*group, *cols)
