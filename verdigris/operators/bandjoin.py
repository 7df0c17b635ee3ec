"""Pairs of ids that used the same key within a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.skew import CELL_ROWS, grid_sides
from verdigris.session import materialize

LIGHT_CELLS = 256  # an id with more buckets carries no list of them
_MANY = 1 << 30
_RING = (1 << 31) - 1


def time_cells(
    events: DataFrame, keys: list[str], id_col: str, time_us: str, window_us: int
) -> DataFrame:
    """First and last event per (keys, id, bucket), buckets as long as the window.

    This is all the pair test needs: two ids in one bucket are always within the window; in
    neighboring buckets the closest events are the last of the earlier and the first of the
    later; buckets further apart never match. Repeated events of one id fold away map-side.
    """
    usable = F.col(time_us).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    return (
        events.filter(usable)
        .select(
            *keys,
            F.col(id_col).alias("id"),
            F.col(time_us).alias("t"),
            F.floor(F.col(time_us) / F.lit(window_us)).cast("bigint").alias("bucket"),
        )
        .groupBy(*keys, "id", "bucket")
        .agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    )


def _sides(
    cells: DataFrame, keys: list[str], cell_rows: int, carried: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the meeting of ids, and the columns to join on; ``carried`` ones come as a_*, b_*.

    Step 0 meets the ids of a bucket, step 1 those of a bucket (a) and of the next one (b).
    """
    earlier = cells.select(*keys, "bucket", F.col("id").alias("a"), F.col("last_t").alias("a_last"), *[F.col(c).alias(f"a_{c}") for c in carried])
    later = cells.select(
        *keys,
        F.col("id").alias("b"),
        F.col("first_t").alias("b_first"),
        *[F.col(c).alias(f"b_{c}") for c in carried],
        F.explode(F.array(F.lit(0), F.lit(1))).alias("step"),
        F.col("bucket").alias("own_bucket"),
    ).select(*keys, (F.col("own_bucket") - F.col("step")).alias("bucket"), "b", "b_first", *[f"b_{c}" for c in carried], "step")
    # A bucket meets itself and the next one: no side is crowded where no bucket holds half a cell.
    full = cells.groupBy(*keys, "bucket").count().filter(F.col("count") * 2 > cell_rows)
    if full.isEmpty():
        return earlier, later, [*keys, "bucket"]
    return grid_sides(earlier, later, [*keys, "bucket"], "a", "b", cell_rows)


def _close(window_us: int) -> F.Column:
    same = (F.col("step") == 0) & (F.col("a") < F.col("b"))
    next_door = (
        (F.col("step") == 1)
        & (F.col("a") != F.col("b"))
        & (F.col("b_first") - F.col("a_last") <= F.lit(window_us))
    )
    return same | next_door


def close_pairs(
    events: DataFrame, keys: list[str], id_col: str, time_us: str, window_us: int, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(keys, id_1 < id_2) for ids with two events at most ``window_us`` apart. May repeat.

    A crowded bucket is compared in a grid of cells of at most about ``cell_rows`` ids a side.
    """
    cells = materialize(time_cells(events, keys, id_col, time_us, window_us), "cells")
    left, right, on = _sides(cells, keys, cell_rows)
    return left.join(right, on).filter(_close(window_us)).select(
        *keys, F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2")
    )


def _code(keys: list[str], bucket: F.Column) -> F.Column:
    """A code of a bucket; the one of the next bucket is its successor in a ring."""
    return F.pmod(F.hash(*keys).cast("bigint") + bucket, F.lit(_RING)).cast("int")


def met_once(
    events: DataFrame, keys: list[str], id_col: str, time_us: str, window_us: int,
    known: DataFrame | None = None, cell_rows: int = CELL_ROWS, light: int = LIGHT_CELLS,
) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``close_pairs`` whatever the key, as two tables (id_1, id_2) that share no pair.

    Pairs of the first table come once each, without an exchange of pairs to tell them apart; the
    second may repeat pairs and holds few. Every row carries its id's buckets as codes. The span
    of an id is its buckets and the ones after them: two ids met in one bucket have two places of
    their spans in common, ids met in neighboring buckets one, and a pair with no more in common
    has no other meeting. Pairs with more, and those of an id with more than ``light`` buckets, go
    to the second table, as do the pairs of ``known`` (id_1 < id_2, distinct) and those of an
    id_1 with more than ``light`` of them. Codes have 31 bits: a chance match sends a pair to the
    second table; only one between two common places of one pair could repeat it.
    """
    cells = materialize(time_cells(events, keys, id_col, time_us, window_us), "cells")
    few = cells.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") <= light).select("id")
    own = cells.join(few, "id", "left_semi").groupBy("id").agg(F.collect_set(_code(keys, F.col("bucket"))).alias("at"))
    carried = ("at",)
    if known is not None:
        carried = ("at", "more")
        none = F.array().cast(f"array<{cells.schema['id'].dataType.simpleString()}>")
        sizes = known.groupBy(F.col("id_1").alias("id")).agg(F.count("*").alias("n"))
        listed = known.withColumnRenamed("id_1", "id").join(sizes.filter(F.col("n") <= light), "id", "left_semi")
        more = listed.groupBy("id").agg(F.collect_set("id_2").alias("more"))
        many = sizes.filter(F.col("n") > light).select("id", F.lit(True).alias("many"))
        own = own.join(more, "id", "left").join(many, "id", "left").select(
            "id", "at", F.when(F.col("many").isNull(), F.coalesce("more", none)).alias("more")
        )
    rows = materialize(cells.join(own, "id", "left"), "placed-cells")
    left, right, on = _sides(rows, keys, cell_rows, carried)

    def spans(side: DataFrame, name: str) -> DataFrame:
        # Laid out for the join first, so that the wider spans are not sent.
        after = F.transform(name + "_at", lambda x: F.pmod(x + 1, F.lit(_RING)).cast("int"))
        return side.repartition(*on).withColumn(f"{name}_span", F.array_distinct(F.concat(f"{name}_at", after)))

    left = spans(left, "a").withColumn("a_stays", F.array_contains("a_at", _code(keys, F.col("bucket") + 1))).drop("a_at")
    right = spans(right, "b").withColumn("b_came", F.array_contains("b_at", _code(keys, F.col("bucket")))).drop("b_at")
    common = F.coalesce(F.array_size(F.array_intersect("a_span", "b_span")), F.lit(_MANY))
    # In step 1, a stays into b's bucket or b comes from a's: the two also meet in one bucket.
    alone = (F.col("step") == 1) & ~F.coalesce(F.col("a_stays") | F.col("b_came"), F.lit(True))
    first = common == F.when(F.col("step") == 0, F.lit(2)).otherwise(F.lit(1))
    rest = common >= F.when(alone, F.lit(2)).otherwise(F.lit(3))
    if known is not None:
        lists = F.when(F.col("a") < F.col("b"), F.col("a_more")).otherwise(F.col("b_more"))
        in_known = F.coalesce(F.array_contains(lists, F.greatest("a", "b")), F.lit(True))
        first, rest = ~in_known & first, in_known | rest
    met = left.join(right, on).filter(_close(window_us))
    pair = [F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2")]
    return met.filter(first).select(*pair), met.filter(rest).select(*pair)
