"""Reproducible shuffle and shards: a Feistel permutation of global row numbers.

Only narrow rows (id, size, checksum) move. They are numbered 0..N-1 in a total order that
does not depend on files or partitions; a keyed permutation of 0..N-1 gives each row its place
in the shuffle, and place p lies in shard p mod S at slot p div S. Whoever knows N and the key
can compute the shard and slot of any row number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.session import materialize

KEY = 20_240_229
ROUND_PAIRS = 4
WALK = 64
# (factor, offset, modulus) of the round function's three steps.
STEPS = ((1103515245, 12345, 2147483647), (69621, 7, 2147483629), (48271, 11, 2147483587))


def sides(n: int) -> tuple[int, int]:
    """Near-square a x b >= n; a * b - n < a, so almost no place needs a second walk."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(half: Column, key: Column) -> Column:
    """Mixes one half with a round key; integer steps any engine can repeat."""
    x = half + key
    for factor, offset, modulus in STEPS:
        x = F.pmod(x * F.lit(factor) + F.lit(offset), F.lit(modulus))
    return x


def permuted(number: Column, n: int, key: int = KEY) -> Column:
    """Place of row ``number`` in a keyed permutation of 0..n-1.

    The halves live in Z_a x Z_b. A value that leaves 0..n-1 walks on until it is back; it can
    meet at most a*b-n strangers, and beyond WALK of them the odds are under n**-32, which
    raises an error instead of giving a wrong place.
    """
    a, b = sides(n)
    keys = F.array(*[F.lit((key * (2 * r + 1) + r * 7919) % 1_000_003) for r in range(ROUND_PAIRS)])

    def pair(state: Column, k: Column) -> Column:
        left = F.pmod(state["l"] + _round(state["r"], k), F.lit(a))
        return F.struct(left.alias("l"), F.pmod(state["r"] + _round(left, k + F.lit(1_000_003)), F.lit(b)).alias("r"))

    def once(p: Column) -> Column:
        start = F.struct(((p - F.pmod(p, F.lit(b))) / F.lit(b)).cast("long").alias("l"), F.pmod(p, F.lit(b)).alias("r"))
        return F.aggregate(keys, start, pair, lambda s: s["l"] * F.lit(b) + s["r"])

    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(min(a * b - n, WALK) + 1)),
        F.lit(-1).cast("long"),
        lambda p, turn: F.when((turn > 1) & (p < F.lit(n)), p).otherwise(once(F.when(turn > 1, p).otherwise(number))),
    )
    return F.when(walk < F.lit(n), walk).otherwise(F.raise_error(F.lit("the walk of a place did not end")).cast("long"))


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> tuple[DataFrame, int]:
    """Global row numbers 0..N-1 in the given order, and N.

    Range partitions are sorted and stored; a row's number is its place in its partition plus
    the rows of the partitions before. Equal rows may swap numbers. ``rows`` should be stored.
    """
    tie = F.monotonically_increasing_id()
    ranged = rows.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    stored = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    total = stored.count()
    out = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.select(*rows.columns, (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")).alias(name)), total


def shard_rows(
    docs: DataFrame, shards: int = 8, key: int = KEY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    The law is ``rows``: shard sizes differ by at most one and slots are gapless from 0;
    grown_shard is null. Size is the UTF-8 length plus 1; a null text has size 1 and the
    checksum of no bytes (0). Rows are numbered by (id, checksum, size), null ids first;
    repeated rows each get a place. An empty table gives an empty table; other columns are
    ignored. Reruns agree whatever the files' order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(materialize(narrow, "sizes"), [id_col, "text_crc32", "size"])
    placed = rows.withColumn("_place", permuted(F.col("number"), n, key))
    return placed.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
