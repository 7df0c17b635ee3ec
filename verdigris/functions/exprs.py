"""Column expressions used across the jobs. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value) -> Column:
    """Timestamp literal, or a column cast to timestamp."""
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value.cast("timestamp")


def micros(c: str | Column) -> Column:
    """Whole microseconds since the epoch; the session clock is UTC."""
    return F.unix_micros(col(c).cast("timestamp"))


def to_timestamp_or_null(c: str | Column) -> Column:
    """Text to timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(col(c).cast("string"))


def safe_div(num: Column, den: Column) -> Column:
    """num / den as double, 0 where the denominator is not positive (or null)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def number_or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def finite_or_zero(c: str | Column) -> Column:
    x = col(c).cast("double")
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(x.isNull() | bad, F.lit(0.0)).otherwise(x)


def nonblank(c: str | Column) -> Column:
    return F.coalesce(F.length(F.trim(col(c))) > 0, F.lit(False))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def truthy(c: str | Column) -> Column:
    """Evidence text to boolean: blank or null is false, unknown text is true."""
    word = F.lower(F.trim(col(c).cast("string")))
    return (
        F.when(word.isNull(), F.lit(False))
        .when(word.isin("true", "yes", "available", "1"), F.lit(True))
        .when(word.isin("false", "no", "missing", "0"), F.lit(False))
        .when(word.try_cast("double").isNotNull(), word.try_cast("double") != 0)
        .otherwise(F.length(word) > 0)
    )


def truthy_flag(c: str | Column) -> Column:
    """Audit flags: only true/1/yes/y count."""
    word = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(word.isin("true", "1", "yes", "y"), F.lit(False))


def tier_of_rank(rank: Column, limits) -> Column:
    out = None
    for top, name in limits:
        out = F.when(rank <= top, name) if out is None else out.when(rank <= top, name)
    return out.otherwise("LOW")


def tier_of_score(score: Column, limits) -> Column:
    out = None
    for low, name in limits:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return out.otherwise("LOW")


def sql_literal(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def map_literal(table: dict) -> Column:
    """A constant dictionary as one map expression (one call into the JVM)."""
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in table.items()) + ")")


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a constant dictionary; null (or the default) when the key is absent."""
    found = F.try_element_at(map_literal(table), c)
    return found if default is None else F.coalesce(found, default)


def non_null_array(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def mask_email(c: str | Column) -> Column:
    x = col(c)
    name = F.substring_index(x, "@", 1)
    domain = F.expr(f"substring({_sql(c)}, instr({_sql(c)}, '@') + 1)")
    hidden = F.when(F.length(name) <= 2, F.repeat(F.lit("*"), F.length(name))).otherwise(
        F.concat(F.left(name, F.lit(1)), F.lit("***"), F.right(name, F.lit(1)))
    )
    return (
        F.when(x.isNull() | (x == ""), F.lit(None).cast("string"))
        .when(~x.contains("@"), F.lit("***"))
        .otherwise(F.concat(hidden, F.lit("@"), domain))
    )


def mask_contact(c: str | Column) -> Column:
    x = col(c)
    digits = F.regexp_replace(x, "[^0-9]", "")
    return (
        F.when(x.isNull() | (x == ""), F.lit(None).cast("string"))
        .when(F.length(digits) < 4, F.lit("***"))
        .otherwise(F.concat(F.lit("***"), F.right(digits, F.lit(4))))
    )


def pseudonym(prefix: str, c: str | Column) -> Column:
    """First 16 hex digits of sha-256 over prefix + value."""
    return F.substring(F.sha2(F.concat(F.lit(prefix), col(c).cast("string")), 256), 1, 16)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _sql(c: str | Column) -> str:
    if not isinstance(c, str):
        raise TypeError("pass the column by name")
    return f"`{c}`"
