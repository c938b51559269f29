"""Totals and averages over trailing periods of days, by binary doubling (problem 3).

Each entity gets one row per calendar day. Sums over 1, 2, 4, 8, ... days are built by adding a block to
itself shifted by its own length; a window of any length is the sum of the shifted blocks of its binary digits.
A 30-day window is the 16-, 8-, 4- and 2-day block, each shifted past the ones before it, so the cost of a
window grows with the logarithm of its length and all windows share the blocks, one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks_of(days: int) -> list[tuple[int, int]]:
    """(size, shift) of the blocks that make up a window: 7 -> [(4, 0), (2, 4), (1, 6)]."""
    if days < 1:
        raise ValueError("a window needs at least one day")
    out, shift = [], 0
    for bit in reversed(range(days.bit_length())):
        if days >> bit & 1:
            out.append((1 << bit, shift))
            shift += 1 << bit
    return out


def distinct_facts(df: DataFrame, key: Sequence[str], value: str, order: str) -> DataFrame:
    """One row per key: the non-null value with the lowest `order`, else null. Facts stored again count once."""
    return df.groupBy(*key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def rolling_totals(df: DataFrame, entity: str, day: str, value: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals, counts and averages of `value` over the trailing `windows` of days, for every entity and day.

    Every entity has a row for each day from the first to the last day of the whole table. `day_total` and
    `day_count` describe the day itself, then `total_w`, `count_w`, `avg_w` and `active_days_w` for each w: the sum
    and number of non-null values, their quotient, and the days that have any. The window ends with the day.

    Nulls: a null value counts for nothing; rows whose entity or day is null have no place in a calendar and are
    left out. A day without values has total 0, count 0 and a null average. Rows of one day add up; an empty
    table gives no rows. Other columns are not carried over.
    """
    known = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    facts = known.select(F.col(entity).alias("entity"), F.to_date(day).alias("day"), F.col(value).cast("decimal(20,2)").alias("value"))
    # Partial sums before the shuffle: a hot entity sends one row per day and task.
    daily = facts.groupBy("entity", "day").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    span = facts.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = (
        facts.select("entity").distinct().crossJoin(F.broadcast(span))  # one row: first and last day
        .select("entity", F.explode(F.sequence("lo", "hi")).alias("day"))
    )
    dense = calendar.join(daily, ["entity", "day"], "left").select(
        "entity", "day", F.coalesce("s", F.lit(0)).cast("decimal(28,2)").alias("s1"),
        F.coalesce("n", F.lit(0)).alias("n1"), F.when(F.col("n") > 0, 1).otherwise(0).cast("bigint").alias("a1"),
    )
    order = Window.partitionBy("entity").orderBy("day")

    def shifted(name: str, by: int) -> Column:
        zero = F.lit(0).cast("decimal(28,2)") if name.startswith("s") else F.lit(0).cast("bigint")
        return F.coalesce(F.lag(name, by).over(order), zero) if by else F.col(name)

    size, longest = 1, max(windows)
    while size * 2 <= longest:
        dense = dense.withColumns({
            f"{m}{size * 2}": (F.col(f"{m}{size}") + shifted(f"{m}{size}", size)).cast("decimal(28,2)" if m == "s" else "bigint") for m in "sna"
        })
        size *= 2
    out = [F.col("entity").alias(entity), F.col("day").alias(day), F.col("s1").alias("day_total"), F.col("n1").alias("day_count")]
    for w in windows:
        total, count, active = (sum((shifted(f"{m}{b}", by) for b, by in blocks_of(w)), start=F.lit(0)) for m in "sna")
        out += [total.cast("decimal(28,2)").alias(f"total_{w}"), count.cast("bigint").alias(f"count_{w}"), active.cast("bigint").alias(f"active_days_{w}")]
    result = dense.select(*out)
    for w in windows:
        result = result.withColumn(f"avg_{w}", F.when(F.col(f"count_{w}") > 0, F.col(f"total_{w}").cast("double") / F.col(f"count_{w}")))
    return result
