"""Pairs within groups whose size is not bounded: a group is joined with itself block by block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2000  #: rows of a block; one key of the join meets BLOCK rows on either side at most


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group, 0 for no rows. Counts combine before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n


def pairs_within(df: DataFrame, keys: Sequence[str], key: str, where: Column, block: int | None = None) -> DataFrame:
    """Every two rows of a group with different `key` for which `where` holds, once, the smaller key as a, the other as b.

    `where` names the rows' columns as a.* and b.*; the result has them under the aliases a and b, as structs. With
    `block`, a group of n rows is cut by the hash of `key` into ceil(n / block) blocks and every two blocks meet
    under a key of their own, so that the work of a hot group is spread over many tasks; without it a group is one key
    of the join. The pairs are the same. Rows with a null in the group's columns or in `key` have no partner.
    """
    rows = df.where(F.col(key).isNotNull()).select(*keys, F.struct(*df.columns).alias("r"))
    if block is None:
        i, j, sides = [], [], (rows, rows)
        order = F.col(f"a.{key}") < F.col(f"b.{key}")
    else:
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_n")).where("_n > 1")
        cut = rows.join(sizes, list(keys), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
        cut = cut.withColumn("_k", F.pmod(F.xxhash64(f"r.{key}"), F.col("_n")))
        first = cut.withColumn("_i", F.col("_k")).withColumn("_j", F.explode(F.sequence(F.col("_k"), F.col("_n") - 1)))
        second = cut.withColumn("_j", F.col("_k")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k"))))
        i, j, sides = ["_i"], ["_j"], (first, second)
        order = (F.col("_i") < F.col("_j")) | (F.col(f"a.{key}") < F.col(f"b.{key}"))
    on = [*keys, *i, *j]
    met = sides[0].select(*on, F.col("r").alias("a")).join(sides[1].select(*on, F.col("r").alias("b")), on).where(order)
    swap = F.col(f"a.{key}") > F.col(f"b.{key}")
    named = met.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    return named.where(where)
