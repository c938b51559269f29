"""Dimensions: look up or create, nearest match, undirected pairs, and the matrix of collection tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.runtime import bounded_rows, checkpoint


def nearest_window(df: DataFrame, windows: DataFrame, days: str = "advance_days") -> DataFrame:
    """df with window_id and window_code of the nearest booking window; ties go to the lowest display order.

    Windows are a handful of rows (checked), held as an array literal: no join, no shuffle.
    """
    rows = bounded_rows(windows.where("target_advance_days is not null").select("target_advance_days", "display_order", "window_id", "window_code"), 1000)
    if rows is None:
        raise ValueError("more than 1000 booking windows")
    if not rows:
        return df.withColumns({"nearest_window_id": F.lit(None).cast("int"), "nearest_window_code": F.lit(None).cast("string")})
    near = F.array_min(F.array(*[
        F.struct(F.abs(F.col(days) - r.target_advance_days).alias("gap"), F.lit(r.display_order).alias("o"), F.lit(r.window_id).alias("id"), F.lit(r.window_code).alias("code")) for r in rows
    ]))
    known = F.col(days).isNotNull()
    return df.withColumns({"nearest_window_id": F.when(known, near["id"]), "nearest_window_code": F.when(known, near["code"])})


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with `name`: 1, 2, ... in the given order. Ranges are sorted and counted, so that no task has all rows."""
    ranges = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("_range", F.shiftright("_spot", 33))
    counts = ranges.groupBy("_range").agg(F.count("*").alias("n"))  # one row per task
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(counts.select("_range", before.alias("_before")))
    place = F.col("_before") + F.col("_spot").bitwiseAND((1 << 33) - 1) + 1
    return ranges.join(shifts, "_range").withColumn(name, place).drop("_range", "_spot", "_before")


def get_or_create(facts: DataFrame, dimension: DataFrame, code: str, key: str) -> DataFrame:
    """dimension plus a row for each code of `facts` that it lacks (case and outer blanks aside), with dense new keys."""
    asked = facts.select(F.upper(F.trim(code)).alias(code)).where(F.coalesce(code, F.lit("")) != "").distinct()
    there = dimension.select(F.upper(F.trim(code)).alias("_code"))
    missing = asked.join(there, asked[code] == there["_code"], "left_anti")
    top = dimension.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    fresh = numbered(missing, [code], "_n").crossJoin(F.broadcast(top))  # one row: the largest key
    return dimension.unionByName(fresh.select((F.col("_top") + F.col("_n")).cast(dimension.schema[key].dataType).alias(key), code), allowMissingColumns=True)


def undirected_pairs(routes: DataFrame, a: str = "origin_city_id", b: str = "destination_city_id") -> DataFrame:
    """city_a, city_b, routes, route_ids: both directions of a pair of cities as one."""
    return routes.groupBy(F.least(a, b).alias("city_a"), F.greatest(a, b).alias("city_b")).agg(F.count("*").alias("routes"), F.sort_array(F.collect_list("route_id")).alias("route_ids"))


def task_matrix(routes: DataFrame, windows: DataFrame, start: str) -> DataFrame:
    """Every active route with every active window and the travel date it means. Windows are a few rows (checked)."""
    if bounded_rows(windows.where("is_active").select("window_id"), 1000) is None:
        raise ValueError("more than 1000 booking windows")
    w = F.broadcast(windows.where("is_active").select("window_id", "window_code", "target_advance_days", "display_order"))
    return routes.where("is_active").select("route_id", "route_code").crossJoin(w).withColumn("travel_date", F.date_add(F.lit(start).cast("date"), F.col("target_advance_days")))


def remaining_tasks(tasks: DataFrame, done: DataFrame, keys: Sequence[str] = ("route_id", "window_id")) -> DataFrame:
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def top_by(df: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """The k rows with the largest `order` (null counts as 0); ties by `tie`."""
    return df.orderBy(F.coalesce(F.col(order), F.lit(0)).desc(), F.col(tie)).limit(k)
