"""The route basket: directed traffic of city pairs, its weights and its checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.text import short_code

#: Columns of a basket sheet and their types (fixed values).
COLUMNS = {
    "Rank": "int", "City 1": "string", "City 2": "string", "Passengers To City 2": "bigint", "Passengers From City 2": "bigint", "Total Route Traffic": "bigint", "Share of Total Traffic": "decimal(12,8)",
    "Basket Weight": "decimal(12,10)", "Reference Period": "string", "Source Organization": "string", "Access Layer": "string",
}
NAMES = ("rank", "city_1", "city_2", "passengers_to", "passengers_from", "total_traffic", "share", "weight", "period", "organization", "access_layer")


def typed_basket(rows: DataFrame) -> DataFrame:
    """A sheet's rows (COLUMNS as strings) typed and named by NAMES, with `error`: what is wrong with a row, null if nothing."""
    casts = [F.col(f"`{c}`").try_cast(t) for c, t in COLUMNS.items()]
    out = rows.select(*[x.alias(n) for x, n in zip(casts, NAMES)])
    lacking = [F.when(F.col(n).isNull(), F.lit(f"{n} is missing or no {t}")) for n, t in zip(NAMES, COLUMNS.values())]
    return out.withColumn("error", F.coalesce(*lacking, F.when(F.col("passengers_to") + F.col("passengers_from") != F.col("total_traffic"), "to and from are not the total")))


def require(rows: DataFrame) -> DataFrame:
    """rows without `error`; a row that has one is an error of the job, which thereby stores nothing."""
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "city_1", "city_2", "error"))).otherwise(F.lit(True))
    return rows.where(checked).drop("error")


def undirected(directed: DataFrame) -> DataFrame:
    """city_a, city_b, passengers_to, passengers_from, total_traffic: the traffic (origin, destination, passengers) of both ways of a pair."""
    a, b = F.least("origin", "destination"), F.greatest("origin", "destination")
    way = lambda x: F.coalesce(F.sum(F.when(F.col("origin") == x, F.col("passengers"))), F.lit(0))
    pairs = directed.where("origin <> destination").withColumns({"city_a": a, "city_b": b})
    out = pairs.groupBy("city_a", "city_b").agg(way(F.col("city_a")).alias("passengers_to"), way(F.col("city_b")).alias("passengers_from"))
    return out.withColumn("total_traffic", F.col("passengers_to") + F.col("passengers_from"))


def weighted(pairs: DataFrame) -> DataFrame:
    """pairs with weight_raw = traffic / total and weight, to 8 places half up; none if the total is 0."""
    total = pairs.agg(F.sum("total_traffic").alias("_total"))
    raw = (F.col("total_traffic") / F.col("_total")).cast("decimal(20,16)")
    return pairs.crossJoin(F.broadcast(total)).where("_total > 0").select(*pairs.columns, raw.alias("weight_raw"), F.round(raw, 8).alias("weight"))  # one row: the total


def with_codes(pairs: DataFrame, codes: Mapping[str, str], columns: Sequence[str] = ("city_a", "city_b")) -> DataFrame:
    """pairs with <column>_code: the code of the city's name or alias, else its first three letters."""
    return pairs.withColumns({f"{c}_code": short_code(c, codes) for c in columns})


def basket_checks(pairs: DataFrame, size: int, tolerance: float = 1e-6) -> DataFrame:
    """One row: size, sums of traffic and of raw and rounded weights, wrong totals and weights, and whether all is well."""
    total = pairs.agg(F.sum("total_traffic").alias("_total"))
    off = F.abs(F.col("weight").cast("double") - F.col("total_traffic") / F.col("_total")) > tolerance
    out = pairs.crossJoin(F.broadcast(total)).agg(  # one row: the total
        F.count("*").alias("pairs"), F.coalesce(F.sum("total_traffic"), F.lit(0)).alias("traffic"), F.round(F.sum("weight_raw").cast("double"), 9).alias("weight_raw"), F.sum("weight").cast("double").alias("weight"),
        F.count_if(F.col("passengers_to") + F.col("passengers_from") != F.col("total_traffic")).alias("wrong_totals"), F.count_if(off).alias("wrong_weights"),
    )
    fine = (F.col("pairs") == size) & (F.col("wrong_totals") == 0) & (F.col("wrong_weights") == 0) & (F.abs(F.col("weight") - 1) <= F.col("pairs") * 1e-8)
    return out.withColumn("passed", F.coalesce(fine, F.lit(False)))


def active_basket(weights: DataFrame, routes: DataFrame, cities: DataFrame) -> DataFrame:
    """Active weights with their route and both cities (city_id, city_code), heaviest first within the result's rows."""
    city = lambda side: cities.select(F.col("city_id").alias(f"{side}_city_id"), F.col("city_code").alias(side))
    rows = weights.where("is_active").join(routes.where("is_active").drop("is_active"), "route_id")
    return rows.join(city("origin"), "origin_city_id").join(city("destination"), "destination_city_id").select("route_id", "route_code", "origin", "destination", "weight")
