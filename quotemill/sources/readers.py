"""Sources and sinks: Parquet, JDBC, JSON landings, spreadsheets, checkpoints of tasks."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.text import legs, parse_clock, parse_fare

PAYLOAD = (
    "cards struct<J1:array<struct<flightId:string,travelOptionId:string,fareId:string>>>,"
    "flights map<string,struct<airlineCode:string,flightNo:string,departure:string,arrival:string,stops:int>>,"
    "fares map<string,struct<total:string,family:string>>, metaData struct<airlineDetail:map<string,string>>"
)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A database table, read in `parts` ranges of a numeric key if its bounds are given; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Writes df to a database table, one connection per partition."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def json_quotes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quotes from JSON lines under a declared schema; what does not parse is kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def quotes_of_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per card of a nested payload: its flight, fare and airline looked up by id in the payload's maps.

    Cards whose flight is not in the payload are left out; a payload that does not parse or has no cards gives none.
    """
    rest = [c for c in df.columns if c != payload]
    p = df.select(*rest, F.from_json(payload, PAYLOAD).alias("p"))
    cards = p.select(*rest, "p", F.explode("p.cards.J1").alias("card"))
    flight = F.try_element_at("p.flights", F.col("card.flightId"))
    fare = F.try_element_at("p.fares", F.col("card.fareId"))
    looked = cards.select(*rest, flight.alias("f"), fare.alias("t"), F.col("p.metaData.airlineDetail").alias("names")).where("f is not null")
    return looked.select(
        *rest, F.coalesce(F.try_element_at("names", F.col("f.airlineCode")), F.col("f.airlineCode")).alias("airline"), F.array_join(legs(F.concat_ws(" ", "f.airlineCode", "f.flightNo")), "/").alias("flight_number"),
        parse_clock("f.departure").alias("departure_time"), parse_clock("f.arrival").alias("arrival_time"), F.col("f.stops").alias("stops"), parse_fare("t.total").alias("total_fare"), F.col("t.family").alias("fare_family"),
    )


def quotes_of_cards(df: DataFrame, lines: str = "lines", least: float = 500) -> DataFrame:
    """One row per text card (array of lines): the first line that is a flight number, the first two times, the first fare, the stops."""
    times = F.filter(F.transform(F.col(lines), lambda x: parse_clock(x)), lambda x: x.isNotNull())
    fares = F.filter(F.transform(F.col(lines), lambda x: parse_fare(x, least)), lambda x: x.isNotNull())
    number = F.get(F.filter(F.col(lines), lambda x: F.upper(x).rlike(r"^\s*([A-Z0-9]{2})[ -]?[0-9]{2,4}(\s*[/,+].*)?$")), F.lit(0))
    rest = [c for c in df.columns if c != lines]
    return df.select(*rest, F.array_join(legs(number), "/").alias("flight_number"), F.get(times, F.lit(0)).alias("departure_time"), F.get(times, F.lit(1)).alias("arrival_time"), F.get(fares, F.lit(0)).alias("total_fare"))


def tier_fares(df: DataFrame, tiers: dict[str, tuple[str, str | None]], standard: str | None = None, lines: str = "lines", ahead: int = 5) -> DataFrame:
    """One row per fare tier that a card's lines name: tier, total_fare, cabin_class, baggage.

    `tiers` gives cabin and baggage by tier. A tier's fare is the first one in the `ahead` lines from the one that names it;
    of several mentions the first with a fare counts. A card without a priced tier has its lowest fare as `standard`, if
    that is given. Cards without a fare give no rows.
    """
    rest = [c for c in df.columns if c != lines]
    fares = F.transform(F.col(lines), lambda x: parse_fare(x))

    def first(tier: str) -> Column:
        behind = lambda i: F.get(F.array_compact(F.slice("_fares", i + 1, ahead)), F.lit(0))
        named = F.transform(F.col(lines), lambda x, i: F.when(F.contains(F.lower(x), F.lit(tier.lower())), behind(i)))
        return F.get(F.array_compact(named), F.lit(0))

    kinds = [(tier, first(tier), cabin, baggage) for tier, (cabin, baggage) in tiers.items()]
    as_row = lambda tier, fare, cabin, baggage: F.struct(F.lit(tier).alias("tier"), fare.alias("total_fare"), F.lit(cabin).alias("cabin_class"), F.lit(baggage).cast("string").alias("baggage"))
    priced = df.withColumn("_fares", fares).withColumn("_rows", F.filter(F.array(*[as_row(*k) for k in kinds]), lambda x: x["total_fare"].isNotNull()))
    if standard is not None:
        lowest = F.array(as_row(standard, F.array_min("_fares"), tiers.get(standard, ("ECONOMY", None))[0], None))
        priced = priced.withColumn("_rows", F.when(F.size("_rows") == 0, lowest).otherwise(F.col("_rows")))
    return priced.select(*rest, F.explode("_rows").alias("_x")).select(*rest, "_x.*").where("total_fare is not null")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """Rows of a workbook's sheet, cells placed by their reference; empty rows are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        wanted = f"xl/worksheets/sheet{sheet}.xml"
        root = ET.fromstring(z.read(wanted if wanted in sheets else sheets[0]))
        for row in root.iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str | None] = {}
            for n, cell in enumerate(row.findall("m:c", _NS)):
                ref = re.match(r"[A-Z]+", cell.get("r", ""))
                col = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(ref.group()))) - 1 if ref else n
                v, inline = cell.find("m:v", _NS), cell.find("m:is", _NS)
                text = v.text if v is not None else "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else None
                cells[col] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
            if any(x not in (None, "") for x in cells.values()):
                yield [cells.get(i) for i in range(max(cells) + 1)]


def spreadsheet(spark: SparkSession, path: str, columns: Sequence[str], sheet: int = 1) -> DataFrame:
    """A sheet with a header row as strings: path, row and the named columns. A missing column is an error.

    A row that ends before a wanted column has null there: workbooks leave out empty cells at the end.

    Workbooks are read by the executors, one per task at a time.
    """
    schema = "path string, row int, " + ", ".join(f"`{c}` string" for c in columns)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                rows = sheet_rows(bytes(content), sheet)
                head = [(h or "").strip() for h in next(rows, [])]
                lacking = [c for c in columns if c not in head]
                if lacking:
                    raise ValueError(f"{where} lacks the columns {lacking}")
                at = [head.index(c) for c in columns]
                body = [(where, n, *(r[i] if i < len(r) else None for i in at)) for n, r in enumerate(rows, 2)]
                yield pd.DataFrame(body, columns=["path", "row", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with the named columns cast; a value that does not fit is an error that names its column."""
    out = df
    for c, t in types.items():
        value = F.col(c).try_cast(t)
        out = out.withColumn(c, F.when(F.col(c).isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{c} is not a {t}: "), F.col(c)))).otherwise(value))
    return out


def append_tasks(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def resume(tasks: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The tasks that the checkpoint at path does not hold yet."""
    schema = ", ".join(f"{k} {tasks.schema[k].dataType.simpleString()}" for k in keys)
    return tasks.join(tasks.sparkSession.read.schema(schema).json(path).distinct(), list(keys), "left_anti")
