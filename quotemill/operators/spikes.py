"""Implausible readings in series of measurements, by state-space forecasting (problem 2).

The logarithm of a series is a level that drifts slowly, observed with the scatter of its source: a Kalman filter
forecasts each reading, and a reading whose standardised innovation exceeds a threshold is withheld from the
update. Three withheld readings in a row that agree with each other are a new level, not errors: the filter starts
again from them. The filter runs forwards and backwards; only what neither side expects is a spike. A stuck source
has no scatter of its own, so the filter of the stuck state has no observation noise: its forecast is the last reading.
Where the variance of its innovations around zero vanishes over a whole window, the readings of the window are stuck.
A reading that is not positive, or so many times the median of its source that no ticket costs as much, is impossible.

Plan: one narrow shuffle by series, sorted in the JVM (it may spill), then Arrow batches in which all series of a
batch are filtered side by side as rows of a matrix. A series is held in memory only up to BLOCK readings: longer
ones are cut by rank into stretches with real readings of both neighbours around them, however uneven their times
are, so that a hot series is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.runtime import bounded_rows, checkpoint

IMPOSSIBLE, SPIKE, STUCK = 1, 2, 4


@dataclass(frozen=True)
class SpikeSettings:
    threshold: float = 4.6  #: standardised innovation beyond which a reading is withheld
    drift: float = 0.05  #: variance of the level's daily step, as a share of the scatter's variance
    level: int = 3  #: so many agreeing withheld readings in a row are a new level
    stuck: int = 8  #: so many equal readings in a row are a stuck value
    far: float = 1000.0  #: no ticket costs so many times the median of its source
    floor: float = 0.03  #: least scatter (of the logarithm) that a source is credited with
    block: int = 8192  #: longest stretch of one series in one task
    halo: int = 64  #: possible readings of either neighbouring stretch, by rank
    most_sources: int = 100_000  #: sources whose scatter may be held by every task


def source_scatter(readings: DataFrame) -> DataFrame:
    """(source, scatter, median): robust standard deviation of log fares around their level, and median fare, by source.

    From the median size of the changes between neighbouring readings of a series, without the unchanged ones:
    a source that keeps its price for days would else have none. Series are cut every 30 days, so that no task sorts
    an unbounded one; only the change across a cut is not counted.
    """
    w = Window.partitionBy("series", F.floor(F.col("at") / (30 * 86_400_000_000))).orderBy("at", "id")
    step = F.abs(F.ln("fare") - F.ln(F.lag("fare").over(w)))
    steps = readings.where("fare > 0").select("source", "fare", step.alias("step"))
    scatter = F.percentile_approx(F.when(F.col("step") > 1e-9, F.col("step")), 0.5, 1000) / (0.6745 * 2**0.5)
    return steps.groupBy("source").agg(scatter.alias("scatter"), F.percentile_approx("fare", 0.5, 1000).alias("median"))


def _filter(y: np.ndarray, known: np.ndarray, sigma: np.ndarray, cfg: SpikeSettings) -> np.ndarray:
    """Which readings a Kalman filter from left to right withholds. y: series x time, packed to the left."""
    n, length = y.shape
    r, q = sigma**2, cfg.drift * sigma**2
    head = np.where(known[:, :5], y[:, :5], np.nan)
    with np.errstate(all="ignore"):
        x = np.nanmedian(head, axis=1)
    p = 0.4 * r  # the median of five readings
    flags = np.zeros((n, length), dtype=bool)
    held = np.zeros(n, dtype=np.int64)  # withheld readings in a row, up to now
    limit = cfg.threshold * sigma * 2**0.5
    for t in range(length):
        here = known[:, t]
        pp = p + q
        s = pp + r
        innovation = y[:, t] - x
        out = here & (np.abs(innovation) > cfg.threshold * np.sqrt(s))
        flags[:, t] = out
        use = here & ~out
        gain = np.where(use, pp / s, 0.0)
        x = x + gain * np.where(use, innovation, 0.0)
        p = np.where(use, (1 - gain) * pp, np.where(here, np.minimum(pp, 4 * r), p))
        held = np.where(out, held + 1, np.where(here, 0, held))
        ready = held >= cfg.level
        if ready.any():
            i = np.nonzero(ready)[0]
            last = y[i, t - cfg.level + 1 : t + 1]
            agree = last.max(axis=1) - last.min(axis=1) <= limit[i]
            j = i[agree]
            if len(j):
                x[j] = np.median(last[agree], axis=1)
                p[j] = 0.6 * r[j]
                held[j] = 0
                flags[j, t - cfg.level + 1 : t + 1] = False
    return flags


def stuck_readings(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Which readings lie in a window of `size` readings of their series over which the innovations of the stuck state vanish."""
    out = np.zeros(len(values), dtype=bool)
    if size < 2 or len(values) < size:
        return out
    with np.errstate(all="ignore"):
        innovation = np.diff(values)
        innovation[starts[1:] - 1] = np.inf  # a series forecasts nothing about the next
        variance = np.lib.stride_tricks.sliding_window_view(innovation**2, size - 1).mean(axis=1)
    edge = np.zeros(len(values) + 1, dtype=np.int64)
    first = np.nonzero(variance == 0)[0]
    np.add.at(edge, first, 1)
    np.add.at(edge, first + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _series_cases(values: np.ndarray, starts: np.ndarray, sigma: np.ndarray, top: np.ndarray, cfg: SpikeSettings, asked: int) -> np.ndarray:
    """Reason (0 none, 1 impossible, 2 spike, 4 stuck; those asked for) of each distinct reading; starts: first reading of each series."""
    n = len(values)
    reason = np.zeros(n, dtype=np.int8)
    if not n:
        return reason
    impossible = ~((values > 0) & (values < top))
    reason[impossible] |= 1
    series = np.zeros(n, dtype=np.int64)
    series[starts[1:]] = 1
    series = np.cumsum(series)
    reason[stuck_readings(values, starts, cfg.stuck)] |= 4
    # spikes: the possible readings of each series, packed to the left of a matrix
    ok = np.nonzero(~impossible)[0]
    if not len(ok) or not asked & SPIKE:
        return reason & asked
    count = np.bincount(series[ok], minlength=len(starts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    order = np.argsort(count, kind="stable")
    lo = 0
    while lo < len(order):  # series of like length share a matrix
        hi = int(np.searchsorted(count[order], max(32, 2 * count[order[lo]]), "right"))
        rows = order[lo:hi]
        lo = hi
        rows = rows[count[rows] >= 3]
        if not len(rows):
            continue
        width = int(count[rows].max())
        at = np.arange(width)
        known = at[None, :] < count[rows][:, None]
        index = np.where(known, first[rows][:, None] + at[None, :], first[rows][:, None])
        y = np.log(values[ok][index])
        back = np.where(known, count[rows][:, None] - 1 - at[None, :], 0)
        s = sigma[ok[first[rows]]]
        forward = _filter(y, known, s, cfg)
        backward = np.take_along_axis(_filter(np.take_along_axis(y, back, 1), known, s, cfg), back, 1)
        both = forward & backward & known
        reason[ok[index[both]]] |= 2
    return reason & asked


def _batches(batches: Iterator[pd.DataFrame], cfg: SpikeSettings, asked: int) -> Iterator[pd.DataFrame]:
    def done(rows: pd.DataFrame) -> pd.DataFrame:
        key, at = rows["part"].to_numpy(), rows["at"].to_numpy()
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        reading = np.cumsum(fresh) - 1  # rows of one reading loaded again share it
        first = np.nonzero(fresh)[0]
        keys = key[first]
        starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        reason = _series_cases(rows["fare"].to_numpy()[first], starts, rows["scatter"].to_numpy()[first], rows["top"].to_numpy()[first], cfg, asked)[reading]
        keep = (reason > 0) & rows["own"].to_numpy()
        return pd.DataFrame({"id": rows["id"].to_numpy()[keep], "reason": reason[keep].astype(np.int32)})

    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        open_series = rows["part"].to_numpy() == rows["part"].iloc[-1]
        cut = int(np.argmax(open_series))
        if cut:
            yield done(rows.iloc[:cut].reset_index(drop=True))
        rest = rows.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield done(rest)


def implausible_readings(
    df: DataFrame, key: str, source: str, at: str, value: str, series: Sequence[str], cfg: SpikeSettings = SpikeSettings()
) -> DataFrame:
    """(key, impossible, spike, stuck): the rows of df whose reading is implausible, with the reasons.

    `series` are the columns (or SQL expressions) that name a series; `at` orders it; `source` has one scatter.
    Rows of a series with the same `at` are one reading loaded again: it counts once and each of its rows comes out.

    Nulls: a row without value, time or key is no reading; null parts of a series name are equal to each other. A
    series of fewer than three possible readings has no spikes; a source without any change has the least scatter, one
    without a positive reading no limit above.
    An empty table gives no rows; other columns of any name are ignored.
    """
    name = F.xxhash64(*[F.coalesce(F.expr(c).cast("string"), F.lit("\x00")) for c in series])
    readings = df.where(F.col(value).isNotNull() & F.col(at).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.expr(source).alias("source"), name.alias("series"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("fare"),
    )
    scatter = source_scatter(readings)
    rows = bounded_rows(scatter, cfg.most_sources)
    least, endless = F.lit(cfg.floor), F.lit(float("inf"))
    if rows is not None:
        small = df.sparkSession.createDataFrame([(r.source, r.scatter, r.median) for r in rows], scatter.schema)
        joined = readings.join(F.broadcast(small), readings.source.eqNullSafe(small.source), "left").drop(small.source)
    else:
        joined = readings.join(scatter, "source", "left")
    joined = joined.select(
        "id", "series", "at", "fare", F.greatest(F.coalesce("scatter", least), least).alias("scatter"), F.coalesce(F.col("median") * cfg.far, endless).alias("top")
    )
    long = readings.groupBy("series").agg(F.count("*").alias("n")).where(F.col("n") > cfg.block).select("series")
    hot = bounded_rows(long, 20_000)
    if hot == []:
        found = _whole(joined, cfg)
    else:
        if hot is not None:
            long = F.broadcast(joined.sparkSession.createDataFrame(hot, long.schema))
        found = _whole(joined.join(long, "series", "left_anti"), cfg).union(_cut(joined.join(long, "series", "left_semi"), cfg))
    return found.select(
        F.col("id").alias(key), (F.col("reason").bitwiseAND(1) > 0).alias("impossible"),
        (F.col("reason").bitwiseAND(2) > 0).alias("spike"), (F.col("reason").bitwiseAND(4) > 0).alias("stuck"),
    )


def _judged(parts: DataFrame, cfg: SpikeSettings, asked: int) -> DataFrame:
    """(id, reason) of the parts' own readings that have a reason among those asked for."""
    ordered = parts.repartition("part").sortWithinPartitions("part", "at", "id")
    return ordered.mapInPandas(lambda it: _batches(it, cfg, asked), "id long, reason int")


def _whole(joined: DataFrame, cfg: SpikeSettings) -> DataFrame:
    """(id, reason) of series that are short enough to be judged in one piece."""
    parts = joined.select("id", "at", "fare", "scatter", "top", F.col("series").alias("part"), F.lit(True).alias("own"))
    return _judged(parts, cfg, IMPOSSIBLE | SPIKE | STUCK)


def _cut(joined: DataFrame, cfg: SpikeSettings) -> DataFrame:
    """(id, reason) of series above cfg.block rows: their readings are judged in stretches, then given to all their rows.

    Stuck values are judged with cfg.stuck - 1 readings of either neighbour, which are enough to tell any run that
    reaches into a stretch. Spikes are judged among the possible readings alone, as in a whole series.
    """
    first = F.min(F.struct("id", "fare", "scatter", "top"))
    facts = joined.groupBy("series", "at").agg(first.alias("r")).select("series", "at", "r.fare", "r.scatter", "r.top")
    ranked = _ranked(facts)
    facts = ranked.select("series", "at", "fare", "scatter", "top", "rank", F.col("spot").alias("id"))
    possible = facts.where((F.col("fare") > 0) & (F.col("fare") < F.col("top")))
    # a whole series has the scatter of its first possible reading
    scatter = possible.groupBy("series").agg(F.min_by("scatter", "at").alias("scatter"))
    possible = _ranked(possible.drop("rank", "scatter")).join(scatter, "series")
    reasons = _judged(_stretches(facts, cfg.stuck - 1, cfg), cfg, IMPOSSIBLE | STUCK).union(_judged(_stretches(possible, cfg.halo, cfg), cfg, SPIKE))
    cases = reasons.groupBy("id").agg(F.bit_or("reason").alias("reason")).join(facts.select("id", "series", "at"), "id").drop("id")
    return joined.select("id", "series", "at").join(cases, ["series", "at"]).select("id", "reason")


def _ranked(readings: DataFrame) -> DataFrame:
    """Adds spot (unique) and rank: the number of readings of the series before this one. (series, at) must be unique.

    Ranges of (series, at) are sorted and counted, and the counts of the ranges before are added: no task has to sort
    a whole series.
    """
    ordered = readings.repartitionByRange("series", "at").sortWithinPartitions("series", "at")
    ordered = checkpoint(ordered.withColumn("spot", F.monotonically_increasing_id())).withColumn("range", F.shiftright("spot", 33))
    ranges = ordered.groupBy("series", "range").agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("series").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = ranges.select("series", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return ordered.join(shifts, ["series", "range"]).withColumn("rank", F.col("spot") + F.col("shift")).drop("range", "shift")


def _stretches(ranked: DataFrame, halo: int, cfg: SpikeSettings) -> DataFrame:
    """Adds part (what is judged together: cfg.block readings and halo of either neighbour) and own (not a neighbour's reading)."""
    home, rank = F.floor(F.col("rank") / cfg.block), F.col("rank")
    parts = F.sequence(F.floor(F.greatest(rank - halo, F.lit(0)) / cfg.block), F.floor((rank + halo) / cfg.block))
    return ranked.select("id", "at", "fare", "scatter", "top", "series", home.alias("home"), F.explode(parts).alias("b")).select(
        "id", "at", "fare", "scatter", "top", F.xxhash64("series", "b").alias("part"), (F.col("b") == F.col("home")).alias("own")
    )
