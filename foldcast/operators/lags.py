"""Lag columns and role alignment. Order is semantic: every frame carries the dense row number t."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _checked(p) -> int:
    if isinstance(p, bool) or not isinstance(p, int) or p < 1:
        raise ValueError(f"the number of lags must be a positive integer, not {p!r}")
    return p


def lag_long(panel: DataFrame, p: int) -> DataFrame:
    """A long panel (t, series, value) with lag1 .. lagp of each series; windows are partitioned by series."""
    w = Window.partitionBy("series").orderBy("t")
    return panel.select("*", *[F.lag("value", k).over(w).alias(f"lag{k}") for k in range(1, _checked(p) + 1)])


def wide(panel: DataFrame, series: list[str], value: str = "value", suffix: str = "") -> DataFrame:
    """(t, one column for each series), the series given, so the pivot needs no extra job."""
    out = panel.groupBy("t").pivot("series", series).agg(F.first(value))
    return out.select("t", *[F.col(f"`{s}`").alias(f"{s}{suffix}") for s in series])


def make_lags(panel: DataFrame, series: list[str], p: int, include_original: bool = False) -> DataFrame:
    """(t, <series>_lag<k> ...) lag by lag in the order of ``series``; with include_original the series come first.

    The lags are taken on the long panel, a window a series, and pivoted in one aggregation over t.
    """
    lagged = lag_long(panel, p)
    values = [F.first("value").alias("v0")] * include_original + [F.first(f"lag{k}").alias(f"v{k}") for k in range(1, p + 1)]
    if len(values) == 1:
        values.append(F.count(F.lit(1)).alias("unused"))
    out = lagged.groupBy("t").pivot("series", series).agg(*values)
    columns = [F.col(f"`{s}_v0`").alias(s) for s in series if include_original]
    columns += [F.col(f"`{s}_v{k}`").alias(f"{s}_lag{k}") for k in range(1, p + 1) for s in series]
    return out.select("t", *columns)


def realign(*frames: DataFrame) -> DataFrame:
    """Inner join on t of frames with distinct columns, without the rows that have a null anywhere."""
    if not frames:
        raise ValueError("nothing to align")
    return reduce(lambda a, b: a.join(b, "t"), frames).dropna()


def vectors(panel: DataFrame, name: str = "y") -> DataFrame:
    """(t, name array<double>) with the values of a complete panel in the order of the series' names."""
    return panel.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("series", "value"))), lambda x: x["value"]).alias(name))
