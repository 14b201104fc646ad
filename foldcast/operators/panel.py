"""Panels: projection, filters, joins on dates, interpolation and validation. Long frames: date, series, value (and t)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_t(panel: DataFrame) -> DataFrame:
    """The dense row number t of each date. It is numbered on the table of distinct dates, which is as small as a
    calendar, and joined back; Spark broadcasts it if its size allows."""
    days = panel.select("date").distinct().withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))
    return panel.join(days, "date").select("t", "date", "series", "value")


def nan_to_null(panel: DataFrame) -> DataFrame:
    return panel.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def named_series(panel: DataFrame, names: list[str]) -> DataFrame:
    """The named series; a missing name raises KeyError."""
    there = {r.series for r in panel.filter(F.col("series").isin(names)).select("series").distinct().collect()}
    if missing := [n for n in names if n not in there]:
        raise KeyError(f"series not in the panel: {missing}")
    return panel.filter(F.col("series").isin(names))


def first_series(panel: DataFrame, n: int, order: str = "series") -> DataFrame:
    """The first n series by ``order`` (a column that is constant within a series)."""
    few = panel.groupBy("series").agg(F.min(order).alias("o")).orderBy("o", "series").limit(n).select("series")
    return panel.join(few, "series", "left_semi")


def complete_series(panel: DataFrame) -> DataFrame:
    """Series that have a value on every date of the panel; one null or missing date drops a series."""
    dates = panel.agg(F.countDistinct("date").alias("n"))
    full = panel.groupBy("series").agg(F.countDistinct(F.when(F.col("value").isNotNull(), F.col("date"))).alias("have")).crossJoin(F.broadcast(dates)).filter("have = n").select("series")
    return panel.join(full, "series", "left_semi")


def tail_days(panel: DataFrame, days: int) -> DataFrame:
    """The last ``days`` rows of t; all of them if there are fewer."""
    last = panel.agg(F.max("t").alias("last"))
    return panel.crossJoin(F.broadcast(last)).filter(F.col("t") > F.col("last") - days).drop("last")


def until(panel: DataFrame, date: str) -> DataFrame:
    return panel.filter(F.col("date") <= F.to_date(F.lit(date)))


def on_dates_of(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of ``panel`` on the dates of ``dates``."""
    return panel.join(dates.select("date").distinct(), "date", "left_semi")


def require_dates(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """Like on_dates_of, but a date of ``dates`` without a row raises KeyError."""
    absent = [str(r.date) for r in dates.select("date").distinct().join(panel.select("date").distinct(), "date", "left_anti").orderBy("date").limit(5).collect()]
    if absent:
        raise KeyError(f"dates without a confounder row, among them {absent}")
    return on_dates_of(panel, dates)


def outer_merge(frames: list[DataFrame]) -> DataFrame:
    """Full outer join of long frames on the date: every series on every date that any frame has, null where absent."""
    rows = frames[0].select("date", "series", "value")
    for f in frames[1:]:
        rows = rows.unionByName(f.select("date", "series", "value"))
    spine = rows.select("date").distinct().crossJoin(rows.select("series").distinct())
    return spine.join(rows, ["date", "series"], "left")


def interpolate(panel: DataFrame, mode: str = "ffill", fill: float | None = 0.0) -> DataFrame:
    """Fill nulls of each series by row position; what is left (leading nulls) becomes ``fill``, if one is given.

    ffill carries the last value forward and needs no future. linear draws a line to the next observation, so it looks
    ahead in interior gaps; trailing gaps carry the last value forward.
    """
    if mode not in ("ffill", "linear"):
        raise ValueError(f"mode is ffill or linear, not {mode!r}")
    w = Window.partitionBy("series").orderBy("date")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("series").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)  # a running value; the frame from here on would be read anew for each row
    here = panel.withColumn("n", F.row_number().over(w)).withColumn("known", F.when(F.col("value").isNotNull(), F.struct("n", "value")))
    here = here.withColumn("a", F.last("known", ignorenulls=True).over(back)).withColumn("b", F.last("known", ignorenulls=True).over(ahead))
    value = F.col("a.value")
    if mode == "linear":
        step = (F.col("b.value") - F.col("a.value")) * (F.col("n") - F.col("a.n")) / F.nullif(F.col("b.n") - F.col("a.n"), F.lit(0))
        value = F.when(F.col("value").isNotNull() | F.col("b").isNull(), value).otherwise(F.col("a.value") + step)
    if fill is not None:
        value = F.coalesce(value, F.lit(float(fill)))
    return here.withColumn("value", value).drop("n", "known", "a", "b")


def quality(panel: DataFrame) -> DataFrame:
    """One row: rows (dates), series, first and last date, missing cells."""
    return panel.agg(
        F.countDistinct("date").alias("n_rows"), F.countDistinct("series").alias("n_series"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("n_missing"),
    )


@dataclass
class Report:
    valid: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    info: dict = field(default_factory=dict)


def validate(assets: DataFrame, confounders: DataFrame | None, lookback: int, days_valid: int, required: int | None = None) -> Report:
    """Sizes, overlap and missing cells; any error raises one ValueError that lists errors and warnings."""
    out, a = Report(), quality(assets).first()
    need = required if required is not None else max(lookback + 1, lookback + days_valid + 1)
    if not a.n_rows:
        out.errors.append("the asset panel is empty")
    if confounders is not None:
        c = quality(confounders).first()
        if not c.n_rows:
            out.errors.append("the confounder panel is empty")
        elif a.n_rows and on_dates_of(confounders, assets).isEmpty():
            out.errors.append("assets and confounders have no date in common")
        if a.n_rows != c.n_rows:
            out.warnings.append(f"{a.n_rows} asset rows but {c.n_rows} confounder rows")
        if c.n_missing:
            out.warnings.append(f"{c.n_missing} confounder cells are missing")
        out.info["confounders"] = c.asDict()
    if a.n_rows < need:
        out.errors.append(f"{a.n_rows} rows, at least {need} are required")
    if lookback <= days_valid:
        out.errors.append(f"lookback_days ({lookback}) must be greater than days_valid ({days_valid})")
    if a.n_missing:
        out.warnings.append(f"{a.n_missing} asset cells are missing")
    out.info["assets"] = a.asDict()
    if out.errors:
        raise ValueError("; ".join([*out.errors, *(f"warning: {w}" for w in out.warnings)]))
    return out
