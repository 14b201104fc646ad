"""Univariate rolling forecasts as window aggregates: AR(1), AR(1) with one exogenous lag, AR(2), neighbours and means.

A frame of the L rows before the target is exactly the training slice of a lag-1 model; a lag-p model starts p - 1 rows
later. The sums of a regression over a frame are differences of running sums of centred values, so a row costs the same
whatever L is. Everything stays in Catalyst; windows are partitioned by series.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lags import lag_long

#: A variance under this share of the running sum of squares is a rounding error of a constant.
NOTHING = 1e-12


def _frame(first: int):
    return Window.partitionBy("series").orderBy("t").rowsBetween(-first, -1)


def fitted(rows: DataFrame, y: str, regressors: list[str], first: int, out: str) -> DataFrame:
    """``rows`` with the forecast ``out`` of y by a line or plane over one or two regressors, fitted on the ``first`` rows before each.

    Rows where y or a regressor is null take no part in a fit. A constant regressor gets the slope 0; two that depend on
    each other give no forecast.
    """
    names, kept = [y, *regressors], rows.columns
    series = Window.partitionBy("series")
    order = series.orderBy("t")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull()
    centred = rows.select("*", F.when(known, 1).otherwise(0).alias("_n"), *[F.avg(F.when(known, F.col(c))).over(series).alias(f"_m{i}") for i, c in enumerate(names)])
    centred = centred.select("*", *[F.when(F.col("_n") == 1, F.col(c) - F.col(f"_m{i}")).otherwise(0.0).alias(f"_c{i}") for i, c in enumerate(names)])
    terms = {"n": F.col("_n")} | {str(i): F.col(f"_c{i}") for i in range(len(names))}
    terms |= {f"{i}{j}": F.col(f"_c{i}") * F.col(f"_c{j}") for i, j in combinations_with_replacement(range(len(names)), 2) if j}
    summed = centred.select("*", *[F.sum(v).over(running).alias(f"_u{k}") for k, v in terms.items()])
    inside = summed.select("*", *[(F.lag(f"_u{k}", 1).over(order) - F.coalesce(F.lag(f"_u{k}", first + 1).over(order), F.lit(0))).alias(f"_s{k}") for k in terms])
    n, mean = F.col("_sn"), lambda i: F.try_divide(f"_s{i}", "_sn")

    def s(i: int, j: int):
        i, j = min(i, j), max(i, j)
        return F.col(f"_s{i}{j}") - F.col(f"_s{i}") * mean(j)

    ahead = lambda i: F.col(names[i]) - F.col(f"_m{i}") - mean(i)
    base = F.when(n > 0, F.col("_m0") + mean(0))
    if len(regressors) == 1:
        slope = F.when(s(1, 1) > NOTHING * F.col("_u11"), F.try_divide(s(0, 1), s(1, 1))).otherwise(0.0)
        guess = base + slope * ahead(1)
    else:
        det = s(1, 1) * s(2, 2) - s(1, 2) * s(1, 2)
        one, two = F.try_divide(s(0, 1) * s(2, 2) - s(0, 2) * s(1, 2), det), F.try_divide(s(0, 2) * s(1, 1) - s(0, 1) * s(1, 2), det)
        guess = F.when(det > NOTHING * F.col("_u11") * F.col("_u22"), base + one * ahead(1) + two * ahead(2))
    return inside.select(*kept, guess.alias(out))


def ar1(panel: DataFrame, lookback: int) -> DataFrame:
    """(t, series, f) for the targets t = L+1 .. N-1."""
    return fitted(lag_long(panel, 1), "value", ["lag1"], lookback, "f").filter(F.col("t") > lookback).select("t", "series", "f")


def arx1(panel: DataFrame, exogenous: DataFrame, lookback: int) -> DataFrame:
    """AR(1) with lag 1 of one exogenous series (t, x)."""
    w = Window.partitionBy("series").orderBy("t")
    rows = lag_long(panel.join(exogenous.select("t", "x"), "t"), 1).withColumn("x1", F.lag("x", 1).over(w))
    return fitted(rows, "value", ["lag1", "x1"], lookback, "f").filter(F.col("t") > lookback).select("t", "series", "f")


def fold_forecasts(panel: DataFrame, lookback: int, days_valid: int) -> DataFrame:
    """(t, series, value, f1, f2): what fold fits of AR(1) and AR(2) with target t forecast."""
    m = lookback - days_valid + 1
    rows = lag_long(panel, 2)
    rows = fitted(fitted(rows, "value", ["lag1"], m - 1, "f1"), "value", ["lag1", "lag2"], m - 2, "f2")
    return rows.filter(F.col("t") >= m).select("t", "series", "value", "f1", "f2")


def fold_errors(forecasts: DataFrame, lookback: int, days_valid: int, n: int) -> DataFrame:
    """(origin, p, shift, err): row_rmse over the series of each fold, for the origins L .. N-2 (target offset 1)."""
    each = forecasts.select("t", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.pow(F.col("value") - F.col(f"f{p}"), 2).alias("e")) for p in (1, 2)])).alias("x")).select("t", "x.p", "x.e")
    day = each.groupBy("t", "p").agg(F.sqrt(F.avg("e")).alias("err"))
    at = day.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(days_valid - 1)))).withColumn("origin", F.col("t") + days_valid - 1 - F.col("shift"))
    return at.filter(F.col("origin").between(lookback, n - 2)).select("origin", "p", "shift", "err")


def best_lag(errors: DataFrame) -> DataFrame:
    """(origin, p_opt, valid_err): least mean error, ties to the smaller lag."""
    mean = errors.groupBy("origin", "p").agg(F.avg("err").alias("err"))
    return mean.groupBy("origin").agg(F.min_by("p", F.struct("err", "p")).alias("p_opt"), F.min("err").alias("valid_err"))


def lag_selected(panel: DataFrame, lookback: int, days_valid: int, n: int) -> DataFrame:
    """(origin, t, series, p_opt, f): AR(1) or AR(2), whichever had the least fold error, refitted at each origin."""
    chosen = best_lag(fold_errors(fold_forecasts(panel, lookback, days_valid), lookback, days_valid, n))
    rows = fitted(fitted(lag_long(panel, 2), "value", ["lag1"], lookback, "f1"), "value", ["lag1", "lag2"], lookback - 1, "f2").withColumn("origin", F.col("t") - 1)
    return rows.join(chosen, "origin").select("origin", "t", "series", "p_opt", F.when(F.col("p_opt") == 1, F.col("f1")).otherwise(F.col("f2")).alias("f"))


def _history(panel: DataFrame, lookback: int) -> DataFrame:
    """(t, series, x, past): each target's own lag and its L training pairs, gathered by a bounded window frame."""
    pairs = F.collect_list(F.struct(F.col("lag1").alias("x"), F.col("t").alias("u"), F.col("value").alias("y"))).over(_frame(lookback))
    return lag_long(panel, 1).withColumn("past", pairs).filter(F.col("t") > lookback).select("t", "series", F.col("lag1").alias("x0"), "past")


def nearest(panel: DataFrame, lookback: int, k: int = 5) -> DataFrame:
    """Mean of the k past values whose lag is nearest; ties go to the earlier row."""
    order = F.array_sort(F.transform("past", lambda h: F.struct(F.abs(h["x"] - F.col("x0")).alias("d"), h["u"].alias("u"), h["y"].alias("y"))))
    total = F.aggregate(F.slice(order, 1, k), F.lit(0.0), lambda a, h: a + h["y"])
    return _history(panel, lookback).select("t", "series", (total / k).alias("f"))


def within(panel: DataFrame, lookback: int, radius: float) -> DataFrame:
    """Mean of the past values whose lag is within the radius; null if there is none."""
    near = F.filter("past", lambda h: F.abs(h["x"] - F.col("x0")) <= radius)
    out = _history(panel, lookback).withColumn("near", near)
    return out.select("t", "series", (F.aggregate("near", F.lit(0.0), lambda a, h: a + h["y"]) / F.nullif(F.size("near"), F.lit(0))).alias("f"))


def mean(panel: DataFrame, lookback: int) -> DataFrame:
    """Mean of the L values before the target."""
    return panel.withColumn("f", F.avg("value").over(_frame(lookback))).filter(F.col("t") > lookback).select("t", "series", "f")
