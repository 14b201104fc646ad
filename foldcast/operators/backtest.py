"""Long/short backtest of forecasts: positions, portfolio returns, hedges, cumulation and metrics; DataFrame plans only.

Forecasts are long (t, series, f), actuals long (t, series, value: log return). Windows over time run on the portfolio,
which has a row a day (and strategy), never on the panel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Strategy:
    name: str
    kind: str  # naive, weighted or top
    percentile: float | None = None
    contrarian: bool = False

    def __post_init__(self):
        if self.kind not in ("naive", "weighted", "top"):
            raise ValueError(f"unknown pnl strategy {self.kind!r}")
        if self.kind == "top" and (self.percentile is None or not 0 < self.percentile <= 1):
            raise ValueError("a top strategy needs a percentile over 0 and up to 1")


STRATEGIES = (Strategy("naive", "naive"), Strategy("weighted", "weighted"), Strategy("top_50", "top", 0.5), Strategy("top_25", "top", 0.25), Strategy("top_75", "top", 0.75))


def positions_of(forecasts: DataFrame, strategies, n_series: int) -> DataFrame:
    """(strategy, t, series, position): absolute positions of a day sum to 1, or to 0 if nothing is held.

    naive takes the sign of each forecast, weighted the forecast itself. top takes the sign of forecasts whose size is
    strictly over the cutoff-th largest of the day (counted from 0), cutoff = int(n * (1 - percentile)): without ties
    exactly cutoff series, fewer on ties. All strategies share one shuffle and sort of the forecasts by day.
    """
    f, size, day = F.col("f"), F.abs("f"), Window.partitionBy("t")
    held = forecasts
    if any(s.kind == "top" for s in strategies):
        held = held.withColumn("rank", F.row_number().over(day.orderBy(size.desc(), "series")))
    raws, parts = [], []
    for i, s in enumerate(strategies):
        if s.kind == "weighted":
            raw = f
        elif s.kind == "naive":
            raw = F.signum(f)
        else:
            cutoff = int(n_series * (1 - s.percentile))
            raw = F.when(size > F.max(F.when(F.col("rank") == cutoff + 1, size)).over(day), F.signum(f)).otherwise(0.0)
        raws.append(raw.alias(f"raw{i}"))
        gross, sign = F.col(f"gross{i}"), F.lit(-1.0 if s.contrarian else 1.0)
        parts.append(F.struct(F.lit(s.name).alias("strategy"), (sign * F.col(f"raw{i}") / F.when(gross == 0, 1.0).otherwise(gross)).alias("position")))
    held = held.select("t", "series", *raws)
    held = held.select("*", *[F.sum(F.abs(f"raw{i}")).over(day).alias(f"gross{i}") for i in range(len(parts))])
    return held.select("t", "series", F.inline(F.array(*parts))).select("strategy", "t", "series", "position")


def positions(forecasts: DataFrame, strategy: Strategy, n_series: int) -> DataFrame:
    """(t, series, position) of one strategy."""
    return positions_of(forecasts, [strategy], n_series).drop("strategy")


def simple_returns(actuals: DataFrame) -> DataFrame:
    return actuals.withColumn("value", F.exp("value") - 1)


def rolling_beta(pairs: DataFrame, window: int, by: str | None = None) -> DataFrame:
    """pairs (t, p, b) with beta: the slope of p on b over the trailing ``window`` rows; 0 before there are as many and where b is constant."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("t").rowsBetween(1 - window, 0)
    spread = F.regr_sxx("p", "b").over(w)
    slope = F.when((F.count(F.lit(1)).over(w) == window) & (spread > 0), F.regr_slope("p", "b").over(w))
    return pairs.withColumn("beta", F.coalesce(slope, F.lit(0.0)))


def portfolio(held: DataFrame, actuals: DataFrame, by: str | None = None) -> DataFrame:
    """(t, daily, net_position): sum of position times simple return, and of positions; missing returns count as 0."""
    both = held.join(simple_returns(actuals).select("t", "series", "value"), ["t", "series"], "left")
    keys = [k for k in (by, "t") if k]
    return both.groupBy(*keys).agg(F.coalesce(F.sum(F.col("position") * F.col("value")), F.lit(0.0)).alias("daily"), F.sum("position").alias("net_position"))


def hedge(daily: DataFrame, benchmark: DataFrame, beta_neutral: bool = False, beta_window: int = 63, by: str | None = None) -> DataFrame:
    """Subtract net position times the benchmark's simple return, or, if beta_neutral, times that and the rolling beta."""
    joined = daily.join(benchmark.select("t", (F.exp("value") - 1).alias("b")), "t", "left")
    if beta_neutral:
        joined = rolling_beta(joined.withColumn("p", F.col("daily")), beta_window, by)
        cut = F.coalesce(F.col("beta") * F.col("b"), F.lit(0.0))
    else:
        cut = F.col("b")
    return joined.select(*[k for k in (by, "t") if k], (F.col("daily") - F.col("net_position") * cut).alias("daily"), "net_position")


def cumulate(daily: DataFrame, by: str | None = None) -> DataFrame:
    """Add cumulative = product of (1 + daily) so far, less 1."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative", F.product(1 + F.col("daily")).over(w) - 1)


def pnl(forecasts: DataFrame, actuals: DataFrame, strategy: Strategy, n_series: int, benchmark: DataFrame | str | None = None, beta_neutral: bool = False, beta_window: int = 63) -> DataFrame:
    """(strategy, t, daily, net_position, cumulative). Without a benchmark the returns stay unadjusted; a benchmark is a frame (t, value) or a series of ``actuals`` (KeyError if absent)."""
    daily = portfolio(positions(forecasts, strategy, n_series), actuals)
    if isinstance(benchmark, str):
        name, benchmark = benchmark, actuals.filter(F.col("series") == benchmark)
        if benchmark.isEmpty():
            raise KeyError(f"benchmark {name!r} is not among the series and no returns were given")
    if benchmark is not None:
        daily = hedge(daily, benchmark, beta_neutral, beta_window)
    return cumulate(daily).select(F.lit(strategy.name).alias("strategy"), "t", "daily", "net_position", "cumulative")


def sweep(forecasts: DataFrame, actuals: DataFrame, n_series: int, strategies=STRATEGIES, benchmark: DataFrame | None = None, beta_neutral: bool = False, beta_window: int = 63) -> DataFrame:
    """pnl of several strategies in one plan: one pass over the forecasts, one aggregation, one window a strategy."""
    daily = portfolio(positions_of(forecasts, strategies, n_series), actuals, "strategy")
    if benchmark is not None:
        daily = hedge(daily, benchmark, beta_neutral, beta_window, "strategy")
    return cumulate(daily, "strategy").select("strategy", "t", "daily", "net_position", "cumulative")


def buy_and_hold(benchmark: DataFrame) -> DataFrame:
    """The benchmark as a strategy of its own: position 1, cumulative from the sum of log returns."""
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return benchmark.select(F.lit("buy_and_hold").alias("strategy"), "t", (F.exp("value") - 1).alias("daily"), F.lit(1.0).alias("net_position"), (F.exp(F.sum("value").over(w)) - 1).alias("cumulative"))


def performance(results: DataFrame) -> DataFrame:
    """(strategy, annualized_return_pct, sharpe_ratio, total_return): 252 days a year, sample deviation, null Sharpe on one row or no deviation."""
    out = results.groupBy("strategy").agg(F.max_by("cumulative", "t").alias("total_return"), F.count(F.lit(1)).alias("n"), F.avg("daily").alias("m"), F.stddev_samp("daily").alias("s"))
    growth = (F.pow(1 + F.col("total_return"), F.lit(252.0) / F.col("n")) - 1) * 100
    sharpe = F.col("m") * 252 / F.nullif(F.col("s") * F.sqrt(F.lit(252.0)), F.lit(0.0))
    return out.select("strategy", growth.alias("annualized_return_pct"), sharpe.alias("sharpe_ratio"), F.coalesce("total_return", F.lit(0.0)).alias("total_return"))


def best_strategy(table: DataFrame) -> DataFrame:
    """The row with the highest Sharpe ratio; null and NaN are skipped, ties go to the first name."""
    return table.filter(F.col("sharpe_ratio").isNotNull() & ~F.isnan("sharpe_ratio")).orderBy(F.desc("sharpe_ratio"), "strategy").limit(1)


def lag_summary(selection: DataFrame) -> DataFrame:
    return selection.agg(F.avg("p_opt").alias("mean_p"), F.min("p_opt").alias("min_p"), F.max("p_opt").alias("max_p"))
