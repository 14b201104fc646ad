"""One experiment end to end: read, select, align, validate, forecast, backtest, save."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, panel, rolling, windows
from ..sources import sinks, tables

log = logging.getLogger(__name__)
#: The tickers of the ETF selection.
ETFS = ("SPY", "XLY", "XLP", "XLE", "XLF", "XLV", "XLI", "XLB", "XLK", "XLU", "EWH", "EWJ", "EWQ", "EWS", "EWU")


@dataclass
class Config:
    returns: str
    confounder_folder: str | None = None
    analysis: str = "ORACLE-VAR"  # or Plain VAR, OR-VAR
    assets: str | tuple[str, ...] = "TOP20"  # ETF, TOP20 or names
    use: dict[str, bool] = field(default_factory=lambda: {"macro": True, "trade": True, "vix": True, "covid": False})
    covid_until: str = "2020-12-31"
    subset_days: int | None = None
    significance: float = 0.15
    lookback: int = 252
    days_valid: int = 2
    target_offset: int = 1
    p_max: int = 10
    model_y: str = "extra_trees"
    model_t: str = "extra_trees"
    model_y_params: dict = field(default_factory=dict)
    model_t_params: dict = field(default_factory=dict)
    cv_folds: int = 5
    interpolation: str = "ffill"  # linear looks ahead in interior gaps
    market_adjustment: bool = True
    beta_neutral: bool = False
    beta_window: int = 63
    benchmark: str = "SPY"
    strategies: tuple[backtest.Strategy, ...] = backtest.STRATEGIES
    output: str | None = None

    def __post_init__(self):
        if self.analysis not in ("Plain VAR", "OR-VAR", "ORACLE-VAR"):
            raise ValueError(f"unknown analysis type {self.analysis!r}")
        if isinstance(self.assets, str) and self.assets not in ("ETF", "TOP20"):
            raise ValueError(f"unknown asset selection {self.assets!r}")

    @property
    def name(self) -> str:
        kind = self.analysis.lower().replace(" ", "_").replace("-", "_")
        chosen = self.assets.lower() if isinstance(self.assets, str) else "chosen"
        return f"{kind}_{chosen}_L{self.lookback}_p{self.p_max}_{self.model_y}"


@dataclass
class Result:
    forecasts: DataFrame  # origin, t, series, f
    selection: DataFrame  # what the model chose at each origin
    pnl: DataFrame
    performance: DataFrame
    adjusted: bool


def prepare(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(assets, confounders or None, benchmark or None), all with the same t."""
    every = panel.complete_series(tables.read_returns(spark, config.returns))
    if config.assets == "ETF":
        chosen = panel.named_series(every, list(ETFS))
    elif config.assets == "TOP20":
        chosen = panel.first_series(every, 20, "place")
    else:
        chosen = panel.named_series(every, list(config.assets))
    assets = panel.with_t(chosen)
    if config.subset_days is not None:
        want = config.lookback + 1 + config.subset_days
        assets = panel.tail_days(assets, want)
        if (have := assets.select("t").distinct().count()) < want:
            log.warning("%d rows wanted, all %d are kept", want, have)
        assets = panel.with_t(assets.select("date", "series", "value"))
    days = assets.select("t", "date").distinct()
    confounders = None
    if config.confounder_folder is not None and (files := tables.source_files(config.confounder_folder, **config.use)):
        covid = set(tables.source_files(config.confounder_folder, covid=True))
        raw = tables.read_confounders(spark, files, until={p: config.covid_until for p in files if p in covid})
        if raw is not None:
            filled = panel.interpolate(raw, config.interpolation)
            confounders = panel.require_dates(filled, assets).join(days, "date").select("t", "date", "series", "value")
    bench = every.filter(F.col("series") == config.benchmark).join(days, "date").select("t", "value")
    return assets, confounders, bench if config.market_adjustment and not bench.isEmpty() else None


def run(spark: SparkSession, config: Config) -> Result:
    """The whole experiment; with ``output`` set its tables are saved below output/name.

    Without a benchmark series the returns stay unadjusted and a buy-and-hold row is left out. The unadjusted returns
    are computed only if they are asked for.
    """
    assets, confounders, bench = prepare(spark, config)
    panel.validate(assets, confounders, config.lookback, config.days_valid)
    names = sorted(r.series for r in assets.select("series").distinct().collect())
    if config.analysis == "Plain VAR":
        model = config.model_y
        if model not in ("ols", "lasso"):
            log.warning("Plain VAR knows ols and lasso, not %s: ols is used", model)
            model = "ols"
        got = rolling.var(assets, confounders, windows.WindowSpec(config.lookback, config.days_valid, 1), config.p_max, model)
    elif config.analysis == "OR-VAR":
        spec = windows.WindowSpec(config.lookback, config.days_valid, config.target_offset)
        got = rolling.or_var(assets, confounders, spec, config.p_max, config.model_y, config.model_t, config.model_y_params, config.model_t_params, config.cv_folds)
    else:
        got = rolling.oracle_var(assets, confounders, config.lookback, config.p_max, config.significance, config.model_y, config.model_t, config.model_y_params, config.model_t_params, config.cv_folds)
    if config.output is not None:  # the fits are the expensive part: run them once
        got.write.mode("overwrite").parquet(f"{config.output}/{config.name}/model")
        got = spark.read.parquet(f"{config.output}/{config.name}/model")
    forecasts = rolling.long_forecast(got, names)
    pnl = backtest.sweep(forecasts, assets, len(names), config.strategies, bench, config.beta_neutral, config.beta_window)
    if bench is None and config.benchmark in names:
        first = forecasts.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        held = assets.filter(F.col("series") == config.benchmark).crossJoin(F.broadcast(first)).filter("t between lo and hi")
        pnl = pnl.unionByName(backtest.buy_and_hold(held))
    result = Result(forecasts, got.drop("y_hat"), pnl, backtest.performance(pnl), bench is not None)
    if config.output is not None:
        folder = f"{config.output}/{config.name}"
        sinks.save_tables({"forecasts": result.forecasts, "selection": result.selection, "pnl": result.pnl}, folder)
        sinks.save_performance(result.performance, folder)
        sinks.save_config(spark, config, folder)
    return result
