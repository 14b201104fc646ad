"""The experiment from CSV files to saved tables, sources, and the streaming score."""

import datetime
import json

import numpy as np
import pytest

from foldcast.operators import backtest, forecast_sql, panel
from foldcast.plans import experiment
from foldcast.sources import sinks, tables
from foldcast.streaming.score import score_latest

DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(70)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, rng = tmp_path_factory.mktemp("csv"), np.random.default_rng(1)
    names = ["BBB", "AAA", "SPY", "GAP"]
    x = rng.normal(0, 0.01, (70, 4))
    rows = [",".join(["ticker", *(f"X{d:%Y%m%d}" for d in DAYS)])]
    rows += [",".join([n, *("" if n == "GAP" and i == 9 else repr(float(v)) for i, v in enumerate(x[:, j]))]) for j, n in enumerate(names)]
    (out / "returns.csv").write_text("\n".join(rows))
    (out / "DFF_20000103_20201231.csv").write_text("observation_date,DFF\n" + "\n".join(f"{d},{rng.normal() if i % 4 else ''}" for i, d in enumerate(DAYS)))
    (out / "VIX_20000103_20201231.csv").write_text("observation_date,VIXCLS,DFF\n" + "\n".join(f"{d},{rng.normal()},1.5" for d in DAYS))
    return out, x


def test_sources(spark, folder):
    out, x = folder
    r = tables.read_returns(spark, str(out / "returns.csv"))
    assert r.columns == ["date", "series", "value", "place"] and r.count() == 280
    assert r.filter("series = 'BBB'").orderBy("date").first().value == x[0, 0]
    assert {s.series for s in panel.first_series(r, 1, "place").select("series").distinct().collect()} == {"BBB"}
    assert {s.series for s in panel.first_series(r, 1).select("series").distinct().collect()} == {"AAA"}
    vix = f"{out}/VIX_20000103_20201231.csv"
    assert tables.read_confounders(spark, [vix], until={vix: str(DAYS[9])}).count() == 20
    assert {s.series for s in panel.complete_series(r).select("series").distinct().collect()} == {"AAA", "BBB", "SPY"}
    c = tables.read_confounders(spark, [f"{out}/DFF_20000103_20201231.csv", f"{out}/absent.csv", f"{out}/VIX_20000103_20201231.csv"])
    assert {s.series for s in c.select("series").distinct().collect()} == {"DFF", "VIXCLS", "DFF_2"} and c.count() == 210
    assert c.filter("value is null").count() == 18
    with pytest.raises(Exception, match="absent"):
        tables.read_confounders(spark, [f"{out}/absent.csv"], on_missing="raise")
    assert tables.read_confounders(spark, [f"{out}/absent.csv"]) is None
    with pytest.raises(ValueError):
        tables.source_files(str(out), other=True)


@pytest.mark.parametrize("analysis", ["Plain VAR", "OR-VAR", "ORACLE-VAR"])
def test_experiment(spark, folder, tmp_path, analysis):
    out, x = folder
    config = experiment.Config(
        f"{out}/returns.csv", str(out), analysis, ("AAA", "BBB", "SPY"), {"macro": True, "vix": True}, lookback=40, p_max=2, model_y="ols", model_t="ols",
        beta_neutral=analysis == "OR-VAR", beta_window=5, output=f"file://{tmp_path}",
    )
    got = experiment.run(spark, config)
    assert got.adjusted and got.forecasts.count() == 29 * 3
    assert {r.t for r in got.forecasts.select("t").distinct().collect()} == set(range(41, 70))
    assert got.performance.count() == len(backtest.STRATEGIES)
    saved = spark.read.parquet(f"{tmp_path}/{config.name}/pnl")
    assert saved.count() == 29 * 5
    days = spark.createDataFrame(list(enumerate(DAYS)), "t int, date date")
    assert sinks.lag_plot(got.selection, days).count() == 29
    assert sinks.strategy_plot(got.pnl, days, got.adjusted).count() == 29 * 5 and "Sharpe" in sinks.summary(got.performance)
    assert json.loads(spark.read.text(f"{tmp_path}/{config.name}/config").first().value)["analysis"] == analysis
    assert spark.read.csv(f"{tmp_path}/{config.name}/performance", header=True).columns == ["strategy", "annualized_return_pct", "sharpe_ratio", "total_return"]


def test_buy_and_hold_without_adjustment(spark, folder):
    out, x = folder
    config = experiment.Config(f"{out}/returns.csv", None, "Plain VAR", ("AAA", "SPY"), lookback=40, p_max=1, market_adjustment=False, subset_days=10)
    got = experiment.run(spark, config)
    held = got.pnl.filter("strategy = 'buy_and_hold'").orderBy("t").collect()
    assert not got.adjusted and len(held) == 10
    assert held[-1].cumulative == pytest.approx(np.exp(x[-10:, 2].sum()) - 1)
    for bad in ({"analysis": "other"}, {"assets": "other"}):
        with pytest.raises(ValueError):
            experiment.Config("x", **bad)
    with pytest.raises(KeyError):
        experiment.run(spark, experiment.Config(f"{out}/returns.csv", None, "Plain VAR", "ETF", lookback=40))


def test_streaming_scores_equal_the_batch(spark, folder, tmp_path):
    out, _ = folder
    every = panel.complete_series(tables.read_returns(spark, f"{out}/returns.csv")).drop("place")
    for i, (lo, hi) in enumerate(((0, 50), (50, 60), (60, 70))):
        every.filter(every.date.between(DAYS[lo], DAYS[hi - 1])).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(every.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        score_latest(stream, f"{tmp_path}/history", f"{tmp_path}/out", f"{tmp_path}/check", 20).awaitTermination()
    got = {(r.date, r.series): r.f for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = panel.with_t(every)
    want = {(r.date, r.series): r.f for r in forecast_sql.ar1(whole, 20).join(whole.select("t", "date").distinct(), "t").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
