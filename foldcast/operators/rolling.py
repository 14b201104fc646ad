"""Rolling-origin models: plain VAR(X), OR-VAR and ORACLE-VAR.

Every origin looks at a bounded stretch of rows. Origins are cut into runs and each row of the panel goes to the runs
that look at it: a run is LEAST origins or lookback / COPIES, so that a row goes to about COPIES runs at most where the
lookback is long, and runs are short where fits are many and rows few. A run is one group of one Python task. Nothing is
broadcast and no task sees the whole panel, so runs, panels and lookbacks scale by adding tasks. Inside a task the
fits are numpy; choice and forecast of an origin need one pass. Fold s of one origin is fold s - 1 of the next, so a run
fits each slice once. The table of fold errors is there too, with its selection as a DataFrame aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dml import LinearDml, choose_lags, lagged
from ..functions.estimators import regressor
from .lags import vectors
from .windows import WindowSpec

LEAST, COPIES = 8, 32
ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0)


def row_rmse(truth: np.ndarray, guess: np.ndarray) -> float:
    """Root of the mean squared error over the outputs."""
    return float(np.sqrt(np.mean((truth - guess) ** 2)))


def mean_output_rmse(truth: np.ndarray, guess: np.ndarray) -> float:
    """Mean over the outputs of each one's root mean square; for one row the mean absolute error."""
    return float(np.mean(np.sqrt(np.mean((truth - guess) ** 2, axis=0))))


METRICS = {"row_rmse": row_rmse, "mean_output_rmse": mean_output_rmse}


def run_length(spec: WindowSpec) -> int:
    return max(LEAST, spec.lookback // COPIES)


def _runs(assets: DataFrame, confounders: DataFrame | None, spec: WindowSpec, n: int) -> DataFrame:
    """(run, t, y, w): each row once for every run of origins that looks at it."""
    rows = vectors(assets, "y")
    rows = rows.join(vectors(confounders, "w"), "t") if confounders is not None else rows.withColumn("w", F.array().cast("array<double>"))
    first, last = F.greatest(F.lit(spec.lookback), F.col("t") - 1), F.least(F.lit(n - 2), F.col("t") + spec.lookback)
    size = run_length(spec)
    runs = F.when(first <= last, F.sequence(F.floor(first / size), F.floor(last / size)))
    # A number of its own, as adaptive execution would put rows this few into one task, however long they take to fit.
    tasks = max(1, min(-(-n // size), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return rows.withColumn("run", F.explode(runs)).repartition(tasks, "run")


_ARROW = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def _each_origin(assets, confounders, spec, schema: str, work: Callable[[np.ndarray, np.ndarray | None, int, int, dict], Iterator[tuple]]) -> DataFrame:
    """Apply work(y, w, base, origin, memo) over the origins; y[base] is the row t = 0 of the panel (base may be negative), memo lasts for a run."""
    n = assets.agg((F.max("t") + 1).alias("n")).first().n or 0
    spec.origins(n)
    types = [tuple(c.strip().split(" ")) for c in schema.split(",")]
    has_w = confounders is not None

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("t")
        t, out, memo = rows.column("t").to_numpy(), [], {}
        if t[-1] - t[0] + 1 != len(t):
            raise ValueError("a date is missing or repeated in the panel")
        y, w = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if c == "y" or has_w else None for c in "yw")
        first = key[0].as_py() * run_length(spec)
        for d in range(max(spec.lookback, first), min(n - 1, first + run_length(spec))):
            out += work(y, w, -int(t[0]), d, memo)
        return pa.table([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*out) if out else [()] * len(types), types)], names=[name for name, _ in types])

    return _runs(assets, confounders, spec, n).groupBy("run").applyInArrow(run, schema)


def _design(y, w, lo, hi, p):
    """(Y, asset lags, confounder lags) of the slice [lo, hi], lags taken inside it, without the first p rows."""
    a = y[lo : hi + 1]
    t = np.hstack([lagged(a, k) for k in range(1, p + 1)])[p:]
    c = np.hstack([lagged(w[lo : hi + 1], k) for k in range(1, p + 1)])[p:] if w is not None else np.zeros((len(a) - p, 0))
    return a[p:], t, c


def best(errors: DataFrame, how: str = "mean") -> DataFrame:
    """(origin, p_opt, alpha_opt, valid_err): least mean (or sum of) fold error; ties go to the smaller p, then to the earlier alpha."""
    total = (F.avg if how == "mean" else F.sum)("err")
    each = errors.groupBy("origin", "p", "alpha", "place").agg(total.alias("err"))
    top = each.groupBy("origin").agg(F.min_by(F.struct("p", "alpha", "err"), F.struct("err", "p", "place")).alias("b"))
    return top.select("origin", F.col("b.p").alias("p_opt"), F.col("b.alpha").alias("alpha_opt"), F.col("b.err").alias("valid_err"))


ERRORS = "origin int, p int, alpha double, place int, shift int, err double"
FORECAST = "origin int, target_t int, p_opt int, alpha_opt double, valid_err double, y_hat array<double>"


class _Grid:
    """A model over the grid of lags and alphas: fold errors, or in one pass the choice and the forecast of each origin."""

    def __init__(self, spec, p_max, alphas, fit, metric, how):
        self.spec, self.fit, self.metric, self.how = spec, fit, METRICS[metric], how
        self.cells = [(p, a, i) for p in range(1, p_max + 1) for i, a in enumerate(alphas)]

    def error(self, y, w, base, d, p, a, s, memo) -> float:
        lo, hi = self.spec.fold(d, s)
        if (lo, hi, p, a) not in memo:
            yy, t, c = _design(y, w, lo + base, hi + base, p)
            memo[lo, hi, p, a] = self.metric(yy[-1:], self.fit(yy[:-1], t[:-1], c[:-1], t[-1:], c[-1:], a))
        return memo[lo, hi, p, a]

    def errors(self, y, w, base, d, memo):
        for p, a, i in self.cells:
            for s in range(self.spec.days_valid):
                yield d, p, a, i, s, self.error(y, w, base, d, p, a, s, memo)

    def forecast(self, y, w, base, d, memo):
        total = np.mean if self.how == "mean" else np.sum
        scored = [(float(total([self.error(y, w, base, d, p, a, s, memo) for s in range(self.spec.days_valid)])), p, i, a) for p, a, i in self.cells]
        err, p, _, a = min(scored, key=lambda x: (np.isnan(x[0]), *x[:3]))
        lo, hi = self.spec.final(d)
        yy, t, c = _design(y, w, lo + base, hi + base, p)
        yield d, hi, p, a, err, self.fit(yy[:-1], t[:-1], c[:-1], t[-1:], c[-1:], a)[0].tolist()


def _var_grid(spec, p_max, model, alphas, error_metric) -> _Grid:
    if model not in ("ols", "lasso"):
        raise ValueError(f"model is ols or lasso, not {model!r}")
    if error_metric != "rmse":
        raise ValueError(f"unsupported error metric {error_metric!r}")

    def fit(y, t, c, t1, c1, alpha):
        x, x1 = np.hstack([t, c]), np.hstack([t1, c1])
        return regressor(model, **({} if alpha is None else {"alpha": alpha})).fit(x, y).predict(x1)

    return _Grid(spec, p_max, list(alphas) if model == "lasso" else [None], fit, "row_rmse", "mean")


def var_errors(assets: DataFrame, confounders: DataFrame | None = None, spec: WindowSpec | None = None, p_max: int = 5, model: str = "ols", alphas=ALPHAS, error_metric: str = "rmse") -> DataFrame:
    """The table of fold errors of plain VAR(X): (origin, p, alpha, place, shift, err); ``best`` picks from it."""
    spec = spec or WindowSpec()
    return _each_origin(assets, confounders, spec, ERRORS, _var_grid(spec, p_max, model, alphas, error_metric).errors)


def var(assets: DataFrame, confounders: DataFrame | None = None, spec: WindowSpec | None = None, p_max: int = 5, model: str = "ols", alphas=ALPHAS, error_metric: str = "rmse") -> DataFrame:
    """Plain VAR, or VARX if there are confounders: (origin, target_t, p_opt, alpha_opt, valid_err, y_hat).

    assets and confounders are complete long panels (t, series, value). Model is ols or lasso; the fold error is
    row_rmse and its mean over the folds is minimised over p = 1..p_max (and, for lasso, alpha).
    """
    spec = spec or WindowSpec()
    return _each_origin(assets, confounders, spec, FORECAST, _var_grid(spec, p_max, model, alphas, error_metric).forecast)


def _need(confounders):
    if confounders is None:
        raise ValueError("double machine learning needs confounders")


def or_var(assets: DataFrame, confounders: DataFrame | None, spec: WindowSpec | None = None, p_max: int = 5, model_y: str = "extra_trees", model_t: str = "extra_trees", y_params=None, t_params=None, cv_folds: int = 5, error_metric: str = "rmse", profile: str = "core") -> DataFrame:
    """OR-VAR: asset lags as treatments, confounder lags as controls; p by the sum over the folds of mean_output_rmse.

    target_offset = 1 is the sequential variant and forecasts the day after the origin; 0 is the parallel variant,
    which forecasts the origin's own day. The output always carries the true target_t.
    """
    _need(confounders)
    spec = spec or WindowSpec()
    if error_metric != "rmse":
        raise ValueError(f"unsupported error metric {error_metric!r}")

    def fit(y, t, c, t1, c1, _):
        return LinearDml(model_y, model_t, cv_folds, y_params, t_params, profile).fit(y, t, c).predict(t1, c1)

    return _each_origin(assets, confounders, spec, FORECAST, _Grid(spec, p_max, [None], fit, "mean_output_rmse", "sum").forecast).drop("alpha_opt")


def oracle_var(assets: DataFrame, confounders: DataFrame | None, lookback: int = 1008, p_max: int = 5, significance: float = 0.05, model_y: str = "extra_trees", model_t: str = "extra_trees", y_params=None, t_params=None, cv_folds: int = 5, profile: str = "core") -> DataFrame:
    """ORACLE-VAR: (origin, target_t, p_opt, treatment_lags, control_lags, max_confound_lag, rank, y_hat), lags chosen by significance."""
    _need(confounders)
    spec = WindowSpec(lookback, 0, 1)
    model = {"model_y": model_y, "model_t": model_t, "folds": cv_folds, "y_params": y_params, "t_params": t_params, "profile": profile}

    def work(y, w, base, d, memo):
        lo, hi = spec.final(d)
        got = choose_lags(y[lo + base : hi + base + 1], w[lo + base : hi + base + 1], p_max, significance, **model)
        yield d, hi, got["p_opt"], got["treatment"], got["control"], got["max_confound_lag"], got["rank"], got["y_hat"].tolist()

    return _each_origin(assets, confounders, spec, "origin int, target_t int, p_opt int, treatment_lags array<int>, control_lags array<int>, max_confound_lag int, rank int, y_hat array<double>", work)


def dml_coefficients(assets: DataFrame, confounders: DataFrame | None, lookback: int = 1008, p: int = 1, model_y: str = "ols", model_t: str = "ols", cv_folds: int = 5, y_params=None, t_params=None, profile: str = "core") -> DataFrame:
    """(origin, outcome, treatment, theta, stderr) of the final stage at each origin; outcomes and treatments are numbered from 1, lag by lag."""
    _need(confounders)
    spec = WindowSpec(lookback, 0, 1)

    def work(y, w, base, d, memo):
        lo, hi = spec.final(d)
        a, t, c = _design(y, w, lo + base, hi + base, p)
        fit = LinearDml(model_y, model_t, cv_folds, y_params, t_params, profile).fit(a[:-1], t[:-1], c[:-1], inference=True)
        for o, j in np.ndindex(fit.theta.shape):
            yield d, o + 1, j + 1, float(fit.theta[o, j]), float(fit.stderr[o, j])

    return _each_origin(assets, confounders, spec, "origin int, outcome int, treatment int, theta double, stderr double", work)


def long_forecast(forecasts: DataFrame, series: list[str]) -> DataFrame:
    """(origin, t, series, f): a row for each series, in the order of their names."""
    names = F.array(*[F.lit(s) for s in sorted(series)])
    each = forecasts.select("origin", F.col("target_t").alias("t"), F.posexplode("y_hat").alias("i", "f"))
    return each.select("origin", "t", F.element_at(names, F.col("i") + 1).alias("series"), "f")


def lag_mask(selection: DataFrame, p_max: int) -> DataFrame:
    """(origin, lag, treatment, control): 0/1 marks of the lags that ORACLE-VAR used at each origin, lags 1 to p_max."""
    each = selection.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(p_max))))
    mark = lambda c: F.array_contains(c, F.col("lag")).cast("int")
    return each.select("origin", "lag", mark("treatment_lags").alias("treatment"), mark("control_lags").alias("control"))
