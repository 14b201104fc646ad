"""Linear double machine learning with time-series cross-fitting, and the lag decision, in numpy.

What is taken from the estimator's public documentation and could not be measured here: rows before the first test
block take no part in the final stage; the final stage has no intercept; covariances are HC1. A rank-deficient
treatment block is solved by minimum norm; with no residual degrees of freedom standard errors are NaN, and a NaN
p-value counts as not significant.
"""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np

from .estimators import regressor


def split_bounds(n: int, folds: int) -> list[tuple[int, int]]:
    """(first, end) of each test block; the fold trains on all rows before it."""
    h = n // (folds + 1)
    if h < 1:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    return [(n - (folds - k) * h, n - (folds - k - 1) * h) for k in range(folds)]


class LinearDml:
    def __init__(self, model_y="ols", model_t="ols", folds=5, y_params=None, t_params=None, profile="core"):
        self.make_y = lambda: regressor(model_y, profile, **(y_params or {}))
        self.make_t = lambda: regressor(model_t, profile, **(t_params or {}))
        self.folds = folds

    def fit(self, y, t, w, inference=False):
        n, dt = t.shape
        self.models, y_res, t_res = [], [], []
        for lo, hi in split_bounds(n, self.folds):
            model = self.make_y().fit(w[:lo], y[:lo])
            self.models.append(model)
            y_res.append(y[lo:hi] - model.predict(w[lo:hi]))
            t_res.append(t[lo:hi] - self.make_t().fit(w[:lo], t[:lo]).predict(w[lo:hi]))
        ry, rt = np.concatenate(y_res), np.concatenate(t_res)
        theta, _, self.rank, _ = np.linalg.lstsq(rt, ry, rcond=None)
        self.theta = theta.T
        if inference:
            m, error = len(rt), ry - rt @ theta
            if m - dt <= 0:
                self.stderr = np.full(self.theta.shape, np.nan)
            else:
                bread = np.linalg.pinv(rt.T @ rt)
                half = rt @ bread
                self.stderr = np.sqrt(np.maximum(0, np.stack([np.einsum("ij,i,ij->j", half, e**2, half) for e in error.T]) * m / (m - dt)))
        return self

    def predict(self, t, w):
        """Mean of the folds' outcome models plus the raw treatment times theta."""
        return np.mean([m.predict(w) for m in self.models], 0) + t @ self.theta.T


def two_sided(z) -> np.ndarray:
    return np.array([erfc(abs(x) / sqrt(2)) if np.isfinite(x) else (0.0 if np.isinf(x) else np.nan) for x in np.ravel(z)])


def least_adjusted(p) -> float:
    """The smallest Benjamini-Hochberg adjusted p-value; NaN if any p-value is missing."""
    p = np.asarray(p, float)
    if not len(p) or np.isnan(p).any():
        return float("nan")
    return float(min(1.0, (np.sort(p) * len(p) / np.arange(1, len(p) + 1)).min()))


def match_coefficients(before: list[str], after: list[str], outcomes: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Places of the shared coefficients in both outcome-major vectors, and of the new ones in the second."""
    pairs = [(o * len(before) + before.index(x), o * len(after) + j) for o in range(outcomes) for j, x in enumerate(after) if x in before]
    new = [o * len(after) + j for o in range(outcomes) for j, x in enumerate(after) if x not in before]
    return pairs, new


def lagged(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[k:] = x[: len(x) - k]
    return out


def choose_lags(y: np.ndarray, w: np.ndarray, p_max: int, alpha: float, **model) -> dict:
    """The iterative lag test on one slice whose last row is the target.

    A lag of the assets becomes a treatment if its coefficients are significant, a control if the earlier ones drift,
    else the search stops; confounder lags are taken in before each test and stay in after a rejected one.
    """
    assets = y.shape[1]
    treat, control, deepest, last = [1], [], 1, 1

    def design(treatments):
        t = np.hstack([lagged(y, k) for k in treatments])
        c = np.hstack([lagged(w, k) for k in range(1, deepest + 1)] + [lagged(y, k) for k in control])
        keep = ~(np.isnan(t).any(1) | np.isnan(c).any(1))
        return y[keep], t[keep], c[keep]

    def fitted(treatments, inference=True):
        a, t, c = design(treatments)
        return LinearDml(**model).fit(a[:-1], t[:-1], c[:-1], inference), t[-1:], c[-1:]

    for p in range(2, p_max + 1):
        deepest = p
        pre, post = fitted(treat)[0], fitted([*treat, p])[0]
        names = [f"{a}:{k}" for k in treat for a in range(assets)]
        pairs, new = match_coefficients(names, names + [f"{a}:{p}" for a in range(assets)], assets)
        with np.errstate(divide="ignore", invalid="ignore"):
            th0, th1, se0, se1 = pre.theta.ravel(), post.theta.ravel(), pre.stderr.ravel(), post.stderr.ravel()
            i, j = np.array([x[0] for x in pairs]), np.array([x[1] for x in pairs])
            significant = least_adjusted(two_sided(th1[new] / se1[new]))
            drift = least_adjusted(two_sided((th1[j] - th0[i]) / np.sqrt(se1[j] ** 2 + se0[i] ** 2)))
        if significant < alpha:
            treat.append(p)
            last = p
        elif drift < alpha:
            control.append(p)
            last = p
        else:
            last = p - 1
            break
    model_, t, c = fitted(treat, False)
    return {"p_opt": last, "treatment": treat, "control": control, "max_confound_lag": deepest, "rank": int(model_.rank), "y_hat": model_.predict(t, c)[0]}
