"""Rolling models against plain loops over their definitions, estimators against closed forms, and properties."""

import math

import numpy as np
import pytest

from foldcast.functions import dml, estimators
from foldcast.operators import backtest, lags, panel, rolling, windows

N, D, L, V = 46, 3, 30, 2


def data(seed=1, n=N, d=D, k=2):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(n, k))
    y = np.zeros((n, d))
    for t in range(1, n):
        y[t] = 0.4 * y[t - 1] + 0.3 * w[t - 1].sum() + 0.2 * (y[t - 2] if t > 1 else 0) + rng.normal(0, 0.3, d)
    return y, w


def long(spark, x, prefix):
    rows = [(t, f"{prefix}{j}", float(x[t, j])) for t in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "t int, series string, value double").repartition(3)


def lag_rows(x, lo, hi, u, p):
    """Lags 1..p of row u, lag by lag; rows before lo don't exist."""
    assert u - p >= lo
    return np.concatenate([x[u - k] for k in range(1, p + 1)])


def slice_design(y, w, lo, hi, p):
    rows = range(lo + p, hi + 1)
    return np.array([y[u] for u in rows]), np.array([lag_rows(y, lo, hi, u, p) for u in rows]), np.array([lag_rows(w, lo, hi, u, p) if w is not None else [] for u in rows])


def ols(x, y, x1):
    a = np.column_stack([np.ones(len(x)), x])
    return np.column_stack([np.ones(len(x1)), x1]) @ np.linalg.lstsq(a, y, rcond=None)[0]


def plain_dml(y, t, w, t1, w1, k=5):
    n, h, ry, rt, base = len(y), len(y) // (k + 1), [], [], []
    for i in range(k):
        lo = n - (k - i) * h
        ry.append(y[lo : lo + h] - ols(w[:lo], y[:lo], w[lo : lo + h]))
        rt.append(t[lo : lo + h] - ols(w[:lo], t[:lo], w[lo : lo + h]))
        base.append(ols(w[:lo], y[:lo], w1))
    theta = np.linalg.lstsq(np.concatenate(rt), np.concatenate(ry), rcond=None)[0]
    return np.mean(base, 0) + t1 @ theta


def plain(y, w, o, p_max, kind):
    out = {}
    for d in range(L, len(y) - 1):
        score = {}
        for p in range(1, p_max + 1):
            errors = []
            for s in range(V):
                lo, hi = d - L + s, d - V + o + s
                a, t, c = slice_design(y, w, lo, hi, p)
                guess = ols(np.hstack([t, c])[:-1], a[:-1], np.hstack([t, c])[-1:]) if kind == "var" else plain_dml(a[:-1], t[:-1], c[:-1], t[-1:], c[-1:])
                errors.append(math.sqrt(((a[-1] - guess[0]) ** 2).mean()) if kind == "var" else np.abs(a[-1] - guess[0]).mean())
            score[p] = sum(errors)
        p = min(score, key=lambda q: (score[q], q))
        a, t, c = slice_design(y, w, d - L, d + o, p)
        f = ols(np.hstack([t, c])[:-1], a[:-1], np.hstack([t, c])[-1:]) if kind == "var" else plain_dml(a[:-1], t[:-1], c[:-1], t[-1:], c[-1:])
        out[d] = (d + o, p, f[0])
    return out


def same(rows, want):
    assert {r.origin for r in rows} == set(want)
    for r in rows:
        target, p, f = want[r.origin]
        assert (r.target_t, r.p_opt) == (target, p)
        assert np.allclose(r.y_hat, f, atol=1e-8)


@pytest.mark.parametrize("exogenous", [False, True])
def test_var_equals_loop(spark, exogenous):
    y, w = data()
    w = w if exogenous else None
    got = rolling.var(long(spark, y, "a"), long(spark, w, "c") if exogenous else None, windows.WindowSpec(L, V), 2).collect()
    same(got, plain(y, w, 1, 2, "var"))


def test_errors_select_what_the_forecast_used(spark):
    y, _ = data(4)
    spec = windows.WindowSpec(L, V)
    for model in ("ols", "lasso"):
        picked = {r.origin: (r.p_opt, r.alpha_opt, r.valid_err) for r in rolling.best(rolling.var_errors(long(spark, y, "a"), None, spec, 2, model, (0.001, 0.1))).collect()}
        used = {r.origin: (r.p_opt, r.alpha_opt, r.valid_err) for r in rolling.var(long(spark, y, "a"), None, spec, 2, model, (0.001, 0.1)).collect()}
        assert set(picked) == set(used)
        assert all(picked[d][:2] == used[d][:2] and abs(picked[d][2] - used[d][2]) < 1e-12 for d in used)


@pytest.mark.parametrize("offset", [0, 1])
def test_or_var_equals_loop(spark, offset):
    y, w = data(2)
    got = rolling.or_var(long(spark, y, "a"), long(spark, w, "c"), windows.WindowSpec(L, V, offset), 2, "ols", "ols").collect()
    same(got, plain(y, w, offset, 2, "dml"))


def test_oracle_var_equals_function_and_mask(spark):
    y, w = data(3, 120)
    frame = rolling.oracle_var(long(spark, y, "a"), long(spark, w, "c"), lookback=100, p_max=4, significance=0.2, model_y="ols", model_t="ols").cache()
    got, marks = frame.collect(), rolling.lag_mask(frame, 4).collect()
    assert {(r.origin, m) for r in got for m in r.treatment_lags} == {(r.origin, r.lag) for r in marks if r.treatment}
    assert {(r.origin, m) for r in got for m in r.control_lags} == {(r.origin, r.lag) for r in marks if r.control}
    assert sorted(r.origin for r in got) == list(range(100, 119))
    for r in got:
        lags_ = sorted(r.treatment_lags + r.control_lags)
        assert lags_[0] == 1 and r.treatment_lags[0] == 1 and max(lags_) == r.p_opt
        assert r.max_confound_lag == min(4, r.p_opt + 1)
        lo = r.origin - 100
        rows = range(lo + r.max_confound_lag, r.origin + 2)
        t = np.array([np.concatenate([y[u - k] for k in r.treatment_lags]) for u in rows])
        c = np.array([np.concatenate([w[u - k] for k in range(1, r.max_confound_lag + 1)] + [y[u - k] for k in r.control_lags]) for u in rows])
        a = np.array([y[u] for u in rows])
        assert np.allclose(r.y_hat, plain_dml(a[:-1], t[:-1], c[:-1], t[-1:], c[-1:])[0], atol=1e-8)


def test_null_rejections_are_near_the_level():
    rng = np.random.default_rng(5)
    accepted = []
    for _ in range(60):
        y, w = rng.normal(size=(200, 2)), rng.normal(size=(200, 2))
        accepted.append(2 in dml.choose_lags(y, w, 2, 0.1, model_y="ols", model_t="ols")["treatment"])
    assert np.mean(accepted) < 0.3


def test_dml_recovers_an_effect_that_plain_regression_misses():
    rng = np.random.default_rng(6)
    w = rng.normal(size=(4000, 3))
    t = w @ [[1.0], [0.5], [-1.0]] + rng.normal(size=(4000, 1))
    y = 0.7 * t + w @ [[2.0], [1.0], [0.0]] + rng.normal(size=(4000, 1))
    fit = dml.LinearDml().fit(y, t, w, inference=True)
    assert abs(fit.theta[0, 0] - 0.7) < 0.05 < abs(ols(t, y, np.ones((1, 1)))[0, 0] - ols(t, y, np.zeros((1, 1)))[0, 0] - 0.7)
    assert 0.01 < fit.stderr[0, 0] < 0.03


def test_too_many_treatments_give_no_decision():
    rng = np.random.default_rng(7)
    y, w = rng.normal(size=(40, 16)), rng.normal(size=(40, 1))  # 30 residual rows, 32 treatments
    out = dml.choose_lags(y, w, 4, 0.5, model_y="ols", model_t="ols")
    assert out["p_opt"] == 1 and out["treatment"] == [1] and np.isfinite(out["y_hat"]).all()


def test_no_look_ahead(spark):
    y, w = data(8)
    spec, cut = windows.WindowSpec(L, V), 40
    a = {r.origin: r.y_hat for r in rolling.var(long(spark, y, "a"), long(spark, w, "c"), spec, 2).collect()}
    y2, w2 = y.copy(), w.copy()
    y2[cut:], w2[cut:] = 99.0, -5.0
    b = {r.origin: r.y_hat for r in rolling.var(long(spark, y2, "a"), long(spark, w2, "c"), spec, 2).collect()}
    assert all(np.allclose(a[d], b[d]) for d in a if d + 1 <= cut) and not np.allclose(a[cut], b[cut])


def test_window_arithmetic():
    for offset, first in ((1, 989), (0, 988)):
        spec = windows.WindowSpec(1008, 20, offset)
        assert [spec.fold(1008, s)[1] for s in range(20)] == list(range(first, first + 20))
        assert spec.final(1008) == (0, 1008 + offset)
    assert len(windows.WindowSpec(1008, 20).origins(1300)) == 291
    assert len(windows.WindowSpec(30, 2).origins(31)) == 0
    with pytest.raises(ValueError):
        windows.WindowSpec(30, 2).origins(30)
    with pytest.raises(ValueError):
        windows.WindowSpec(20, 20)


def test_rejected_arguments(spark):
    y, w = (long(spark, x, n) for x, n in zip(data(), "ac"))
    spec = windows.WindowSpec(L, V)
    for call in (lambda: rolling.or_var(y, None, spec), lambda: rolling.oracle_var(y, None), lambda: rolling.var(y, w, spec, model="ridge"), lambda: rolling.var(y, w, spec, error_metric="mae"), lambda: rolling.var(y, w, windows.WindowSpec(500, 2))):
        with pytest.raises(ValueError):
            call()
    for p in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            lags.make_lags(y, ["a0"], p)
    with pytest.raises(KeyError):
        estimators.regressor("none such")
    for bad in (lambda: backtest.Strategy("x", "other"), lambda: backtest.Strategy("x", "top", 0)):
        with pytest.raises(ValueError):
            bad()


def test_lag_names_and_nulls(spark):
    x = spark.createDataFrame([(t, s, float(v)) for s, start in (("A", 1), ("B", 5)) for t, v in enumerate(range(start, start + 4))], "t int, series string, value double")
    out = lags.make_lags(x, ["A", "B"], 2).orderBy("t")
    assert out.columns == ["t", "A_lag1", "B_lag1", "A_lag2", "B_lag2"]
    assert [tuple(r) for r in out.collect()] == [(0, None, None, None, None), (1, 1, 5, None, None), (2, 2, 6, 1, 5), (3, 3, 7, 2, 6)]
    assert lags.make_lags(x, ["A", "B"], 1, True).columns == ["t", "A", "B", "A_lag1", "B_lag1"]
    assert lags.realign(lags.make_lags(x, ["A", "B"], 2)).count() == 2


def test_interpolation(spark):
    x = spark.createDataFrame([(f"2020-01-{i + 1:02d}", "s", v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "date string, series string, value double").selectExpr("cast(date as date) date", "series", "value")
    for mode, want in (("linear", [0, 1, 2, 3, 4, 4]), ("ffill", [0, 1, 1, 1, 4, 4])):
        assert [r.value for r in panel.interpolate(x, mode).orderBy("date").collect()] == want


def test_validation(spark):
    def frame(days, start=0):
        return spark.createDataFrame([(start + i, "s", 1.0) for i in range(days)], "n int, series string, value double").selectExpr("date_add(date'2020-01-01', n) date", "series", "value")

    assert panel.validate(frame(40), frame(45), 30, 2).warnings
    for a, c, l, v, word in ((frame(0), None, 30, 2, "empty"), (frame(40), frame(40, 900), 30, 2, "in common"), (frame(20), frame(20), 30, 2, "required"), (frame(40), frame(40), 3, 3, "greater")):
        with pytest.raises(ValueError, match=word):
            panel.validate(a, c, l, v)
    with pytest.raises(KeyError):
        panel.require_dates(frame(3), frame(5))


def test_positions(spark):
    f = spark.createDataFrame([(0, f"s{i:02d}", (i + 1) * (-1.0) ** i) for i in range(15)] + [(1, f"s{i:02d}", 0.0) for i in range(15)], "t int, series string, f double")
    for pct, n in ((0.25, 11), (0.5, 7), (0.75, 3), (1.0, 0)):
        held = [r.position for r in backtest.positions(f, backtest.Strategy("top", "top", pct), 15).filter("t = 0").collect()]
        assert sum(p != 0 for p in held) == n and sum(map(abs, held)) == pytest.approx(1.0 if n else 0.0)
    for s in (backtest.Strategy("n", "naive"), backtest.Strategy("w", "weighted"), backtest.Strategy("w", "weighted", contrarian=True)):
        assert all(r.position == 0 for r in backtest.positions(f, s, 15).filter("t = 1").collect())


def test_metrics_and_beta(spark):
    r = spark.createDataFrame([(t, d) for t, d in enumerate([0.01, -0.01, 0.02])], "t int, daily double").selectExpr("'x' strategy", "t", "daily", "0.0 net_position")
    out = backtest.performance(backtest.cumulate(r, "strategy")).first()
    total = 1.01 * 0.99 * 1.02 - 1
    assert out.total_return == pytest.approx(total) and out.annualized_return_pct == pytest.approx(((1 + total) ** 84 - 1) * 100)
    assert out.sharpe_ratio == pytest.approx(np.mean([0.01, -0.01, 0.02]) * 252 / (np.std([0.01, -0.01, 0.02], ddof=1) * 252**0.5))
    pairs = spark.createDataFrame([(t, float(2 * t), float(t)) for t in range(6)], "t int, p double, b double")
    assert [x.beta for x in backtest.rolling_beta(pairs, 4).orderBy("t").collect()] == pytest.approx([0, 0, 0, 2, 2, 2])
    assert all(x.beta == 0 for x in backtest.rolling_beta(pairs, 9).collect()) and all(x.beta == 0 for x in backtest.rolling_beta(pairs.withColumn("b", pairs.p * 0), 3).collect())
    y, _ = data(9)
    f = long(spark, y, "a").withColumnRenamed("value", "f")
    with pytest.raises(KeyError):
        backtest.pnl(f, long(spark, y, "a"), backtest.Strategy("n", "naive"), 3, benchmark="SPY")


def test_coefficient_mapping_and_adjustment():
    assert dml.match_coefficients(["a1"], ["a1", "a2"], 2) == ([(0, 0), (1, 2)], [1, 3])
    assert dml.least_adjusted([0.04, 0.01, 0.5]) == pytest.approx(0.03)
    assert math.isnan(dml.least_adjusted([0.1, float("nan")]))
    assert dml.split_bounds(13, 5) == [(3, 5), (5, 7), (7, 9), (9, 11), (11, 13)]


@pytest.mark.parametrize("name", estimators.available())
def test_every_estimator_fits_several_outputs(name):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    y = np.column_stack([x[:, 0] * 2, x[:, 1] - x[:, 2]])
    params = {"n_estimators": 15} if "forest" in name or "trees" in name else {}
    guess = estimators.regressor(name, **params).fit(x, y).predict(x)
    assert guess.shape == y.shape and (name == "radius_neighbors" or np.isfinite(guess).all())
    if name not in ("dummy", "lasso_lars", "elastic_net"):
        assert np.mean((guess - y) ** 2) < 0.7 * y.var()


def test_linear_models_meet_their_optimality_conditions():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=(60, 2))
    xc, yc = x - x.mean(0), y - y.mean(0)
    assert np.allclose(estimators.Ols().fit(x, y).predict(x), ols(x, y, x))
    ridge = estimators.Ridge(3.0).fit(x, y).coef
    assert np.allclose(xc.T @ (yc - xc @ ridge), 3.0 * ridge)
    for alpha, ratio in ((0.05, 1.0), (0.1, 0.5)):
        w = estimators.ElasticNet(alpha, ratio).fit(x, y).coef
        pull = xc.T @ (yc - xc @ w) / 60 - alpha * (1 - ratio) * w
        assert np.allclose(pull[w != 0], alpha * ratio * np.sign(w[w != 0]), atol=1e-6) and (np.abs(pull[w == 0]) <= alpha * ratio + 1e-6).all()


def test_a_forest_of_one_whole_tree_is_the_tree():
    """Without random rows, features or thresholds; weights of rows count as repeated rows (two features may part these alike)."""
    rng = np.random.default_rng(2)
    for n in (20, 47, 120):
        x, y, new = rng.normal(size=(n, 4)).round(1), rng.normal(size=(n, 3)), rng.normal(size=(60, 4))
        y += x[:, :3]
        forest = estimators.Forest(3, 4, 6, 3, 1.0, False, False).fit(x, y)
        assert np.allclose(forest.predict(new), estimators.DecisionTree(4, 6, 3, 0.0, 0.0).fit(x, y).predict(new))
        boot = estimators.Forest(1, 4, 6, 3, 1.0, True, False, seed=n).fit(x, y)
        rows = np.random.default_rng(n).integers(0, n, n)
        assert np.allclose(boot.predict(x[rows]), estimators.DecisionTree(4, 6, 3, 0.0, 0.0).fit(x[rows], y[rows]).predict(x[rows]))


def test_extra_trees_cut_inside_the_node_and_keep_their_leaves():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 3)), rng.normal(size=(80, 2))
    f = estimators.Forest(50, 5, 20, 10, 0.8).fit(x, y)
    for tree in range(50):
        node = np.zeros(80, int)
        while (f.feature[tree, node] >= 0).any():
            inner = f.feature[tree, node] >= 0
            low = x[np.arange(80), np.maximum(0, f.feature[tree, node])] <= f.cut[tree, node]
            node = np.where(inner, 2 * node + np.where(low, 1, 2), node)
        assert np.bincount(node)[np.unique(node)].min() >= 10
        for leaf in np.unique(node):
            assert np.allclose(f.value[tree, leaf], y[node == leaf].mean(0))


def test_trees_equal_the_trees_of_mllib(spark):
    """One output, no pruning: MLlib tries the same midpoints where its bins are as many as the values."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 3))
    y = np.where(x[:, 0] > 0.2, 2.0, 0.0) + 0.5 * x[:, 1] + rng.normal(0, 0.1, 90)
    frame = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame([(*map(float, r), float(v), i) for i, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, label double, i int"))
    model = DecisionTreeRegressor(maxDepth=3, maxBins=128, minInstancesPerNode=8).fit(frame)
    want = np.array([r.prediction for r in model.transform(frame).orderBy("i").collect()])
    assert np.allclose(estimators.DecisionTree(3, 16, 8, 0.0, 0.0).fit(x, y).predict(x)[:, 0], want)
    assert np.allclose(estimators.Forest(1, 3, 16, 8, 1.0, False, False).fit(x, y).predict(x)[:, 0], want)


def test_pruning_cuts_the_weakest_links():
    """Every subtree that stays lowers the impurity by more than alpha a leaf, and what is cut does not."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 2)), rng.normal(size=(200, 1))
    y[:, 0] += 3 * (x[:, 0] > 0)
    full, cut = estimators.DecisionTree(6, 10, 5, 0.0, 0.0).fit(x, y), estimators.DecisionTree(6, 10, 5, 0.0, 0.05).fit(x, y)

    def links(tree, at=0):
        node = tree.nodes[at]
        if node[0] < 0:
            return node[5], 1, []
        (c1, l1, a), (c2, l2, b) = links(tree, node[2]), links(tree, node[3])
        return c1 + c2, l1 + l2, [*a, *b, (node[5] - c1 - c2) / (l1 + l2 - 1)]

    assert min(links(full)[2]) <= 0.05 < min(links(cut)[2])
    assert links(cut)[1] < links(full)[1] and cut.nodes[0][0] == full.nodes[0][0]


def test_gaussian_process_is_the_posterior_mean():
    """By the conditional of the joint normal distribution, one point after another."""
    rng = np.random.default_rng(5)
    x, y, new = rng.normal(size=(12, 2)), rng.normal(size=(12, 2)), rng.normal(size=(4, 2))
    got = estimators.GaussianProcess(0.7, 0.01).fit(x, y).predict(new)
    k = lambda a, b: math.exp(-sum((p - q) ** 2 for p, q in zip(a, b)) / (2 * 0.7**2))
    for j in range(2):
        mean, spread = y[:, j].mean(), y[:, j].std()
        cov = np.array([[k(a, b) + 0.01 * (i == h) for h, b in enumerate(x)] for i, a in enumerate(x)])
        for i, point in enumerate(new):
            cross = np.array([k(point, a) for a in x])
            assert got[i, j] == pytest.approx(mean + spread * (cross @ np.linalg.inv(cov) @ ((y[:, j] - mean) / spread)))


def test_pls_of_all_components_is_least_squares_and_one_component_is_the_covariance():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(50, 1))
    y[:, 0] += x @ [1.0, -2.0, 0.5]
    assert np.allclose(estimators.Pls(3).fit(x, y).predict(x), ols(x, y, x))
    a, b = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean(0)) / y.std(0, ddof=1)
    w = a.T @ b / np.linalg.norm(a.T @ b)
    t = a @ w
    want = t @ (t.T @ b) / (t.T @ t) * y.std(0, ddof=1) + y.mean(0)
    assert np.allclose(estimators.Pls(1).fit(x, y).predict(x), want)


def test_lars_paths_end_where_their_optima_are():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=(60, 2))
    assert np.allclose(estimators.Lars().fit(x, y).predict(x), ols(x, y, x))
    w = estimators.LassoLars(0.05).fit(x, y).coef
    pull = (x - x.mean(0)).T @ (y - y.mean(0) - (x - x.mean(0)) @ w) / 60
    assert (w != 0).any() and np.allclose(pull[w != 0], 0.05 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(pull[w == 0]) <= 0.05 + 1e-6).all()


def test_per_output_trees_split_for_their_output_alone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = np.column_stack([x[:, 0] > 0, x[:, 1] > 0]).astype(float)
    both = estimators.regressor("decision_tree", per_output=True, max_depth=1).fit(x, y)
    assert np.allclose(both.predict(x), y)
    assert not np.allclose(estimators.regressor("decision_tree", max_depth=1).fit(x, y).predict(x), y)
    one = estimators.regressor("decision_tree", max_depth=1).fit(x, y[:, 1])
    assert np.allclose(both.predict(x)[:, 1], one.predict(x)[:, 0])


def test_knn_and_radius_against_sorted_distances():
    rng = np.random.default_rng(6)
    x, y, new = rng.normal(size=(30, 2)), rng.normal(size=(30, 2)), rng.normal(size=(5, 2))
    for q, near, inside in zip(new, estimators.Knn(3).fit(x, y).predict(new), estimators.RadiusNeighbors(0.8).fit(x, y).predict(new)):
        d = [math.dist(q, a) for a in x]
        assert np.allclose(near, y[sorted(range(30), key=lambda i: d[i])[:3]].mean(0))
        here = [i for i in range(30) if d[i] <= 0.8]
        assert np.allclose(inside, y[here].mean(0)) if here else np.isnan(inside).all()
