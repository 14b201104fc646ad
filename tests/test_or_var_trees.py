"""or_var_trees hands the whole panel to OR-VAR, with the default forests."""

from foldcast.operators import rolling
from foldcast.plans import queries

DIR = "/root/testdata/sf0.001"


def test_every_row_and_the_default_forests(spark, monkeypatch):
    seen = {}

    def or_var(y, c, spec, p_max, model_y, model_t, y_params=None, t_params=None):
        seen.update(y=y, c=c, spec=spec, p_max=p_max, models=(model_y, model_t), params=(y_params, t_params))
        return spark.createDataFrame([], "origin int, target_t int, p_opt int, valid_err double, y_hat array<double>")

    monkeypatch.setattr(rolling, "or_var", or_var)
    assert queries.or_var_trees(spark, DIR).count() == 0
    y, c = queries.aligned(spark, DIR)
    assert sorted(map(tuple, seen["y"].collect())) == sorted(map(tuple, y.collect()))
    assert sorted(map(tuple, seen["c"].collect())) == sorted(map(tuple, c.collect()))
    assert (seen["p_max"], seen["spec"]) == (queries.P_MAX, queries.SPEC)
    assert (seen["models"], seen["params"]) == (("extra_trees", "random_forest"), (None, None))
