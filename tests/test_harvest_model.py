"""Linear models from sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators.leastsquares import Moments, collected, moments
from fieldspark.plans import forecast, harvest_model
from fieldspark.sources.fixture import AS_OF, PLANTED_SINCE

NAMES = ["a", "b", "c", "d", "y"]


def frame(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal([5, -2000, 0.1, 7], [1, 300, 0.01, 0], (n, 4))
    y = 3 + 2 * x[:, 0] - 0.01 * x[:, 1] + 40 * x[:, 2] + rng.normal(0, 0.1, n)
    rows = [[None if rng.random() < 0.1 else float(v) for v in r] for r in x]
    rows[4][1] = float("nan")
    rows = [(*r, float(v), int(k % 4)) for k, (r, v) in enumerate(zip(rows, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, g int").repartition(5), rows


def direct(rows, ridge):
    """Means filled in, standardised inputs, the normal equations."""
    x = np.array([[np.nan if v is None else v for v in r[:4]] for r in rows])
    y = np.array([r[4] for r in rows])
    means = np.nanmean(x, axis=0)
    x = np.where(np.isnan(x), means, x) - means
    unit = np.sqrt((x**2).sum(0))
    use = unit > 1e-6
    z = x[:, use] / unit[use]
    w = np.zeros(4)
    gram = z.T @ z
    gram[np.diag_indices(len(gram))] = 1 + ridge
    w[use] = np.linalg.solve(gram, z.T @ (y - y.mean())) / unit[use]
    return y.mean(), w, means


@pytest.mark.parametrize("ridge", [0.0, 0.01])
def test_fit_equals_the_normal_equations_over_all_rows(spark, ridge):
    df, rows = frame(spark)
    (sums,) = collected(moments(df, NAMES, []), []).values()
    fit = sums.fit(NAMES, NAMES[:4], "y", ridge)
    base, weights, means = direct(rows, ridge)
    assert fit.rows == 400 and fit.base == pytest.approx(base) and fit.weights["d"] == 0.0
    assert [fit.weights[c] for c in "abc"] == pytest.approx(weights[:3].tolist(), rel=1e-7)
    assert [fit.means[c] for c in "abcd"] == pytest.approx(means.tolist())
    got = df.select("a", "b", "c", "d", fit.prediction().alias("p")).collect()
    for r in got:
        x = [m if v is None or np.isnan(v) else v for v, m in zip(r[:4], means)]
        assert r.p == pytest.approx(base + weights @ (np.array(x) - means), rel=1e-9)


def test_a_group_left_out_is_a_difference_of_sums(spark):
    df, rows = frame(spark)
    by = collected(moments(df, NAMES, ["g"]), ["g"])
    total = Moments()
    for of in by.values():
        total = total.plus(of)
    for k in range(4):
        fit = total.plus(by[(k,)], -1).fit(NAMES, NAMES[:4], "y", 0.01)
        base, weights, _ = direct([r for r in rows if r[5] != k], 0.01)
        assert fit.base == pytest.approx(base)
        assert [fit.weights[c] for c in "abc"] == pytest.approx(weights[:3].tolist(), rel=1e-6)


def test_no_rows_no_model(spark):
    df, _ = frame(spark)
    assert collected(moments(df.where("false"), NAMES, ["g"]), ["g"]) == {}
    assert Moments().fit(NAMES, NAMES[:4], "y", 0.01) is None
    empty = df.select(*[F.lit(None).cast("double").alias(c) for c in "abcd"], "y")
    fit = collected(moments(empty, NAMES, []), [])[()].fit(NAMES, NAMES[:4], "y", 0.01)
    assert set(fit.weights.values()) == {0.0}


def test_sums_are_added_before_they_are_moved(spark, final_plan):
    df, _ = frame(spark)
    plan = final_plan(moments(df, NAMES, ["g"]))
    assert "partial_sum" in plan and plan.count("hashpartitioning") == 1


def test_forecast_takes_stored_fits_and_leaves_unknown_crops_blank(tables):
    fits = harvest_model.fit_linear(tables)
    assert set(fits) == {"PC", "SC"} and set(fits["PC"].weights) == set(forecast.FIRST_CROP_INPUTS)
    rows = harvest_model.harvest_forecast_linear(tables, AS_OF, PLANTED_SINCE, fits={"PC": fits["PC"]}).collect()
    assert rows and all((r.prediccion is None) == (r.desarrollo == "SC") for r in rows)


def test_folds_are_predicted_by_the_others(tables):
    """A model that knew the fold would explain it better than one that does not."""
    errors = {r.desarrollo: r for r in harvest_model.harvest_fold_errors(tables).collect()}
    assert all(r.explicado > 0.5 for r in errors.values())
    single = harvest_model.harvest_folds(tables, folds=1)
    assert single.where("prediccion is not null").isEmpty() and single.count() > 0
