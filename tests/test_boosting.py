"""Boosted trees against a plain version that splits one leaf at a time, and the queries that fit them."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretable.operators import boosting as bt
from foretable.operators import experiments
from foretable.plans import catalogue, fixtures

NAN = float("nan")


def plain_tree(x, w, n, q, categorical, usable, p):
    """Splits one leaf at a time, each split found by trying every cut of every feature. Gives the rows of each leaf."""

    def best(rows):
        g = bt.gradients(w[rows], np.ones(len(rows)), q)
        base, found = g.sum() ** 2 / max(len(rows), 1), (1e-12, None)
        for nulls_low in (False, True):
            for f in np.flatnonzero(usable):
                values = x[rows, f]
                there = [v for v in np.unique(values) if v < n - 1]
                if categorical[f]:
                    there.sort(key=lambda v: (g[values == v].mean(), v))
                for i in range(len(there)):
                    low = np.isin(values, there[: i + 1]) | (nulls_low & (values == n - 1))
                    if min(low.sum(), (~low).sum()) >= p.least:
                        gain = g[low].sum() ** 2 / low.sum() + g[~low].sum() ** 2 / (~low).sum() - base
                        if gain > found[0] + 1e-9:
                            found = (gain, low)
        return found

    leaves = [(np.arange(len(x)), best(np.arange(len(x))))]
    while len(leaves) < p.leaves:
        i = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
        rows, (_, low) = leaves[i]
        if low is None:
            break
        leaves[i : i + 1] = [(part, best(part)) for part in (rows[low], rows[~low])]
    return sorted(sorted(map(int, rows)) for rows, _ in leaves)


@pytest.mark.parametrize("q", [0.5, 0.9, None])
def test_a_tree_equals_one_that_splits_leaf_by_leaf(q):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 12, 300), rng.integers(0, 8, 300), rng.integers(0, 5, 300)], 1).astype(np.uint8)
    x[rng.random(300) < 0.2, 0] = 15  # nulls
    y = np.where(x[:, 0] == 15, 4.0, x[:, 0] * 0.3) + np.array([2.0, -1.0, 0.5, 2.5, -2.0])[x[:, 2]] + rng.normal(size=300)
    p, categorical = bt.Growth(rounds=1, leaves=9, least=7, rows=1.0, columns=1.0), np.array([False, False, True])
    first, tree = bt.boosted(x, y, np.arange(300), q, categorical, 16, p)
    assert first.value[0] == pytest.approx(y.mean() if q is None else np.quantile(y, q, method="inverted_cdf"))
    leaf = tree.leaves(x)
    ours = sorted(np.flatnonzero(leaf == i).tolist() for i in np.unique(leaf))
    assert ours == plain_tree(x, bt.weights(y, np.full(300, first.value[0]), q), 16, q, categorical, np.ones(3, bool), p)
    for i in np.unique(leaf):
        rest = (y - first.value[0])[leaf == i]
        assert tree.value[i] == pytest.approx(p.step * (rest.mean() if q is None else np.quantile(rest, q, method="inverted_cdf")))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(6)
    n = 900
    a, c, cat = rng.normal(size=n), rng.normal(size=n), rng.choice(list("pqrs"), n)
    y = np.where(a > 0.3, 5.0, 0.0) + 2 * c + np.where(np.isin(cat, ["p", "s"]), 3.0, 0.0) + rng.normal(size=n)
    rows = [(m, q, float(y[i]), None if i % 7 == 0 else NAN if i % 11 == 0 else float(a[i]), float(c[i]), None if i % 13 == 0 else str(cat[i]), "x") for m, q in (("mean", None), ("q50", 0.5), ("q90", 0.9)) for i in range(n)]
    return spark.createDataFrame(rows, "model string, q double, y double, a double, c double, cat string, bins string")


def test_dealt_out_growth_gives_the_same_trees(sample):
    p = bt.Growth(rounds=bt.STORED_EVERY + 2, leaves=6)
    one, two = ({(r.model, r["round"]): r for r in bt.fit(sample, ("a", "c"), ("cat",), g).trees.collect()} for g in (p, replace(p, local_rows=100)))
    assert one.keys() == two.keys() and len(one) == 3 * (p.rounds + 1)
    for k, r in one.items():
        assert (r.feature, r.low, r.high, r.goes) == (two[k].feature, two[k].low, two[k].high, two[k].goes)
        assert r.value == pytest.approx(two[k].value)


def test_more_rounds_fit_quantiles_better_and_in_order(sample):
    def loss(rounds):
        out = bt.fit(sample, ("a", "c"), ("cat",), bt.Growth(rounds=rounds)).predict(sample, None).toPandas()
        e = out.y - out.y_hat
        q = out.q.fillna(0.5)
        return np.maximum(q * e, (q - 1) * e).mean(), (e[out.q == 0.9] <= 0).mean()

    (few, _), (many, covered) = loss(5), loss(100)
    assert many < 0.6 * few and covered == pytest.approx(0.9, abs=0.05)


def test_odd_frames(spark, sample):
    p = bt.Growth(rounds=2)
    forest = bt.fit(sample, ("a", "c"), ("cat",), p)
    odd = spark.createDataFrame([("mean", None, None, None, None, None, "b"), ("q50", None, 1.0, NAN, float("inf"), "new", "b"), ("unknown", None, 1.0, 1.0, 1.0, "p", "b"), (None, None, 1.0, 1.0, 1.0, "p", "b")], sample.schema)
    out = forest.predict(odd).collect()
    assert [r.model for r in out] == ["mean", "q50"] and all(r.y_hat >= 0 and r.bins == "b" for r in out)
    assert bt.fit(sample.limit(0), ("a", "c"), ("cat",), p).predict(odd).collect() == []
    none = bt.fit(sample.withColumns({"a": F.lit(None), "c": F.lit(1.0), "cat": F.lit(None)}), ("a", "c"), ("cat",), p)
    assert {len(r.feature) for r in none.trees.collect()} == {1}  # nothing to split on
    assert sum(r.share for r in forest.importance().collect()) == pytest.approx(1)


@pytest.fixture
def short(monkeypatch, sf_dir):
    """Two last origins of the daily panel's last years and few rounds; tables of a size that has all cells."""
    pair = fixtures.daily_pair

    def last(spark, d):
        panel, grid = pair(spark, d)
        return panel.where("date >= '2000-03-01'"), experiments.last_origins(grid, 2)

    monkeypatch.setattr(fixtures, "daily_pair", last)
    monkeypatch.setattr(catalogue, "TREES", bt.Growth(rounds=3, leaves=4, least=5))
    return sf_dir.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name", ["gbt_squared", "gbt_grain", "gbt_covariates", "gbt_curve"])
def test_daily_models_forecast_every_origin_and_cell(name, spark, short):
    rows = catalogue.queries()[name](spark, short).toPandas()
    _, grid = fixtures.daily_pair(spark, short)
    cell = next((c for c in ("condition", "cell") if c in rows), None)
    cells = {"gbt_squared": 1, "gbt_grain": 3, "gbt_covariates": 6, "gbt_curve": 10}[name]
    assert (rows[cell].nunique() if cell else 1) == cells
    assert set(rows.origin) == {t.date() for t in grid.times()}
    assert len(rows.groupby([c for c in (cell, "origin") if c])) == cells * grid.count
    assert not rows.duplicated([c for c in (cell, "series_id", "origin", "date") if c]).any() and (rows.y_hat >= 0).all()


@pytest.mark.parametrize("name", ["gbt_l1", "gbt_quantile", "gbt_coldstart"])
def test_hourly_models_forecast_every_origin_and_cell(name, spark, short):
    rows = catalogue.queries()[name](spark, short).toPandas()
    _, grid = fixtures.hourly_pair(spark, short)
    assert set(rows.origin) == set(grid.times())
    if name == "gbt_quantile":
        assert (rows.p10 <= rows.p50).all() and (rows.p50 <= rows.p90).all()
    if name == "gbt_coldstart":
        assert {c.split("_", 1)[1] for c in rows.cell} == {"local_series", "local_park", "global_all"}
        assert len({(c, o) for c, o in zip(rows.cell, rows.origin, strict=True)}) == rows.cell.nunique() * grid.count


def test_importance_and_production_run(spark, short):
    shares = catalogue.queries()["feature_importance"](spark, short).toPandas()
    assert shares.share.sum() == pytest.approx(1, abs=1e-4) and shares.share.max() > 0.1
    made = catalogue.queries()["production_trees"](spark, short).toPandas()
    layers = catalogue.queries()["production_layers"](spark, short).toPandas()
    assert len(made) and set(made.k) <= set(layers.k) and made.l1.between(5, 300).all() and made.y_hat.between(5, 300).all()


def test_calibration_cells_have_a_pool_from_the_first_origin_on(spark, short):
    rows = catalogue.queries()["calibration_cells"](spark, short).toPandas()
    _, grid = fixtures.hourly_pair(spark, short)
    assert set(rows.base) == {"cal", "rec"} and set(rows.origin) == set(grid.times())
    first = rows[rows.origin == grid.times()[0]]
    assert (first.l2 != first.none).mean() > 0.9 and ((rows.l2 >= 0.3 * rows.none - 1e-6) & (rows.l2 <= 3 * rows.none + 1e-6)).all()
    pool = catalogue._pool(spark, short)[2]
    assert set(pool.select("at").distinct().toPandas()["at"]) == set(grid.times())
