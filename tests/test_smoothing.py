"""Decomposition, smoothing and theta against plain loops and closed forms."""

import numpy as np
import pandas as pd
import pytest

from foretable.operators import models, smoothing
from foretable.operators.smoothing import dynamic_theta, ets, loess, mstl, mstl_ets_forecast, running_lines, seasonal_means, stl, theta_forecast


def plain_loess(y, window, at, rho):
    n = len(y)
    near = sorted(range(n), key=lambda i: (abs(i - at), i))[: min(window, n)]
    span = max(max(abs(i - at) for i in near) + max(window - n, 0) // 2, 1)
    w = np.array([rho[i] * (1.0 if abs(i - at) <= 0.001 * span else max(0.0, 1 - (abs(i - at) / (0.999 * span)) ** 3) ** 3) for i in near])
    x = np.array([i - at for i in near], float)
    line = np.polynomial.polynomial.polyfit(x, np.array([y[i] for i in near]), 1, w=np.sqrt(w))
    return line[0]


@pytest.mark.parametrize("window", [5, 11, 25])
def test_loess_equals_a_weighted_fit_at_each_point(window):
    rng = np.random.default_rng(window)
    y, rho = rng.normal(size=20), rng.random(20)
    for weights in (None, rho):
        found = loess(y, window, weights, beyond=1)
        want = [plain_loess(y, window, at, np.ones(20) if weights is None else rho) for at in range(-1, 21)]
        assert found == pytest.approx(want, abs=1e-9)
    both = loess(np.stack([y, 2 * y]), window)
    assert both[0] == pytest.approx(loess(y, window)) and both[1] == pytest.approx(2 * both[0])


def test_loess_keeps_lines_and_passes_over_lost_windows(monkeypatch):
    line = 3.0 + 0.5 * np.arange(40)
    assert loess(line, 7, beyond=1) == pytest.approx(3 + 0.5 * np.arange(-1, 41))
    assert np.isfinite(loess(line, 7, np.zeros(40))).all()
    whole = loess(np.sin(line), 9)
    monkeypatch.setattr(smoothing, "CHUNK", 6)
    assert loess(np.sin(line), 9) == pytest.approx(whole)


def test_stl_parts_of_a_line_and_a_season():
    t = np.arange(24 * 15 + 7)
    season = 5 * np.sin(2 * np.pi * t / 24)
    seasonal, trend = stl(20 + 0.05 * t + season, 24, 11)
    assert seasonal == pytest.approx(season, abs=0.05) and trend == pytest.approx(20 + 0.05 * t, abs=0.05)


def test_robust_weights_hold_off_outliers():
    t = np.arange(24 * 12)
    y = 20 + 5 * np.sin(2 * np.pi * t / 24)
    y[[100, 200]] += 80
    off = [np.abs(np.delete(stl(y, 24, 11, robust)[0] - 5 * np.sin(2 * np.pi * t / 24), [100, 200])).max() for robust in (0, 5)]
    assert off[1] < 0.2 < 1 < off[0]


def test_several_seasons():
    t = np.arange(24 * 7 * 5 + 30)
    day, week = 3 * np.sin(2 * np.pi * t / 24), np.where(t % 168 >= 120, 4.0, 0.0)
    y = 50 + 0.01 * t + day + week
    rest, parts = mstl(y, (24, 168))
    assert set(parts) == {24, 168} and rest + parts[24] + parts[168] == pytest.approx(y)
    assert np.abs(rest - rest.mean() - 0.01 * (t - t.mean())).max() < 1
    ahead = np.arange(len(t), len(t) + 168)
    want = 50 + 0.01 * ahead + 3 * np.sin(2 * np.pi * ahead / 24) + np.where(ahead % 168 >= 120, 4.0, 0.0)
    assert np.abs(mstl_ets_forecast(y, 168, 168) - want).mean() < 0.5
    assert mstl(np.ones(30), (24, 168))[1] == {} and len(mstl_ets_forecast(np.ones(30), 168, 5)) == 5


def test_ets_finds_the_form():
    rng = np.random.default_rng(1)
    assert ets(np.full(40, 7.0), 3) == pytest.approx([7, 7, 7]) and ets(np.arange(60.0), 2) == pytest.approx([60, 61], abs=0.2)
    assert ets(np.array([2.0, 4.0]), 2) == pytest.approx([3, 3]) and ets(np.array([]), 1) == pytest.approx([0])
    noise = 10 + rng.normal(size=300)
    assert ets(noise, 5) == pytest.approx([noise.mean()] * 5, abs=0.4)
    trend = 5 + 0.4 * np.arange(200) + rng.normal(size=200)
    assert ets(trend, 10) == pytest.approx(5 + 0.4 * np.arange(200, 210), abs=1.5)


def test_ets_comes_near_the_greatest_likelihood():
    rng = np.random.default_rng(2)
    level, y = 10.0, []
    for e in rng.normal(size=150):
        y.append(level + e)
        level += 0.4 * e
    y = np.array(y)

    def squares(alpha, first):
        s, total = first, 0.0
        for v in y:
            total, s = total + (v - s) ** 2, s + alpha * (v - s)
        return total, s

    _, last = min(squares(a, f) for a in np.linspace(0.01, 0.99, 60) for f in np.linspace(7, 13, 31))
    assert ets(y, 1)[0] == pytest.approx(last, abs=0.3)


def test_running_lines_equal_fits():
    y = np.random.default_rng(3).normal(size=12)
    base, slope = running_lines(y)
    for t in range(2, 13):
        assert (slope[t - 1], base[t - 1]) == pytest.approx(tuple(np.polyfit(np.arange(1, t + 1), y[:t], 1)))
    assert (base[0], slope[0]) == (y[0], 0)


def test_theta_errors_are_the_least_of_a_dense_search():
    rng = np.random.default_rng(4)
    y = 20 + 0.3 * np.arange(40) + rng.normal(size=40)
    base, slope = running_lines(y)

    def run(alpha, part, first):
        level, total = first, 0.0
        for i, v in enumerate(y):
            drift = 0.0 if i == 0 else (1 - alpha) ** i * base[i - 1] + (1 - (1 - alpha) ** (i + 1)) / alpha * slope[i - 1]
            total, level = total + (v - level - part * drift) ** 2, alpha * v + (1 - alpha) * level
        n = len(y)
        return total, level + part * ((1 - alpha) ** n * base[-1] + (1 - (1 - alpha) ** (n + 1)) / alpha * slope[-1])

    _, want = min(run(a, p, f) for a in np.linspace(0.02, 0.98, 25) for p in np.linspace(0, 1, 21) for f in np.linspace(10, 30, 21))
    assert dynamic_theta(y, 1)[0] == pytest.approx(want, abs=0.3)
    assert dynamic_theta(np.array([1.0, 3.0]), 2) == pytest.approx([3, 3]) and dynamic_theta(np.full(9, 4.0), 3) == pytest.approx([4, 4, 4])


def test_theta_with_a_season():
    y = 10 + np.tile([0.0, 5.0, -5.0], 20)
    assert theta_forecast(y, 3, 3) == pytest.approx([10, 15, 5], abs=0.2)
    assert (seasonal_means(np.random.default_rng(7).normal(size=90), 7) == 0).all()  # no season: none is taken out
    assert (theta_forecast(np.zeros(50), 7, 4) == 0).all()


def test_context_curve_cuts_each_series(spark):
    at = pd.Timestamp("2024-03-01")
    rows = [(s, at.to_pydatetime(), (at - pd.Timedelta(hours=n - i)).to_pydatetime(), float(i)) for s, n in (("long", 10), ("short", 3)) for i in range(n)]
    grid = spark.createDataFrame(rows, "series_id string, origin timestamp_ntz, ts timestamp_ntz, y double")
    made = models.context_curve(grid, 2, 2, (2, 5, None), lambda y, season, horizon: np.full(horizon, y.sum()))
    found = {(r.series_id, r.context): r.y_hat for r in made.collect()}
    assert found == {("long", 2): 17, ("long", 5): 35, ("long", None): 45, ("short", 2): 3, ("short", None): 3} and made.count() == 10
    assert models.context_curve(grid.limit(0), 2, 2, (2, None)).count() == 0 and models.context_curve(grid, 2, 2, (99,)).count() == 0
