"""Queries of per-series methods against the same methods on series that DuckDB and pandas deal out."""

import numpy as np
import pandas as pd
import pytest

from foretable.operators import smoothing
from foretable.plans import catalogue, sql
from foretable.plans.fixtures import HOURLY


@pytest.fixture(scope="module")
def series():
    """(series_id, origin) to the hours that observed targets lie at, and the hourly values before, 0 where none was observed."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    rows = con.execute(f"{sql.H} SELECT series_id, origin, ts, y FROM h CROSS JOIN o").df()
    out = {}
    for (name, origin), own in rows.groupby(["series_id", "origin"]):
        past, own = own[own.ts < origin], own.set_index("ts").sort_index()
        goals = own.index[(own.index >= origin) & (own.index < origin + pd.Timedelta(hours=HOURLY.horizon))]
        if len(past) and len(goals):
            every = pd.date_range(past.ts.min(), origin - pd.Timedelta(hours=1), freq="h")
            if len(every) >= 336:
                out[name, origin] = goals, own["y"].reindex(every, fill_value=0.0).to_numpy(), own["y"]
    assert len(out) > 10
    return out


@pytest.mark.parametrize("name, method", [("regular_grid_theta", smoothing.theta_forecast), ("regular_grid_mstl", smoothing.mstl_ets_forecast)])
def test_forecasts(name, method, spark, series):
    found = {(r.series_id, pd.Timestamp(r.origin), pd.Timestamp(r.ts)): r.y_hat for r in catalogue.queries()[name](spark, "/root/testdata/sf0.01").collect()}
    want = {}
    for (s, origin), (goals, y, _) in series.items():
        ahead = method(y, HOURLY.season, HOURLY.horizon)
        want |= {(s, origin, t): ahead[int((t - origin) / pd.Timedelta(hours=1))] for t in goals}
    assert found.keys() == want.keys()
    keys = list(found)
    assert np.array([found[k] for k in keys]) == pytest.approx(np.array([want[k] for k in keys]), abs=1e-5)


def test_context_curve(spark, series):
    found = {(r.context, r.bucket): r for r in catalogue.queries()["theta_context_curve"](spark, "/root/testdata/sf0.01").collect()}
    scaled = set(catalogue.queries()["mase_scales"](spark, "/root/testdata/sf0.01").toPandas()["series_id"])
    errors = {}
    for (s, origin), (goals, y, known) in series.items():
        for context in catalogue.CONTEXTS:
            if s in scaled and (context is None or context <= len(y)):
                ahead = smoothing.theta_forecast(y if context is None else y[-context:], HOURLY.season, HOURLY.horizon)
                for t in goals:
                    lead = int((t - origin) / pd.Timedelta(hours=1)) + 1
                    bucket = next(b for b, (low, high) in HOURLY.buckets.items() if low <= lead <= high)
                    errors.setdefault((context, bucket), []).append(abs(known[t] - ahead[lead - 1]))
    assert found.keys() == errors.keys()
    for k, e in errors.items():
        assert found[k].n == len(e) and found[k].mae == pytest.approx(np.mean(e), abs=1e-5)
