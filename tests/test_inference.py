"""Tests and intervals against plain loops."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretable.operators import inference

SCHEMA = "g string, day date, d double"


def frame(spark, groups):
    rows = [(g, dt.date(2024, 1, 1) + dt.timedelta(days=7 * i), float(v)) for g, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows[::-1], SCHEMA)


def test_student_tail(spark):
    # values of printed tables, tails far out, and one degree of freedom, where the tail is an angle
    cases = [(2.228139, 10, 0.05), (-2.228139, 10, 0.05), (0.0, 5, 1.0), (12.706205, 1, 0.05), (1.0, 1, 0.5), (1.983972, 100, 0.05), (3.390492, 100, 0.001), (1.962339, 1000, 0.05), (0.01, 1000, 0.992023)]
    rows = spark.createDataFrame([(t, df) for t, df, _ in cases], "t double, df long").select("t", "df", inference.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    found = {(r.t, r.df): r.p for r in rows}
    assert [found[t, df] for t, df, _ in cases] == [pytest.approx(p, rel=2e-5) for _, _, p in cases]
    far = spark.createDataFrame([(40.0, 4)], "t double, df long").select(inference.t_two_sided(F.col("t"), F.col("df"))).first()[0]
    x = 4 / (4 + 1600)  # two times two degrees: the beta function is a polynomial in the root of 1 - x
    assert far == pytest.approx(1 - math.sqrt(1 - x) * (1 + x / 2), rel=1e-7)


def plain_dm(d, lag):
    t = len(d)
    if t < 5:
        return None
    lag, e = min(lag, t - 2), d - d.mean()
    v = sum(x * x for x in e) / t
    for k in range(1, lag + 1):
        v += 2 * (1 - k / (lag + 1)) * sum(e[i] * e[i - k] for i in range(k, t)) / t
    if v <= 0:
        return None
    h = lag + 1
    return d.mean() / math.sqrt(v / t) * math.sqrt((t + 1 - 2 * h + h * (h - 1) / t) / t)


@pytest.mark.parametrize("lag", [0, 1, 4])
def test_dm(lag, spark):
    rng = np.random.default_rng(lag)
    groups = {"short": np.ones(4), "flat": np.full(10, 0.5), "five": rng.normal(0.3, 1, 5), "long": rng.normal(0.2, 1, 60)}
    rows = {r.g: r for r in inference.dm_test(frame(spark, groups), ["g"], lag).collect()}
    for g, d in groups.items():
        want = plain_dm(d, lag)
        assert rows[g].days == len(d) and rows[g].mean_diff == pytest.approx(d.mean())
        assert (rows[g].stat, rows[g].p) == (None, None) if want is None else rows[g].stat == pytest.approx(want) and 0 < rows[g].p < 1


def plain_draws(d, key, block, draws, seed=0):
    t, means = len(d), []
    size = min(block, t)
    for draw in range(draws):
        picked = []
        for q in range(-(-t // size)):
            start = int(hashlib.md5("|".join(map(str, (seed, *key, block, draw, q))).encode()).hexdigest()[:15], 16) % (t - size + 1)
            picked.extend(d[start : start + size])
        means.append(np.mean(picked[:t]))
    return np.array(means)


def test_bootstrap_of_days_and_blocks(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0.3, 1, 11), "b": rng.normal(0, 1, 2), "one": np.array([2.0])}
    rows = inference.block_bootstrap(frame(spark, groups), ["g"], (1, 2, 4), draws=300).collect()
    assert {(r.g, r.block) for r in rows} == {(g, b) for g in groups for b in (1, 2, 4)} and len(rows) == 9
    for r in rows:
        means = plain_draws(groups[r.g], [r.g], r.block, 300)
        assert (r.low, r.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
        assert r.p_sign == pytest.approx(min(1.0, 2 * min((means <= 0).mean(), (means >= 0).mean())))
        assert r.days == len(groups[r.g])


def test_draws_do_not_depend_on_partitions_or_other_groups(spark):
    groups = {"a": np.arange(30) % 3, "b": np.arange(7)}
    both, alone = frame(spark, groups), frame(spark, {"a": groups["a"]})
    first = inference.bootstrap_ci(both.repartition(7), ["g"], draws=500).where("g = 'a'").first()
    assert first == inference.bootstrap_ci(alone.coalesce(1), ["g"], draws=500).first()
    assert first.low < first.mean_diff < first.high
    assert first != inference.bootstrap_ci(alone, ["g"], draws=500, seed=1).first()
    blocks = inference.bootstrap_ci(alone, ["g"], block=3, draws=500).first()
    assert blocks.high - blocks.low < first.high - first.low  # blocks of one whole cycle differ less


def test_no_rows_and_null_keys(spark):
    none = frame(spark, {})
    assert inference.dm_test(none, ["g"]).count() == 0 and inference.bootstrap_ci(none, ["g"], draws=10).count() == 0
    row = inference.bootstrap_ci(frame(spark, {None: np.array([1.0, 1.0])}), ["g"], draws=10).first()
    assert (row.g, row.low, row.high) == (None, 1.0, 1.0)
