"""The as-of join and scores on shared targets against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from foretable.operators import fidelity

STORED = "s string, ts int, made int, v double, w double"
ASKS = "s string, ts int, moment int, y double"


def test_as_of_takes_the_newest_until_the_moment(spark):
    rng = random.Random(1)
    stored = [(rng.choice("ab"), rng.randrange(4), rng.randrange(20), rng.random(), None) for _ in range(120)]
    stored += [("a", 1, 7, 0.5, 1.0), ("a", 1, 7, 0.9, 2.0), (None, 1, 3, 0.1, 0.2), ("a", 2, None, 9.0, 9.0)]  # made at one time, a null key, never made
    asks = [(rng.choice("abc"), rng.randrange(5), rng.randrange(-2, 25), float(i)) for i in range(60)]
    asks += [asks[0], (None, 1, 4, -1.0), ("a", 1, 7, -2.0), ("a", 1, None, -3.0)]
    out = fidelity.as_of(spark.createDataFrame(asks, ASKS), spark.createDataFrame(stored, STORED).repartition(5), ["s", "ts"], "moment", "made", ["v", "w"])
    want = []
    for s, ts, moment, y in asks:
        past = [r for r in stored if r[:2] == (s, ts) and r[2] is not None and moment is not None and r[2] <= moment]
        newest = max(past, key=lambda r: (r[2], r[3])) if past else (None,) * 5
        want.append((s, ts, moment, y, *newest[2:]))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_as_of_of_empty_sides(spark):
    stored, asks = spark.createDataFrame([("a", 1, 1, 1.0, 1.0)], STORED), spark.createDataFrame([("a", 1, 5, 0.0)], ASKS)
    assert fidelity.as_of(asks.limit(0), stored, ["s", "ts"], "moment", "made", ["v"]).count() == 0
    assert fidelity.as_of(asks, stored.limit(0), ["s", "ts"], "moment", "made", ["v"]).first().v is None
    odd = asks.withColumn("a.b", F.lit(1)).withColumn("made_by", F.lit("x"))
    row = fidelity.as_of(odd, stored, ["s", "ts"], "moment", "made", ["v"]).first()
    assert (row["a.b"], row.made_by, row.made, row.v) == (1, "x", 1, 1.0)


def test_scores_on_targets_that_all_methods_have(spark):
    rows = [("g", 10.0, 12.0, 30.0), ("g", 10.0, 4.0, 10.0), ("g", 10.0, None, 10.0), ("g", None, 1.0, 1.0), ("h", 1.0, None, 2.0)]
    wide = spark.createDataFrame(rows, "g string, y double, a double, b double")
    found = {(r.g, r.method): r for r in fidelity.same_targets(wide, ["a", "b"], ["g"]).collect()}
    assert found.keys() == {("g", "a"), ("g", "b")}
    a, b = found["g", "a"], found["g", "b"]
    assert (a.n, a.mae, a.w5, a.w10, a.bias) == (2, 4.0, 0.5, 1.0, -2.0) and a.rmse == pytest.approx(20**0.5)
    assert (b.n, b.mae, b.w5, b.bias) == (2, 10.0, 0.5, 10.0)
    pair = fidelity.same_target_agreement(wide.where("g = 'g'"), "a", "b", ["g"]).first()
    assert (pair.n, pair.mean_abs_diff) == (3, pytest.approx(8.0)) and pair.mean_b == pytest.approx(41 / 3)
