"""Frames made by hand: ties, nulls, boundaries."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretable.functions import measures, temporal
from foretable.operators import baselines, boosting, calibrate, experiments, features, inference, models, origins, score
from foretable.plans import catalogue, fixtures
from foretable.protocol import Daily, Grid, Hourly
from foretable.sources import files, panels
from foretable.streaming.hourly import streaming_hourly_panel

DAY0 = dt.datetime(2024, 1, 1)


def hours(spark, rows):
    data = [(s, "P", "A", DAY0 + dt.timedelta(hours=h), y) for s, h, y in rows]
    return spark.createDataFrame(data, "series_id string, park string, regime string, ts timestamp_ntz, y double")


def days(spark, rows):
    data = [(s, "P", "E", "A", (DAY0 + dt.timedelta(days=d)).date(), y, e) for s, d, y, e in rows]
    return spark.createDataFrame(data, "series_id string, park string, resort string, regime string, date date, y double, source string")


def test_bucket_edges(spark):
    leads = spark.createDataFrame([(x,) for x in (0, 1, 2, 24, 25, 72, 73, 168, 169)], "lead int")
    got = [r[0] for r in leads.select(temporal.bucket(F.col("lead"), Hourly().buckets)).collect()]
    assert got == [None, "1h", "same_day", "same_day", "2-3d", "2-3d", "4-7d", "4-7d", None]
    leads = spark.createDataFrame([(x,) for x in (1, 7, 8, 112, 113)], "lead int")
    assert [r[0] for r in leads.select(temporal.bucket(F.col("lead"), Daily().buckets)).collect()] == ["1-7d", "1-7d", "8-14d", "57-112d", None]


def test_size_bins_are_closed_on_the_right(spark):
    x = spark.createDataFrame([(v,) for v in (0.0, 0.1, 10.0, 10.01, 50.0, 51.0, None)], "x double")
    assert [r[0] for r in x.select(measures.size_bin(F.col("x"))).collect()] == [None, "0-10", "0-10", "10-20", "30-50", ">50", None]


def test_clamp_keeps_null(spark):
    x = spark.createDataFrame([(v,) for v in (0.1, 0.3, 1.0, 3.0, 9.0, None)], "x double")
    assert [r[0] for r in x.select(measures.clamp(F.col("x"), 0.3, 3)).collect()] == [0.3, 0.3, 1.0, 3.0, 3.0, None]


def test_crossed_quantiles_are_ordered_and_not_negative(spark):
    x = spark.createDataFrame([(5.0, 3.0, -1.0)], "a double, b double, c double")
    assert x.select(*measures.in_order([F.col("a"), F.col("b"), F.col("c")])).first()[:] == (0.0, 3.0, 5.0)


def test_hours_do_not_depend_on_the_session_time_zone(spark):
    gap = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 15, 250),)], "ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        floor, lead = gap.select(temporal.hour_floor(F.col("ts")), temporal.lead_hours(temporal.at(dt.datetime(2024, 3, 10)), F.col("ts"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert floor == dt.datetime(2024, 3, 10, 2) and lead == 3


def test_nearest_hour_takes_the_lower_of_two(spark):
    table = spark.createDataFrame([("s", 7, 1.0), ("s", 9, 2.0)], "series_id string, hour int, ratio double")
    got = {r.hour: r.ratio for r in calibrate.every_hour(table, ["series_id"]).collect()}
    assert got[8] == 1.0 and got[7] == 1.0 and got[9] == 2.0 and got[0] == 1.0 and got[23] == 2.0
    made = spark.createDataFrame([("s", 8, 10.0), ("t", 8, 10.0)], "series_id string, hour int, y_hat double")
    assert {r.series_id: r.y_hat for r in calibrate.apply_ratio(made, table.withColumn("ratio", F.col("ratio") * 2), ["series_id"]).collect()} == {"s": 20.0, "t": 10.0}


def test_snaive_falls_back_week_by_week(spark):
    week = 168
    rows = [("a", 0, 1.0), ("a", week, None), ("a", 2 * week, 7.0), ("b", 5, 2.0), ("b", 3 * week + 5, 9.0), ("c", 3 * week + 7, 4.0), ("a", 3 * week, 5.0)]
    grid = Grid(DAY0 + dt.timedelta(weeks=3), 1, (0,))
    got = {r.series_id: r.y_hat for r in baselines.snaive_hourly(hours(spark, rows), grid, Hourly()).collect()}
    assert got == {"a": 7.0, "b": 2.0}


def test_history_counts_only_what_is_before_the_origin(spark):
    grid = Grid(DAY0 + dt.timedelta(days=1), 2, (0, 9))
    panel = hours(spark, [("a", 0, 1.0), ("a", 24, 2.0), ("a", 32, 4.0), ("a", 33, 8.0), ("a", 24 * 9, 16.0)])
    got = {r.k: r.s for r in origins.history(panel, grid, F.col("ts"), ["series_id"], {"s": F.col("y")}).collect()}
    assert got == {0: 1.0, 1: 7.0, 2: 15.0, 3: 15.0}


def test_targets_equal_a_range_join(spark):
    panel = hours(spark, [("a", h, float(h)) for h in range(0, 24 * 40, 5)])
    grid = Grid(DAY0 + dt.timedelta(days=10), 3, (0, 9, 13))
    got = {(r.k, r.ts) for r in origins.targets(panel, grid, 168).collect()}
    want = {(k, r.ts) for r in panel.collect() for k, o in enumerate(grid.times()) if o <= r.ts < o + dt.timedelta(hours=168)}
    assert got == want


def test_scale_needs_enough_pairs_and_some_difference(spark):
    grid = Grid(DAY0 + dt.timedelta(days=20), 1, (0,))
    rows = [("enough", h, float(h % 5)) for h in (*range(24), *range(168, 192))] + [("few", h, float(h)) for h in (*range(23), *range(168, 191))] + [("flat", h, 3.0) for h in (*range(24), *range(168, 192))]
    got = [r.series_id for r in score.hourly_scales(hours(spark, rows), grid, Hourly()).collect()]
    assert got == ["enough"]


def test_centred_mean_needs_seven_days(spark):
    rows = [("a", d, 1.0, "own") for d in range(6)] + [("b", d, 2.0, "own") for d in range(7)]
    got = {(r.series_id, r.centred) for r in features.centred_mean(days(spark, rows)).collect()}
    assert got == {("a", None), ("b", 2.0)}


def test_duplicate_keys_raise(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, v int")
    with pytest.raises(Exception, match="duplicate key"):
        panels.assert_unique(frame, ["k"]).collect()
    assert panels.assert_unique(frame.distinct(), ["k"]).count() == 2


def test_ranks_average_ties(spark):
    losses = spark.createDataFrame([("x", 1.0, 1.0, 2.0)], "block string, a double, b double, c double")
    got = {r.method: r.mean_rank for r in score.mean_ranks(losses, ["a", "b", "c"], ["block"], ["block"]).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_level_ratio_and_splice(spark):
    rows = [("a", d, 10.0, "coarse") for d in range(60)] + [("a", 60 + d, 20.0, "own") for d in range(70)] + [("b", d, 1.0, "coarse") for d in range(60)]
    panel = days(spark, rows)
    grid = origins.daily_grid(panel, Daily())
    ratios = calibrate.level_ratio(panel, grid)
    assert {(r.series_id, r.ratio) for r in ratios.collect()} == {("a", 2.0)}
    spliced = calibrate.splice_calibrated(panel, ratios.where("k = 0"))
    assert {(r.series_id, r.y) for r in spliced.collect()} == {("a", 20.0)}


def test_empty_panels_give_empty_results(spark):
    none = hours(spark, [])
    grid = origins.hourly_grid(none, Hourly())
    assert grid.count == 0
    assert baselines.snaive_hourly(none, grid, Hourly()).count() == 0
    assert features.hourly_samples(none, grid, Hourly()).count() == 0
    assert score.hourly_scales(none, grid, Hourly()).count() == 0


def test_range_quantile():
    assert inference.range_quantile(6) / math.sqrt(2) * math.sqrt(6 * 7 / (6 * 1910)) == pytest.approx(0.17, abs=0.005)


def test_widening_finds_the_least_factor(spark):
    rows = [("g", 10.0 + e, 9.0, 10.0, 11.0) for e in (0.0, 0.5, 1.0, 1.1, 1.2)]
    frame = spark.createDataFrame(rows, "g string, y double, p10 double, p50 double, p90 double")
    assert calibrate.frozen_factor(frame).first().factor == pytest.approx(1.1)
    assert calibrate.frozen_factor(frame.withColumn("y", F.lit(99.0))).first().factor is None


def test_the_calibration_half_decides_for_the_other(spark):
    rows = [(d, y, 9.0, 10.0, 11.0) for d in range(3) for y in ((10.0, 11.1) if d == 0 else (11.0, 11.2))]
    frame = calibrate.halves(spark.createDataFrame(rows, "day int, y double, p10 double, p50 double, p90 double"), "day")
    out = calibrate.holdout_coverage(frame).collect()
    assert {r.day for r in out} == {1, 2} and {round(r.factor, 2) for r in out} == {1.1}
    assert sum(r.raw for r in out) == 2 and sum(r.widened for r in out) == 2


def test_blocks_average_each_method_over_its_own_rows(spark):
    wide = spark.createDataFrame([("x", 1.0, None), ("x", 3.0, 2.0), ("x", 4.0, 5.0), ("y", 1.0, None)], "block string, a double, b double")
    assert [tuple(r) for r in score.block_losses(wide, ["a", "b"], ["block"]).collect()] == [("x", pytest.approx(8 / 3), 3.5)]


def test_third_layer_takes_the_nearest_second_ratio(spark):
    readings = spark.createDataFrame([("s", 8, 2, 40.0), ("s", 12, 1, 30.0), ("s", 13, 1, 9.0), ("t", 8, 1, 12.0)], "series_id string, hour int, cnt long, total double")
    first = spark.createDataFrame([("s", 8, 10.0), ("s", 12, 10.0), ("s", 13, 3.0), ("t", 8, 10.0)], "series_id string, hour int, l1 double")
    second = spark.createDataFrame([("s", 9, 2.0)], "series_id string, hour int, ratio double")
    got = {(r.series_id, r.hour): r.ratio for r in calibrate.recent_layer(readings, first, second, ["series_id"]).collect()}
    assert got == {("s", 8): 1.0, ("s", 12): 1.5, ("t", 8): pytest.approx(1.2)}  # l1 of 3 is too small; t has no ratio, which counts as 1


def test_break_scores_at_their_edges(spark):
    dates = {"2024-03-09": (0.2, 0.1, 0.1), "2024-03-10": (0.9, 0.1, 0.1), "2024-04-15": (0.9, 0.1, 0.1), "2024-04-16": (0.2, 0.1, 0.1), "2024-06-01": (0.2, 0.9, 0.1), "2024-08-15": (0.2, 0.9, 0.1), "2024-08-16": (0.2, 0.1, 0.1), "2024-12-20": (0.2, 0.1, 0.9), "2024-01-05": (0.2, 0.1, 0.9), "2024-01-06": (0.2, 0.1, 0.1)}
    frame = spark.createDataFrame([(dt.date.fromisoformat(x),) for x in dates], "date date")
    got = {str(r[0]): tuple(r)[1:] for r in frame.select("date", *measures.break_scores(F.col("date")).values()).collect()}
    assert got == dates


def test_origins_go_backwards_and_are_cut_at_either_end():
    grid = Grid(DAY0, 3)
    back = experiments.backward_grid(grid, DAY0 - dt.timedelta(days=50))
    assert back.times()[0] == DAY0 - dt.timedelta(days=21) and back.times()[-3:] == grid.times()
    assert experiments.backward_grid(grid, DAY0) == grid
    assert experiments.first_origins(grid, 2).times() == grid.times()[:2] and experiments.last_origins(grid, 2).times() == grid.times()[-2:] and experiments.last_origins(grid, 9) == grid


def test_series_rules(spark):
    frame = spark.createDataFrame([(x,) for x in ("click-1", "click-x-test", "click-2-end", "other-1", "click 3")], "series_id string")
    rules = (panels.SeriesRule("click", "P1", "east", "A"),)
    got = [r.series_id for r in panels.classify(frame, rules, must_contain="-", never=("test",), never_ends=("end",)).collect()]
    assert got == ["click-1"]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("id", "id % 7 AS v").write.jdbc(url, "readings", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    more = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    query = 'SELECT "v", COUNT(*) AS "n" FROM readings WHERE "v" > 4 GROUP BY "v"'
    whole = {(r.v, r.n) for r in files.read_jdbc(spark, url, query, **more).collect()}
    parts = files.read_jdbc(spark, url, query, partition=("v", 5, 7, 2), **more)
    assert whole == {(5, 14), (6, 14)} == {(r.v, r.n) for r in parts.collect()} and parts.rdd.getNumPartitions() == 2


def test_trees(spark):
    rng = np.random.default_rng(0)
    data = [("s", "P", "A", float(x), float(3 * x + rng.normal())) for x in rng.uniform(0, 10, 300)]
    frame = spark.createDataFrame(data, "series_id string, park string, regime string, lead double, y double")
    train = frame.withColumn("q", F.explode(F.array(*map(F.lit, (0.1, 0.5, 0.9))))).withColumn("model", F.col("q").cast("string"))
    out = boosting.fit(train, ("lead",), models.CATEGORIES, boosting.Growth(rounds=40)).predict(train)
    assert out.where("q = 0.5").select(F.avg(F.abs(F.col("y") - F.col("y_hat")))).first()[0] < 3
    below = {r.q: r.part for r in out.groupBy("q").agg(F.avg((F.col("y") < F.col("y_hat")).cast("double")).alias("part")).collect()}
    assert below[0.1] < 0.3 < 0.7 < below[0.9]


def test_stream_gives_the_batch_panel(spark, tmp_path):
    rows = [("click-1", DAY0 + dt.timedelta(minutes=13 * i), float(i)) for i in range(40)] + [("click-1", DAY0 + dt.timedelta(days=2), 0.0)]
    frame = spark.createDataFrame(rows, "sid string, at timestamp_ntz, v double")
    frame.write.parquet(str(tmp_path / "in"))
    rules = (panels.SeriesRule("click", "P1", "east", "A"),)
    batch = panels.hourly_panel(frame, F.col("sid"), F.col("at"), F.col("v"), rules, 3)
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    made = streaming_hourly_panel(stream, F.col("sid"), F.col("at"), F.col("v"), rules, 3)
    run = made.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch.where("y > 0").collect()))


def test_files(spark, tmp_path):
    frame = spark.createDataFrame([("m1", 1.5), ("m2", 2.5)], "method string, y double")
    files.write_forecasts(frame, str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p"), ["y"]).count() == 2
    files.write_csv(frame, str(tmp_path / "c"), compressed=True, order=["y"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("y").collect()] == [("m1", "1.5"), ("m2", "2.5")]
    assert list((tmp_path / "c").glob("*.csv.gz"))


def test_every_real_ratio_stays(spark, monkeypatch):
    have = {h: 1.0 + h / 100 for h in range(24) if h != 11}
    table = spark.createDataFrame([("s", DAY0, h, r) for h, r in have.items()], "series_id string, origin timestamp_ntz, hour int, ratio double")
    monkeypatch.setattr(catalogue, "ratio_table_l2", lambda spark, d: table)
    assert {r.hour: r.ratio for r in catalogue.queries()["every_hour_ratio"](spark, "").collect()} == pytest.approx(have | {11: have[10]})


def test_per_series_methods_see_the_whole_grid(spark):
    rows = spark.range(2100).select(F.lit("a").alias("series_id"), F.lit(DAY0).cast("timestamp_ntz").alias("origin"), temporal.plus_hours(temporal.at(DAY0), -1 - F.col("id").cast("int")).alias("ts"), F.lit(1.0).alias("y"))
    count = lambda y, season, horizon: np.full(horizon, float(len(y)))
    assert [models.per_series(rows, 168, 1, count, **more).first().y_hat for more in ({}, {"context": 2048})] == [2100.0, 2048.0]
