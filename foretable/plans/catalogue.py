"""The queries over the test tables, each with the SQL that gives the same rows. Doubles are rounded to 6 digits in both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretable.functions import measures, temporal
from foretable.operators import baselines, boosting, calibrate, experiments, features, fidelity, inference, models, production, score, smoothing
from foretable.operators import origins as og
from foretable.plans import fixtures as fx
from foretable.plans import sql
from foretable.sources import files, panels

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers f under its name, its doubles rounded."""

    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(spark, sf_dir)
        return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

    _queries[f.__name__] = rounded
    return f


H, D = fx.HOURLY, fx.DAILY


@query
def hourly_panel(spark, d):
    return fx.hourly(spark, d)


@query
def daily_panel(spark, d):
    return fx.daily(spark, d)


@query
def daily_from_hourly(spark, d):
    return panels.daily_from_hourly(fx.hourly(spark, d), D.min_hours)


@query
def series_curation(spark, d):
    return panels.curated(fx.hourly(spark, d), 30).groupBy("series_id").agg(F.count("*").alias("n_hours"))


@query
def rolling_origins(spark, d):
    panel, grid = fx.hourly_pair(spark, d)
    return og.origins(spark, grid)


@query
def daily_origins(spark, d):
    panel, grid = fx.daily_pair(spark, d)
    return og.origins(spark, grid).select("k", temporal.day(F.col("origin")).alias("origin"))


@query
def pseudo_origins(spark, d):
    return og.origins(spark, og.hourly_grid(fx.hourly(spark, d), H, min_train_days=7))


@query
def target_grid(spark, d):
    panel, grid = fx.hourly_pair(spark, d)
    return og.targets(panel, grid, H.horizon).select("series_id", "origin", "ts", temporal.lead_hours(F.col("origin"), F.col("ts")).alias("lead"))


@query
def daily_target_grid(spark, d):
    panel, grid = fx.daily_pair(spark, d)
    return og.daily_targets(panel, grid, D.horizon).select("series_id", "origin", "date", temporal.lead_days(F.col("origin"), F.col("date")).alias("lead"))


@query
def mase_scales(spark, d):
    panel, grid = fx.hourly_pair(spark, d)
    return score.hourly_scales(panel, grid, H).select("series_id", "origin", "scale")


@query
def daily_mase_scales(spark, d):
    panel, grid = fx.daily_pair(spark, d)
    return score.mean_scales(score.daily_scales(panel, grid, D))


@query
def snaive_fc(spark, d):
    panel, grid = fx.hourly_pair(spark, d)
    return baselines.snaive_hourly(panel, grid, H)


@query
def hourly_avg_fc(spark, d):
    panel, grid = fx.hourly_pair(spark, d)
    return baselines.hourly_average(panel, grid, H)


def snaive_scores_of(spark: SparkSession, sf_dir: str, p) -> DataFrame:
    panel, grid = fx.hourly_pair(spark, sf_dir, p)
    scored = score.evaluate_hourly(baselines.snaive_hourly(panel, grid, p), panel, p)
    return score.summarize(scored, score.mean_scales(score.hourly_scales(panel, grid, p)), ["bucket"])


@query
def snaive_scores(spark, d):
    return snaive_scores_of(spark, d, H)


@query
def snaive7_daily(spark, d):
    return baselines.snaive7(*fx.daily_pair(spark, d), D)


@query
def snaive7_ext(spark, d):
    return baselines.snaive7_extended(*fx.daily_pair(spark, d), D)


@query
def dow_mean_8w(spark, d):
    return baselines.dow_mean(*fx.daily_pair(spark, d), D, 8)


@query
def dow_mean_full(spark, d):
    return baselines.dow_mean(*fx.daily_pair(spark, d), D, None)


@query
def snaive364(spark, d):
    return baselines.snaive364(*fx.daily_pair(spark, d), D)


@query
def level_ratio(spark, d):
    return calibrate.level_ratio(*fx.daily_pair(spark, d)).select("series_id", "origin", "ratio")


@query
def window_ratio(spark, d):
    return calibrate.window_ratio(*fx.daily_pair(spark, d), weeks=8).select("series_id", "origin", "ratio")


@query
def snaive364_cal(spark, d):
    panel, grid = fx.daily_pair(spark, d)
    return calibrate.level_calibrated(baselines.snaive364(panel, grid, D), calibrate.level_ratio(panel, grid))


@query
def month_shape(spark, d):
    return baselines.month_shape(*fx.daily_pair(spark, d)).select("series_id", "k", "month", "shape")


@query
def dow_shape_annual(spark, d):
    return baselines.dow_shape_annual(*fx.daily_pair(spark, d), D)


@query
def shape_layer(spark, d):
    panel, grid = fx.daily_pair(spark, d)
    return baselines.shape_layer(baselines.dow_mean(panel, grid, D, 8), panel, grid)


@query
def seasonal_lags(spark, d):
    return features.seasonal_lags(*fx.hourly_pair(spark, d), H).select("series_id", "origin", "ts", *(f"lag{h}" for h in features.LAGS), "sdhr4")


@query
def recency_features(spark, d):
    return features.recency(*fx.hourly_pair(spark, d))


@query
def annual_lookup(spark, d):
    return features.annual_lookup(fx.daily(spark, d))


@query
def hourly_samples(spark, d):
    return features.hourly_samples(*fx.hourly_pair(spark, d), H)


@query
def daily_samples(spark, d):
    return features.daily_samples(*fx.daily_pair(spark, d), D)


@query
def regular_grid(spark, d):
    return features.regular_grid(*fx.hourly_pair(spark, d))


@query
def truncated_context(spark, d):
    panel, grid = fx.hourly_pair(spark, d)
    rows = og.trailing(panel, grid, F.col("ts"), 28).select("series_id", "origin", "ts", "y")
    return features.truncated_context(rows, 100)


@query
def history_windows(spark, d):
    """Own-era history cut to k weeks before each origin, for several k in one pass."""
    panel, grid = fx.daily_pair(spark, d)
    rows = og.trailing(panel.where("source = 'own'"), grid, temporal.midnight(F.col("date")), 56).withColumn("weeks", F.explode(F.array(*map(F.lit, (2, 4, 8)))))
    rows = rows.where(F.col("date") >= F.date_sub(temporal.day(F.col("origin")), F.col("weeks") * 7))
    return rows.select("series_id", temporal.day(F.col("origin")).alias("origin"), "weeks", "date", "y")


#: Days of history from which on an origin is forecast, to be learned from or to fill the pool.
WARM_UP_FROM = 7


def _pool(spark, d):
    """Scored hourly averages of every midnight origin, warm-up days before the first evaluation origin too, as the pools of later origins."""
    panel, grid = fx.hourly_pair(spark, d)
    made = baselines.hourly_average(panel, og.hourly_grid(panel, H, min_train_days=WARM_UP_FROM), H).where(F.hour("origin") == 0).join(panel.select("series_id", "ts", "y"), ["series_id", "ts"])
    return panel, grid, calibrate.pool_before(made, grid, 30)


@query
def ratio_table_l2(spark, d):
    *_, pool = _pool(spark, d)
    return calibrate.ratio_table(pool.withColumns({"hour": F.hour("ts"), "origin": F.col("at")}), ["origin", "series_id", "hour"])


@query
def every_hour_ratio(spark, d):
    """All 24 hours of every series and origin: each real ratio as it is, the nearest one where there is none."""
    return calibrate.every_hour(ratio_table_l2(spark, d), ["origin", "series_id"])


@query
def two_ratio_layers(spark, d):
    panel, grid, pool = _pool(spark, d)
    made = baselines.hourly_average(panel, grid, H).withColumn("hour", F.hour("ts"))
    return calibrate.two_layers(made, pool).select("series_id", "origin", "ts", "y_hat", "l2", "l2l3")


@query
def splice_cal(spark, d):
    panel, grid = fx.daily_pair(spark, d)
    ratio = calibrate.level_ratio(panel, grid).where("k = 0")
    return calibrate.splice_calibrated(panel, ratio)


def _methods(spark, d):
    """Two methods in one frame, scored, with mean scales."""
    panel, grid = fx.hourly_pair(spark, d)
    both = baselines.snaive_hourly(panel, grid, H).withColumn("method", F.lit("snaive")).unionByName(baselines.hourly_average(panel, grid, H).withColumn("method", F.lit("hourly_avg")))
    return score.evaluate_hourly(both, panel, H), score.mean_scales(score.hourly_scales(panel, grid, H))


METHODS = ["snaive", "hourly_avg"]


@query
def pivot_methods(spark, d):
    return score.by_method(*_methods(spark, d), METHODS, ["series_id", "origin", "ts", "bucket"])


@query
def mean_ranks(spark, d):
    losses = score.block_losses(pivot_methods(spark, d), METHODS, ["series_id", "origin", "bucket"])
    return score.mean_ranks(losses, METHODS, ["series_id", "origin", "bucket"], ["bucket"])


@query
def dm_day_diffs(spark, d):
    return score.day_differences(pivot_methods(spark, d), *METHODS, ["bucket"])


@query
def multi_grain_summary(spark, d):
    scored, scales = _methods(spark, d)
    return score.summarize_sets(scored, scales, [["method", "bucket"], ["method", "park"], ["method", "regime", "bucket"]])


@query
def paired_summary(spark, d):
    """Both methods on the targets that both forecast."""
    scored, scales = _methods(spark, d)
    keys = ["series_id", "origin", "ts"]
    both = scored.groupBy(*keys).agg(F.count("*").alias("m")).where(F.col("m") == len(METHODS))
    return score.summarize(scored.join(both, keys, "left_semi"), scales, ["method", "bucket"])


def _bands(spark, d):
    """Intervals around the seasonal forecast, as wide as the series' seasonal differences."""
    panel, grid = fx.hourly_pair(spark, d)
    scored = score.evaluate_hourly(baselines.snaive_hourly(panel, grid, H), panel, H).join(score.mean_scales(score.hourly_scales(panel, grid, H)), "series_id")
    low, mid, high = measures.in_order([F.col("y_hat") + F.col("scale"), F.col("y_hat"), F.col("y_hat") - F.col("scale")])
    return scored.select("series_id", "regime", "origin", "ts", "bucket", "y", "scale", low.alias("p10"), mid.alias("p50"), high.alias("p90"))


@query
def pinball_coverage(spark, d):
    return score.quantile_metrics(_bands(spark, d), ["bucket"])


@query
def quantile_by_regime(spark, d):
    return score.quantile_metrics(_bands(spark, d), ["regime", "bucket"])


def _sized(spark, d, rows):
    """rows with the bin of their series' mean."""
    size = fx.hourly(spark, d).groupBy("series_id").agg(F.avg("y").alias("size"))
    return rows.join(size, "series_id").withColumn("size_bin", measures.size_bin(F.col("size")))


@query
def quantile_by_size(spark, d):
    return score.quantile_metrics(_sized(spark, d, _bands(spark, d)), ["size_bin"])


def _holdout(spark, d):
    bands = calibrate.halves(_bands(spark, d).withColumn("day", temporal.day(F.col("origin"))), "day")
    return _sized(spark, d, calibrate.holdout_coverage(bands))


@query
def interval_widening(spark, d):
    """Coverage of the holdout half by the one factor that the calibration half gives: as a whole, and by regime, bucket and size."""
    names = ["regime", "bucket", "size_bin"]
    sets = [(), *((F.col(c),) for c in names)]
    return _holdout(spark, d).groupingSets(sets, *names).agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("widened").alias("widened"), F.max("factor").alias("factor"))


@query
def holdout_day_spread(spark, d):
    """The least, middle and greatest coverage of a holdout day."""
    days = _holdout(spark, d).groupBy("day").agg(F.avg("widened").alias("coverage"))
    return days.agg(F.count("*").alias("days"), F.min("coverage").alias("least"), F.median("coverage").alias("middle"), F.max("coverage").alias("most"))


@query
def coverage_table(spark, d):
    """Coverage of intervals as they are and widened by 1.2, by bucket and by size."""
    low, high = calibrate.widened(F.col("p10"), F.col("p50"), F.col("p90"), F.lit(1.2))
    rows = _sized(spark, d, _bands(spark, d))
    inside = lambda a, b: measures.share((F.col("y") >= a) & (F.col("y") <= b))
    return rows.groupingSets([(F.col("bucket"),), (F.col("size_bin"),)], "bucket", "size_bin").agg(F.count("*").alias("n"), inside(F.col("p10"), F.col("p90")).alias("raw"), inside(low, high).alias("widened"))


@query
def size_bins(spark, d):
    """Series by the bin of their mean."""
    size = fx.hourly(spark, d).groupBy("series_id").agg(F.avg("y").alias("size"))
    return size.groupBy(measures.size_bin(F.col("size")).alias("bin")).agg(F.count("*").alias("n"), F.avg("size").alias("mean"))


@query
def delta_table(spark, d):
    """Scaled errors of regime A by bucket, and how far they are from the base method's."""
    scored, scales = _methods(spark, d)
    return score.delta_to(score.summarize(scored.where("regime = 'A'"), scales, ["method", "bucket"]).select("method", "bucket", "n", "mase"), METHODS[0], ["bucket"])


@query
def report_table(spark, d):
    """The summary as a report shows it: rounded half to even."""
    table = snaive_scores_of(spark, d, H)
    return table.select("bucket", "n", *(F.bround(c, 3).alias(c) for c in ("mae", "rmse", "mase", "w5", "w10")))


WINDOWS = (2, 4, 8, 16, None)


def _window_ratios(spark, d):
    return calibrate.window_ratios(*fx.daily_pair(spark, d), WINDOWS)


@query
def window_ratios(spark, d):
    return _window_ratios(spark, d)


@query
def ratio_stability(spark, d):
    return score.stability(_window_ratios(spark, d))


@query
def ratio_variation(spark, d):
    return score.ratio_cv(_window_ratios(spark, d))


@query
def ratio_distribution(spark, d):
    return _window_ratios(spark, d).groupBy("window").agg(*score.quartiles("ratio"), F.median("days_seen").alias("days_seen"))


@query
def agreement_corr(spark, d):
    panel, grid = fx.hourly_pair(spark, d)
    a, b = baselines.snaive_hourly(panel, grid, H), baselines.hourly_average(panel, grid, H)
    return score.agreement(a, b, ["series_id", "origin", "ts"], ["series_id"])


@query
def monthly_climatology(spark, d):
    """The mean of each month of the coarse era, 12 rows a series, the series' mean where a month has no rows."""
    coarse = fx.daily(spark, d).where("source = 'coarse'")
    means = coarse.groupBy("series_id", F.month("date").alias("month")).agg(F.avg("y").alias("m"))
    whole = coarse.groupBy("series_id").agg(F.avg("y").alias("all")).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return whole.join(means, ["series_id", "month"], "left").select("series_id", "month", F.coalesce("m", "all").alias("mean"))


@query
def calendar_features(spark, d):
    days = fx.daily(spark, d).select("date").distinct()
    return days.select("date", *(c.alias(k) for k, c in production.calendar(F.col("date")).items()))


@query
def hour_features(spark, d):
    """Daily rows crossed with the hours of the day: the frame of an hourly model over daily data."""
    days = fx.daily(spark, d).where("source = 'own'").select("series_id", "date", F.explode(F.sequence(*map(F.lit, production.TRAIN_HOURS))).alias("hour"))
    return days.select("*", *(c.alias(k) for k, c in production.hours_of_day(F.col("hour")).items()))


@query
def calendar_weather(spark, d):
    """Order days and event days, either of which may lack a day of the other."""
    orders = fx.table(spark, d, "orders").groupBy(temporal.day(F.col("o_orderdate")).alias("date")).agg(F.count("*").alias("orders"))
    events = fx.table(spark, d, "events").groupBy(temporal.day(F.col("ts")).alias("date")).agg(F.count("*").alias("events"))
    return orders.join(events, "date", "full_outer").select("date", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("events", F.lit(0)).alias("events"))


@query
def status_scan(spark, d):
    """Counts and sums by type, day and hour: what many windows of pooled means are then made of."""
    events = fx.table(spark, d, "events").where(F.col("event_type").isin("view", "click") & (F.col("value") > 0))
    return events.groupBy("event_type", temporal.day(F.col("ts")).alias("date"), F.hour("ts").alias("hour")).agg(F.count("*").alias("cnt"), F.sum("value").alias("total"))


@query
def hour_pattern(spark, d):
    """Pooled means by type and hour from the counts and sums, where there are three."""
    return status_scan(spark, d).groupBy("event_type", "hour").agg(F.sum("cnt").alias("cnt"), (F.sum("total") / F.sum("cnt")).alias("mean")).where("cnt >= 3")


def _days_grid(spark, d):
    """The origin days of the hourly protocol, as origins of their own."""
    grid = fx.hourly_pair(spark, d)[1]
    return replace(grid, hours=(0,))


@query
def hour_patterns(spark, d):
    by_hour, by_series = production.patterns(fx.readings(spark, d), _days_grid(spark, d))
    return by_hour.join(by_series, ["k", "series_id"])


@query
def month_weather(spark, d):
    return production.month_weather(fx.weather(spark, d), fx.daily_pair(spark, d)[1])


def _layer_inputs(spark, d):
    """Daily means, readings and weather, each made once and stored, and the grid."""
    return files.stored(fx.event_days(spark, d), "days"), files.stored(fx.readings(spark, d), "readings"), files.stored(fx.weather(spark, d), "weather"), _days_grid(spark, d)


@query
def l1_training_frame(spark, d):
    """The 28 features and the target that each origin's first layer learns from."""
    return production.training_frame(*_layer_inputs(spark, d))


def _layer_goals(spark, d, grid):
    """Panel hours once for each origin day with them in its daily horizon: (k, origin, series_id, park, date, ts, hour)."""
    goal = og.targets(fx.hourly(spark, d), grid, 24 * D.horizon)
    return goal.select("k", "origin", "series_id", "park", temporal.day(F.col("ts")).alias("date"), "ts", F.hour("ts").alias("hour"))


def _past_grid(days, readings, grid):
    return production.observed_grid(readings, grid, 30).join(days.select("series_id", "park").distinct(), "series_id")


@query
def l1_goal_frame(spark, d):
    """The features of what each origin forecasts."""
    inputs = _layer_inputs(spark, d)
    return production.goal_frame(_layer_goals(spark, d, inputs[-1]), *inputs).select("k", "series_id", "ts", *production.FEATURES)


def _pattern_layers(spark, d):
    """All layers over the hour's mean as the first one, of all origins."""
    days, readings, _, grid = _layer_inputs(spark, d)
    by_hour, known = files.stored(production.patterns(readings, grid)[0], "hours"), production.codes(days, grid, "series_id")
    first = lambda rows: rows.join(known.select("k", "series_id"), ["k", "series_id"], "left_semi").join(by_hour, ["k", "series_id", "hour"], "left").withColumn("l1", calibrate.clipped(F.coalesce("hour_mean", F.lit(production.NO_MEAN))))
    past = files.stored(first(_past_grid(days, readings, grid)).select("k", "series_id", "date", "hour", "l1"), "past")
    return production.layered(readings, past, first(_layer_goals(spark, d, grid)), grid)


@query
def production_layers(spark, d):
    """First layer (here the mean of the hour) times the ratio of all history times that of the last 5 days, of all origin days."""
    return _pattern_layers(spark, d).select("k", "series_id", "ts", "l1", "l2", "l3", "y_hat")


@query
def production_daily(spark, d):
    """The same by day: means over the hours that were forecast."""
    return production.by_day(_pattern_layers(spark, d))


@query
def production_trees(spark, d):
    """The layers over trees for the mean that each origin day learns from its own training frame (80 % of it)."""
    inputs = _layer_inputs(spark, d)
    days, readings, _, grid = inputs
    train, goal, past = (files.stored(x, "frame") for x in (
        production.training_frame(*inputs), production.goal_frame(_layer_goals(spark, d, grid), *inputs), production.goal_frame(_past_grid(days, readings, grid), *inputs),
    ))
    numbers = tuple(c for c in production.FEATURES if c not in ("series_code", "park_code"))
    learn = train.where(F.pmod(F.xxhash64("series_id", "date", "hour"), F.lit(5)) > 0).withColumnRenamed("target", "y").withColumns({"q": F.lit(None).cast("double"), "model": F.col("k").cast("string")})
    forest = boosting.fit(learn, (*numbers, "series_code", "park_code"), (), TREES)
    goal_l1, past_l1 = (files.stored(forest.predict(f.withColumn("model", F.col("k").cast("string"))).withColumn("l1", calibrate.clipped(F.col("y_hat"))).drop("y_hat", "model"), "first") for f in (goal, past))
    out = production.layered(readings, past_l1.select("k", "series_id", "date", "hour", "l1"), goal_l1, grid)
    return out.select("k", "series_id", "ts", "l1", "l2", "l3", "y_hat")


@query
def stored_forecast_scan(spark, d):
    """A date cut from a stored timestamp string, and an hour added to a date: what reading stored forecasts takes."""
    stamp = F.col("o_orderdate").cast("string")
    rows = fx.table(spark, d, "orders").select(F.to_date(F.substring(stamp, 1, 10)).alias("made"), (F.col("o_orderkey") % 24).cast("int").alias("hour"), "o_totalprice")
    rows = rows.withColumn("target", temporal.plus_hours(temporal.midnight(F.col("made")), F.col("hour")))
    return rows.groupBy("made", "target").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))


#: How long before its target a stored forecast must have been made.
CUTOFF_DAYS = (1, 3, 6)


def _stored_layers(spark, d):
    """The layers' forecasts as a store of forecasts: (series_id, ts, made, deployed, first_layer)."""
    out = _pattern_layers(spark, d)
    return out.select("series_id", "ts", F.col("origin").alias("made"), F.col("y_hat").alias("deployed"), F.col("l1").alias("first_layer"))


def _asked(spark, d):
    panel = fx.hourly(spark, d).withColumn("days", F.explode(F.array(*map(F.lit, CUTOFF_DAYS))))
    return panel.select("series_id", "regime", "ts", "y", "days", temporal.plus_hours(F.col("ts"), -24 * F.col("days")).alias("cutoff"))


@query
def stored_as_of(spark, d):
    """For each observed hour and cutoff before it, the newest stored forecast made until then."""
    return fidelity.as_of(_asked(spark, d), _stored_layers(spark, d), ["series_id", "ts"], "cutoff", "made", ["deployed", "first_layer"])


def _as_of_both(spark, d):
    """Those with, from another store made three times a day, the newest mean of the hour and weekday until the same cutoff."""
    panel, grid = fx.hourly_pair(spark, d)
    other = baselines.hourly_average(panel, grid, H).select("series_id", "ts", F.col("origin").alias("averaged"), F.col("y_hat").alias("average"))
    return fidelity.as_of(stored_as_of(spark, d), other, ["series_id", "ts"], "cutoff", "averaged", ["average"])


@query
def same_target_accuracy(spark, d):
    """Scores of what was deployed, of its first layer alone and of the mean, on targets that all of them forecast by the cutoff."""
    return fidelity.same_targets(_as_of_both(spark, d), ["deployed", "first_layer", "average"], ["days"])


@query
def same_target_agreement(spark, d):
    return fidelity.same_target_agreement(_as_of_both(spark, d), "deployed", "average", ["days"])


@query
def frozen_daily_scores(spark, d):
    """The first stored forecast, averaged over the observed hours of each day, by the daily protocol."""
    panel = panels.daily_from_hourly(fx.hourly(spark, d), D.min_hours)
    hours = _pattern_layers(spark, d).where("k = 0")
    frozen = hours.groupBy("series_id", temporal.day(F.col("origin")).alias("origin"), "date").agg(F.avg("y_hat").alias("y_hat"))
    return score.evaluate_daily(frozen, panel, D).groupBy("regime", "bucket").agg(F.count("*").alias("n"), F.avg("abs_err").alias("mae"), F.sqrt(F.avg("sq_err")).alias("rmse"))


@query
def label_encoding(spark, d):
    parts = fx.table(spark, d, "part")
    codes = features.label_codes(parts, "p_type")
    return parts.join(F.broadcast(codes), "p_type", "left").groupBy("p_type", F.coalesce("code", F.lit(0)).alias("code")).agg(F.count("*").alias("n"))


@query
def era_overlap(spark, d):
    """Series of both eras, of one alone, and the union of both: set operations on ids."""
    panel = fx.daily(spark, d)
    own, coarse = (panel.where(f"source = '{s}'").select("series_id") for s in ("own", "coarse"))
    tagged = [own.intersect(coarse).withColumn("part", F.lit("both")), own.exceptAll(own.intersect(coarse)).distinct().join(coarse, "series_id", "left_anti").withColumn("part", F.lit("own only")), own.union(coarse).distinct().withColumn("part", F.lit("any"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query
def id_crosswalk(spark, d):
    nation, region = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    known = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("outer_id"), F.concat_ws(".", "r_name", "n_name").alias("series_id")).distinct()
    manual = spark.createDataFrame([(9001, "MANUAL.ONE"), (9002, "MANUAL.TWO")], "outer_id long, series_id string")
    return panels.assert_unique(known.unionByName(manual), ["outer_id"])


@query
def series_metadata(spark, d):
    hourly = fx.hourly(spark, d)
    meta = hourly.groupBy("series_id", "park", "resort", "regime").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_hours"), F.count_distinct(temporal.day(F.col("ts"))).alias("n_days"), F.avg("y").alias("mean"))
    full = panels.daily_from_hourly(hourly, D.min_hours).groupBy("series_id").agg(F.count("*").alias("full_days"))
    return meta.join(full, "series_id", "left").withColumn("full_days", F.coalesce("full_days", F.lit(0)))


@query
def daily_scores(spark, d):
    """All daily baselines in one frame, scored in one plan."""
    panel, grid = fx.daily_pair(spark, d)
    made = {
        "snaive7": baselines.snaive7(panel, grid, D), "snaive7_ext": baselines.snaive7_extended(panel, grid, D), "dow_mean_8w": baselines.dow_mean(panel, grid, D, 8), "dow_mean_full": baselines.dow_mean(panel, grid, D, None),
        "snaive364": baselines.snaive364(panel, grid, D), "dow_shape_annual": baselines.dow_shape_annual(panel, grid, D),
    }
    rows = None
    for name, frame in made.items():
        frame = frame.withColumn("method", F.lit(name))
        rows = frame if rows is None else rows.unionByName(frame)
    return score.summarize(score.evaluate_daily(rows, panel, D), score.mean_scales(score.daily_scales(panel, grid, D)), ["method", "bucket"])


@query
def dm_statistics(spark, d):
    """The statistic without its p value, of two daily methods."""
    return inference.dm_test(_daily_diffs(spark, d), ["bucket"]).drop("p")


@query
def dm_test(spark, d):
    """With four lags, as horizons of up to sixteen weeks overlap from one origin to the next."""
    return inference.dm_test(_daily_diffs(spark, d), ["bucket"], DAILY_LAG)


@query
def mcb_cd(spark, d):
    return inference.mcb(mean_ranks(spark, d), ["bucket"], len(METHODS))


@query
def bootstrap_ci(spark, d):
    """Intervals of the mean difference, and the part of draws on the other side of 0."""
    return inference.bootstrap_ci(files.stored(_daily_diffs(spark, d), "diffs"), ["bucket"])


@query
def bootstrap_methods(spark, d):
    """Intervals of each method's own mean loss."""
    wide = _daily_wide(spark, d)
    losses = None
    for m in DAILY_METHODS:
        one = score.day_means(wide, m, ["bucket"]).withColumn("method", F.lit(m))
        losses = one if losses is None else losses.unionByName(one)
    return inference.bootstrap_ci(files.stored(losses, "losses"), ["method", "bucket"])


@query
def block_bootstrap(spark, d):
    """Intervals by moving blocks of 1 to 4 origin days."""
    return inference.block_bootstrap(files.stored(_daily_diffs(spark, d), "diffs"), ["bucket"])


DAILY_METHODS = ["snaive7_ext", "dow_mean_8w"]
DAILY_LAG = 4


def _daily_wide(spark, d):
    panel, grid = fx.daily_pair(spark, d)
    both = baselines.snaive7_extended(panel, grid, D).withColumn("method", F.lit(DAILY_METHODS[0])).unionByName(baselines.dow_mean(panel, grid, D, 8).withColumn("method", F.lit(DAILY_METHODS[1])))
    return score.by_method(score.evaluate_daily(both, panel, D), score.mean_scales(score.daily_scales(panel, grid, D)), DAILY_METHODS, ["series_id", "origin", "date", "bucket"])


def _daily_diffs(spark, d):
    """Day differences of two daily methods over all origins."""
    return score.day_differences(_daily_wide(spark, d), *DAILY_METHODS, ["bucket"])


def _days(grid) -> list:
    return sorted({t.replace(hour=0) for t in grid.times()})


#: The trees of all queries here.
TREES = boosting.Growth()


def _hourly_samples(panel, base=None):
    """Samples of all pseudo-origins: a week of history is enough for one."""
    return features.hourly_samples(panel if base is None else base, og.hourly_grid(panel, H, min_train_days=WARM_UP_FROM), H)


def _hourly_models(rows, grid, *more):
    """What each evaluation day's model learns from, and what it forecasts: rows with model."""
    train = models.later_days(rows, grid, models.known_hourly(H.horizon // 24))
    return models.named(train, "day", *more), models.named(rows, temporal.day(F.col("origin")), *more)


def _daily_models(rows, grid, *more):
    train = models.later_days(rows, grid, F.date_add("date", 1))
    return models.named(train, "day", *more), models.named(rows, "origin", *more)


@query
def gbt_l1(spark, d):
    """Hourly forecasts of every origin by trees for the median that each origin day learned from the samples known by then."""
    panel, grid = fx.hourly_pair(spark, d)
    train, goal = _hourly_models(files.stored(_hourly_samples(panel), "samples"), grid)
    made = boosting.fit(train.withColumn("q", F.lit(0.5)), models.HOURLY_NUMBERS, models.CATEGORIES, TREES).predict(goal)
    return made.select("series_id", "origin", "ts", "y", "y_hat")


#: What the base that knows the calendar alone may use.
CALENDAR_BASE = ("hour", "dow", "is_weekend", "month")


@query
def calibration_cells(spark, d):
    """Two bases (calendar features alone, and all) without layers, with one and with two: forecasts of every evaluation origin. Every
    origin day, warm-up days included, has a model of its own that learned from what was known by then; what it forecast at midnight is
    stored, and is the pool that the layers of later origins read."""
    panel, grid = fx.hourly_pair(spark, d)
    # the panel is short: its first day is an origin too, so that a model is known a week before the first evaluation
    past = og.hourly_grid(panel, H, min_train_days=0)
    samples = files.stored(features.hourly_samples(panel, past, H), "samples")
    hidden = {c: F.lit(None).cast("double") for c in models.HOURLY_NUMBERS if c not in CALENDAR_BASE}
    rows = samples.withColumn("base", F.lit("rec")).unionByName(samples.withColumns(hidden | {"base": F.lit("cal")}).select(*samples.columns, "base"))
    train, goal = _hourly_models(rows, past, "base")
    made = boosting.fit(train.withColumn("q", F.lit(0.5)), models.HOURLY_NUMBERS, models.CATEGORIES, TREES).predict(goal)
    made = files.stored(made.select("base", "series_id", "origin", "ts", "y", "y_hat"), "forecasts")
    asked, out = og.origins(spark, grid).select("origin"), None
    for base in ("cal", "rec"):
        own = made.where(F.col("base") == base)
        pool = calibrate.pool_before(own.where(F.hour("origin") == 0).drop("base"), grid, 30)
        one = calibrate.two_layers(own.join(F.broadcast(asked), "origin", "left_semi").withColumn("hour", F.hour("ts")), pool)
        one = one.select("base", "series_id", "origin", "ts", "y", F.col("y_hat").alias("none"), "l2", "l2l3")
        out = one if out is None else out.unionByName(one)
    return out


@query
def gbt_squared(spark, d):
    """Daily forecasts of every origin by trees for the mean, on the spliced and calibrated panel, over origins that go back through all of it."""
    samples = experiments.grain_samples(*fx.daily_pair(spark, d), D).where("condition = 'splice_cal'")
    train, goal = _daily_models(files.stored(samples, "samples"), fx.daily_pair(spark, d)[1])
    made = boosting.fit(train.withColumn("q", F.lit(None)), models.DAILY_NUMBERS, models.CATEGORIES, TREES).predict(goal)
    return made.select("series_id", "origin", "date", "y", "y_hat")


@query
def gbt_quantile(spark, d):
    """Three quantiles of every hourly target, in order, all of them and all origin days in one growth."""
    panel, grid = fx.hourly_pair(spark, d)
    rows = files.stored(_hourly_samples(panel), "samples").withColumn("q", F.explode(F.array(*map(F.lit, QUANTILES))))
    train, goal = _hourly_models(rows, grid, "q")
    made = boosting.fit(train, models.HOURLY_NUMBERS, models.CATEGORIES, TREES).predict(goal)
    wide = made.groupBy("series_id", "origin", "ts", "y").agg(*(F.max(F.when(F.col("q") == q, F.col("y_hat"))).alias(f"q{i}") for i, q in enumerate(QUANTILES)))
    low, mid, high = measures.in_order([F.col(f"q{i}") for i in range(len(QUANTILES))])
    return wide.select("series_id", "origin", "ts", "y", low.alias("p10"), mid.alias("p50"), high.alias("p90"))


QUANTILES = (0.1, 0.5, 0.9)


@query
def backward_origins(spark, d):
    """The origins of each data condition, carried back through its history."""
    panel, grid = fx.daily_pair(spark, d)
    out = None
    for name, frame in experiments.grain_panels(panel, grid).items():
        one = og.origins(spark, experiments.backward_grid(grid, experiments.begin(frame))).select(F.lit(name).alias("condition"), "k", temporal.day(F.col("origin")).alias("origin"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def some_origins(spark, d):
    """The first two and the last two weeks of origins."""
    panel, grid = fx.daily_pair(spark, d)
    part = lambda g, name: og.origins(spark, g).select(F.lit(name).alias("part"), temporal.day(F.col("origin")).alias("origin"))
    return part(experiments.first_origins(grid, 2), "first").unionByName(part(experiments.last_origins(grid, 2), "last"))


@query
def grain_samples(spark, d):
    return experiments.grain_samples(*fx.daily_pair(spark, d), D)


@query
def train_masks(spark, d):
    """How many samples each evaluation day may learn from, and how many it forecasts: whole horizons known (hourly), dates passed (daily)."""
    hourly, grid = fx.hourly_pair(spark, d)
    daily, weekly = fx.daily_pair(spark, d)

    def counts(kind, rows, days, known):
        dates = F.array(*(F.lit(x.date()) for x in days)).cast("array<date>")
        rows = rows.withColumn("day", F.explode(dates))
        return rows.groupBy(F.lit(kind).alias("kind"), "day").agg(F.count_if(known).alias("train"), F.count_if(temporal.day(F.col("origin")) == F.col("day")).alias("goal"))

    last = F.col("origin") + F.make_dt_interval(F.lit(H.horizon // 24)) <= temporal.midnight(F.col("day"))
    one = counts("hourly", og.targets(hourly, og.hourly_grid(hourly, H, min_train_days=7), H.horizon), _days(grid), last)
    return one.unionByName(counts("daily", og.daily_targets(daily, weekly, D.horizon), _days(weekly), F.col("date") < F.col("day")))


@query
def curve_samples(spark, d):
    return experiments.curve_samples(*fx.daily_pair(spark, d), D, WINDOWS)


@query
def scaled_coarse_samples(spark, d):
    """Of every evaluation origin and window (each has all coarse samples whose series has a ratio there): means of the scaled columns over
    the targets of each sample origin."""
    rows = experiments.scaled_coarse_samples(*fx.daily_pair(spark, d), D, WINDOWS)
    return rows.groupBy("window", "k", "series_id", "origin").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("lead").alias("last_lead"), *(F.avg(c).alias(c) for c in experiments.LEVELS))


@query
def coldstart_samples(spark, d):
    panel, grid = fx.hourly_pair(spark, d)
    return experiments.coldstart_samples(panel, grid, H, "B", (1, 2, None))


@query
def covariate_scan(spark, d):
    return fx.covariates(spark, d)


def _covariate_samples(spark, d):
    panel, grid = fx.daily_pair(spark, d)
    frame = experiments.grain_panels(panel, grid)["splice_cal"]
    begin = experiments.begin(frame)
    return experiments.with_covariates(features.daily_samples(frame, experiments.backward_grid(grid, begin) if begin else grid, D), fx.covariates(spark, d))


@query
def covariate_samples(spark, d):
    return _covariate_samples(spark, d)


@query
def gbt_grain(spark, d):
    """Forecasts of every origin by models that learned from the own era, from both as they are, and from both at one level."""
    panel, grid = fx.daily_pair(spark, d)
    train, goal = _daily_models(files.stored(experiments.grain_samples(panel, grid, D), "samples"), grid, "condition")
    made = boosting.fit(train.withColumn("q", F.lit(0.5)), models.DAILY_NUMBERS, models.CATEGORIES, TREES).predict(goal)
    return made.select("condition", "series_id", "origin", "date", "y", "y_hat")


FEATURE_SETS = {
    "base": (), "school": fx.SCHOOL, "events": fx.EVENTS, "weather": fx.WEATHER, "all": fx.SCHOOL + fx.EVENTS + fx.WEATHER, "no_recency": (),
}


@query
def gbt_covariates(spark, d):
    """Forecasts of every origin by feature set: the base, without recency, with each group of covariates, and with all. A set's
    models have the columns that they may not use empty, so that all sets are one growth."""
    grid, samples = fx.daily_pair(spark, d)[1], files.stored(_covariate_samples(spark, d), "covariates")
    every, rows = FEATURE_SETS["all"], None
    for name, more in FEATURE_SETS.items():
        hidden = [*(c for c in every if c not in more), *(experiments.RECENCY if name == "no_recency" else ())]
        one = samples.withColumns({c: F.lit(None).cast("double") for c in hidden} | {"condition": F.lit(name)}).select(*samples.columns, "condition")
        rows = one if rows is None else rows.unionByName(one)
    train, goal = _daily_models(rows, grid, "condition")
    made = boosting.fit(train.withColumn("q", F.lit(0.5)), models.DAILY_NUMBERS + every, models.CATEGORIES, TREES).predict(goal)
    return made.select("condition", "series_id", "origin", "date", "y", "y_hat")


@query
def gbt_curve(spark, d):
    """Forecasts of every origin by window of own data, without and with the coarse era's part."""
    panel, grid = fx.daily_pair(spark, d)
    own = files.stored(experiments.curve_samples(panel, grid, D, WINDOWS), "curve")
    coarse = experiments.scaled_coarse_samples(panel, grid, D, WINDOWS)
    names = ["k", "window", "series_id", "park", "regime", "origin", "date", "y", *models.DAILY_NUMBERS]
    fine = own.withColumns({c: F.lit(None).cast("double") for c in ("lag364", "ann28")}).withColumn("kind", F.lit("fine"))
    both = fine.unionByName(own.withColumn("kind", F.lit("aug"))).select(*names, "part", "kind")
    some = both.where("part = 'train'").select("k", "window").distinct()  # a window without a sample of its own has no model
    train = both.where("part = 'train'").drop("part").unionByName(coarse.join(F.broadcast(some), ["k", "window"], "left_semi").select(*names, F.lit("aug").alias("kind")))
    train, goal = (models.named(x, "window", "kind", "k") for x in (train, both.where("part = 'goal'")))
    made = boosting.fit(train.withColumn("q", F.lit(0.5)), models.DAILY_NUMBERS, models.CATEGORIES, TREES).predict(goal)
    return made.select(F.concat_ws("_", "window", "kind").alias("cell"), "series_id", "origin", "date", "y", "y_hat")


@query
def gbt_coldstart(spark, d):
    """Forecasts of new series from every origin day, by weeks of own data and by whose data is learned from: the series', its park's, or all."""
    panel, grid = fx.hourly_pair(spark, d)
    new = files.stored(experiments.coldstart_samples(panel, grid, H, "B", COLD_WINDOWS), "new")
    names = ["day", "window", "series_id", "park", "regime", "origin", "ts", "y", *models.HOURLY_NUMBERS]
    rest = models.later_days(_hourly_samples(panel, panel.where("regime <> 'B'")), grid, models.known_hourly(H.horizon // 24))
    some = new.where("part = 'train'").select("day", "window").distinct()
    scopes = F.explode(F.array(*map(F.lit, ("local_series", "local_park", "global_all"))))
    mine = new.select(*names, "part", scopes.alias("scope"))
    train = mine.where("part = 'train'").drop("part").unionByName(rest.join(F.broadcast(some), "day").select(*names, F.lit("global_all").alias("scope")))
    of = F.when(F.col("scope") == "local_series", F.col("series_id")).otherwise(F.lit(""))
    train, goal = (models.named(x, "day", "window", "scope", of) for x in (train, mine.where("part = 'goal'")))
    made = boosting.fit(train.withColumn("q", F.lit(0.5)), models.HOURLY_NUMBERS, models.CATEGORIES, TREES).predict(goal)
    return made.select(F.concat_ws("_", "window", "scope").alias("cell"), "series_id", "origin", "ts", "y", "y_hat")


COLD_WINDOWS = (1, 2, None)


@query
def feature_importance(spark, d):
    """Each feature's share of what the splits gained, of trees over all hourly samples."""
    rows = _hourly_samples(fx.hourly_pair(spark, d)[0]).withColumns({"model": F.lit("all"), "q": F.lit(0.5)})
    return boosting.fit(rows, models.HOURLY_NUMBERS, models.CATEGORIES, TREES).importance()


@query
def series_rules(spark, d):
    """Classification by prefix, with what a name must contain, may not contain and may not end with."""
    names = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id")).distinct()
    rules = tuple(panels.SeriesRule(f"{i}-", f"P{i}", "east" if i < 4 else "west", "ABC"[i % 3]) for i in range(1, 6))
    return panels.classify(names, rules, must_contain="-", never=("SPEC",), never_ends=("LOW",))


@query
def era_splice(spark, d):
    """Both eras in one panel: coarse means above 0 before the own era, the own panel from then on."""
    panel = fx.daily(spark, d)
    return panels.spliced(panel.where("source = 'own'"), panel.drop("source"), D.own_start)


@query
def history_scan(spark, d):
    """Daily history of the series of two prefixes, and the weather of its days."""
    rows = fx.daily(spark, d).where(F.col("series_id").startswith("A-") | F.col("series_id").startswith("N-")).select("series_id", "date", "y")
    return rows.join(fx.weather(spark, d).select("date", "temp_max", "rain"), "date", "left")


@query
def ordered_export(spark, d):
    """What a gzip CSV export in the order of series and time holds, read back."""
    path = files.scratch_path(spark, "csv") + "/panel"
    files.write_csv(fx.daily(spark, d).select("series_id", "date", "source", F.round("y", 6).alias("y")), path, compressed=True, order=["series_id", "date"])
    return spark.read.csv(path, header=True, schema="series_id string, date date, source string, y double")


@query
def forecasts_by_method(spark, d):
    """Forecasts of two methods, written by method and read back."""
    panel, grid = fx.hourly_pair(spark, d)
    both = baselines.snaive_hourly(panel, grid, H).withColumn("method", F.lit("snaive")).unionByName(baselines.hourly_average(panel, grid, H).withColumn("method", F.lit("hourly_avg")))
    path = files.scratch_path(spark, "forecasts") + "/table"
    files.write_forecasts(both, path)
    return files.read_parquet(spark, path, ["method", "series_id", "origin", "ts", "y_hat"], like=both)


@query
def regular_grid_theta(spark, d):
    panel, grid = fx.hourly_pair(spark, d)
    made = models.per_series(features.regular_grid(panel, grid), H.season, H.horizon)
    return made.join(og.targets(panel, grid, H.horizon).select("series_id", "origin", "ts"), ["series_id", "origin", "ts"])


@query
def regular_grid_mstl(spark, d):
    """Two seasons by loess and exponential smoothing, in place of the theta method."""
    panel, grid = fx.hourly_pair(spark, d)
    made = models.per_series(features.regular_grid(panel, grid), H.season, H.horizon, smoothing.mstl_ets_forecast)
    return made.join(og.targets(panel, grid, H.horizon).select("series_id", "origin", "ts"), ["series_id", "origin", "ts"])


#: Two, four and eight weeks, and all hours.
CONTEXTS = (2 * 168, 4 * 168, 8 * 168, None)


@query
def theta_context_curve(spark, d):
    """How theta's scores grow with the hours it knows: by context (null: all) and bucket."""
    panel, grid = fx.hourly_pair(spark, d)
    made = models.context_curve(features.regular_grid(panel, grid), H.season, H.horizon, CONTEXTS)
    return score.summarize(score.evaluate_hourly(made, panel, H), score.mean_scales(score.hourly_scales(panel, grid, H)), ["context", "bucket"])


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in sql.ORACLE.items() if name in _queries}
