"""Sample matrices of the experiments: which data a model learns from (grain), how much of it (learning curve), whose (cold start), and with which columns (covariates).

Each experiment is one frame of samples with the number of the evaluation origin and the cell that they belong to, so that
a fit is a filter of it.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, time, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.functions.temporal import day, lead_days, midnight, seconds, weekday
from foretable.operators import features
from foretable.operators.calibrate import level_ratio, splice_calibrated, window_ratios
from foretable.operators.origins import daily_targets, trailing
from foretable.protocol import Daily, Grid, Hourly

LEVELS = ("y", "r7", "r28", "dow8w", "lag364", "ann28")
#: The feature sets of the covariate ablation, beside the daily features.
RECENCY = ("r7", "r28", "dow8w")


def backward_grid(grid: Grid, begin: datetime, min_days: int = 28) -> Grid:
    """The grid carried on backwards at its own spacing, as far as min_days after begin."""
    steps = max(0, (grid.first - (begin + timedelta(days=min_days))).days // grid.spacing_days)
    return replace(grid, first=grid.first - timedelta(days=grid.spacing_days * steps), weeks=grid.weeks + steps)


def first_origins(grid: Grid, n: int) -> Grid:
    return replace(grid, weeks=min(n, grid.weeks))


def last_origins(grid: Grid, n: int) -> Grid:
    cut = max(0, grid.weeks - n)
    return replace(grid, first=grid.first + timedelta(days=grid.spacing_days * cut), weeks=grid.weeks - cut)


def begin(panel: DataFrame) -> datetime | None:
    low = panel.agg(F.min("date")).first()[0]
    return None if low is None else datetime.combine(low, time())


def grain_panels(panel: DataFrame, grid: Grid) -> dict[str, DataFrame]:
    """The own era alone, both eras as they are, and both with the coarse one brought to the own level (by the ratio before the first origin)."""
    ratio = level_ratio(panel, grid).where("k = 0")
    return {"fine": panel.where("source = 'own'"), "splice": panel, "splice_cal": splice_calibrated(panel, ratio)}


def grain_samples(panel: DataFrame, grid: Grid, p: Daily) -> DataFrame:
    """Daily samples of each condition, over origins that go back as far as the condition's history."""
    out = None
    for name, frame in grain_panels(panel, grid).items():
        low = begin(frame)
        made = features.daily_samples(frame, backward_grid(grid, low) if low else grid, p).withColumn("condition", F.lit(name))
        out = made if out is None else out.unionByName(made)
    return out


def windows(panel: DataFrame, grid: Grid, weeks: tuple[int | None, ...]) -> DataFrame:
    """Own rows (series_id, park, regime, date, y) once for each evaluation origin and window that holds them: adds k, at (the origin) and window."""
    own = panel.where("source = 'own'").select("series_id", "park", "regime", "date", "y")
    longest = max(w for w in weeks if w)
    rows = trailing(own, grid, midnight(F.col("date")), 7 * longest).withColumn("at", day(F.col("origin"))).drop("origin")
    short = F.array(*(F.when(F.col("date") >= F.date_sub("at", 7 * w), F.lit(f"k{w:02d}")) for w in weeks if w))
    out = rows.withColumn("window", F.explode(F.array_compact(short)))
    if None in weeks:
        spans = F.sequence(F.lit(0), F.lit(grid.count - 1))
        origin = F.to_date(F.lit(grid.first.date().isoformat()))
        full = own.withColumn("k", F.explode(spans)).withColumn("at", F.date_add(origin, F.col("k") * grid.spacing_days)).where("date < at").withColumn("window", F.lit("full"))
        out = out.unionByName(full.select(*out.columns))
    return out


def recency_at(held: DataFrame, when: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, r7, r28) and (keys, dow, dow8w) of the rows before a date, over the last 7, 28 and 56 days."""
    held = held.where((F.col("date") < when) & (F.col("date") >= F.date_sub(when, 56)))
    within = lambda n: F.avg(F.when(F.col("date") >= F.date_sub(when, n), F.col("y")))
    return held.groupBy(*keys).agg(within(7).alias("r7"), within(28).alias("r28")), held.groupBy(*keys, weekday(F.col("date")).alias("dow")).agg(F.avg("y").alias("dow8w"))


def curve_samples(panel: DataFrame, grid: Grid, p: Daily, weeks: tuple[int | None, ...] = (2, 4, 8, 16, None)) -> DataFrame:
    """The learning curve's samples: window, k, part (train or goal), series_id, park, regime, origin, date, y, the daily features without
    annual lags, and lag364, ann28 of the coarse era times the window's ratio. A model of own data leaves the last two out; an
    augmented one keeps them. Training samples are those of weekly origins inside the window, of dates before the evaluation origin."""
    held = windows(panel, grid, weeks)
    starts = held.groupBy("window", "k", "at").agg(F.min("date").alias("start"))
    steps = F.sequence(F.lit(1), F.greatest(F.floor((F.datediff("at", "start") - 7) / 7).cast("int"), F.lit(1)))
    asked = starts.where(F.datediff("at", "start") >= 14).withColumn("back", F.explode(steps)).select("window", "k", "at", F.date_sub("at", F.col("back") * 7).alias("origin"), F.lit("train").alias("part"))
    asked = asked.unionByName(starts.select("window", "k", "at", F.col("at").alias("origin"), F.lit("goal").alias("part")))
    keys = ["window", "k", "part", "origin", "series_id"]
    placed = held.drop("at").join(asked, ["window", "k"])
    recent, by_day = recency_at(placed, F.col("origin"), keys)
    ahead = (F.col("date") >= F.col("origin")) & (F.col("date") < F.date_add("origin", p.horizon))
    train = placed.where(ahead & (F.col("part") == "train") & (F.col("date") < F.col("at")))
    goal = daily_targets(panel.where("source = 'own'"), grid, p.horizon).join(starts.select("window", "k", F.lit("goal").alias("part")), "k")
    names = ["window", "k", "part", "series_id", "park", "regime", "origin", "date", "y"]
    rows = train.select(*names).unionByName(goal.select(*names)).withColumn("dow", weekday(F.col("date")))
    rows = rows.join(recent, keys, "left").join(by_day, [*keys, "dow"], "left")
    annual = features.annual_lookup(panel.where("source = 'coarse'"))
    ratio = window_ratios(panel, grid, weeks).select("window", "k", "series_id", "ratio")
    rows = rows.join(annual, ["series_id", "date"], "left").join(ratio, ["window", "k", "series_id"], "left")
    return rows.select(*names, lead_days(F.col("origin"), F.col("date")).alias("lead"), "dow", (F.col("dow") >= 5).cast("int").alias("is_weekend"), F.month("date").alias("month"), *RECENCY, *((F.col(c) * F.col("ratio")).alias(c) for c in ("lag364", "ann28")))


def scaled_coarse_samples(panel: DataFrame, grid: Grid, p: Daily, weeks: tuple[int | None, ...] = (2, 4, 8, 16, None)) -> DataFrame:
    """What an augmented model learns from beside its own window: coarse samples, made once, whose level columns are times the ratio of the
    window and evaluation origin (all are linear in y); series without a ratio are left out."""
    coarse = panel.where("source = 'coarse'")
    low = begin(coarse)
    past = backward_grid(grid, low) if low else grid
    past = first_origins(past, past.weeks - grid.weeks)  # those before the first evaluation origin
    made = features.daily_samples(coarse, past, p)
    ratio = window_ratios(panel, grid, weeks).select("window", "k", "series_id", "ratio")
    return made.join(ratio, "series_id").select("window", "k", *(c for c in made.columns if c not in LEVELS), *((F.col(c) * F.col("ratio")).alias(c) for c in LEVELS))


def with_covariates(samples: DataFrame, covariates: DataFrame, masked_regime: str = "C") -> DataFrame:
    """Samples with the covariates of their date, null for a regime that they say nothing of."""
    names = [c for c in covariates.columns if c != "date"]
    rows = samples.join(covariates, "date", "left")
    return rows.withColumns({c: F.when(F.col("regime") != masked_regime, F.col(c)) for c in names})


def coldstart_samples(panel: DataFrame, grid: Grid, p: Hourly, regime: str, weeks: tuple[int | None, ...]) -> DataFrame:
    """Hourly samples of the new series (those of one regime) as each evaluation day knows them: window, day, part (train or goal), and the
    hourly features, all of them from no more than the window's rows before each sample's origin. Training samples are those of
    weekly origins within the window, of times before the day."""
    if grid.spacing_days % 7:
        raise ValueError("evaluation days must lie whole weeks apart")
    new = panel.where(F.col("regime") == regime)
    low = new.agg(F.min(day(F.col("ts")))).first()[0]
    if low is None or not grid.count:
        out = features.hourly_samples(new, grid, p)
        return out.select(F.lit("").alias("window"), day(F.col("origin")).alias("day"), F.lit("").alias("part"), *out.columns).limit(0)
    first = grid.first.replace(hour=0)
    back = max(0, (first - datetime.combine(low, time())).days // 7)
    own = Grid(first - timedelta(weeks=back), back + (grid.weeks - 1) * grid.spacing_days // 7 + 1, grid.hours)
    # a series as one day's window knows it is a series of its own, so that all of them pass the features together
    held = _known(new, grid, first, p.horizon, weeks)
    starts = held.groupBy("series_id.window", "series_id.day").agg(F.min(day(F.col("ts"))).alias("low"))
    rows = features.hourly_samples(held, own, p)
    rows = rows.select("series_id.window", "series_id.day", F.col("series_id.series_id").alias("series_id"), *(c for c in rows.columns if c != "series_id")).join(starts, ["window", "day"])
    steps = F.datediff("day", "origin") / 7
    part = F.when(steps == 0, F.lit("goal")).when(F.col("ts") < midnight(F.col("day")), F.lit("train"))
    rows = rows.where((steps >= 0) & (steps <= F.greatest(F.lit(0), F.floor(F.datediff("day", "low") / 7) - 1))).withColumn("part", part).where("part IS NOT NULL")
    return rows.select("window", "day", "part", *(c for c in rows.columns if c not in ("window", "day", "part", "low")))


def _asked(name: Column, first: Column, spacing: int, i: Column) -> Column:
    return F.struct(name, F.date_add(first, i * spacing).alias("day"))


def _known(rows: DataFrame, grid: Grid, first: datetime, horizon: int, weeks: tuple[int | None, ...]) -> DataFrame:
    """rows once for each window and evaluation day that need them, found by arithmetic: those from the window's start to the end of the
    day's last horizon. series_id becomes (window, day, series_id)."""
    step = 86400 * grid.spacing_days
    off = seconds(F.col("ts")) - int((first - datetime(1970, 1, 1)).total_seconds())
    since = F.greatest(F.floor((off - 86400 - 3600 * horizon) / step) + 1, F.lit(0)).cast("int")
    spans = []
    for w in weeks:
        until = F.lit(grid.weeks - 1) if w is None else F.least(F.floor((off + 604800 * w) / step), F.lit(grid.weeks - 1)).cast("int")
        numbers = F.when(since <= until, F.sequence(since, until)).otherwise(F.array().cast("array<int>"))
        name = F.lit(f"k{w:02d}" if w else "full").alias("window")
        spans.append(F.transform(numbers, partial(_asked, name, F.lit(first.date()), grid.spacing_days)))
    found = rows.withColumn("__at", F.explode(F.concat(*spans)))
    return found.withColumn("series_id", F.struct("__at.window", "__at.day", "series_id")).drop("__at")
