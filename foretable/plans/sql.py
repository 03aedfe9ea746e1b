"""SQL (DuckDB's dialect) for the queries of the catalogue."""

_EVENT_SERIES = "(VALUES ('click','P1','east','A'), ('view','P2','east','A'), ('purchase','P3','east','B'), ('signup','P4','west','C'), ('error','P5','west','C'))"
_ITEM_SERIES = "(VALUES ('A','PA','east','A'), ('N','PN','east','B'), ('R','PR','west','C'))"

HOURLY = f"""
h AS (
  SELECT e.event_type AS series_id, park, resort, regime, date_trunc('hour', e.ts)::TIMESTAMP AS ts, avg(value) AS y, count(value) AS n_obs
  FROM events e JOIN {_EVENT_SERIES} r(s, park, resort, regime) ON r.s = e.event_type
  WHERE value IS NOT NULL GROUP BY ALL HAVING count(value) >= 3)"""


def _origins(train: int = 14, name: str = "o") -> str:
    return f"""
{name} AS (
  SELECT (w * 3 + i)::INT AS k, (d0 + w * 7)::TIMESTAMP + to_hours(hh) AS origin
  FROM (SELECT min(ts)::DATE + {train} AS d0, max(ts)::DATE - 7 AS d1 FROM h), (SELECT unnest(range(0, 100))::INT AS w), (VALUES (0, 0), (1, 9), (2, 13)) v(i, hh)
  WHERE d0 + w * 7 <= d1)"""


ORIGINS = _origins()
DAILY = f"""
d AS (
  SELECT * FROM (
    SELECT l_returnflag || '-' || l_linestatus AS series_id, park, resort, regime, l_shipdate::DATE AS date, avg(l_quantity) AS y,
           CASE WHEN l_shipdate::DATE >= DATE '2001-03-06' THEN 'own' ELSE 'coarse' END AS source
    FROM lineitem JOIN {_ITEM_SERIES} r(f, park, resort, regime) ON f = l_returnflag GROUP BY ALL HAVING count(*) >= 3)
  WHERE source = 'own' OR regime = 'A' OR (regime = 'B' AND date >= DATE '2000-05-01')),
q AS (
  SELECT w AS k, d0 + w * 7 AS origin
  FROM (SELECT min(date) + 56 AS d0, max(date) - 7 AS d1 FROM d WHERE source = 'own'), (SELECT unnest(range(0, 200))::INT AS w)
  WHERE d0 + w * 7 <= d1)"""

H = f"WITH {HOURLY}, {ORIGINS}"
D = f"WITH {DAILY}"
T = "t AS (SELECT series_id, park, regime, ts, y, k, origin FROM h JOIN o ON ts >= origin AND ts < origin + INTERVAL 168 HOUR)"
DT = "t AS (SELECT series_id, park, regime, date, y, k, origin FROM d JOIN q ON date >= origin AND date < origin + 112)"
SNAIVE = """
sn AS (
  SELECT t.series_id, origin, t.ts, arg_min(p.y, w) AS y_hat
  FROM t, (SELECT unnest(range(1, 5))::INT AS w) JOIN h p ON p.series_id = t.series_id AND p.ts = t.ts - to_hours(168 * w) AND p.ts < origin GROUP BY ALL)"""
AVERAGE = """
ha AS (
  SELECT t.series_id, origin, t.ts, avg(p.y) AS y_hat
  FROM t JOIN h p ON p.series_id = t.series_id AND isodow(p.ts) = isodow(t.ts) AND hour(p.ts) = hour(t.ts) AND p.ts < origin GROUP BY ALL)"""
SCALE = """
so AS (
  SELECT a.series_id, k, origin, avg(abs(a.y - b.y)) AS scale
  FROM h a JOIN h b ON a.series_id = b.series_id AND b.ts = a.ts - INTERVAL 168 HOUR JOIN o ON a.ts < origin
  GROUP BY ALL HAVING count(*) >= 24 AND avg(abs(a.y - b.y)) > 0),
sc AS (SELECT series_id, avg(scale) AS scale FROM so GROUP BY series_id)"""
DSCALE = """
dsc AS (
  SELECT series_id, avg(scale) AS scale FROM (
    SELECT a.series_id, k, avg(abs(a.y - b.y)) AS scale FROM d a JOIN d b ON a.series_id = b.series_id AND b.date = a.date - 7 JOIN q ON a.date < origin
    GROUP BY ALL HAVING count(*) >= 28 AND avg(abs(a.y - b.y)) > 0) GROUP BY series_id)"""
_BUCKET = "CASE WHEN lead = 1 THEN '1h' WHEN lead BETWEEN 2 AND 24 THEN 'same_day' WHEN lead BETWEEN 25 AND 72 THEN '2-3d' WHEN lead BETWEEN 73 AND 168 THEN '4-7d' END"
_DBUCKET = "CASE WHEN lead BETWEEN 1 AND 7 THEN '1-7d' WHEN lead BETWEEN 8 AND 14 THEN '8-14d' WHEN lead BETWEEN 15 AND 28 THEN '15-28d' WHEN lead BETWEEN 29 AND 56 THEN '29-56d' WHEN lead BETWEEN 57 AND 112 THEN '57-112d' END"


def _scored(name: str, fc: str) -> str:
    return f"""
{name} AS (
  SELECT f.*, park, regime, y, abs(y - y_hat) AS e, {_BUCKET} AS bucket
  FROM (SELECT *, (date_diff('hour', origin, ts) + 1)::INT AS lead FROM {fc}) f JOIN h USING (series_id, ts))"""


_METRICS = "count(*) AS n, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e / scale), 6) AS mase, round(avg((e <= 5)::INT), 6) AS w5, round(avg((e <= 10)::INT), 6) AS w10"
BOTH = "fc AS (SELECT *, 'snaive' AS method FROM sn UNION ALL SELECT *, 'hourly_avg' FROM ha)"
METHODS = f"{H}, {T}, {SNAIVE}, {AVERAGE}, {SCALE}, {BOTH}, {_scored('s', 'fc')}, x AS (SELECT s.*, scale, e / scale AS ase FROM s JOIN sc USING (series_id))"
WIDE = f"{METHODS}, wide AS (SELECT series_id, origin, ts, bucket, max(ase) FILTER (method = 'snaive') AS snaive, max(ase) FILTER (method = 'hourly_avg') AS hourly_avg FROM x GROUP BY ALL)"
BANDS = f"""{H}, {T}, {SNAIVE}, {SCALE}, {_scored('s', 'sn')},
b AS (SELECT s.*, scale, greatest(y_hat - scale, 0) AS p10, greatest(y_hat, 0) AS p50, greatest(y_hat + scale, 0) AS p90 FROM s JOIN sc USING (series_id))"""
DOW8 = "d8 AS (SELECT series_id, k, isodow(date) AS dow, avg(y) AS m FROM d JOIN q ON date >= origin - 56 AND date < origin GROUP BY ALL)"
DOWALL = "da AS (SELECT series_id, k, isodow(date) AS dow, avg(y) AS m FROM d JOIN q ON date < origin GROUP BY ALL)"
LEVEL = """
own AS (SELECT *, min(date) OVER (PARTITION BY series_id) AS start FROM d WHERE source = 'own'),
coarse AS (SELECT *, max(date) OVER (PARTITION BY series_id) AS final FROM d WHERE source = 'coarse'),
lc AS (SELECT series_id, avg(y) AS c FROM coarse WHERE date >= final - 56 GROUP BY ALL HAVING count(*) >= 14 AND avg(y) > 0),
lo AS (SELECT series_id, k, origin, avg(y) AS m FROM own JOIN q ON date < origin WHERE date < start + 56 GROUP BY ALL HAVING count(*) >= 14),
lr AS (SELECT series_id, k, origin, m / c AS ratio FROM lo JOIN lc USING (series_id))"""
WINDOW = """
wo AS (SELECT d.*, k, origin, min(date) OVER (PARTITION BY k) AS s FROM d JOIN q ON date >= origin - 56 AND date < origin WHERE source = 'own'),
wc AS (SELECT series_id, avg(y) AS c FROM d WHERE source = 'coarse' AND date >= (SELECT max(date) FROM d WHERE source = 'coarse') - 56 GROUP BY ALL),
wr AS (SELECT series_id, k, origin, avg(y) / c AS ratio FROM wo JOIN wc USING (series_id) WHERE date < s + 56 AND c > 0 GROUP BY series_id, k, origin, c HAVING count(*) >= 7)"""
SHAPE = """
mm AS (SELECT series_id, k, origin, month(date) AS month, avg(y) AS m FROM d JOIN q ON date < origin WHERE source = 'coarse' GROUP BY ALL),
mw AS (SELECT mm.*, (SELECT count(*) FROM range(1, 57) r(i) WHERE month(origin - i::INT) = mm.month) / 56.0::DOUBLE AS w FROM mm),
mb AS (SELECT series_id, k, sum(m * w) / nullif(sum(w), 0) AS base FROM mw GROUP BY ALL),
ms AS (SELECT series_id, k, month, m / base AS shape FROM mm JOIN mb USING (series_id, k) WHERE base > 0)"""
RECENT = """
rc AS (
  SELECT series_id, k, arg_max(h.y, ts) AS last_y, max(ts) AS last_ts, avg(y) FILTER (ts >= origin - INTERVAL 1 DAY) AS r24h,
         avg(y) FILTER (ts >= origin - INTERVAL 7 DAY) AS r7d, avg(y) FILTER (ts >= origin - INTERVAL 28 DAY) AS r28d
  FROM h JOIN o ON ts < origin GROUP BY series_id, k)"""
ANNUAL = """
an AS (
  SELECT a.series_id, a.date + 364 AS date, a.y AS lag364,
         (SELECT CASE WHEN count(*) >= 7 THEN avg(b.y) END FROM d b WHERE b.series_id = a.series_id AND b.date BETWEEN a.date - 14 AND a.date + 14) AS ann28
  FROM d a)"""
POOL = f"""{H}, {T}, {AVERAGE}, {_origins(7, "ow")},
tw AS (SELECT series_id, ts, y, origin FROM h JOIN ow ON hour(origin) = 0 AND ts >= origin AND ts < origin + INTERVAL 168 HOUR),
made AS (
  SELECT tw.series_id, origin, tw.ts, any_value(tw.y) AS y, avg(p.y) AS y_hat
  FROM tw JOIN h p ON p.series_id = tw.series_id AND isodow(p.ts) = isodow(tw.ts) AND hour(p.ts) = hour(tw.ts) AND p.ts < origin GROUP BY ALL),
pool AS (SELECT m.series_id, o.origin AS at_, m.ts, m.y, m.y_hat, hour(m.ts)::INT AS hour FROM made m JOIN o ON m.ts >= o.origin - INTERVAL 30 DAY AND m.ts < o.origin AND m.origin < o.origin),
l2 AS (SELECT at_ AS origin, series_id, hour, least(3, greatest(0.3, avg(y) / greatest(avg(y_hat), 1))) AS ratio FROM pool GROUP BY ALL)"""
_HOURS = "(SELECT unnest(range(0, 24))::INT AS hour)"


def _near(table: str, keys: str, where: str = "true") -> str:
    return f"SELECT {keys}, v.hour, arg_min(ratio, abs(x.hour - v.hour) * 100 + x.hour) AS ratio FROM {table} x, {_HOURS} v WHERE {where} GROUP BY {keys}, v.hour"


ORACLE = {
    "hourly_panel": f"WITH {HOURLY} SELECT series_id, park, resort, regime, ts, round(y, 6) AS y, n_obs FROM h",
    "daily_panel": f"{D} SELECT series_id, park, resort, regime, date, round(y, 6) AS y, source FROM d",
    "daily_from_hourly": f"WITH {HOURLY} SELECT series_id, park, resort, regime, ts::DATE AS date, round(avg(y), 6) AS y, 'own' AS source FROM h GROUP BY ALL HAVING count(*) >= 4",
    "series_curation": f"WITH {HOURLY} SELECT series_id, count(*) AS n_hours FROM h GROUP BY series_id HAVING count(DISTINCT ts::DATE) >= 30",
    "rolling_origins": f"{H} SELECT k, origin FROM o",
    "daily_origins": f"{D} SELECT k, origin FROM q",
    "pseudo_origins": f"WITH {HOURLY}, {_origins(7)} SELECT k, origin FROM o",
    "target_grid": f"{H}, {T} SELECT series_id, origin, ts, (date_diff('hour', origin, ts) + 1)::INT AS lead FROM t",
    "daily_target_grid": f"{D}, {DT} SELECT series_id, origin, date, (date - origin + 1)::INT AS lead FROM t",
    "mase_scales": f"{H}, {SCALE} SELECT series_id, origin, round(scale, 6) AS scale FROM so",
    "daily_mase_scales": f"{D}, {DSCALE} SELECT series_id, round(scale, 6) AS scale FROM dsc",
    "snaive_fc": f"{H}, {T}, {SNAIVE} SELECT series_id, origin, ts, round(y_hat, 6) AS y_hat FROM sn",
    "hourly_avg_fc": f"{H}, {T}, {AVERAGE} SELECT series_id, origin, ts, round(y_hat, 6) AS y_hat FROM ha",
    "snaive_scores": f"{H}, {T}, {SNAIVE}, {SCALE}, {_scored('s', 'sn')} SELECT bucket, {_METRICS} FROM s JOIN sc USING (series_id) GROUP BY bucket",
    "snaive7_daily": f"{D}, {DT} SELECT t.series_id, origin, t.date, round(arg_min(p.y, w), 6) AS y_hat FROM t, (SELECT unnest(range(1, 5))::INT AS w) JOIN d p ON p.series_id = t.series_id AND p.date = t.date - 7 * w AND p.date < origin GROUP BY ALL",
    "snaive7_ext": f"{D}, {DT} SELECT t.series_id, origin, t.date, round(arg_min(p.y, e), 6) AS y_hat FROM t, (SELECT unnest(range(0, 5))::INT AS e) JOIN d p ON p.series_id = t.series_id AND p.date = t.date - 7 * (ceil((t.date - origin + 1) / 7.0)::INT + e) AND p.date < origin GROUP BY ALL",
    "dow_mean_8w": f"{D}, {DT}, {DOW8} SELECT t.series_id, origin, date, round(m, 6) AS y_hat FROM t JOIN d8 ON d8.series_id = t.series_id AND d8.k = t.k AND dow = isodow(date)",
    "dow_mean_full": f"{D}, {DT}, {DOWALL} SELECT t.series_id, origin, date, round(m, 6) AS y_hat FROM t JOIN da ON da.series_id = t.series_id AND da.k = t.k AND dow = isodow(date)",
    "snaive364": f"{D}, {DT} SELECT t.series_id, origin, t.date, round(p.y, 6) AS y_hat FROM t JOIN d p ON p.series_id = t.series_id AND p.date = t.date - 364 AND p.date < origin",
    "level_ratio": f"{D}, {LEVEL} SELECT series_id, origin, round(ratio, 6) AS ratio FROM lr",
    "window_ratio": f"{D}, {WINDOW} SELECT series_id, origin, round(ratio, 6) AS ratio FROM wr",
    "snaive364_cal": f"{D}, {DT}, {LEVEL} SELECT t.series_id, t.origin, t.date, round(p.y * ratio, 6) AS y_hat FROM t JOIN d p ON p.series_id = t.series_id AND p.date = t.date - 364 AND p.date < t.origin JOIN lr ON lr.series_id = t.series_id AND lr.k = t.k",
    "month_shape": f"{D}, {SHAPE} SELECT series_id, k, month::INT AS month, round(shape, 6) AS shape FROM ms",
    "dow_shape_annual": f"{D}, {DT}, {DOW8}, {SHAPE} SELECT t.series_id, origin, date, round(d8.m * shape, 6) AS y_hat FROM t JOIN d8 ON d8.series_id = t.series_id AND d8.k = t.k AND dow = isodow(date) JOIN ms ON ms.series_id = t.series_id AND ms.k = t.k AND ms.month = month(date)",
    "shape_layer": f"{D}, {DT}, {DOW8}, {SHAPE} SELECT t.series_id, origin, date, round(d8.m * coalesce(shape, 1), 6) AS y_hat FROM t JOIN d8 ON d8.series_id = t.series_id AND d8.k = t.k AND dow = isodow(date) LEFT JOIN ms ON ms.series_id = t.series_id AND ms.k = t.k AND ms.month = month(date)",
    "seasonal_lags": f"{H}, {T} SELECT series_id, origin, ts, round(a.y, 6) AS lag168, round(b.y, 6) AS lag336, round(c.y, 6) AS lag504, round(e.y, 6) AS lag672, round(list_avg([a.y, b.y, c.y, e.y]), 6) AS sdhr4 FROM t "
    + " ".join(f"LEFT JOIN (SELECT series_id AS s, ts + INTERVAL {n} HOUR AS at_, y FROM h) {x} ON {x}.s = t.series_id AND {x}.at_ = t.ts" for x, n in (("a", 168), ("b", 336), ("c", 504), ("e", 672))),
    "recency_features": f"{H}, {RECENT} SELECT series_id, k, round(last_y, 6) AS last_y, last_ts, round(r24h, 6) AS r24h, round(r7d, 6) AS r7d, round(r28d, 6) AS r28d FROM rc",
    "annual_lookup": f"{D}, {ANNUAL} SELECT series_id, date, round(lag364, 6) AS lag364, round(ann28, 6) AS ann28 FROM an",
    "hourly_samples": f"{H}, {T}, {RECENT} SELECT t.series_id, park, regime, origin, ts, round(t.y, 6) AS y, (date_diff('hour', origin, ts) + 1)::INT AS lead, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS dow, (isodow(ts) >= 6)::INT AS is_weekend, month(ts)::INT AS month, round(a.y, 6) AS lag168, round(b.y, 6) AS lag336, round(c.y, 6) AS lag504, round(e.y, 6) AS lag672, round(list_avg([a.y, b.y, c.y, e.y]), 6) AS sdhr4, round(last_y, 6) AS last_y, round(date_diff('second', last_ts, origin) / 3600.0::DOUBLE, 6) AS hrs_since_last, round(r24h, 6) AS r24h, round(r7d, 6) AS r7d, round(r28d, 6) AS r28d FROM t "
    + " ".join(f"LEFT JOIN (SELECT series_id AS s, ts + INTERVAL {n} HOUR AS at_, y FROM h) {x} ON {x}.s = t.series_id AND {x}.at_ = t.ts" for x, n in (("a", 168), ("b", 336), ("c", 504), ("e", 672)))
    + " LEFT JOIN rc ON rc.series_id = t.series_id AND rc.k = t.k",
    "daily_samples": f"{D}, {DT}, {DOW8}, {ANNUAL}, r AS (SELECT series_id, k, avg(y) FILTER (date >= origin - 7) AS r7, avg(y) AS r28 FROM d JOIN q ON date >= origin - 28 AND date < origin GROUP BY ALL) SELECT t.series_id, park, regime, origin, t.date, round(t.y, 6) AS y, (t.date - origin + 1)::INT AS lead, (isodow(t.date) - 1)::INT AS dow, (isodow(t.date) >= 6)::INT AS is_weekend, month(t.date)::INT AS month, round(r7, 6) AS r7, round(r28, 6) AS r28, round(d8.m, 6) AS dow8w, round(lag364, 6) AS lag364, round(ann28, 6) AS ann28 FROM t LEFT JOIN r ON r.series_id = t.series_id AND r.k = t.k LEFT JOIN d8 ON d8.series_id = t.series_id AND d8.k = t.k AND d8.dow = isodow(t.date) LEFT JOIN an ON an.series_id = t.series_id AND an.date = t.date",
    "ratio_table_l2": f"{POOL} SELECT origin, series_id, hour, round(ratio, 6) AS ratio FROM l2",
    "two_ratio_layers": f"""{POOL}, n2 AS ({_near('l2', 'origin, series_id')}),
p3 AS (SELECT p.series_id, at_, p.hour, p.y, p.y_hat * coalesce(ratio, 1) AS p FROM pool p LEFT JOIN n2 ON n2.origin = at_ AND n2.series_id = p.series_id AND n2.hour = p.hour WHERE ts >= at_ - INTERVAL 5 DAY),
l3 AS (SELECT at_ AS origin, series_id, hour, least(3, greatest(0.3, avg(y) / greatest(avg(p), 1))) AS ratio FROM p3 GROUP BY ALL), n3 AS ({_near('l3', 'origin, series_id')})
SELECT f.series_id, f.origin, f.ts, round(y_hat, 6) AS y_hat, round(y_hat * coalesce(a.ratio, 1), 6) AS l2, round(y_hat * coalesce(a.ratio, 1) * coalesce(b.ratio, 1), 6) AS l2l3
FROM ha f LEFT JOIN n2 a ON a.origin = f.origin AND a.series_id = f.series_id AND a.hour = hour(f.ts) LEFT JOIN n3 b ON b.origin = f.origin AND b.series_id = f.series_id AND b.hour = hour(f.ts)""",
    "pivot_methods": f"{WIDE} SELECT series_id, origin, ts, bucket, round(snaive, 6) AS snaive, round(hourly_avg, 6) AS hourly_avg FROM wide",
    "dm_day_diffs": f"{WIDE} SELECT bucket, origin::DATE AS day, round(avg(round(snaive, 6) - round(hourly_avg, 6)), 6) AS d, count(*) AS n FROM wide WHERE snaive IS NOT NULL AND hourly_avg IS NOT NULL GROUP BY ALL",
    "multi_grain_summary": f"{METHODS} SELECT method, bucket, park, regime, {_METRICS}, (CASE WHEN grouping(bucket) = 0 AND grouping(regime) = 1 THEN 0 WHEN grouping(park) = 0 THEN 1 ELSE 2 END)::INT AS level FROM x GROUP BY GROUPING SETS ((method, bucket), (method, park), (method, regime, bucket))",
    "paired_summary": f"{METHODS}, p AS (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY series_id, origin, ts) = 2) SELECT method, bucket, {_METRICS} FROM p GROUP BY ALL",
    "pinball_coverage": f"{BANDS} SELECT bucket, count(*) AS n, round(avg((y >= p10 AND y <= p90)::INT), 6) AS coverage, round(avg(p90 - p10), 6) AS width, round(avg((p90 - p10) / scale), 6) AS scaled_width, "
    + ", ".join(f"round(avg(greatest({q} * (y - p{n}), ({q} - 1) * (y - p{n})) / scale), 6) AS pinball_{n}" for q, n in (("0.1::DOUBLE", 10), ("0.5::DOUBLE", 50), ("0.9::DOUBLE", 90))) + " FROM b GROUP BY bucket",
    "agreement_corr": f"{H}, {T}, {SNAIVE}, {AVERAGE} SELECT series_id, count(*) AS n, round(corr(sn.y_hat, ha.y_hat), 6) AS corr, round(avg(abs(sn.y_hat - ha.y_hat)), 6) AS mean_abs_diff FROM sn JOIN ha USING (series_id, origin, ts) GROUP BY series_id",
    "monthly_climatology": f"{D}, c AS (SELECT * FROM d WHERE source = 'coarse'), a AS (SELECT series_id, avg(y) AS m FROM c GROUP BY ALL), b AS (SELECT series_id, month(date) AS month, avg(y) AS m FROM c GROUP BY ALL) SELECT a.series_id, v.month::INT AS month, round(coalesce(b.m, a.m), 6) AS mean FROM a CROSS JOIN (SELECT unnest(range(1, 13)) AS month) v LEFT JOIN b ON b.series_id = a.series_id AND b.month = v.month",
    "calendar_weather": "WITH a AS (SELECT o_orderdate::DATE AS date, count(*) AS orders FROM orders GROUP BY ALL), b AS (SELECT ts::DATE AS date, count(*) AS events FROM events GROUP BY ALL) SELECT date, coalesce(orders, 0) AS orders, coalesce(events, 0) AS events FROM a FULL JOIN b USING (date)",
    "status_scan": "SELECT event_type, ts::DATE AS date, hour(ts)::INT AS hour, count(*) AS cnt, round(sum(value), 6) AS total FROM events WHERE event_type IN ('view', 'click') AND value > 0 GROUP BY ALL",
    "hour_pattern": "WITH s AS (SELECT event_type, ts::DATE AS date, hour(ts)::INT AS hour, count(*) AS cnt, round(sum(value), 6) AS total FROM events WHERE event_type IN ('view', 'click') AND value > 0 GROUP BY ALL) SELECT event_type, hour, sum(cnt)::BIGINT AS cnt, round(sum(total) / sum(cnt), 6) AS mean FROM s GROUP BY ALL HAVING sum(cnt) >= 3",
    "stored_forecast_scan": "WITH s AS (SELECT substr(o_orderdate::VARCHAR, 1, 10)::DATE AS made, (o_orderkey % 24)::INT AS hour, o_totalprice FROM orders) SELECT made, made::TIMESTAMP + to_hours(hour) AS target, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM s GROUP BY ALL",
    "label_encoding": "SELECT p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS code, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)",
    "era_overlap": f"{D}, a AS (SELECT DISTINCT series_id FROM d WHERE source = 'own'), b AS (SELECT DISTINCT series_id FROM d WHERE source = 'coarse') SELECT series_id, 'both' AS part FROM a JOIN b USING (series_id) UNION ALL SELECT series_id, 'own only' FROM a WHERE series_id NOT IN (SELECT series_id FROM b) UNION ALL SELECT series_id, 'any' FROM (SELECT series_id FROM a UNION SELECT series_id FROM b)",
    "id_crosswalk": "SELECT DISTINCT n_nationkey::BIGINT AS outer_id, r_name || '.' || n_name AS series_id FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL VALUES (9001, 'MANUAL.ONE'), (9002, 'MANUAL.TWO')",
    "series_metadata": f"WITH {HOURLY}, f AS (SELECT series_id, count(*) AS full_days FROM (SELECT series_id, ts::DATE AS date FROM h GROUP BY ALL HAVING count(*) >= 4) GROUP BY series_id) SELECT series_id, park, resort, regime, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_hours, count(DISTINCT ts::DATE) AS n_days, round(avg(y), 6) AS mean, coalesce(any_value(full_days), 0) AS full_days FROM h LEFT JOIN f USING (series_id) GROUP BY series_id, park, resort, regime",
}
ORACLE["daily_scores"] = f"""{D}, {DT}, {DOW8}, {DOWALL}, {SHAPE}, {DSCALE},
fc AS (
  SELECT t.series_id, origin, t.date, arg_min(p.y, w) AS y_hat, 'snaive7' AS method FROM t, (SELECT unnest(range(1, 5))::INT AS w) JOIN d p ON p.series_id = t.series_id AND p.date = t.date - 7 * w AND p.date < origin GROUP BY ALL
  UNION ALL SELECT t.series_id, origin, t.date, arg_min(p.y, e), 'snaive7_ext' FROM t, (SELECT unnest(range(0, 5))::INT AS e) JOIN d p ON p.series_id = t.series_id AND p.date = t.date - 7 * (ceil((t.date - origin + 1) / 7.0)::INT + e) AND p.date < origin GROUP BY ALL
  UNION ALL SELECT t.series_id, origin, date, m, 'dow_mean_8w' FROM t JOIN d8 ON d8.series_id = t.series_id AND d8.k = t.k AND dow = isodow(date)
  UNION ALL SELECT t.series_id, origin, date, m, 'dow_mean_full' FROM t JOIN da ON da.series_id = t.series_id AND da.k = t.k AND dow = isodow(date)
  UNION ALL SELECT t.series_id, origin, t.date, p.y, 'snaive364' FROM t JOIN d p ON p.series_id = t.series_id AND p.date = t.date - 364 AND p.date < origin
  UNION ALL SELECT t.series_id, origin, date, d8.m * shape, 'dow_shape_annual' FROM t JOIN d8 ON d8.series_id = t.series_id AND d8.k = t.k AND dow = isodow(date) JOIN ms ON ms.series_id = t.series_id AND ms.k = t.k AND ms.month = month(date)),
s AS (SELECT *, abs(y - y_hat) AS e, {_DBUCKET} AS bucket FROM (SELECT fc.*, d.y, (fc.date - origin + 1) AS lead FROM fc JOIN d USING (series_id, date)))
SELECT method, bucket, {_METRICS} FROM s JOIN dsc USING (series_id) WHERE bucket IS NOT NULL GROUP BY ALL"""

_SIZE_BIN = "CASE WHEN size > 50 THEN '>50' WHEN size > 30 THEN '30-50' WHEN size > 20 THEN '20-30' WHEN size > 10 THEN '10-20' WHEN size > 0 THEN '0-10' END"
_PI2 = "6.283185307179586::DOUBLE"
SIZES = f"sz AS (SELECT series_id, {_SIZE_BIN} AS size_bin FROM (SELECT series_id, avg(y) AS size FROM h GROUP BY series_id))"
_BAND_METRICS = "count(*) AS n, round(avg((y >= p10 AND y <= p90)::INT), 6) AS coverage, round(avg(p90 - p10), 6) AS width, round(avg((p90 - p10) / scale), 6) AS scaled_width, " + ", ".join(
    f"round(avg(greatest({q} * (y - p{n}), ({q} - 1) * (y - p{n})) / scale), 6) AS pinball_{n}" for q, n in (("0.1::DOUBLE", 10), ("0.5::DOUBLE", 50), ("0.9::DOUBLE", 90))
)
HOLDOUT = f"""{BANDS}, {SIZES},
days AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT origin::DATE AS day FROM b)),
f AS (SELECT round(1 + 0.05 * i, 2)::DOUBLE AS factor FROM range(0, 13) r(i)),
c AS (SELECT factor, avg((y >= greatest(0, p50 - factor * (p50 - p10)) AND y <= p50 + factor * (p90 - p50))::INT) AS coverage FROM b JOIN days ON day = origin::DATE AND i <= floor(n / 2), f GROUP BY factor),
ch AS (SELECT min(factor) FILTER (coverage >= 0.8) AS factor FROM c),
z AS (
  SELECT b.*, day, size_bin, factor, (y >= p10 AND y <= p90)::INT AS raw, (y >= greatest(0, p50 - factor * (p50 - p10)) AND y <= p50 + factor * (p90 - p50))::INT AS wide
  FROM b JOIN days ON day = origin::DATE AND i > floor(n / 2) JOIN sz USING (series_id), ch)"""
WINDOWS = f"""
wd(win, n) AS (VALUES ('k02', 2), ('k04', 4), ('k08', 8), ('k16', 16), ('full', NULL)),
hw AS (SELECT win, n, k, origin AS at_, series_id, park, regime, date, y FROM d JOIN q ON date < origin JOIN wd ON n IS NULL OR date >= origin - 7 * n WHERE source = 'own'),
st AS (SELECT win, k, at_, min(date) AS start FROM hw GROUP BY ALL),
cl AS (SELECT series_id, avg(y) AS c FROM d WHERE source = 'coarse' AND date >= (SELECT max(date) FROM d WHERE source = 'coarse') - 56 GROUP BY ALL),
rs AS (
  SELECT win, k, at_ AS origin, series_id, avg(y) / any_value(c) AS ratio, any_value(CASE WHEN n IS NULL THEN at_ - start ELSE least(at_ - start, 7 * n) END)::INT AS days_seen
  FROM hw JOIN st USING (win, k, at_) JOIN cl USING (series_id) WHERE date < start + 56 AND c > 0 GROUP BY win, k, at_, series_id HAVING count(*) >= 7)"""
_QUARTILES = "count({0}) AS n, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.75), 6) AS p75"


def _calendar(date: str) -> str:
    cyc = lambda name, value, period: f"round(sin(({value}) * ({_PI2} / {period})), 6) AS {name}_sin, round(cos(({value}) * ({_PI2} / {period})), 6) AS {name}_cos"
    md = f"(month({date}) * 100 + day({date}))"
    return ", ".join((
        f"dayofyear({date})::INT AS doy, (isodow({date}) - 1)::INT AS dow, month({date})::INT AS month, (isodow({date}) >= 6)::INT AS is_weekend",
        cyc("doy", f"dayofyear({date})", 365), cyc("dow", f"isodow({date}) - 1", 7), cyc("month", f"month({date})", 12),
        # 10 March to 15 April, June to 15 August, 20 December to 5 January
        f"(CASE WHEN (month({date}) = 3 AND day({date}) >= 10) OR (month({date}) = 4 AND day({date}) <= 15) THEN 0.9 ELSE 0.2 END)::DOUBLE AS spring_break",
        f"(CASE WHEN month({date}) IN (6, 7) OR (month({date}) = 8 AND day({date}) <= 15) THEN 0.9 ELSE 0.1 END)::DOUBLE AS summer_break",
        f"(CASE WHEN {md} >= 1220 OR {md} <= 105 THEN 0.9 ELSE 0.1 END)::DOUBLE AS winter_break",
    ))


_HOUR = f"round(sin(hour * ({_PI2} / 24)), 6) AS hour_sin, round(cos(hour * ({_PI2} / 24)), 6) AS hour_cos, (hour BETWEEN 10 AND 14)::INT AS is_peak, (hour >= 17)::INT AS is_evening, (hour <= 10)::INT AS is_morning"
_WEATHER = "wt AS (SELECT l_shipdate::DATE AS date, avg(l_quantity) + 60 AS temp_max, avg(l_quantity) + 40 AS temp_min, avg(l_discount) * 1000 AS humidity, avg(l_tax) * 1000 AS rain FROM lineitem GROUP BY ALL)"
_MONTHS = """
m0 AS (SELECT k, v.month::INT AS month, coalesce(avg(temp_max), 80) AS temp_max, coalesce(avg(temp_min), 65) AS temp_min, coalesce(avg(humidity), 70) AS humidity, coalesce(avg(rain), 20) AS rain
  FROM {0} CROSS JOIN (SELECT unnest(range(1, 13)) AS month) v LEFT JOIN wt ON month(wt.date) = v.month AND wt.date < {0}.origin GROUP BY k, v.month),
mo AS (SELECT *, (temp_max > 85)::INT AS is_hot, (rain > 30)::INT AS is_rainy FROM m0)"""
_MONTH_ROWS = "round(temp_max, 6) AS temp_max, round(temp_min, 6) AS temp_min, round(humidity, 6) AS humidity, round(rain, 6) AS rain, is_hot, is_rainy"
LAYERS = f"""WITH {HOURLY},
g AS (SELECT w AS k, d0 + w * 7 AS origin FROM (SELECT min(ts)::DATE + 14 AS d0, max(ts)::DATE - 7 AS d1 FROM h), (SELECT unnest(range(0, 100))::INT AS w) WHERE d0 + w * 7 <= d1),
rd AS (SELECT event_type AS series_id, ts::DATE AS date, hour(ts)::INT AS hour, count(*) AS cnt, sum(value) AS total FROM events WHERE value > 0 GROUP BY ALL),
ed AS (SELECT event_type AS series_id, park, ts::DATE AS date, avg(value) AS avg FROM events JOIN {_EVENT_SERIES} r(s, park, resort, regime) ON s = event_type WHERE value > 0 GROUP BY ALL),
hp AS (SELECT k, series_id, hour, sum(total) / sum(cnt) AS hour_mean FROM rd JOIN g ON date < origin GROUP BY ALL HAVING sum(cnt) >= 3),
sp AS (SELECT k, series_id, sum(total) / sum(cnt) AS series_mean FROM rd JOIN g ON date < origin GROUP BY ALL),
{_WEATHER}, {_MONTHS.format("g")},
scd AS (SELECT k, series_id, (row_number() OVER (PARTITION BY k ORDER BY series_id) - 1)::INT AS series_code FROM (SELECT DISTINCT k, series_id FROM ed JOIN g ON date < origin)),
pcd AS (SELECT k, park, (row_number() OVER (PARTITION BY k ORDER BY park) - 1)::INT AS park_code FROM (SELECT DISTINCT k, park FROM ed JOIN g ON date < origin))"""
_L1 = f"{_calendar('date')}, hour, {_HOUR}, {_MONTH_ROWS}, coalesce(series_code, 0) AS series_code, coalesce(park_code, 0) AS park_code"
STACK = f"""{LAYERS},
l1 AS (SELECT k, series_id, ts, least(300, greatest(5, coalesce(hour_mean, 30))) AS l1, hour(ts)::INT AS hour FROM h JOIN g ON ts >= origin AND ts < origin + 112 JOIN scd USING (k, series_id) LEFT JOIN hp ON hp.k = g.k AND hp.series_id = h.series_id AND hp.hour = hour(ts)),
past AS (SELECT g.k, rd.series_id, date, rd.hour, least(300, greatest(5, coalesce(hour_mean, 30))) AS l1 FROM rd JOIN g ON date >= origin - 30 AND date < origin JOIN scd ON scd.k = g.k AND scd.series_id = rd.series_id LEFT JOIN hp ON hp.k = g.k AND hp.series_id = rd.series_id AND hp.hour = rd.hour),
a2 AS (SELECT k, series_id, hour, sum(total) / sum(cnt) AS actual FROM rd JOIN g ON date < origin GROUP BY ALL),
e2 AS (SELECT k, series_id, hour, avg(l1) AS expected FROM past GROUP BY ALL),
r2 AS (SELECT k, series_id, hour, least(3, greatest(0.3, actual / greatest(expected, 5))) AS ratio FROM a2 JOIN e2 USING (k, series_id, hour)),
n2 AS ({_near("r2", "k, series_id")}),
a3 AS (SELECT k, series_id, hour, sum(total) / sum(cnt) AS actual FROM rd JOIN g ON date >= origin - 5 AND date < origin GROUP BY ALL),
e3 AS (SELECT k, series_id, hour, avg(l1) AS l1 FROM past JOIN g USING (k) WHERE date >= origin - 5 GROUP BY ALL),
r3 AS (SELECT k, series_id, hour, least(3, greatest(0.3, actual / (l1 * coalesce(ratio, 1)))) AS ratio FROM a3 JOIN e3 USING (k, series_id, hour) LEFT JOIN n2 USING (k, series_id, hour) WHERE l1 >= 5 AND l1 * coalesce(ratio, 1) >= 5),
n3 AS ({_near("r3", "k, series_id")}),
lay AS (
  SELECT l1.k, l1.series_id, ts, l1, coalesce(n2.ratio, 1) AS l2, coalesce(n3.ratio, 1) AS l3, least(300, greatest(5, l1 * coalesce(n2.ratio, 1) * coalesce(n3.ratio, 1))) AS y_hat
  FROM l1 LEFT JOIN n2 USING (k, series_id, hour) LEFT JOIN n3 USING (k, series_id, hour))"""
ASKED = f"""{STACK},
ask AS (SELECT series_id, regime, ts, y, days, ts - to_days(days) AS cutoff FROM h, (VALUES (1), (3), (6)) v(days)),
sa AS (SELECT ask.series_id, ask.ts, days, max(origin)::TIMESTAMP AS made, arg_max(lay.y_hat, origin) AS deployed, arg_max(lay.l1, origin) AS first_layer
  FROM ask JOIN lay ON lay.series_id = ask.series_id AND lay.ts = ask.ts JOIN g ON g.k = lay.k AND origin::TIMESTAMP <= cutoff GROUP BY ALL)"""
AS_OF = f"""{ASKED}, {ORIGINS}, {T}, {AVERAGE},
sb AS (SELECT ask.series_id, ask.ts, days, arg_max(ha.y_hat, origin) AS average FROM ask JOIN ha ON ha.series_id = ask.series_id AND ha.ts = ask.ts AND origin <= cutoff GROUP BY ALL),
ab AS (SELECT days, y, deployed, first_layer, average FROM ask JOIN sa USING (series_id, ts, days) JOIN sb USING (series_id, ts, days))"""
GRAINS = f"""{D}, {LEVEL},
p_fine AS (SELECT * FROM d WHERE source = 'own'), p_splice AS (SELECT * FROM d),
p_splice_cal AS (SELECT d.* EXCLUDE (y), CASE WHEN source = 'coarse' THEN y * ratio ELSE y END AS y FROM d LEFT JOIN (SELECT series_id, ratio FROM lr WHERE k = 0) r USING (series_id) WHERE source = 'own' OR ratio IS NOT NULL)"""
_CONDITIONS = ("fine", "splice", "splice_cal")


def _backward(name: str, panel: str, only_past: bool = False) -> str:
    return f"""{name} AS (SELECT i::INT AS k, (q0 + (7 * i - 7 * steps)::INT)::DATE AS origin FROM (SELECT min(origin) AS q0, count(*) AS nq FROM q), (SELECT greatest(0, ((SELECT min(origin) FROM q) - (min(date) + 28)) // 7) AS steps FROM {panel}), (SELECT unnest(range(0, 2000))::INT AS i) WHERE i < steps{"" if only_past else " + nq"})"""


def _daily_samples(n: str, panel: str, origins: str) -> str:
    """Common table expression n: the daily samples of a panel at origins."""
    return f"""
{n}_8 AS (SELECT series_id, k, isodow(date) AS dow, avg(y) AS m FROM {panel} JOIN {origins} ON date >= origin - 56 AND date < origin GROUP BY ALL),
{n}_r AS (SELECT series_id, k, avg(y) FILTER (date >= origin - 7) AS r7, avg(y) AS r28 FROM {panel} JOIN {origins} ON date >= origin - 28 AND date < origin GROUP BY ALL),
{n}_a AS (SELECT a.series_id, a.date + 364 AS date, any_value(a.y) AS lag364, CASE WHEN count(*) >= 7 THEN avg(b.y) END AS ann28 FROM {panel} a JOIN {panel} b ON b.series_id = a.series_id AND b.date BETWEEN a.date - 14 AND a.date + 14 GROUP BY a.series_id, a.date),
{n} AS (
  SELECT t.series_id, park, regime, origin, t.date, t.y, (t.date - origin + 1)::INT AS lead, (isodow(t.date) - 1)::INT AS dow, (isodow(t.date) >= 6)::INT AS is_weekend, month(t.date)::INT AS month, r7, r28, m AS dow8w, lag364, ann28
  FROM (SELECT p.*, k, origin FROM {panel} p JOIN {origins} ON date >= origin AND date < origin + 112) t
  LEFT JOIN {n}_r r ON r.series_id = t.series_id AND r.k = t.k LEFT JOIN {n}_8 e ON e.series_id = t.series_id AND e.k = t.k AND e.dow = isodow(t.date) LEFT JOIN {n}_a a ON a.series_id = t.series_id AND a.date = t.date)"""


_DAILY_COLUMNS = "series_id, park, regime, origin, date, round(y, 6) AS y, lead, dow, is_weekend, month, round(r7, 6) AS r7, round(r28, 6) AS r28, round(dow8w, 6) AS dow8w, round(lag364, 6) AS lag364, round(ann28, 6) AS ann28"
_COARSE_ANNUAL = "can AS (SELECT a.series_id, a.date + 364 AS date, any_value(a.y) AS lag364, CASE WHEN count(*) >= 7 THEN avg(b.y) END AS ann28 FROM d a JOIN d b ON b.series_id = a.series_id AND b.source = 'coarse' AND b.date BETWEEN a.date - 14 AND a.date + 14 WHERE a.source = 'coarse' GROUP BY a.series_id, a.date)"
_COVARIATES = f"""{_WEATHER},
cc AS (SELECT o_orderdate::DATE AS date, count(*)::DOUBLE AS event_score, max(o_totalprice) AS peak_week_score FROM orders GROUP BY ALL),
cv AS (SELECT date, spring_break AS spring_break_score, summer_break AS summer_break_score, winter_break AS winter_break_score, event_score, peak_week_score, temp_max, temp_min, humidity, rain
  FROM (SELECT date, event_score, peak_week_score, {_calendar('date')} FROM cc) FULL JOIN wt USING (date))"""
_COVARIATE_NAMES = ("spring_break_score", "summer_break_score", "winter_break_score", "event_score", "peak_week_score", "temp_max", "temp_min", "humidity", "rain")


def _mcb() -> str:
    from foretable.operators.inference import range_quantile

    cd = f"{range_quantile(2)!r}::DOUBLE / sqrt(2) * sqrt(2 * 3 / 6.0::DOUBLE) / sqrt(blocks)"
    return f"SELECT *, round({cd}, 6) AS cd, mean_rank <= min(mean_rank) OVER (PARTITION BY bucket) + {cd} AS in_best_set FROM ({ORACLE['mean_ranks']})"


DAILY_WIDE = ORACLE["daily_scores"].replace("SELECT method, bucket, " + _METRICS + " FROM s JOIN dsc USING (series_id) WHERE bucket IS NOT NULL GROUP BY ALL", "").rstrip() + """,
dw AS (SELECT series_id, origin, date, bucket, max(e / scale) FILTER (method = 'snaive7_ext') AS a, max(e / scale) FILTER (method = 'dow_mean_8w') AS b FROM s JOIN dsc USING (series_id) WHERE bucket IS NOT NULL AND method IN ('snaive7_ext', 'dow_mean_8w') GROUP BY ALL),
dd AS (SELECT bucket, origin AS day, avg(a - b) AS d FROM dw WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)"""


def _drawn(days: str, by: str, blocks: str = "1") -> str:
    """Intervals by blocks of days(by, day, d), draws as in inference.block_bootstrap."""
    names = [c.strip() for c in by.split(",")]
    key = ", ".join(f"g.{c}" for c in names)
    return f"""bi AS (SELECT {by}, d, row_number() OVER (PARTITION BY {by} ORDER BY day) - 1 AS i FROM {days}),
g AS (SELECT {by}, count(*) AS days, avg(d) AS mean_diff FROM {days} GROUP BY ALL),
dr AS (SELECT {key}, g.days, mean_diff, block, draw, q, off, ('0x' || substr(md5(concat_ws('|', '0', {key}, block, draw, q)), 1, 15))::BIGINT % (g.days - size + 1) + off AS i
  FROM (SELECT g.*, block, least(block, g.days) AS size, draw, j // least(block, g.days) AS q, j % least(block, g.days) AS off
    FROM g, (SELECT unnest([{blocks}]) AS block), (SELECT unnest(range(0, 10000)) AS draw), LATERAL (SELECT unnest(range(0, g.days)) AS j)) g),
dm AS (SELECT {", ".join(f"dr.{c}" for c in names)}, block, days, mean_diff, draw, avg(d) AS m FROM dr JOIN bi ON dr.i = bi.i AND {" AND ".join(f"dr.{c} = bi.{c}" for c in names)} GROUP BY ALL),
ci AS (SELECT {by}, block, days, round(mean_diff, 6) AS mean_diff, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high,
  round(least(1.0, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))), 6) AS p_sign FROM dm GROUP BY {by}, block, days, dm.mean_diff)"""


ORACLE |= {
    "bootstrap_ci": f"{DAILY_WIDE}, {_drawn('dd', 'bucket')} SELECT bucket, days, mean_diff, low, high, p_sign FROM ci",
    "block_bootstrap": f"{DAILY_WIDE}, {_drawn('dd', 'bucket', '1, 2, 3, 4')} SELECT * FROM ci",
    "bootstrap_methods": f"""{DAILY_WIDE}, ml AS (SELECT 'snaive7_ext' AS method, bucket, origin AS day, avg(a) AS d FROM dw WHERE a IS NOT NULL GROUP BY ALL UNION ALL SELECT 'dow_mean_8w', bucket, origin, avg(b) FROM dw WHERE b IS NOT NULL GROUP BY ALL),
{_drawn('ml', 'method, bucket')} SELECT method, bucket, days, mean_diff, low, high, p_sign FROM ci""",
    # p by the finite sums in the angle that whole degrees of freedom have, not by the beta function
    "dm_test": f"""{DAILY_WIDE},
e1 AS (SELECT bucket, day, d, d - avg(d) OVER (PARTITION BY bucket) AS e, row_number() OVER (PARTITION BY bucket ORDER BY day) AS i FROM dd),
n1 AS (SELECT bucket, count(*) AS t, avg(d) AS m, least(4, count(*) - 2) AS used FROM e1 GROUP BY bucket),
v AS (SELECT bucket, t, m, used, (SELECT sum(e * e) FROM e1 WHERE e1.bucket = n1.bucket) / t + coalesce((SELECT sum(2 * (1 - (x.i - y.i) / (used + 1)) * x.e * y.e) FROM e1 x JOIN e1 y ON x.bucket = y.bucket AND x.i - y.i BETWEEN 1 AND 4 WHERE x.bucket = n1.bucket AND x.i - y.i <= used), 0) / t AS lrv FROM n1),
st AS (SELECT bucket, t, m, CASE WHEN t >= 5 AND lrv > 0 THEN m / sqrt(lrv / t) * sqrt((t + 1 - 2 * (used + 1) + (used + 1) * used / t) / t) END AS stat, atan(abs(stat) / sqrt(t - 1)) AS th, (t - 1)::INT AS df FROM v),
pt AS (SELECT *, CASE WHEN df % 2 = 1
  THEN 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (df - 1) // 2), lambda j: exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) * cos(th) ** (2 * j + 1))))
  ELSE sin(th) * list_sum(list_transform(range(0, df // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * cos(th) ** (2 * j))) END AS within FROM st)
SELECT bucket, t AS days, round(m, 6) AS mean_diff, round(stat, 6) AS stat, round(1 - within, 6) AS p FROM pt""",
    "regular_grid": f"{H}, s AS (SELECT series_id, origin, min(ts) AS s FROM h JOIN o ON ts < origin GROUP BY ALL), g AS (SELECT series_id, origin, unnest(generate_series(s, origin - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM s WHERE date_diff('hour', s, origin) >= 336) SELECT g.series_id, g.origin, g.ts, round(coalesce(y, 0), 6) AS y FROM g LEFT JOIN h USING (series_id, ts)",
    "truncated_context": f"{H} SELECT series_id, origin, ts, round(y, 6) AS y FROM h JOIN o ON ts >= origin - INTERVAL 28 DAY AND ts < origin QUALIFY row_number() OVER (PARTITION BY series_id, origin ORDER BY ts DESC) <= 100",
    "history_windows": f"{D} SELECT series_id, origin, weeks, date, round(y, 6) AS y FROM d, q, (VALUES (2), (4), (8)) v(weeks) WHERE source = 'own' AND date >= origin - 7 * weeks AND date < origin",
    "splice_cal": f"{GRAINS} SELECT series_id, park, resort, regime, date, round(y, 6) AS y, source FROM p_splice_cal",
    "every_hour_ratio": f"{POOL} SELECT origin, series_id, hour, round(ratio, 6) AS ratio FROM ({_near('l2', 'origin, series_id')})",
    "mean_ranks": f"""{WIDE}, b0 AS (SELECT series_id, origin, bucket, avg(snaive) AS snaive, avg(hourly_avg) AS hourly_avg FROM wide GROUP BY ALL), b AS (SELECT * FROM b0 WHERE snaive IS NOT NULL AND hourly_avg IS NOT NULL),
l AS (SELECT series_id, origin, bucket, 'snaive' AS method, snaive AS loss FROM b UNION ALL SELECT series_id, origin, bucket, 'hourly_avg', hourly_avg FROM b),
r AS (SELECT *, rank() OVER (PARTITION BY series_id, origin, bucket ORDER BY loss) + (count(*) OVER (PARTITION BY series_id, origin, bucket, loss) - 1) / 2.0::DOUBLE AS rk FROM l)
SELECT bucket, method, round(avg(rk), 6) AS mean_rank, count(*) AS blocks FROM r GROUP BY ALL""",
    "size_bins": f"WITH {HOURLY} SELECT {_SIZE_BIN} AS bin, count(*) AS n, round(avg(size), 6) AS mean FROM (SELECT series_id, avg(y) AS size FROM h GROUP BY series_id) GROUP BY bin",
    "quantile_by_regime": f"{BANDS} SELECT regime, bucket, {_BAND_METRICS} FROM b GROUP BY ALL",
    "quantile_by_size": f"{BANDS}, {SIZES} SELECT size_bin, {_BAND_METRICS} FROM b JOIN sz USING (series_id) GROUP BY ALL",
    "interval_widening": f"{HOLDOUT} SELECT regime, bucket, size_bin, count(*) AS n, round(avg(raw), 6) AS raw, round(avg(wide), 6) AS widened, max(factor) AS factor FROM z GROUP BY GROUPING SETS ((), (regime), (bucket), (size_bin)) HAVING count(*) > 0",
    "holdout_day_spread": f"{HOLDOUT} SELECT count(*) AS days, round(min(c), 6) AS least, round(median(c), 6) AS middle, round(max(c), 6) AS most FROM (SELECT day, avg(wide) AS c FROM z GROUP BY day)",
    "coverage_table": f"{BANDS}, {SIZES} SELECT bucket, size_bin, count(*) AS n, round(avg((y >= p10 AND y <= p90)::INT), 6) AS raw, round(avg((y >= greatest(0, p50 - 1.2::DOUBLE * (p50 - p10)) AND y <= p50 + 1.2::DOUBLE * (p90 - p50))::INT), 6) AS widened FROM b JOIN sz USING (series_id) GROUP BY GROUPING SETS ((bucket), (size_bin))",
    "delta_table": f"{METHODS}, a AS (SELECT method, bucket, count(*) AS n, avg(e / scale) AS mase FROM x WHERE regime = 'A' GROUP BY ALL) SELECT a.method, a.bucket, a.n, round(a.mase, 6) AS mase, round(a.mase - b.mase, 6) AS delta FROM a LEFT JOIN a b ON b.bucket = a.bucket AND b.method = 'snaive'",
    "report_table": f"{H}, {T}, {SNAIVE}, {SCALE}, {_scored('s', 'sn')} SELECT bucket, count(*) AS n, round_even(avg(e), 3) AS mae, round_even(sqrt(avg(e * e)), 3) AS rmse, round_even(avg(e / scale), 3) AS mase, round_even(avg((e <= 5)::INT), 3) AS w5, round_even(avg((e <= 10)::INT), 3) AS w10 FROM s JOIN sc USING (series_id) GROUP BY bucket",
    "window_ratios": f'{D}, {WINDOWS} SELECT win AS "window", series_id, k, origin, round(ratio, 6) AS ratio, days_seen FROM rs',
    "ratio_stability": f"""{D}, {WINDOWS}, x AS (SELECT a.win, abs(ln(a.ratio) - ln(b.ratio)) AS off FROM rs a JOIN rs b USING (series_id, origin) WHERE b.win = 'full' AND a.win <> 'full')
SELECT win AS "window", count(off) AS n, round(quantile_cont(off, 0.5), 6) AS p50, round(quantile_cont(off, 0.75), 6) AS p75, round(quantile_cont(off, 0.9), 6) AS p90, round(avg((off <= ln(1.1::DOUBLE))::INT), 6) AS within_10, round(avg((off <= ln(1.2::DOUBLE))::INT), 6) AS within_20 FROM x GROUP BY win""",
    "ratio_variation": f"{D}, {WINDOWS}, v AS (SELECT win, series_id, stddev_samp(ratio) / avg(ratio) AS cv FROM rs GROUP BY ALL HAVING count(ratio) >= 5) SELECT win AS \"window\", {_QUARTILES.format('cv')} FROM v GROUP BY win",
    "ratio_distribution": f"{D}, {WINDOWS} SELECT win AS \"window\", {_QUARTILES.format('ratio')}, median(days_seen) AS days_seen FROM rs GROUP BY win",
    "calendar_features": f"{D} SELECT DISTINCT date, {_calendar('date')} FROM d",
    "hour_features": f"{D} SELECT series_id, date, hour, {_HOUR} FROM d, (SELECT unnest(range(8, 23))::INT AS hour) WHERE source = 'own'",
    "hour_patterns": f"{LAYERS} SELECT k, series_id, hour, round(hour_mean, 6) AS hour_mean, round(series_mean, 6) AS series_mean FROM hp JOIN sp USING (k, series_id)",
    "month_weather": f"{D}, {_WEATHER}, {_MONTHS.format('q')} SELECT k, month, {_MONTH_ROWS} FROM mo",
    "l1_training_frame": f"""{LAYERS},
tr AS (
  SELECT k, series_id, park, date, avg, hour, hour_mean, CASE WHEN has THEN coalesce(series_mean, 30) ELSE avg END AS mean
  FROM (SELECT k, ed.* FROM ed JOIN g ON date < origin) CROSS JOIN (SELECT unnest(range(8, 23))::INT AS hour) LEFT JOIN hp USING (k, series_id, hour) LEFT JOIN sp USING (k, series_id) LEFT JOIN (SELECT DISTINCT k, series_id, true AS has FROM hp) USING (k, series_id))
SELECT tr.k, tr.series_id, tr.park, tr.date, {_L1.replace("dayofyear(date)", "dayofyear(tr.date)")}, round(coalesce(hour_mean, mean), 6) AS baseline, round(avg * CASE WHEN hour_mean IS NOT NULL AND mean > 0 THEN hour_mean / mean ELSE 1 END, 6) AS target
FROM tr JOIN mo m ON m.k = tr.k AND m.month = month(tr.date) LEFT JOIN scd ON scd.k = tr.k AND scd.series_id = tr.series_id LEFT JOIN pcd ON pcd.k = tr.k AND pcd.park = tr.park""",
    "l1_goal_frame": f"""{LAYERS},
gl AS (SELECT k, h.series_id, park, ts, ts::DATE AS date, hour(ts)::INT AS hour FROM h JOIN g ON ts >= origin AND ts < origin + 112)
SELECT gl.k, gl.series_id, ts, {_L1.replace(", hour, ", ", gl.hour, ", 1).replace("(hour ", "(gl.hour ")}, round(coalesce(hour_mean, 30), 6) AS baseline
FROM gl JOIN mo m ON m.k = gl.k AND m.month = month(gl.date) JOIN scd ON scd.k = gl.k AND scd.series_id = gl.series_id LEFT JOIN pcd ON pcd.k = gl.k AND pcd.park = gl.park LEFT JOIN hp ON hp.k = gl.k AND hp.series_id = gl.series_id AND hp.hour = gl.hour""",
    "stored_as_of": f"{ASKED} SELECT series_id, regime, ts, round(y, 6) AS y, days, cutoff, made, round(deployed, 6) AS deployed, round(first_layer, 6) AS first_layer FROM ask LEFT JOIN sa USING (series_id, ts, days)",
    "same_target_accuracy": f"""{AS_OF}
SELECT days, method, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg((abs(e) <= 5)::INT), 6) AS w5, round(avg((abs(e) <= 10)::INT), 6) AS w10, round(avg(e), 6) AS bias
FROM (SELECT days, 'deployed' AS method, deployed - y AS e FROM ab UNION ALL SELECT days, 'first_layer', first_layer - y FROM ab UNION ALL SELECT days, 'average', average - y FROM ab) GROUP BY days, method""",
    "same_target_agreement": f"{AS_OF} SELECT days, count(*) AS n, round(corr(deployed, average), 6) AS corr, round(avg(abs(deployed - average)), 6) AS mean_abs_diff, round(avg(deployed), 6) AS mean_a, round(avg(average), 6) AS mean_b FROM ab GROUP BY days",
    "frozen_daily_scores": f"""{STACK}, f AS (SELECT series_id, origin::DATE AS origin, ts::DATE AS date, avg(y_hat) AS y_hat FROM lay JOIN g USING (k) WHERE k = 0 GROUP BY ALL),
dy AS (SELECT series_id, regime, ts::DATE AS date, avg(y) AS y FROM h GROUP BY ALL HAVING count(*) >= 4),
s AS (SELECT regime, date - origin + 1 AS lead, {_DBUCKET} AS bucket, y - y_hat AS e FROM f JOIN dy USING (series_id, date))
SELECT regime, bucket, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM s WHERE bucket IS NOT NULL GROUP BY ALL""",
    "production_layers": f"{STACK} SELECT k, series_id, ts, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3, round(y_hat, 6) AS y_hat FROM lay",
    "production_daily": f"{STACK} SELECT k, series_id, ts::DATE AS date, round(avg(l1), 6) AS l1, round(avg(y_hat), 6) AS y_hat FROM lay GROUP BY ALL",
    "dm_statistics": f"""{DAILY_WIDE},
e1 AS (SELECT bucket, day, d, d - avg(d) OVER (PARTITION BY bucket) AS e FROM dd),
e2 AS (SELECT *, lag(e) OVER (PARTITION BY bucket ORDER BY day) AS before FROM e1),
v AS (SELECT bucket, count(*) AS t, avg(d) AS m, (sum(e * e) + sum(e * before)) / count(*) AS lrv FROM e2 GROUP BY bucket)
SELECT bucket, t AS days, round(m, 6) AS mean_diff, CASE WHEN t >= 5 AND lrv > 0 THEN round(m / sqrt(lrv / t) * sqrt((t - 3 + 2.0::DOUBLE / t) / t), 6) END AS stat FROM v""",
    "backward_origins": f"{GRAINS}, " + ", ".join(_backward(f"b_{c}", f"p_{c}") for c in _CONDITIONS) + " " + " UNION ALL ".join(f"SELECT '{c}' AS condition, k, origin FROM b_{c}" for c in _CONDITIONS),
    "some_origins": f"{D} SELECT 'first' AS part, origin FROM q WHERE k < 2 UNION ALL SELECT 'last', origin FROM q WHERE k >= (SELECT max(k) - 1 FROM q)",
    "grain_samples": f"{GRAINS}, " + ", ".join(f"{_backward(f'b_{c}', f'p_{c}')}, {_daily_samples(f's_{c}', f'p_{c}', f'b_{c}')}" for c in _CONDITIONS) + " " + " UNION ALL ".join(f"SELECT {_DAILY_COLUMNS}, '{c}' AS condition FROM s_{c}" for c in _CONDITIONS),
    "train_masks": f"""WITH {HOURLY}, {ORIGINS}, {_origins(7, "po")}, {DAILY},
ht AS (SELECT origin FROM h JOIN po ON ts >= origin AND ts < origin + INTERVAL 168 HOUR), dt AS (SELECT origin, date FROM d JOIN q ON date >= origin AND date < origin + 112)
SELECT 'hourly' AS kind, day, count(*) FILTER (origin + INTERVAL 7 DAY <= day) AS train, count(*) FILTER (origin::DATE = day) AS goal FROM ht, (SELECT DISTINCT origin::DATE AS day FROM o) GROUP BY day
UNION ALL SELECT 'daily', day, count(*) FILTER (date < day), count(*) FILTER (origin = day) FROM dt, (SELECT origin AS day FROM q) GROUP BY day""",
    "curve_samples": f"""{D}, {WINDOWS}, {_COARSE_ANNUAL},
ask AS (SELECT win, k, at_, at_ - 7 * b AS origin, 'train' AS part FROM st, (SELECT unnest(range(1, 400))::INT AS b) WHERE at_ - 7 * b >= start + 7 UNION ALL SELECT win, k, at_, at_, 'goal' FROM st),
pl AS (SELECT hw.*, ask.origin, part FROM hw JOIN ask USING (win, k)),
rec AS (SELECT win, k, part, origin, series_id, avg(y) FILTER (date >= origin - 7) AS r7, avg(y) FILTER (date >= origin - 28) AS r28 FROM pl WHERE date < origin AND date >= origin - 56 GROUP BY ALL),
bd AS (SELECT win, k, part, origin, series_id, (isodow(date) - 1)::INT AS dow, avg(y) AS dow8w FROM pl WHERE date < origin AND date >= origin - 56 GROUP BY ALL),
rw AS (SELECT win, k, part, series_id, park, regime, origin, date, y FROM pl WHERE part = 'train' AND date >= origin AND date < origin + 112 AND date < at_
  UNION ALL SELECT win, k, 'goal', series_id, park, regime, origin, date, y FROM d JOIN q ON date >= origin AND date < origin + 112 JOIN st USING (k) WHERE source = 'own'),
rx AS (SELECT *, (isodow(date) - 1)::INT AS dow FROM rw)
SELECT win AS "window", k, part, series_id, park, regime, rx.origin, date, round(y, 6) AS y, (date - rx.origin + 1)::INT AS lead, dow, (dow >= 5)::INT AS is_weekend, month(date)::INT AS month, round(r7, 6) AS r7, round(r28, 6) AS r28, round(dow8w, 6) AS dow8w, round(lag364 * ratio, 6) AS lag364, round(ann28 * ratio, 6) AS ann28
FROM rx LEFT JOIN rec USING (win, k, part, origin, series_id) LEFT JOIN bd USING (win, k, part, origin, series_id, dow) LEFT JOIN can USING (series_id, date) LEFT JOIN (SELECT win, k, series_id, ratio FROM rs) r USING (win, k, series_id)""",
    "scaled_coarse_samples": f"""{D}, {WINDOWS}, p_coarse AS (SELECT * FROM d WHERE source = 'coarse'), {_backward("b_coarse", "p_coarse", only_past=True)}, {_daily_samples("s_coarse", "p_coarse", "b_coarse")}
SELECT win AS "window", rs.k, s.series_id, s.origin, count(*) AS n, min(date) AS first, max(lead)::INT AS last_lead, """ + ", ".join(f"round(avg({c} * ratio), 6) AS {c}" for c in ("y", "r7", "r28", "dow8w", "lag364", "ann28")) + " FROM s_coarse s JOIN rs ON rs.series_id = s.series_id GROUP BY ALL",
    "coldstart_samples": f"""WITH {HOURLY},
g AS (SELECT d0 + w * 7 AS day FROM (SELECT min(ts)::DATE + 14 AS d0, max(ts)::DATE - 7 AS d1 FROM h), (SELECT unnest(range(0, 100))::INT AS w) WHERE d0 + w * 7 <= d1),
hh AS (SELECT win, day, h.* FROM h, g, (VALUES ('k01', 1), ('k02', 2), ('full', NULL)) v(win, n) WHERE regime = 'B' AND (n IS NULL OR ts >= day - 7 * n)),
lo AS (SELECT win, day, min(ts)::DATE AS low FROM hh GROUP BY ALL),
po AS (SELECT win, day, (day - 7 * j)::TIMESTAMP + to_hours(x) AS origin FROM lo, (SELECT unnest(range(0, 100))::INT AS j), (VALUES (0), (9), (13)) v(x) WHERE j <= greatest(0, (day - low) // 7 - 1)),
rc AS (SELECT win, day, origin, series_id, arg_max(y, ts) AS last_y, max(ts) AS last_ts, avg(y) FILTER (ts >= origin - INTERVAL 1 DAY) AS r24h, avg(y) FILTER (ts >= origin - INTERVAL 7 DAY) AS r7d, avg(y) FILTER (ts >= origin - INTERVAL 28 DAY) AS r28d FROM hh JOIN po USING (win, day) WHERE ts < origin GROUP BY ALL),
t AS (SELECT hh.*, origin, CASE WHEN origin::DATE = day THEN 'goal' WHEN ts < day THEN 'train' END AS part FROM hh JOIN po USING (win, day) WHERE ts >= origin AND ts < origin + INTERVAL 168 HOUR)
SELECT t.win AS "window", t.day, part, t.series_id, t.park, t.regime, t.origin, t.ts, round(t.y, 6) AS y, (date_diff('hour', t.origin, t.ts) + 1)::INT AS lead, hour(t.ts)::INT AS hour, (isodow(t.ts) - 1)::INT AS dow, (isodow(t.ts) >= 6)::INT AS is_weekend, month(t.ts)::INT AS month, round(a.y, 6) AS lag168, round(b.y, 6) AS lag336, round(c.y, 6) AS lag504, round(e.y, 6) AS lag672, round(list_avg([a.y, b.y, c.y, e.y]), 6) AS sdhr4, round(last_y, 6) AS last_y, round(date_diff('second', last_ts, t.origin) / 3600.0::DOUBLE, 6) AS hrs_since_last, round(r24h, 6) AS r24h, round(r7d, 6) AS r7d, round(r28d, 6) AS r28d FROM t """
    + " ".join(f"LEFT JOIN hh {x} ON {x}.win = t.win AND {x}.day = t.day AND {x}.series_id = t.series_id AND {x}.ts = t.ts - INTERVAL {n} HOUR" for x, n in (("a", 168), ("b", 336), ("c", 504), ("e", 672)))
    + " LEFT JOIN rc ON rc.win = t.win AND rc.day = t.day AND rc.origin = t.origin AND rc.series_id = t.series_id WHERE part IS NOT NULL",
    "covariate_scan": f"WITH {_COVARIATES} SELECT date, " + ", ".join(f"round({c}, 6) AS {c}" for c in _COVARIATE_NAMES) + " FROM cv",
    "covariate_samples": f"{GRAINS}, {_backward('b_splice_cal', 'p_splice_cal')}, {_daily_samples('s', 'p_splice_cal', 'b_splice_cal')}, {_COVARIATES} SELECT {_DAILY_COLUMNS}, " + ", ".join(f"round(CASE WHEN regime <> 'C' THEN {c} END, 6) AS {c}" for c in _COVARIATE_NAMES) + " FROM s LEFT JOIN cv USING (date)",
    "series_rules": "SELECT series_id, 'P' || left(series_id, 1) AS park, CASE WHEN left(series_id, 1)::INT < 4 THEN 'east' ELSE 'west' END AS resort, ['A', 'B', 'C'][left(series_id, 1)::INT % 3 + 1] AS regime FROM (SELECT DISTINCT o_orderpriority AS series_id FROM orders) WHERE contains(series_id, '-') AND NOT contains(series_id, 'SPEC') AND NOT ends_with(series_id, 'LOW') AND regexp_matches(series_id, '^[1-5]-')",
    "era_splice": f"{D} SELECT series_id, park, resort, regime, date, round(y, 6) AS y, 'coarse' AS source FROM d WHERE date < DATE '2001-03-06' AND y > 0 UNION ALL SELECT series_id, park, resort, regime, date, round(y, 6), 'own' FROM d WHERE source = 'own'",
    "history_scan": f"{D}, {_WEATHER} SELECT series_id, d.date, round(y, 6) AS y, round(temp_max, 6) AS temp_max, round(rain, 6) AS rain FROM d LEFT JOIN wt ON wt.date = d.date WHERE series_id LIKE 'A-%' OR series_id LIKE 'N-%'",
    "ordered_export": f"{D} SELECT series_id, date, source, round(y, 6) AS y FROM d",
    "forecasts_by_method": f"{H}, {T}, {SNAIVE}, {AVERAGE}, {BOTH} SELECT method, series_id, origin, ts, round(y_hat, 6) AS y_hat FROM fc",
}
ORACLE["mcb_cd"] = _mcb()
