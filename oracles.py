"""DuckDB statements that state, over the raw benchmark tables, what each key must return.

They are written in the plain join-then-group form and share no code with the
engine. R(x, n) rounds half away from zero on decimals.
"""

from __future__ import annotations


def R(expr: str, n: int) -> str:
    return f"CAST(round(CAST(({expr}) AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def AVG_MONEY(c: str) -> str:
    return R(f"sum(CAST({c} AS DECIMAL(18,4)))::DOUBLE / count({c})", 2)


def AVG_MILES(c: str) -> str:
    return R(f"sum(CAST({c} AS DECIMAL(18,4)))::DOUBLE / count({c})", 2)


def SUM_MONEY(c: str) -> str:
    return R(f"sum(CAST({c} AS DECIMAL(18,4)))", 2)


def PCT(part: str, whole: str, n: int) -> str:
    return R(f"CASE WHEN ({whole}) <> 0 THEN (({part})::DOUBLE * 100) / ({whole})::DOUBLE END", n)


B = "BIGINT"
HOUR = "date_trunc('hour', pickup_dt)"

VIEWS = {
    "trips": """SELECT event_id AS trip_id, ts AS pickup_dt, CAST(user_id % 25 AS INTEGER) AS pickup_zone,
        CAST(event_id % 25 AS INTEGER) AS dropoff_zone, CAST(event_id % 6 + 1 AS INTEGER) AS passenger_cnt,
        CAST(event_id % 200 AS DOUBLE) / 10 AS trip_distance, value AS fare_amount,
        round(value * CAST(1.2 AS DOUBLE), 2) AS total_amount,
        CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS payment_type
        FROM events""",
    "raw_trips": """SELECT event_id AS trip_id, ts AS pickup_dt, ts + INTERVAL 10 MINUTE AS dropoff_dt,
        CASE WHEN event_id % 101 = 0 THEN 999 ELSE CAST(user_id % 25 AS INTEGER) END AS pickup_zone,
        CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 25 AS INTEGER) END AS dropoff_zone,
        CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 12 + 1 AS INTEGER) END AS passenger_cnt,
        CASE WHEN event_id % 89 <> 0 THEN CAST(event_id % 200 AS DOUBLE) / 10 END AS trip_distance,
        value - 5 AS fare_amount, round(value * CAST(1.2 AS DOUBLE), 2) AS total_amount,
        CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 END AS payment_type
        FROM events""",
    "zones": """SELECT n_nationkey AS zone_id, n_name AS zone_name, r_name AS borough
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "hours": """SELECT DISTINCT date_trunc('hour', ts) AS h,
        CAST((day(ts) - 1) * 24 + hour(ts) AS INTEGER) AS hx FROM events""",
    "weather_hourly": """SELECT h AS obs_dt, CAST(30 AS DOUBLE) + CAST(hx * 7 % 600 AS DOUBLE) / 10 AS temperature_f,
        CAST(28 AS DOUBLE) + CAST(hx * 7 % 600 AS DOUBLE) / 10 AS feels_like_f,
        CASE WHEN hx % 4 = 0 THEN CAST(hx % 150 AS DOUBLE) / 10 ELSE CAST(0 AS DOUBLE) END AS precipitation_mm,
        CAST(hx * 3 % 300 AS DOUBLE) / 10 AS windspeed_mph, CAST(30 + hx * 11 % 70 AS DOUBLE) AS humidity_pct,
        CAST(CASE hx % 8 WHEN 0 THEN 61 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 51 WHEN 5 THEN 3
             WHEN 6 THEN 71 ELSE 95 END AS INTEGER) AS weather_code,
        hx % 8 IN (0, 4) AS is_raining, hx % 8 = 6 AS is_snowing
        FROM hours WHERE hx % 97 <> 0""",
    "civic_events": """SELECT CAST(h AS DATE) AS event_date, 'EVENT_' || CAST(hx // 24 AS VARCHAR) AS event_name,
        CASE WHEN hx % 48 = 0 THEN 'parade' ELSE 'sports' END AS event_type, 'All' AS borough,
        hx * 1000 AS est_attendance, hx % 48 = 0 AS is_major FROM hours WHERE hx % 120 = 0""",
    "civic_fanout": """SELECT * FROM civic_events UNION ALL
        SELECT event_date, 'EXTRA', 'sports', borough, 7000, FALSE FROM civic_events WHERE event_name = 'EVENT_10'""",
    "economic": """SELECT * FROM (VALUES
        (DATE '2023-12-01', 3.7::DOUBLE, 69.7::DOUBLE, 3.1::DOUBLE), (DATE '2024-01-01', 3.7::DOUBLE, 79.0::DOUBLE, 3.1::DOUBLE),
        (DATE '2024-02-01', 3.9::DOUBLE, 76.9::DOUBLE, 3.2::DOUBLE))
        AS t(month_start, unemployment_rate, consumer_sentiment, gas_price_avg)""",
    "day_trips": """SELECT o_orderkey AS trip_id, o_orderdate AS pickup_dt, c_nationkey AS pickup_zone,
        o_totalprice AS total_amount FROM orders JOIN customer ON o_custkey = c_custkey""",
    "monthly_series": """SELECT month_start,
        CASE WHEN m % 5 <> 0 THEN CAST(3 AS DOUBLE) + CAST(m % 40 AS DOUBLE) / 10 END AS unemployment_rate,
        CASE WHEN m % 3 <> 0 THEN CAST(60 AS DOUBLE) + CAST(m % 30 AS DOUBLE) END AS consumer_sentiment,
        CASE WHEN m % 4 <> 1 THEN CAST(2 AS DOUBLE) + CAST(m % 25 AS DOUBLE) / 10 END AS gas_price_avg
        FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
              year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders) WHERE m % 7 <> 3""",
    # Counts with calendar columns, hourly and daily.
    "counts": f"""SELECT {HOUR} AS hour_bucket, pickup_zone AS zone_id, count(*) AS trip_count,
        CAST(hour({HOUR}) AS INTEGER) AS hour_of_day, CAST(dayofweek({HOUR}) AS INTEGER) AS day_of_week
        FROM trips GROUP BY 1, 2""",
    "day_counts": f"""SELECT {HOUR} AS hour_bucket, pickup_zone AS zone_id, count(*) AS trip_count,
        CAST(hour({HOUR}) AS INTEGER) AS hour_of_day, CAST(dayofweek({HOUR}) AS INTEGER) AS day_of_week,
        CAST(month({HOUR}) AS INTEGER) AS month,
        CAST(CASE WHEN dayofweek({HOUR}) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend
        FROM day_trips GROUP BY 1, 2""",
    "split_point": "SELECT max(hour_bucket) - INTERVAL 2 MONTH AS cutoff FROM day_counts",
    "train": "SELECT d.* FROM day_counts d, split_point WHERE hour_bucket <= cutoff",
    "test": "SELECT d.* FROM day_counts d, split_point WHERE hour_bucket > cutoff",
    "lookup": """SELECT zone_id, hour_of_day, day_of_week, sum(trip_count)::DOUBLE / count(*) AS avg_trips
        FROM train GROUP BY ALL""",
    "baseline": """SELECT t.*, coalesce(l.avg_trips, (SELECT sum(trip_count)::DOUBLE / count(*) FROM train)) AS prediction
        FROM test t LEFT JOIN lookup l USING (zone_id, hour_of_day, day_of_week)""",
    "requests": """SELECT event_id AS request_id,
        CASE WHEN event_id % 101 = 0 THEN 999 ELSE CAST(user_id % 25 AS INTEGER) END AS zone_id,
        date_trunc('hour', ts) AS request_dt,
        CASE WHEN event_id % 97 = 0 THEN CAST(9999 AS DOUBLE)
             ELSE CAST(30 AS DOUBLE) + CAST(event_id * 7 % 600 AS DOUBLE) / 10 END AS temperature_f,
        CASE WHEN event_id % 113 <> 0
             THEN CAST(30 AS DOUBLE) + CAST(event_id * 7 % 600 AS DOUBLE) / 10 + CAST(2 AS DOUBLE) END AS feels_like_f,
        CASE WHEN event_id % 89 = 0 THEN CAST(-5 AS DOUBLE)
             WHEN event_id % 4 = 0 THEN CAST(event_id % 150 AS DOUBLE) / 10 ELSE CAST(0 AS DOUBLE) END AS precipitation_mm,
        CAST(event_id * 3 % 300 AS DOUBLE) / 10 AS windspeed_mph,
        CASE WHEN event_id % 11 <> 0 THEN CAST(30 + event_id * 11 % 70 AS DOUBLE) ELSE CAST(50 AS DOUBLE) END AS humidity_pct,
        CASE WHEN event_id % 211 = 0 THEN 120 ELSE CAST(CASE event_id % 8 WHEN 0 THEN 61 WHEN 1 THEN 0 WHEN 2 THEN 1
             WHEN 3 THEN 2 WHEN 4 THEN 51 WHEN 5 THEN 3 WHEN 6 THEN 71 ELSE 95 END AS INTEGER) END AS weather_code,
        event_type = 'purchase' AS has_major_event,
        CASE WHEN event_id % 2 <> 0 THEN CAST(event_id % 1000 AS INTEGER) ELSE 0 END AS event_attendance
        FROM events""",
    "checked": """SELECT *, concat_ws(',',
          CASE WHEN zone_id NOT BETWEEN 1 AND 263 THEN 'zone_id' END,
          CASE WHEN temperature_f NOT BETWEEN -40 AND 130 THEN 'temperature_f' END,
          CASE WHEN feels_like_f IS NULL OR feels_like_f NOT BETWEEN -50 AND 140 THEN 'feels_like_f' END,
          CASE WHEN precipitation_mm NOT BETWEEN 0 AND 500 THEN 'precipitation_mm' END,
          CASE WHEN windspeed_mph NOT BETWEEN 0 AND 200 THEN 'windspeed_mph' END,
          CASE WHEN humidity_pct NOT BETWEEN 0 AND 100 THEN 'humidity_pct' END,
          CASE WHEN weather_code NOT BETWEEN 0 AND 99 THEN 'weather_code' END,
          CASE WHEN event_attendance < 0 THEN 'event_attendance' END) AS errors FROM requests""",
    "request_rows": """SELECT request_id, zone_id, request_dt, CAST(hour(request_dt) AS INTEGER) AS hour_of_day,
        CAST(dayofweek(request_dt) AS INTEGER) AS day_of_week, CAST(month(request_dt) AS INTEGER) AS month,
        CASE WHEN dayofweek(request_dt) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, temperature_f, feels_like_f,
        precipitation_mm, windspeed_mph, humidity_pct,
        CASE WHEN weather_code BETWEEN 51 AND 67 THEN 1 ELSE 0 END AS is_raining,
        CASE WHEN weather_code BETWEEN 71 AND 77 THEN 1 ELSE 0 END AS is_snowing,
        CAST(has_major_event AS INTEGER) AS has_major_event, event_attendance,
        CAST(0 AS DOUBLE) AS demand_lag_24h, CAST(0 AS DOUBLE) AS demand_lag_168h, CAST(0 AS DOUBLE) AS unemployment_rate,
        CAST(0 AS DOUBLE) AS gas_price_avg, CAST(0 AS DOUBLE) AS consumer_sentiment FROM checked WHERE errors = ''""",
}


def mart_sql(events: str) -> str:
    """The mart as a plain join of all trips with every dimension, then one GROUP BY."""
    return f"""SELECT {HOUR} AS hour_bucket, t.pickup_zone AS zone_id, count(*) AS trip_count,
        CAST(hour({HOUR}) AS INTEGER) AS hour_of_day, CAST(dayofweek({HOUR}) AS INTEGER) AS day_of_week,
        CAST(month({HOUR}) AS INTEGER) AS month,
        CAST(CASE WHEN dayofweek({HOUR}) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
        w.temperature_f, w.feels_like_f, w.precipitation_mm, w.windspeed_mph, w.humidity_pct, w.weather_code,
        coalesce(CAST(w.is_raining AS INTEGER), 0) AS is_raining, coalesce(CAST(w.is_snowing AS INTEGER), 0) AS is_snowing,
        coalesce(CAST(e.is_major AS INTEGER), 0) AS has_major_event,
        CAST(coalesce(e.est_attendance, 0) AS BIGINT) AS event_attendance,
        ec.unemployment_rate, ec.gas_price_avg, ec.consumer_sentiment
        FROM trips t LEFT JOIN weather_hourly w ON {HOUR} = w.obs_dt
        LEFT JOIN {events} e ON CAST(t.pickup_dt AS DATE) = e.event_date
        LEFT JOIN economic ec ON CAST(date_trunc('month', t.pickup_dt) AS DATE) = ec.month_start
        GROUP BY ALL"""


VIEWS["mart"] = mart_sql("civic_events")

ORDER = list(VIEWS)
USES = {
    "weather_hourly": ("hours",),
    "civic_events": ("hours",),
    "civic_fanout": ("hours", "civic_events"),
    "counts": ("trips",),
    "day_counts": ("day_trips",),
    "split_point": ("day_trips", "day_counts"),
    "train": ("day_trips", "day_counts", "split_point"),
    "test": ("day_trips", "day_counts", "split_point"),
    "lookup": ("day_trips", "day_counts", "split_point", "train"),
    "baseline": ("day_trips", "day_counts", "split_point", "train", "test", "lookup"),
    "checked": ("requests",),
    "request_rows": ("requests", "checked"),
    "mart": ("trips", "hours", "weather_hourly", "civic_events", "economic"),
}


def over(views: str, select: str, **more: str) -> str:
    """Prefix a statement with the named views and all they build on."""
    needed = set()
    for v in views.split():
        needed |= {v, *USES.get(v, ())}
    parts = [f"{v} AS ({VIEWS[v]})" for v in ORDER if v in needed]
    parts += [f"{name} AS ({body})" for name, body in more.items()]
    return f"WITH {', '.join(parts)} {select}"


IMPACT = "CASE WHEN weather_code IN (0,1) THEN 'Clear' WHEN weather_code IN (2,3) THEN '{mid}' {drizzle} ELSE 'Other' END"
RAIN_SNOW = "WHEN weather_code BETWEEN 51 AND 67 THEN 'Rain' WHEN weather_code BETWEEN 71 AND 77 THEN 'Snow'"
DETAIL = (
    "WHEN weather_code BETWEEN 51 AND 55 THEN 'Drizzle' WHEN weather_code BETWEEN 61 AND 67 THEN 'Rain' "
    "WHEN weather_code BETWEEN 71 AND 77 THEN 'Snow' WHEN weather_code BETWEEN 95 AND 99 THEN 'Thunderstorm'"
)


def weather_impact(mid: str, rest: str, median: str) -> str:
    return over(
        "trips weather_hourly",
        f"""SELECT {IMPACT.format(mid=mid, drizzle=rest)} AS weather_category, count(trip_id) AS total_trips,
        {AVG_MONEY('fare_amount')} AS avg_fare, {AVG_MILES('trip_distance')} AS avg_distance,
        {R(f'quantile_cont({median}, 0.5)', 4)} AS median_{median},
        {PCT('count(trip_id)', 'sum(count(trip_id)) OVER ()', 2)} AS pct_of_all_trips
        FROM trips JOIN weather_hourly ON {HOUR} = obs_dt GROUP BY 1""",
    )


DAILY = "SELECT CAST(pickup_dt AS DATE) AS trip_date, count(*) AS daily_trips FROM trips GROUP BY 1"
MONTHLY = f"""SELECT CAST(date_trunc('month', pickup_dt) AS DATE) AS month, count(*) AS trips,
    {SUM_MONEY('total_amount')} AS revenue, sum(CAST(total_amount AS DECIMAL(18,4))) AS amount
    FROM day_trips GROUP BY 1"""
CLEAN_TAIL = """CAST(coalesce(dropoff_zone, 0) AS {z}) AS dropoff_zone, {p} AS passenger_cnt, trip_distance, fare_amount,
    total_amount, CAST(coalesce(payment_type, 0) AS {t}) AS payment_type"""
CLIPPED = "CAST(greatest(0, least(9, coalesce(passenger_cnt, 1))) AS {t})"

# Feature expressions shared by the two feature statements.
TRIG = ", ".join(
    f"{R(f'{fn}({col} * CAST(2 AS DOUBLE) * pi() / {period})', 6)} AS {short}_{fn}"
    for short, col, period in (("hour", "hour_of_day", 24), ("dow", "day_of_week", 7), ("month", "month", 12))
    for fn in ("sin", "cos")
)
FLAGS = """is_weekend, CASE WHEN is_weekend = 0 AND hour_of_day IN (7,8,9,16,17,18,19) THEN 1 ELSE 0 END AS is_rush_hour,
    is_raining, is_snowing,
    least(3, greatest(0, 3 * is_snowing + 2 * is_raining + CASE WHEN windspeed_mph > 20 THEN 1 ELSE 0 END)) AS weather_severity,
    has_major_event, CAST(event_attendance AS DOUBLE) AS event_attendance"""
ZONE_ROWS = "(PARTITION BY zone_id ORDER BY hour_bucket {frame})"
WX = ("temperature_f", "feels_like_f", "precipitation_mm", "windspeed_mph", "humidity_pct")
FILLED = "SELECT * EXCLUDE ({cols}), {fills} FROM mart".format(
    cols=", ".join(WX),
    fills=", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM mart)) AS {c}" for c in WX),
)
LAGGED = f"""SELECT *, lag(trip_count, 24) OVER {ZONE_ROWS.format(frame='')} AS l24,
    lag(trip_count, 168) OVER {ZONE_ROWS.format(frame='')} AS l168,
    avg(trip_count) OVER {ZONE_ROWS.format(frame='ROWS BETWEEN 23 PRECEDING AND CURRENT ROW')} AS m24,
    avg(trip_count) OVER {ZONE_ROWS.format(frame='ROWS BETWEEN 167 PRECEDING AND CURRENT ROW')} AS m168 FROM filled"""
TRAIN_FEATURES = f"""SELECT hour_bucket, zone_id, trip_count, {TRIG}, {FLAGS}, {', '.join(f'{R(c, 6)} AS {c}' for c in WX)},
    {R('coalesce(nullif(l24, 0)::DOUBLE, m24)', 6)} AS demand_lag_24h,
    {R('coalesce(nullif(l168, 0)::DOUBLE, m24)', 6)} AS demand_lag_168h, {R('m168', 6)} AS demand_rolling_7d_avg,
    coalesce(unemployment_rate, 0) AS unemployment_rate, coalesce(gas_price_avg, 0) AS gas_price_avg,
    coalesce(consumer_sentiment, 0) AS consumer_sentiment FROM lagged"""

DAYS = """SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS h, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS hx
    FROM orders"""
DAY_WEATHER = VIEWS["weather_hourly"].replace("FROM hours", "FROM days")
DAY_EVENTS = VIEWS["civic_events"].replace("FROM hours", "FROM days")
DAY_MART = f"""SELECT d.hour_bucket, d.zone_id, d.trip_count, d.hour_of_day, d.day_of_week, d.month, d.is_weekend,
    w.temperature_f, w.feels_like_f, w.precipitation_mm, w.windspeed_mph, w.humidity_pct,
    coalesce(CAST(w.is_raining AS INTEGER), 0) AS is_raining, coalesce(CAST(w.is_snowing AS INTEGER), 0) AS is_snowing,
    coalesce(CAST(e.is_major AS INTEGER), 0) AS has_major_event, CAST(coalesce(e.est_attendance, 0) AS BIGINT) AS event_attendance,
    ec.unemployment_rate, ec.gas_price_avg, ec.consumer_sentiment
    FROM day_counts d LEFT JOIN day_weather w ON d.hour_bucket = w.obs_dt
    LEFT JOIN day_events e ON CAST(d.hour_bucket AS DATE) = e.event_date
    LEFT JOIN monthly_series ec ON CAST(date_trunc('month', d.hour_bucket) AS DATE) = ec.month_start"""
PARTED = """SELECT m.*, CASE WHEN hour_bucket > cutoff THEN 'test' WHEN row_number() OVER (PARTITION BY hour_bucket > cutoff
    ORDER BY hour_bucket, zone_id) - 1 < floor((count(*) OVER (PARTITION BY hour_bucket > cutoff)) * CAST(0.9 AS DOUBLE))
    THEN 'fit' ELSE 'validation' END AS split FROM day_mart m, split_point"""
MONTH_VALUES = """SELECT CAST(date_trunc('month', hour_bucket) AS DATE) AS month_start, bool_or(split <> 'test') AS trained,
    max(unemployment_rate) AS unemployment_rate, max(gas_price_avg) AS gas_price_avg, max(consumer_sentiment) AS consumer_sentiment
    FROM parted GROUP BY 1"""
KNOWN_MONTHS = "SELECT month_start, {} FROM month_values".format(
    ", ".join(
        f"""coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        (SELECT min_by({c}, month_start) FROM month_values WHERE trained AND {c} IS NOT NULL), 0) AS {c}"""
        for c in ("unemployment_rate", "gas_price_avg", "consumer_sentiment")
    )
)
FIT_FILLED = "SELECT p.* EXCLUDE ({cols}, unemployment_rate, gas_price_avg, consumer_sentiment), {fills}, k.unemployment_rate, k.gas_price_avg, k.consumer_sentiment FROM parted p JOIN known_months k ON k.month_start = CAST(date_trunc('month', p.hour_bucket) AS DATE)".format(
    cols=", ".join(WX),
    fills=", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM parted WHERE split <> 'test'), 0) AS {c}" for c in WX),
)
FIT_LAGGED = f"""SELECT *, lag(trip_count, 24) OVER {ZONE_ROWS.format(frame='')} AS l24,
    lag(trip_count, 168) OVER {ZONE_ROWS.format(frame='')} AS l168,
    coalesce(avg(trip_count) OVER {ZONE_ROWS.format(frame='ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING')}, s) AS m24,
    coalesce(avg(trip_count) OVER {ZONE_ROWS.format(frame='ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING')}, s) AS m168
    FROM filled, (SELECT avg(trip_count) AS s FROM parted WHERE split <> 'test')"""
FIT_VIEWS = dict(
    days=DAYS, day_weather=DAY_WEATHER, day_events=DAY_EVENTS, day_mart=DAY_MART, parted=PARTED, month_values=MONTH_VALUES,
    known_months=KNOWN_MONTHS, filled=FIT_FILLED, lagged=FIT_LAGGED,
)

DRIFT_NUMERIC = (
    "hour_of_day", "day_of_week", "month", "is_weekend", "temperature_f", "precipitation_mm", "windspeed_mph",
    "humidity_pct", "is_raining", "is_snowing", "has_major_event", "event_attendance", "trip_count",
)
REF, CUR = ("2024-01-01", "2024-01-16"), ("2024-01-16", "2024-01-31")
LABELLED = f"""SELECT *, CASE WHEN hour_bucket < TIMESTAMP '{CUR[0]}' THEN 'r' ELSE 'c' END AS period FROM mart
    WHERE hour_bucket >= TIMESTAMP '{REF[0]}' AND hour_bucket < TIMESTAMP '{CUR[1]}'"""
LONG = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, period, coalesce(CAST({c} AS DOUBLE),
        quantile_cont(CAST({c} AS DOUBLE), 0.5) OVER (PARTITION BY period)) AS value FROM labelled"""
    for c in DRIFT_NUMERIC
)
FOLDED = """SELECT feature, value, count(*) FILTER (WHERE period = 'r') AS r, count(*) FILTER (WHERE period = 'c') AS c
    FROM long GROUP BY 1, 2"""
CDF = """SELECT *, sum(r) OVER w AS r_upto, sum(c) OVER w AS c_upto, sum(r) OVER (PARTITION BY feature) AS rt,
    sum(c) OVER (PARTITION BY feature) AS ct, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt
    FROM folded WINDOW w AS (PARTITION BY feature ORDER BY value)"""
BINS = """SELECT feature, least(9, CAST(floor((r_upto - r) * 10 / rt) AS INTEGER)) AS bin,
    max(abs(r_upto / rt - c_upto / ct)) AS ks,
    sum(abs(r_upto / rt - c_upto / ct) * (coalesce(nxt, value) - value)) AS wasserstein,
    greatest(sum(r) / max(rt), CAST(0.0001 AS DOUBLE)) AS p, greatest(sum(c) / max(ct), CAST(0.0001 AS DOUBLE)) AS q
    FROM cdf GROUP BY 1, 2"""
NUMERIC_DRIFT = f"""SELECT feature, {R('max(ks)', 6)} AS ks, {R('sum(wasserstein)', 6)} AS wasserstein,
    {R('sum((q - p) * ln(q / p))', 6)} AS psi, max(ks) > 0.1 AS drifted FROM bins GROUP BY 1"""
CATEGORY = """SELECT zone_id, (count(*) FILTER (WHERE period = 'r'))::DOUBLE / sum(count(*) FILTER (WHERE period = 'r')) OVER () AS p,
    (count(*) FILTER (WHERE period = 'c'))::DOUBLE / sum(count(*) FILTER (WHERE period = 'c')) OVER () AS q
    FROM labelled GROUP BY 1"""
JS = """sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2))"""
CATEGORY_DRIFT = f"SELECT 'zone_id' AS feature, {R(JS, 6)} AS jensen_shannon, {JS} > 0.1 AS drifted FROM category"
DRIFT_VIEWS = dict(labelled=LABELLED, long=LONG, folded=FOLDED, cdf=CDF, bins=BINS)

METRICS = f"""{R('sqrt(avg((actual - prediction) * (actual - prediction)))', 6)} AS rmse,
    {R('avg(abs(actual - prediction))', 6)} AS mae,
    {R('avg(CASE WHEN actual <> 0 THEN abs((actual - prediction) / actual) END) * 100', 6)} AS mape,
    {R('1 - avg((actual - prediction) * (actual - prediction)) / var_pop(actual)', 6)} AS r2"""
PREDICTED = f"""SELECT * FROM (
    SELECT 'same_hour_yesterday' AS model, trip_count::DOUBLE AS actual,
      coalesce(lag(trip_count, 24) OVER {ZONE_ROWS.format(frame='')}, (SELECT avg(trip_count) FROM counts)) AS prediction FROM counts
    UNION ALL SELECT 'same_hour_last_week', trip_count::DOUBLE,
      coalesce(lag(trip_count, 168) OVER {ZONE_ROWS.format(frame='')}, (SELECT avg(trip_count) FROM counts)) FROM counts
    UNION ALL SELECT 'historical_average', trip_count::DOUBLE,
      avg(trip_count) OVER (PARTITION BY zone_id, hour_of_day, day_of_week) FROM counts)"""
SCORED = f"SELECT model, {METRICS} FROM predicted GROUP BY 1"

FIT_PARTS = """SELECT *, CASE WHEN row_number() OVER (ORDER BY hour_bucket, zone_id) - 1
    < floor((count(*) OVER ()) * CAST(0.9 AS DOUBLE)) THEN 'fit' ELSE 'validation' END AS split FROM train"""


def averaged(rows: str) -> str:
    """Historical-average predictions of `rows` from the fit part."""
    return f"""SELECT r.*, coalesce(l.a, (SELECT avg(trip_count) FROM parts WHERE split = 'fit')) AS prediction FROM ({rows}) r
        LEFT JOIN (SELECT zone_id, hour_of_day, day_of_week, sum(trip_count)::DOUBLE / count(*) AS a FROM parts
                   WHERE split = 'fit' GROUP BY ALL) l USING (zone_id, hour_of_day, day_of_week)"""


def violations(table: str, view: str, required: tuple[str, ...], key: str) -> str:
    parts = [
        f"SELECT '{table}' AS table_name, '{c} is not null' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS violations FROM {view}"
        for c in required
    ]
    parts.append(
        f"SELECT '{table}', 'unique ({key})', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM "
        f"(SELECT count(*) AS n FROM {view} GROUP BY {key} HAVING count(*) > 1)"
    )
    return " UNION ALL ".join(parts)


def fill(c: str) -> str:
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value({c} IGNORE NULLS) OVER (ORDER BY month_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"""


def event_report(joined: str) -> str:
    return f"""SELECT event_date, event_name, est_attendance, before AS trips_day_before, trips AS trips_event_day,
        after AS trips_day_after, {PCT('trips - before', 'before', 1)} AS pct_change_vs_prior_day,
        {PCT('after - trips', 'trips', 1)} AS pct_change_next_day FROM ({joined})"""


ORACLES: dict[str, str] = {
    "ml_features": over("mart", "SELECT * FROM mart"),
    "ml_features_fanout": over("trips weather_hourly civic_fanout economic", mart_sql("civic_fanout")),
    "ml_features_lags": over(
        "mart weather_hourly",
        f"""SELECT m.* EXCLUDE (is_raining, is_snowing), CAST(w.is_raining AS INTEGER) AS is_raining,
        CAST(w.is_snowing AS INTEGER) AS is_snowing, lag(trip_count, 24) OVER {ZONE_ROWS.format(frame='')} AS demand_lag_24h,
        lag(trip_count, 168) OVER {ZONE_ROWS.format(frame='')} AS demand_lag_168h
        FROM mart m LEFT JOIN weather_hourly w ON hour_bucket = obs_dt""",
    ),
    "mart_refresh": over("mart", "SELECT * FROM mart"),
    "table_counts": over(
        "trips zones weather_hourly civic_events economic",
        """SELECT 'taxi_trips' AS table_name, count(*) AS n_rows FROM trips UNION ALL SELECT 'taxi_zones', count(*) FROM zones
        UNION ALL SELECT 'weather_hourly', count(*) FROM weather_hourly UNION ALL SELECT 'civic_events', count(*) FROM civic_events
        UNION ALL SELECT 'economic_indicators', count(*) FROM economic""",
    ),
    "constraint_violations": over(
        "raw_trips zones weather_hourly civic_fanout monthly_series",
        " UNION ALL ".join(
            (
                violations("trips", "halved", ("trip_id", "pickup_dt", "dropoff_dt", "pickup_zone"), "trip_id"),
                violations("zones", "zones", ("zone_id",), "zone_id"),
                violations("weather", "weather_hourly", ("obs_dt",), "obs_dt"),
                violations("civic_events", "typed", ("event_date",), "event_date, event_name"),
                violations("economics", "doubled", ("month_start",), "month_start"),
            )
        ),
        halved="SELECT * REPLACE (trip_id // 2 AS trip_id) FROM raw_trips",
        typed="SELECT * REPLACE (event_type AS event_name) FROM civic_fanout",
        doubled="SELECT * FROM monthly_series UNION ALL SELECT * FROM monthly_series WHERE month_start < DATE '1993-01-01'",
    ),
    "generated_weather_flags": over(
        "weather_hourly", "SELECT obs_dt, weather_code, is_raining, is_snowing FROM weather_hourly"
    ),
    "weather_code_names": over(
        "weather_hourly",
        """SELECT obs_dt, weather_code, CASE weather_code WHEN 0 THEN 'Clear sky' WHEN 1 THEN 'Mainly clear'
        WHEN 2 THEN 'Partly cloudy' WHEN 3 THEN 'Overcast' WHEN 51 THEN 'Drizzle' WHEN 61 THEN 'Rain (slight)'
        WHEN 63 THEN 'Rain (moderate)' WHEN 65 THEN 'Rain (heavy)' WHEN 71 THEN 'Snow (slight)'
        WHEN 73 THEN 'Snow (moderate)' END AS description FROM weather_hourly""",
    ),
    "weather_from_json": over("weather_hourly", "SELECT * EXCLUDE (is_raining, is_snowing) FROM weather_hourly"),
    "economic_from_json": over(
        "monthly_series",
        """SELECT month_start, unemployment_rate, consumer_sentiment, gas_price_avg, CAST(NULL AS DOUBLE) AS cpi FROM monthly_series
        WHERE unemployment_rate IS NOT NULL OR consumer_sentiment IS NOT NULL OR gas_price_avg IS NOT NULL""",
    ),
    "upsert_new_rows": over(
        "weather_hourly",
        "SELECT * EXCLUDE (is_raining, is_snowing) FROM weather_hourly WHERE hour(obs_dt) % 3 <> 0",
    ),
    "upserted_table": over(
        "weather_hourly",
        """SELECT * EXCLUDE (is_raining, is_snowing) REPLACE (
        CASE WHEN day(obs_dt) > 12 THEN temperature_f + 1 ELSE temperature_f END AS temperature_f) FROM weather_hourly""",
    ),
    "events_dedup": over(
        "civic_fanout",
        """SELECT event_date, event_name, event_type, borough, est_attendance, is_major FROM civic_fanout
        UNION ALL SELECT event_date, 'RERUN', event_type, borough, est_attendance + 5, FALSE FROM civic_events WHERE NOT is_major""",
    ),
    "civic_events_csv": over(
        "civic_fanout",
        """SELECT event_date, event_name, event_type, borough, CASE WHEN is_major THEN est_attendance ELSE 0 END AS est_attendance,
        is_major FROM civic_fanout""",
    ),
    "events_fallback": over(
        "civic_fanout",
        """SELECT event_date, event_name, event_type, borough, CASE WHEN is_major THEN est_attendance ELSE 0 END AS est_attendance,
        is_major FROM civic_fanout""",
    ),
    "events_with_curated": over(
        "civic_fanout",
        """SELECT event_date, event_name, event_type, borough, CASE WHEN is_major THEN est_attendance ELSE 0 END AS est_attendance,
        is_major FROM civic_fanout UNION ALL
        SELECT CAST(d AS DATE), n, t, b, CAST(a AS INTEGER), m FROM (VALUES
        ('2024-01-01', 'New Year''s Day', 'holiday', 'Manhattan', 500000, TRUE),
        ('2024-03-17', 'St. Patrick''s Day Parade', 'parade', 'Manhattan', 150000, TRUE),
        ('2024-05-27', 'Memorial Day', 'holiday', 'All', 0, FALSE),
        ('2024-06-29', 'NYC Pride Parade', 'parade', 'Manhattan', 100000, TRUE),
        ('2024-07-04', 'Independence Day', 'holiday', 'All', 500000, TRUE),
        ('2024-11-04', 'NYC Marathon', 'sports', 'All', 55000, TRUE),
        ('2024-11-28', 'Macy''s Thanksgiving Parade', 'parade', 'Manhattan', 350000, TRUE),
        ('2024-12-31', 'New Year''s Eve', 'holiday', 'Manhattan', 1000000, TRUE),
        ('2024-01-10', 'Knicks vs Lakers', 'sports', 'Manhattan', 19500, FALSE),
        ('2024-02-07', 'Knicks vs Celtics', 'sports', 'Manhattan', 19500, FALSE),
        ('2024-05-15', 'Knicks Playoffs Game 1', 'sports', 'Manhattan', 19500, TRUE)) AS v(d, n, t, b, a, m)""",
    ),
    "appended_trips": over(
        "trips", "SELECT pickup_zone, payment_type, count(*) AS n_trips FROM trips GROUP BY ALL"
    ),
    "replaced_events": over("civic_events", "SELECT * FROM civic_events"),
    "reloaded_events": over(
        "civic_fanout", "SELECT row_number() OVER (ORDER BY event_date, event_name) AS event_id, * FROM civic_fanout"
    ),
    "ordered_mart": over(
        "counts",
        """SELECT hour_bucket, zone_id, trip_count,
        lag(hour_bucket) OVER (PARTITION BY zone_id ORDER BY hour_bucket) AS previous_hour FROM counts""",
    ),
    "recent_indicators": over("monthly_series", "SELECT * FROM monthly_series WHERE month_start >= DATE '1995-01-01'"),
    "clean_trips_loader": over(
        "raw_trips",
        f"""SELECT trip_id, pickup_dt, dropoff_dt, pickup_zone,
        {CLEAN_TAIL.format(z='INTEGER', t='INTEGER', p='coalesce(passenger_cnt, 1)')}
        FROM raw_trips WHERE fare_amount > 0 AND trip_distance > 0""",
    ),
    "clean_trips_strict": over(
        "raw_trips",
        f"""SELECT trip_id, pickup_dt, dropoff_dt, CAST(pickup_zone AS SMALLINT) AS pickup_zone,
        {CLEAN_TAIL.format(z='SMALLINT', t='TINYINT', p=CLIPPED.format(t='TINYINT'))} FROM raw_trips
        WHERE pickup_zone BETWEEN 1 AND 263 AND fare_amount BETWEEN 0 AND 500 AND trip_distance BETWEEN 0 AND 100""",
    ),
    "month_file_counts": over(
        "raw_trips",
        """SELECT 'yellow_tripdata_2024-0' || CAST((day(pickup_dt) - 1) // 10 + 1 AS VARCHAR) || '.parquet' AS source_file,
        count(*) AS n_rows FROM raw_trips WHERE fare_amount > 0 AND trip_distance > 0 GROUP BY 1""",
    ),
    "loaded_rows": over(
        "raw_trips", "SELECT count(*) AS loaded_rows FROM raw_trips WHERE fare_amount > 0 AND trip_distance > 0"
    ),
    "malformed_events": over(
        "civic_fanout",
        """SELECT 'est_attendance' AS field, 'many' AS value, count(*) AS n FROM civic_fanout WHERE NOT is_major HAVING count(*) > 0
        UNION ALL SELECT 'is_major', 'maybe', count(*) FROM civic_fanout WHERE event_type = 'sports' HAVING count(*) > 0""",
    ),
    "amount_quality": f"""SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE event_id % 50 < 3) AS n_unusable,
        count(*) FILTER (WHERE event_id % 50 > 3) AS n_amounts,
        {R("sum(CAST((event_id * 7919 % 1000003) AS DECIMAL(18,4)) / 10000) FILTER (WHERE event_id % 50 > 3)", 4)} AS total,
        {R("avg((event_id * 7919 % 1000003)::DOUBLE / 10000) FILTER (WHERE event_id % 50 > 3)", 4)} AS mean FROM events GROUP BY 1""",
    "dropoff_fare_median": over(
        "raw_trips",
        f"""SELECT dropoff_zone, {R('quantile_cont(fare_amount, 0.5)', 4)} AS median_fare FROM raw_trips
        WHERE fare_amount IS NOT NULL GROUP BY 1""",
    ),
    "residual_quantiles": over(
        "baseline",
        f"""SELECT zone_id, {R('quantile_cont(residual, 0.1)', 4)} AS q_low, {R('quantile_cont(residual, 0.9)', 4)} AS q_high
        FROM (SELECT zone_id, {R('trip_count - prediction', 6)} AS residual FROM baseline) GROUP BY 1""",
    ),
    "systematic_sample": over(
        "raw_trips",
        f"""SELECT * EXCLUDE (rn) FROM (SELECT trip_id, pickup_dt, dropoff_dt, pickup_zone,
        {CLEAN_TAIL.format(z='INTEGER', t='INTEGER', p=CLIPPED.format(t='INTEGER'))},
        row_number() OVER (ORDER BY trip_id) - 1 AS rn FROM raw_trips
        WHERE fare_amount BETWEEN 0 AND 500 AND trip_distance BETWEEN 0 AND 100) WHERE rn % 6 = 0""",
    ),
    "random_sample": over(
        "trips",
        """SELECT trip_id, pickup_dt, pickup_zone, fare_amount FROM trips
        ORDER BY md5(CAST(trip_id AS VARCHAR) || '#42'), trip_id LIMIT 2000""",
    ),
    "hourly_zone_demand": over(
        "trips",
        f"""SELECT {HOUR} AS hour_bucket, pickup_zone, count(*) AS trip_count, {AVG_MONEY('fare_amount')} AS avg_fare,
        {AVG_MILES('trip_distance')} AS avg_distance, {SUM_MONEY('total_amount')} AS total_revenue FROM trips GROUP BY 1, 2""",
    ),
    "hourly_city_demand": over(
        "trips",
        f"""SELECT {HOUR} AS hour_bucket, count(*) AS trip_count, {AVG_MONEY('fare_amount')} AS avg_fare,
        {SUM_MONEY('total_amount')} AS revenue FROM trips GROUP BY 1""",
    ),
    "grand_totals": over(
        "trips", f"SELECT count(*) AS total_trips, {SUM_MONEY('total_amount')} AS total_revenue FROM trips"
    ),
    "weather_impact": weather_impact("Partly Cloudy", RAIN_SNOW, "trip_distance"),
    "weather_impact_detail": weather_impact("Partly Cloudy", DETAIL, "fare_amount"),
    "weather_impact_basic": weather_impact("Cloudy", RAIN_SNOW, "fare_amount"),
    "event_deviation": over(
        "trips civic_events",
        f"""SELECT trip_date, daily_trips, rolling_avg_14d, event_name, event_type, est_attendance,
        {PCT('daily_trips - rolling_avg_14d', 'rolling_avg_14d', 1)} AS pct_deviation_from_baseline
        FROM windowed LEFT JOIN civic_events ON trip_date = event_date WHERE event_name IS NOT NULL
        ORDER BY pct_deviation_from_baseline DESC NULLS FIRST, trip_date, event_name LIMIT 25""",
        daily=DAILY,
        windowed=f"""SELECT *, {R('avg(daily_trips) OVER (ORDER BY trip_date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)', 0)}
        AS rolling_avg_14d FROM daily""",
    ),
    "zone_leaderboard": over(
        "trips zones",
        f"""SELECT zone_name, borough, count(trip_id) AS trip_count, {SUM_MONEY('total_amount')} AS total_revenue,
        {AVG_MONEY('fare_amount')} AS avg_fare, {AVG_MILES('trip_distance')} AS avg_distance,
        CAST(dense_rank() OVER (ORDER BY count(trip_id) DESC) AS INTEGER) AS demand_rank,
        CAST(dense_rank() OVER (ORDER BY sum(CAST(total_amount AS DECIMAL(18,4))) DESC) AS INTEGER) AS revenue_rank
        FROM trips JOIN zones ON pickup_zone = zone_id GROUP BY 1, 2 ORDER BY demand_rank, zone_name, borough LIMIT 20""",
    ),
    "dow_hour_heatmap": over(
        "trips",
        f"""SELECT CAST(dayofweek(pickup_dt) AS INTEGER) AS day_of_week, strftime(pickup_dt, '%a') AS day_name,
        CAST(hour(pickup_dt) AS INTEGER) AS hour_of_day, count(*) AS trip_count, {AVG_MONEY('fare_amount')} AS avg_fare,
        {AVG_MILES('trip_distance')} AS avg_distance FROM trips GROUP BY 1, 2, 3""",
    ),
    "heatmap_pivot": over(
        "trips",
        "SELECT CAST(dayofweek(pickup_dt) AS INTEGER) AS day_of_week, "
        + ", ".join(
            f"CAST(sum(CASE WHEN hour(pickup_dt) = {h} THEN 1 END) AS BIGINT) AS h{h:02d}" for h in range(24)
        )
        + " FROM trips GROUP BY 1",
    ),
    "event_before_after": over(
        "trips civic_events",
        event_report(
            """SELECT event_date, event_name, est_attendance, daily_trips AS trips,
            lag(daily_trips) OVER (ORDER BY event_date, event_name) AS before,
            lead(daily_trips) OVER (ORDER BY event_date, event_name) AS after
            FROM civic_events JOIN daily ON trip_date = event_date WHERE is_major"""
        ),
        daily=DAILY,
    ),
    "event_before_after_calendar": over(
        "trips civic_events",
        event_report(
            """SELECT event_date, event_name, est_attendance, d.daily_trips AS trips, p.daily_trips AS before,
            n.daily_trips AS after FROM civic_events JOIN daily d ON d.trip_date = event_date
            LEFT JOIN daily p ON p.trip_date = event_date - 1 LEFT JOIN daily n ON n.trip_date = event_date + 1 WHERE is_major"""
        ),
        daily=DAILY,
    ),
    "monthly_revenue_mom": over(
        "day_trips",
        f"""SELECT month, trips, revenue, lag(revenue) OVER (ORDER BY month) AS prev_month_revenue,
        {PCT('revenue - lag(revenue) OVER (ORDER BY month)', 'lag(revenue) OVER (ORDER BY month)', 1)} AS revenue_mom_growth_pct
        FROM monthly""",
        monthly=MONTHLY,
    ),
    "monthly_cumulative": over(
        "day_trips",
        f"""SELECT month, trips AS monthly_trips, revenue AS monthly_revenue,
        CAST(sum(trips) OVER (ORDER BY month) AS BIGINT) AS cumulative_trips,
        {R('sum(amount) OVER (ORDER BY month)', 2)} AS cumulative_revenue,
        lag(trips) OVER (ORDER BY month) AS prev_month_trips,
        {PCT('trips - lag(trips) OVER (ORDER BY month)', 'lag(trips) OVER (ORDER BY month)', 1)} AS mom_trip_growth_pct
        FROM monthly""",
        monthly=MONTHLY,
    ),
    "zone_rain_share": over(
        "trips weather_hourly zones",
        f"""SELECT zone_name, borough, count(trip_id) FILTER (WHERE is_raining) AS rainy_trips,
        count(trip_id) FILTER (WHERE NOT is_raining) AS clear_trips,
        {PCT('count(trip_id) FILTER (WHERE is_raining)', 'count(trip_id)', 1)} AS rainy_trip_pct
        FROM trips JOIN weather_hourly ON {HOUR} = obs_dt JOIN zones ON pickup_zone = zone_id
        GROUP BY 1, 2 HAVING count(trip_id) > 100 ORDER BY rainy_trip_pct DESC, zone_name, borough LIMIT 20""",
    ),
    "precipitation_buckets": over(
        "trips weather_hourly",
        f"""SELECT CASE WHEN precipitation_mm = 0 THEN '0 mm (Dry)' WHEN precipitation_mm < 2 THEN '0.1–2 mm (Light)'
        WHEN precipitation_mm < 10 THEN '2–10 mm (Moderate)' ELSE '10+ mm (Heavy)' END AS precipitation_bucket,
        count(trip_id) AS total_trips, {AVG_MONEY('fare_amount')} AS avg_fare,
        {PCT('count(trip_id)', 'sum(count(trip_id)) OVER ()', 2)} AS pct_of_trips, {AVG_MILES('trip_distance')} AS avg_distance
        FROM trips JOIN weather_hourly ON {HOUR} = obs_dt GROUP BY 1""",
    ),
    "weekly_running_total": over(
        "trips",
        """SELECT date_trunc('week', pickup_dt)::TIMESTAMP AS week_start, pickup_zone, count(*) AS weekly_trips,
        CAST(sum(count(*)) OVER (PARTITION BY pickup_zone ORDER BY date_trunc('week', pickup_dt)) AS BIGINT) AS cumulative_trips,
        CAST(row_number() OVER (PARTITION BY pickup_zone ORDER BY date_trunc('week', pickup_dt)) AS INTEGER) AS week_number
        FROM trips GROUP BY date_trunc('week', pickup_dt), pickup_zone""",
    ),
    "top_od_pairs": over(
        "trips zones",
        f"""SELECT pz.zone_name AS pickup_zone_name, dz.zone_name AS dropoff_zone_name, pz.borough AS pickup_borough,
        dz.borough AS dropoff_borough, count(*) AS trip_count, {AVG_MILES('trip_distance')} AS avg_distance,
        {AVG_MONEY('fare_amount')} AS avg_fare FROM trips JOIN zones pz ON pickup_zone = pz.zone_id
        JOIN zones dz ON dropoff_zone = dz.zone_id WHERE pickup_zone <> dropoff_zone GROUP BY 1, 2, 3, 4 HAVING count(*) > 10
        ORDER BY trip_count DESC, 1, 2, 3, 4 LIMIT 30""",
    ),
    "hour_context": over(
        "trips weather_hourly civic_events economic",
        f"""SELECT {HOUR} AS hour_bucket, count(trip_id) AS trip_count, {AVG_MONEY('fare_amount')} AS avg_fare, temperature_f,
        precipitation_mm, windspeed_mph, CASE WHEN is_raining THEN 'Rain' WHEN is_snowing THEN 'Snow' ELSE 'Dry' END AS weather_type,
        coalesce(event_name, 'None') AS event, coalesce(est_attendance, 0) AS event_attendance, unemployment_rate, gas_price_avg
        FROM trips LEFT JOIN weather_hourly ON {HOUR} = obs_dt LEFT JOIN civic_events ON CAST(pickup_dt AS DATE) = event_date
        LEFT JOIN economic ON CAST(date_trunc('month', pickup_dt) AS DATE) = month_start
        GROUP BY {HOUR}, temperature_f, precipitation_mm, windspeed_mph, is_raining, is_snowing, event_name, est_attendance,
        unemployment_rate, gas_price_avg""",
    ),
    "hour_zone_context": over(
        "trips zones weather_hourly civic_events economic",
        f"""SELECT {HOUR} AS hour_bucket, pickup_zone AS zone_id, zone_name, zones.borough AS borough, count(trip_id) AS trip_count,
        {SUM_MONEY('total_amount')} AS revenue, temperature_f, precipitation_mm, coalesce(event_name, 'None') AS event_name,
        coalesce(CAST(is_major AS VARCHAR), 'false') AS is_major_event, unemployment_rate, gas_price_avg
        FROM trips LEFT JOIN zones ON pickup_zone = zone_id LEFT JOIN weather_hourly ON {HOUR} = obs_dt
        LEFT JOIN civic_events e ON CAST(pickup_dt AS DATE) = event_date
        LEFT JOIN economic ON CAST(date_trunc('month', pickup_dt) AS DATE) = month_start
        GROUP BY {HOUR}, pickup_zone, zone_name, zones.borough, temperature_f, precipitation_mm, e.event_name, is_major,
        unemployment_rate, gas_price_avg""",
    ),
    "demand_by_hour": over(
        "mart",
        f"""SELECT hour_of_day, {R('avg(trip_count)', 6)} AS avg_trips, {R('stddev_samp(trip_count)', 6)} AS std_trips
        FROM mart GROUP BY 1""",
    ),
    "temperature_bins": over(
        "mart",
        f"""SELECT round_even(temperature_f / 10, 0) * 10 AS temp_bin, {R('avg(trip_count)', 6)} AS avg_trips, count(*) AS n_hours
        FROM mart WHERE temperature_f BETWEEN -20 AND 120 GROUP BY 1 HAVING count(*) > 10""",
    ),
    "demand_by_weather": over(
        "mart",
        f"""SELECT {IMPACT.format(mid='Cloudy', drizzle=RAIN_SNOW)} AS weather_type, {R('avg(trip_count)', 6)} AS avg_trips,
        count(*) AS n_obs FROM mart WHERE weather_code IS NOT NULL GROUP BY 1""",
    ),
    "mart_health": over(
        "mart",
        f"""SELECT count(*) AS total_rows, count(DISTINCT zone_id) AS zones, count(DISTINCT CAST(hour_bucket AS DATE)) AS days,
        {R('avg(trip_count)', 6)} AS avg_demand, count(*) FILTER (WHERE temperature_f IS NULL) AS missing_weather,
        count(*) FILTER (WHERE unemployment_rate IS NULL) AS missing_econ,
        {PCT('count(*) FILTER (WHERE temperature_f IS NULL)', 'count(*)', 2)} AS missing_weather_pct,
        {PCT('count(*) FILTER (WHERE unemployment_rate IS NULL)', 'count(*)', 2)} AS missing_econ_pct FROM mart""",
    ),
    "data_range": over("mart", "SELECT min(hour_bucket) AS dt_min, max(hour_bucket) AS dt_max FROM mart"),
    "zone_hourly_series": over(
        "mart",
        """SELECT hour_bucket, trip_count FROM mart WHERE zone_id = 5 AND hour_bucket >= TIMESTAMP '2024-01-03'
        AND hour_bucket <= TIMESTAMP '2024-01-20'""",
    ),
    "period_slice": over(
        "mart",
        f"""SELECT hour_bucket, zone_id, hour_of_day, day_of_week, month, is_weekend, temperature_f, precipitation_mm, windspeed_mph,
        humidity_pct, is_raining, is_snowing, has_major_event, event_attendance, trip_count FROM mart
        WHERE hour_bucket >= TIMESTAMP '{CUR[0]}' AND hour_bucket < TIMESTAMP '{CUR[1]}'""",
    ),
    "top_zone_filter": over(
        "mart zones",
        """SELECT hour_bucket, zone_id, trip_count, hour_of_day, day_of_week, month, is_weekend FROM mart
        WHERE zone_id IN (SELECT zone_id FROM zones WHERE borough IN ('ASIA', 'EUROPE'))""",
    ),
    "zone_name_lookup": over(
        "raw_trips zones",
        """SELECT pickup_zone AS zone_id, trip_id, zone_name FROM raw_trips LEFT JOIN zones ON pickup_zone = zone_id
        WHERE fare_amount > 0 AND trip_distance > 0""",
    ),
    "demand_lags": over(
        "counts",
        f"""SELECT hour_bucket, zone_id, trip_count, lag(trip_count, 24) OVER {ZONE_ROWS.format(frame='')} AS demand_lag_24h,
        lag(trip_count, 168) OVER {ZONE_ROWS.format(frame='')} AS demand_lag_168h FROM counts""",
    ),
    "demand_lags_filled": over(
        "counts",
        "SELECT hour_bucket, zone_id, trip_count, "
        + ", ".join(
            R(f"coalesce(lag(trip_count, {n}) OVER {ZONE_ROWS.format(frame='')}, (SELECT avg(trip_count) FROM counts))", 6)
            + f" AS demand_lag_{n}h"
            for n in (24, 168)
        )
        + " FROM counts",
    ),
    "demand_lags_calendar": over(
        "counts",
        """SELECT c.hour_bucket, c.zone_id, c.trip_count, d.trip_count AS demand_lag_24h, w.trip_count AS demand_lag_168h FROM counts c
        LEFT JOIN counts d ON d.zone_id = c.zone_id AND d.hour_bucket = c.hour_bucket - INTERVAL 24 HOUR
        LEFT JOIN counts w ON w.zone_id = c.zone_id AND w.hour_bucket = c.hour_bucket - INTERVAL 168 HOUR""",
    ),
    "rolling_7d": over(
        "counts",
        "SELECT hour_bucket, zone_id, trip_count, "
        + R(f"avg(trip_count) OVER {ZONE_ROWS.format(frame='ROWS BETWEEN 167 PRECEDING AND CURRENT ROW')}", 6)
        + " AS demand_rolling_7d_avg FROM counts",
    ),
    "fill_economic": over(
        "day_trips monthly_series",
        f"""SELECT month_start, {fill('unemployment_rate')}, {fill('gas_price_avg')}, {fill('consumer_sentiment')}
        FROM (SELECT DISTINCT CAST(date_trunc('month', pickup_dt) AS DATE) AS month_start FROM day_trips)
        LEFT JOIN monthly_series USING (month_start)""",
    ),
    "features_train": over("mart", TRAIN_FEATURES, filled=FILLED, lagged=LAGGED),
    "features_fit_apply": over(
        "day_counts split_point monthly_series",
        TRAIN_FEATURES.replace("SELECT hour_bucket, zone_id, trip_count,", "SELECT hour_bucket, zone_id, trip_count, split,"),
        **FIT_VIEWS,
    ),
    **{
        f"{key}_rows": over("test", "SELECT hour_bucket, zone_id, trip_count AS actual, TRUE AS non_negative FROM test")
        for key in (
            "random_forest", "random_forest_deep", "boosted_a", "boosted_b", "linear_regression", "early_stopping", "tuned_model",
        )
    },
    "search_facts": "SELECT CAST(i AS INTEGER) AS place, TRUE AS all_drawn, TRUE AS in_order, TRUE AS patient FROM range(50) t(i)",
    "run_facts": """SELECT unnest(['historical_average', 'linear', 'random_forest', 'random_forest_deep', 'boosted_a', 'boosted_b', 'early_stopping']) AS model,
        TRUE AS measured, TRUE AS timed, FALSE AS baseline_best, CAST(1 AS BIGINT) AS n_best""",
    "stored_comparison_facts": over(
        "baseline",
        f"""SELECT model, (SELECT count(*) FROM baseline) AS n, TRUE AS agrees,
        CASE WHEN model = 'historical_average' THEN
            (SELECT {R('sqrt(avg((trip_count - prediction) * (trip_count - prediction)))', 4)} FROM baseline) END AS rmse,
        CASE WHEN model = 'historical_average' THEN
            (SELECT {R('avg(abs(trip_count - prediction))', 4)} FROM baseline) END AS mae
        FROM (SELECT unnest(['historical_average', 'linear', 'random_forest', 'random_forest_deep', 'boosted_a', 'boosted_b',
        'early_stopping']) AS model)""",
    ),
    "importance_facts": "SELECT unnest(['feature_importance', 'global_importance']) AS report, CAST(15 AS BIGINT) AS n_rows, CAST(15 AS BIGINT) AS n_features",
    "forecast_rows": over(
        "test",
        """SELECT hour_bucket, trip_count AS actual, TRUE AS forecast FROM test WHERE zone_id = 5
        ORDER BY hour_bucket LIMIT 336""",
    ),
    "scored_requests": over(
        "request_rows zones",
        """SELECT request_id, zone_name, 5 AS n_factors, TRUE AS banded FROM request_rows LEFT JOIN zones USING (zone_id)""",
    ),
    **{
        f"{key}_gaps": over("test", "SELECT hour_bucket, zone_id, 24 AS n_features, TRUE AS adds_up FROM test")
        for key in ("tree_attribution", "forest_attribution")
    },
    "dependence_values": over(
        "day_counts split_point monthly_series",
        f"SELECT hour_bucket, zone_id, {R('temperature_f', 6)} AS value, TRUE AS explained FROM filled WHERE split = 'test'",
        **FIT_VIEWS,
    ),
    "dependence_counts": over(
        "day_counts split_point monthly_series",
        "SELECT floor(temperature_f / 5) * 5 AS bin, count(*) AS n FROM filled WHERE split = 'test' GROUP BY 1",
        **FIT_VIEWS,
    ),
    "waterfall_facts": over(
        "test",
        """SELECT hour_bucket, zone_id, CAST(10 AS BIGINT) AS n_lines, CAST(10 AS BIGINT) AS n_features FROM test
        WHERE zone_id = 5 AND day_of_week = 5 AND hour_of_day = 0 ORDER BY hour_bucket LIMIT 1""",
    ),
    "features_serve": over(
        "request_rows",
        f"""SELECT request_id, {TRIG}, {FLAGS}, {', '.join(f'{R(c, 6)} AS {c}' for c in WX)},
        CAST(200 AS DOUBLE) AS demand_lag_24h, CAST(200 AS DOUBLE) AS demand_lag_168h, CAST(200 AS DOUBLE) AS demand_rolling_7d_avg,
        unemployment_rate, gas_price_avg, consumer_sentiment FROM request_rows""",
    ),
    "feature_nulls": over(
        "mart",
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM matrix"
            for c in (
                "hour_sin hour_cos dow_sin dow_cos month_sin month_cos is_weekend is_rush_hour temperature_f feels_like_f "
                "precipitation_mm windspeed_mph humidity_pct is_raining is_snowing weather_severity has_major_event "
                "event_attendance demand_lag_24h demand_lag_168h demand_rolling_7d_avg unemployment_rate gas_price_avg "
                "consumer_sentiment"
            ).split()
        ),
        filled=FILLED,
        lagged=LAGGED,
        matrix=TRAIN_FEATURES,
    ),
    "validate_requests": over("checked", "SELECT *, errors = '' AS accepted FROM checked"),
    "request_rows": over("request_rows", "SELECT * FROM request_rows"),
    "request_rows_monday": over(
        "request_rows", "SELECT * REPLACE (CAST((dayofweek(request_dt) + 6) % 7 AS INTEGER) AS day_of_week) FROM request_rows"
    ),
    "safe_numbers": f"""SELECT event_id, CASE WHEN event_id % 10 < 4 THEN 0 ELSE {R('value / 7', 4)} END AS shown FROM events""",
    "temporal_split": over(
        "train test",
        """SELECT hour_bucket, zone_id, trip_count, 'train' AS split FROM train UNION ALL
        SELECT hour_bucket, zone_id, trip_count, 'test' FROM test""",
    ),
    "fallback_split": over(
        "counts",
        """SELECT hour_bucket, zone_id, trip_count, CASE WHEN row_number() OVER (ORDER BY hour_bucket, zone_id) - 1
        < floor((count(*) OVER ()) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM counts""",
    ),
    "validation_tail": over(
        "train", "SELECT hour_bucket, zone_id, trip_count, split FROM parts", parts=FIT_PARTS
    ),
    "historical_average": over(
        "counts",
        f"SELECT zone_id, hour_of_day, day_of_week, {R('avg(trip_count)', 6)} AS avg_trips FROM counts GROUP BY 1, 2, 3",
    ),
    "baseline_predictions": over(
        "baseline",
        f"""SELECT hour_bucket, zone_id, trip_count AS actual, hour_of_day, day_of_week, month, is_weekend,
        {R('prediction', 6)} AS prediction FROM baseline""",
    ),
    "regression_metrics": over(
        "baseline", f"SELECT {METRICS} FROM (SELECT trip_count::DOUBLE AS actual, prediction FROM baseline)"
    ),
    "model_comparison": over(
        "counts",
        f"SELECT model, {R('rmse', 2)} AS rmse, {R('mae', 2)} AS mae, {R('mape', 2)} AS mape, {R('r2', 3)} AS r2 FROM scored",
        predicted=PREDICTED,
        scored=SCORED,
    ),
    "best_model": over(
        "counts",
        "SELECT * FROM scored WHERE model <> 'historical_average' ORDER BY rmse, model LIMIT 1",
        predicted=PREDICTED,
        scored=SCORED,
    ),
    "prediction_interval": over(
        "baseline",
        """SELECT hour_bucket, zone_id, greatest(0, CAST(round_even(prediction, 0) AS BIGINT)) AS predicted_trips,
        greatest(0, CAST(trunc(prediction - prediction * CAST(0.15 AS DOUBLE) * CAST(1.28 AS DOUBLE)) AS BIGINT)) AS interval_low,
        greatest(0, CAST(trunc(prediction + prediction * CAST(0.15 AS DOUBLE) * CAST(1.28 AS DOUBLE)) AS BIGINT)) AS interval_high
        FROM baseline""",
    ),
    "interval_calibrated": over(
        "train test",
        f"""SELECT hour_bucket, zone_id, actual, {R('prediction', 8)} AS prediction,
        greatest(0, {R('prediction + q_low', 8)}) AS interval_low, greatest(0, {R('prediction + q_high', 8)}) AS interval_high
        FROM (SELECT hour_bucket, zone_id, trip_count AS actual, prediction FROM scored) LEFT JOIN bands USING (zone_id)""",
        parts=FIT_PARTS,
        checked_rows=averaged("SELECT * FROM parts WHERE split = 'validation'"),
        bands=f"""SELECT zone_id, quantile_cont({R('trip_count - prediction', 6)}, CAST(0.1 AS DOUBLE)) AS q_low,
        quantile_cont({R('trip_count - prediction', 6)}, CAST(0.9 AS DOUBLE)) AS q_high FROM checked_rows GROUP BY 1""",
        scored=averaged("SELECT * FROM test"),
    ),
    "drift_numeric": over("mart", NUMERIC_DRIFT, **DRIFT_VIEWS),
    "drift_categorical": over("mart", CATEGORY_DRIFT, labelled=LABELLED, category=CATEGORY),
    "drift_summary": over(
        "mart",
        f"""SELECT count(*) AS n_features, CAST(sum(CAST(drifted AS INTEGER)) AS BIGINT) AS n_drifted,
        {R('sum(CAST(drifted AS INTEGER)) / count(*)', 6)} AS drift_share, sum(CAST(drifted AS INTEGER)) / count(*) >= 0.5 AS dataset_drift
        FROM (SELECT drifted FROM numeric_part UNION ALL SELECT drifted FROM category_part)""",
        **DRIFT_VIEWS,
        category=CATEGORY,
        numeric_part=NUMERIC_DRIFT,
        category_part=CATEGORY_DRIFT,
    ),
}

ORACLES["aligned_features"] = (
    "SELECT * REPLACE (CAST(0 AS DOUBLE) AS humidity_pct, CAST(0 AS DOUBLE) AS demand_lag_168h) "
    f"FROM ({ORACLES['features_serve']})"
)


# Dates are shown as midnight timestamps and optional counts as doubles.
SHOWN = {
    "ml_features": {"weather_code": "DOUBLE"},
    "ml_features_fanout": {"weather_code": "DOUBLE"},
    "ml_features_lags": {
        c: "DOUBLE" for c in ("weather_code", "is_raining", "is_snowing", "demand_lag_24h", "demand_lag_168h")
    },
    "economic_from_json": {"month_start": "TIMESTAMP"},
    "events_dedup": {"event_date": "TIMESTAMP"},
    "civic_events_csv": {"event_date": "TIMESTAMP"},
    **{k: {"event_date": "TIMESTAMP"} for k in ("events_fallback", "events_with_curated", "replaced_events", "reloaded_events")},
    "recent_indicators": {"month_start": "TIMESTAMP"},
    "event_deviation": {"trip_date": "TIMESTAMP"},
    "event_before_after": {"event_date": "TIMESTAMP", "trips_day_before": "DOUBLE", "trips_day_after": "DOUBLE"},
    "event_before_after_calendar": {
        "event_date": "TIMESTAMP",
        "trips_day_before": "DOUBLE",
        "trips_day_after": "DOUBLE",
    },
    "monthly_revenue_mom": {"month": "TIMESTAMP"},
    "monthly_cumulative": {"month": "TIMESTAMP", "prev_month_trips": "DOUBLE"},
    "demand_lags": {"demand_lag_24h": "DOUBLE", "demand_lag_168h": "DOUBLE"},
    "demand_lags_calendar": {"demand_lag_24h": "DOUBLE", "demand_lag_168h": "DOUBLE"},
    "fill_economic": {"month_start": "TIMESTAMP"},
}
for _key, _types in SHOWN.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _types.items())
    ORACLES[_key] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_key]})"
