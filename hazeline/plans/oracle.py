"""SQL twins of the registered queries, for checking results on another engine."""

from __future__ import annotations

from hazeline.functions import constants as K
from hazeline.plans.archived import ORACLE as ARCHIVED

ORACLE: dict[str, str] = dict(ARCHIVED)

M = "SELECT event_id, ts AS datetime, user_id AS sensor_id, event_type, value AS pm25 FROM events"
S = """SELECT s_suppkey AS sensor_id, s_nationkey AS station_id, n_name AS district_slug, r_name AS area
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_ONCE = """SELECT event_id, ts AS datetime, user_id AS sensor_id, event_type,
CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' AND value < 5 THEN -value
     WHEN value > 250 THEN value + 1000 ELSE value END AS pm25 FROM events"""
D = f"{_ONCE} UNION ALL SELECT * FROM ({_ONCE}) WHERE event_type = 'purchase'"
G = """SELECT event_id, ts AS datetime, user_id AS sensor_id, event_type,
CASE WHEN event_type IN ('click', 'view') THEN value END AS pm25 FROM events"""
B = """SELECT l_orderkey, l_linenumber, l_shipdate AS datetime, l_suppkey AS sensor_id, l_quantity AS pm25
FROM lineitem"""
CTES = {"m": M, "s": S, "d": D, "g": G, "b": B}


def using(names: str, body: str) -> str:
    """Prefix ``body`` with the adapter views it needs (one letter each)."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n]})" for n in names) + " " + body


def rd(expr: str, digits: int = 4) -> str:
    scale = f"1e{digits}"
    steps = f"CAST({expr} AS DOUBLE) * {scale}"
    return f"floor({steps} + 0.5 + abs({steps}) * 1e-12) / {scale}"


def steps_case(expr: str, steps, above: str) -> str:
    whens = " ".join(f"WHEN {expr} <= {bound} THEN '{text}'" for bound, text in steps)
    return f"CASE {whens} ELSE '{above}' END"


def band(expr: str) -> str:
    known = steps_case(expr, [(b, t) for b, t, _ in K.RISK_BANDS], K.RISK_TOP[0])
    return f"CASE WHEN {expr} > 0 THEN {known} ELSE 'Unknown' END"


def message(expr: str) -> str:
    known = steps_case(expr, [(b, t) for b, _, t in K.RISK_BANDS], K.RISK_TOP[1])
    return f"CASE WHEN {expr} > 0 THEN {known} END"


def category(expr: str) -> str:
    return steps_case(expr, [(b, t) for b, t, _ in K.ESTIMATOR_CATEGORIES], K.ESTIMATOR_TOP[0])


def color(expr: str) -> str:
    return steps_case(expr, [(b, t) for b, _, t in K.ESTIMATOR_CATEGORIES], K.ESTIMATOR_TOP[1])


def rr(expr: str, coef: float) -> str:
    return f"CASE WHEN {expr} > 5 THEN pow({coef}, ({expr} - 5) / 10) END"


def excess(expr: str, coef: float) -> str:
    return rd(f"({rr(expr, coef)} - 1) * 100", 1)


def recommend(expr: str) -> str:
    return f"CASE WHEN {expr} IS NOT NULL THEN {steps_case(expr, K.RECOMMENDATIONS, K.RECOMMENDATION_TOP)} END"


def advice(profile: str, expr: str) -> str:
    whens = " ".join(f"WHEN {profile} = '{p}' THEN {steps_case(expr, steps, above)}"
                     for p, (steps, above) in K.PROFILE_ADVICE.items())
    return f"CASE {whens} END"


def share(cond: str) -> str:
    return f"100 * avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


def box(table: str, group: str) -> str:
    return f"""q AS (SELECT {group}, quantile_cont(pm25, 0.25) AS q1, quantile_cont(pm25, 0.5) AS median,
quantile_cont(pm25, 0.75) AS q3 FROM {table} WHERE {group} IS NOT NULL GROUP BY {group}),
f AS (SELECT x.{group}, pm25, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
FROM {table} x JOIN q ON x.{group} = q.{group} WHERE pm25 IS NOT NULL)"""


BOX_OUT = f"""SELECT district_slug, {rd('q1')} AS q1, {rd('median')} AS median, {rd('q3')} AS q3, count(*) AS count,
{rd('least(min(CASE WHEN pm25 >= lo THEN pm25 END), q1)')} AS whisker_low,
{rd('greatest(max(CASE WHEN pm25 <= hi THEN pm25 END), q3)')} AS whisker_high,
count(CASE WHEN pm25 < lo OR pm25 > hi THEN 1 END) AS outliers
FROM f GROUP BY district_slug, q1, median, q3"""


def daily_stats(table: str, min_rows: int, extra: str = "") -> str:
    return f"""SELECT CAST(x.datetime AS DATE) AS date, x.sensor_id, station_id, area,
{rd('avg(pm25)', 2)} AS pm25_mean, {rd('stddev_samp(pm25)', 2)} AS pm25_std, {rd('min(pm25)', 2)} AS pm25_min,
{rd('max(pm25)', 2)} AS pm25_max, count(pm25) AS measurements_count{extra}
FROM {table} x JOIN s ON x.sensor_id = s.sensor_id GROUP BY ALL HAVING count(pm25) >= {min_rows}"""


_m, _v = "avg(pm25)", "pm25"

ORACLE["daily_sensor_stats"] = using("ms", f"""
, v AS (SELECT * FROM m WHERE pm25 IS NOT NULL AND pm25 >= 0 AND pm25 < 1000),
t AS ({daily_stats('v', 4)}) SELECT *, {band('pm25_mean')} AS risk_level FROM t""")
ORACLE["daily_type_stats"] = using("m", f"""
SELECT CAST(datetime AS DATE) AS date, event_type, {rd(_m)} AS pm25_mean, {rd('stddev_samp(pm25)')} AS pm25_std,
{rd('min(pm25)')} AS pm25_min, {rd('max(pm25)')} AS pm25_max, count(pm25) AS measurements_count
FROM m GROUP BY 1, 2 HAVING count(pm25) >= 18""")
ORACLE["city_daily_mean"] = using("m", f"""
SELECT CAST(datetime AS DATE) AS date, {rd(_m)} AS pm25_mean FROM m GROUP BY 1""")
ORACLE["hourly_profile"] = using("m", f"""
SELECT CAST(extract(hour FROM datetime) AS INTEGER) AS hour, {rd(_m)} AS pm25_mean,
{rd('stddev_samp(pm25)')} AS pm25_std, {rd('avg(pm25) - stddev_samp(pm25)')} AS pm25_lower,
{rd('avg(pm25) + stddev_samp(pm25)')} AS pm25_upper FROM m GROUP BY 1""")
ORACLE["district_top10"] = using("ms", f"""
SELECT district_slug, {rd(_m, 2)} AS mean, {rd('stddev_samp(pm25)', 2)} AS std, count(pm25) AS count
FROM m JOIN s USING (sensor_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
ORACLE["district_top8"] = using("ms", f"""
, t AS (SELECT district_slug AS district, avg(pm25) AS mean FROM m JOIN s USING (sensor_id) GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 8) SELECT district, {rd('mean')} AS mean FROM t""")
ORACLE["station_mean"] = using("ms", f"""
SELECT station_id, {rd(_m)} AS mean FROM m JOIN s USING (sensor_id) GROUP BY 1""")
ORACLE["sensor_location_mean"] = using("ms", f"""
SELECT sensor_id, station_id, area, {rd(_m)} AS mean FROM m JOIN s USING (sensor_id) GROUP BY 1, 2, 3""")


def summary_sql(table: str) -> str:
    pcts = ", ".join(f"{rd(f'quantile_cont(pm25, {p / 100})')} AS p{p}" for p in K.PERCENTILES)
    return f"""SELECT count(pm25) AS count, {rd(_m)} AS mean, {rd('stddev_samp(pm25)')} AS std,
{rd('min(pm25)')} AS min, {rd('max(pm25)')} AS max, {rd('quantile_cont(pm25, 0.5)')} AS median, {pcts}
FROM {table} WHERE pm25 >= 0"""


def describe_sql(group: str = "") -> str:
    return f"""SELECT {group + ',' if group else ''} count(pm25) AS count, {rd(_m)} AS mean,
{rd('stddev_samp(pm25)')} AS std, {rd('min(pm25)')} AS min, {rd('max(pm25)')} AS max,
{rd('quantile_cont(pm25, 0.25)')} AS p25, {rd('quantile_cont(pm25, 0.5)')} AS p50,
{rd('quantile_cont(pm25, 0.75)')} AS p75 FROM m {'GROUP BY ' + group if group else ''}"""


ORACLE["summary_percentiles"] = using("d", summary_sql("d"))
ORACLE["describe"] = using("m", describe_sql())
ORACLE["describe_per_sensor"] = using("m", describe_sql("sensor_id"))
ORACLE["exceedance"] = using("d", f"""
SELECT sensor_id, {rd(share('pm25 > 5'), 1)} AS pct_above_guideline, {rd(share('pm25 > 25'), 1)} AS pct_hazardous,
count(*) AS data_points FROM d GROUP BY 1""")
ORACLE["exceedance_flags"] = using("d", """
SELECT event_id, coalesce(pm25 > 5, false) AS above_guideline, coalesce(pm25 > 25, false) AS hazardous FROM d""")
ORACLE["top_sensors_by_count"] = using("m", """
SELECT sensor_id, count(*) AS measurements FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
ORACLE["top_sensors_by_mean"] = using("m", f"""
, t AS (SELECT sensor_id, avg(pm25) AS mean FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT sensor_id, {rd('mean')} AS mean FROM t""")
ORACLE["distinct_and_range"] = using("ms", """
SELECT min(datetime) AS first_time, max(datetime) AS last_time, count(DISTINCT sensor_id) AS distinct_sensor_id,
count(DISTINCT station_id) AS distinct_station_id FROM m LEFT JOIN s USING (sensor_id)""")
ORACLE["data_quality"] = using("d", f"""
, t AS (SELECT count(*) AS n, count(*) - count(pm25) AS mis, count(CASE WHEN pm25 < 0 THEN 1 END) AS neg FROM d)
SELECT n AS total_rows, mis AS missing, {rd('100.0 * mis / n', 1)} AS missing_pct, neg AS negative,
{rd('100.0 * neg / n', 1)} AS negative_pct FROM t""")

LATEST = "(SELECT sensor_id, arg_max(pm25, datetime) AS pm25 FROM m GROUP BY 1)"
ORACLE["live_summary"] = using("m", f"""
SELECT {rd(_m)} AS avg_pm25, {rd('max(pm25)')} AS max_pm25, {rd('min(pm25)')} AS min_pm25, count(pm25) AS sensor_count
FROM {LATEST} WHERE pm25 <> 0""")
ORACLE["sensors_by_district"] = using("s", """
SELECT district_slug, sensor_id, count(*) OVER (PARTITION BY district_slug) AS sensors_in_district,
count(*) OVER () AS total_sensors FROM s""")


def histogram_sql(table: str, bins: int = 50) -> str:
    edge = f"lo + i * ((hi - lo) / {bins})"
    above = f"lo + (i + 1) * ((hi - lo) / {bins})"
    return f""", r AS (SELECT CASE WHEN min(pm25) = max(pm25) THEN min(pm25) - 0.5 ELSE min(pm25) END AS lo,
CASE WHEN min(pm25) = max(pm25) THEN max(pm25) + 0.5 ELSE max(pm25) END AS hi FROM {table}),
a AS (SELECT pm25 AS v, lo, hi, CAST(least(floor((pm25 - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) AS i
FROM {table}, r WHERE pm25 IS NOT NULL),
c AS (SELECT CASE WHEN v < {edge} THEN i - 1 WHEN v >= {above} AND i < {bins - 1} THEN i + 1 ELSE i END AS bin,
count(*) AS n FROM a GROUP BY 1)
SELECT k.bin, {rd(f'lo + k.bin * ((hi - lo) / {bins})')} AS bin_start,
{rd(f'CASE WHEN k.bin = {bins - 1} THEN hi ELSE lo + (k.bin + 1) * ((hi - lo) / {bins}) END')} AS bin_end,
coalesce(c.n, 0) AS frequency
FROM (SELECT range AS bin FROM range({bins})) k LEFT JOIN c ON k.bin = c.bin, r"""


ORACLE["histogram50"] = using("m", histogram_sql("m"))
ORACLE["district_boxplot"] = using("ms", f"""
, p AS (SELECT * FROM m JOIN s USING (sensor_id)), {box('p', 'district_slug')} {BOX_OUT}""")
ORACLE["boxplot_outliers"] = using("ms", f"""
, p AS (SELECT * FROM m JOIN s USING (sensor_id)), {box('p', 'district_slug')}
SELECT district_slug, pm25 AS value, count(*) AS n FROM f WHERE pm25 < lo OR pm25 > hi GROUP BY 1, 2""")

ORACLE["risk_bands"] = using("d", f"""
SELECT event_id, {band(_v)} AS risk_level, {message(_v)} AS risk_message FROM d""")
ORACLE["category_estimator"] = using("d", f"SELECT event_id, {category(_v)} AS category, {color(_v)} AS color FROM d")
ORACLE["excess_risk_short"] = using("m", "SELECT event_id, " + ", ".join(
    f"{excess(_v, c)} AS {n}_excess_pct" for n, c, _ in K.RISK_COEFFICIENTS if n in K.SHORT_OUTCOMES) + " FROM m")
_DAILY = "(SELECT CAST(datetime AS DATE) AS date, avg(pm25) AS x FROM m GROUP BY 1)"
ORACLE["excess_risk_long"] = using("m", " UNION ALL ".join(
    f"""SELECT date, '{n}' AS outcome, {rd(rr('x', c), 3)} AS relative_risk, {excess('x', c)} AS excess_risk_percent,
'{t}' AS description FROM {_DAILY} WHERE x > 5""" for n, c, t in K.RISK_COEFFICIENTS))


def impact(expr: str) -> str:
    return ", ".join(f"{rd(f'1000000 * {r} * greatest(0, {expr} - 5)', 0)} AS {n}" for n, r in K.IMPACT_RATES)


ORACLE["population_impact"] = using("m", f"SELECT date, {impact('x')} FROM {_DAILY}")
ORACLE["recommendation_latest"] = using("m", f"SELECT sensor_id, pm25, {recommend(_v)} AS recommendation FROM {LATEST}")
ORACLE["profile_advice_latest"] = using("m", f"""
SELECT sensor_id, pm25, profile, {band(_v)} AS risk_level, {advice('profile', _v)} AS advice
FROM {LATEST} JOIN (VALUES {", ".join(f"('{p}')" for p in K.PROFILE_ADVICE)}) p(profile) ON true""")
_KIND = """CASE event_type WHEN 'click' THEN 'sensitive' WHEN 'view' THEN 'athlete' WHEN 'signup' THEN 'elderly'
ELSE 'parent' END"""
ORACLE["profile_advice_rows"] = using("m", f"""
, k AS (SELECT event_id, pm25, {_KIND} AS profile FROM m)
SELECT event_id, profile, {advice('profile', _v)} AS advice FROM k""")
ORACLE["district_names"] = using("s", "SELECT sensor_id, CASE district_slug " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in K.DISTRICT_NAMES.items()) + " ELSE district_slug END AS district FROM s")

HEALTH = f"""h AS (SELECT sensor_id, avg(pm25) AS x, {rd(_m, 2)} AS mean_pm25, {rd('max(pm25)', 2)} AS max_pm25,
{rd(share('pm25 > 5'), 1)} AS percent_above_guideline, {rd(share('pm25 > 25'), 1)} AS percent_hazardous,
count(*) AS data_points FROM m GROUP BY 1)"""
ORACLE["health_summary_sensors"] = using("ms", f"""
, {HEALTH} SELECT sensor_id, mean_pm25, max_pm25, {category('x')} AS air_quality_category,
{color('x')} AS category_color, percent_above_guideline, percent_hazardous, data_points, district_slug, area
FROM h LEFT JOIN s USING (sensor_id)""")
ORACLE["health_risks_long"] = using("m", f", {HEALTH} " + " UNION ALL ".join(
    f"SELECT sensor_id, '{n}' AS outcome, {rd(rr('x', c), 3)} AS relative_risk, {excess('x', c)} AS excess_risk_percent "
    f"FROM h WHERE x > 5" for n, c, _ in K.RISK_COEFFICIENTS))
ORACLE["health_rollup_city"] = using("m", f"""
, {HEALTH}, o AS (SELECT avg(mean_pm25) AS x, count(*) AS n FROM h)
SELECT {rd('x')} AS avg_pm25, n AS sensors, {impact('x')} FROM o""")


def report_sql() -> str:
    head = ["=" * 70, "HEALTH RISK ASSESSMENT REPORT", "=" * 70, "", "WHO Annual Guideline: 5 µg/m³",
            "WHO 24-hour Guideline: 15 µg/m³", ""]
    rows = [(-1, i, t) for i, t in enumerate(head)] + [(2**63 - 1, 0, ""), (2**63 - 1, 1, "=" * 70)]
    fixed = ", ".join(f"(CAST({s} AS BIGINT), {i}, '{t}')" for s, i, t in rows)
    body = ["''", "'Sensor ' || sensor_id || ' (' || coalesce(district_slug, 'Unknown') || '):'",
            "'  Mean PM2.5: ' || mean_pm25 || ' µg/m³'", "'  Max PM2.5: ' || max_pm25 || ' µg/m³'",
            f"'  Air Quality: ' || {category('x')}", "'  % Above WHO: ' || percent_above_guideline || '%'", "''"]
    risk = ["'  Excess Health Risks:'"]
    for n, c, _ in K.RISK_COEFFICIENTS:
        title = n.replace("_", " ").title()
        risk += [f"'    {title}:'", f"'      Relative Risk: ' || {rd(rr('x', c), 3)}",
                 f"'      Excess Risk: ' || {excess('x', c)} || '%'"]
    parts = [f"SELECT sensor_id AS section, {i} AS line_no, {t} AS text FROM p" for i, t in enumerate(body)]
    parts += [f"SELECT sensor_id, {i}, {t} FROM p WHERE x > 5" for i, t in enumerate(risk, len(body))]
    return f""", {HEALTH}, p AS (SELECT * FROM h LEFT JOIN s USING (sensor_id))
{" UNION ALL ".join(parts)} UNION ALL SELECT * FROM (VALUES {fixed}) t(section, line_no, text)"""


ORACLE["health_report_lines"] = using("ms", report_sql())

ORACLE["valid_readings"] = using("d", "SELECT event_id, pm25 FROM d WHERE pm25 >= 0 AND pm25 < 1000")
ORACLE["non_negative_readings"] = using("d", """
SELECT event_id, pm25 FROM d
WHERE pm25 >= 0 OR (pm25 IS NULL AND NOT EXISTS (SELECT 1 FROM d WHERE pm25 < 0))""")
ORACLE["recent_readings"] = using("m", """
SELECT event_id, datetime FROM m WHERE datetime >= (SELECT max(datetime) FROM m) - INTERVAL 7 DAY""")
ORACLE["calendar_parts"] = using("m", """
SELECT event_id, CAST(datetime AS DATE) AS date, CAST(extract(hour FROM datetime) AS INTEGER) AS hour FROM m""")
ORACLE["semi_allow_list"] = using("ms", "SELECT event_id FROM m WHERE sensor_id IN (SELECT sensor_id FROM s)")
ORACLE["district_lookup"] = using("ms", """
SELECT event_id, sensor_id, coalesce(district_slug, 'Unknown') AS district FROM m LEFT JOIN s USING (sensor_id)""")
ORACLE["join_left"] = using("ms", """
SELECT event_id, sensor_id, station_id, district_slug, pm25 FROM m LEFT JOIN s USING (sensor_id)""")
ORACLE["join_inner"] = using("ms", "SELECT event_id, district_slug FROM m JOIN s USING (sensor_id)")
ORACLE["join_right"] = using("m", """
SELECT event_id, c_custkey AS sensor_id, c_mktsegment FROM m RIGHT JOIN customer ON sensor_id = c_custkey""")
ORACLE["join_outer"] = using("ms", """
, p AS (SELECT * FROM m FULL JOIN s USING (sensor_id))
SELECT event_id, coalesce(sensor_id, c_custkey) AS sensor_id, area, c_mktsegment
FROM p FULL JOIN customer ON sensor_id = c_custkey""")
ORACLE["union_by_name"] = using("mb", """
SELECT event_id, sensor_id, pm25 FROM m UNION ALL BY NAME
SELECT datetime, sensor_id, pm25, l_orderkey AS order_id FROM b""")

LIVE = """x AS (SELECT *, CAST(datetime AS DATE) AS date, max(CAST(datetime AS DATE)) OVER () AS last FROM m),
live AS (SELECT sensor_id, arg_max(pm25, datetime) AS pm25, max(datetime) AS datetime FROM x WHERE date = last GROUP BY 1),
past AS (SELECT * FROM x WHERE date < last)"""


def fallback(past: str) -> str:
    return f"""SELECT c_custkey AS sensor_id, coalesce(l.pm25, o.pm25) AS pm25,
CASE WHEN l.sensor_id IS NOT NULL THEN 'LIVE' ELSE 'FILE' END AS source,
CASE WHEN l.sensor_id IS NOT NULL THEN l.datetime ELSE o.datetime END AS datetime, n_name AS district FROM customer
LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN live l ON c_custkey = l.sensor_id LEFT JOIN ({past}) o ON c_custkey = o.sensor_id
WHERE l.sensor_id IS NOT NULL OR o.sensor_id IS NOT NULL"""


PAST_MEAN = "SELECT sensor_id, avg(pm25) AS pm25, NULL AS datetime FROM past GROUP BY 1"
PAST_NEWEST = "SELECT sensor_id, arg_max(pm25, datetime) AS pm25, max(datetime) AS datetime FROM past GROUP BY 1"
PAST_24 = """SELECT sensor_id, avg(pm25) AS pm25, NULL AS datetime FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id
ORDER BY datetime DESC, event_id DESC) AS rn FROM past) WHERE rn <= 24 GROUP BY 1"""
ORACLE["live_or_archive"] = using("m", f"""
, {LIVE}, t AS ({fallback(PAST_MEAN)}) SELECT sensor_id, {rd(_v)} AS pm25, source FROM t""")
ORACLE["current_quality"] = using("m", f"""
, {LIVE}, t AS ({fallback(PAST_NEWEST)}),
c AS (SELECT avg(pm25) AS a, max(pm25) AS b, min(pm25) AS c, count(*) AS n FROM live WHERE pm25 <> 0)
SELECT sensor_id, district, datetime, {rd(_v)} AS pm25, source, {band(_v)} AS risk_level, {message(_v)} AS risk_message,
{", ".join(f"{excess(_v, c)} AS {n}_excess_pct" for n, c, _ in K.RISK_COEFFICIENTS if n in K.SHORT_OUTCOMES)},
{recommend(_v)} AS recommendation, {rd('a')} AS avg_pm25, {rd('b')} AS max_pm25, {rd('c')} AS min_pm25,
n AS sensor_count FROM t, c""")
ORACLE["compare_sensors"] = using("ms", f"""
, {LIVE}, t AS ({fallback(PAST_24)})
SELECT sensor_id, district, {rd(_v)} AS pm25, source, {band(_v)} AS risk_level FROM t
WHERE sensor_id IN (SELECT sensor_id FROM s)""")

ORACLE["dedup_rows"] = using("d", "SELECT DISTINCT * FROM d")
ORACLE["dedup_key_first"] = using("m", """
SELECT event_id, datetime, sensor_id, event_type, pm25 FROM (SELECT *, row_number() OVER (
PARTITION BY sensor_id, event_type ORDER BY datetime, event_id) AS rn FROM m) WHERE rn = 1""")
UNIQUE = """u AS (SELECT DISTINCT event_id, datetime, sensor_id, event_type,
CASE WHEN NOT (pm25 < 0) THEN pm25 END AS pm25 FROM d)"""
ORACLE["basic_clean"] = using("d", f", {UNIQUE} SELECT * FROM u")


def fences(table: str, k: float, group: str = "") -> str:
    cols = f"{group}, " if group else ""
    return f"""SELECT {cols}quantile_cont(pm25, 0.25) - {k} * (quantile_cont(pm25, 0.75) - quantile_cont(pm25, 0.25)) AS lo,
quantile_cont(pm25, 0.75) + {k} * (quantile_cont(pm25, 0.75) - quantile_cont(pm25, 0.25)) AS hi
FROM {table} WHERE pm25 IS NOT NULL {'GROUP BY ' + group if group else ''}"""


INSIDE = "CASE WHEN NOT (pm25 < lo OR pm25 > hi) THEN pm25 END"
ORACLE["outliers_iqr"] = using("d", f", q AS ({fences('d', 3.0)}) SELECT event_id, {INSIDE} AS pm25 FROM d, q")
ORACLE["outliers_iqr_per_sensor"] = using("d", f"""
, q AS ({fences('d', 1.5, 'sensor_id')})
SELECT event_id, {INSIDE} AS pm25 FROM d LEFT JOIN q USING (sensor_id)""")
ORACLE["outliers_zscore"] = using("d", """
, q AS (SELECT avg(pm25) AS a, stddev_pop(pm25) AS s FROM d)
SELECT event_id, CASE WHEN s > 0 AND abs((pm25 - a) / s) > 3.0 THEN NULL ELSE pm25 END AS pm25 FROM d, q""")

ASC = "PARTITION BY {k} ORDER BY datetime, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
DSC = "PARTITION BY {k} ORDER BY datetime, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def knots(table: str, key: str = "sensor_id") -> str:
    """Each row with its position and the values, times and positions of the readings around it."""
    a, z = ASC.format(k=key), DSC.format(k=key)
    return f"""n0 AS (SELECT *, epoch_us(datetime) AS us, row_number() OVER (PARTITION BY {key}
ORDER BY datetime, event_id) AS pos FROM {table}),
n AS (SELECT *, last_value(pm25 IGNORE NULLS) OVER ({a}) AS pv, first_value(pm25 IGNORE NULLS) OVER ({z}) AS nv,
last_value(CASE WHEN pm25 IS NOT NULL THEN us END IGNORE NULLS) OVER ({a}) AS pu,
first_value(CASE WHEN pm25 IS NOT NULL THEN us END IGNORE NULLS) OVER ({z}) AS nu,
last_value(CASE WHEN pm25 IS NOT NULL THEN pos END IGNORE NULLS) OVER ({a}) AS pp,
first_value(CASE WHEN pm25 IS NOT NULL THEN pos END IGNORE NULLS) OVER ({z}) AS np FROM n0)"""


TIME_FILL = """CASE WHEN pm25 IS NOT NULL THEN pm25 WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
ELSE pv + (nv - pv) * (CAST(us - pu AS DOUBLE) / (nu - pu)) END"""
LINEAR_FILL = """CASE WHEN pm25 IS NOT NULL THEN pm25 WHEN pv IS NULL OR pos - pp > 7 THEN NULL WHEN nv IS NULL THEN pv
ELSE pv + (nv - pv) * (CAST(pos - pp AS DOUBLE) / (np - pp)) END"""


def filled(expr: str, key: str = "sensor_id") -> str:
    return using("g", f", {knots('g', key)} SELECT event_id, {rd(expr)} AS pm25 FROM n")


ORACLE["fill_time"] = filled(TIME_FILL)
ORACLE["fill_time_whole_table"] = filled(TIME_FILL, "1")
ORACLE["fill_linear"] = filled(LINEAR_FILL)
ORACLE["fill_linear_whole_table"] = filled(LINEAR_FILL, "1")
ORACLE["fill_ffill"] = filled("CASE WHEN pm25 IS NOT NULL THEN pm25 WHEN pos - pp <= 7 THEN pv END")
ORACLE["fill_bfill"] = filled("CASE WHEN pm25 IS NOT NULL THEN pm25 WHEN np - pos <= 7 THEN nv END")
ORACLE["fill_mean"] = using("g", f"SELECT event_id, {rd('coalesce(pm25, (SELECT avg(pm25) FROM g))')} AS pm25 FROM g")

CLEANED = f"""{UNIQUE}, q AS ({fences('u', 3.0)}),
w AS (SELECT event_id, datetime, sensor_id, event_type, {INSIDE} AS pm25, pm25 AS was FROM u, q), {knots('w')}"""
ORACLE["clean_series"] = using("d", f"""
, {CLEANED} SELECT event_id, datetime, sensor_id, event_type, {rd(TIME_FILL)} AS pm25 FROM n""")
ORACLE["cleaning_log"] = using("d", f"""
, {CLEANED}, e AS (SELECT DISTINCT * FROM d)
SELECT 1 AS step_no, 'duplicates_removed' AS step, (SELECT count(*) FROM d) - (SELECT count(*) FROM e) AS rows
UNION ALL SELECT 2, 'negatives_to_null', (SELECT count(*) FROM e WHERE pm25 < 0)
UNION ALL SELECT 3, 'outliers_to_null', (SELECT count(*) FROM w WHERE pm25 IS NULL AND was IS NOT NULL)
UNION ALL SELECT 4, 'gaps_filled', (SELECT count(*) FROM n WHERE pm25 IS NULL AND ({TIME_FILL}) IS NOT NULL)""")


def resample_sql(keep: str) -> str:
    return f"""t AS (SELECT sensor_id, CAST(datetime AS DATE) AS date, avg(pm25) AS v FROM {keep} GROUP BY 1, 2),
k AS (SELECT sensor_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
FROM t GROUP BY 1)
SELECT sensor_id, date, {rd('v')} AS pm25_mean FROM k LEFT JOIN t USING (sensor_id, date)"""


ORACLE["resample_daily_top5"] = using("m", f"""
, top5 AS (SELECT sensor_id FROM m GROUP BY 1 ORDER BY avg(pm25) DESC, 1 LIMIT 5),
o AS (SELECT * FROM m WHERE sensor_id IN (SELECT sensor_id FROM top5)), {resample_sql('o')}""")
_W = "avg(pm25) OVER (PARTITION BY sensor_id ORDER BY datetime RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
ORACLE["rolling_features"] = using("m", f"""
SELECT event_id, {rd(_W.format(h=3))} AS pm25_mean_3h, {rd(_W.format(h=6))} AS pm25_mean_6h FROM m""")

ORACLE["latest_snapshot_rows"] = using("m", """
SELECT sensor_id, pm25, datetime AS timestamp, 'CSV download' AS source FROM m
WHERE datetime = (SELECT max(datetime) FROM m)""")
ORACLE["latest_snapshot_bulk"] = using("b", "SELECT * FROM b WHERE datetime = (SELECT max(datetime) FROM b)")
RANKED = """(SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY datetime DESC, event_id DESC) AS rn FROM m)"""
ORACLE["latest_per_sensor_rows"] = using("m", f"SELECT * EXCLUDE (rn) FROM {RANKED} WHERE rn = 1")
ORACLE["latest_keyed_table"] = using("m", f"SELECT sensor_id, pm25 FROM {RANKED} WHERE rn = 1 AND sensor_id <> 0")
ORACLE["latest_24_per_sensor"] = using("m", f"SELECT event_id, sensor_id FROM {RANKED} WHERE rn <= 24")
ORACLE["first_5_per_type"] = using("m", """
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY datetime, event_id)
AS rn FROM m) WHERE rn <= 5""")
LAST_DAYS = """l AS (SELECT sensor_id, CAST(datetime AS DATE) AS date, avg(pm25) AS v,
row_number() OVER (PARTITION BY sensor_id ORDER BY CAST(datetime AS DATE) DESC) AS dr FROM {t} GROUP BY 1, 2)"""
ORACLE["daily_mean_last_days"] = using("m", f"""
, {LAST_DAYS.format(t='m')} SELECT sensor_id, date, {rd('v')} AS pm25_mean FROM l WHERE dr <= 7""")
TREND = f"""o AS (SELECT *, count(*) OVER (PARTITION BY sensor_id) AS n FROM {RANKED} WHERE rn <= 168),
p AS (SELECT * FROM o WHERE n >= 24), {LAST_DAYS.format(t='p')}"""
ORACLE["trend_last_days"] = using("m", f"""
, {TREND} SELECT sensor_id, date, {rd('v')} AS pm25_mean, {band('v')} AS risk_level FROM l WHERE dr <= 7""")
ORACLE["trend_summary"] = using("m", f"""
, {TREND} SELECT sensor_id, {rd('avg(v)')} AS mean, {rd('max(v)')} AS peak FROM l WHERE dr <= 7 GROUP BY 1""")

FORECAST = f"""f AS (SELECT *, count(*) OVER (PARTITION BY sensor_id) AS n, avg(pm25) OVER (PARTITION BY sensor_id) AS hm,
max(datetime) OVER (PARTITION BY sensor_id) AS last FROM {RANKED} WHERE rn <= 24),
f24 AS (SELECT sensor_id, CAST(25 - rn AS INTEGER) AS step, last, hm, greatest(0.0, {rd('pm25', 1)}) AS forecast
FROM f WHERE n = 24)"""
ORACLE["forecast_24"] = using("m", f"""
, {FORECAST} SELECT sensor_id, step, last + to_hours(step) AS forecast_time, forecast,
{band('forecast')} AS risk_level FROM f24""")
ORACLE["forecast_48"] = using("m", f"""
, {FORECAST}, r AS (SELECT sensor_id, step, hm, forecast FROM f24 WHERE step = 24 UNION ALL
SELECT sensor_id, step + 1, hm, greatest(0.0, {rd('forecast * 0.95 + hm * (1 - 0.95)', 1)}) FROM r WHERE step < 48),
a AS (SELECT sensor_id, step, forecast FROM f24 UNION ALL SELECT sensor_id, step, forecast FROM r WHERE step > 24)
SELECT sensor_id, step, forecast, {band('forecast')} AS risk_level FROM a""")
ORACLE["forecast_peak"] = using("m", f"""
, {FORECAST} SELECT sensor_id, {rd('avg(forecast)')} AS mean, {rd('max(forecast)')} AS peak FROM f24 GROUP BY 1""")

ORACLE["health_brief"] = using("ms", f"""
, t AS (SELECT sensor_id, avg(pm25) AS x FROM {RANKED} WHERE rn <= 720 GROUP BY 1)
SELECT sensor_id, district_slug AS district, {rd('x')} AS mean, {band('x')} AS risk_level,
{excess('x', 1.062)} AS mortality_excess_pct FROM t JOIN s USING (sensor_id)""")
ORACLE["monthly_stats"] = using("m", f"""
SELECT count(*) AS measurements, {rd(_m)} AS mean, {rd('max(pm25)')} AS max,
{rd(share('pm25 > 5'))} AS pct_above_guideline FROM m""")

ORACLE["bulk_daily_stats"] = using("bs", daily_stats("b", 2))
ORACLE["bulk_summary"] = using("b", summary_sql("b"))
ORACLE["bulk_histogram"] = using("b", histogram_sql("b"))
ORACLE["bulk_station_mean"] = using("bs", f"""
SELECT station_id, {rd(_m)} AS mean FROM b JOIN s USING (sensor_id) GROUP BY 1""")
ORACLE["bulk_boxplot"] = using("bs", f"""
, p AS (SELECT * FROM b JOIN s USING (sensor_id)), {box('p', 'district_slug')} {BOX_OUT}""")
ORACLE["bulk_resample"] = using("b", f", {resample_sql('b')}")

ORACLE["stream_latest"] = using("m", f"SELECT sensor_id, event_id, datetime, pm25 FROM {RANKED} WHERE rn = 1")
ORACLE["stream_hourly_averages"] = using("m", f"""
, t AS (SELECT date_trunc('hour', datetime) AS window_start, sensor_id, avg(pm25) AS v, count(pm25) AS n
FROM m GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, sensor_id, {rd('v')} AS pm25_mean,
{band('v')} AS risk_level, n AS measurements_count FROM t
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(datetime) FROM m) - INTERVAL 2 HOUR""")


def tree_sql(body: str, depth: int = 3, min_rows: int = 2, cut: str = "TIMESTAMP '2024-01-24'") -> str:
    """A tree per sensor on hour, weekday and day of the month, level by level: p0 are placed rows, g the splits."""
    steps = [f"""p0 AS (SELECT sensor_id, pm25, datetime < {cut} AS train, CAST(round(pm25 * 1e6) AS BIGINT) AS r, 0 AS node,
[extract(hour FROM datetime), dayofweek(datetime), extract(day FROM datetime) - 1] AS x FROM m)"""]
    for k in range(depth):
        steps.append(f"""h{k} AS (SELECT sensor_id, node, f, b, count(*) AS w, sum(r) AS s FROM (
SELECT sensor_id, node, r, unnest([1, 2, 3]) AS f, unnest(x) AS b FROM p{k} WHERE train AND node >= {2**k - 1}) GROUP BY ALL),
c{k} AS (SELECT sensor_id, node, f, b, sum(w) OVER u AS nl, CAST(sum(s) OVER u AS DOUBLE) AS sl,
 sum(w) OVER a - sum(w) OVER u AS nr, CAST(sum(s) OVER a - sum(s) OVER u AS DOUBLE) AS sr FROM h{k}
 WINDOW u AS (PARTITION BY sensor_id, node, f ORDER BY b ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY sensor_id, node, f)),
g{k} AS (SELECT sensor_id, node, f, b, sl * sl / nl + sr * sr / nr - (sl + sr) * (sl + sr) / (nl + nr) AS gain FROM c{k}
 WHERE nl >= {min_rows} AND nr >= {min_rows} AND sl * sl / nl + sr * sr / nr - (sl + sr) * (sl + sr) / (nl + nr) > 0
 QUALIFY row_number() OVER (PARTITION BY sensor_id, node
  ORDER BY sl * sl / nl + sr * sr / nr - (sl + sr) * (sl + sr) / (nl + nr) DESC, f, b) = 1),
p{k + 1} AS (SELECT p.sensor_id, pm25, train, r, x,
 CASE WHEN g.f IS NULL THEN p.node WHEN x[g.f] > g.b THEN 2 * p.node + 2 ELSE 2 * p.node + 1 END AS node
 FROM p{k} p LEFT JOIN g{k} g ON p.sensor_id = g.sensor_id AND p.node = g.node)""")
    return using("m", ", " + ",\n".join(steps) + body.format(last=f"p{depth}", gains=" UNION ALL ".join(
        f"SELECT * FROM g{k}" for k in range(depth))))


ORACLE["sensor_tree_quality"] = tree_sql(f""", v AS (SELECT sensor_id, node, CAST(sum(r) AS DOUBLE) / count(*) / 1000000 AS v
FROM {{last}} WHERE train GROUP BY ALL),
e AS (SELECT t.sensor_id, pm25, pm25 - v AS e FROM {{last}} t JOIN v ON t.sensor_id = v.sensor_id AND t.node = v.node WHERE NOT train)
SELECT sensor_id, {rd('sqrt(avg(e * e))')} AS rmse,
CASE WHEN var_pop(pm25) * count(pm25) > 0 THEN {rd('1 - sum(e * e) / (var_pop(pm25) * count(pm25))')} END AS r2,
count(*) AS rows FROM e GROUP BY sensor_id""")
ORACLE["sensor_tree_importance"] = tree_sql(f""", g AS ({{gains}}), w AS (SELECT sensor_id, sum(gain) AS whole FROM g GROUP BY 1),
n AS (SELECT unnest([1, 2, 3]) AS f, unnest(['hour_of_day', 'day_of_week', 'day_of_month']) AS feature)
SELECT w.sensor_id, n.feature, {rd('coalesce(sum(g.gain), 0.0) / whole')} AS importance
FROM w JOIN n ON true LEFT JOIN g ON g.sensor_id = w.sensor_id AND g.f = n.f GROUP BY w.sensor_id, n.feature, whole""")

_ROLLED = f"""count(pm25) AS count, {rd(_m)} AS mean, {rd('stddev_samp(pm25)')} AS std, {rd('min(pm25)')} AS min,
{rd('max(pm25)')} AS max, count(DISTINCT CAST(datetime AS DATE)) AS days"""
_INSIDE = "WHERE CAST(datetime AS DATE) BETWEEN DATE '2024-01-06' AND DATE '2024-01-23'"
ORACLE["partials_per_sensor"] = using("m", f"SELECT sensor_id, {_ROLLED} FROM m {_INSIDE} GROUP BY sensor_id")
ORACLE["partials_city"] = using("m", f"SELECT {_ROLLED}, count(DISTINCT event_type) AS distinct_event_type FROM m {_INSIDE}")

ORACLE["one_sensor_now"] = using("m", """SELECT sensor_id, datetime, pm25 FROM m WHERE sensor_id = 7
ORDER BY datetime DESC, event_id DESC LIMIT 1""")
ORACLE["sensor_series"] = using("m", "SELECT datetime, pm25 FROM m WHERE sensor_id = 7")
ORACLE["sensor_hourly"] = using("m", f"""
SELECT CAST(extract(hour FROM datetime) AS INTEGER) AS hour, {rd(_m)} AS pm25_mean,
{rd('stddev_samp(pm25)')} AS pm25_std, {rd('avg(pm25) - stddev_samp(pm25)')} AS pm25_lower,
{rd('avg(pm25) + stddev_samp(pm25)')} AS pm25_upper FROM m WHERE sensor_id = 7 GROUP BY 1""")
ORACLE["district_comparison_boxes"] = using("ms", f"""
, x AS (SELECT pm25, district_slug FROM m JOIN s USING (sensor_id)), {box('x', 'district_slug')}
{BOX_OUT.replace('FROM f', """FROM f WHERE district_slug IN (SELECT district_slug FROM x GROUP BY 1
ORDER BY floor(avg(pm25) * 100 + 0.5 + abs(avg(pm25) * 100) * 1e-12) DESC, 1 LIMIT 5)""")}""")
ORACLE["quick_first_points"] = using("m", "SELECT * FROM m ORDER BY datetime, event_id LIMIT 300")
ORACLE["personal_advice"] = using("m", f"""
, {LIVE}, t AS ({fallback(PAST_MEAN)}),
w AS (SELECT *, unnest([{', '.join(f"'{p}'" for p in K.PROFILE_ADVICE)}]) AS profile FROM t)
SELECT sensor_id, {rd(_v)} AS pm25, source, profile, {band(_v)} AS risk_level, {advice('profile', _v)} AS advice FROM w""")
ORACLE["clean_whole_frame"] = using("d", f"""
, {UNIQUE}, q AS ({fences('u', 3.0)}),
w AS (SELECT event_id, datetime, sensor_id, event_type, {INSIDE} AS pm25, pm25 AS was FROM u, q), {knots('w', '1')}
SELECT event_id, datetime, sensor_id, event_type, {rd(TIME_FILL)} AS pm25 FROM n""")

ORACLE["stream_live_or_file"] = using("m", f"""
, z AS (SELECT sensor_id, arg_max(pm25, datetime) AS pm25 FROM m GROUP BY 1
  HAVING max(datetime) + INTERVAL 1 HOUR > date_trunc('milliseconds', (SELECT max(datetime) FROM m))),
a AS (SELECT sensor_id, avg(pm25) AS pm25 FROM m
  WHERE CAST(datetime AS DATE) < (SELECT max(CAST(datetime AS DATE)) FROM m) GROUP BY 1)
SELECT c_custkey AS sensor_id, {rd('CASE WHEN z.sensor_id IS NOT NULL THEN z.pm25 ELSE a.pm25 END')} AS pm25,
CASE WHEN z.sensor_id IS NOT NULL THEN 'LIVE' ELSE 'FILE' END AS source
FROM customer LEFT JOIN z ON c_custkey = z.sensor_id LEFT JOIN a ON c_custkey = a.sensor_id
WHERE z.sensor_id IS NOT NULL OR a.sensor_id IS NOT NULL""")
