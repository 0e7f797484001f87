"""DuckDB SQL for the stand-alone operator queries (see ``inventory.py``)."""

from __future__ import annotations

from tarmac.plans import portable
from tarmac.sources.flights import RAW_COLUMNS
from tarmac.plans.oracle import CAUSES, PCT, R, R2, ROUTE, with_ctes, with_flights

COLS = [
    ("Month", "bigint"), ("DepHour", "bigint"), ("UniqueCarrier", "string"), ("Origin", "string"),
    ("Dest", "string"), ("DepDelay", "double"), ("ArrDelay", "double"), ("CarrierDelay", "double"),
    ("WeatherDelay", "double"), ("NASDelay", "double"), ("SecurityDelay", "double"), ("LateAircraftDelay", "double"),
]
CAUSE_COLS = [c for c, _ in CAUSES]
CORR = ["ArrDelay", "DepDelay", *CAUSE_COLS]
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
SCHED = 'SELECT *, "DepHour" * 100 + (CAST("ArrDelay" AS BIGINT) % 60) AS "CRSDepTime"'


def uall(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def q(select: str, ctes: str = "") -> str:
    return with_flights(ctes, select)


SQL: dict[str, str] = {}

# ------------------------------------------------------------------ profiling
SQL["prof_schema"] = q(uall(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, COUNT(\"{c}\") AS non_null FROM flights0" for c, t in COLS))
SQL["prof_shape"] = q("SELECT COUNT(*) AS n_rows, CAST(12 AS BIGINT) AS n_columns FROM flights0")
SQL["prof_nulls"] = q(uall(
    f"SELECT '{c}' AS column_name, COUNT(CASE WHEN \"{c}\" IS NULL THEN 1 END) AS null_count FROM flights0"
    for c, _ in COLS))
_ALL = ", ".join(f'"{c}"' for c, _ in COLS)
SQL["prof_duplicates"] = q(
    f"SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT COUNT(*) AS n FROM flights0 GROUP BY {_ALL})")
SQL["prof_distinct"] = q('SELECT DISTINCT "UniqueCarrier" FROM flights0')
SQL["prof_describe"] = q(uall(f"""
SELECT '{c}' AS column_name, COUNT("{c}") AS count, {R(f'AVG("{c}")', 4)} AS mean, {R(f'STDDEV_SAMP("{c}")', 4)} AS std,
       CAST(MIN("{c}") AS DOUBLE) AS min, {R(f'QUANTILE_CONT("{c}", 0.25)', 4)} AS p25,
       {R(f'QUANTILE_CONT("{c}", 0.5)', 4)} AS p50, {R(f'QUANTILE_CONT("{c}", 0.75)', 4)} AS p75,
       CAST(MAX("{c}") AS DOUBLE) AS max FROM flights0""" for c in ("ArrDelay", "DepDelay")))
SQL["prof_minmax"] = q(uall(
    f"SELECT '{c}' AS column_name, CAST(MIN(\"{c}\") AS DOUBLE) AS min_value, CAST(MAX(\"{c}\") AS DOUBLE) AS max_value "
    f"FROM airline_delays" for c in ("ArrDelay", "DepDelay")))


def _box(stage: str, table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS column_name, b.q1, b.median, b.q3,
       CAST(MIN(CASE WHEN t."{c}" BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1) THEN t."{c}" END) AS DOUBLE)
         AS whisker_low,
       CAST(MAX(CASE WHEN t."{c}" BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1) THEN t."{c}" END) AS DOUBLE)
         AS whisker_high,
       COUNT(CASE WHEN t."{c}" IS NOT NULL AND NOT (t."{c}" BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1))
             THEN 1 END) AS outliers,
       '{stage}' AS stage
FROM {table} t, (SELECT QUANTILE_CONT("{c}", 0.25) AS q1, QUANTILE_CONT("{c}", 0.5) AS median,
                        QUANTILE_CONT("{c}", 0.75) AS q3 FROM {table}) b
GROUP BY b.q1, b.median, b.q3"""


SQL["prof_boxplot"] = q(uall(_box(s, t, c) for s, t in (("before", "flights0"), ("after", "airline_delays"))
                             for c in ("ArrDelay", "DepDelay")))
SQL["prof_head"] = q(f"SELECT * FROM airline_delays ORDER BY {_ALL} LIMIT 5")
SQL["prof_invariants"] = q("""
SELECT 'arr_delay_at_least_min' AS check_name, COUNT(CASE WHEN NOT ("ArrDelay" >= 15) THEN 1 END) AS violations
FROM airline_delays
UNION ALL
SELECT 'causes_sum_to_arr_delay', COUNT(CASE WHEN COALESCE("CarrierDelay", 0) + COALESCE("WeatherDelay", 0)
       + COALESCE("NASDelay", 0) + COALESCE("SecurityDelay", 0) + COALESCE("LateAircraftDelay", 0) <> "ArrDelay"
       THEN 1 END) FROM airline_delays""")

# ------------------------------------------------------------------ cleaning and predicates
SQL["clean_dropna"] = q("SELECT * FROM flights0 WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in CORR))
SQL["clean_drop_columns"] = q('SELECT "Month", "DepHour", "UniqueCarrier", "Origin", "Dest", "DepDelay", "ArrDelay" FROM flights0')
SQL["clean_cast_int"] = q('SELECT "Month", "UniqueCarrier", CAST(TRUNC("ArrDelay") AS BIGINT) AS "ArrDelay", '
                          'CAST(TRUNC("DepDelay") AS BIGINT) AS "DepDelay" FROM flights0')
SQL["clean_hhmm_to_hour"] = q('SELECT "DepHour", "CRSDepTime", CAST(FLOOR("CRSDepTime" / 100) AS BIGINT) AS "SchedHour" FROM s',
                              f"s AS ({SCHED} FROM flights0)")
SQL["clean_trim"] = q(f"""SELECT trim(' ' || chr(9) || "UniqueCarrier" || ' ' || chr(10), {WS}) AS "UniqueCarrier",
       COUNT(*) AS flights FROM flights0 GROUP BY 1""")
SQL["clean_iqr_filter"] = q("SELECT * FROM airline_delays")
SQL["clean_override_hour"] = q('SELECT "UniqueCarrier", "CRSDepTime", CAST(FLOOR("CRSDepTime" / 100) AS BIGINT) AS "DepHour" FROM s',
                               f"s AS ({SCHED} FROM airline_delays)")
SQL["proj_columns"] = q(f'SELECT {ROUTE} AS route, "Month" AS month, "ArrDelay" AS delay FROM airline_delays')
SQL["filter_range"] = q('SELECT "UniqueCarrier", "Origin", "Dest", "ArrDelay" FROM airline_delays WHERE "ArrDelay" BETWEEN 31 AND 60')
SQL["filter_in"] = q('SELECT "Month", "UniqueCarrier", "ArrDelay" FROM airline_delays WHERE "Month" IN (12, 1, 2)')
SQL["filter_null"] = with_ctes(portable.monthly_changes(), "SELECT airline, Month, avg_delay FROM changes_named WHERE mom_change IS NULL")
SQL["filter_compare"] = q('SELECT "Origin", "Dest", "ArrDelay", "DepDelay" FROM airline_delays '
                          'WHERE "Origin" < "Dest" AND "ArrDelay" > "DepDelay"')
SQL["filter_having"] = q(f'SELECT {ROUTE} AS route, COUNT(*) AS flights FROM airline_delays GROUP BY "Origin", "Dest" '
                         'HAVING COUNT(*) >= 50')
SQL["row_mask_and"] = q('SELECT "UniqueCarrier", "ArrDelay", "DepDelay" FROM flights0 WHERE "ArrDelay" >= 20 '
                        'AND "ArrDelay" <= 90 AND "DepDelay" >= 10 AND "DepDelay" <= 80')

# ------------------------------------------------------------------ joins
SQL["join_reverse_pair"] = q("""
SELECT a."Origin", a."Dest", a.flights AS flights_ab, b.flights AS flights_ba
FROM g a JOIN g b ON a."Origin" = b."Dest" AND a."Dest" = b."Origin" WHERE a."Origin" < a."Dest\"""",
                             'g AS (SELECT "Origin", "Dest", COUNT(*) AS flights FROM airline_delays GROUP BY 1, 2)')
SQL["join_equi_inner"] = q("""
SELECT d.airport, d.departures, a.arrivals FROM
  (SELECT "Origin" AS airport, COUNT(*) AS departures FROM airline_delays GROUP BY 1) d
  JOIN (SELECT "Dest" AS airport, COUNT(*) AS arrivals FROM airline_delays GROUP BY 1) a ON d.airport = a.airport""")
SQL["join_rank1_rank2"] = q("""
SELECT r1.airline, r1."Month" AS top_month, r1.flights AS top_flights, r2."Month" AS second_month,
       r2.flights AS second_flights
FROM rk r1 JOIN rk r2 ON r1.airline = r2.airline AND r1.month_rank = 1 AND r2.month_rank = 2""", """
g AS (SELECT "UniqueCarrier" AS airline, "Month", COUNT(*) AS flights FROM airline_delays GROUP BY 1, 2),
rk AS (SELECT *, RANK() OVER (PARTITION BY airline ORDER BY flights DESC) AS month_rank FROM g)""")
SQL["join_cross_scalar"] = q(f"""
SELECT a.airline, a.avg_delay, n.network_avg, {R2('a.avg_delay - n.network_avg')} AS vs_network
FROM (SELECT "UniqueCarrier" AS airline, {R2('AVG("ArrDelay")')} AS avg_delay FROM airline_delays GROUP BY 1) a
CROSS JOIN (SELECT {R2('AVG("ArrDelay")')} AS network_avg FROM airline_delays) n""")
SQL["join_lookup"] = q("""
SELECT d.airport, d.departures, r.region
FROM (SELECT "Origin" AS airport, COUNT(*) AS departures FROM airline_delays GROUP BY 1) d
LEFT JOIN (SELECT airport, region FROM (
    SELECT n.n_name AS airport, g.r_name AS region,
           ROW_NUMBER() OVER (PARTITION BY n.n_name ORDER BY g.r_name) AS rn
    FROM nation n JOIN region g ON n.n_regionkey = g.r_regionkey) WHERE rn = 1) r ON d.airport = r.airport""")

# ------------------------------------------------------------------ aggregates
BYC = 'FROM airline_delays GROUP BY "UniqueCarrier"'
SQL["agg_count"] = q(f'SELECT "UniqueCarrier" AS airline, COUNT(*) AS flights {BYC}')
SQL["agg_count_distinct"] = q(f'SELECT "UniqueCarrier" AS airline, COUNT(DISTINCT "Origin") AS origins, '
                              f'COUNT(DISTINCT "Dest") AS dests {BYC}')
SQL["agg_min_max"] = q(f'SELECT "UniqueCarrier" AS airline, MIN("ArrDelay") AS min_arr, MAX("ArrDelay") AS max_arr, '
                       f'MIN("DepDelay") AS min_dep, MAX("DepDelay") AS max_dep {BYC}')
SQL["agg_avg"] = q(f'SELECT "UniqueCarrier" AS airline, {R2("AVG(\"ArrDelay\")")} AS avg_arr, '
                   f'{R2("AVG(\"DepDelay\")")} AS avg_dep {BYC}')
SQL["agg_stddev"] = q(f'SELECT "Origin" AS airport, {R2("STDDEV_SAMP(\"ArrDelay\")")} AS stddev_arr, '
                      f'{R2("STDDEV_SAMP(\"DepDelay\")")} AS stddev_dep FROM airline_delays GROUP BY 1')
SQL["agg_sum"] = q('SELECT "UniqueCarrier" AS airline, ' + ", ".join(f'SUM("{c}") AS "{c}"' for c in CAUSE_COLS) + f" {BYC}")
SQL["agg_conditional_count"] = q('SELECT "Month", COUNT(CASE WHEN "ArrDelay" > 60 THEN 1 END) AS severe_flights, '
                                 'COUNT(CASE WHEN "ArrDelay" BETWEEN 15 AND 30 THEN 1 END) AS mild_flights '
                                 'FROM airline_delays GROUP BY 1')
SQL["agg_conditional_avg"] = q('SELECT "UniqueCarrier" AS airline, ' + ", ".join(
    f'{R2(f"AVG(CASE WHEN \"{c}\" > 0 THEN \"{c}\" END)")} AS "{c}"' for c in CAUSE_COLS) + f" {BYC}")
SQL["agg_rate_pct"] = q(f'SELECT "Origin" AS airport, {PCT("COUNT(CASE WHEN \"ArrDelay\" > 60 THEN 1 END)", "COUNT(*)")} '
                        'AS severe_rate FROM airline_delays GROUP BY 1')
SQL["agg_multi_key"] = q(f'SELECT "UniqueCarrier", "Origin", "Month", COUNT(*) AS flights, {R2("AVG(\"ArrDelay\")")} '
                         'AS avg_arr FROM airline_delays GROUP BY 1, 2, 3')
SQL["agg_of_agg"] = q(f"""
SELECT "Origin" AS airport, {R2('AVG(route_avg)')} AS mean_route_avg, MIN(route_avg) AS best_route_avg,
       MAX(route_avg) AS worst_route_avg, COUNT(*) AS routes
FROM (SELECT "Origin", "Dest", {R2('AVG("ArrDelay")')} AS route_avg FROM airline_delays GROUP BY 1, 2) GROUP BY 1""")
SQL["agg_quantile"] = q(f'SELECT "UniqueCarrier" AS airline, {R("QUANTILE_CONT(\"ArrDelay\", 0.25)", 4)} AS p25, '
                        f'{R("QUANTILE_CONT(\"ArrDelay\", 0.5)", 4)} AS p50, '
                        f'{R("QUANTILE_CONT(\"ArrDelay\", 0.75)", 4)} AS p75 {BYC}')
SQL["agg_corr_matrix"] = q(uall(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + R(f'CORR("{a}", "{b}")', 4) + " AS corr FROM flights0"
    for a in CORR for b in CORR))
SQL["agg_column_means"] = q(uall(f"SELECT '{c}' AS column_name, {R(f'AVG(\"{c}\")', 6)} AS mean FROM flights0"
                                 for c in CORR))
SQL["agg_global"] = q(f"""
SELECT COUNT(*) AS total_flights, COUNT(DISTINCT "UniqueCarrier") AS total_airlines,
       MIN("ArrDelay") AS min_arrdelay, MAX("ArrDelay") AS max_arrdelay, MIN("DepDelay") AS min_depdelay,
       MAX("DepDelay") AS max_depdelay, {R2('AVG("ArrDelay")')} AS avg_arrdelay, {R2('AVG("DepDelay")')} AS avg_depdelay
FROM airline_delays""")
_SEASON = """CASE WHEN "Month" IN (12, 1, 2) THEN 'Winter' WHEN "Month" IN (3, 4, 5) THEN 'Spring'
  WHEN "Month" IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""
SQL["agg_pivot"] = q('SELECT "UniqueCarrier" AS airline, ' + ", ".join(
    f"COUNT(CASE WHEN {_SEASON} = '{s}' THEN 1 END) AS {s.lower()}" for s in ("Winter", "Spring", "Summer", "Fall"))
    + f" {BYC}")
SQL["agg_ifs"] = q(f"""
SELECT "UniqueCarrier" AS airline,
       COUNT(CASE WHEN "ArrDelay" > 60 AND "DepHour" BETWEEN 15 AND 20 THEN 1 END) AS evening_severe,
       SUM(CASE WHEN "Month" IN (12, 1, 2) AND "WeatherDelay" > 0 THEN "WeatherDelay" END) AS winter_weather_minutes,
       {R2('AVG(CASE WHEN "Origin" < "Dest" AND "DepDelay" > 30 THEN "ArrDelay" END)')} AS late_dep_avg_arr
{BYC}""")

# ------------------------------------------------------------------ windows
CM = f"""cm AS (SELECT "UniqueCarrier" AS airline, "Month", {R2('AVG("ArrDelay")')} AS avg_delay, COUNT(*) AS flights
  FROM airline_delays GROUP BY 1, 2)"""
MO = f"""mo AS (SELECT "Month", {R2('AVG("ArrDelay")')} AS avg_delay FROM airline_delays GROUP BY 1)"""
SQL["win_rank_partition"] = q('SELECT *, RANK() OVER (PARTITION BY "Month" ORDER BY avg_delay DESC) AS rank_in_month FROM cm', CM)
SQL["win_rank_global"] = q("""SELECT airport, avg_delay, RANK() OVER (ORDER BY avg_delay DESC) AS rank_desc,
  RANK() OVER (ORDER BY avg_delay ASC) AS rank_asc FROM g""",
                           f'g AS (SELECT "Origin" AS airport, {R2("AVG(\"ArrDelay\")")} AS avg_delay FROM airline_delays GROUP BY 1)')
SQL["win_rank_in_case"] = q("""
SELECT *, delay_rank - volume_rank AS rank_difference,
       CASE WHEN volume_rank <= 5 AND delay_rank <= 5 THEN 'Busy & Delayed'
            WHEN volume_rank <= 5 AND delay_rank > 5 THEN 'Busy but Punctual'
            WHEN volume_rank > 5 AND delay_rank <= 5 THEN 'Quiet but Chaotic' ELSE 'Standard' END AS profile
FROM (SELECT *, RANK() OVER (ORDER BY flights DESC) AS volume_rank, RANK() OVER (ORDER BY avg_delay DESC) AS delay_rank
      FROM g)""", f'g AS (SELECT "UniqueCarrier" AS airline, COUNT(*) AS flights, {R2("AVG(\"ArrDelay\")")} AS avg_delay {BYC})')
SQL["win_conditional_rank"] = with_ctes(portable.severity()[0], """
SELECT airline, severity_profile, severe_delay_rate,
       CASE WHEN severity_profile = 'High Severity'
            THEN RANK() OVER (PARTITION BY severity_profile ORDER BY severe_delay_rate DESC NULLS FIRST) END AS profile_rank
FROM rated_named""")
SQL["win_lag"] = q('SELECT *, LAG(avg_delay) OVER (ORDER BY "Month") AS prev_avg FROM mo', MO)
SQL["win_delta"] = q(f'SELECT *, {R2("avg_delay - LAG(avg_delay) OVER (ORDER BY \"Month\")")} AS change FROM mo', MO)
SQL["win_moving_avg"] = q(f"""SELECT *, {R2('AVG(avg_delay) OVER (PARTITION BY airline ORDER BY "Month" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')}
  AS moving_avg_3 FROM cm""", CM)
_RUN = 'AVG(avg_delay) OVER (PARTITION BY airline ORDER BY "Month" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'
SQL["win_cumulative_avg"] = q(f"SELECT *, {R2(_RUN)} AS cumulative_avg, {R2('avg_delay - ' + _RUN)} AS vs_cumulative FROM cm", CM)
SQL["win_share_of_total"] = q(f"SELECT *, {R2('100.0 * flights / SUM(flights) OVER ()')} AS share_pct FROM g",
                              f'g AS (SELECT "UniqueCarrier" AS airline, COUNT(*) AS flights {BYC})')
SQL["win_share_of_group"] = q(f"""SELECT airline, "Month", flights,
  {R2('100.0 * flights / SUM(flights) OVER (PARTITION BY airline)')} AS share_of_airline_pct FROM cm""", CM)
SQL["win_row_number"] = q("""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "Month" ORDER BY flights DESC, route) AS rn
  FROM g) WHERE rn <= 3""", f'g AS (SELECT "Month", {ROUTE} AS route, COUNT(*) AS flights FROM airline_delays GROUP BY "Month", "Origin", "Dest")')

# ------------------------------------------------------------------ sort / top-k
SQL["sort_multi"] = q(f'SELECT "UniqueCarrier" AS airline, {R2("AVG(\"ArrDelay\")")} AS avg_delay, COUNT(*) AS flights '
                      f'{BYC} ORDER BY avg_delay DESC, flights, airline')
SQL["sort_case_expr"] = q(f"""
SELECT dep_hour, avg_delay, time_of_day FROM (
  SELECT "DepHour" AS dep_hour, {R2('AVG("ArrDelay")')} AS avg_delay,
         CASE WHEN "DepHour" BETWEEN 5 AND 8 THEN 'Early Morning' WHEN "DepHour" BETWEEN 9 AND 11 THEN 'Mid Morning'
              WHEN "DepHour" BETWEEN 12 AND 14 THEN 'Afternoon' WHEN "DepHour" BETWEEN 15 AND 17 THEN 'Peak Hours'
              WHEN "DepHour" BETWEEN 18 AND 20 THEN 'Evening' ELSE 'Night / Red Eye' END AS time_of_day
  FROM airline_delays GROUP BY "DepHour")
ORDER BY CASE time_of_day WHEN 'Peak Hours' THEN 1 WHEN 'Evening' THEN 2 ELSE 3 END, avg_delay DESC NULLS LAST, dep_hour""")
SQL["topk_limit"] = q(f'SELECT {ROUTE} AS route, {R2("AVG(\"ArrDelay\")")} AS avg_delay FROM airline_delays '
                      'GROUP BY "Origin", "Dest" ORDER BY avg_delay DESC, route LIMIT 10')
_G = f'g AS (SELECT "UniqueCarrier" AS airline, {R2("AVG(\"ArrDelay\")")} AS avg_delay {BYC})'
SQL["topk_both_ends"] = q("""
SELECT * FROM ((SELECT *, 'Best' AS category FROM g ORDER BY avg_delay, airline LIMIT 5)
  UNION ALL (SELECT *, 'Worst' AS category FROM g ORDER BY avg_delay DESC, airline LIMIT 5))""", _G)
SQL["topk_per_group"] = q("""SELECT * FROM (SELECT *, RANK() OVER (PARTITION BY "Month" ORDER BY avg_delay DESC) AS delay_rank
  FROM g) WHERE delay_rank <= 3""",
                          f'g AS (SELECT "Month", {ROUTE} AS route, {R2("AVG(\"ArrDelay\")")} AS avg_delay FROM airline_delays '
                          'GROUP BY "Month", "Origin", "Dest")')

# ------------------------------------------------------------------ set operations / reshape
SQL["set_union_distinct"] = q('SELECT "Origin" AS airport FROM airline_delays UNION SELECT "Dest" FROM airline_delays')
SQL["set_union_all"] = q("""
SELECT "Origin" AS airport, COUNT(*) AS flights, 'origin' AS role FROM airline_delays GROUP BY 1
UNION ALL
SELECT "Dest" AS airport, COUNT(*) AS flights, 'dest' AS role FROM airline_delays GROUP BY 1""")
SQL["unpivot_causes"] = q(uall(
    f"SELECT \"UniqueCarrier\" AS airline, '{label}' AS delay_cause, SUM(\"{c}\") AS total_minutes {BYC}"
    for c, label in CAUSES))
SQL["endpoint_explode"] = q("""
SELECT airport, SUM(n) AS total_flights FROM (
  SELECT "Origin" AS airport, COUNT(*) AS n FROM airline_delays GROUP BY 1
  UNION ALL SELECT "Dest", COUNT(*) FROM airline_delays GROUP BY 1) GROUP BY 1""".replace(
    "SUM(n) AS total_flights", "CAST(SUM(n) AS BIGINT) AS total_flights"))

# ------------------------------------------------------------------ scalar functions
SQL["fn_round2"] = q(f'SELECT "Origin", "Dest", {R2("AVG(\"ArrDelay\")")} AS avg_2dp, {R2("AVG(\"ArrDelay\") / 7")} '
                     'AS seventh_2dp FROM airline_delays GROUP BY 1, 2')
SQL["fn_abs"] = q(f'SELECT "Origin", "Dest", {R2("AVG(ABS(\"DepDelay\" - \"ArrDelay\"))")} AS mean_abs_gap '
                  'FROM airline_delays GROUP BY 1, 2')
SQL["fn_concat_route"] = q(f"SELECT DISTINCT {ROUTE} AS route FROM airline_delays")
SQL["fn_pct_text"] = q(f"""SELECT airline, CONCAT(CAST(CAST({R2('100.0 * flights / SUM(flights) OVER ()')} AS DECIMAL(38,2))
  AS VARCHAR), '%') AS share_text FROM g""", f'g AS (SELECT "UniqueCarrier" AS airline, COUNT(*) AS flights {BYC})')
SQL["fn_arith"] = q(f'SELECT "UniqueCarrier" AS airline, SUM("ArrDelay" - "DepDelay") AS sum_gap, '
                    f'SUM("ArrDelay" * 2) AS sum_double, {R2("AVG((\"ArrDelay\" + \"DepDelay\") / 2)")} AS avg_mid {BYC}')
SQL["fn_floor_div"] = q('SELECT CAST(FLOOR((CAST("ArrDelay" AS BIGINT) - 50) / 7) AS BIGINT) AS bucket, COUNT(*) AS flights '
                        'FROM airline_delays GROUP BY 1')
SQL["fn_cast"] = q("""SELECT "Month", CAST(TRUNC(avg_delay) AS BIGINT) AS avg_int,
  CAST(CAST(avg_delay AS DECIMAL(10,2)) AS VARCHAR) AS avg_text, TRY_CAST(CAST("Month" AS VARCHAR) AS BIGINT) AS month_int
FROM mo""", MO)
SQL["fn_strip"] = q(f'SELECT DISTINCT trim(chr(9) || "Dest" || \'  \', {WS}) AS "Dest" FROM flights0')
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
           "November", "December"]
SQL["fn_month_name"] = q('SELECT DISTINCT "Month", CASE "Month" ' + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(_MONTHS, 1)) + ' END AS month_name FROM airline_delays')
SQL["fn_season"] = q(f'SELECT DISTINCT "Month", {_SEASON} AS season FROM airline_delays')
SQL["fn_time_of_day"] = q("""SELECT DISTINCT "DepHour",
  CASE WHEN "DepHour" BETWEEN 5 AND 8 THEN 'Early Morning' WHEN "DepHour" BETWEEN 9 AND 11 THEN 'Mid Morning'
       WHEN "DepHour" BETWEEN 12 AND 14 THEN 'Afternoon' WHEN "DepHour" BETWEEN 15 AND 17 THEN 'Peak Hours'
       WHEN "DepHour" BETWEEN 18 AND 20 THEN 'Evening' ELSE 'Night / Red Eye' END AS time_of_day FROM airline_delays""")
SQL["fn_threshold_label"] = q("""SELECT route, avg_delay, CASE WHEN avg_delay >= 60 THEN 'Severe' WHEN avg_delay >= 45 THEN 'Heavy'
  WHEN avg_delay >= 30 THEN 'Moderate' ELSE 'Light' END AS band FROM g""",
                              f'g AS (SELECT {ROUTE} AS route, {R2("AVG(\"ArrDelay\")")} AS avg_delay FROM airline_delays GROUP BY "Origin", "Dest")')
SQL["fn_simple_case"] = q("""SELECT CASE "Month" WHEN 1 THEN 'Q1' WHEN 2 THEN 'Q1' WHEN 3 THEN 'Q1' WHEN 4 THEN 'Q2'
  WHEN 5 THEN 'Q2' WHEN 6 THEN 'Q2' WHEN 7 THEN 'Q3' WHEN 8 THEN 'Q3' WHEN 9 THEN 'Q3' WHEN 10 THEN 'Q4'
  WHEN 11 THEN 'Q4' WHEN 12 THEN 'Q4' END AS quarter, COUNT(*) AS flights FROM airline_delays GROUP BY 1""")
_CMEANS = uall(f"SELECT '{c}' AS cause, AVG(\"{c}\") AS m FROM airline_delays" for c in CAUSE_COLS)
SQL["fn_pct_format"] = q(f"""SELECT cause, CONCAT(CAST(CAST({R('100.0 * m / SUM(m) OVER ()', 1)} AS DECIMAL(38,1)) AS VARCHAR), '%')
  AS share_text, {R('m', 2)} AS mean_2dp FROM cm""", f"cm AS ({_CMEANS})")
SQL["fn_literal_tag"] = q("""
SELECT COUNT(*) AS flights, 'Before Noon' AS part FROM airline_delays WHERE "DepHour" < 12
UNION ALL SELECT COUNT(*), 'After Noon' FROM airline_delays WHERE "DepHour" >= 12""")
SQL["fn_conditional_value"] = q(f"""SELECT *, CASE WHEN avg_arr > avg_dep THEN {R2('avg_arr - avg_dep')} END AS excess_when_arr_worse
FROM (SELECT "UniqueCarrier" AS airline, {R2('AVG("ArrDelay")')} AS avg_arr, {R2('AVG("DepDelay")')} AS avg_dep {BYC})""")

# ------------------------------------------------------------------ label ladders
AS_ = f"""ast AS (SELECT "Origin" AS airport, COUNT(*) AS flights, {R2('AVG("ArrDelay")')} AS avg_delay,
  {R2('STDDEV_SAMP("ArrDelay")')} AS stddev_delay, {R2('AVG("DepDelay" - "ArrDelay")')} AS avg_recovery,
  {PCT('COUNT(CASE WHEN "ArrDelay" > 60 THEN 1 END)', 'COUNT(*)')} AS severe_rate FROM airline_delays GROUP BY 1)"""
SQL["lbl_symmetry"] = with_ctes(portable.symmetry()[0], "SELECT route_ab, delay_difference, symmetry_label FROM leg_pairs")
SQL["lbl_recovery"] = q("""SELECT airport, avg_recovery, CASE WHEN avg_recovery >= 10 THEN 'Strong Recovery'
  WHEN avg_recovery >= 0 THEN 'Slight Recovery' WHEN avg_recovery >= -10 THEN 'Slight Worsening'
  ELSE 'Strong Worsening' END AS recovery_label FROM ast""", AS_)
SQL["lbl_consistency"] = q("""SELECT airport, stddev_delay, CASE WHEN stddev_delay <= 20 THEN 'Highly Consistent'
  WHEN stddev_delay <= 30 THEN 'Moderately Consistent' ELSE 'Inconsistent' END AS consistency_label FROM ast""", AS_)
SQL["lbl_performance"] = q("""SELECT airport, consistency_rank, avg_delay_rank,
  CASE WHEN consistency_rank <= 3 AND avg_delay_rank <= 3 THEN 'Best Overall'
       WHEN consistency_rank <= 3 THEN 'Consistent but Slow' WHEN avg_delay_rank <= 3 THEN 'Fast but Unpredictable'
       ELSE 'Standard' END AS performance_profile
FROM (SELECT *, RANK() OVER (ORDER BY stddev_delay ASC NULLS LAST) AS consistency_rank,
             RANK() OVER (ORDER BY avg_delay ASC NULLS LAST) AS avg_delay_rank FROM ast)""", AS_)
SQL["lbl_airline_trend"] = with_ctes(portable.monthly_changes(1), "SELECT airline, Month, mom_change, trend_label FROM changes_named")
OM = f"""om AS (SELECT airport, "Month", avg_delay,
  {R2('avg_delay - LAG(avg_delay) OVER (PARTITION BY airport ORDER BY "Month")')} AS mom_change
  FROM (SELECT "Origin" AS airport, "Month", {R2('AVG("ArrDelay")')} AS avg_delay FROM airline_delays GROUP BY 1, 2))"""
SQL["lbl_overall_trend"] = q(f"""SELECT airport, {R2('AVG(mom_change)')} AS avg_mom_change,
  CASE WHEN CAST(AVG(mom_change) AS DECIMAL(38,10)) <= -2 THEN 'Overall Improving'
       WHEN CAST(AVG(mom_change) AS DECIMAL(38,10)) >= 2 THEN 'Overall Worsening' ELSE 'Stable' END AS overall_trend
FROM om WHERE mom_change IS NOT NULL GROUP BY airport""", OM)
SQL["lbl_severity"] = q("""SELECT airport, severe_rate, CASE WHEN severe_rate >= 40 THEN 'Critical'
  WHEN severe_rate >= 30 THEN 'High Severity' WHEN severe_rate >= 20 THEN 'Moderate Severity' ELSE 'Low Severity' END
  AS severity_profile FROM ast""", AS_)
SQL["bucket_delay"] = q("""SELECT "DepHour" AS dep_hour, COUNT(CASE WHEN "ArrDelay" BETWEEN 15 AND 30 THEN 1 END) AS mild,
  COUNT(CASE WHEN "ArrDelay" BETWEEN 31 AND 60 THEN 1 END) AS moderate, COUNT(CASE WHEN "ArrDelay" > 60 THEN 1 END) AS severe,
  COUNT(*) AS flights FROM airline_delays GROUP BY 1""")
SQL["lbl_airport_profile"] = with_ctes(portable.volume()[0], "SELECT airport, volume_rank, delay_rank, airport_profile FROM busy_named")
SQL["lbl_delay_profile"] = with_ctes(portable.profile(1)[0], "SELECT airport, delay_profile, ground_ops_rank FROM profiled")
SQL["lbl_hour_risk"] = q(f"""SELECT airline, major_delay_prob, CASE WHEN major_delay_prob >= 40 THEN 'Very High Risk'
  WHEN major_delay_prob >= 30 THEN 'High Risk' WHEN major_delay_prob >= 20 THEN 'Moderate Risk' ELSE 'Low Risk' END AS risk_label
FROM (SELECT "UniqueCarrier" AS airline, {PCT('COUNT(CASE WHEN "ArrDelay" > 60 THEN 1 END)', 'COUNT(*)')} AS major_delay_prob {BYC})""")
SQL["lbl_month_trend"] = q("""SELECT *, CASE WHEN mom_change IS NULL THEN 'Baseline' WHEN mom_change <= -5 THEN 'Strong Improvement'
  WHEN mom_change < 0 THEN 'Slight Improvement' WHEN mom_change <= 5 THEN 'Slight Worsening' ELSE 'Strong Worsening' END
  AS mom_trend FROM om""", OM)
SQL["lbl_trend_position"] = q(f"""SELECT *, CASE WHEN vs_cumulative_avg > 5 THEN 'Above Trend' WHEN vs_cumulative_avg < -5 THEN 'Below Trend'
  ELSE 'On Trend' END AS trend_position FROM (
  SELECT airport, "Month", avg_delay,
         {R2('avg_delay - AVG(avg_delay) OVER (PARTITION BY airport ORDER BY "Month" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')}
         AS vs_cumulative_avg FROM om)""", OM)


def _cause_rank_ctes(key: str) -> str:
    union = uall(f"""SELECT "{key}" AS k, '{label}' AS delay_cause, SUM("{c}") AS total_minutes,
  COUNT(CASE WHEN "{c}" > 0 THEN 1 END) AS flights_affected,
  {R2(f'AVG(CASE WHEN "{c}" > 0 THEN "{c}" END)')} AS avg_when_present FROM airline_delays GROUP BY 1""" for c, label in CAUSES)
    return f"""ct AS ({union}),
cr AS (SELECT *, RANK() OVER (PARTITION BY k ORDER BY total_minutes DESC NULLS FIRST) AS cause_rank,
  {R2('100.0 * total_minutes / SUM(total_minutes) OVER (PARTITION BY k)')} AS pct_of_total FROM ct)"""


SQL["lbl_impact"] = q("""SELECT k AS airline, delay_cause, pct_of_total AS pct_of_airline_total,
  CASE WHEN pct_of_total >= 30 THEN 'Dominant Cause' WHEN pct_of_total >= 20 THEN 'Major Cause'
       WHEN pct_of_total >= 10 THEN 'Moderate Cause' ELSE 'Minor Cause' END AS impact_label FROM cr""",
                      _cause_rank_ctes("UniqueCarrier"))
SQL["lbl_spread"] = q("""SELECT airline, delay_cause, breadth_rank, severity_rank,
  CASE WHEN breadth_rank <= 2 AND severity_rank <= 2 THEN 'Wide & Severe' WHEN breadth_rank <= 2 AND severity_rank > 2
       THEN 'Wide but Mild' WHEN breadth_rank > 2 AND severity_rank <= 2 THEN 'Narrow but Severe' ELSE 'Narrow & Mild' END
       AS spread_label
FROM (SELECT k AS airline, delay_cause,
             RANK() OVER (PARTITION BY k ORDER BY flights_affected DESC NULLS FIRST) AS breadth_rank,
             RANK() OVER (PARTITION BY k ORDER BY avg_when_present DESC NULLS FIRST) AS severity_rank FROM cr)""",
                      _cause_rank_ctes("UniqueCarrier"))
SQL["lbl_network"] = q("""SELECT k AS airport, delay_cause, CASE WHEN delay_cause = 'Late Aircraft Delay'
  THEN 'Follows Network Pattern' ELSE 'Deviates from Network' END AS vs_network FROM cr WHERE cause_rank = 1""",
                       _cause_rank_ctes("Origin"))
SQL["lbl_concentration"] = q("""SELECT k AS airport, delay_cause, pct_of_total AS pct_of_airline_total,
  CASE WHEN pct_of_total >= 50 THEN 'Highly Concentrated' WHEN pct_of_total >= 40 THEN 'Moderately Concentrated'
       ELSE 'Distributed' END AS concentration_label FROM cr WHERE cause_rank = 1""", _cause_rank_ctes("Origin"))

# ------------------------------------------------------------------ report marts
from tarmac.plans.oracle import SQL as _A  # noqa: E402

_CTRL = "('Late Aircraft Delay', 'Carrier Delay')"


def _sub(key: str) -> str:
    return f"({_A[key]})"


SQL["mart_controllable_pct"] = (
    f"SELECT {R2('SUM(pct_of_total_minutes)')} AS controllable_pct FROM {_sub('q11_cause_totals')} q "
    f"WHERE delay_cause IN {_CTRL}")
_WINDOW = """CASE WHEN "DepHour" BETWEEN 5 AND 8 THEN 'Early Morning' WHEN "DepHour" BETWEEN 9 AND 11 THEN 'Mid Morning'
  WHEN "DepHour" BETWEEN 12 AND 14 THEN 'Afternoon' WHEN "DepHour" BETWEEN 15 AND 17 THEN 'Peak Hours'
  WHEN "DepHour" BETWEEN 18 AND 20 THEN 'Evening' ELSE 'Night / Red Eye' END"""
SQL["mart_kpi"] = with_ctes(portable.monthly()[0] + "," + portable.causes()[0] + f""",
cr AS (SELECT "UniqueCarrier" AS c, {R2('AVG("ArrDelay")')} AS v FROM airline_delays GROUP BY 1),
tw AS (SELECT {_WINDOW} AS w, {R2('AVG("ArrDelay")')} AS v FROM airline_delays GROUP BY 1)""", f"""
SELECT 'total_flights' AS metric, CAST((SELECT COUNT(*) FROM airline_delays) AS VARCHAR) AS value
UNION ALL SELECT 'avg_arrival_delay', CAST((SELECT {R2('AVG(avg_arr_delay)')} FROM months) AS VARCHAR)
UNION ALL SELECT 'avg_arrival_delay_rows', CAST((SELECT {R2('AVG("ArrDelay")')} FROM airline_delays) AS VARCHAR)
UNION ALL SELECT 'controllable_pct', CAST((SELECT {R2('SUM(pct_of_total_minutes)')} FROM cause_report
                                          WHERE delay_cause IN {_CTRL}) AS VARCHAR)
UNION ALL SELECT 'best_month', (SELECT month_name FROM months ORDER BY avg_arr_delay, "Month" LIMIT 1)
UNION ALL SELECT 'worst_month', (SELECT month_name FROM months ORDER BY avg_arr_delay DESC, "Month" DESC LIMIT 1)
UNION ALL SELECT 'most_delayed_airline', (SELECT c FROM cr ORDER BY v DESC, c DESC LIMIT 1)
UNION ALL SELECT 'least_delayed_airline', (SELECT c FROM cr ORDER BY v, c LIMIT 1)
UNION ALL SELECT 'best_time_window', (SELECT w FROM tw ORDER BY v, w LIMIT 1)""")
SQL["mart_monthly_trend"] = f"""
SELECT *, avg_arr_delay = MIN(avg_arr_delay) OVER () AS is_best_month,
       avg_arr_delay = MAX(avg_arr_delay) OVER () AS is_worst_month
FROM {_sub('q10_monthly_rolling')} q"""
SQL["mart_cause_contribution"] = f"""
SELECT impact_rank, delay_cause, total_minutes, pct_of_total_minutes, impact_label FROM {_sub('q11_cause_totals')} q"""
SQL["mart_airline_performance"] = f"""
SELECT s.airline, s.total_flights, s.avg_delay, s.severity_rank, s.severe_delay_rate, s.severity_profile,
       c.consistency_rank, c.stddev_delay, c.consistency_label, c.performance_profile,
       m.avg_mom_change, m.overall_trend, d.dominant_cause, d.dominant_pct, d.concentration_label
FROM {_sub('q06_severity_profile')} s
LEFT JOIN {_sub('q04_airline_consistency')} c ON s.airline = c.airline
LEFT JOIN {_sub('q05_airline_momentum')} m ON s.airline = m.airline
LEFT JOIN (SELECT DISTINCT airline, dominant_cause, dominant_pct, concentration_label
           FROM {_sub('q12_dominant_cause')} x) d ON s.airline = d.airline"""
SQL["mart_routes"] = f"""
SELECT route, 'Repeat Worst' AS list_name, overall_avg_delay AS value, months_in_top10
FROM {_sub('q01_repeat_worst_routes')} a
UNION ALL
SELECT route, category, avg_recovery, CAST(NULL AS BIGINT) FROM {_sub('q03_delay_recovery')} b"""
SQL["mart_airport_profiles"] = f"""
SELECT v.*, p.avg_dep_delay, p.avg_arr_delay, p.dep_vs_global, p.arr_vs_global, p.delay_profile
FROM ({with_ctes(*portable.volume(top=None))}) v
JOIN {_sub('q08_dep_arr_profile')} p ON v.airport = p.airport"""
_AIRLINE_SECTIONS = {"severity_rank": "severity_profile", "total_flights": "performance_profile", "avg_delay": "severity_profile", "severe_delay_rate": "severity_profile",
                     "consistency_rank": "performance_profile", "stddev_delay": "consistency_label", "avg_mom_change": "overall_trend"}
SQL["mart_executive"] = f"""
WITH kpis AS ({SQL['mart_kpi']}), ranking AS ({SQL['mart_airline_performance']})
SELECT 'kpi' AS section, metric AS item, TRY_CAST(value AS DOUBLE) AS value, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS label FROM kpis
UNION ALL SELECT 'month', month_name, avg_arr_delay, mom_trend FROM {_sub('q10_monthly_rolling')} a
UNION ALL SELECT 'cause', delay_cause, pct_of_total_minutes, impact_label FROM {_sub('q11_cause_totals')} b
UNION ALL SELECT 'airline: dominant_share', airline, CAST(REPLACE(dominant_pct, '%', '') AS DOUBLE), dominant_cause FROM ranking
""" + "\n".join(f"UNION ALL SELECT 'airline: {v}', airline, {v}, {label} FROM ranking" for v, label in _AIRLINE_SECTIONS.items())
SQL["mart_deep_dive"] = f"""
SELECT 'hour' AS section, CAST(dep_hour AS VARCHAR) AS item, major_delay_prob AS value, risk_label AS label FROM {_sub('q09_hour_risk')} a
UNION ALL SELECT 'dominant cause', airline, dominant_avg_mins, dominant_cause FROM {_sub('q12_dominant_cause')} b
UNION ALL SELECT category, route, avg_recovery, recovery_label FROM {_sub('q03_delay_recovery')} c"""
SQL["mart_airport"] = f"""
WITH both_views AS ({SQL['mart_airport_profiles']})
SELECT 'volume and delay' AS section, airport AS item, avg_delay AS value, airport_profile AS label FROM both_views
UNION ALL SELECT 'departure and arrival', airport, dep_vs_global, delay_profile FROM both_views"""
SQL["mart_rag_tier"] = q(f"""
SELECT airline, avg_delay, CASE WHEN avg_delay >= 55 THEN 'Red' WHEN avg_delay >= 45 THEN 'Amber' ELSE 'Green' END AS tier
FROM (SELECT "UniqueCarrier" AS airline, {R2('AVG("ArrDelay")')} AS avg_delay {BYC})""")
SQL["mart_dep_hour_risk"] = _A["q09_hour_risk"]
SQL["mart_pivot_airline_month"] = q('SELECT "UniqueCarrier" AS airline, ' + ", ".join(
    f'{R2(f"AVG(CASE WHEN \"Month\" = {m} THEN \"ArrDelay\" END)")} AS m{m:02d}' for m in range(1, 13)) + f" {BYC}")

# ------------------------------------------------------------------ sources and sinks
SQL["src_csv"] = q("SELECT * FROM flights0")
SQL["src_table"] = q("SELECT * FROM airline_delays")
SQL["sink_csv"] = q("SELECT * FROM airline_delays")
SQL["sink_table"] = q("SELECT * FROM airline_delays")
_EXPORTED = [
    "q01_repeat_worst_routes", "q02_route_symmetry", "q03_delay_recovery", "q04_airline_consistency",
    "q05_airline_momentum", "q06_severity_profile", "q07_volume_vs_delay", "q08_dep_arr_profile",
    "q09_hour_risk", "q10_monthly_rolling", "q11_cause_totals", "q12_dominant_cause",
]
SQL["sink_query_exports"] = uall(
    f"SELECT '{k}' AS export_name, COUNT(*) AS rows FROM {_sub(k)} x" for k in _EXPORTED)
SQL["stream_ingest"] = q("SELECT * FROM flights0")

# ------------------------------------------------------------------ raw file and the cleaning pipeline
_RAW = """
raw AS (
  SELECT ok * 8 + ln AS "Unnamed: 0", CAST(2008 AS BIGINT) AS "Year", mon AS "Month", ok % 28 + 1 AS "DayofMonth",
         ok % 7 + 1 AS "DayOfWeek",
         CASE WHEN ok % 97 = 0 THEN 2400.0
              ELSE CAST(FLOOR((((hr * 60 + ok % 60 + dep) % 1440) + 1440) % 1440 / 60) * 100
                        + ((((hr * 60 + ok % 60 + dep) % 1440) + 1440) % 1440) % 60 AS DOUBLE) END AS "DepTime",
         hr * 100 + ok % 60 AS "CRSDepTime",
         CASE WHEN ok % 37 = 0 THEN NULL
              ELSE CAST(FLOOR((((hr * 60 + ok % 60 + 95 + arr) % 1440) + 1440) % 1440 / 60) * 100
                        + ((((hr * 60 + ok % 60 + 95 + arr) % 1440) + 1440) % 1440) % 60 AS DOUBLE) END AS "ArrTime",
         CAST(FLOOR(((hr * 60 + ok % 60 + 95) % 1440) / 60) * 100 + ((hr * 60 + ok % 60 + 95) % 1440) % 60 AS BIGINT)
           AS "CRSArrTime",
         CASE WHEN ok % 11 = 0 THEN ' ' || concat('C', lpad(CAST(ci AS VARCHAR), 2, '0')) || ' '
              ELSE concat('C', lpad(CAST(ci AS VARCHAR), 2, '0')) END AS "UniqueCarrier",
         ok % 7000 + 1 AS "FlightNum",
         CASE WHEN ok % 41 = 0 THEN NULL ELSE 'N' || CAST(ok % 900 + 100 AS VARCHAR) || 'AA' END AS "TailNum",
         CAST(95 + arr - dep AS DOUBLE) AS "ActualElapsedTime", CAST(95.0 AS DOUBLE) AS "CRSElapsedTime",
         CAST(75 + arr - dep AS DOUBLE) AS "AirTime", CAST(arr AS DOUBLE) AS "ArrDelay", CAST(dep AS DOUBLE) AS "DepDelay",
         CASE WHEN ok % 13 = 1 THEN chr(9) || origin ELSE origin END AS "Origin",
         CASE WHEN ok % 17 = 2 THEN dest || ' ' ELSE dest END AS "Dest",
         CASE WHEN ok % 211 = 1 THEN NULL ELSE ok % 2200 + 300 END AS "Distance",
         CASE WHEN ok % 199 = 3 THEN NULL ELSE CAST(ok % 10 + 5 AS DOUBLE) END AS "TaxiIn", CAST(ok % 15 + 10 AS DOUBLE) AS "TaxiOut",
         CAST(ok % 37 = 0 AND ok % 2 = 0 AS INTEGER) AS "Cancelled",
         CASE WHEN ok % 37 > 0 THEN 'N' WHEN ok % 2 = 0 THEN ['A', 'B', 'C'][CAST(ok % 3 + 1 AS INT)] END AS "CancellationCode",
         CAST(ok % 37 = 0 AND ok % 2 = 1 AS INTEGER) AS "Diverted",
         CASE WHEN ok % 23 = 0 THEN NULL ELSE CAST(car AS DOUBLE) END AS "CarrierDelay",
         CASE WHEN ok % 29 = 0 THEN NULL ELSE CAST(wx AS DOUBLE) END AS "WeatherDelay",
         CASE WHEN ok % 31 = 0 THEN NULL ELSE CAST(nas AS DOUBLE) END AS "NASDelay",
         CAST(sec AS DOUBLE) AS "SecurityDelay", CAST(arr - wx - sec - nas - car AS DOUBLE) AS "LateAircraftDelay"
  FROM r)"""
_ORIG = _RAW + f""",
orig AS (
  SELECT "Year", "Month", "DayofMonth", "DayOfWeek", CAST(TRUNC("DepTime") AS BIGINT) AS "DepTime", "CRSDepTime",
         CAST(TRUNC("ArrTime") AS BIGINT) AS "ArrTime", "CRSArrTime", trim("UniqueCarrier", {WS}) AS "UniqueCarrier",
         "FlightNum", "ActualElapsedTime", "CRSElapsedTime", "AirTime", "ArrDelay", "DepDelay",
         trim("Origin", {WS}) AS "Origin", trim("Dest", {WS}) AS "Dest", "Distance", "TaxiIn", "TaxiOut", "Cancelled",
         "CancellationCode", "Diverted", "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
         CAST(FLOOR(TRUNC("DepTime") / 100) AS BIGINT) AS "DepHour", CAST(FLOOR(TRUNC("ArrTime") / 100) AS BIGINT) AS "ArrHour"
  FROM raw
  WHERE "ArrTime" IS NOT NULL AND "ActualElapsedTime" IS NOT NULL AND "CRSElapsedTime" IS NOT NULL
    AND "AirTime" IS NOT NULL AND "ArrDelay" IS NOT NULL AND "TaxiIn" IS NOT NULL AND "TaxiOut" IS NOT NULL
    AND "CarrierDelay" IS NOT NULL AND "WeatherDelay" IS NOT NULL AND "NASDelay" IS NOT NULL
    AND "SecurityDelay" IS NOT NULL AND "LateAircraftDelay" IS NOT NULL),
ob AS (SELECT quantile_cont("ArrDelay", 0.25) AS aq1, quantile_cont("ArrDelay", 0.75) AS aq3,
              quantile_cont("DepDelay", 0.25) AS dq1, quantile_cont("DepDelay", 0.75) AS dq3 FROM orig)"""
SQL["src_csv_raw"] = q("SELECT * FROM raw", _RAW)
SQL["pipeline_original"] = q("SELECT * FROM orig", _ORIG)
SQL["pipeline_clean"] = q("""
SELECT o.* REPLACE (CAST(FLOOR(o."CRSDepTime" / 100) AS BIGINT) AS "DepHour") FROM orig o, ob b
WHERE o."ArrDelay" >= b.aq1 - 1.5 * (b.aq3 - b.aq1) AND o."ArrDelay" <= b.aq3 + 1.5 * (b.aq3 - b.aq1)
  AND o."DepDelay" >= b.dq1 - 1.5 * (b.dq3 - b.dq1) AND o."DepDelay" <= b.dq3 + 1.5 * (b.dq3 - b.dq1)""", _ORIG)
SQL["prof_invariants_raw"] = q("""
SELECT 'arr_delay_at_least_min' AS check_name, COUNT(CASE WHEN NOT ("ArrDelay" >= 15) THEN 1 END) AS violations FROM orig
UNION ALL SELECT 'Cancelled_is_zero', COUNT(CASE WHEN "Cancelled" <> 0 THEN 1 END) FROM orig
UNION ALL SELECT 'Diverted_is_zero', COUNT(CASE WHEN "Diverted" <> 0 THEN 1 END) FROM orig
UNION ALL SELECT 'causes_sum_to_arr_delay', COUNT(CASE WHEN COALESCE("CarrierDelay", 0) + COALESCE("WeatherDelay", 0)
       + COALESCE("NASDelay", 0) + COALESCE("SecurityDelay", 0) + COALESCE("LateAircraftDelay", 0) <> "ArrDelay"
       THEN 1 END) FROM orig""", _ORIG)
SQL["prof_distinct_flags"] = q("""
SELECT DISTINCT 'CancellationCode' AS column_name, "CancellationCode" AS value FROM raw
UNION ALL SELECT DISTINCT 'Diverted', CAST("Diverted" AS VARCHAR) FROM raw
UNION ALL SELECT DISTINCT 'Cancelled', CAST("Cancelled" AS VARCHAR) FROM raw""", _RAW)
SQL["pipeline_rejected_rows"] = q("""
SELECT ok * 8 + ln AS row_number, 'Distance' AS column, 'far' AS token FROM r WHERE ok % 211 = 1
UNION ALL SELECT ok * 8 + ln, 'TaxiIn', '12min' FROM r WHERE ok % 199 = 3""")
_BAD = {"Distance": "ok % 211 = 1", "TaxiIn": "ok % 199 = 3"}
SQL["pipeline_rejects"] = q("\nUNION ALL ".join([
    "SELECT 'rows_read' AS counted, COUNT(*) AS rows FROM raw", "SELECT 'rows_kept', COUNT(*) FROM orig",
    "SELECT 'rows_incomplete', (SELECT COUNT(*) FROM raw) - COUNT(*) FROM orig", "SELECT 'rows_rejected', COUNT(*) FROM r WHERE ok % 211 = 1 OR ok % 199 = 3",
    *(f"SELECT 'bad_{n}', COUNT(*) FROM r WHERE {_BAD.get(n, 'false')}" for n, t in RAW_COLUMNS if t != "string")]), _ORIG)
