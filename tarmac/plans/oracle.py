"""Independent SQL (DuckDB dialect) for every registered query.

The named analyses come from :mod:`tarmac.plans.portable`; DuckDB runs them
against the DataFrame plans, and against the same text in Spark SQL. The forms
of SQL there have oracles of another derivation here. All sides round through
``DECIMAL(38,10)`` and spell tiebreaks for every LIMIT.
"""

from __future__ import annotations

from tarmac.plans import portable

# The fact view over the driver's tables, then the IQR filter (DuckDB).
FLIGHTS0_CTES = """
k AS (
  SELECT CAST(l.l_orderkey AS BIGINT) AS ok, CAST(l.l_linenumber AS BIGINT) AS ln,
         CAST(l.l_partkey AS BIGINT) AS pk, CAST(l.l_quantity AS BIGINT) AS q,
         CAST(l.l_partkey % 20 AS BIGINT) AS ci, CAST(s.s_nationkey AS BIGINT) AS sn, CAST(c.c_nationkey AS BIGINT) AS cn,
         ns.n_name AS origin, nc.n_name AS dest,
         CAST(EXTRACT(MONTH FROM l.l_shipdate) AS BIGINT) AS mon,
         (l.l_orderkey * 7 + l.l_linenumber * 3) % 24 AS hr
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation ns ON ns.n_nationkey = s.s_nationkey
  JOIN nation nc ON nc.n_nationkey = c.c_nationkey),
d AS (
  SELECT *, 6 + ((ok * 13 + pk * 7 + ln * 29) % 97) * (35 + ci * 3) / 100
            + CASE WHEN hr BETWEEN 15 AND 20 THEN 12 WHEN hr BETWEEN 5 AND 8 THEN -5 ELSE 0 END
            + CASE WHEN mon IN (6, 12) THEN 9 WHEN mon IN (5, 10) THEN -3 ELSE 0 END
            + (sn * 7) % 13
            + CASE WHEN ok % 211 = 0 THEN 400 ELSE 0 END AS dep_raw
  FROM k),
e AS (SELECT *, CAST(FLOOR(dep_raw) AS BIGINT) AS dep FROM d),
a AS (
  SELECT *, dep + q % 31 - 8 - CASE WHEN sn % 5 = 0 THEN 12 ELSE 0 END + CASE WHEN cn % 6 = 0 THEN 14 ELSE 0 END AS arr FROM e),
n AS (
  SELECT *, CASE WHEN ok % 13 = 0 THEN CAST(FLOOR(arr * 3 / 10) AS BIGINT) ELSE 0 END AS wx,
            CASE WHEN ok % 197 = 0 THEN 2 ELSE 0 END AS sec,
            CAST(FLOOR(arr * (5 + (ci % 4) * 13) / 100) AS BIGINT) AS nas
  FROM a WHERE arr >= 15),
r AS (SELECT *, CAST(FLOOR((arr - wx - sec - nas) * (15 + (ci * 7) % 60) / 100) AS BIGINT) AS car FROM n),
flights0 AS (
SELECT CAST(mon AS BIGINT) AS "Month", CAST(hr AS BIGINT) AS "DepHour",
       concat('C', lpad(CAST(ci AS VARCHAR), 2, '0')) AS "UniqueCarrier", origin AS "Origin", dest AS "Dest",
       CAST(dep AS DOUBLE) AS "DepDelay", CAST(arr AS DOUBLE) AS "ArrDelay",
       CAST(car AS DOUBLE) AS "CarrierDelay", CAST(wx AS DOUBLE) AS "WeatherDelay", CAST(nas AS DOUBLE) AS "NASDelay",
       CAST(sec AS DOUBLE) AS "SecurityDelay", CAST(arr - wx - sec - nas - car AS DOUBLE) AS "LateAircraftDelay"
FROM r)"""

IQR_CTES = """
iqr_q AS (
  SELECT quantile_cont("ArrDelay", 0.25) AS aq1, quantile_cont("ArrDelay", 0.75) AS aq3,
         quantile_cont("DepDelay", 0.25) AS dq1, quantile_cont("DepDelay", 0.75) AS dq3
  FROM flights0),
airline_delays AS (
  SELECT f.* FROM flights0 f CROSS JOIN iqr_q q
  WHERE f."ArrDelay" >= q.aq1 - 1.5 * (q.aq3 - q.aq1) AND f."ArrDelay" <= q.aq3 + 1.5 * (q.aq3 - q.aq1)
    AND f."DepDelay" >= q.dq1 - 1.5 * (q.dq3 - q.dq1) AND f."DepDelay" <= q.dq3 + 1.5 * (q.dq3 - q.dq1))"""


def R(x: str, scale: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {scale}) AS DOUBLE)"


def R2(x: str) -> str:
    return R(x, 2)


def PCT(n: str, t: str, scale: int = 2) -> str:
    return R(f"100.0 * {n} / {t}", scale)


def with_flights(ctes: str, select: str) -> str:
    """``WITH <flights0>, <iqr>, <ctes> <select>`` (``ctes`` may be empty)."""
    extra = f",\n{ctes}" if ctes.strip() else ""
    return f"WITH {FLIGHTS0_CTES},{IQR_CTES}{extra}\n{select}"


CAUSES = [
    ("CarrierDelay", "Carrier Delay"),
    ("WeatherDelay", "Weather Delay"),
    ("NASDelay", "NAS Delay"),
    ("SecurityDelay", "Security Delay"),
    ("LateAircraftDelay", "Late Aircraft Delay"),
]

ROUTE = "\"Origin\" || ' → ' || \"Dest\""

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- scope and Q1-Q12
def with_ctes(ctes: str, select: str) -> str:
    """The flights, then ``ctes`` and ``select``."""
    return portable.duckdb(portable.text((ctes, select), f"{FLIGHTS0_CTES},{IQR_CTES}"))


for _key, (_ctes, _select) in portable.STATEMENTS.items():
    SQL[_key] = with_ctes(_ctes, _select)

# Other derivations for the forms: windows over rows in place of chains of groups, and the calendar in place of lists of names.
SQL["cte_chain"] = with_flights("", f"""
SELECT airline, months, monthly_range, (SELECT COUNT(*) + 1 FROM (
         SELECT DISTINCT "UniqueCarrier" AS other, MAX(v) OVER w - MIN(v) OVER w AS span
         FROM (SELECT DISTINCT "UniqueCarrier", "Month", {R2('AVG("ArrDelay") OVER (PARTITION BY "UniqueCarrier", "Month")')} AS v FROM airline_delays) x
         WINDOW w AS (PARTITION BY "UniqueCarrier")) y WHERE {R2('span')} > monthly_range) AS range_rank
FROM (SELECT u AS airline, LEN(vs) AS months, {R2('LIST_MAX(vs) - LIST_MIN(vs)')} AS monthly_range
      FROM (SELECT u, LIST(v) AS vs FROM (SELECT "UniqueCarrier" AS u, "Month", {R2('SUM("ArrDelay") / COUNT("ArrDelay")')} AS v FROM airline_delays GROUP BY ALL) a GROUP BY u) b) c""")
SQL["subquery_from"] = with_flights("", """
SELECT "Month", MAX(per_hour) AS flights_in_busiest_hour, COUNT(DISTINCT "DepHour") AS hours_flown
FROM (SELECT "Month", "DepHour", COUNT(*) OVER (PARTITION BY "Month", "DepHour") AS per_hour FROM airline_delays) f GROUP BY 1""")
SQL["subquery_scalar"] = with_flights("", f"""
SELECT DISTINCT "UniqueCarrier" AS airline, {R2('own')} AS avg_delay
FROM (SELECT "UniqueCarrier", AVG("ArrDelay") OVER (PARTITION BY "UniqueCarrier") AS own, AVG("ArrDelay") OVER () AS overall FROM airline_delays) f
WHERE own > overall""")
SQL["udf_apply"] = with_flights("", """
SELECT "Month", MONTHNAME(MAKE_DATE(2008, CAST("Month" AS INT), 1)) AS month_name,
       ['Winter', 'Spring', 'Summer', 'Fall'][CAST("Month" % 12 // 3 + 1 AS INT)] AS season, COUNT(*) AS total_flights
FROM airline_delays GROUP BY 1""")
SQL["q05_monthly_changes"] = with_ctes(portable.monthly_changes(), """
SELECT airline, Month, avg_delay, total_flights, prev_month_avg, mom_change, trend_label FROM changes_named""")


# ---------------------------------------------------------------- EDA
def _means(key: str, extra: str = "") -> str:
    return with_flights("", f"""
SELECT "{key}", {R('AVG("ArrDelay")', 6)} AS "ArrDelay", {R('AVG("DepDelay")', 6)} AS "DepDelay"{extra}
FROM airline_delays WHERE "{key}" IS NOT NULL GROUP BY "{key}" ORDER BY 2 DESC""")


SQL["eda_airline_means"] = _means("UniqueCarrier")
SQL["eda_month_means"] = with_flights("", f"""
SELECT "Month", {R('AVG("ArrDelay")', 6)} AS "ArrDelay", {R('AVG("DepDelay")', 6)} AS "DepDelay",
       {portable.month_name('"Month"')} AS "Month_Name"
FROM airline_delays WHERE "Month" IS NOT NULL GROUP BY "Month" ORDER BY 2 DESC""")
SQL["eda_origin_means"] = _means("Origin")
SQL["eda_dest_means"] = _means("Dest")
SQL["eda_hour_means"] = _means("DepHour")
SQL["eda_hour_counts"] = with_flights(
    "", 'SELECT "DepHour", COUNT(*) AS flights FROM airline_delays WHERE "DepHour" IS NOT NULL GROUP BY "DepHour"')
_cause_means_union = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS cause, AVG(\"{c}\") AS mean_minutes FROM airline_delays" for c, _ in CAUSES)
SQL["eda_cause_means"] = with_flights(f"cm AS ({_cause_means_union})",
                                      f"SELECT cause, {R('mean_minutes', 6)} AS mean_minutes FROM cm")
SQL["eda_cause_share"] = with_flights(f"cm AS ({_cause_means_union})", f"""
SELECT cause, {R('mean_minutes', 6)} AS mean_minutes,
       {R('100.0 * mean_minutes / SUM(mean_minutes) OVER ()', 1)} AS share_pct,
       CONCAT(CAST(CAST({R('100.0 * mean_minutes / SUM(mean_minutes) OVER ()', 1)} AS DECIMAL(38,1)) AS VARCHAR), '%')
         AS share_text
FROM cm""")

_CORR_COLS = ["ArrDelay", "DepDelay", "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"]
SQL["eda_corr"] = with_flights("", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + R(f'CORR("{a}", "{b}")', 4) + " AS corr FROM airline_delays"
    for a in _CORR_COLS for b in _CORR_COLS))

_EXT_DIMS = [("carrier", "UniqueCarrier"), ("month", "Month"), ("origin", "Origin"), ("dest", "Dest")]
_ext_groups = "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS dimension, CAST("{c}" AS VARCHAR) AS key, {R('AVG("ArrDelay")', 6)} AS "ArrDelay",
       {R('AVG("DepDelay")', 6)} AS "DepDelay" FROM airline_delays WHERE "{c}" IS NOT NULL GROUP BY "{c}\""""
    for n, c in _EXT_DIMS)
SQL["eda_extremes"] = with_flights(f"g AS ({_ext_groups})", "\nUNION ALL\n".join(f"""
SELECT h.dimension, '{m}' AS measure, h.key AS highest, h.v AS highest_mean, l.key AS lowest, l.v AS lowest_mean
FROM (SELECT dimension, key, "{m}" AS v, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY "{m}" DESC, key) AS rn
      FROM g) h
JOIN (SELECT dimension, key, "{m}" AS v, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY "{m}" ASC, key) AS rn
      FROM g) l ON h.dimension = l.dimension AND h.rn = 1 AND l.rn = 1""" for m in ("ArrDelay", "DepDelay")))
