"""The named analyses as SQL text that Spark SQL and DuckDB run alike.

Each statement aggregates ``airline_delays`` once, at its own key, and goes on
with those few rows. Means are ``AVG`` (NULL delays do not count), shares are
NULL where there is nothing to share, and orders spell where NULLs go, so the
statements and the DataFrame analyses give the same rows. Labels and their
thresholds come from the one table in ``tarmac.functions.labels``.

Where rows are repeated (both ends of a flight, five causes) the text says
``EXPLODE(ARRAY(...))``; ``duckdb`` names DuckDB's functions instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from tarmac.functions import labels as L

CAUSES = (("CarrierDelay", "Carrier Delay"), ("WeatherDelay", "Weather Delay"), ("NASDelay", "NAS Delay"), ("SecurityDelay", "Security Delay"),
          ("LateAircraftDelay", "Late Aircraft Delay"))


def duckdb(sql: str) -> str:
    return sql.replace("EXPLODE(ARRAY(", "UNNEST(LIST_VALUE(")


# -- pieces of text -------------------------------------------------------------

def r2(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def over(part: str, whole: str) -> str:
    return f"{part} / NULLIF({whole}, 0)"


def share(part: str, whole: str) -> str:
    return r2(over(f"100.0 * {part}", whole))


def text_of(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def ladder(x: str, rungs: tuple[Sequence[tuple], str]) -> str:
    """The label of the first rung that holds, else the default."""
    steps, default = rungs
    cases = [f"WHEN {x} IS NULL THEN {text_of(name)}" if op == "isnull" else f"WHEN {x} {op} {bound} THEN {text_of(name)}" for op, bound, name in steps]
    return f"CASE {' '.join(cases)} ELSE {text_of(default)} END"


def two(first: str, second: str, names: Sequence[str]) -> str:
    both, only_first, only_second, neither = map(text_of, names)
    return f"CASE WHEN {first} AND {second} THEN {both} WHEN {first} THEN {only_first} WHEN {second} THEN {only_second} ELSE {neither} END"


def month_name(m: str) -> str:
    return f"CASE {m} {' '.join(f'WHEN {i} THEN {text_of(n)}' for i, n in enumerate(L.MONTH_NAMES, 1))} END"


def season(m: str) -> str:
    return f"CASE {' '.join(f'WHEN {m} IN ({', '.join(map(str, ms))}) THEN {text_of(n)}' for ms, n in L.SEASONS)} ELSE {text_of(L.SEASON_DEFAULT)} END"


def time_of_day(h: str) -> str:
    return f"CASE {' '.join(f'WHEN {h} BETWEEN {a} AND {b} THEN {text_of(n)}' for a, b, n in L.TIME_OF_DAY)} ELSE {text_of(L.TIME_OF_DAY_DEFAULT)} END"


def route(o: str, d: str) -> str:
    return f"{o} || {text_of(L.ROUTE_ARROW)} || {d}"


def rank(order: str, within: str = "") -> str:
    return f"CAST(RANK() OVER ({f'PARTITION BY {within} ' if within else ''}ORDER BY {order}) AS BIGINT)"


def percent_text(x: str) -> str:
    return f"COALESCE(CAST(CAST({x} AS DECIMAL(38,2)) AS STRING), '') || '%'"


FACTS = "FROM airline_delays"
ROUTE = route("Origin", "Dest")
_bucket = lambda b: f"COUNT(CASE WHEN ArrDelay BETWEEN {b[0]} AND {b[1]} THEN 1 END)"
MILD, MODERATE, SEVERE = _bucket(L.MILD_BUCKET), _bucket(L.MODERATE_BUCKET), f"COUNT(CASE WHEN ArrDelay > {L.SEVERE_ABOVE} THEN 1 END)"
_cause_sums = ",\n         ".join(f"SUM({c}) AS t{k}, COUNT(CASE WHEN {c} > 0 THEN 1 END) AS f{k}, AVG(CASE WHEN {c} > 0 THEN {c} END) AS a{k}, MAX({c}) AS m{k}"
                                  for k, (c, _) in enumerate(CAUSES, 1))
FIVE = "EXPLODE(ARRAY(1, 2, 3, 4, 5)) AS k"
CAUSE_NAME = f"CASE k {' '.join(f'WHEN {k} THEN {text_of(n)}' for k, (_, n) in enumerate(CAUSES, 1))} END"


def _of_cause(kind: str) -> str:
    return f"CASE k {' '.join(f'WHEN {k} THEN {kind}{k}' for k in range(1, 6))} END"


# -- the analyses: (CTEs, final SELECT) --------------------------------------------

def worst_routes(top: int = 10, months: int = 2) -> tuple[str, str]:
    return f"""
route_month AS (SELECT {ROUTE} AS route, Month AS m, {r2('AVG(ArrDelay)')} AS v {FACTS} GROUP BY Origin, Dest, Month),
placed_routes AS (SELECT *, {rank('v DESC NULLS FIRST', 'm')} AS place FROM route_month),
repeated AS (
  SELECT route, COUNT(*) AS months_in_top10, {r2('AVG(v)')} AS overall_avg_delay FROM placed_routes WHERE place <= {top} GROUP BY route HAVING COUNT(*) >= {months})""", """
SELECT * FROM repeated ORDER BY months_in_top10 DESC, overall_avg_delay DESC NULLS LAST, route"""


def symmetry(top: int = 20) -> tuple[str, str]:
    return f"""
legs AS (SELECT Origin AS o, Dest AS d, {r2('AVG(ArrDelay)')} AS v {FACTS} WHERE Origin <> Dest GROUP BY Origin, Dest),
both_ways AS (
  SELECT LEAST(o, d) AS p, GREATEST(o, d) AS q, MAX(CASE WHEN o < d THEN v END) AS there, MAX(CASE WHEN o > d THEN v END) AS back
  FROM legs GROUP BY LEAST(o, d), GREATEST(o, d) HAVING COUNT(*) = 2),
gaps AS (SELECT *, {route('p', 'q')} AS out_leg, {route('q', 'p')} AS home_leg, {r2('ABS(there - back)')} AS gap FROM both_ways),
leg_pairs AS (
  SELECT out_leg AS route_ab, there AS delay_ab, home_leg AS route_ba, back AS delay_ba, gap AS delay_difference,
         {ladder('gap', L.SYMMETRY)} AS symmetry_label, CASE WHEN there > back THEN out_leg ELSE home_leg END AS worse_direction
  FROM gaps)""", f"""
SELECT * FROM leg_pairs ORDER BY delay_difference DESC NULLS LAST, route_ab LIMIT {top}"""


def recovery(least: int = 50, top: int = 10) -> tuple[str, str]:
    best, worst = map(text_of, L.RECOVERY_CATEGORIES)
    return f"""
regained AS (
  SELECT {ROUTE} AS route, {r2('AVG(DepDelay)')} AS avg_dep_delay, {r2('AVG(ArrDelay)')} AS avg_arr_delay, {r2('AVG(DepDelay - ArrDelay)')} AS avg_recovery,
         COUNT(*) AS total_flights
  {FACTS} GROUP BY Origin, Dest HAVING COUNT(*) >= {least}),
ends AS (
  SELECT *, {ladder('avg_recovery', L.RECOVERY)} AS recovery_label, ROW_NUMBER() OVER (ORDER BY avg_recovery DESC NULLS LAST, route NULLS FIRST) AS from_best,
         ROW_NUMBER() OVER (ORDER BY avg_recovery NULLS FIRST, route NULLS FIRST) AS from_worst
  FROM regained),
listed AS (SELECT *, EXPLODE(ARRAY({best}, {worst})) AS category FROM ends)""", f"""
SELECT route, avg_dep_delay, avg_arr_delay, avg_recovery, total_flights, recovery_label, category
FROM listed WHERE CASE WHEN category = {best} THEN from_best ELSE from_worst END <= {top}
ORDER BY category, avg_recovery DESC, route"""


def consistency(least: int = 100, top: int = 3) -> tuple[str, str]:
    return f"""
steady AS (
  SELECT UniqueCarrier AS airline, COUNT(*) AS total_flights, {r2('AVG(ArrDelay)')} AS avg_delay, {r2('STDDEV_SAMP(ArrDelay)')} AS stddev_delay
  {FACTS} GROUP BY UniqueCarrier HAVING COUNT(*) >= {least}),
placed AS (SELECT *, {rank('stddev_delay NULLS LAST')} AS consistency_rank, {rank('avg_delay NULLS LAST')} AS avg_delay_rank FROM steady)""", f"""
SELECT consistency_rank, airline, total_flights, avg_delay, stddev_delay, {ladder('stddev_delay', L.CONSISTENCY)} AS consistency_label, avg_delay_rank,
       {two(f'consistency_rank <= {top}', f'avg_delay_rank <= {top}', L.PERFORMANCE_LABELS)} AS performance_profile
FROM placed ORDER BY consistency_rank, airline"""


def monthly_changes(least: int = 30) -> str:
    before = "LAG(avg_delay) OVER (PARTITION BY airline ORDER BY m NULLS FIRST)"
    return f"""
carrier_month AS (
  SELECT UniqueCarrier AS airline, Month AS m, {r2('AVG(ArrDelay)')} AS avg_delay, COUNT(*) AS total_flights
  {FACTS} GROUP BY UniqueCarrier, Month HAVING COUNT(*) >= {least}),
against_last AS (SELECT *, {before} AS prev_month_avg FROM carrier_month),
changes AS (
  SELECT airline, m AS Month, avg_delay, total_flights, prev_month_avg, {r2('avg_delay - prev_month_avg')} AS mom_change FROM against_last),
changes_named AS (SELECT *, {ladder('mom_change', L.AIRLINE_TREND)} AS trend_label FROM changes)"""


def momentum(least: int = 30) -> tuple[str, str]:
    return monthly_changes(least), f"""
SELECT airline, COUNT(*) AS months_tracked, {r2('AVG(mom_change)')} AS avg_mom_change, MIN(mom_change) AS best_single_month_improvement,
       MAX(mom_change) AS worst_single_month_worsening, COUNT(CASE WHEN mom_change < 0 THEN 1 END) AS months_improved,
       COUNT(CASE WHEN mom_change > 0 THEN 1 END) AS months_worsened, {ladder('CAST(AVG(mom_change) AS DECIMAL(38,10))', L.OVERALL_TREND)} AS overall_trend
FROM changes WHERE mom_change IS NOT NULL GROUP BY airline ORDER BY avg_mom_change, airline"""


def severity() -> tuple[str, str]:
    return f"""
counted AS (
  SELECT UniqueCarrier AS airline, COUNT(*) AS total_flights, {SEVERE} AS severe_delay_flights, {MILD} AS mild_delay_flights,
         {MODERATE} AS moderate_delay_flights, {r2('AVG(ArrDelay)')} AS avg_delay
  {FACTS} GROUP BY UniqueCarrier),
rated AS (
  SELECT *, {share('severe_delay_flights', 'total_flights')} AS severe_delay_rate, {share('mild_delay_flights', 'total_flights')} AS mild_delay_rate,
         {share('moderate_delay_flights', 'total_flights')} AS moderate_delay_rate
  FROM counted),
rated_named AS (SELECT *, {ladder('severe_delay_rate', L.SEVERITY)} AS severity_profile FROM rated)""", f"""
SELECT {rank('severe_delay_rate DESC NULLS FIRST')} AS severity_rank, airline, total_flights, severe_delay_flights, severe_delay_rate, mild_delay_rate,
       moderate_delay_rate, avg_delay, severity_profile
FROM rated_named ORDER BY severe_delay_rate DESC, airline"""


def volume(least: int = 500, top: int | None = 30, busy: int = 20) -> tuple[str, str]:
    n = "SUM(CASE WHEN side = 1 THEN arr_n END)"
    about = f"SUM(CASE WHEN side = 1 THEN arr_var * arr_n + {over('arr * arr', 'arr_n')} END) - {over('SUM(CASE WHEN side = 1 THEN arr END) * SUM(CASE WHEN side = 1 THEN arr END)', n)}"
    return f"""
legs AS (
  SELECT Origin AS o, Dest AS d, COUNT(*) AS n, COUNT(ArrDelay) AS arr_n, SUM(ArrDelay) AS arr, VAR_POP(ArrDelay) AS arr_var {FACTS} GROUP BY Origin, Dest),
sides AS (SELECT *, EXPLODE(ARRAY(1, 2)) AS side FROM legs),
airports AS (
  SELECT CASE WHEN side = 1 THEN o ELSE d END AS airport, CAST(SUM(n) AS BIGINT) AS total_flights, SUM(CASE WHEN side = 1 THEN n ELSE 0 END) AS left_from,
         {r2(over('SUM(CASE WHEN side = 1 THEN arr END)', n))} AS avg_delay, {r2(f'SQRT(GREATEST({over(f"({about})", f"{n} - 1")}, 0.0) + CASE WHEN {n} > 1 THEN 0.0 END)')} AS stddev_delay
  FROM sides GROUP BY CASE WHEN side = 1 THEN o ELSE d END),
busy AS (SELECT * FROM airports WHERE left_from >= {least} AND airport IS NOT NULL),
busy_ranked AS (SELECT *, {rank('total_flights DESC')} AS volume_rank, {rank('avg_delay DESC NULLS FIRST')} AS delay_rank FROM busy),
busy_named AS (
  SELECT volume_rank, airport, total_flights, avg_delay, stddev_delay, delay_rank, delay_rank - volume_rank AS rank_difference,
         {two(f'volume_rank <= {busy}', f'delay_rank <= {busy}', L.AIRPORT_PROFILE_LABELS)} AS airport_profile
  FROM busy_ranked)""", f"""
SELECT * FROM busy_named ORDER BY volume_rank, airport{f' LIMIT {top}' if top else ''}"""


def profile(least: int = 500) -> tuple[str, str]:
    late_out, late_in = "avg_dep_delay > usual_dep", "avg_arr_delay > usual_arr"
    fine_out, fine_in = "avg_dep_delay <= usual_dep", "avg_arr_delay <= usual_arr"
    kinds = {"ground_ops": (late_out, fine_in), "destination": (fine_out, late_in), "systemic": (late_out, late_in)}
    named = " ".join(f"WHEN {a} AND {b} THEN {text_of(L.DELAY_PROFILE_LABELS[k])}" for k, (a, b) in kinds.items())
    place = " ".join(f"WHEN {text_of(L.DELAY_PROFILE_LABELS[k])} THEN {i}" for i, k in enumerate(L.DELAY_PROFILE_ORDER, 1))
    ground = text_of(L.DELAY_PROFILE_LABELS["ground_ops"])
    return f"""
origins AS (
  SELECT Origin AS airport, COUNT(*) AS n, SUM(DepDelay) AS dep, COUNT(DepDelay) AS dep_n, SUM(ArrDelay) AS arr, COUNT(ArrDelay) AS arr_n {FACTS} GROUP BY Origin),
against_all AS (
  SELECT airport, n AS total_flights, {r2(over('dep', 'dep_n'))} AS avg_dep_delay, {r2(over('arr', 'arr_n'))} AS avg_arr_delay,
         {r2(over('SUM(dep) OVER ()', 'SUM(dep_n) OVER ()'))} AS usual_dep, {r2(over('SUM(arr) OVER ()', 'SUM(arr_n) OVER ()'))} AS usual_arr
  FROM origins),
kinds AS (
  SELECT *, {r2('avg_dep_delay - avg_arr_delay')} AS avg_recovery, {r2('avg_dep_delay - usual_dep')} AS dep_vs_global, {r2('avg_arr_delay - usual_arr')} AS arr_vs_global,
         CASE {named} ELSE {text_of(L.DELAY_PROFILE_LABELS['normal'])} END AS delay_profile
  FROM against_all WHERE total_flights >= {least}),
profiled AS (
  SELECT *, CASE delay_profile WHEN {ground} THEN {rank('dep_vs_global DESC NULLS FIRST', 'delay_profile')} END AS ground_ops_rank,
         CASE delay_profile {place} END AS place
  FROM kinds)""", """
SELECT airport, total_flights, avg_dep_delay, avg_arr_delay, avg_recovery, dep_vs_global, arr_vs_global, delay_profile, ground_ops_rank
FROM profiled ORDER BY place, ground_ops_rank NULLS LAST, airport"""


def hour_risk() -> tuple[str, str]:
    return f"""
hours AS (
  SELECT DepHour AS dep_hour, COUNT(*) AS total_flights, {share(SEVERE, 'COUNT(*)')} AS major_delay_prob, {share(MILD, 'COUNT(*)')} AS mild_delay_prob,
         {share(MODERATE, 'COUNT(*)')} AS moderate_delay_prob, {r2('AVG(ArrDelay)')} AS avg_arr_delay, {r2('AVG(DepDelay)')} AS avg_dep_delay
  {FACTS} GROUP BY DepHour),
hours_ranked AS (
  SELECT *, {rank('major_delay_prob DESC NULLS FIRST')} AS probability_rank, {rank('avg_arr_delay DESC NULLS FIRST')} AS length_rank FROM hours)""", f"""
SELECT probability_rank, dep_hour, {time_of_day('dep_hour')} AS time_of_day, total_flights, major_delay_prob, mild_delay_prob, moderate_delay_prob,
       avg_arr_delay, avg_dep_delay, probability_rank - length_rank AS rank_divergence, {ladder('major_delay_prob', L.HOUR_RISK)} AS risk_label
FROM hours_ranked ORDER BY probability_rank, dep_hour"""


def monthly() -> tuple[str, str]:
    so_far = "AVG(avg_arr_delay) OVER (ORDER BY m NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
year AS (SELECT Month AS m, COUNT(*) AS total_flights, {r2('AVG(ArrDelay)')} AS avg_arr_delay, {share(SEVERE, 'COUNT(*)')} AS severe_rate {FACTS} GROUP BY Month),
running AS (
  SELECT *, {r2('AVG(avg_arr_delay) OVER (ORDER BY m NULLS FIRST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS rolling_3m_avg,
         {r2('avg_arr_delay - LAG(avg_arr_delay) OVER (ORDER BY m NULLS FIRST)')} AS mom_change, {r2(so_far)} AS cumulative_avg,
         {r2(f'avg_arr_delay - {so_far}')} AS vs_cumulative_avg
  FROM year),
months AS (
  SELECT m AS Month, {month_name('m')} AS month_name, {season('m')} AS season, total_flights, avg_arr_delay, rolling_3m_avg, mom_change,
         {ladder('mom_change', L.MONTH_TREND)} AS mom_trend, cumulative_avg, vs_cumulative_avg, {ladder('vs_cumulative_avg', L.TREND_POSITION)} AS trend_position,
         severe_rate
  FROM running)""", """
SELECT * FROM months ORDER BY Month"""


def causes() -> tuple[str, str]:
    return f"""
summed AS (
  SELECT COUNT(*) AS n,
         {_cause_sums}
  {FACTS}),
five AS (SELECT *, {FIVE} FROM summed),
by_cause AS (
  SELECT {CAUSE_NAME} AS delay_cause, n, {_of_cause('t')} AS total_minutes, {_of_cause('f')} AS flights_affected, {r2(_of_cause('a'))} AS avg_when_present,
         {_of_cause('m')} AS max_single_flight
  FROM five),
weighed AS (
  SELECT *, {share('total_minutes', 'SUM(total_minutes) OVER ()')} AS pct_of_total_minutes, {share('flights_affected', 'n')} AS pct_flights_affected FROM by_cause),
weighed_ranked AS (
  SELECT *, {rank('total_minutes DESC NULLS FIRST')} AS impact_rank, {rank('flights_affected DESC')} AS breadth_rank,
         {rank('avg_when_present DESC NULLS FIRST')} AS severity_rank
  FROM weighed),
cause_report AS (
  SELECT impact_rank, delay_cause, total_minutes, pct_of_total_minutes, flights_affected, pct_flights_affected, avg_when_present, max_single_flight,
         breadth_rank, severity_rank, {ladder('pct_of_total_minutes', L.IMPACT)} AS impact_label,
         {two('breadth_rank <= 2', 'severity_rank <= 2', L.SPREAD_LABELS)} AS spread_label
  FROM weighed_ranked)""", """
SELECT * FROM cause_report ORDER BY impact_rank, delay_cause"""


def dominant() -> tuple[str, str]:
    lead = "OVER (PARTITION BY airline ORDER BY total_minutes DESC NULLS FIRST)"
    follows, deviates = map(text_of, L.NETWORK_LABELS)
    return f"""
carrier_sums AS (
  SELECT UniqueCarrier AS airline,
         {_cause_sums}
  {FACTS} GROUP BY UniqueCarrier),
five AS (SELECT *, {FIVE} FROM carrier_sums),
carrier_cause AS (
  SELECT airline, {CAUSE_NAME} AS cause, {_of_cause('t')} AS total_minutes, {_of_cause('f')} AS hits, {r2(_of_cause('a'))} AS each_time FROM five),
carrier_share AS (
  SELECT *, {share('total_minutes', 'SUM(total_minutes) OVER (PARTITION BY airline)')} AS pct, {rank('total_minutes DESC NULLS FIRST', 'airline')} AS place
  FROM carrier_cause),
beside_first AS (
  SELECT *, FIRST_VALUE(cause) {lead} AS first_cause, FIRST_VALUE(pct) {lead} AS first_pct, FIRST_VALUE(hits) {lead} AS first_hits,
         FIRST_VALUE(each_time) {lead} AS first_each
  FROM carrier_share)""", f"""
SELECT airline, first_cause AS dominant_cause, {percent_text('first_pct')} AS dominant_pct, cause AS second_cause, {percent_text('pct')} AS second_pct,
       first_hits AS dominant_flights, first_each AS dominant_avg_mins,
       CASE WHEN first_cause = {text_of(L.NETWORK_CAUSE)} THEN {follows} ELSE {deviates} END AS vs_network, {ladder('first_pct', L.CONCENTRATION)} AS concentration_label
FROM beside_first WHERE place = 2 ORDER BY vs_network, first_pct DESC, airline"""


#: (CTEs, final SELECT) of each analysis.
STATEMENTS: dict[str, tuple[str, str]] = {
    "scope_total_flights": ("", f"SELECT COUNT(*) AS total_flights {FACTS}"),
    "scope_total_airports": ("", f"SELECT COUNT(DISTINCT airport) AS total_airports FROM (SELECT EXPLODE(ARRAY(Origin, Dest)) AS airport {FACTS}) ends"),
    "scope_total_airlines": ("", f"SELECT COUNT(DISTINCT UniqueCarrier) AS total_airlines {FACTS}"),
    "scope_arrdelay_range": ("", f"SELECT MIN(ArrDelay) AS min_arrdelay, MAX(ArrDelay) AS max_arrdelay {FACTS}"),
    "scope_depdelay_range": ("", f"SELECT MIN(DepDelay) AS min_depdelay, MAX(DepDelay) AS max_depdelay {FACTS}"),
    "scope_avg_delays": ("", f"SELECT {r2('AVG(ArrDelay)')} AS avg_arrdelay, {r2('AVG(DepDelay)')} AS avg_depdelay {FACTS}"),
    "q01_repeat_worst_routes": worst_routes(),
    "q02_route_symmetry": symmetry(),
    "q03_delay_recovery": recovery(),
    "q04_airline_consistency": consistency(),
    "q05_airline_momentum": momentum(),
    "q06_severity_profile": severity(),
    "q07_volume_vs_delay": volume(),
    "q08_dep_arr_profile": profile(),
    "q09_hour_risk": hour_risk(),
    "q10_monthly_rolling": monthly(),
    "q11_cause_totals": causes(),
    "q12_dominant_cause": dominant(),
}

#: The forms of SQL that users write, each with a statement of its own (their
#: oracles are other derivations of the same rows, in ``tarmac.plans.oracle``).
FORMS: dict[str, tuple[str, str]] = {
    "cte_chain": (f"""
carrier_month AS (SELECT UniqueCarrier AS c, Month AS m, {r2('AVG(ArrDelay)')} AS v {FACTS} GROUP BY UniqueCarrier, Month),
carrier_range AS (SELECT c AS airline, COUNT(*) AS months, {r2('MAX(v) - MIN(v)')} AS monthly_range FROM carrier_month GROUP BY c),
carrier_place AS (SELECT *, {rank('monthly_range DESC NULLS FIRST')} AS range_rank FROM carrier_range)""", "SELECT * FROM carrier_place"),
    "subquery_from": ("", f"""
SELECT Month, MAX(flights) AS flights_in_busiest_hour, COUNT(*) AS hours_flown
FROM (SELECT Month, DepHour, COUNT(*) AS flights {FACTS} GROUP BY Month, DepHour) GROUP BY Month"""),
    "subquery_scalar": (f"""
by_carrier AS (SELECT UniqueCarrier AS airline, SUM(ArrDelay) AS minutes, COUNT(ArrDelay) AS n {FACTS} GROUP BY UniqueCarrier)""", f"""
SELECT airline, {r2(over('minutes', 'n'))} AS avg_delay FROM by_carrier
WHERE {over('minutes', 'n')} > (SELECT {over('SUM(minutes)', 'SUM(n)')} FROM by_carrier)"""),
    "udf_apply": ("", f"SELECT Month, tarmac_month_name(Month) AS month_name, tarmac_season(Month) AS season, COUNT(*) AS total_flights {FACTS} GROUP BY Month"),
}

#: Functions of the SQL surface, in SQL themselves: name, parameters, result, body.
FUNCTIONS: list[tuple[str, str, str, str]] = [
    ("tarmac_month_name", "m BIGINT", "STRING", month_name("m")),
    ("tarmac_season", "m BIGINT", "STRING", season("m")),
    ("tarmac_time_of_day", "h BIGINT", "STRING", time_of_day("h")),
    ("tarmac_route", "origin STRING, dest STRING", "STRING", route("origin", "dest")),
    ("tarmac_r2", "x DOUBLE", "DOUBLE", r2("x")),
    ("tarmac_hhmm_hour", "hhmm DOUBLE", "BIGINT", "CAST(FLOOR(hhmm / 100) AS BIGINT)"),
]


def text(statement: tuple[str, str], before: str = "") -> str:
    """A whole statement; ``before`` are CTEs that define ``airline_delays``, if no view does."""
    ctes, select = statement
    parts = [p.strip().strip(",") for p in (before, ctes) if p.strip()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + select.strip()
