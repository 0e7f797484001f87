"""Property tests: random small flight frames, Spark analyses against a
brute-force pure-Python computation with exact rational arithmetic and
half-up rounding."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import FIELDS, FLIGHT_SCHEMA
from tarmac.plans import analyses as Q

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def r2(x) -> float:
    """Exact half-up rounding at 2 dp of a Fraction (or a float read as its decimal text)."""
    d = Decimal(x.numerator) / Decimal(x.denominator) if isinstance(x, Fraction) else Decimal(str(x))
    return float(d.quantize(Decimal("0.01"), ROUND_HALF_UP))


@st.composite
def flights(draw):
    n = draw(st.integers(min_value=1, max_value=60))
    rows = []
    for _ in range(n):
        arr = draw(st.integers(min_value=15, max_value=130))
        parts = draw(st.lists(st.integers(min_value=0, max_value=arr), min_size=4, max_size=4))
        parts = sorted(parts)
        car, wx, nas, sec = parts[0], parts[1] - parts[0], parts[2] - parts[1], parts[3] - parts[2]
        late = arr - parts[3]
        rows.append({
            "Month": draw(st.integers(min_value=1, max_value=12)),
            "DepHour": draw(st.integers(min_value=0, max_value=23)),
            "UniqueCarrier": draw(st.sampled_from(["AA", "BB", "CC"])),
            "Origin": draw(st.sampled_from(["X", "Y", "Z"])),
            "Dest": draw(st.sampled_from(["X", "Y", "Z"])),
            "DepDelay": float(draw(st.integers(min_value=-5, max_value=130))),
            "ArrDelay": float(arr),
            "CarrierDelay": float(car), "WeatherDelay": float(wx), "NASDelay": float(nas),
            "SecurityDelay": float(sec), "LateAircraftDelay": float(late),
        })
    return rows


def to_df(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], FLIGHT_SCHEMA)


def mean(vals):
    return Fraction(sum(int(v) for v in vals), len(vals))


@SETTINGS
@given(rows=flights())
def test_severity_profile(spark, rows):
    got = {r["airline"]: r for r in Q.q06_severity_profile(to_df(spark, rows)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r["UniqueCarrier"]].append(r["ArrDelay"])
    rates = {}
    for c, v in by.items():
        n = len(v)
        rates[c] = r2(Fraction(100 * sum(1 for x in v if x > 60), n))
        g = got[c]
        assert g["total_flights"] == n
        assert g["severe_delay_rate"] == rates[c]
        assert g["mild_delay_rate"] == r2(Fraction(100 * sum(1 for x in v if 15 <= x <= 30), n))
        assert g["moderate_delay_rate"] == r2(Fraction(100 * sum(1 for x in v if 31 <= x <= 60), n))
        assert g["avg_delay"] == r2(mean(v))
    for c in by:  # RANK: 1 + number of strictly larger rates
        assert got[c]["severity_rank"] == 1 + sum(1 for d in rates.values() if d > rates[c])


@SETTINGS
@given(rows=flights())
def test_monthly_rolling(spark, rows):
    got = {r["Month"]: r for r in Q.q10_monthly_rolling(to_df(spark, rows)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r["Month"]].append(r["ArrDelay"])
    months = sorted(by)
    avgs = [Fraction(Decimal(str(r2(mean(by[m]))))) for m in months]
    for i, m in enumerate(months):
        g = got[m]
        assert g["avg_arr_delay"] == float(avgs[i])
        window = avgs[max(0, i - 2): i + 1]
        assert g["rolling_3m_avg"] == r2(sum(window) / len(window))
        cum = sum(avgs[: i + 1]) / (i + 1)
        assert g["cumulative_avg"] == r2(cum)
        assert g["vs_cumulative_avg"] == r2(avgs[i] - cum)
        assert g["mom_change"] == (None if i == 0 else r2(avgs[i] - avgs[i - 1]))


@SETTINGS
@given(rows=flights())
def test_dominant_cause(spark, rows):
    got = defaultdict(list)
    for r in Q.q12_dominant_cause(to_df(spark, rows)).collect():
        got[r["airline"]].append((r["dominant_cause"], r["second_cause"], r["dominant_pct"], r["second_pct"]))
    causes = [("CarrierDelay", "Carrier Delay"), ("WeatherDelay", "Weather Delay"), ("NASDelay", "NAS Delay"),
              ("SecurityDelay", "Security Delay"), ("LateAircraftDelay", "Late Aircraft Delay")]
    want = defaultdict(list)
    for c in {r["UniqueCarrier"] for r in rows}:
        tot = {label: sum(int(r[col]) for r in rows if r["UniqueCarrier"] == c) for col, label in causes}
        allm = sum(tot.values())
        rank = {k: 1 + sum(1 for v in tot.values() if v > tot[k]) for k in tot}
        pct = {k: (None if allm == 0 else r2(Fraction(100 * tot[k], allm))) for k in tot}
        firsts = [k for k in tot if rank[k] == 1]
        seconds = [k for k in tot if rank[k] == 2]
        for a in firsts:
            for b in seconds:
                want[c].append((a, b, f"{pct[a]:.2f}%", f"{pct[b]:.2f}%"))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


@SETTINGS
@given(rows=flights())
def test_route_symmetry(spark, rows):
    got = {r["route_ab"]: r for r in Q.q02_route_symmetry(to_df(spark, rows), top=None).collect()}
    by = defaultdict(list)
    for r in rows:
        by[(r["Origin"], r["Dest"])].append(r["ArrDelay"])
    want = {}
    for (o, d), v in by.items():
        if o < d and (d, o) in by:
            ab, ba = r2(mean(v)), r2(mean(by[(d, o)]))
            diff = r2(Fraction(Decimal(str(ab))) - Fraction(Decimal(str(ba)))).__abs__()
            want[f"{o} → {d}"] = (ab, ba, diff, f"{o} → {d}" if ab > ba else f"{d} → {o}")
    assert {k: (g["delay_ab"], g["delay_ba"], g["delay_difference"], g["worse_direction"]) for k, g in got.items()} == want


@SETTINGS
@given(rows=flights())
def test_volume_vs_delay(spark, rows):
    got = {r["airport"]: r for r in Q.q07_volume_vs_delay(to_df(spark, rows), min_departures=1, top=None).collect()}
    vol, dep = defaultdict(int), defaultdict(list)
    for r in rows:
        vol[r["Origin"]] += 1
        vol[r["Dest"]] += 1
        dep[r["Origin"]].append(r["ArrDelay"])
    assert set(got) == set(dep)
    for a, v in dep.items():
        assert got[a]["total_flights"] == vol[a]
        assert got[a]["avg_delay"] == r2(mean(v))
        assert got[a]["volume_rank"] == 1 + sum(1 for b in dep if vol[b] > vol[a])


@SETTINGS
@given(values=st.lists(st.integers(min_value=-50, max_value=300), min_size=1, max_size=80),
       deps=st.lists(st.integers(min_value=-20, max_value=200), min_size=80, max_size=80))
def test_iqr_bounds_match_numpy(spark, values, deps):
    import numpy as np

    from tarmac.operators.clean import iqr_bounds

    rows = [(float(v), float(deps[i])) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ArrDelay double, DepDelay double")
    got = iqr_bounds(df, ["ArrDelay", "DepDelay"]).first()
    for j, m in enumerate(("ArrDelay", "DepDelay")):
        col = np.array([r[j] for r in rows])
        q1, q3 = np.percentile(col, 25), np.percentile(col, 75)  # linear interpolation, as pandas
        assert abs(got[f"{m}_q1"] - q1) < 1e-9 and abs(got[f"{m}_q3"] - q3) < 1e-9
        assert abs(got[f"{m}_lower"] - (q1 - 1.5 * (q3 - q1))) < 1e-9
        assert abs(got[f"{m}_upper"] - (q3 + 1.5 * (q3 - q1))) < 1e-9
