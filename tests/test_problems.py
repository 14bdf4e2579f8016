"""Faulty readings, filling and the hourly grid against brute force, and their edge cases."""

import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brumar.common import join_small
from brumar.operators.impute import fill_readings
from brumar.operators.regrid import hourly_grid
from brumar.operators.spikes import HOUR_US, faulty_readings, robust_pca, spike_mask, usual_spread

SCHEMA = "id_rand bigint, Denumire string, `Data masurarii` timestamp_ntz, Rff1 double, Nop string, Fenomen string, data_incarcare timestamp_ntz, e string, t int, v string"
T0 = datetime(2024, 1, 1)


def frame(spark, rows):
    """rows: (station, time, wind[, nop, fenomen, loaded])"""
    full = []
    for i, r in enumerate(rows):
        s, t, w, *rest = r
        nop, fen, load = [*rest, *["3", "Ceata", t + timedelta(minutes=2) if t else T0][len(rest):]]
        full.append((i, s, t, w, nop, fen, load, "x", 1, None))
    return spark.createDataFrame(full, SCHEMA)


def faults(df):
    return {(r["id_rand"], r["tip"]) for r in faulty_readings(df, "Denumire", "Data masurarii", "Rff1", "id_rand").collect()}


def series(n, seed=0, level=3.0):
    r = np.random.default_rng(seed)
    v = level + np.cumsum(r.normal(0, 0.15, n))
    v = np.round(np.clip(level + 0.9 * (v - level) - np.linspace(0, 0.5, n), 0.6, 6), 1)
    for i in range(1, n):
        if v[i] == v[i - 1]:
            v[i] = round(v[i] + 0.1, 1)
    return v


def test_faults_of_each_kind(spark):
    v = series(24 * 70)
    v[100] = 14.0
    v[200:203] = [13.0, 13.4, 12.9]
    v[300:304] = [12.0, 12.5, 13.1, 12.2]  # four: no spike
    v[400:408] = 2.2  # stuck
    v[500:507] = 2.7  # seven: not stuck
    v[600:620] = 0.0  # a calm
    block = 32 * 24
    v[block - 4 : block + 5] = 1.9  # a run over the border of two blocks
    v[700], v[701], v[702] = -3.0, 99.0, -999.0
    rows = [("A", T0 + timedelta(hours=i), float(x)) for i, x in enumerate(v)]
    got = faults(frame(spark, rows))
    kinds = {k: sorted(i for i, t in got if t == k) for k in ("impossible", "stuck", "spike")}
    assert kinds["impossible"] == [700, 701]
    assert kinds["stuck"] == [*range(400, 408), *range(block - 4, block + 5)] or kinds["stuck"] == sorted([*range(400, 408), *range(block - 4, block + 5)])
    assert kinds["spike"] == [100, 200, 201, 202]


def test_runs_pass_over_gaps_and_count_repeats_once(spark):
    v = list(series(60, 1))
    rows = [("A", T0 + timedelta(hours=i), float(x)) for i, x in enumerate(v)]
    at = [10, 11, 12, 13, 14, 15, 16, 17]
    for i in at:
        rows[i] = ("A", rows[i][1], 2.5)
    rows[13] = ("A", rows[13][1], None)  # passed over, so one more is needed
    rows[18] = ("A", rows[18][1], 2.5)
    rows.append(("A", rows[10][1], 2.5))  # a repeated row counts once and is reported too
    rows.append(("A", None, 2.5))
    rows.append((None, T0, 2.5))
    stuck = {i for i, k in faults(frame(spark, rows)) if k == "stuck"}
    assert stuck == {10, 11, 12, 14, 15, 16, 17, 18, 60}
    rows[18] = ("A", rows[18][1], 9.9)
    assert not {i for i, k in faults(frame(spark, rows)) if k == "stuck"}


def test_faults_of_nothing_and_of_nulls(spark):
    assert faults(frame(spark, [])) == set()
    assert faults(frame(spark, [("A", None, None), (None, None, None), ("A", T0, float("nan"))])) == set()
    assert faults(frame(spark, [("A", T0, 80.0)])) == {(0, "impossible")}


def test_robust_pca_splits():
    r = np.random.default_rng(0)
    low = np.outer(r.normal(size=40), r.normal(size=24)) + np.outer(r.normal(size=40), r.normal(size=24))
    sparse = np.zeros_like(low)
    sparse[3, 5], sparse[20, 11] = 15, -12
    a, s, noise = robust_pca(low + sparse + r.normal(0, 0.1, low.shape), np.ones_like(low, bool))
    assert abs(s[3, 5] - 15) < 0.5 and abs(s[20, 11] + 12) < 0.5 and 0.05 <= noise < 0.12
    assert np.linalg.norm(a - low) < 0.1 * np.linalg.norm(low)
    a, s, noise = robust_pca(np.zeros((3, 24)), np.zeros((3, 24), bool))
    assert not a.any() and not s.any()


def test_the_decomposition_decides():
    """A sharp peak at the same hour of every day is normal to principal components and to nothing else; a gale is neither."""
    r = np.random.default_rng(1)
    t = np.arange(24 * 32) * HOUR_US
    v = 3 + r.normal(0, 0.2, len(t))
    v[t // HOUR_US % 24 == 15] += 6
    planted = [100, 400, 401]
    v[planted] += 9
    v[600:612] += 8 * np.sin(np.linspace(0, np.pi, 12))  # a gale that builds up and dies down
    off = lambda d, known: (np.zeros_like(d), d, 0.05)
    assert list(np.flatnonzero(spike_mask(t, v, 0.3))) == planted
    without = set(np.flatnonzero(spike_mask(t, v, 0.3, off)))
    assert len(without - set(planted)) > 20


def test_spread_is_exact_and_the_same_however_rows_lie(spark):
    v = np.round(np.random.default_rng(0).gamma(2, 2, 999), 1)
    df = spark.createDataFrame([("A", float(x)) for x in v] + [("B", 1.0)], "e string, v double")
    want = np.subtract(*np.quantile(v, [0.75, 0.25])) / 1.349
    for n in (1, 7):
        got = {r["e"]: r["sigma"] for r in usual_spread(df.repartition(n), "e", "v").collect()}
        assert got["A"] == pytest.approx(want) and got["B"] == 0


@pytest.mark.parametrize("zone", ["UTC", "Europe/Bucharest"])
def test_no_session_zone_moves_a_reading(spark, zone):
    rows = [("A", datetime(2024, 3, 31) + timedelta(hours=i), 2.5 if 2 < i < 12 else float(i % 7)) for i in range(30) if i != 20]
    rows.append(("A", None, 2.5, "3", "Ceata", datetime(2024, 3, 31, 3, 10)))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = frame(spark, rows)
        hours = {r["ora"]: r["occupied"] for r in hourly_grid(df, "Denumire", "Data masurarii", "Rff1").collect()}
        assert hours == {f"{rows[0][1] + timedelta(hours=i):%Y-%m-%d %H:%M}": i != 20 for i in range(30)}
        assert faults(df) == {(i, "stuck") for i in range(3, 12)}
        got = {x["id_rand"]: x["Data masurarii"] for x in fill(df).collect()}
        assert all(got[i] == r[1] for i, r in enumerate(rows) if r[1]) and abs(got[len(rows) - 1] - rows[-1][5]) < timedelta(minutes=5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_grid_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for s in "AB":
        t = T0 + timedelta(minutes=int(r.integers(0, 60)))
        for _ in range(300):
            t += timedelta(minutes=int(r.choice([20, 30, 55, 60, 65, 200, 500])), seconds=int(r.integers(0, 60)))
            rows.append((s, t, None if r.random() < 0.1 else float(np.round(r.random() * 9, 1))))
    rows += [rows[5], rows[7], ("A", None, 1.0), (None, T0, 1.0)]
    got = hourly_grid(frame(spark, rows), "Denumire", "Data masurarii", "Rff1").toPandas()
    pdf = pd.DataFrame([x for x in rows if x[0] and x[1]], columns=["s", "t", "v"])
    for s, g in pdf.groupby("s"):
        mine = got[got.denumire == s].set_index("ora")
        hour = (g.t + pd.Timedelta("30min")).dt.floor("h")
        want = pd.date_range(hour.min(), hour.max(), freq="h").strftime("%Y-%m-%d %H:%M")
        assert sorted(mine.index) == sorted(want)
        assert set(mine.index[mine.occupied]) == set(hour.dt.strftime("%Y-%m-%d %H:%M"))
        u = g.dropna().groupby("t").v.mean().sort_index()
        end = [min(a + pd.Timedelta("3h"), b) for a, b in zip(u.index, [*u.index[1:], u.index[-1] + pd.Timedelta("3h")])]
        for h in want[:150]:
            a = pd.Timestamp(h) - pd.Timedelta("30min")
            b = a + pd.Timedelta("1h")
            w = np.array([max(0.0, (min(e, b) - max(t, a)).total_seconds()) for t, e in zip(u.index, end)])
            assert mine.loc[h, "coverage"] == pytest.approx(w.sum() / 3600)
            if w.sum():
                assert mine.loc[h, "mean_value"] == pytest.approx((w * u.to_numpy()).sum() / w.sum())
    assert hourly_grid(frame(spark, []), "Denumire", "Data masurarii", "Rff1").count() == 0
    half = hourly_grid(frame(spark, [("A", T0 + timedelta(minutes=30), 1.0)]), "Denumire", "Data masurarii", "Rff1").collect()
    assert [r["ora"] for r in half] == ["2024-01-01 01:00"]


def fill(df, **k):
    return fill_readings(df, "Denumire", "Data masurarii", "Rff1", "Nop", "Fenomen", "data_incarcare", "id_rand", **k)


def test_filling_marks_and_estimates(spark):
    r = np.random.default_rng(0)
    rows, truth = [], {}
    for i in range(3000):
        windy = (i // 60) % 2
        t = T0 + timedelta(hours=i // 3)
        s = "ABC"[i % 3]
        w = {"A": 3, "B": 6, "C": 12}[s] + (2.0 if windy else -0.5) + r.normal(0, 0.2)
        nop, fen = ("8", "Ploaie") if windy else ("1", "Nu avem fenomen")
        rows.append([s, t, round(w, 1), nop, fen, t + timedelta(minutes=5)])
    for i in r.choice(3000, 120, replace=False):
        c = int(r.integers(0, 4))
        truth[int(i), c] = rows[i][[2, 3, 4, 1][c]]
        rows[i][[2, 3, 4, 1][c]] = [[-999.0, None, float("nan")][i % 3], [None, " ", "/", "9"][i % 4], ["N/A", "//", None][i % 3], None][c]
    got = {x["id_rand"]: x for x in fill(frame(spark, rows)).collect()}
    assert len(got) == 3000
    names = ["Rff1", "Nop", "Fenomen", "Data masurarii"]
    assert {(i, names[c]) for i, c in truth} == {(i, c) for i, x in got.items() for c in x["lipsa"]} == {(i, c) for i, x in got.items() for c in x["umplut"]}
    wind = [abs(got[i]["Rff1"] - v) for (i, c), v in truth.items() if c == 0]
    assert np.mean(wind) < 0.8
    for c in (1, 2):
        assert np.mean([got[i][names[c]] == v for (i, k), v in truth.items() if k == c]) > 0.9
    assert all(abs((got[i]["Data masurarii"] - v).total_seconds()) < 120 for (i, c), v in truth.items() if c == 3)
    for i, x in got.items():
        assert (i, 0) in truth or x["Rff1"] == rows[i][2]
        assert (i, 3) in truth or x["Data masurarii"] == rows[i][1]


def test_filling_edge_cases(spark):
    assert fill(frame(spark, [])).count() == 0
    rows = [(None, None, None, None, None, None), ("A", T0, 4.0, " 6", "Ceata", T0), ("A", T0, 4.0, "3.0", "Ceata", T0), ("A", None, 6310.0, "10", "x", T0)]
    got = {x["id_rand"]: x for x in fill(frame(spark, rows)).collect()}
    assert set(got[0]["lipsa"]) == {"Rff1", "Nop", "Fenomen", "Data masurarii"}
    assert set(got[0]["umplut"]) == {"Rff1", "Nop", "Fenomen"} and got[0]["Data masurarii"] is None
    assert got[1]["lipsa"] == [] and got[1]["Nop"] == "6"
    assert got[3]["lipsa"] == ["Data masurarii"] and got[3]["Rff1"] == 6310.0 and got[3]["Data masurarii"] is not None


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_filled_values_of_the_table_against_hidden_ones(spark):
    """One known cell in twenty is hidden; what is filled in must be nearer than the station's mean, and right more often than the most frequent value."""
    t = spark.read.parquet(f"{TABLES}/sirdate_1748514797752_bucuresti.parquet")
    hide = lambda c, k: F.when(F.pmod(F.xxhash64("id_rand", F.lit(k)), F.lit(20)) != 0, F.col(c))
    hidden = t.withColumns({"Rff1": hide("Rff1", 1), "Nop": hide("Nop", 2), "Fenomen": hide("Fenomen", 3)})
    got = fill(hidden).select("id_rand", "Denumire", "lipsa", "Rff1", "Nop", "Fenomen").toPandas().set_index("id_rand")
    was = t.select("id_rand", "Rff1", F.trim("Nop").alias("Nop"), F.trim("Fenomen").alias("Fenomen")).toPandas().set_index("id_rand").loc[got.index]
    assert len(got) == t.count()
    lost = lambda c: got.lipsa.map(lambda x: c in x)
    w = lost("Rff1") & was.Rff1.between(0, 75)
    mean = was.Rff1[~lost("Rff1") & was.Rff1.between(0, 75)].groupby(got.Denumire).mean()
    assert w.sum() > 500 and (got.Rff1[w] - was.Rff1[w]).abs().mean() < 0.8 * (got.Denumire[w].map(mean) - was.Rff1[w]).abs().mean()
    n = lost("Nop") & was.Nop.isin(list("012345678"))
    assert (got.Nop[n] == was.Nop[n]).mean() > 2 * (was.Nop[n] == was.Nop[~lost("Nop")].mode()[0]).mean()
    f = lost("Fenomen") & was.Fenomen.isin(set(got.Fenomen[~lost("Fenomen")]))
    assert (got.Fenomen[f] == was.Fenomen[f]).mean() >= 0.99 * (was.Fenomen[f] == was.Fenomen[~lost("Fenomen")].mode()[0]).mean()


def test_a_large_side_is_not_sent_out(spark):
    big, small = spark.range(100).withColumn("k", F.col("id") % 10), spark.range(8).withColumnRenamed("id", "k")
    for most in (3, 100):
        assert join_small(big, small, ["k"], "left", most).count() == 100 and join_small(big, small, ["k"], most=most).count() == 80
