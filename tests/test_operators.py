"""Worked examples and properties of the operators."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brumar.functions import text as X
from brumar.operators import assembly, checks, experiments, forecast, quality, rendering, rollup, similarity, zones


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


def filled(spark, values, days=None, n=1):
    days = days or range(len(values))
    df = spark.createDataFrame([("a", date(2024, 1, 1) + timedelta(days=d), v) for d, v in zip(days, values)], "e string, d date, v double")
    return [r["v"] for r in quality.neighbour_fill(df, "e", "d", ["v"], n).orderBy("d").collect()]


def test_neighbour_fill(spark):
    assert filled(spark, [1.0, None, 3.0, None, None, None, None, 9.0]) == [1, 2, 3, 3, None, None, 9, 9]
    assert filled(spark, [1.0, None, 5.0], [0, 1, 8]) == [1, 3, 5]  # rows count, not days
    assert filled(spark, [None, None]) == [None, None]


def test_fold_edges(spark):
    rows = forecast.fold_edges(spark, 348, 4).orderBy("fold").collect()
    assert [r["test_from"] for r in rows] + [rows[-1]["test_to"]] == [69, 139, 208, 278, 348]


@pytest.mark.parametrize("low,high,want", [(0, 2, 0), (10.5, 12.5, 10), (1, 3, 2), (10, 13, 10), (-4.1, -2.1, -4)])
def test_grid_snap(spark, low, high, want):
    r = one(spark, X.snapped(F.col("a"), F.col("b")), a=float(low), b=float(high))
    assert r["low"] == want and r["high"] == want + 2
    again = one(spark, X.snapped(F.col("a"), F.col("b")), a=r["low"], b=r["high"])
    assert again["low"] == r["low"] and not again["moved"]


def test_classes(spark):
    assert [one(spark, forecast.class_of(F.col("v")), v=v) for v in (-20.1, -20.0, 39.99, 40.0)] == [0, 1, 30, 31]


def test_scores_and_names(spark):
    assert one(spark, X.last_scores(F.col("t")), t="a [1, 2, 3, 4, 5] b [0.9, 0.8, 1.0, 0.7] c [x]") == pytest.approx(0.85)
    assert one(spark, X.last_scores(F.col("t")), t="none") is None
    assert one(spark, X.judge_score(F.col("t")), t="from [12, 14] to [73]") == 73
    assert one(spark, X.judge_score(F.col("t")), t="I say 64 of 250") == 64
    assert tuple(one(spark, X.run_name(F.col("t")), t="m_x_2024-07-10_4_past_days_seed43.json")) == ("m_x", "2024-07-10", 4, 43)
    assert tuple(one(spark, X.run_name(F.col("t")), t="m_2024-07-10_4_past_days.json")) == ("m", "2024-07-10", 4, 1)
    assert tuple(one(spark, X.run_name(F.col("t")), t="other")) == (None, None, None, None)


def test_structured_sentences(spark):
    t = "<think>x</think>PRIMA PROPOZIȚIE: a b\nprima propozitie: a b c\nA DOUA PROPOZIȚIE: -\nPROPOZIȚIA FINALĂ:  z "
    assert one(spark, X.structured(F.col("t")), t=t) == "a b c z"
    assert one(spark, X.structured(F.col("t")), t="plain  text") == "plain text"


def test_report_sections(spark, tmp_path):
    from brumar.plans.texts import report_sections

    texts = ["Răspuns: <think>PRIMA PROPOZIȚIE: cel mai lung dintre toate</think>\nPRIMA PROPOZIȚIE: a\nA TREIA PROPOZIȚIE: c c\nA TREIA PROPOZITIE: c\nA PATRA PROPOZIȚIE: -",
             "BUCUREȘTI\nPRIMA PROPOZIȚIE: a\nBUCUREȘTI\nprima propozitie: a b\nPROPOZIȚIA FINALĂ: z", "fără etichete"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in report_sections(spark, str(tmp_path)).collect())
    assert got == [(0, "a", None, "c c", None, None), (1, "a b", None, None, None, "z")]


def by_lines(text):
    import re

    loose = lambda x: x.replace("Ț", "[ȚŢT]?").replace("Ă", "[ĂA]").replace("IE", "I[AE]")
    got, now = [[] for _ in X.SECTION_LABELS], None
    for line in filter(None, map(str.strip, text.splitlines())):
        hit = next(((i, m) for i, x in enumerate(X.SECTION_LABELS) if (m := re.match(rf"{loose(x)}[^:]*:\s*(.*)$", line, re.I))), None)
        if hit:
            now = hit[0]
        if now is not None:
            got[now].append(hit[1][1] if hit else line)
    return tuple(re.sub(r"\s+", " ", " ".join(x)).strip() for x in got)


def test_line_sections(spark):
    rows = [("BUCUREȘTI\nPRIMA PROPOZIȚIE: a b\n  c: d\n\ne\r\nA TREIA PROPOZIȚIE (OPȚIONALĂ): -\r  prima propozitie: f vezi A DOUA PROPOZIȚIE: g\nPROPOZIȚIA FINALĂ:\nh\u2028i",),
            ("A DOUA PROPOZIȚIE fără două puncte\nnimic",), ("\n\nA PATRA PROPOZIȚIE: x",), ("PRIMA PROPOZIȚIE:" + " y\n" * 20000,), ("",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(*X.line_sections(F.col("t"))).collect()]
    assert got[0] == ("a b c: d e f vezi A DOUA PROPOZIȚIE: g", "", "-", "", "h i")
    assert got == [by_lines(t) for (t,) in rows]


def test_worded_intervals(spark):
    got = one(spark, X.worded_intervals(F.col("t")), t="între 4 și 6 °C, peste 6 °C, sub 0 °C, sub 5 minute, ÎNTRE 1 SI 2")
    assert sorted((r["low"], r["high"]) for r in got) == [(-2, 0), (1, 2), (4, 6), (6, 8)]


def test_intervals_know_their_place(spark):
    t = "în zona montană [2, 4] °C, între 10 și 12 grade Celsius, sub 3 minute"
    got = one(spark, X.intervals(F.col("t")), t=t)
    assert [(r["low"], r["high"]) for r in got] == [(2, 4), (10, 12)]
    at = t.index("[2, 4] °C")
    assert got[0]["middle"] == at + len("[2, 4] °C") / 2
    assert one(spark, X.intervals(F.col("t")), t=None) == [] == one(spark, X.intervals(F.col("t")), t="")


def test_bracket_rewrite(spark):
    f = lambda t: one(spark, zones.rewritten(F.col("t")), t=t)
    assert f("valori sub [0, 2] °C și peste [4, 6] °C") == "valori sub 0 °C și peste 6 °C"
    assert f("sub [2, 4] °C, [0, 2] °C") == "intre 2 si 4 °C, intre 0 si 2 °C"
    assert f("până la [4, 6] °C") == "pana la 6 °C" and f("de la [1, 3]C, între [10, 12]") == "de la 2 °C, intre 10 si 12 °C"
    assert f("[−1, 2]") == "[−1, 2]" and f("[-4.1, -2.1]") == "intre -4 si -2 °C"
    assert f("nimic") == "nimic" and f(None) is None and f("") == ""


def test_zone_extraction(spark):
    find = lambda t: [(z["zone"], z["cardinal"]) for z in one(spark, zones.zones_of(F.col("t")), t=t)]
    assert find("În sudul Moldovei și pe litoral [2, 4] °C, în centrul Munteniei") == [("Moldova", "S"), ("Litoral", None), ("Muntenia", None)]
    assert find(None) == find("") == []
    # of compound directions the first part counts, however they are written
    for t in ("nord-estul Munteniei", "Nord-Estul Munteniei", "nordestul Munteniei", "nord-est de Muntenia"):
        assert find(t) == [("Muntenia", "N")]
    assert find("sud-vestul Olteniei, vestul Banatului") == [("Oltenia", "S"), ("Banat", "S")]  # the longer form within reach wins
    assert find("jumătatea estică a Transilvaniei") == [("Transilvania", "E")]
    assert find("în sudul țării, iar în cea mai mare parte a Dobrogei") == [("Dobrogea", None)]
    assert find("zona montană înaltă, zonele extracarpatice, creste montane, interiorul arcului carpatic, deltaplan") == [("Zona montană înaltă", None), ("Câmpie (zone joase extracarpatice)", None), ("Creste montane (peste 2500 m)", None), ("Depresiuni intramontane", None)]
    (z,) = one(spark, zones.zones_of(F.col("t")), t="Pe LITORAL")
    assert z["raw"] == "LITORAL" and z["start"] == 3
    assert len(zones.directions()) == 36 and len(zones.vocabulary()) == 38
    with pytest.raises(ValueError):
        zones.claim_order(["zona de sud", "litoralul zona"][::1] + ["a zona"])


def test_zones_at_stations(spark):
    st = spark.createDataFrame([("A", "Muntenia", "IF", "S"), ("B", "Muntenia", "B", None), ("C", "TransilvaniaN", "MM", "N"), ("D", "Banat-Crisana", "TM", "V"), ("E", None, None, None)], "entity string, region string, county string, cardinal string")
    cl = spark.createDataFrame([("Litoral", "A"), ("Litoral", "Z")], "zone string, entity string")
    tab = zones.zone_table(st, cl)
    z = spark.createDataFrame([(1, "region", "Muntenia", None), (2, "region", "Muntenia", "S"), (3, "region_compound", "Transilvania", None), (4, "region_part", "Banat", "V"), (5, "subregion", "Maramures", "N"), (6, "climatic", "Litoral", None), (7, "region", "Muntenia", "N"), (8, "region", "Narnia", None)], "id int, axis string, zone string, cardinal string")
    got = {}
    for r in zones.at_stations(z, tab).collect():
        got.setdefault(r["id"], set()).add(r["entity"])
    assert got == {1: {"A", "B"}, 2: {"A"}, 3: {"C"}, 4: {"D"}, 5: {"C"}, 6: {"A", "Z"}}
    c = {(r["zone"], r["cardinal"]): r["counties"] for r in zones.counties(z, tab).collect()}
    assert c["Muntenia", None] == "IF,B" and c["Litoral", None] == "IF"
    text = {r["id"]: r["l"] for r in z.select("id", zones.label(F.col("axis"), F.col("zone"), F.col("cardinal")).alias("l")).collect()}
    assert text[2] == "Muntenia (sud)" and text[4] == "Banat (vest)" and text[1] == "Muntenia" and text[6] == "Litoral"
    f = zones.first_mention(z.withColumn("at", F.col("id")), [], ["at"]).collect()
    assert len(f) == 8


def test_nearest_interval(spark):
    df = spark.createDataFrame([(1, "În Dobrogea [2, 4] °C, iar în Banat [6, 8] °C. În Oltenia nimic."), (2, None)], "id int, t string")
    got = {(r["zone"], r["low"]) for r in zones.predictions(df, "id", "t").collect()}
    assert got == {("Dobrogea", 2.0), ("Banat", 6.0)}


@pytest.mark.parametrize("d,accuracy", [(0.0, 1.0), (2.0, 0.5), (4.0, 1 / 3)])
def test_interval_score(spark, d, accuracy):
    k = spark.createDataFrame([(1, "s")], "m int, entity string")
    pred = spark.createDataFrame([(1, "s", 4.0 + d, 6.0 + d)], "m int, entity string, low double, high double")
    value = spark.createDataFrame([("s", 4.0)], "entity string, t double")
    assert zones.interval_score(k, pred, value, ["m"]).first()["accuracy"] == pytest.approx(accuracy)
    nothing = zones.interval_score(k, pred.limit(0), value, ["m"]).first()
    assert nothing["n_missed"] == 1 and nothing["accuracy"] == 0.5


def test_fallback_cascade(spark):
    day = date(2024, 1, 1)
    days = spark.createDataFrame([("a", day, 1.0), ("b", day, 3.0), ("c", day, 8.0), ("b", day + timedelta(1), 5.0)], "entity string, day date, mean_value double")
    dim = spark.createDataFrame([("a", "g1", "p"), ("b", "g2", "p"), ("c", "g3", "q"), ("d", "g4", "q")], "entity string, grp string, parent string")
    got = {(r["day"], r["grp"]): (r["value"], r["source"]) for r in rollup.group_day_fallback(days, dim).collect()}
    assert got[day, "g1"] == (1.0, "group") and got[day + timedelta(1), "g1"] == (5.0, "parent") and got[day + timedelta(1), "g3"] == (5.0, "all")
    assert len(got) == 6


def test_modal_value_tie(spark):
    df = spark.createDataFrame([(1, "x", 3), (2, "x", 1), (3, "x", 3), (4, "x", 1)], "i int, g string, v int")
    assert rollup.ranked_values(df, ["g"], "v", "i", 1).first()["v"] == 3


def test_decode(spark):
    df = spark.createDataFrame([("//", 1), ("5", 2), ("7", 5), ("10", 9), (None, 1), ("99", 1)], "c string, ix int")
    a, b = (spark.createDataFrame([(f"{i:02}", f"{t}{i}") for i in range(20)], "code string, text string") for t in "AB")
    got = [r["meaning"] for r in rollup.decoded(df, F.col("c"), F.col("ix"), a, b).orderBy("ix", "c").collect()]
    assert sorted(got) == sorted(["*", "A5", "B7", "ix invalid", "*", "unknown code 99"])


def test_decode_large_tables(spark):
    a = spark.createDataFrame([("07", "A")] * 200 + [(str(i), f"A{i}") for i in range(100, 300)], "code string, text string").coalesce(1)
    df = spark.createDataFrame([("7", 1), ("299", 2)], "c string, ix int")
    assert sorted(r["meaning"] for r in rollup.decoded(df, F.col("c"), F.col("ix"), a, a.limit(0)).collect()) == ["A", "A299"]


def test_too_many_labels(spark):
    from brumar.operators import impute

    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", t, 1.0, "3", f"l{i}", t, i) for i in range(impute.MOST_LABELS + 1)], "e string, t timestamp_ntz, v double, n string, f string, l timestamp_ntz, i bigint")
    with pytest.raises(ValueError, match="labels"):
        impute.fill_readings(df, "e", "t", "v", "n", "f", "l", "i")


def test_expected_ticks(spark):
    df = spark.createDataFrame([("a", datetime(2024, 12, 20, 6, 30)), ("b", None)], "e string, t timestamp_ntz")
    got = {r["e"]: (r["n_expected"], r["n_found"]) for r in quality.tick_coverage(df, "e", "t", "2024-12-20", 4).collect()}
    assert got == {"a": (95, 1), "b": (95, 0)}


def test_calendar(spark):
    assert {r["split"]: r["count"] for r in assembly.calendar(spark, 2024).groupBy("split").count().collect()} == {"train": 300, "test": 6}
    days = [r["day"].day for r in assembly.analysis_dates(spark, "2024-07-01", "2024-07-30", 4).orderBy("day").collect()]
    assert days == [5, 10, 15, 20, 25, 30]
    assert assembly.analysis_dates(spark, "2024-07-01", "2024-07-01", 4).count() == 1


def test_half_even(spark):
    df = spark.createDataFrame([("a", 0.125)], "m string, v double")
    assert experiments.cube(df, ["m"], "v", 2).first()["mean"] == 0.12


def test_similarity(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("a b", "c d"), ("", "x")], "x string, y string")
    a, b = X.words(F.col("x")), X.words(F.col("y"))
    assert [r[0].f for r in df.select(similarity.rouge_l(a, b)).collect()] == [1, 0, 0]
    assert [round(r[0], 6) for r in df.select(similarity.bleu(a, b)).collect()] == [1, 0, 0]


def test_common_subsequence_against_the_table():
    import random

    r = random.Random(0)
    for _ in range(200):
        x, y = ([r.choice("abcd") for _ in range(r.randint(0, 90))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for t in x:
            diag = 0
            for j, u in enumerate(y, 1):
                diag, row[j] = row[j], diag + 1 if t == u else max(row[j], row[j - 1])
        assert similarity.common_subsequence(x, y) == row[-1]


def test_rouge_l_and_meteor(spark):
    df = spark.createDataFrame([("a b c d", "a x c"), ("the cat sat", "the cat sat"), ("b a", "a b"), ("", "x"), (None, "x")], "x string, y string")
    a, b = X.words(F.col("x")), X.words(F.col("y"))
    got = [r[0] for r in df.select(similarity.rouge_l(a, b)).collect()]
    assert (got[0].precision, got[0].recall, round(got[0].f, 6)) == (0.5, pytest.approx(2 / 3), round(4 / 7, 6))
    m = [r[0] for r in df.select(similarity.meteor(a, b)).collect()]
    # two of four and of three, in two pieces; all in one piece; all in two pieces
    f = 10 * 0.5 * (2 / 3) / (2 / 3 + 9 * 0.5)
    assert m == [pytest.approx(f * 0.5), pytest.approx(1 - 0.5 / 27), pytest.approx(0.5), 0.0, 0.0]


def test_judge_motivation(spark):
    f = lambda t: one(spark, X.motivation(F.col("t")), t=t)
    assert f("PASUL 1: a\nPASUL 3: Motivatie: Diferă cu\n două grade. PASUL 4: [73]") == "Diferă cu două grade."
    assert f("pasul 3 - Bun. [80]") == "Bun." and f("PASUL 3:\nPASUL 4: [3]") is None
    assert f("Text lung.\nMotivație: prea cald\n\nScor [42]") == "prea cald"
    assert f("[42]") is None and f("fără scor") is None and f("") is None and f(None) is None


def test_response_field(spark):
    f = lambda t: one(spark, X.loose_response(F.col("t")), t=t)
    assert f('{"response": {"text": "a  b"}}') == "a b" and f('{"response": {"text": "", "content": "c"}}') == "c"
    assert f('{"response": "<think>x</think> d\\n e"}') == "d e" and f('{"model": "m"}') == "" and f(None) == "" and f("no json") == ""


def test_rendered_blocks(spark):
    df = spark.sql("""select date'2024-07-05' d, 31.25d tmax, cast(null as double) tmin, 0.0d p, named_struct('mean', 2.0d, 'low', 0.5d, 'high', 9.0d) w, cast(null as struct<value:int,n:int>) s,
        array(named_struct('name', 'Ploaie', 'n', 3L), named_struct('name', 'Ceata', 'n', 1L)) ph""")
    day = df.select(rendering.day_block(F.concat(F.lit("ZIUA "), F.col("d").cast("string")), F.col("tmax"), F.col("tmin"), F.col("p"), F.col("w"), F.col("s"), F.col("ph"))).first()[0]
    assert day == "ZIUA 2024-07-05:\nTemperatura medie maximă București: 31.3°C\nPrecipitații medii București: 0.0 l/m²\nVânt: Media 2.0 m/s (min: 0.5, max: 9.0)\nFenomene:\n  - Ploaie: 3 observații\n  - Ceata: 1 observații\n"
    ph = df.select(rendering.phenomena_block(F.col("ph"), F.lit(8))).first()[0]
    assert "Frecvența: 3 apariții (37.5% din timpul observat)" in ph and ph.endswith("- Ploaie: 3 apariții în ultimele 24h\n\n")
    days = spark.sql("select array(named_struct('day', date'2024-07-01', 'amount', 2.5d, 'tmax', 30d, 'tmin', 20d), named_struct('day', date'2024-07-02', 'amount', cast(null as double), 'tmax', cast(null as double), 'tmin', 18d)) x")
    rain = days.select(rendering.precipitation_block(F.col("x"))).first()[0]
    assert "- 01.07.2024: 2.5 l/m² (zi cu precipitații)\n- 02.07.2024: 0.0 l/m² (zi fără precipitații)\n" in rain and "- Zile cu precipitații: 1 din 2\n- Media zilnică: 1.3 l/m²\n\n" in rain
    t = days.select(rendering.temperature_block(F.col("x"))).first()[0]
    assert t == "MEDIA TEMPERATURILOR PENTRU TOATE ZILELE:\n- 01.07 Tmax: 30.0°C, Tmin: 20.0°C\n- 02.07 Tmin: 18.0°C\nTemperatura maximă medie generală: 30.0°C\nTemperatura minimă medie generală: 19.0°C\n\n"
    none = spark.sql("select cast(null as double) v, cast(null as int) i, cast(array() as array<string>) h")
    assert none.select(rendering.wind_block(F.col("v"), F.lit(1), F.lit("x")), rendering.sky_block(F.col("i"), F.lit(1), F.col("h"))).first()[:] == ("", "")
    assert "ore de apariție: 06, 12" in one(spark, rendering.sky_block(F.lit(7), F.lit(2), F.array(F.lit("06"), F.lit("12"))))


def test_checks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0)], "d int, g string, v double")
    b = spark.createDataFrame([(2, "x", 1.0), (3, "x", 2.0)], "d int, g string, v double")
    assert checks.same_panels({"a": a, "b": b}, "d", "g", "v") == 1
    for wrong in (b.withColumn("g", F.lit("y")), b.withColumn("v", F.lit(None).cast("double")), b.withColumn("d", F.col("d") + 9), b.limit(0)):
        with pytest.raises(ValueError):
            checks.same_panels({"a": a, "b": wrong}, "d", "g", "v")
    assert checks.required_item(a, "g", "d", 2).count() == 1
    with pytest.raises(ValueError):
        checks.required_item(a, "d", "v", 2.0)
    (tmp_path / "f").write_text("")
    assert len(checks.required_files(str(tmp_path), ["f"])) == 1
    with pytest.raises(FileNotFoundError, match="g, h"):
        checks.required_files(str(tmp_path), ["f", "g", "h"])
    match = checks.headers_match
    assert match(["Cifra\nde cod", None, "SEMNIFICATIA"], ["Cifra de cod", "Semnificatia"]) and not match(["Cifra"], ["Cifra de cod", "Semnificatia"], exact=True)
    assert match(["Semnificatie"], ["Semnificatia"]) and not match(["xyz", "uvw"], ["Cifra de cod", "Semnificatia"]) and not match([], ["a"])
    assert checks.continues(["12", "Ploaie"], 2) and not checks.continues(["Cod", "Sens"], 2) and not checks.continues(["1"], 2)


@pytest.mark.parametrize("block", [3, 100])
def test_greedy_match(spark, block):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=4)]) for i in range(20)] + [(20, 7, [1.0, 0.0, 0.0, 0.0]), (21, 0, [0.0] * 4), (22, 1, None)]
    df = spark.createDataFrame(rows, "i int, t int, v array<double>")
    want = {}
    for i, t, v in rows[:21]:
        for j, u, w in rows[:21]:
            if i != j:
                want[i, u] = max(want.get((i, u), -2), float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)))
    best = similarity.best_matches(df, "i", "t", "v", block)
    assert {(r["i"], r["other"]): pytest.approx(r["s"]) for r in best.collect()} == want
    mean = lambda a, b: np.mean([s for (i, u), s in want.items() if rows[i][1] == a and u == b])
    got = {(r["t"], r["other"]): (r["precision"], r["recall"]) for r in similarity.greedy_match(best, "t").collect()}
    assert len(got) == 15 and all(got[a, b] == pytest.approx((mean(a, b), mean(b, a))) for a, b in got)


def test_message_errors(spark):
    df = spark.createDataFrame([(1, None), (2, [("user", "x"), ("bot", "y")]), (3, [("user", None)]), (4, [("user", "x")])], "id int, m array<struct<role:string,content:string>>")
    assert sorted((r["id"], r["error"]) for r in assembly.message_errors(df, "id", "m").collect()) == [(1, "no messages"), (2, "unknown role"), (3, "no content")]
