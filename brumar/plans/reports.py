"""Queries of rendered prompt blocks, fold tables, small reshapes and record selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brumar.common import table
from brumar.functions import text as X
from brumar.operators import checks
from brumar.operators import rendering as R
from brumar.plans.experiments import RUNS, runs
from brumar.plans.registry import query
from brumar.plans.sensors import DAILY, DIM, H, READINGS, daily, dim, hourly

_T = "printf('%.1f', floor(round({x}, 6) * 10 + 0.5) / 10)"
FACTS = f"""{DAILY}, {H}, dt AS (SELECT day, avg(tmax) AS tmax, avg(tmin) AS tmin FROM daily GROUP BY 1),
wd AS (SELECT day, avg(wind) AS wm, min(wind) AS wl, max(wind) AS wh, count(wind) AS wn FROM hourly WHERE day IS NOT NULL AND (wind IS NULL OR wind BETWEEN 0 AND 75) GROUP BY 1),
sk AS (SELECT day, CAST(oktas AS BIGINT) AS v, count(*) AS n FROM hourly WHERE day IS NOT NULL AND oktas IS NOT NULL GROUP BY 1, 2), sky AS (SELECT day, v, n FROM sk QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, v) = 1),
pc AS (SELECT day, trim(Fenomen) AS name, count(*) AS n FROM hourly WHERE day IS NOT NULL AND Fenomen IS NOT NULL AND lower(trim(Fenomen)) NOT IN ('', '-', '/', '//', 'n/a', 'na', 'nan', 'null', 'none', 'nu avem fenomen') GROUP BY 1, 2),
ph AS (SELECT day, list(struct_pack(name := name, n := n) ORDER BY n DESC, name) AS ps FROM pc GROUP BY 1),
ob AS (SELECT day, count(Fenomen) AS observed FROM hourly WHERE day IS NOT NULL GROUP BY 1),
f AS (SELECT dt.*, wm, wl, wh, wn, v, n, coalesce(ps, []) AS ps, observed FROM dt LEFT JOIN wd USING (day) LEFT JOIN sky USING (day) LEFT JOIN ph USING (day) LEFT JOIN ob USING (day))"""


def facts(spark, d) -> DataFrame:
    """The facts of every day over all stations: day, tmax, tmin, wind, sky, phenomena, observed."""
    h = hourly(spark, d).where("day is not null")
    temps = daily(spark, d).groupBy("day").agg(F.avg("tmax").alias("tmax"), F.avg("tmin").alias("tmin"))
    usual = h.where("wind is null or wind between 0 and 75").groupBy("day")
    wind = usual.agg(F.struct(F.avg("wind").alias("mean"), F.min("wind").alias("low"), F.max("wind").alias("high"), F.count("wind").alias("n")).alias("wind"))
    sky = h.where("oktas is not null").groupBy("day", F.col("oktas").cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "value")).alias("sky"))
    name = F.trim("Fenomen")
    none = ["", "-", "/", "//", "n/a", "na", "nan", "null", "none", "nu avem fenomen"]
    seen = h.where(F.col("Fenomen").isNotNull() & ~F.lower(name).isin(none)).groupBy("day", name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "n"))), lambda p: F.struct(p["name"].alias("name"), p["n"].alias("n")))
    seen = seen.groupBy("day").agg(listed.alias("phenomena"))
    observed = h.groupBy("day").agg(F.count("Fenomen").alias("observed"))
    out = temps
    for x in (wind, sky, seen, observed):
        out = out.join(x, "day", "left")
    return out.withColumn("phenomena", F.coalesce("phenomena", F.array().cast("array<struct<name:string,n:bigint>>")))


def _sql_line(*parts: str) -> str:
    return "coalesce(" + " || ".join(parts) + " || chr(10), '')"


_FEN = "array_to_string(list_transform(ps, lambda p: '  - ' || p.name || ': ' || p.n || ' observații' || chr(10)), '')"


@query(f"""WITH {FACTS} SELECT day, {_sql_line("'ZIUA '", "strftime(day, '%Y-%m-%d')", "':'")} || {_sql_line("'Temperatura medie maximă București: '", _T.format(x='tmax'), "'°C'")} || {_sql_line("'Temperatura medie minimă București: '", _T.format(x='tmin'), "'°C'")}
|| {_sql_line("'Vânt: Media '", _T.format(x='wm'), "' m/s (min: '", _T.format(x='wl'), "', max: '", _T.format(x='wh'), "')'")} || {_sql_line("'Nebulozitate: Cel mai frecvent '", "v", "'/8 ('", "n", "' măsurători)'")}
|| CASE WHEN len(ps) > 0 THEN 'Fenomene:' || chr(10) || {_FEN} ELSE '' END AS block FROM f""", dates=("day",))
def day_blocks(spark, d):
    """The prompt block of every day."""
    f = facts(spark, d)
    return f.select("day", R.day_block(F.concat(F.lit("ZIUA "), F.col("day").cast("string")), F.col("tmax"), F.col("tmin"), F.lit(None).cast("double"), F.col("wind"), F.col("sky"), F.col("phenomena")).alias("block"))


@query(f"""WITH {FACTS} SELECT day, CASE WHEN wm IS NULL THEN '' ELSE 'ANALIZA VÂNTULUI (Rff1):' || chr(10) || '- Viteza medie înregistrată: ' || {_T.format(x='wm')} || ' m/s' || chr(10) || '- Numărul total de măsurători: ' || wn || chr(10) || '- Caracterizare: vânt ' || CASE WHEN wm < 3 THEN 'slab' WHEN wm < 6 THEN 'moderat' ELSE 'puternic' END || chr(10) || chr(10) END
|| CASE WHEN v IS NULL THEN '' ELSE 'ANALIZA NEBULOZITĂȚII (Nop):' || chr(10) || '- Valoarea cea mai frecventă: ' || v || '/8 (pe scala 1-8)' || chr(10) || '- Numărul de înregistrări cu această valoare: ' || n || chr(10) || '- Caracterizare: ' || CASE WHEN v <= 2 THEN 'cer senin sau puțin noros' WHEN v <= 4 THEN 'cer parțial noros' WHEN v <= 6 THEN 'cer predominant noros' ELSE 'cer complet acoperit de nori' END || chr(10) || chr(10) END AS block FROM f""", dates=("day",))
def analysis_blocks(spark, d):
    """Wind and sky of every day in words."""
    f = facts(spark, d)
    none = F.array().cast("array<string>")
    return f.select("day", F.concat(R.wind_block(F.col("wind.mean"), F.col("wind.n"), X.wind_band(F.col("wind.mean"))), R.sky_block(F.col("sky.value"), F.col("sky.n"), none)).alias("block"))


@query(f"""WITH {FACTS} SELECT day, CASE WHEN len(ps) = 0 THEN '' ELSE 'FENOMENE METEOROLOGICE ÎNREGISTRATE:' || chr(10) || 'Inventarul complet al fenomenelor observate:' || chr(10) || array_to_string(list_transform(ps, lambda p: '- ' || p.name || chr(10) || '  Frecvența: ' || p.n || ' apariții (' || {_T.format(x='100 * p.n / observed')} || '% din timpul observat)' || chr(10)), '')
|| CASE WHEN len(list_filter(ps, lambda p: p.n > 1)) > 0 THEN chr(10) || 'FENOMENE REPETATE (importante pentru propoziția 3):' || chr(10) || array_to_string(list_transform(list_filter(ps, lambda p: p.n > 1), lambda p: '- ' || p.name || ': ' || p.n || ' apariții în ultimele 24h' || chr(10)), '') ELSE '' END || chr(10) END AS block FROM f""", dates=("day",))
def phenomena_blocks(spark, d):
    return facts(spark, d).select("day", R.phenomena_block(F.col("phenomena"), F.col("observed")).alias("block"))


@query(f"""WITH {DAILY}, {DIM}, g AS (SELECT grp, day, avg(tmax) AS tmax, avg(tmin) AS tmin FROM daily JOIN dim USING (entity) WHERE grp IS NOT NULL GROUP BY 1, 2),
l AS (SELECT grp, day, tmax, tmin, CASE WHEN tmax IS NOT NULL THEN '- ' || strftime(day, '%d.%m') || ' Tmax: ' || {_T.format(x='tmax')} || '°C' || coalesce(', Tmin: ' || {_T.format(x='tmin')} || '°C', '') || chr(10) WHEN tmin IS NOT NULL THEN '- ' || strftime(day, '%d.%m') || ' Tmin: ' || {_T.format(x='tmin')} || '°C' || chr(10) ELSE '' END AS line FROM g)
SELECT grp, 'MEDIA TEMPERATURILOR PENTRU TOATE ZILELE:' || chr(10) || string_agg(line, '' ORDER BY day) || {_sql_line("'Temperatura maximă medie generală: '", _T.format(x='avg(tmax)'), "'°C'")} || {_sql_line("'Temperatura minimă medie generală: '", _T.format(x='avg(tmin)'), "'°C'")} || chr(10) AS block FROM l GROUP BY 1""")
def temperature_blocks(spark, d):
    """The temperatures of all days of each county; a year of days at most, so the list of a county is short."""
    g = daily(spark, d).join(dim(spark, d), "entity").where("grp is not null").groupBy("grp", "day").agg(F.avg("tmax").alias("tmax"), F.avg("tmin").alias("tmin"))
    return g.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("day", "tmax", "tmin"))).alias("days")).select("grp", R.temperature_block(F.col("days")).alias("block"))


LAGGED = f"{DAILY}, {DIM}, c AS (SELECT grp, day, avg(tmax) AS v FROM daily JOIN dim USING (entity) WHERE grp IS NOT NULL AND tmax IS NOT NULL GROUP BY 1, 2), e AS (SELECT grp, day, lag(v) OVER (PARTITION BY grp ORDER BY day) - v AS err FROM c)"


@query(f"WITH {LAGGED} SELECT grp, count(err) AS n, round(sqrt(avg(err * err)), 5) AS rmse, round(avg(err), 5) AS mean_error, row_number() OVER (ORDER BY round(sqrt(avg(err * err)), 5) DESC NULLS LAST, grp) AS place FROM e GROUP BY 1")
def group_errors(spark, d):
    """Errors of the forecast 'as yesterday' by county, the worst first; the ranking is over counties, a few rows."""
    c = daily(spark, d).join(dim(spark, d), "entity").where("grp is not null and tmax is not null").groupBy("grp", "day").agg(F.avg("tmax").alias("v"))
    e = c.withColumn("err", F.lag("v").over(Window.partitionBy("grp").orderBy("day")) - F.col("v"))
    got = e.groupBy("grp").agg(F.count("err").alias("n"), F.round(F.sqrt(F.avg(F.col("err") * F.col("err"))), 5).alias("rmse"), F.round(F.avg("err"), 5).alias("mean_error"))
    return got.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("rmse"), "grp")))


@query(f"WITH {RUNS} SELECT model, past_days AS fold, round(avg(score), 6) AS mean_accuracy, count(*) AS n FROM runs GROUP BY 1, 2")
def fold_accuracy(spark, d):
    """Mean score by model and fold."""
    return runs(spark, d).groupBy("model", F.col("past_days").alias("fold")).agg(F.round(F.avg("score"), 6).alias("mean_accuracy"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {RUNS} SELECT past_days, {', '.join(f'coalesce(round(stddev_samp(score) FILTER (WHERE model = {chr(39)}{m}{chr(39)}), 6), 0) AS {m}' for m in 'ANRX')} FROM runs GROUP BY 1")
def pivot_std(spark, d):
    """Deviation by setting and model; models without runs have 0."""
    p = runs(spark, d).groupBy("past_days").pivot("model", list("ANRX")).agg(F.round(F.stddev_samp("score"), 6))
    return p.na.fill(0.0)


@query(f"WITH {RUNS}, s AS (SELECT k, list(score ORDER BY past_days, score) AS x FROM runs GROUP BY 1) SELECT k, x[1] AS score_1, x[2] AS score_2, x[3] AS score_3 FROM s")
def numbered_columns(spark, d):
    """A list of scores as numbered columns; shorter lists leave the last ones null."""
    s = runs(spark, d).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("past_days", "score"))), lambda x: x["score"]).alias("x"))
    return s.select("k", *[F.get("x", F.lit(i)).alias(f"score_{i + 1}") for i in range(3)])


@query("WITH g AS (SELECT approach, split, CAST(past_days AS BIGINT) AS past_days, count(*) AS n FROM test_data_zero_shot GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY approach <> 'zero_shot' NULLS LAST, approach NULLS LAST, split NULLS LAST, past_days NULLS LAST) AS place FROM g")
def run_order(spark, d):
    """Kinds of runs in order: one approach first, then by name, split and days; the ranking is over kinds, a few rows."""
    t = table(spark, d, "test_data_zero_shot").groupBy("approach", "split", "past_days").agg(F.count(F.lit(1)).alias("n"))
    order = [F.asc_nulls_last(F.col("approach") != "zero_shot"), *[F.asc_nulls_last(c) for c in ("approach", "split", "past_days")]]
    return t.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("SELECT CAST(year(processing_timestamp) AS BIGINT) AS year, count(*) AS n, count(formatted_diagnosis) AS n_formatted, round(100.0 * count(formatted_diagnosis) / count(*), 6)::DOUBLE AS success_rate FROM formatted_diagnoses GROUP BY 1")
def yearly_success(spark, d):
    t = table(spark, d, "formatted_diagnoses").groupBy(F.year("processing_timestamp").alias("year"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count("formatted_diagnosis").alias("n_formatted")).withColumn("success_rate", F.round(100.0 * F.col("n_formatted") / F.col("n"), 6))


@query(f"""SELECT Denumire AS entity, count(*) AS n FROM {READINGS} WHERE "Data masurarii" >= TIMESTAMP '2024-12-20' AND "Data masurarii" < TIMESTAMP '2024-12-21' GROUP BY 1""")
def half_open_day(spark, d):
    """Readings of one day, midnight of the next left out; the bounds reach the scan."""
    t = F.col("`Data masurarii`")
    return table(spark, d, READINGS).where((t >= F.expr("timestamp_ntz'2024-12-20'")) & (t < F.expr("timestamp_ntz'2024-12-21'"))).groupBy(F.col("Denumire").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS code, CAST(n_regionkey AS BIGINT) AS meaning FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation)")
def last_columns(spark, d):
    """The last two columns of a table by place, whatever their names."""
    t = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return t.select(*[F.col(c) for c in t.columns[-2:]]).toDF("code", "meaning")


@query("""SELECT test_id, '{' || array_to_string(list_filter([CASE WHEN approach IS NOT NULL THEN '"approach":"' || approach || '"' END, CASE WHEN split IS NOT NULL THEN '"split":"' || split || '"' END, CASE WHEN past_days IS NOT NULL THEN '"past_days":' || past_days END, CASE WHEN sursa IS NOT NULL THEN '"sursa":"' || sursa || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS record FROM test_data_zero_shot""")
def sparse_records(spark, d):
    """Records as JSON without their null fields."""
    return table(spark, d, "test_data_zero_shot").select("test_id", F.to_json(F.struct("approach", "split", "past_days", "sursa")).alias("record"))


@query("WITH t AS (SELECT split, past_days, test_id FROM test_data_zero_shot WHERE past_days IS NOT NULL AND split IS NOT NULL), m AS (SELECT min(past_days) AS p FROM t) SELECT split, CAST(past_days AS BIGINT) AS past_days, count(*) AS n FROM t, m WHERE past_days = p GROUP BY 1, 2")
def past_days_items(spark, d):
    """The items of the smallest setting, of the splits that have it; the check behind would refuse any other split."""
    t = table(spark, d, "test_data_zero_shot").where("past_days is not null and split is not null").select("split", "past_days", "test_id")
    least = t.agg(F.min("past_days")).first()[0]
    t = t.join(t.where(F.col("past_days") == least).select("split").distinct(), "split", "left_semi")
    return checks.required_item(t, "split", "past_days", least).groupBy("split", "past_days").agg(F.count(F.lit(1)).alias("n"))
