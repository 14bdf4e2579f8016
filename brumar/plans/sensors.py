"""Queries on stations: masking, filling, roll-up, coverage, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brumar.common import table
from brumar.functions import text as X
from brumar.operators import quality as Q
from brumar.operators import rollup as R
from brumar.plans.registry import query

READINGS = "sirdate_1748514797752_bucuresti"
SENTINELS = [-999.0, -9999.0]
TARGET, DAYS = "2024-12-20", 4

MASK = "CASE WHEN {c} IS NULL OR isnan({c}) OR {c} IN (-999, -9999) THEN NULL ELSE {c} END"
OKTAS = "CASE WHEN isnan(TRY_CAST(trim(Nop) AS DOUBLE)) OR TRY_CAST(trim(Nop) AS DOUBLE) = 9 THEN NULL ELSE TRY_CAST(trim(Nop) AS DOUBLE) END"
H = f"""hourly AS (SELECT id_rand, Denumire AS entity, "Data masurarii" AS ts, CAST("Data masurarii" AS DATE) AS day, {MASK.format(c='Rff1')} AS wind, {OKTAS} AS oktas, Nop, Fenomen FROM {READINGS})"""
E_DAY = H + """, eday AS (SELECT entity, day, avg(wind) AS mean_value FROM hourly WHERE entity IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)"""
DIM = """dim AS (SELECT nume_NUME AS entity, max(judet_JU) AS grp, max(regiune_CMR) AS parent FROM statii_meteo WHERE nume_NUME IS NOT NULL GROUP BY 1)"""
DAILY = f"""daily AS (SELECT Denumire AS entity, CAST("Data masurarii" AS DATE) AS day, avg({MASK.format(c='Tamax24')}) AS tmax, avg({MASK.format(c='Tamin24')}) AS tmin FROM datezilnicetemp_bucuresti WHERE Denumire IS NOT NULL AND "Data masurarii" IS NOT NULL GROUP BY 1, 2)"""


def hourly(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, READINGS)
    return t.select("id_rand", F.col("Denumire").alias("entity"), F.col("`Data masurarii`").alias("ts"), F.to_date("`Data masurarii`").alias("day"), Q.masked(F.col("Rff1"), SENTINELS).alias("wind"), Q.number_of(F.trim("Nop"), [9]).alias("oktas"), "Nop", "Fenomen")


def daily(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "datezilnicetemp_bucuresti").where("Denumire is not null and `Data masurarii` is not null")
    return t.groupBy(F.col("Denumire").alias("entity"), F.to_date("`Data masurarii`").alias("day")).agg(F.avg(Q.masked(F.col("Tamax24"), SENTINELS)).alias("tmax"), F.avg(Q.masked(F.col("Tamin24"), SENTINELS)).alias("tmin"))


def dim(spark: SparkSession, d: str) -> DataFrame:
    return R.station_dim(table(spark, d, "statii_meteo"), "nume_NUME", "judet_JU", "regiune_CMR")


def r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


@query(f"""SELECT Denumire AS entity, count(*) AS n_rows,
count(*) FILTER (WHERE Rff1 IS NOT NULL AND (isnan(Rff1) OR Rff1 IN (-999, -9999))) AS n_masked,
count(*) FILTER (WHERE Nop IS NOT NULL AND (TRY_CAST(trim(Nop) AS DOUBLE) IS NULL OR isnan(TRY_CAST(trim(Nop) AS DOUBLE)))) AS n_coerced,
count(*) FILTER (WHERE TRY_CAST(trim(Nop) AS DOUBLE) = 9) AS n_obscured FROM {READINGS} GROUP BY 1""")
def masked_readings(spark, d):
    t = table(spark, d, READINGS).select(F.col("Denumire").alias("entity"), "Rff1", F.trim("Nop").alias("Nop"))
    return Q.mask_counts(t, "entity", "Rff1", "Nop", SENTINELS, 9.0)


@query(f"WITH {E_DAY} SELECT entity, day, round(mean_value, 6) AS mean_value FROM eday", dates=("day",))
def entity_day_mean(spark, d):
    return Q.entity_day_mean(hourly(spark, d), "entity", "ts", "wind").withColumns(r6("mean_value"))


FILL = "coalesce({c}, avg({c}) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"


@query(f"WITH {DAILY} SELECT entity, day, round({FILL.format(c='tmax')}, 6) AS tmax, round({FILL.format(c='tmin')}, 6) AS tmin FROM daily", dates=("day",))
def neighbour_fill(spark, d):
    return Q.neighbour_fill(daily(spark, d), "entity", "day", ["tmax", "tmin"], 3).withColumns(r6("tmax", "tmin"))


@query(f"""WITH {DAILY}, f AS (SELECT tmax, tmin, {FILL.format(c='tmax')} AS fmax, {FILL.format(c='tmin')} AS fmin FROM daily)
SELECT 'tmax' AS variable, count(*) FILTER (WHERE tmax IS NULL) AS n_missing, count(*) FILTER (WHERE tmax IS NULL AND fmax IS NOT NULL) AS n_filled, count(*) FILTER (WHERE fmax IS NULL) AS n_still_missing FROM f
UNION ALL SELECT 'tmin', count(*) FILTER (WHERE tmin IS NULL), count(*) FILTER (WHERE tmin IS NULL AND fmin IS NOT NULL), count(*) FILTER (WHERE fmin IS NULL) FROM f""")
def fill_audit(spark, d):
    return Q.fill_audit(daily(spark, d), "entity", "day", ["tmax", "tmin"], 3)


@query(f"""WITH {E_DAY}, {DIM},
filled AS (SELECT entity, day, coalesce(mean_value, avg(mean_value) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS v FROM eday),
r AS (SELECT f.day, d.grp, d.parent, f.v FROM filled f JOIN dim d ON f.entity = d.entity WHERE v IS NOT NULL AND grp IS NOT NULL AND parent IS NOT NULL),
spine AS (SELECT day, grp, parent FROM (SELECT DISTINCT day FROM r), (SELECT DISTINCT grp, parent FROM r)),
g AS (SELECT day, grp, parent, avg(v) AS v FROM r GROUP BY 1, 2, 3), p AS (SELECT day, parent, avg(v) AS v FROM r GROUP BY 1, 2), a AS (SELECT day, avg(v) AS v FROM r GROUP BY 1)
SELECT s.day, s.grp, s.parent, round(coalesce(g.v, p.v, a.v), 6) AS value, CASE WHEN g.v IS NOT NULL THEN 'group' WHEN p.v IS NOT NULL THEN 'parent' ELSE 'all' END AS source
FROM spine s LEFT JOIN g ON s.day = g.day AND s.grp = g.grp AND s.parent = g.parent LEFT JOIN p ON s.day = p.day AND s.parent = p.parent LEFT JOIN a ON s.day = a.day""", dates=("day",))
def group_day_fallback(spark, d):
    days = Q.entity_day_mean(hourly(spark, d), "entity", "ts", "wind")
    filled = Q.neighbour_fill(days, "entity", "day", ["mean_value"], 3)
    return R.group_day_fallback(filled, dim(spark, d)).withColumns(r6("value"))


@query(f"""WITH {DAILY}, span AS (SELECT min(day) AS lo, max(day) AS hi FROM daily),
months AS (SELECT CAST(m AS DATE) AS m0, lo, hi FROM span, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS t(m)),
whole AS (SELECT m0 FROM months WHERE m0 >= lo AND last_day(m0) <= hi),
spine AS (SELECT entity, m0, CAST(x AS DATE) AS day FROM (SELECT DISTINCT entity FROM daily), whole, unnest(generate_series(m0, last_day(m0), INTERVAL 1 DAY)) AS t(x))
SELECT s.entity, strftime(m0, '%Y-%m') AS month, count(*) AS n_missing, count(*) = day(last_day(m0)) AS whole_month, string_agg(strftime(s.day, '%d'), ',' ORDER BY s.day) AS days
FROM spine s ANTI JOIN daily d ON s.entity = d.entity AND s.day = d.day GROUP BY s.entity, m0""")
def month_registry_audit(spark, d):
    return Q.month_audit(daily(spark, d).withColumn("ts", F.col("day")), "entity", "ts")


@query(f"""WITH {H}, e AS (SELECT DISTINCT entity FROM hourly WHERE entity IS NOT NULL),
ticks AS (SELECT entity, x AS tick FROM e, unnest(generate_series(TIMESTAMP '{TARGET} 08:30:00' - INTERVAL {DAYS} DAY, TIMESTAMP '{TARGET} 06:30:00', INTERVAL 1 HOUR)) AS t(x)),
g AS (SELECT entity, tick, EXISTS (SELECT 1 FROM hourly h WHERE h.entity = ticks.entity AND h.ts > ticks.tick - INTERVAL 1 HOUR AND h.ts <= ticks.tick) AS hit FROM ticks)
SELECT entity, count(*) AS n_expected, count(*) FILTER (WHERE hit) AS n_found, count(*) - count(*) FILTER (WHERE hit) AS n_missing, round(count(*) FILTER (WHERE hit) * 100.0 / count(*), 4)::DOUBLE AS pct, round(count(*) FILTER (WHERE hit) * 100.0 / count(*), 4) >= 95 AS sufficient FROM g GROUP BY 1""")
def tick_coverage(spark, d):
    return Q.tick_coverage(hourly(spark, d), "entity", "ts", TARGET, DAYS).withColumn("pct", F.col("pct").cast("double"))


@query(f"""WITH a AS (SELECT DISTINCT Denumire AS name FROM {READINGS} WHERE Denumire IS NOT NULL), b AS (SELECT DISTINCT nume_NUME AS name FROM statii_meteo WHERE nume_NUME IS NOT NULL)
SELECT name, 'both' AS side FROM a SEMI JOIN b USING (name) UNION ALL SELECT name, 'data_only' FROM a ANTI JOIN b USING (name) UNION ALL SELECT name, 'registry_only' FROM b ANTI JOIN a USING (name)""")
def registry_join_unmatched(spark, d):
    return Q.registry_match(table(spark, d, READINGS), table(spark, d, "statii_meteo"), "Denumire", "nume_NUME")


@query("""SELECT CAST(t."Cod sinoptic" AS BIGINT) AS code, t.Denumire AS entity, r.judet_JU AS county, count(*) AS n_rows FROM datezilnicetemp_bucuresti t
LEFT JOIN (SELECT cod_wmo_CODST, max(judet_JU) AS judet_JU FROM statii_meteo GROUP BY 1) r ON t."Cod sinoptic" = r.cod_wmo_CODST GROUP BY 1, 2, 3""")
def registry_left_join(spark, d):
    reg = table(spark, d, "statii_meteo").groupBy("cod_wmo_CODST").agg(F.max("judet_JU").alias("county"))
    t = table(spark, d, "datezilnicetemp_bucuresti").select(F.col("`Cod sinoptic`").alias("code"), F.col("Denumire").alias("entity"))
    return t.join(reg, t["code"] == reg["cod_wmo_CODST"], "left").groupBy("code", "entity", "county").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH s AS (SELECT DISTINCT Denumire AS member, 'daily' AS s FROM datezilnicetemp_bucuresti WHERE Denumire IS NOT NULL UNION ALL SELECT DISTINCT Denumire, 'hourly' FROM {READINGS} WHERE Denumire IS NOT NULL UNION ALL SELECT DISTINCT nume_NUME, 'registry' FROM statii_meteo WHERE nume_NUME IS NOT NULL),
g AS (SELECT member, count(*) AS n_sets, list(s) AS have FROM s GROUP BY 1)
SELECT member, n_sets, array_to_string(list_filter(['daily', 'hourly', 'registry'], lambda x: NOT list_contains(have, x)), ',') AS missing_from FROM g WHERE n_sets < 3""")
def set_consistency(spark, d):
    return Q.set_consistency({"hourly": table(spark, d, READINGS).select("Denumire"), "daily": table(spark, d, "datezilnicetemp_bucuresti").select("Denumire"), "registry": table(spark, d, "statii_meteo").select("nume_NUME")})


MONTH = DAILY + """, m AS (SELECT entity, strftime(day, '%Y-%m') AS month, avg(tmin) AS mean_low, avg(tmax) AS mean_high, avg((tmin + tmax) / 2) AS mean_mid, count(*) AS days_used FROM daily WHERE tmin IS NOT NULL AND tmax IS NOT NULL GROUP BY 1, 2)"""


def monthly(spark, d):
    return R.entity_month_mean(daily(spark, d), "tmin", "tmax")


@query(f"WITH {MONTH} SELECT entity, month, round(mean_low, 6) AS mean_low, round(mean_high, 6) AS mean_high, round(mean_mid, 6) AS mean_mid, days_used FROM m")
def entity_month_mean(spark, d):
    return monthly(spark, d).withColumns(r6("mean_low", "mean_high", "mean_mid"))


MACRO = f"""{MONTH}, {DIM}, x AS (SELECT d.entity, d.grp, k.month, m.mean_mid FROM dim d CROSS JOIN (SELECT DISTINCT month FROM m) k LEFT JOIN m ON m.entity = d.entity AND m.month = k.month WHERE d.grp IS NOT NULL),
g AS (SELECT grp, month, avg(mean_mid) AS mean_mid, count(*) AS n_expected, count(mean_mid) AS n_aggregated, coalesce(string_agg(CASE WHEN mean_mid IS NULL THEN entity END, '|' ORDER BY entity), '') AS missing FROM x GROUP BY 1, 2)"""


@query(f"WITH {MACRO} SELECT grp, month, round(mean_mid, 6) AS mean_mid, n_expected, n_aggregated, missing FROM g")
def group_macro_average(spark, d):
    return R.group_macro(monthly(spark, d), dim(spark, d)).withColumns(r6("mean_mid"))


@query(f"WITH {MONTH} SELECT month, round(avg(mean_mid), 6) AS mean_mid, count(*) AS n_entities FROM m GROUP BY 1")
def global_macro_average(spark, d):
    return monthly(spark, d).groupBy("month").agg(F.round(F.avg("mean_mid"), 6).alias("mean_mid"), F.count(F.lit(1)).alias("n_entities"))


@query(f"""WITH {MACRO}, r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY mean_mid DESC, grp) AS a, row_number() OVER (PARTITION BY month ORDER BY mean_mid, grp) AS b FROM (SELECT grp, month, round(mean_mid, 6) AS mean_mid FROM g WHERE mean_mid IS NOT NULL))
SELECT month, max(grp) FILTER (WHERE a = 1) AS largest, max(mean_mid) AS largest_value, max(grp) FILTER (WHERE b = 1) AS smallest, min(mean_mid) AS smallest_value FROM r GROUP BY 1""")
def extremes(spark, d):
    g = R.group_macro(monthly(spark, d), dim(spark, d)).withColumns(r6("mean_mid"))
    return R.extremes(g, "month", "grp", "mean_mid")


@query(f"""WITH {DIM}, a AS (SELECT DISTINCT Denumire AS entity, 'da' AS hourly FROM {READINGS} WHERE Denumire IS NOT NULL), b AS (SELECT DISTINCT Denumire AS entity, 'da' AS daily FROM datezilnicetemp_bucuresti WHERE Denumire IS NOT NULL)
SELECT coalesce(dim.entity, a.entity, b.entity) AS entity, grp, parent, hourly, daily FROM dim FULL JOIN a ON dim.entity = a.entity FULL JOIN b ON b.entity = coalesce(dim.entity, a.entity)""")
def unified_classification(spark, d):
    a = table(spark, d, READINGS).select(F.col("Denumire").alias("entity")).where("entity is not null").distinct().withColumn("hourly", F.lit("da"))
    b = table(spark, d, "datezilnicetemp_bucuresti").select(F.col("Denumire").alias("entity")).where("entity is not null").distinct().withColumn("daily", F.lit("da"))
    return dim(spark, d).join(a, "entity", "full").join(b, "entity", "full").select("entity", "grp", "parent", "hourly", "daily")


@query(f"WITH {DIM} SELECT parent, grp, count(*) AS n_entities, string_agg(entity, '|' ORDER BY entity) AS entities FROM dim WHERE grp IS NOT NULL AND parent IS NOT NULL GROUP BY 1, 2")
def nested_classification(spark, d):
    return dim(spark, d).where("grp is not null and parent is not null").groupBy("parent", "grp").agg(F.count(F.lit(1)).alias("n_entities"), F.concat_ws("|", F.array_sort(F.collect_list("entity"))).alias("entities"))


RANK = H + """, n AS (SELECT day, {v} AS val, count(*) AS n, min(id_rand) AS f FROM hourly WHERE {v} IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2), r AS (SELECT day, val, n, row_number() OVER (PARTITION BY day ORDER BY n DESC, f) AS rank FROM n)"""


@query(f"WITH {RANK.format(v='oktas')} SELECT day, val AS oktas, n, rank FROM r WHERE rank <= 1", dates=("day",))
def modal_value(spark, d):
    return R.ranked_values(hourly(spark, d).where("day is not null"), ["day"], "oktas", "id_rand", 1)


@query(f"WITH {RANK.format(v='Fenomen')} SELECT day, val AS Fenomen, n, rank FROM r WHERE rank <= 3", dates=("day",))
def top3_values(spark, d):
    return R.ranked_values(hourly(spark, d).where("day is not null"), ["day"], "Fenomen", "id_rand", 3)


@query(f"""WITH {H}, c AS (SELECT day, oktas, hour(ts) AS h, count(*) AS n FROM hourly WHERE oktas IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT day, oktas, row_number() OVER (PARTITION BY day ORDER BY sum(n) DESC, oktas) AS r FROM c GROUP BY 1, 2),
t AS (SELECT c.day, c.oktas, c.h, c.n, row_number() OVER (PARTITION BY c.day ORDER BY c.n DESC, c.h) AS rank FROM c JOIN m ON c.day = m.day AND c.oktas = m.oktas AND m.r = 1)
SELECT day, oktas, string_agg(lpad(CAST(h AS VARCHAR), 2, '0') || ':00', ', ' ORDER BY rank) AS hours FROM t WHERE rank <= 3 GROUP BY 1, 2""", dates=("day",))
def modal_value_hours(spark, d):
    from pyspark.sql import Window

    c = hourly(spark, d).where("oktas is not null and ts is not null").groupBy("day", "oktas", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("day", "oktas").agg(F.sum("n").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("s"), "oktas"))).where("r = 1").select("day", "oktas")
    t = c.join(m, ["day", "oktas"]).withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "h"))).where("rank <= 3")
    label = F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda s: F.concat(F.lpad(s["h"].cast("string"), 2, "0"), F.lit(":00")))
    return t.groupBy("day", "oktas").agg(F.array_join(label, ", ").alias("hours"))


@query(f"""WITH {H}, n AS (SELECT entity, Fenomen, count(*) AS n FROM hourly WHERE Fenomen IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, round(n * 100.0 / sum(n) OVER (PARTITION BY entity), 6)::DOUBLE AS pct FROM n)
SELECT entity, Fenomen, n, pct, n > 1 AS repeated FROM p WHERE Fenomen <> 'Nu avem fenomen'""")
def frequency_share(spark, d):
    return R.frequency_share(hourly(spark, d), "entity", "Fenomen", "Nu avem fenomen").withColumn("pct", F.col("pct").cast("double"))


@query(f"""WITH r AS (SELECT Denumire AS entity, CAST("Data masurarii" AS DATE) AS day, {MASK.format(c='Tamax24')} AS tmax, {MASK.format(c='Tamin24')} AS tmin, data_incarcare, row_number() OVER (PARTITION BY Denumire, CAST("Data masurarii" AS DATE) ORDER BY data_incarcare NULLS FIRST, Tamax24 NULLS FIRST, Tamin24 NULLS FIRST) AS rn FROM datezilnicetemp_bucuresti WHERE "Data masurarii" IS NOT NULL)
SELECT day, round(avg(tmax), 6) AS mean_first, count(*) AS n_entities FROM r WHERE rn = 1 GROUP BY 1""", dates=("day",))
def dedup_first_mean(spark, d):
    t = table(spark, d, "datezilnicetemp_bucuresti").where("`Data masurarii` is not null").withColumn("day", F.to_date("`Data masurarii`"))
    one = R.first_row(t, ["Denumire", "day"], ["data_incarcare", "Tamax24", "Tamin24"])
    return one.groupBy("day").agg(F.round(F.avg(Q.masked(F.col("Tamax24"), SENTINELS)), 6).alias("mean_first"), F.count(F.lit(1)).alias("n_entities"))


@query(f"""WITH {H} SELECT day, round(avg(wind), 6) AS mean_wind, min(wind) AS min_wind, max(wind) AS max_wind, count(wind) AS n FROM hourly WHERE day IS NOT NULL GROUP BY 1""", dates=("day",))
def wind_day_stats(spark, d):
    return hourly(spark, d).where("day is not null").groupBy("day").agg(F.round(F.avg("wind"), 6).alias("mean_wind"), F.min("wind").alias("min_wind"), F.max("wind").alias("max_wind"), F.count("wind").alias("n"))


@query(f"""WITH x AS (SELECT CAST("Data masurarii" AS DATE) AS day, avg({MASK.format(c='Tamax24')}) AS tmax, avg({MASK.format(c='Tamin24')}) AS tmin FROM datezilnicetemp_bucuresti WHERE "Data masurarii" IS NOT NULL GROUP BY 1)
SELECT round(avg(tmax), 6) AS mean_tmax, round(avg(tmin), 6) AS mean_tmin, count(*) AS n_days FROM x""")
def overall_means(spark, d):
    t = table(spark, d, "datezilnicetemp_bucuresti").where("`Data masurarii` is not null")
    x = t.groupBy(F.to_date("`Data masurarii`").alias("day")).agg(F.avg(Q.masked(F.col("Tamax24"), SENTINELS)).alias("tmax"), F.avg(Q.masked(F.col("Tamin24"), SENTINELS)).alias("tmin"))
    return x.agg(F.round(F.avg("tmax"), 6).alias("mean_tmax"), F.round(F.avg("tmin"), 6).alias("mean_tmin"), F.count(F.lit(1)).alias("n_days"))


@query(f"""WITH {H} SELECT CASE WHEN wind < 3 THEN 'slab' WHEN wind < 6 THEN 'moderat' WHEN wind IS NOT NULL THEN 'puternic' END AS wind_band, CASE WHEN oktas <= 2 THEN 'senin' WHEN oktas <= 4 THEN 'variabil' WHEN oktas <= 6 THEN 'noros' WHEN oktas IS NOT NULL THEN 'acoperit' END AS sky_band, count(*) AS n FROM hourly GROUP BY 1, 2""")
def descriptor_bands(spark, d):
    return hourly(spark, d).groupBy(X.wind_band(F.col("wind")).alias("wind_band"), X.sky_band(F.col("oktas")).alias("sky_band")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, n_name AS text FROM nation), b AS (SELECT lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS code, r_name AS text FROM region),
l AS (SELECT CASE WHEN l_discount = 0 THEN '//' WHEN l_tax = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS code, l_linenumber + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS ix FROM lineitem),
m AS (SELECT l.code, ix, CASE WHEN l.code IS NULL OR l.code = '//' THEN '*' WHEN ix BETWEEN 1 AND 3 THEN coalesce(a.text, 'unknown code ' || CASE WHEN length(l.code) < 2 THEN lpad(l.code, 2, '0') ELSE l.code END) WHEN ix BETWEEN 4 AND 7 THEN coalesce(b.text, 'unknown code ' || CASE WHEN length(l.code) < 2 THEN lpad(l.code, 2, '0') ELSE l.code END) ELSE 'ix invalid' END AS meaning
FROM l LEFT JOIN a ON CASE WHEN length(l.code) < 2 THEN lpad(l.code, 2, '0') ELSE l.code END = a.code LEFT JOIN b ON CASE WHEN length(l.code) < 2 THEN lpad(l.code, 2, '0') ELSE l.code END = b.code)
SELECT code, CAST(ix AS BIGINT) AS ix, meaning, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def code_decode(spark, d):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    a = table(spark, d, "nation").select(pad("n_nationkey").alias("code"), F.col("n_name").alias("text"))
    b = table(spark, d, "region").select(pad("r_regionkey").alias("code"), F.col("r_name").alias("text"))
    code = F.when(F.col("l_discount") == 0, "//").when(F.col("l_tax") == 0, None).otherwise(F.col("l_quantity").cast("int").cast("string"))
    rows = table(spark, d, "lineitem").select(code.alias("code"), (F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 2).otherwise(0)).cast("bigint").alias("ix"))
    return R.decoded(rows, F.col("code"), F.col("ix"), a, b).groupBy("code", "ix", "meaning").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DAILY}, {DIM} SELECT strftime(day, '%Y-%m-%d') AS date, round(avg(CASE WHEN grp = 'BUCURESTI' THEN (tmax + tmin) / 2 END), 6) AS BUCURESTI, round(avg(CASE WHEN grp = 'ILFOV' THEN (tmax + tmin) / 2 END), 6) AS ILFOV FROM daily JOIN dim USING (entity) GROUP BY 1""")
def group_matrix(spark, d):
    """The wide export: one row a day, one column a group (the list of groups is given)."""
    j = daily(spark, d).join(dim(spark, d), "entity").withColumn("v", (F.col("tmax") + F.col("tmin")) / 2)
    p = j.groupBy(F.date_format("day", "yyyy-MM-dd").alias("date")).pivot("grp", ["BUCURESTI", "ILFOV"]).agg(F.avg("v"))
    return p.select("date", F.round("BUCURESTI", 6).alias("BUCURESTI"), F.round("ILFOV", 6).alias("ILFOV"))


@query(f"""SELECT Denumire, count(*) AS n_rows FROM {READINGS} WHERE lower(Denumire) LIKE '%filaret%' AND "Data masurarii" BETWEEN TIMESTAMP '{TARGET} 00:00:00' - INTERVAL 3 DAY AND TIMESTAMP '{TARGET} 06:30:00' GROUP BY 1""")
def window_substring_filter(spark, d):
    t = table(spark, d, READINGS)
    lo, hi = F.expr(f"timestamp_ntz'{TARGET} 00:00:00' - interval 3 days"), F.expr(f"timestamp_ntz'{TARGET} 06:30:00'")
    return t.where(F.coalesce(F.lower("Denumire").contains("filaret"), F.lit(False)) & F.col("`Data masurarii`").between(lo, hi)).groupBy("Denumire").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""SELECT Denumire, CAST("Data masurarii" AS DATE) - 1 AS day, round(sum(coalesce({MASK.format(c='Tamin24')}, 0)), 6) AS total, count(*) FILTER (WHERE {MASK.format(c='Tamin24')} > 0) AS n_positive FROM datezilnicetemp_bucuresti WHERE "Data masurarii" IS NOT NULL GROUP BY 1, 2""", dates=("day",))
def shifted_totals(spark, d):
    """Values belong to the day before; totals take a null as 0."""
    v = Q.masked(F.col("Tamin24"), SENTINELS)
    t = table(spark, d, "datezilnicetemp_bucuresti").where("`Data masurarii` is not null")
    return t.groupBy("Denumire", F.date_add(F.to_date("`Data masurarii`"), -1).alias("day")).agg(F.round(F.sum(F.coalesce(v, F.lit(0.0))), 6).alias("total"), F.count_if(v > 0).alias("n_positive"))
