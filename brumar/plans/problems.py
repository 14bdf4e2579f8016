"""Queries of the general problems on the readings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brumar.common import table
from brumar.operators.impute import fill_readings
from brumar.operators.regrid import hourly_grid
from brumar.operators.spikes import faulty_readings
from brumar.plans.registry import query

READINGS = "sirdate_1748514797752_bucuresti"
MISSING_TEXT = "('', '-', '--', '/', '//', '///', 'n/a', 'na', 'nan', 'null', 'none')"


def _faults(spark: SparkSession, d: str) -> DataFrame:
    return faulty_readings(table(spark, d, READINGS), "Denumire", "Data masurarii", "Rff1", "id_rand")


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _faults(spark, d)


@query()
def p1_by_station(spark: SparkSession, d: str) -> DataFrame:
    """Faulty rows by station and kind."""
    rows = table(spark, d, READINGS).select("id_rand", "Denumire")
    return _faults(spark, d).join(rows, "id_rand").groupBy("Denumire", "tip").agg(F.count(F.lit(1)).alias("n_rows"))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_readings(table(spark, d, READINGS), "Denumire", "Data masurarii", "Rff1", "Nop", "Fenomen", "data_incarcare", "id_rand")


@query(f"""
SELECT id_rand, 'Rff1' AS camp FROM {READINGS} WHERE Rff1 IS NULL OR isnan(Rff1) OR Rff1 IN (-999, -9999, -99999, -999.9, -9999.9)
UNION ALL SELECT id_rand, 'Nop' FROM {READINGS} WHERE Nop IS NULL OR lower(trim(Nop)) IN {MISSING_TEXT} OR TRY_CAST(trim(Nop) AS DOUBLE) = 9
UNION ALL SELECT id_rand, 'Fenomen' FROM {READINGS} WHERE Fenomen IS NULL OR lower(trim(Fenomen)) IN {MISSING_TEXT}
UNION ALL SELECT id_rand, 'Data masurarii' FROM {READINGS} WHERE "Data masurarii" IS NULL
""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("id_rand", F.explode("lipsa").alias("camp"))


@query()
def p4_filled(spark: SparkSession, d: str) -> DataFrame:
    """The whole table with its missing cells filled and marked."""
    return _filled(spark, d)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return hourly_grid(table(spark, d, READINGS), "Denumire", "Data masurarii", "Rff1")


HOURS_SQL = f"""
WITH h AS (SELECT Denumire AS denumire, date_trunc('hour', "Data masurarii" + INTERVAL 30 MINUTE) AS h, count(*) AS n FROM {READINGS} WHERE Denumire IS NOT NULL AND "Data masurarii" IS NOT NULL GROUP BY 1, 2),
s AS (SELECT denumire, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM h GROUP BY 1)
SELECT s.denumire, strftime(s.h, '%Y-%m-%d %H:%M') AS ora"""


@query(HOURS_SQL + " FROM s LEFT JOIN h ON s.denumire = h.denumire AND s.h = h.h WHERE h.h IS NULL")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where(~F.col("occupied")).select("denumire", "ora")


GRID_SQL = f"""
WITH o AS (SELECT Denumire AS e, epoch_us("Data masurarii") AS t, avg(CASE WHEN isnan(Rff1) OR Rff1 IN (-999, -9999, -99999, -999.9, -9999.9) THEN NULL ELSE Rff1 END) AS v, count(*) AS n FROM {READINGS} WHERE Denumire IS NOT NULL AND "Data masurarii" IS NOT NULL GROUP BY 1, 2),
u AS (SELECT e, t, v, least(coalesce(lead(t) OVER (PARTITION BY e ORDER BY t), t + 10800000000), t + 10800000000) AS until FROM o WHERE v IS NOT NULL),
c AS (SELECT e, t, v, until, unnest(generate_series((t + 1800000000) // 3600000000, (until - 1 + 1800000000) // 3600000000)) AS h FROM u),
w AS (SELECT e, h, v, least(until, h * 3600000000 + 1800000000) - greatest(t, h * 3600000000 - 1800000000) AS k FROM c),
m AS (SELECT e, h, sum(v * k) AS vk, sum(k) AS k FROM w GROUP BY 1, 2),
r AS (SELECT e, (t + 1800000000) // 3600000000 AS h, sum(n) AS n FROM o GROUP BY 1, 2),
s AS (SELECT e, unnest(generate_series(min(h), max(h))) AS h FROM r GROUP BY 1)
SELECT s.e AS denumire, strftime(make_timestamp(s.h * 3600000000), '%Y-%m-%d %H:%M') AS ora, round(vk / k, 6) AS mean_value, round(coalesce(k, 0) / 3600000000, 6)::DOUBLE AS coverage, coalesce(n, 0)::BIGINT AS n_rows, n IS NOT NULL AS occupied, CASE WHEN n IS NOT NULL THEN 'read' WHEN k > 0 THEN 'filled' ELSE 'missing' END AS mark
FROM s LEFT JOIN m ON s.e = m.e AND s.h = m.h LEFT JOIN r ON s.e = r.e AND s.h = r.h"""


@query(GRID_SQL)
def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    """One row per station and full hour with its time-weighted mean, coverage and mark."""
    return _grid(spark, d).withColumns({"mean_value": F.round("mean_value", 6), "coverage": F.round("coverage", 6)})


@query(HOURS_SQL + ", CAST(coalesce(h.n, 0) AS BIGINT) AS n_rows FROM s LEFT JOIN h ON s.denumire = h.denumire AND s.h = h.h")
def p6_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Rows that occupy each full hour."""
    return _grid(spark, d).select("denumire", "ora", "n_rows")
