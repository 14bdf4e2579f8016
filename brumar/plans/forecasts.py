"""Queries on windows, folds, scaling and closed-form forecasts over the daily means of stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from brumar.operators import forecast as P
from brumar.operators import quality as Q
from brumar.plans.registry import query
from brumar.plans.sensors import E_DAY, hourly, r6

W, H, K = 7, 3, 4


def series(spark, d):
    return Q.entity_day_mean(hourly(spark, d), "entity", "ts", "wind").where("mean_value is not null")


def samples(spark, d):
    return P.sliding(series(spark, d), "entity", "day", "mean_value", W, H)


def folded(spark, d):
    from pyspark.sql import Window

    s = samples(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    return s.withColumn("fold", P.fold_of(F.col("sample"), n, K))


S = E_DAY + f""", s0 AS (SELECT entity, day, mean_value AS v FROM eday WHERE mean_value IS NOT NULL),
s1 AS (SELECT entity, day, v, list(v) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS x, list(v) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) AS y FROM s0),
s2 AS (SELECT entity, day AS anchor, x, y, row_number() OVER (PARTITION BY entity ORDER BY day) - 1 AS sample FROM s1 WHERE len(x) = {W} AND len(y) = {H}),
s3 AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM s2),
s AS (SELECT *, CASE """ + " ".join(f"WHEN sample >= floor({i} * n / {K + 1}) THEN {i}" for i in range(K, 0, -1)) + """ ELSE 0 END AS fold FROM s3)"""
FC = """, f AS (SELECT entity, fold, sample, h, {pred} AS pred, y[h] AS actual FROM s, unnest(generate_series(1, %d)) AS t(h))""" % H
ERR = "round(sqrt(avg((pred - actual) * (pred - actual))), 6) AS rmse, round(avg(abs(pred - actual)), 6) AS mae, count(*) AS n"


@query(f"WITH {S} SELECT entity, sample, anchor, round(list_sum(x), 6) AS sum_x, round(y[1], 6) AS first_y, round(y[{H}], 6) AS last_y FROM s", dates=("anchor",))
def sliding_windows(spark, d):
    x = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return samples(spark, d).select("entity", "sample", "anchor", F.round(x, 6).alias("sum_x"), F.round(F.element_at("y", 1), 6).alias("first_y"), F.round(F.element_at("y", H), 6).alias("last_y"))


@query("SELECT i AS fold, CAST(floor(i * 348 / 5) AS BIGINT) AS train_to, CAST(floor(i * 348 / 5) AS BIGINT) AS test_from, CAST(floor((i + 1) * 348 / 5) AS BIGINT) AS test_to FROM generate_series(1, 4) AS t(i)")
def fold_edges(spark, d):
    return P.fold_edges(spark, 348, 4)


@query(f"WITH {S} SELECT entity, CAST(fold AS BIGINT) AS fold, count(*) AS n FROM s GROUP BY 1, 2")
def fold_sizes(spark, d):
    return folded(spark, d).groupBy("entity", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S}, t AS (SELECT s.entity, k.fold, unnest(s.x) AS v FROM s JOIN (SELECT DISTINCT entity, fold FROM s WHERE fold > 0) k ON s.entity = k.entity AND s.fold < k.fold)
SELECT entity, CAST(fold AS BIGINT) AS fold, round(avg(v), 5) AS mu, round(greatest(stddev_pop(v), 1e-6), 5) AS sigma FROM t GROUP BY 1, 2""")
def scaler_fit(spark, d):
    return P.fitted_scaler(folded(spark, d), "entity", "fold").where(F.col("fold") <= K).select("entity", "fold", F.round("mu", 5).alias("mu"), F.round("sigma", 5).alias("sigma"))


@query(f"""WITH {S}, t AS (SELECT s.entity, k.fold, unnest(s.x) AS v FROM s JOIN (SELECT DISTINCT entity, fold FROM s WHERE fold > 0) k ON s.entity = k.entity AND s.fold < k.fold), z AS (SELECT entity, fold, avg(v) AS mu, greatest(stddev_pop(v), 1e-6) AS sigma FROM t GROUP BY 1, 2)
SELECT s.entity, sample, round((x[{W}] - mu) / sigma, 4) AS scaled FROM s JOIN z ON s.entity = z.entity AND s.fold = z.fold""")
def scaler_apply(spark, d):
    """The last input of every test sample in the scale of its fold."""
    s = folded(spark, d)
    z = P.fitted_scaler(s, "entity", "fold")
    return s.join(z, ["entity", "fold"]).select("entity", "sample", F.round((F.element_at("x", -1) - F.col("mu")) / F.col("sigma"), 4).alias("scaled"))


@query(f"WITH {S} SELECT s.entity, sample, round(x[{W}], 4) AS value FROM s JOIN (SELECT DISTINCT entity, fold FROM s WHERE fold > 0) k ON s.entity = k.entity AND s.fold = k.fold")
def scaler_inverse(spark, d):
    """Scaled and scaled back, the last input of every test sample is itself again."""
    s = folded(spark, d)
    z = P.fitted_scaler(s, "entity", "fold")
    scaled = s.join(z, ["entity", "fold"]).withColumn("scaled", (F.element_at("x", -1) - F.col("mu")) / F.col("sigma"))
    return scaled.select("entity", "sample", F.round(F.col("scaled") * F.col("sigma") + F.col("mu"), 4).alias("value"))


def _metrics(spark, d, how):
    p = P.forecasts(folded(spark, d).where("fold > 0"), "entity", how)
    return P.errors(p, ["entity", "h", "fold"]).withColumns(r6("rmse", "mae"))


def _metrics_sql(pred):
    keys = "CAST(entity AS VARCHAR) AS entity, CAST(h AS VARCHAR) AS h, CAST(fold AS VARCHAR) AS fold"
    return f"WITH {S}{FC.format(pred=pred)} SELECT {keys}, {ERR} FROM f WHERE fold > 0 GROUP BY GROUPING SETS ((), (entity), (h), (fold))"


@query(_metrics_sql(f"list_sum(x) / {W}"))
def mean_forecast_metrics(spark, d):
    return _metrics(spark, d, "mean")


@query(_metrics_sql(f"x[{W}]"))
def persistence_forecast_metrics(spark, d):
    return _metrics(spark, d, "last")


@query(f"WITH {S}{FC.format(pred=f'x[{W}]')}, g AS (SELECT fold, sqrt(avg((pred - actual) * (pred - actual))) AS rmse FROM f WHERE fold > 0 GROUP BY 1) SELECT round(avg(rmse), 6) AS mean_rmse, count(*) AS n_folds FROM g")
def cross_fold_mean(spark, d):
    p = P.forecasts(folded(spark, d).where("fold > 0"), "entity", "last")
    per = p.groupBy("fold").agg(F.sqrt(F.avg((F.col("pred") - F.col("actual")) ** 2)).alias("rmse"))
    return per.agg(F.round(F.avg("rmse"), 6).alias("mean_rmse"), F.count(F.lit(1)).alias("n_folds"))


@query(f"""WITH {S}{FC.format(pred=f'x[{W}]')} SELECT round(avg(exp(-0.1 * (h - 1)) * CASE WHEN abs(pred - actual) <= 1 THEN 0.5 * (pred - actual) * (pred - actual) ELSE abs(pred - actual) - 0.5 END), 6) AS loss FROM f""")
def horizon_huber(spark, d):
    p = P.forecasts(folded(spark, d), "entity", "last")
    return p.agg(F.round(F.avg(P.huber(F.col("pred"), F.col("actual"), F.col("h"), 0.1)), 6).alias("loss"))


CLASS = "CASE WHEN {v} < -20 THEN 0 WHEN {v} >= 40 THEN 31 ELSE CAST(floor(({v} + 20) / 2) AS BIGINT) + 1 END"


@query(f"SELECT CAST({CLASS.format(v='Tamax24')} AS BIGINT) AS class, count(*) AS n FROM datezilnicetemp_bucuresti WHERE Tamax24 IS NOT NULL AND NOT isnan(Tamax24) GROUP BY 1")
def class_histogram(spark, d):
    from brumar.common import table

    t = table(spark, d, "datezilnicetemp_bucuresti").where("Tamax24 is not null and not isnan(Tamax24)")
    return t.groupBy(P.class_of(F.col("Tamax24")).cast("bigint").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S}, v AS (SELECT fold, unnest(list_concat(x, y)) AS v FROM s) SELECT CAST(fold AS BIGINT) AS fold, CAST({CLASS.format(v='v')} AS BIGINT) AS class, count(*) AS n FROM v GROUP BY 1, 2""")
def fold_distribution(spark, d):
    v = folded(spark, d).select("fold", F.explode(F.concat("x", "y")).alias("v"))
    return v.groupBy("fold", P.class_of(F.col("v")).cast("bigint").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E_DAY}, s AS (SELECT entity, day, mean_value AS v FROM eday WHERE mean_value IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, count(v) OVER w3 AS c3, avg(v) OVER w3 AS a3, count(v) OVER w2 AS c2, avg(v) OVER w2 AS a2 FROM s WINDOW w3 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), w2 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT entity, day, round(CASE WHEN n >= 3 THEN CASE WHEN c3 = 3 THEN a3 END WHEN n = 2 THEN CASE WHEN c2 = 2 THEN a2 END ELSE v END, 6) AS moving_average FROM n""", dates=("day",))
def moving_average(spark, d):
    return P.moving_average(series(spark, d), "entity", "day", "mean_value").select("entity", "day", F.round("moving_average", 6).alias("moving_average"))


@query(f"""WITH {E_DAY}, i AS (SELECT entity, day, mean_value AS v, row_number() OVER (PARTITION BY entity ORDER BY day) - 1 AS i FROM eday WHERE mean_value IS NOT NULL), m AS (SELECT *, avg(CASE WHEN i < 10 AND i >= 3 THEN v END) OVER (PARTITION BY entity) AS m FROM i)
SELECT entity, day, round(CASE WHEN i < 10 THEN v ELSE m END, 6) AS value, i < 10 AS observed FROM m""", dates=("day",))
def known_days_splice(spark, d):
    return P.spliced(series(spark, d), "entity", "day", "mean_value", 10, 7).withColumns(r6("value"))


@query(f"WITH {E_DAY}, r AS (SELECT entity, day, mean_value, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS n FROM eday WHERE mean_value IS NOT NULL) SELECT entity, day, round(mean_value, 6) AS mean_value, n AS rank FROM r WHERE n <= 5", dates=("day",))
def last_days(spark, d):
    from brumar.operators.experiments import top_n

    return top_n(series(spark, d), ["entity"], [F.desc("day")], 5).withColumns(r6("mean_value"))


@query(f"""WITH {E_DAY}, z AS (SELECT entity, day, mean_value FROM eday), k AS (SELECT day FROM z GROUP BY 1 HAVING count(mean_value) = (SELECT count(DISTINCT entity) FROM z)) SELECT day FROM k""", dates=("day",))
def common_days(spark, d):
    """Days on which every series has a value."""
    z = Q.entity_day_mean(hourly(spark, d), "entity", "ts", "wind")
    n = z.agg(F.count_distinct("entity").alias("n_all"))
    return z.groupBy("day").agg(F.count("mean_value").alias("n")).join(F.broadcast(n)).where("n = n_all").select("day")


@query()
def linear_forecast(spark, d):
    """RMSE by step of a least-squares forecast on the window."""
    p = P.linear_direct(samples(spark, d), "entity")
    return p.groupBy("h").agg(F.round(F.sqrt(F.avg((F.col("pred") - F.col("actual")) ** 2)), 6).alias("rmse"), F.count(F.lit(1)).alias("n"))
