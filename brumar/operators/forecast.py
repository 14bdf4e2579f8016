"""Windows, folds, scaling and closed-form forecasts on long (series, day, value) frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def indexed(days: DataFrame, series: str, day: str) -> DataFrame:
    """Adds i, the 0-based place of each row in its series."""
    return days.withColumn("i", (F.row_number().over(Window.partitionBy(series).orderBy(day)) - 1).cast("bigint"))


def sliding(days: DataFrame, series: str, day: str, value: str, window: int, horizon: int) -> DataFrame:
    """(series, sample, anchor, x, y): every stretch of window input days and horizon target days; the anchor is the last input day."""
    o = Window.partitionBy(series).orderBy(day)
    x = F.collect_list(value).over(o.rowsBetween(1 - window, 0))
    y = F.collect_list(value).over(o.rowsBetween(1, horizon))
    got = days.where(F.col(value).isNotNull()).withColumn("x", x).withColumn("y", y).where((F.size("x") == window) & (F.size("y") == horizon))
    return got.select(series, (F.row_number().over(o) - 1).cast("bigint").alias("sample"), F.col(day).alias("anchor"), "x", "y")


def fold_of(sample: Column, n: Column, folds: int) -> Column:
    """The fold whose test part holds a sample, 0 for those before the first: edges are floor(i n / (folds + 1))."""
    out = F.lit(0)
    for i in range(1, folds + 1):
        out = F.when(sample >= F.floor(F.lit(i) * n / (folds + 1)), F.lit(i)).otherwise(out)
    return out


def fold_edges(spark, n: int, folds: int) -> DataFrame:
    """(fold, train_to, test_from, test_to) of the walk-forward folds of n samples."""
    edge = lambda i: F.floor(i * F.lit(n) / (folds + 1)).cast("bigint")
    return spark.range(1, folds + 1).select(F.col("id").alias("fold"), edge(F.col("id")).alias("train_to"), edge(F.col("id")).alias("test_from"), edge(F.col("id") + 1).alias("test_to"))


def transformed(value: Column, variable: Column) -> Column:
    """Rain goes through log1p of its non-negative part, everything else stays."""
    return F.when(variable.startswith("precip") & value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0)))).otherwise(value)


def fitted_scaler(samples: DataFrame, series: str, fold: str) -> DataFrame:
    """(series, fold, mu, sigma): over the inputs of the training samples of each fold; a day counts once per window that holds it.

    Fold f trains on every sample of an earlier fold.
    """
    per = samples.select(series, F.col(fold).alias("f0"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("q"), F.size("x").alias("n"))
    sums = per.groupBy(series, "f0").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    w = Window.partitionBy(series).orderBy("f0").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.select(series, (F.col("f0") + 1).alias(fold), F.sum("s").over(w).alias("s"), F.sum("q").over(w).alias("q"), F.sum("n").over(w).alias("n"))
    mu = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") / F.col("n") - mu * mu, F.lit(0.0))
    return run.select(series, fold, mu.alias("mu"), F.greatest(F.sqrt(var), F.lit(1e-6)).alias("sigma"))


def forecasts(samples: DataFrame, series: str, how: str) -> DataFrame:
    """(series, sample, h, pred, actual): the window mean ('mean') or the last input value ('last') for every step of the horizon."""
    pred = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x") if how == "mean" else F.element_at("x", -1)
    keep = [c for c in samples.columns if c not in ("x", "y")]
    return samples.select(*keep, pred.alias("pred"), F.posexplode("y").alias("h", "actual")).withColumn("h", (F.col("h") + 1).cast("bigint"))


def errors(pred: DataFrame, by: list[str]) -> DataFrame:
    """RMSE and MAE by each of the columns in ``by`` (one pass of grouping sets) and over all; the row over all is there for an empty frame too."""
    e = F.col("pred") - F.col("actual")
    keyed = pred.select(*[F.col(c).cast("string").alias(c) for c in by], (e * e).alias("sq"), F.abs(e).alias("ab"))
    measures = [F.sqrt(F.avg("sq")).alias("rmse"), F.avg("ab").alias("mae"), F.count(F.lit(1)).alias("n")]
    whole = keyed.agg(*measures).select(*[F.lit(None).cast("string").alias(c) for c in by], "rmse", "mae", "n")
    return keyed.groupingSets([[c] for c in by], *by).agg(*measures).unionByName(whole)


def class_of(value: Column) -> Column:
    """0..31: below -20, thirty bins of two degrees, 40 and above."""
    return F.when(value < -20, 0).when(value >= 40, 31).otherwise(F.floor((value + 20) / 2).cast("int") + 1)


def moving_average(df: DataFrame, by: str, order: str, value: str, span: int = 3) -> DataFrame:
    """Centred mean over min(span, rows) rows, null where the window is not full."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    o = Window.partitionBy(by).orderBy(order)
    out = F.lit(None).cast("double")
    for k in range(span, 0, -1):
        w = o.rowsBetween(-(k // 2), (k - 1) // 2)
        out = F.when(F.least(n, F.lit(span)) == k, F.when(F.count(value).over(w) == k, F.avg(value).over(w))).otherwise(out)
    return df.withColumn("moving_average", out)


def spliced(actual: DataFrame, series: str, day: str, value: str, known: int, window: int) -> DataFrame:
    """By series: the first ``known`` days as observed, the rest carried on with the mean of the last ``window`` known ones."""
    ix = indexed(actual, series, day)
    w = Window.partitionBy(series)
    mean = F.avg(F.when((F.col("i") < known) & (F.col("i") >= known - window), F.col(value))).over(w)
    return ix.select(series, F.col(day).alias("day"), F.when(F.col("i") < known, F.col(value)).otherwise(mean).alias("value"), (F.col("i") < known).alias("observed"))


def huber(pred: Column, actual: Column, h: Column, decay: float, delta: float = 1.0) -> Column:
    """Huber loss with weight exp(-decay (h - 1))."""
    e = F.abs(pred - actual)
    return F.exp(-decay * (h - 1)) * F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def linear_direct(samples: DataFrame, series: str, ridge: float = 1e-3) -> DataFrame:
    """(series, sample, h, pred, actual): least squares of every target step on the input window, one fit a series.

    Normal equations need window squared numbers a series; they are added up by grouped aggregation of the outer
    products, so only these sums, never the samples, are brought together.
    """
    first = samples.select(F.size("x").alias("w"), F.size("y").alias("h")).first()
    if first is None:
        return samples.select(series, "sample", F.lit(1).alias("h"), F.lit(0.0).alias("pred"), F.lit(0.0).alias("actual"))
    w, h = first["w"] + 1, first["h"]

    def outer(batches):
        for pdf in batches:
            sums: dict = {}
            for key, g in pdf.groupby(series):
                a = np.column_stack([np.stack(g["x"].to_list()), np.ones(len(g))])
                y = np.stack(g["y"].to_list())
                sums[key] = np.concatenate([(a.T @ a).ravel(), (a.T @ y).ravel()])
            for key, v in sums.items():
                yield pd.DataFrame({series: key, "k": np.arange(len(v)), "v": v})

    sums = samples.select(series, "x", "y").mapInPandas(outer, f"{series} string, k int, v double").groupBy(series, "k").agg(F.sum("v").alias("v"))
    packed = sums.groupBy(series).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("s"))

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            v = np.asarray(v)
            out.append(np.linalg.solve(v[: w * w].reshape(w, w) + ridge * np.eye(w), v[w * w :].reshape(w, h)).ravel().tolist())
        return pd.Series(out)

    beta = packed.select(series, solve("s").alias("b"))
    j = samples.join(beta, series).select(series, "sample", "x", "b", F.posexplode("y").alias("h0", "actual"))
    dot = F.aggregate(F.sequence(F.lit(0), F.lit(w - 2)), F.element_at("b", (w - 1) * h + F.col("h0") + 1), lambda acc, i: acc + F.element_at("x", i + 1) * F.element_at("b", i * h + F.col("h0") + 1))
    return j.select(series, "sample", (F.col("h0") + 1).alias("h"), dot.alias("pred"), "actual")


def rolled_out(samples: DataFrame, series: str, steps: int) -> DataFrame:
    """(series, sample, step, pred): the window mean fed back into the window, ``steps`` times."""
    n = F.size("x")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("x"), lambda a, _: F.concat(a, F.array(total(F.slice(a, -n, n)) / n)))
    return samples.select(series, "sample", F.posexplode(F.slice(grown, n + 1, F.lit(steps))).alias("step", "pred")).withColumn("step", (F.col("step") + 1).cast("bigint"))
