"""Analytics over long experiment results: replicate-aware cubes, summaries, rankings, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cube(df: DataFrame, by: list[str], value: str, places: int = 4) -> DataFrame:
    """Mean, sample deviation and count by cell, rounded half to even; a single value has no deviation."""
    return df.groupBy(*by).agg(F.bround(F.avg(value), places).alias("mean"), F.bround(F.stddev_samp(value), places).alias("std"), F.count(value).alias("n"))


def has_replicates(df: DataFrame, by: list[str]) -> DataFrame:
    """One row: whether any cell holds more than one run."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("replicates"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def described(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, std, min, exact quartiles and max by group."""
    q = lambda p: F.percentile(value, p)
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max(value).alias("max"))


def high_variance(df: DataFrame, by: list[str], value: str, over: float) -> DataFrame:
    """Cells with more than one run and a deviation above ``over``."""
    return df.groupBy(*by).agg(F.stddev_samp(value).alias("std"), F.count(value).alias("n")).where((F.col("n") > 1) & (F.col("std") > over))


def average_ranks(df: DataFrame, by: str, value: str, to: str) -> DataFrame:
    """(by, value, to): the rank of every different value, ties sharing the average; values are counted before they are ordered."""
    n = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return n.select(by, value, (upto - (F.col("__n") - 1) / 2).alias(to))


def spearman(df: DataFrame, by: str, a: str, b: str, least: int = 3) -> DataFrame:
    """Rank correlation by group, null under ``least`` pairs or where one side has a single value.

    Pairs and values are counted first, so that what is ordered in one task is the different values of a group only.
    """
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = ok.groupBy(by, a, b).agg(F.count(F.lit(1)).alias("__c"))
    r = pairs.join(average_ranks(ok, by, a, "__x"), [by, a]).join(average_ranks(ok, by, b, "__y"), [by, b])
    c, x, y = F.col("__c"), F.col("__x"), F.col("__y")
    s = r.groupBy(by).agg(F.sum(c).alias("n"), *[F.sum(c * e).alias(k) for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])
    n = F.col("n")
    spread = F.sqrt((n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2))
    return s.select(by, "n", F.when((n >= least) & (spread > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).alias("rho"))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def pivoted(df: DataFrame, rows: str, columns: str, values: list, value: str) -> DataFrame:
    """Mean by row and column; the list of columns is given, so no extra job looks for them."""
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(value))


def token_audit(df: DataFrame, by: str, tokens: str, context: int, near: float = 0.8) -> DataFrame:
    """Least, most and whole-number mean of the tokens by group, and how near they come to the context."""
    got = df.groupBy(by).agg(F.count(tokens).alias("n"), F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.expr(f"sum(`{tokens}`) div count(`{tokens}`)").alias("mean"))
    return got.withColumn("status", F.when(F.col("most") >= context, "TRUNCATED").when(F.col("most") >= near * context, "near limit").otherwise("ok"))


def truncation_flag(reason: Column, fill: Column, served_locally: Column, limit: float = 0.95) -> Column:
    """Whether an answer was cut: by the stated reason, or, for local servers only, by how full the context is."""
    return F.when(reason.isin("length", "max_output_tokens"), "cut").when(served_locally & (fill >= limit), "full").otherwise("ok")
