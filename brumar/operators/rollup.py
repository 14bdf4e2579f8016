"""From entities to groups, parents and all: means with a cascading fallback, macro averages, extremes, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brumar.common import with_each


def station_dim(registry: DataFrame, name: str, group: str, parent: str) -> DataFrame:
    """One row per name: (entity, grp, parent); of several rows the largest non-null values."""
    return registry.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("entity")).agg(F.max(group).alias("grp"), F.max(parent).alias("parent"))


def group_day_fallback(days: DataFrame, dim: DataFrame, value: str = "mean_value") -> DataFrame:
    """(day, grp, parent, value, source) for every day x group: the group's mean, else its parent's, else that of all.

    One pass makes the three means (grouping sets over the entity rows, not means of means); the spine is taken from
    rows with a value.  The dimension is joined as it is: AQE broadcasts it while it is small.
    """
    rows = days.join(dim, "entity").where(F.col(value).isNotNull() & F.col("grp").isNotNull() & F.col("parent").isNotNull())
    sets = rows.groupingSets([["day", "grp", "parent"], ["day", "parent"], ["day"]], "day", "grp", "parent").agg(F.avg(value).alias("v"))
    pairs = rows.select("grp", "parent").distinct()
    spine = with_each(rows.select("day").distinct(), pairs)  # days x groups is the result's own size
    g = sets.where("grp is not null").select("day", "grp", "parent", F.col("v").alias("gv"))
    p = sets.where(F.col("grp").isNull() & F.col("parent").isNotNull()).select("day", "parent", F.col("v").alias("pv"))
    a = sets.where(F.col("grp").isNull() & F.col("parent").isNull()).select("day", F.col("v").alias("av"))
    joined = spine.join(g, ["day", "grp", "parent"], "left").join(p, ["day", "parent"], "left").join(a, "day", "left")
    return joined.select("day", "grp", "parent", F.coalesce("gv", "pv", "av").alias("value"), F.when(F.col("gv").isNotNull(), "group").when(F.col("pv").isNotNull(), "parent").otherwise("all").alias("source"))


def entity_month_mean(days: DataFrame, low: str, high: str) -> DataFrame:
    """By entity and month, over days on which both extremes are known: means of low, high and their middle, and the days used."""
    ok = days.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    return ok.groupBy("entity", F.date_format("day", "yyyy-MM").alias("month")).agg(F.avg(low).alias("mean_low"), F.avg(high).alias("mean_high"), F.avg((F.col(low) + F.col(high)) / 2).alias("mean_mid"), F.count(F.lit(1)).alias("days_used"))


def group_macro(means: DataFrame, dim: DataFrame) -> DataFrame:
    """By group and month: mean of the entity means, entities expected, with data and without."""
    months = means.select("month").distinct()
    expected = with_each(dim.where("grp is not null"), months)
    j = expected.join(means, ["entity", "month"], "left")
    return j.groupBy("grp", "month").agg(F.avg("mean_mid").alias("mean_mid"), F.count(F.lit(1)).alias("n_expected"), F.count("mean_mid").alias("n_aggregated"), F.concat_ws("|", F.array_sort(F.collect_list(F.when(F.col("mean_mid").isNull(), F.col("entity"))))).alias("missing"))


def extremes(df: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """By ``by``: the names of the largest and smallest value; ties go to the first name."""
    ok = df.where(F.col(value).isNotNull())
    top = F.min_by(name, F.struct(-F.col(value), F.col(name)))
    return ok.groupBy(by).agg(top.alias("largest"), F.max(value).alias("largest_value"), F.min_by(name, F.struct(F.col(value), F.col(name))).alias("smallest"), F.min(value).alias("smallest_value"))


def ranked_values(df: DataFrame, by: list[str], value: str, first: str, k: int) -> DataFrame:
    """The k most frequent values by group, rank 1 first; ties go to the value met first in the order of ``first``."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first_seen"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first_seen")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first_seen")


def frequency_share(df: DataFrame, by: str, value: str, none: str) -> DataFrame:
    """Counts and percentage of the non-null values; ``none`` counts in the denominator but is not listed."""
    ok = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    pct = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(by)), 6)
    return ok.withColumn("pct", pct).where(F.col(value) != none).withColumn("repeated", F.col("n") > 1)


def first_row(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def decoded(df: DataFrame, code: Column, ix: Column, table_a: DataFrame, table_b: DataFrame, none: str = "*") -> DataFrame:
    """Adds ``meaning``: ``none`` for a null code or '//'; by ix 1-3 the text of table A, 4-7 of table B; else a remark.

    The code tables hold (code, text); of several texts of one code the first by alphabet counts.
    """
    c = F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)
    a = table_a.groupBy(F.col("code").alias("__a")).agg(F.min("text").alias("__ta"))
    b = table_b.groupBy(F.col("code").alias("__b")).agg(F.min("text").alias("__tb"))
    j = df.withColumn("__c", c).withColumn("__ix", ix).join(a, F.col("__c") == F.col("__a"), "left").join(b, F.col("__c") == F.col("__b"), "left")
    unknown = F.concat(F.lit("unknown code "), F.col("__c"))
    meaning = F.when(code.isNull() | (code == "//"), none).when(F.col("__ix").between(1, 3), F.coalesce("__ta", unknown)).when(F.col("__ix").between(4, 7), F.coalesce("__tb", unknown)).otherwise("ix invalid")
    return j.withColumn("meaning", meaning).drop("__c", "__ix", "__a", "__b", "__ta", "__tb")
