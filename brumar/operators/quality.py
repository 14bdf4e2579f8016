"""Preparation and audit of sensor tables: masking, gap filling, coverage, registry checks.

All operators take the names of the entity, time and value columns; rows whose entity or time is
null drop out where a result is by entity or time, as stated for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked(value: Column, sentinels: list[float]) -> Column:
    """value, or null where it is NaN or one of the sentinels."""
    v = value.cast("double")
    return F.when(F.isnan(v) | v.isin([float(s) for s in sentinels]), None).otherwise(v)


def number_of(text: Column, missing: list[float] = ()) -> Column:
    """The number written in a text; null for anything else and for the numbers in missing."""
    v = text.try_cast("double")
    v = F.when(F.isnan(v), None).otherwise(v)
    return F.when(v.isin([float(m) for m in missing]), None).otherwise(v) if missing else v


def mask_counts(df: DataFrame, entity: str, value: str, code: str, sentinels: list[float], obscured: float) -> DataFrame:
    """By entity: rows, readings masked, codes that are no number, codes that mean "obscured"."""
    v, c = F.col(value), F.col(code)
    return df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(v.isNotNull() & masked(v, sentinels).isNull()).alias("n_masked"),
        F.count_if(c.isNotNull() & number_of(c).isNull()).alias("n_coerced"),
        F.count_if(F.coalesce(number_of(c) == obscured, F.lit(False))).alias("n_obscured"),
    )


def entity_day_mean(df: DataFrame, entity: str, time: str, value: str, alias: str = "mean_value") -> DataFrame:
    """Mean of the values by entity and day, nulls left out; days on which all are null keep a null."""
    day = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).withColumn("day", F.to_date(time))
    return day.groupBy(entity, "day").agg(F.avg(value).alias(alias))


def neighbour_fill(df: DataFrame, entity: str, order: str, columns: list[str], n: int) -> DataFrame:
    """Null cells become the mean of the n rows before and after of the same entity; other cells never change.

    The window counts rows, not days.  The cell itself is in the window, but where it matters it is null and adds nothing.
    """
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(-n, n)
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in columns})


def fill_audit(df: DataFrame, entity: str, order: str, columns: list[str], n: int) -> DataFrame:
    """By column: cells missing before, filled, and missing still."""
    filled = neighbour_fill(df.withColumns({f"{c}__before": F.col(c) for c in columns}), entity, order, columns, n)
    agg = filled.agg(*[F.count_if(F.col(f"{c}__before").isNull()).alias(f"{c}_b") for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"{c}_a") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"{c}_b").alias("n_missing"), (F.col(f"{c}_b") - F.col(f"{c}_a")).alias("n_filled"), F.col(f"{c}_a").alias("n_still_missing")) for c in columns])
    return agg.select(F.inline(rows))


def month_audit(df: DataFrame, entity: str, time: str) -> DataFrame:
    """By entity and month that lies whole inside the range of the data: days without a reading, and whether that is all of them.

    The spine is entities x months x days, made of sequences; only entities and the range are aggregated before.
    """
    days = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).select(entity, F.to_date(time).alias("day")).distinct()
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    months = span.select("lo", "hi", F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))).alias("m0")).where("m0 >= lo and last_day(m0) <= hi")
    spine = days.select(entity).distinct().join(F.broadcast(months.select("m0")), how="cross").select(entity, "m0", F.explode(F.sequence("m0", F.last_day("m0"))).alias("day"))
    missing = spine.join(days, [entity, "day"], "left_anti")
    return missing.groupBy(entity, "m0").agg(F.count(F.lit(1)).alias("n_missing"), F.concat_ws(",", F.array_sort(F.collect_list(F.date_format("day", "dd")))).alias("days")).select(
        entity, F.date_format("m0", "yyyy-MM").alias("month"), "n_missing", (F.col("n_missing") == F.day(F.last_day("m0"))).alias("whole_month"), "days"
    )


def tick_coverage(df: DataFrame, entity: str, time: str, target: str, days: int, enough: float = 95.0) -> DataFrame:
    """By entity: share of the hourly ticks from 08:30 of ``days`` days before to 06:30 of the target that have a reading within the hour before.

    Every entity of the table is reported, those without any reading in the window with 0.
    """
    lo = F.expr(f"timestamp_ntz'{target} 08:30:00' - interval {days} days")
    hi = F.expr(f"timestamp_ntz'{target} 06:30:00'")
    known = df.where(F.col(entity).isNotNull())
    ticks = known.select(entity).distinct().select(entity, F.explode(F.sequence(lo, hi, F.expr("interval 1 hour"))).alias("tick"))
    # readings are brought to the tick at or after them
    t = F.col(time)
    tick = F.date_trunc("hour", t - F.expr("interval 30 minutes 1 microsecond")) + F.expr("interval 1 hour 30 minutes")
    seen = known.where(t.isNotNull() & (t > lo - F.expr("interval 1 hour")) & (t <= hi)).select(entity, tick.cast("timestamp_ntz").alias("tick")).distinct().withColumn("hit", F.lit(1))
    got = ticks.join(seen, [entity, "tick"], "left").groupBy(entity).agg(F.count(F.lit(1)).alias("n_expected"), F.count("hit").alias("n_found"))
    pct = F.round(F.col("n_found") * 100.0 / F.col("n_expected"), 4)
    return got.select(entity, "n_expected", "n_found", (F.col("n_expected") - F.col("n_found")).alias("n_missing"), pct.alias("pct"), (pct >= enough).alias("sufficient"))


def registry_match(stations: DataFrame, registry: DataFrame, left: str, right: str) -> DataFrame:
    """(name, side): stations that the registry has ('both'), lacks ('data_only'), and registered ones without data ('registry_only')."""
    a = stations.select(F.col(left).alias("name")).where("name is not null").distinct()
    b = registry.select(F.col(right).alias("name")).where("name is not null").distinct()
    tag = lambda df, side: df.select("name", F.lit(side).alias("side"))
    return tag(a.join(b, "name", "left_semi"), "both").unionByName(tag(a.join(b, "name", "left_anti"), "data_only")).unionByName(tag(b.join(a, "name", "left_anti"), "registry_only"))


def set_consistency(sets: dict[str, DataFrame]) -> DataFrame:
    """sets: name -> one-column frame.  (member, n_sets, missing_from) of members that not every set has."""
    tagged = None
    for name, df in sets.items():
        one = df.select(F.col(df.columns[0]).alias("member")).where("member is not null").distinct().select("member", F.lit(name).alias("s"))
        tagged = one if tagged is None else tagged.unionByName(one)
    every = F.array(*[F.lit(n) for n in sorted(sets)])
    got = tagged.groupBy("member").agg(F.collect_set("s").alias("have"))
    return got.where(F.size("have") < len(sets)).select("member", F.size("have").cast("bigint").alias("n_sets"), F.array_join(F.array_except(every, "have"), ",").alias("missing_from"))


def clean_cell(text: Column) -> Column:
    """The trimmed text; null where it is blank or one of the words that stand for nothing."""
    t = F.trim(text)
    return F.when(~t.isin("", "nan", "None", "NaN"), t)


def without_empty(df: DataFrame) -> DataFrame:
    """Text cells cleaned; rows and columns that are null throughout are left out.  One pass finds the columns."""
    clean = df.select(*[clean_cell(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    some = clean.agg(*[F.bool_or(F.col(f"`{c}`").isNotNull()).alias(c) for c in clean.columns]).first()
    kept = [c for c in clean.columns if some[c]]
    return clean.select(*[F.col(f"`{c}`") for c in kept]).na.drop("all") if kept else clean.limit(0)
