"""Assembly and validation of training and evaluation records, calendars, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ["system", "user", "assistant"]


def chat(system: Column, user: Column, assistant: Column) -> Column:
    """The messages of a record; absent parts are left out."""
    one = lambda role, c: F.when(c.isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.array_compact(F.array(one("system", system), one("user", user), one("assistant", assistant)))


def message_errors(df: DataFrame, row_id: str, messages: str) -> DataFrame:
    """(row id, position, error) of records whose messages are missing or malformed; the position of a whole record is -1."""
    m = F.col(messages)
    whole = df.where(m.isNull() | (F.size(m) == 0)).select(row_id, F.lit(-1).alias("position"), F.lit("no messages").alias("error"))
    each = df.select(row_id, F.posexplode(messages).alias("position", "m"))
    error = F.when(F.col("m.role").isNull(), "no role").when(~F.col("m.role").isin(ROLES), "unknown role").when(F.col("m.content").isNull(), "no content").when(F.trim("m.content") == "", "empty content")
    return whole.unionByName(each.select(row_id, "position", error.alias("error")).where("error is not null"))


def required(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(row id, field) for every required field that is null or blank."""
    bad = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields]))
    return df.select(row_id, F.explode(bad).alias("field"))


def any_date(text: Column) -> Column:
    """The day of '2024-01-31', '2024/01/31' or '31.01.2024'; null for anything else."""
    forms = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy")]
    return F.to_date(F.coalesce(*forms))


def calendar(spark, year: int) -> DataFrame:
    """(day, split): days 1 to 25 of each month train, the 30th of every odd month tests."""
    days = spark.sql(f"select explode(sequence(date'{year}-01-01', date'{year}-12-31', interval 1 day)) as day")
    split = F.when(F.day("day") <= 25, "train").when((F.day("day") == 30) & (F.month("day") % 2 == 1), "test")
    return days.withColumn("split", split).where("split is not null")


def analysis_dates(spark, start: str, end: str, past_days: int) -> DataFrame:
    """Every (past_days + 1)-th day from start + past_days to end; just the day itself if start and end are the same."""
    if start == end:
        return spark.sql(f"select date'{start}' as day")
    return spark.sql(f"select explode(sequence(date_add(date'{start}', {past_days}), date'{end}', interval {past_days + 1} days)) as day where date_add(date'{start}', {past_days}) <= date'{end}'")
