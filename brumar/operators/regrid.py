"""Problem 6: irregular readings onto a regular hourly grid.

A reading holds from its time to the next reading of its source, ``hold_hours`` at most.
These validity intervals are cut at the cells of the grid (the hour before and after each
full hour, half each); a cell gets the time-weighted mean of what holds in it, and the part
of it that is covered.  All of it is built-in expressions; series are worked on in blocks of
days of a source, a block seeing the first readings of the next one.

Defined results: rows without source or time are left out; rows without a usable value
occupy their hour but hold nothing; copies of one (source, time) are averaged; a source
with a single row gives one cell; an empty table gives an empty grid; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brumar.common import HOUR_US, from_micros, micros, usable


def hourly_grid(df: DataFrame, entity: str, time: str, value: str, hold_hours: int = 3, block_days: int = 32) -> DataFrame:
    """(entity, ora, mean_value, coverage, n_rows, occupied, mark): every full hour from the first to the last occupied one.

    mark: 'read' where a row occupies the hour, 'filled' where none does but a reading still holds, else 'missing'.
    """
    half, width, hold = HOUR_US // 2, block_days * 24, hold_hours * HOUR_US
    rows = df.select(F.col(f"`{entity}`").alias("e"), micros(F.col(f"`{time}`")).alias("t"), usable(F.col(f"`{value}`")).alias("v")).where("e is not null and t is not null")
    once = rows.groupBy("e", "t").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    hour = lambda us: F.floor((us + half) / HOUR_US)
    once = once.withColumn("h", hour(F.col("t")))
    own = F.floor(F.col("h") / width)
    held = once.where("v is not null").withColumn("b", F.explode(F.sequence(F.floor(hour(F.col("t") - hold) / width), own))).withColumn("own", own == F.col("b"))
    w = Window.partitionBy("e", "b").orderBy("t")
    held = held.withColumn("until", F.least(F.coalesce(F.lead("t").over(w), F.col("t") + hold), F.col("t") + hold)).where("own")
    cells = held.withColumn("c", F.explode(F.sequence(F.col("h"), hour(F.col("until") - 1))))
    overlap = F.least(F.col("until"), F.col("c") * HOUR_US + half) - F.greatest(F.col("t"), F.col("c") * HOUR_US - half)
    cells = cells.select("e", F.col("c").alias("h"), (F.col("v") * overlap).alias("vo"), overlap.alias("o"), F.lit(0).cast("bigint").alias("n"))
    stats = cells.unionByName(once.select("e", "h", F.lit(0.0).alias("vo"), F.lit(0).cast("bigint").alias("o"), "n")).groupBy("e", "h").agg(F.sum("vo").alias("vo"), F.sum("o").alias("o"), F.sum("n").alias("n"))
    span = once.groupBy("e").agg(F.min("h").alias("h0"), F.max("h").alias("h1"))
    spine = (
        span.withColumn("b", F.explode(F.sequence(F.floor(F.col("h0") / width), F.floor(F.col("h1") / width))))
        .repartition("e", "b")
        .select("e", F.explode(F.sequence(F.greatest("h0", F.col("b") * width), F.least("h1", F.col("b") * width + width - 1))).alias("h"))
    )
    out = spine.join(stats, ["e", "h"], "left")
    n, o = F.coalesce("n", F.lit(0)), F.coalesce("o", F.lit(0))
    return out.select(
        F.col("e").alias("denumire"),
        F.substring(from_micros(F.col("h") * HOUR_US).cast("string"), 1, 16).alias("ora"),
        F.when(o > 0, F.col("vo") / o).alias("mean_value"),
        (o / HOUR_US).alias("coverage"),
        n.alias("n_rows"),
        (n > 0).alias("occupied"),
        F.when(n > 0, "read").when(o > 0, "filled").otherwise("missing").alias("mark"),
    )
