"""Small helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes that stand for "no value" in the text columns of the readings (after trim and lower case).
NO_VALUE_CODES = ["", "-", "--", "/", "//", "///", "n/a", "na", "nan", "null", "none"]
# Codes that stand for "no value" in the numeric columns.
NO_VALUE_NUMBERS = [-999.0, -9999.0, -99999.0, -999.9, -9999.9]

# White space and separators.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usable(value: Column) -> Column:
    """The number, or null where it is null, NaN or a no-value code."""
    v = value.cast("double")
    return F.when(F.isnan(v) | v.isin(NO_VALUE_NUMBERS), None).otherwise(v)


def usable_text(value: Column) -> Column:
    """The trimmed text, or null where it is null, blank or a no-value code."""
    t = F.btrim(value, F.lit(SPACES))
    return F.when(F.lower(t).isin(NO_VALUE_CODES), None).otherwise(t)


EPOCH = "timestamp_ntz'1970-01-01'"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the clock that the timestamp shows; one without a zone never meets the session's zone.

    In a session in UTC, where every such clock time exists once, the plain count is the same and cheaper.
    """
    session = SparkSession.getActiveSession()
    if session and session.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC"):
        return F.unix_micros(ts.cast("timestamp"))
    return ((ts.cast("timestamp_ntz") - F.expr(EPOCH)).cast("decimal(20,6)") * 1_000_000).cast("bigint")


def from_micros(us: Column) -> Column:
    """The timestamp without zone of a count of microseconds; the inverse of ``micros``."""
    minute = F.floor(us / 60_000_000).cast("int")
    second = (F.pmod(us, F.lit(60_000_000)) / 1_000_000).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), minute, second)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Enough partitions for Python stages: a table of few files is hashed by its unique keys; one of many is left as it is."""
    want = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, *[F.col(k) for k in keys])


#: rows of a table of one row a source or hour up to which it is sent to every executor
SMALL = 200_000


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = SMALL) -> DataFrame:
    """A join with a table that is nearly always small: sent to every executor if counting shows that it is, else shuffled.

    ``small`` is kept, as it is worked out for the count.  Sent out, it spares the shuffle of ``big``, in which a key that
    holds a third of all rows would go to one task.
    """
    small = small.persist()
    n = small.limit(most + 1).count()
    return big.join(F.broadcast(small) if n <= most else small, on, how)


def with_each(big: DataFrame, small: DataFrame, most: int = SMALL) -> DataFrame:
    """Every row with every row of a small table, for spines whose size is that of the result; sent out only if counting shows that it is small."""
    small = small.persist()
    n = small.limit(most + 1).count()
    return big.join(F.broadcast(small) if n <= most else small, how="cross")
