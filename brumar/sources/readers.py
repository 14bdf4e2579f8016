"""Readers with fixed schemas for the files of stations, reports and runs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The layouts of the station files.
SCHEMAS = {
    "daily_temp": "Denumire string, `Cod sinoptic` int, `Data masurarii` timestamp_ntz, Tamax24 double, Tamin24 double",
    "daily_precip": "Denumire string, `Data masurarii` timestamp_ntz, R24 double",
    "hourly": "Denumire string, `Data masurarii` timestamp_ntz, Rff1 double, Nop string, ww string, ix int",
    "registry": "cod_wmo_CODST int, regiune_CMR string, judet_JU string, nume_NUME string",
}


def one_match(folder: str, pattern: str) -> str:
    """The only file that matches; none or several are an error."""
    found = sorted(map(str, Path(folder).glob(pattern)))
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files in {folder} match {pattern}: {found[:5]}")
    return found[0]


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with header; unknown layouts are named in SCHEMAS, any other text is taken as a schema."""
    df = spark.read.schema(SCHEMAS.get(schema, schema)).csv(path, header=True)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def wide_matrix(spark: SparkSession, path: str, key: str = "date") -> DataFrame:
    """A wide CSV (one column a group) as long rows (key, group, value)."""
    df = spark.read.csv(path, header=True)
    groups = [c for c in df.columns if c != key]
    long = df.unpivot([key], groups, "grp", "value")
    return long.select(F.to_date(key).alias(key), "grp", F.col("value").try_cast("double").alias("value"))


def json_runs(spark: SparkSession, folder: str, schema: T.StructType | str, skip: str = "test_summary") -> DataFrame:
    """All JSON documents of a folder with the name of their file, without those whose name begins with ``skip``."""
    df = spark.read.schema(schema).json(folder, multiLine=True, pathGlobFilter="*.json")
    return df.withColumn("file", F.col("_metadata.file_name")).where(~F.startswith("file", F.lit(skip)))


def first_file_of_day(spark: SparkSession, root: str, suffix: str = "txt") -> DataFrame:
    """(day, path, text) of the first file by name below root/YYYY/MM/DD of each day."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{suffix}").withColumn("path", F.col("_metadata.file_path"))
    day = F.try_to_timestamp(F.regexp_extract("path", r"/(\d{4}/\d{2}/\d{2})/[^/]+$", 1), F.lit("yyyy/MM/dd"))
    return df.withColumn("day", F.to_date(day)).where("day is not null").groupBy("day").agg(F.min("path").alias("path"), F.min_by("value", "path").alias("text"))


def flattened(df: DataFrame, results: str, keep: list[str]) -> DataFrame:
    """One row for each entry of an array of structs; records without entries stay with nulls."""
    return df.select(*keep, F.explode_outer(results).alias("r")).select(*keep, "r.*")


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table stored at path, or what ``make()`` gives, stored there first, where nothing readable is stored."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if not any(k in str(e) for k in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER")):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def preview(df: DataFrame, column: str, rows: int = 5, values: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(some rows, the different values of a column in order), for a look at a file."""
    return df.limit(rows), df.select(column).distinct().orderBy(column).limit(values)
