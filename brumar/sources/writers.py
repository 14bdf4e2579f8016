"""Writers: wide matrices, partitions that are replaced as a whole, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_csv(df: DataFrame, path: str, key: str, column: str, groups: list[str], value: str) -> None:
    """Long rows as one CSV with a column for each group, in order of the key."""
    wide = df.groupBy(key).pivot(column, sorted(groups)).agg(F.first(value)).orderBy(key)
    wide.coalesce(1).write.mode("overwrite").csv(path, header=True)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that df holds are replaced; a failed job leaves the old ones."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key is not stored yet; gives the number of rows that were new."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # nothing stored so far
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    new = (df if done is None else df.join(done, key, "left_anti")).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
    finally:
        new.unpersist()
    return n


def audit_json(df: DataFrame, path: str) -> None:
    """A small audit frame as JSON lines beside the data."""
    df.coalesce(1).write.mode("overwrite").json(path)


def subset_csv(df: DataFrame, path: str, column: str, wanted: list) -> None:
    """The rows with a wanted value as CSV, in as many files as there are partitions."""
    df.where(F.col(column).isin(wanted)).write.mode("overwrite").csv(path, header=True)


def summary_csvs(tables: dict[str, DataFrame], folder: str) -> None:
    """Small result tables, each as one CSV folder under its name."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def dataset_json(df: DataFrame, folder: str, by: str) -> None:
    """Records as JSON lines, and beside them a summary of their number by ``by``."""
    df.write.mode("overwrite").json(f"{folder}/records")
    df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def prompt_files(df: DataFrame, folder: str, key: str, text: str) -> None:
    """One text file a key, under folder/key=...; keys must be unique."""
    df.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def append_tripped(df: DataFrame, path: str, tokens: str, limit: int) -> int:
    """Appends the records over a limit of tokens to a log; without any, nothing is written."""
    over = df.where(F.col(tokens) >= limit)
    n = over.count()
    if n:
        over.write.mode("append").json(path)
    return n
