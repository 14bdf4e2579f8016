"""Readers, writers and streams."""

from datetime import date, datetime, timedelta

import pytest

from brumar.sources import readers, writers
from brumar.streaming import readings


def test_one_match(tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.one_match(str(tmp_path), "a*.csv")
    (tmp_path / "a1.csv").write_text("x")
    assert readers.one_match(str(tmp_path), "a*.csv").endswith("a1.csv")
    (tmp_path / "a2.csv").write_text("x")
    with pytest.raises(FileNotFoundError):
        readers.one_match(str(tmp_path), "a*.csv")


def test_csv_and_wide_matrix(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Denumire,Cod sinoptic,Data masurarii,Tamax24,Tamin24\nA,1,2024-01-01 00:00:00,3.5,-1\n")
    assert readers.csv(spark, str(tmp_path / "t.csv"), "daily_temp", ["Denumire", "Tamax24"]).collect() == [("A", 3.5)]
    long = spark.createDataFrame([(date(2024, 1, 1), "x", 1.0), (date(2024, 1, 2), "y", 2.0)], "date date, grp string, value double")
    writers.wide_csv(long, str(tmp_path / "wide"), "date", "grp", ["x", "y"], "value")
    back = readers.wide_matrix(spark, str(tmp_path / "wide")).where("value is not null")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_json_runs_and_documents(spark, tmp_path):
    (tmp_path / "r1.json").write_text('{"model": "m",\n "results": [{"fold": 1}, {"fold": 2}]}')
    (tmp_path / "r2.json").write_text('{"model": "n", "results": []}')
    (tmp_path / "test_summary.json").write_text('{"model": "s"}')
    df = readers.json_runs(spark, str(tmp_path), "model string, results array<struct<fold:int>>")
    assert sorted(readers.flattened(df, "results", ["model"]).collect(), key=str) == [("m", 1), ("m", 2), ("n", None)]
    d = tmp_path / "docs/2024/01/05"
    d.mkdir(parents=True)
    (d / "b.txt").write_text("second")
    (d / "a.txt").write_text("first")
    got = readers.first_file_of_day(spark, str(tmp_path / "docs")).collect()
    assert [(r["day"], r["text"]) for r in got] == [(date(2024, 1, 5), "first")]


def test_resume_and_replace(spark, tmp_path):
    df = spark.range(5)
    assert writers.append_new(df, str(tmp_path / "s"), "id") == 5
    assert writers.append_new(spark.range(7), str(tmp_path / "s"), "id") == 2
    assert spark.read.parquet(str(tmp_path / "s")).count() == 7
    p = str(tmp_path / "p")
    writers.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), p, ["k"])
    writers.replace_partitions(spark.createDataFrame([(3, "b")], "v int, k string"), p, ["k"])
    assert sorted((r["v"], r["k"]) for r in spark.read.parquet(p).collect()) == [(1, "a"), (3, "b")]


def test_streams(spark, tmp_path):
    rows = [("A", datetime(2024, 1, 1, 0, 5) + timedelta(minutes=20 * i), 2.5 if i >= 3 else float(i)) for i in range(14)] + [("A", None, 1.0), ("B", datetime(2024, 1, 1), -999.0)]
    schema = "Denumire string, `Data masurarii` timestamp, Rff1 double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = readings.hourly_means(stream(), "Denumire", "Data masurarii", "Rff1").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["hour"].hour: (r["mean_value"], r["n"]) for r in spark.table("hours").collect()}
    assert got[0] == (1.0, 3) and got[1] == (2.5, 3) and len(got) == 5
    q = readings.stuck_runs(stream(), "Denumire", "Data masurarii", "Rff1").writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["length"] for r in spark.table("runs").collect()) == [8, 9, 10, 11]


def test_cached_tables_and_logs(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, "a", 10), (2, "b", 99)], "k int, g string, tokens int")

    path = str(tmp_path / "cache")
    assert readers.cached(spark, path, make).count() == 2 and readers.cached(spark, path, make).count() == 2 and len(made) == 1
    df = make()
    rows, values = readers.preview(df, "g", 1)
    assert rows.count() == 1 and [r["g"] for r in values.collect()] == ["a", "b"]
    writers.subset_csv(df, str(tmp_path / "subset"), "g", ["b"])
    assert spark.read.csv(str(tmp_path / "subset"), header=True).count() == 1
    writers.summary_csvs({"one": df, "two": df.limit(1)}, str(tmp_path / "tables"))
    assert spark.read.csv(str(tmp_path / "tables/two"), header=True).count() == 1
    writers.dataset_json(df, str(tmp_path / "data"), "g")
    assert spark.read.json(str(tmp_path / "data/summary")).count() == 2
    writers.prompt_files(df, str(tmp_path / "prompts"), "k", "g")
    assert {(r["k"], r["value"]) for r in spark.read.text(str(tmp_path / "prompts")).collect()} == {(1, "a"), (2, "b")}
    log = str(tmp_path / "log")
    assert writers.append_tripped(df, log, "tokens", 100) == 0 and not (tmp_path / "log").exists()
    assert writers.append_tripped(df, log, "tokens", 50) == 1 == writers.append_tripped(df, log, "tokens", 50) and spark.read.json(log).count() == 2
