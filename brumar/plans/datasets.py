"""Queries on record assembly, validation, calendars and coverage of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from brumar.common import table
from brumar.operators import assembly as A
from brumar.plans.registry import query

DATE = "coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%Y/%m/%d'), try_strptime({c}, '%d.%m.%Y'))"
REPORTS = f"r AS (SELECT diag_id, CAST({DATE.format(c='date')} AS DATE) AS day, original_diagnosis, formatted_diagnosis, processing_timestamp FROM formatted_diagnoses)"


def reports(spark, d):
    t = table(spark, d, "formatted_diagnoses")
    return t.select("diag_id", A.any_date(F.col("date")).alias("day"), "original_diagnosis", "formatted_diagnosis", "processing_timestamp")


@query("""SELECT test_id, CAST(len(list_filter([system_prompt, user_prompt, reference_diagnosis], lambda x: x IS NOT NULL)) AS BIGINT) AS n_messages, concat_ws('|', CASE WHEN system_prompt IS NOT NULL THEN 'system' END, CASE WHEN user_prompt IS NOT NULL THEN 'user' END, CASE WHEN reference_diagnosis IS NOT NULL THEN 'assistant' END) AS roles, CAST(length(concat_ws('', system_prompt, user_prompt, reference_diagnosis)) AS BIGINT) AS n_chars FROM test_data_zero_shot""")
def chat_assembly(spark, d):
    t = table(spark, d, "test_data_zero_shot").withColumn("m", A.chat(F.col("system_prompt"), F.col("user_prompt"), F.col("reference_diagnosis")))
    return t.select("test_id", F.size("m").alias("n_messages"), F.array_join("m.role", "|").alias("roles"), F.length(F.array_join("m.content", "")).alias("n_chars"))


@query("""WITH e AS (SELECT train_id, i - 1 AS position, messages[i] AS m FROM train_data, unnest(generate_series(1, len(messages))) AS t(i)), x AS (SELECT train_id, position, CASE WHEN m.role IS NULL THEN 'no role' WHEN m.role NOT IN ('system', 'user', 'assistant') THEN 'unknown role' WHEN m.content IS NULL THEN 'no content' WHEN trim(m.content) = '' THEN 'empty content' END AS error FROM e)
SELECT train_id, -1 AS position, 'no messages' AS error FROM train_data WHERE messages IS NULL OR len(messages) = 0 UNION ALL SELECT train_id, position, error FROM x WHERE error IS NOT NULL""".replace("-1 AS position", "CAST(-1 AS BIGINT) AS position"))
def message_validation(spark, d):
    return A.message_errors(table(spark, d, "train_data"), "train_id", "messages")


@query("""WITH u AS (SELECT test_id, unnest(['date', 'approach', 'split', 'sursa', 'user_prompt', 'reference_diagnosis']) AS field, unnest([date, approach, split, sursa, user_prompt, reference_diagnosis]) AS v FROM test_data_zero_shot) SELECT test_id, field FROM u WHERE v IS NULL OR trim(v) = ''""")
def required_fields(spark, d):
    return A.required(table(spark, d, "test_data_zero_shot"), "test_id", ["date", "approach", "split", "sursa", "user_prompt", "reference_diagnosis"])


@query("""SELECT diag_id, coalesce(nullif(concat_ws(' ', formatted_diagnosis.PRIMA_PROPOZITIE, formatted_diagnosis.A_DOUA_PROPOZITIE), ''), original_diagnosis) AS reference FROM formatted_diagnoses""")
def reference_selection(spark, d):
    t = table(spark, d, "formatted_diagnoses")
    f = F.concat_ws(" ", "formatted_diagnosis.PRIMA_PROPOZITIE", "formatted_diagnosis.A_DOUA_PROPOZITIE")
    return t.select("diag_id", F.coalesce(F.nullif(f, F.lit("")), F.col("original_diagnosis")).alias("reference"))


@query("SELECT CAST(x AS DATE) AS day, CASE WHEN day(x) <= 25 THEN 'train' ELSE 'test' END AS split FROM generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY) AS t(x) WHERE day(x) <= 25 OR (day(x) = 30 AND month(x) % 2 = 1)", dates=("day",))
def calendar_split(spark, d):
    return A.calendar(spark, 2024)


@query("SELECT CAST(x AS DATE) AS day FROM generate_series(DATE '2024-07-05', DATE '2024-07-30', INTERVAL 5 DAY) AS t(x)", dates=("day",))
def analysis_dates(spark, d):
    return A.analysis_dates(spark, "2024-07-01", "2024-07-30", 4)


@query("SELECT test_id, CAST(x AS BIGINT) AS past_days FROM test_data_zero_shot, unnest(generate_series(1, past_days)) AS t(x)")
def past_days_sweep(spark, d):
    return table(spark, d, "test_data_zero_shot").where("past_days >= 1").select("test_id", F.explode(F.sequence(F.lit(1), "past_days")).alias("past_days"))


@query("SELECT 42 + x AS seed FROM generate_series(0, 4) AS t(x)")
def seed_list(spark, d):
    return spark.range(42, 47).select(F.col("id").alias("seed"))


@query(f"""WITH {REPORTS}, a AS (SELECT DISTINCT day FROM r WHERE day IS NOT NULL), b AS (SELECT DISTINCT CAST("Data masurarii" AS DATE) AS day FROM datezilnicetemp_bucuresti WHERE "Data masurarii" IS NOT NULL), m AS (SELECT b.day, a.day IS NOT NULL AS has FROM b LEFT JOIN a ON b.day = a.day)
SELECT strftime(day, '%Y-%m') AS month, count(*) AS n_days, count(*) FILTER (WHERE has) AS n_with_report, coalesce(string_agg(CASE WHEN NOT has THEN CAST(day AS VARCHAR) END, ',' ORDER BY day), '') AS missing FROM m GROUP BY 1""")
def date_coverage(spark, d):
    a = reports(spark, d).where("day is not null").select("day").distinct().withColumn("has", F.lit(True))
    b = table(spark, d, "datezilnicetemp_bucuresti").where("`Data masurarii` is not null").select(F.to_date("`Data masurarii`").alias("day")).distinct()
    m = b.join(a, "day", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return m.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_days"), F.count_if("has").alias("n_with_report"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(~F.col("has"), F.col("day").cast("string"))))).alias("missing"))


@query(f"""WITH {REPORTS}, t AS (SELECT train_id, CAST({DATE.format(c='date')} AS DATE) AS day FROM train_data), k AS (SELECT day, min(diag_id) AS diag_id FROM r WHERE day IS NOT NULL GROUP BY 1)
SELECT train_id, t.day, k.diag_id FROM t JOIN k ON t.day = k.day - 1""", dates=("day",))
def gap_pairing(spark, d):
    """A day belongs with the report of the next day."""
    k = reports(spark, d).where("day is not null").groupBy("day").agg(F.min("diag_id").alias("diag_id")).select(F.date_sub("day", 1).alias("day"), "diag_id")
    t = table(spark, d, "train_data").select("train_id", A.any_date(F.col("date")).alias("day"))
    return t.join(k, "day").select("train_id", "day", "diag_id")


@query(f"""WITH {REPORTS} SELECT count(*) AS n_expected, count(*) FILTER (WHERE day IS NOT NULL) AS n_dated, count(*) FILTER (WHERE day IS NOT NULL AND trim(original_diagnosis) <> '') AS n_with_text, count(*) FILTER (WHERE day IS NOT NULL AND trim(original_diagnosis) <> '' AND formatted_diagnosis IS NOT NULL) AS n_usable FROM r""")
def record_funnel(spark, d):
    text = F.coalesce(F.trim("original_diagnosis") != "", F.lit(False))
    return reports(spark, d).agg(F.count(F.lit(1)).alias("n_expected"), F.count("day").alias("n_dated"), F.count_if(F.col("day").isNotNull() & text).alias("n_with_text"), F.count_if(F.col("day").isNotNull() & text & F.col("formatted_diagnosis").isNotNull()).alias("n_usable"))


@query(f"""WITH {REPORTS}, x AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY processing_timestamp DESC NULLS LAST, diag_id DESC) AS n FROM r WHERE day IS NOT NULL) SELECT day, diag_id FROM x WHERE n = 1""", dates=("day",))
def latest_report(spark, d):
    """The report of a day that was processed last."""
    from brumar.operators.experiments import top_n

    return top_n(reports(spark, d).where("day is not null"), ["day"], [F.desc_nulls_last("processing_timestamp"), F.desc("diag_id")], 1).select("day", "diag_id")


@query("""SELECT diag_id, to_json({'PRIMA_PROPOZITIE': formatted_diagnosis.PRIMA_PROPOZITIE, 'A_TREIA_PROPOZITIE': formatted_diagnosis.A_TREIA_PROPOZITIE, 'A_PATRA_PROPOZITIE': formatted_diagnosis.A_PATRA_PROPOZITIE, 'PROPOZITIA_FINALA': formatted_diagnosis.PROPOZITIA_FINALA})::VARCHAR AS kept FROM formatted_diagnoses WHERE formatted_diagnosis IS NOT NULL""")
def drop_fields(spark, d):
    """Nested records without one of their fields keep the others; the JSON of the record shows that it is gone."""
    t = table(spark, d, "formatted_diagnoses").where("formatted_diagnosis is not null").withColumn("f", F.col("formatted_diagnosis").dropFields("A_DOUA_PROPOZITIE"))
    return t.select("diag_id", F.to_json("f", {"ignoreNullFields": "false"}).alias("kept"))


@query("""SELECT train_id, sursa, CAST(i - 1 AS BIGINT) AS position, messages[i].role AS role, CAST(length(messages[i].content) AS BIGINT) AS n_chars FROM train_data, unnest(generate_series(1, len(messages))) AS t(i)""")
def flatten_records(spark, d):
    return table(spark, d, "train_data").select("train_id", "sursa", F.posexplode("messages").alias("position", "m")).select("train_id", "sursa", "position", "m.role", F.length("m.content").alias("n_chars"))


@query("""SELECT approach, count(*) AS n, round(avg(length(user_prompt)), 6) AS mean_prompt, CAST(max(length(user_prompt)) AS BIGINT) AS longest FROM test_data_zero_shot GROUP BY 1""")
def prompt_lengths(spark, d):
    n = F.length("user_prompt")
    return table(spark, d, "test_data_zero_shot").groupBy("approach").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean_prompt"), F.max(n).alias("longest"))


@query("""SELECT train_id FROM train_data SEMI JOIN (SELECT DISTINCT sursa FROM test_data_zero_shot WHERE split = 'validare') s ON train_data.sursa = s.sursa ANTI JOIN (SELECT CAST(diag_id AS BIGINT) AS diag_id FROM formatted_diagnoses WHERE original_diagnosis IS NULL) f ON train_data.train_id = f.diag_id""")
def resume_skip_done(spark, d):
    """Records still to be worked on: those whose key is not among the finished ones."""
    s = table(spark, d, "test_data_zero_shot").where("split = 'validare'").select("sursa").distinct()
    done = table(spark, d, "formatted_diagnoses").where("original_diagnosis is null").select(F.col("diag_id").alias("train_id"))
    return table(spark, d, "train_data").join(s, "sursa", "left_semi").join(done, "train_id", "left_anti").select("train_id")


@query("""WITH x AS (SELECT day, avg(tmax) AS tmax, avg(tmin) AS tmin FROM {daily_cte} GROUP BY 1) SELECT day, strftime(day, '%d.%m.%Y') || ': maxima ' || printf('%.1f', floor(round(tmax, 6) * 10 + 0.5) / 10) || ' °C, minima ' || printf('%.1f', floor(round(tmin, 6) * 10 + 0.5) / 10) || ' °C' AS line FROM x WHERE tmax IS NOT NULL AND tmin IS NOT NULL""".replace("{daily_cte}", "daily"), dates=("day",))
def prompt_lines(spark, d):
    from brumar.plans.sensors import daily

    x = daily(spark, d).groupBy("day").agg(F.avg("tmax").alias("tmax"), F.avg("tmin").alias("tmin")).where("tmax is not null and tmin is not null")
    tenth = lambda c: F.floor(F.round(F.col(c), 6) * 10 + 0.5) / 10
    return x.select("day", F.format_string("%s: maxima %.1f °C, minima %.1f °C", F.date_format("day", "dd.MM.yyyy"), tenth("tmax"), tenth("tmin")).alias("line"))


def _fill_in() -> None:
    from brumar.plans.registry import SQL
    from brumar.plans.sensors import DAILY

    SQL["prompt_lines"] = SQL["prompt_lines"].replace("FROM (WITH x", f"FROM (WITH {DAILY}, x")


_fill_in()
