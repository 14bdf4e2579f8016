"""Smaller queries: labels, clean cells, zone means, paragraphs, roll-outs, failures of parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from brumar.common import table
from brumar.functions import text as X
from brumar.operators import forecast as P
from brumar.operators import quality as Q
from brumar.plans.forecasts import S, W, samples
from brumar.plans.registry import query
from brumar.plans.sensors import DAILY, DIM, READINGS, daily, dim


@query("SELECT DISTINCT source, translate(replace(source, '_', ':'), ':/', '__') AS safe FROM documents WHERE source IS NOT NULL")
def safe_names(spark, d):
    """Names that can be part of a file name."""
    s = table(spark, d, "documents").where("source is not null").select("source").distinct()
    return s.select("source", F.translate(F.translate("source", "_", ":"), ":/", "__").alias("safe"))


@query(r"SELECT diag_id, nullif(regexp_extract(pdf_path, '([a-z]+)_\d+\.pdf$', 1), '') AS label, nullif(regexp_extract(pdf_path, '/(\d{4})/\d{2}/\d{2}/', 1), '') AS year FROM formatted_diagnoses")
def path_labels(spark, d):
    g = lambda p: F.nullif(F.regexp_extract("pdf_path", p, 1), F.lit(""))
    return table(spark, d, "formatted_diagnoses").select("diag_id", g(r"([a-z]+)_\d+\.pdf$").alias("label"), g(r"/(\d{4})/\d{2}/\d{2}/").alias("year"))


@query(f"SELECT nullif(nullif(nullif(trim(Fenomen), ''), 'nan'), 'None') AS label, count(*) AS n FROM {READINGS} GROUP BY 1")
def clean_cells(spark, d):
    """Blank cells and the words that stand for them become null."""
    return table(spark, d, READINGS).groupBy(Q.clean_cell(F.col("Fenomen")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT nullif(nullif(nullif(trim(Fenomen), ''), 'nan'), 'None') AS label, nullif(nullif(nullif(trim(Nop), ''), 'nan'), 'None') AS sky FROM {READINGS} WHERE nullif(nullif(nullif(trim(Fenomen), ''), 'nan'), 'None') IS NOT NULL OR nullif(nullif(nullif(trim(Nop), ''), 'nan'), 'None') IS NOT NULL")
def without_empty(spark, d):
    """A table of text cells without its empty rows and columns; the made-up column is all blank and goes."""
    t = table(spark, d, READINGS).select(F.col("Fenomen").alias("label"), F.col("Nop").alias("sky"), F.lit(" ").alias("nothing"))
    return Q.without_empty(t).distinct()


@query("SELECT test_id FROM test_data_zero_shot WHERE split IS NOT NULL AND split NOT IN ('validare') AND (sursa IS NULL OR sursa NOT IN (SELECT sursa FROM test_data_zero_shot WHERE sursa IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, sursa LIMIT 1))")
def exclusion_list(spark, d):
    """Records outside two lists of what is left out: named splits, and the source with the most records."""
    t = table(spark, d, "test_data_zero_shot")
    most = t.where("sursa is not null").groupBy("sursa").count().orderBy(F.desc("count"), "sursa").limit(1).select("sursa")
    return t.where(~F.col("split").isin("validare")).join(most, "sursa", "left_anti").select("test_id")


@query(f"""WITH {DAILY}, {DIM}, c AS (SELECT parent, grp, strftime(day, '%Y-%m') AS month, avg((tmax + tmin) / 2) AS m FROM daily JOIN dim USING (entity) WHERE grp IS NOT NULL AND parent IS NOT NULL GROUP BY 1, 2, 3)
SELECT parent, month, round(avg(m), 6) AS zone_mean, count(m) AS n_groups FROM c GROUP BY 1, 2""")
def zone_month_mean(spark, d):
    """The mean of a zone over a month as the mean of the means of its groups."""
    j = daily(spark, d).join(dim(spark, d), "entity").where("grp is not null and parent is not null")
    c = j.groupBy("parent", "grp", F.date_format("day", "yyyy-MM").alias("month")).agg(F.avg((F.col("tmax") + F.col("tmin")) / 2).alias("m"))
    return c.groupBy("parent", "month").agg(F.round(F.avg("m"), 6).alias("zone_mean"), F.count("m").alias("n_groups"))


@query(f"""WITH {DAILY}, {DIM}, c AS (SELECT parent, day, grp, avg((tmax + tmin) / 2) AS m FROM daily JOIN dim USING (entity) WHERE grp IS NOT NULL AND parent IS NOT NULL GROUP BY 1, 2, 3) SELECT parent, day, round(avg(m), 6) AS zone_mean FROM c GROUP BY 1, 2""", dates=("day",))
def zone_day_mean(spark, d):
    j = daily(spark, d).join(dim(spark, d), "entity").where("grp is not null and parent is not null")
    c = j.groupBy("parent", "day", "grp").agg(F.avg((F.col("tmax") + F.col("tmin")) / 2).alias("m"))
    return c.groupBy("parent", "day").agg(F.round(F.avg("m"), 6).alias("zone_mean"))


@query(f"""WITH {DAILY}, {DIM}, c AS (SELECT strftime(day, '%Y-%m') AS month, grp, round(avg((tmax + tmin) / 2), 6) AS m FROM daily JOIN dim USING (entity) WHERE grp IS NOT NULL GROUP BY 1, 2)
SELECT month, string_agg('În ' || grp || ' temperatura medie a fost cuprinsă în intervalul [' || CAST(CAST(2 * floor(m / 2) AS BIGINT) AS VARCHAR) || ', ' || CAST(CAST(2 * floor(m / 2) + 2 AS BIGINT) AS VARCHAR) || '] °C.', ' ' ORDER BY grp) AS paragraph FROM c WHERE m IS NOT NULL GROUP BY 1""")
def paragraph_synthesis(spark, d):
    """A paragraph of one sentence a group, with the cell of the grid that holds its mean."""
    c = daily(spark, d).join(dim(spark, d), "entity").where("grp is not null").groupBy(F.date_format("day", "yyyy-MM").alias("month"), "grp").agg(F.round(F.avg((F.col("tmax") + F.col("tmin")) / 2), 6).alias("m")).where("m is not null")
    low = (2 * F.floor(F.col("m") / 2)).cast("bigint")
    line = F.format_string("În %s temperatura medie a fost cuprinsă în intervalul [%d, %d] °C.", "grp", low, low + 2)
    return c.groupBy("month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", line.alias("line")))), lambda s: s["line"]), " ").alias("paragraph"))


def _steps_sql() -> str:
    x = f"(list_sum(x) / {W})"
    y = f"((list_sum(x) - x[1] + a) / {W})"
    z = f"((list_sum(x) - x[1] - x[2] + a + b) / {W})"
    return f"WITH {S}, a AS (SELECT entity, sample, x, {x} AS a FROM s), b AS (SELECT *, {y} AS b FROM a), c AS (SELECT *, {z} AS c FROM b) SELECT entity, sample, CAST(h AS BIGINT) AS step, round(CASE h WHEN 1 THEN a WHEN 2 THEN b ELSE c END, 6) AS pred FROM c, unnest(generate_series(1, 3)) AS t(h)"


@query(_steps_sql())
def mean_rollout(spark, d):
    return P.rolled_out(samples(spark, d), "entity", 3).withColumn("pred", F.round("pred", 6))


@query(r"SELECT source, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(text, '\[[^\[\]]*\]')) AS n_unparsed FROM documents WHERE text IS NOT NULL GROUP BY 1")
def unparsed_counts(spark, d):
    """Texts without any bracketed list, by source."""
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("text").rlike(r"\[[^\[\]]*\]")).alias("n_unparsed"))


@query()
def judge_motivation(spark, d):
    """A judge's reason, for every reply."""
    t = table(spark, d, "documents").where("source = 'judge_response' and text is not null")
    return t.select("doc_id", X.motivation(F.col("text")).alias("motivation"))


@query("""WITH t AS (SELECT train_id, messages, list_filter(messages, lambda m: m.role = 'assistant') AS a FROM train_data), c AS (SELECT sursa FROM test_data_zero_shot WHERE sursa IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
SELECT t.train_id FROM t JOIN train_data d ON t.train_id = d.train_id SEMI JOIN c ON d.sursa = c.sursa WHERE len(a) > 0 AND length(a[1].content) > 0""")
def eligible_records(spark, d):
    """Records with a non-empty answer whose source is well covered by evaluation records."""
    c = table(spark, d, "test_data_zero_shot").where("sursa is not null").groupBy("sursa").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    a = F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(1))
    return table(spark, d, "train_data").where(F.length(a["content"]) > 0).join(c, "sursa", "left_semi").select("train_id")


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 300 THEN 'short' WHEN length(text) < 1000 THEN 'usual' ELSE 'long' END AS label FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def length_bands(spark, d):
    n = F.length("text")
    label = F.when(n == 0, "empty").when(n < 300, "short").when(n < 1000, "usual").otherwise("long")
    return table(spark, d, "documents").where("text is not null").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


_LABEL_SQL = [("PRIMA PROPOZIȚIE", "PRIMA PROPOZI[ȚŢT]?I[AE]"), ("A DOUA PROPOZIȚIE", "A DOUA PROPOZI[ȚŢT]?I[AE]"), ("A TREIA PROPOZIȚIE", "A TREIA PROPOZI[ȚŢT]?I[AE]"), ("A PATRA PROPOZIȚIE", "A PATRA PROPOZI[ȚŢT]?I[AE]"), ("PROPOZIȚIA FINALĂ", "PROPOZI[ȚŢT]?IA FINAL[ĂA]")]


@query(" UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM documents WHERE len(list_filter(regexp_extract_all(text, '(?i){p}:[ \t]*([^\n]*)', 1), lambda s: trim(s) NOT IN ('', '-'))) > 0" for n, p in _LABEL_SQL))
def section_labels(spark, d):
    """How many structured texts have each of the five labels."""
    t = table(spark, d, "documents").where("text is not null")
    counts = t.agg(*[F.count(X.labelled(F.col("text"), x)).alias(f"c{i}") for i, x in enumerate(X.SECTION_LABELS)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"c{i}").alias("n")) for i, x in enumerate(X.SECTION_LABELS)])))
