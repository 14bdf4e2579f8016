"""Queries of experiment analytics: line items stand for runs (model = return flag, setting = line number, metric = discount)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brumar.common import table
from brumar.operators import experiments as X
from brumar.operators.similarity import best_matches
from brumar.operators.similarity import greedy_match as matched
from brumar.plans.registry import query

RUNS = "runs AS (SELECT l_returnflag AS model, CAST(l_linenumber AS BIGINT) AS past_days, l_discount AS score, l_tax AS other, l_quantity AS tokens, l_orderkey AS k FROM lineitem)"


def runs(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("bigint").alias("past_days"), F.col("l_discount").alias("score"), F.col("l_tax").alias("other"), F.col("l_quantity").alias("tokens"), F.col("l_orderkey").alias("k"))


@query(f"WITH {RUNS} SELECT model, past_days, round_even(avg(score), 4) AS mean, round_even(stddev_samp(score), 4) AS std, count(score) AS n FROM runs GROUP BY 1, 2")
def replicate_cube(spark, d):
    return X.cube(runs(spark, d), ["model", "past_days"], "score")


@query(f"""WITH {RUNS}, u AS (SELECT model, past_days, 'score' AS metric, score AS value FROM runs UNION ALL SELECT model, past_days, 'other', other FROM runs)
SELECT model, past_days, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM u GROUP BY 1, 2, 3""")
def variance_cube(spark, d):
    long = runs(spark, d).unpivot(["model", "past_days"], ["score", "other"], "metric", "value")
    return long.groupBy("model", "past_days", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count("value").alias("n"))


@query(f"WITH {RUNS}, g AS (SELECT count(*) AS n FROM runs GROUP BY model, past_days) SELECT max(n) > 1 AS replicates, max(n) AS most FROM g")
def replicate_detection(spark, d):
    return X.has_replicates(runs(spark, d), ["model", "past_days"])


@query(f"WITH {RUNS} SELECT model, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS min, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75, max(score) AS max FROM runs GROUP BY 1")
def describe_metric(spark, d):
    return X.described(runs(spark, d), "model", "score").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"WITH {RUNS} SELECT model, past_days, round(stddev_samp(score), 6) AS std, count(score) AS n FROM runs GROUP BY 1, 2 HAVING count(score) > 1 AND stddev_samp(score) > 0.0315")
def high_variance_cells(spark, d):
    return X.high_variance(runs(spark, d), ["model", "past_days"], "score", 0.0315).withColumn("std", F.round("std", 6))


@query(f"WITH {RUNS} SELECT past_days, round(avg(score) FILTER (WHERE model = 'A'), 6) AS A, round(avg(score) FILTER (WHERE model = 'N'), 6) AS N, round(avg(score) FILTER (WHERE model = 'R'), 6) AS R FROM runs GROUP BY 1")
def pivot_mean(spark, d):
    p = X.pivoted(runs(spark, d), "past_days", "model", ["A", "N", "R"], "score")
    return p.select("past_days", *[F.round(c, 6).alias(c) for c in "ANR"])


@query(f"""WITH {RUNS}, r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model ORDER BY other) + (count(*) OVER (PARTITION BY model, other) - 1) / 2.0 AS rb FROM runs WHERE score IS NOT NULL AND other IS NOT NULL)
SELECT model, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1""")
def spearman(spark, d):
    return X.spearman(runs(spark, d), "model", "score", "other").withColumn("rho", F.round("rho", 6))


@query(f"WITH {RUNS}, r AS (SELECT model, k, past_days, score, row_number() OVER (PARTITION BY model ORDER BY score DESC, k, past_days) AS rank FROM runs) SELECT * FROM r WHERE rank <= 3")
def topn_per_group(spark, d):
    return X.top_n(runs(spark, d).select("model", "k", "past_days", "score"), ["model"], [F.desc("score"), F.asc("k"), F.asc("past_days")], 3)


@query(f"WITH {RUNS}, r AS (SELECT model, k, past_days, score, row_number() OVER (PARTITION BY model ORDER BY (tokens > 45) DESC, coalesce(score, -1) DESC, k, past_days) AS rank FROM runs) SELECT * FROM r WHERE rank <= 1")
def preferred_best(spark, d):
    """Best run by model, those of the preferred pool first; a null score counts as -1."""
    r = runs(spark, d)
    order = [F.desc(F.col("tokens") > 45), F.desc(F.coalesce("score", F.lit(-1.0))), F.asc("k"), F.asc("past_days")]
    return X.top_n(r, ["model"], order, 1).select("model", "k", "past_days", "score", "rank")


@query(f"WITH {RUNS} SELECT past_days, round(avg(score), 6) AS mean FROM runs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top5_columns(spark, d):
    return runs(spark, d).groupBy("past_days").agg(F.round(F.avg("score"), 6).alias("mean")).orderBy(F.desc("mean"), "past_days").limit(5)


@query(f"""WITH {RUNS}, g AS (SELECT model, count(tokens) AS n, CAST(min(tokens) AS BIGINT) AS least, CAST(max(tokens) AS BIGINT) AS most, CAST(sum(CAST(tokens AS BIGINT)) // count(tokens) AS BIGINT) AS mean FROM runs GROUP BY 1)
SELECT *, CASE WHEN most >= 50 THEN 'TRUNCATED' WHEN most >= 40 THEN 'near limit' ELSE 'ok' END AS status FROM g""")
def token_audit(spark, d):
    return X.token_audit(runs(spark, d).withColumn("tokens", F.col("tokens").cast("bigint")), "model", "tokens", 50)


@query(f"""WITH {RUNS}, f AS (SELECT model, CASE WHEN past_days = 1 THEN 'length' WHEN past_days = 2 THEN 'max_output_tokens' ELSE 'stop' END AS reason, tokens / 50 AS fill FROM runs)
SELECT model, CASE WHEN reason IN ('length', 'max_output_tokens') THEN 'cut' WHEN model = 'A' AND fill >= 0.95 THEN 'full' ELSE 'ok' END AS flag, count(*) AS n FROM f GROUP BY 1, 2""")
def truncation_flags(spark, d):
    reason = F.when(F.col("past_days") == 1, "length").when(F.col("past_days") == 2, "max_output_tokens").otherwise("stop")
    return runs(spark, d).groupBy("model", X.truncation_flag(reason, F.col("tokens") / 50, F.col("model") == "A").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RUNS}, a AS (SELECT * FROM runs WHERE model = 'A'), b AS (SELECT DISTINCT k, past_days FROM runs WHERE model = 'R') SELECT a.k, a.past_days, a.score FROM a SEMI JOIN b ON a.k = b.k AND a.past_days % 3 = b.past_days % 3""")
def matched_runs(spark, d):
    """Runs of one evaluation set that the other set holds under the same key."""
    r = runs(spark, d)
    key = (F.col("past_days") % 3).alias("m")
    a = r.where("model = 'A'").select("k", "past_days", "score", key)
    b = r.where("model = 'R'").select("k", key).distinct()
    return a.join(b, ["k", "m"], "left_semi").select("k", "past_days", "score")


@query("""WITH s AS (SELECT * FROM (VALUES ('monthly'), ('daily')) t(scenario)), f AS (SELECT CAST(x AS BIGINT) AS fold FROM generate_series(1, 4) t(x)), m AS (SELECT * FROM (VALUES ('zero'), ('few'), ('aux')) t(mode)) SELECT scenario, fold, mode FROM s, f, m""")
def test_matrix(spark, d):
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], [name])
    return one("scenario", ["monthly", "daily"]).crossJoin(one("fold", [1, 2, 3, 4])).crossJoin(one("mode", ["zero", "few", "aux"]))


BEST = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0), m AS (SELECT a.vec_id, a.label, b.label AS other, max(list_cosine_similarity(a.e, b.e)) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3)"


def best(spark, d):
    return best_matches(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query(f"WITH {BEST} SELECT vec_id, CAST(label AS BIGINT) AS label, round(max(s), 5) AS best FROM m GROUP BY 1, 2")
def vector_best_match(spark, d):
    """The similarity of every vector to the nearest of all others."""
    return best(spark, d).groupBy("vec_id", F.col("label").cast("bigint").alias("label")).agg(F.round(F.max("s"), 5).alias("best"))


@query(f"""WITH {BEST}, p AS (SELECT label, other, avg(s) AS p, count(*) AS n FROM m GROUP BY 1, 2)
SELECT CAST(x.label AS BIGINT) AS label, CAST(x.other AS BIGINT) AS other, round(x.p, 5) AS precision, round(y.p, 5) AS recall, round(CASE WHEN x.p + y.p <> 0 THEN 2 * x.p * y.p / (x.p + y.p) ELSE 0 END, 5) AS f, x.n FROM p x JOIN p y ON x.label = y.other AND x.other = y.label""")
def greedy_match(spark, d):
    """Greedy matching of the vectors of every two labels, a label standing for a text and its vectors for the words of it."""
    m = matched(best(spark, d), "label")
    return m.select(F.col("label").cast("bigint").alias("label"), F.col("other").cast("bigint").alias("other"), *[F.round(c, 5).alias(c) for c in ("precision", "recall", "f")], "n")
