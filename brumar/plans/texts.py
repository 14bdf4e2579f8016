"""Queries on narrative texts: folding, cutting, parsing, zones, overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from brumar.common import table
from brumar.functions import text as X
from brumar.operators import similarity as S
from brumar.operators import zones as Z
from brumar.plans.registry import query

DOCS = "d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").where("text is not null")


def monthly(spark, d):
    return table(spark, d, "documents").where("source = 'caracterizare_lunara' and text is not null").select("doc_id", "text")


@query(f"WITH {DOCS} SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(greatest(0, len(regexp_split_to_array(text, '[.!?]+')) - 1) AS BIGINT) AS n_sentences, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM d")
def text_basic_stats(spark, d):
    return docs(spark, d).select("doc_id", F.length("text").alias("n_chars"), X.sentence_count(F.col("text")).alias("n_sentences"), F.size(X.words(F.col("text"))).alias("n_words"))


@query(f"WITH {DOCS} SELECT doc_id, translate(text, 'şŞţŢ', 'șȘțȚ') AS folded FROM d")
def cedilla_fold(spark, d):
    return docs(spark, d).select("doc_id", X.fold_cedilla(F.col("text")).alias("folded"))


@query(f"WITH {DOCS} SELECT doc_id, lower(translate(text, '{X.ACCENTED}', '{X.PLAIN}')) AS plain FROM d")
def accent_strip(spark, d):
    return docs(spark, d).select("doc_id", X.strip_accents(F.col("text")).alias("plain"))


@query(f"WITH {DOCS} SELECT doc_id, regexp_replace(text, '<think>.*?</think>', '', 'gis') AS answer FROM d WHERE text ILIKE '%<think>%'")
def thought_strip(spark, d):
    return docs(spark, d).where(F.lower("text").contains("<think>")).select("doc_id", X.without_thoughts(F.col("text")).alias("answer"))


@query(f"WITH {DOCS} SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{{85}}\\x{{0b}}\\x{{a0}}\\pZ]+', ' ', 'g')) AS clean FROM d")
def whitespace_normalise(spark, d):
    return docs(spark, d).select("doc_id", X.one_space(F.col("text")).alias("clean"))


STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"WITH {DOCS} SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains([{STOP}], w)), ' ') AS content FROM d")
def stopword_filter(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(X.content_words(F.col("text")), " ").alias("content"))


_GONE = ", ".join(f"'{w}'" for w in X.STOP_WORDS if w not in X.TIME_WORDS)


@query(f"WITH p AS (SELECT doc_id, lower(trim(regexp_replace(translate(coalesce(text, ''), 'şŞţŢ', 'șȘțȚ'), '[\\s\\x{{85}}\\x{{0b}}\\x{{a0}}\\pZ]+', ' ', 'g'))) AS plain FROM documents) SELECT doc_id, plain, array_to_string(list_filter(string_split(plain, ' '), lambda w: NOT list_contains([{_GONE}], w)), ' ') AS filtered FROM p")
def comparable_texts(spark, d):
    """Both forms in which texts are compared: whole, and without function words but with words for time."""
    return table(spark, d, "documents").select("doc_id", X.comparable(F.col("text"), None).alias("plain"), X.comparable(F.col("text")).alias("filtered"))


PAIR = "p AS (SELECT diag_id, original_diagnosis AS a, concat_ws(' ', formatted_diagnosis.PRIMA_PROPOZITIE, formatted_diagnosis.A_DOUA_PROPOZITIE, formatted_diagnosis.A_TREIA_PROPOZITIE, formatted_diagnosis.A_PATRA_PROPOZITIE, formatted_diagnosis.PROPOZITIA_FINALA) AS b FROM formatted_diagnoses WHERE original_diagnosis IS NOT NULL AND formatted_diagnosis IS NOT NULL)"


def pairs(spark, d):
    f = "formatted_diagnosis."
    b = F.concat_ws(" ", *[F.col(f + x) for x in ("PRIMA_PROPOZITIE", "A_DOUA_PROPOZITIE", "A_TREIA_PROPOZITIE", "A_PATRA_PROPOZITIE", "PROPOZITIA_FINALA")])
    return table(spark, d, "formatted_diagnoses").where("original_diagnosis is not null and formatted_diagnosis is not null").select("diag_id", F.col("original_diagnosis").alias("a"), b.alias("b"))


TOK = f"list_filter(regexp_split_to_array(lower({{c}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: w <> '' AND NOT list_contains([{STOP}], w))"


@query(f"""WITH {PAIR}, t AS (SELECT diag_id, list_distinct({TOK.format(c='a')}) AS x, list_distinct({TOK.format(c='b')}) AS y FROM p), n AS (SELECT diag_id, len(list_intersect(x, y)) AS i, len(x) AS nx, len(y) AS ny FROM t)
SELECT diag_id, round(i / nullif(nx + ny - i, 0), 6) AS jaccard, round(i / nullif(ny, 0), 6) AS reference_coverage, round(i / nullif(nx, 0), 6) AS response_coverage FROM n""")
def token_jaccard(spark, d):
    a, b = X.content_words(F.col("a")), X.content_words(F.col("b"))
    got = pairs(spark, d).select("diag_id", *S.token_overlap(a, b))
    return got.select("diag_id", *[F.round(c, 6).alias(c) for c in ("jaccard", "reference_coverage", "response_coverage")])


WORD = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query(f"""WITH {PAIR}, t AS (SELECT diag_id, {WORD.format(c='a')} AS x, {WORD.format(c='b')} AS y FROM p),
gx AS (SELECT diag_id, x[i] || ' ' || x[i + 1] AS g, count(*) AS n FROM t, unnest(generate_series(1, len(x) - 1)) AS s(i) GROUP BY 1, 2), gy AS (SELECT diag_id, y[i] || ' ' || y[i + 1] AS g, count(*) AS n FROM t, unnest(generate_series(1, len(y) - 1)) AS s(i) GROUP BY 1, 2),
j AS (SELECT coalesce(gx.diag_id, gy.diag_id) AS diag_id, sum(least(coalesce(gx.n, 0), coalesce(gy.n, 0))) AS b, sum(coalesce(gx.n, 0)) AS nx, sum(coalesce(gy.n, 0)) AS ny FROM gx FULL JOIN gy ON gx.diag_id = gy.diag_id AND gx.g = gy.g GROUP BY 1)
SELECT diag_id, round(CASE WHEN nx > 0 THEN b / nx ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN ny > 0 THEN b / ny ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN b > 0 THEN 2 * b / (nx + ny) ELSE 0 END, 6)::DOUBLE AS f FROM j""")
def rouge_2(spark, d):
    p = pairs(spark, d).select("diag_id", X.words(F.col("a")).alias("x"), X.words(F.col("b")).alias("y"))
    got = S.rouge_n(p, "diag_id", "x", "y", 2)
    return got.select("diag_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(f"""WITH {PAIR}, t AS (SELECT diag_id, {WORD.format(c='a')} AS x, {WORD.format(c='b')} AS y FROM p),
gx AS (SELECT diag_id, unnest(x) AS g, count(*) AS n FROM t GROUP BY 1, 2), gy AS (SELECT diag_id, unnest(y) AS g, count(*) AS n FROM t GROUP BY 1, 2),
j AS (SELECT coalesce(gx.diag_id, gy.diag_id) AS diag_id, sum(least(coalesce(gx.n, 0), coalesce(gy.n, 0))) AS b, sum(coalesce(gx.n, 0)) AS nx, sum(coalesce(gy.n, 0)) AS ny FROM gx FULL JOIN gy ON gx.diag_id = gy.diag_id AND gx.g = gy.g GROUP BY 1)
SELECT diag_id, round(CASE WHEN nx > 0 THEN b / nx ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN ny > 0 THEN b / ny ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN b > 0 THEN 2 * b / (nx + ny) ELSE 0 END, 6)::DOUBLE AS f FROM j""")
def rouge_1(spark, d):
    p = pairs(spark, d).select("diag_id", X.words(F.col("a")).alias("x"), X.words(F.col("b")).alias("y"))
    got = S.rouge_n(p, "diag_id", "x", "y", 1)
    return got.select("diag_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


GATED = f"""g AS (SELECT diag_id, coalesce(original_diagnosis, '') AS a, coalesce(concat_ws(' ', formatted_diagnosis.PRIMA_PROPOZITIE, formatted_diagnosis.A_DOUA_PROPOZITIE, formatted_diagnosis.A_TREIA_PROPOZITIE, formatted_diagnosis.A_PATRA_PROPOZITIE, formatted_diagnosis.PROPOZITIA_FINALA), '') AS b FROM formatted_diagnoses),
w AS (SELECT *, list_distinct({TOK.format(c='a').replace('{{', '{').replace('}}', '}')}) AS x, list_distinct({TOK.format(c='b').replace('{{', '{').replace('}}', '}')}) AS y FROM g)"""


def _gated(spark, d):
    parts = [F.col("formatted_diagnosis." + x) for x in ("PRIMA_PROPOZITIE", "A_DOUA_PROPOZITIE", "A_TREIA_PROPOZITIE", "A_PATRA_PROPOZITIE", "PROPOZITIA_FINALA")]
    t = table(spark, d, "formatted_diagnoses").select("diag_id", F.coalesce("original_diagnosis", F.lit("")).alias("a"), F.concat_ws(" ", *parts).alias("b"))
    return t.withColumns({"x": F.array_distinct(X.content_words(F.col("a"))), "y": F.array_distinct(X.content_words(F.col("b")))})


@query(f"WITH {GATED} SELECT diag_id, CAST(length(a) AS BIGINT) AS length, CASE WHEN len(y) > 0 THEN round(len(list_intersect(x, y)) / len(y), 6) END AS reference_coverage FROM w")
def metric_gating(spark, d):
    """Length of every response, and its overlap with the reference only where there is a reference."""
    return _gated(spark, d).select("diag_id", F.length("a").alias("length"), F.when(F.size("y") > 0, F.round(F.size(F.array_intersect("x", "y")) / F.size("y"), 6)).alias("reference_coverage"))


@query(f"WITH {GATED}, e AS (SELECT diag_id, unnest([struct_pack(metric := 'jaccard', error := CASE WHEN len(x) = 0 AND len(y) = 0 THEN 'no words' END), struct_pack(metric := 'reference_coverage', error := CASE WHEN len(y) = 0 THEN 'empty reference' END), struct_pack(metric := 'response_coverage', error := CASE WHEN len(x) = 0 THEN 'empty response' END)]) AS m FROM w) SELECT m.metric AS metric, count(m.error) AS n_errors, arg_min(m.error, diag_id) FILTER (WHERE m.error IS NOT NULL) AS first_error FROM e GROUP BY 1")
def metric_errors(spark, d):
    """Failures of each metric and the first message."""
    x, y = F.size("x") == 0, F.size("y") == 0
    errors = {"jaccard": F.when(x & y, "no words"), "reference_coverage": F.when(y, "empty reference"), "response_coverage": F.when(x, "empty response")}
    e = _gated(spark, d).select("diag_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("error")) for m, c in errors.items()])).alias("m")).select("diag_id", "m.*")
    return e.groupBy("metric").agg(F.count("error").alias("n_errors"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("diag_id"))).alias("first_error"))


@query(r"""WITH r AS (SELECT test_id, CASE test_id % 4 WHEN 0 THEN to_json({'response': {'text': reference_diagnosis}}) WHEN 1 THEN to_json({'response': {'text': '', 'content': reference_diagnosis}}) WHEN 2 THEN to_json({'response': reference_diagnosis}) ELSE to_json({'model': approach}) END AS j FROM test_data_zero_shot WHERE reference_diagnosis IS NOT NULL)
SELECT test_id, trim(regexp_replace(CASE WHEN json_type(j, '$.response') = 'OBJECT' THEN coalesce(nullif(json_extract_string(j, '$.response.text'), ''), nullif(json_extract_string(j, '$.response.content'), ''), CAST(json_extract(j, '$.response') AS VARCHAR)) ELSE coalesce(json_extract_string(j, '$.response'), '') END, '[\s\x{85}\x{0b}\x{a0}\pZ]+', ' ', 'g')) AS answer FROM r""")
def response_field(spark, d):
    """Answers out of records of four shapes."""
    t = table(spark, d, "test_data_zero_shot").where("reference_diagnosis is not null")
    text, k = F.col("reference_diagnosis"), F.col("test_id") % 4
    obj = lambda **c: F.to_json(F.struct(*[v.alias(n) for n, v in c.items()]))
    j = F.when(k == 0, obj(response=F.struct(text.alias("text")))).when(k == 1, obj(response=F.struct(F.lit("").alias("text"), text.alias("content")))).when(k == 2, obj(response=text)).otherwise(obj(model=F.col("approach")))
    return t.select("test_id", X.loose_response(j).alias("answer"))


@query()
def rouge_l(spark, d):
    got = pairs(spark, d).select("diag_id", S.rouge_l(X.words(F.col("a")), X.words(F.col("b"))).alias("r"))
    return got.select("diag_id", *[F.round(f"r.{c}", 6).alias(c) for c in ("precision", "recall", "f")])


@query()
def meteor(spark, d):
    return pairs(spark, d).select("diag_id", F.round(S.meteor(X.words(F.col("a")), X.words(F.col("b"))), 6).alias("meteor"))


@query()
def bleu(spark, d):
    return pairs(spark, d).select("diag_id", F.round(S.bleu(X.words(F.col("a")), X.words(F.col("b"))), 6).alias("bleu"))


_LABELS = ["PRIMA PROPOZI[ȚŢT]?I[AE]", "A DOUA PROPOZI[ȚŢT]?I[AE]", "A TREIA PROPOZI[ȚŢT]?I[AE]", "A PATRA PROPOZI[ȚŢT]?I[AE]", "PROPOZI[ȚŢT]?IA FINAL[ĂA]"]
_SECTIONS = ["first", "second", "third", "fourth", "last"]


@query(
    f"WITH {DOCS}, c AS (SELECT doc_id, regexp_replace(text, '<think>.*?</think>', '', 'gis') AS t FROM d), l AS (SELECT doc_id, "
    + ", ".join(f"list_filter(list_transform(regexp_extract_all(t, '(?i){p}:[ \\t]*([^\\n]*)', 1), lambda s: trim(s)), lambda s: s NOT IN ('', '-')) AS {n}" for p, n in zip(_LABELS, _SECTIONS))
    + f" FROM c WHERE regexp_matches(t, '(?i)({'|'.join(_LABELS)}):')) SELECT doc_id, "
    + ", ".join(f"list_filter({n}, lambda s: length(s) = list_max(list_transform({n}, lambda x: length(x))))[1] AS {n}" for n in _SECTIONS)
    + " FROM l"
)
def report_sections(spark, d):
    """All five sections, the longest of each, of every text that holds a label outside of thoughts."""
    clean = docs(spark, d).select("doc_id", X.without_thoughts(F.col("text")).alias("t"))
    some = clean.where(F.col("t").rlike("|".join(f"(?:{X.label_pattern(x)})" for x in X.SECTION_LABELS)))
    return some.select("doc_id", *[X.labelled(F.col("t"), x).alias(n) for x, n in zip(X.SECTION_LABELS, _SECTIONS)])


@query()
def line_sections(spark, d):
    """The five sections, read line by line, of every text that has any."""
    got = docs(spark, d).select("doc_id", *[c.alias(n) for c, n in zip(X.line_sections(F.col("text")), _SECTIONS)])
    return got.where(F.concat(*_SECTIONS) != "")


_SPACE = r"[\s\x{85}\x{0b}\x{a0}\pZ]+"


@query(
    f"WITH {DOCS}, c AS (SELECT doc_id, regexp_replace(text, '<think>.*?</think>', '', 'gis') AS t FROM d), l AS (SELECT doc_id, t, "
    + ", ".join(f"list_filter(list_transform(regexp_extract_all(t, '(?i){p}:[ \t]*([^\n]*)', 1), lambda s: trim(s)), lambda s: s NOT IN ('', '-')) AS {n}" for p, n in zip(_LABELS, _SECTIONS))
    + " FROM c), j AS (SELECT doc_id, t, concat_ws(' ', "
    + ", ".join(f"list_filter({n}, lambda s: length(s) = list_max(list_transform({n}, lambda x: length(x))))[1]" for n in _SECTIONS)
    + f") AS joined FROM l) SELECT doc_id, trim(regexp_replace(CASE WHEN joined = '' THEN t ELSE joined END, '{_SPACE}', ' ', 'g')) AS sentences FROM j"
)
def structured_sentences(spark, d):
    return docs(spark, d).select("doc_id", X.structured(F.col("text")).alias("sentences"))


@query(f"""WITH {DOCS}, s AS (SELECT doc_id, generate_subscripts(regexp_split_to_array(text, '\\.\\s+'), 1) AS i FROM d) SELECT doc_id, count(*) AS n_sentences FROM s GROUP BY 1""")
def sentence_split(spark, d):
    return docs(spark, d).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"))


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, regexp_extract_all(text, '\\[([^\\[\\]]*)\\]', 1) AS a FROM d), n AS (SELECT doc_id, list_filter(list_transform(a, lambda s: list_transform(regexp_split_to_array(s, '\\s*,\\s*'), lambda x: TRY_CAST(trim(x) AS DOUBLE))), lambda v: len(v) IN (4, 5) AND len(list_filter(v, lambda x: x BETWEEN 0 AND 1)) = len(v)) AS g FROM l)
SELECT doc_id, round(list_sum(g[-1]) / len(g[-1]), 6) AS score FROM n WHERE len(g) > 0""")
def score_list(spark, d):
    return docs(spark, d).select("doc_id", F.round(X.last_scores(F.col("text")), 6).alias("score")).where("score is not null")


@query("""WITH t AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS i, 'Nota [' || CAST(l_quantity AS INTEGER) || ', 12] apoi ' || CASE WHEN l_returnflag = 'A' THEN '[' || CAST(CAST(l_quantity AS INTEGER) * 3 AS VARCHAR) || ']' ELSE 'scor ' || CAST(CAST(l_quantity AS INTEGER) * 2 AS VARCHAR) END || ' din 250.' AS text FROM lineitem),
n AS (SELECT k, i, list_filter(list_transform(regexp_extract_all(text, '\\[\\s*(\\d+)\\s*\\]', 1), lambda s: CAST(s AS INTEGER)), lambda v: v <= 100) AS a, list_filter(list_transform(regexp_extract_all(text, '\\d+'), lambda s: CAST(s AS INTEGER)), lambda v: v <= 100) AS b FROM t)
SELECT k, i, CAST(coalesce(a[-1], b[-1]) AS BIGINT) AS score FROM n""")
def judge_integer(spark, d):
    q = F.col("l_quantity").cast("int")
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("Nota ["), s(q), F.lit(", 12] apoi "), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("["), s(q * 3), F.lit("]"))).otherwise(F.concat(F.lit("scor "), s(q * 2))), F.lit(" din 250."))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("i"), X.judge_score(text).alias("score"))


@query("""WITH n AS (SELECT test_id, approach || '_2024-07-10_' || past_days || '_past_days' || CASE WHEN test_id % 2 = 0 THEN '_seed' || CAST(40 + test_id % 5 AS VARCHAR) ELSE '' END || '.json' AS name FROM test_data_zero_shot)
SELECT test_id, regexp_extract(name, '^(.*)_(\\d{4}-\\d{2}-\\d{2})_(\\d+)_past_days', 1) AS model, '2024-07-10' AS date, CAST(regexp_extract(name, '_(\\d+)_past_days', 1) AS BIGINT) AS past_days, CASE WHEN test_id % 2 = 0 THEN 40 + test_id % 5 ELSE 1 END AS seed FROM n WHERE name IS NOT NULL""")
def filename_parse(spark, d):
    t = table(spark, d, "test_data_zero_shot")
    name = F.concat(F.col("approach"), F.lit("_2024-07-10_"), F.col("past_days").cast("string"), F.lit("_past_days"), F.when(F.col("test_id") % 2 == 0, F.concat(F.lit("_seed"), (40 + F.col("test_id") % 5).cast("string"))).otherwise(""), F.lit(".json"))
    return t.select("test_id", name.alias("name")).where("name is not null").select("test_id", X.run_name(F.col("name")).alias("r")).select("test_id", "r.*")


MONTHLY = "m AS (SELECT doc_id, text FROM documents WHERE source = 'caracterizare_lunara' AND text IS NOT NULL)"
BR = r"\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]"


@query(f"""WITH {MONTHLY}, b AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '{BR}', 1), regexp_extract_all(text, '{BR}', 2))) AS z FROM m), v AS (SELECT doc_id, CAST(z[1] AS DOUBLE) AS lo, CAST(z[2] AS DOUBLE) AS hi FROM b)
SELECT doc_id, lo, hi, 2 * floor((lo + hi) / 4) AS low, 2 * floor((lo + hi) / 4) + 2 AS high, abs(2 * floor((lo + hi) / 4) - lo) > 1e-9 OR abs(2 * floor((lo + hi) / 4) + 2 - hi) > 1e-9 AS moved FROM v""")
def grid_snap(spark, d):
    b = monthly(spark, d).select("doc_id", F.explode(X.bracket_intervals(F.col("text"))).alias("i"))
    return b.select("doc_id", F.col("i.low").alias("lo"), F.col("i.high").alias("hi"), X.snapped(F.col("i.low"), F.col("i.high")).alias("s")).select("doc_id", "lo", "hi", "s.*")


@query(f"""WITH {MONTHLY}, x AS (SELECT doc_id, regexp_extract_all(text, '(?i)[iîÎ]ntre\\s+(-?\\d+(?:\\.\\d+)?)\\s+(?:si|și|ȘI)\\s+(-?\\d+(?:\\.\\d+)?)', 1) AS a, regexp_extract_all(text, '(?i)\\bpeste\\s+(-?\\d+(?:\\.\\d+)?)\\s*°\\s*C', 1) AS p FROM m) SELECT doc_id, CAST(len(a) AS BIGINT) AS n_between, CAST(len(p) AS BIGINT) AS n_over, round(list_sum(list_transform(p, lambda v: CAST(v AS DOUBLE))), 6) AS sum_over FROM x""")
def worded_intervals(spark, d):
    w = monthly(spark, d).select("doc_id", X.worded_intervals(F.col("text")).alias("w"), F.regexp_extract_all("text", F.lit(r"(?iu)\bpeste\s+(-?\d+(?:\.\d+)?)\s*°\s*C"), F.lit(1)).alias("p"))
    total = F.aggregate(F.transform("p", lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return w.select("doc_id", (F.size("w") - F.size("p")).alias("n_between"), F.size("p").alias("n_over"), F.when(F.size("p") > 0, F.round(total, 6)).alias("sum_over"))


# the same zones in SQL: every place of every phrase is looked at, and a phrase keeps its place if none of better rank overlaps it
_q = lambda x: "'" + x.replace("'", "''") + "'"
_WORDS_SQL = "vocab(phrase, axis, zone, rk) AS (VALUES " + ", ".join(f"({_q(p)}, {_q(a)}, {_q(z)}, {i})" for i, (p, a, z) in enumerate(Z.vocabulary())) + ")"
_SIDES_SQL = "sides(word, side, rk) AS (VALUES " + ", ".join(f"({_q(w)}, {_q(x)}, {i})" for i, (w, x) in enumerate(Z.directions())) + ")"
_NEUTRAL_SQL = "(^|[^a-z0-9])(" + "|".join(Z.NEUTRAL) + ")($|[^a-z0-9])"
SENTENCES = f"""{MONTHLY}, sent AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS sentence, parts[i] AS s FROM (SELECT doc_id, string_split(regexp_replace(text, '\\.\\s+', '.' || chr(1), 'g'), chr(1)) AS parts FROM m), unnest(generate_series(1, len(parts))) AS g(i))"""
ZONES = f"""{_WORDS_SQL}, {_SIDES_SQL}, {{source}},
pl AS (SELECT *, lower(translate(s, '{X.ACCENTED}', '{X.PLAIN}')) AS p FROM src),
hit AS (SELECT doc_id, sentence, s, p, i AS start, i + length(phrase) AS stop, axis, zone, rk FROM pl, vocab, unnest(generate_series(0, length(p) - length(phrase))) AS g(i)
  WHERE contains(p, phrase) AND substr(p, i + 1, length(phrase)) = phrase AND (i = 0 OR NOT regexp_matches(substr(p, i, 1), '[a-z0-9]')) AND NOT regexp_matches(substr(p, i + 1 + length(phrase), 1), '[a-z0-9]')),
kept AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.doc_id = h.doc_id AND o.sentence = h.sentence AND o.rk < h.rk AND o.start < h.stop AND h.start < o.stop)),
win AS (SELECT *, CASE WHEN start = 0 THEN '' ELSE substr(p, greatest(start - {Z.LOOK_BACK}, 0) + 1, least(start, {Z.LOOK_BACK})) END AS before FROM kept),
z AS (SELECT doc_id, sentence, start, substr(s, start + 1, stop - start) AS raw, axis, zone, CASE WHEN axis <> 'climatic' AND NOT regexp_matches(before, '{_NEUTRAL_SQL}') THEN (SELECT arg_min(side, sides.rk) FROM sides WHERE regexp_matches(before, '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')) END AS cardinal FROM win)"""
WHOLE = ZONES.format(source=f"{MONTHLY}, src AS (SELECT doc_id, 0 AS sentence, text AS s FROM m)")
PARTS = ZONES.format(source=f"{SENTENCES}, src AS (SELECT * FROM sent)")


@query(f"WITH {WHOLE} SELECT doc_id, raw, axis, zone, cardinal, CAST(start AS BIGINT) AS start FROM z")
def zone_extraction(spark, d):
    return monthly(spark, d).select("doc_id", F.explode(Z.zones_of(F.col("text"))).alias("z")).select("doc_id", "z.*")


_N = r"(-?\d+(?:\.\d+)?)"
_U = r"(?:°\s*C|deg\s*C|grad[ei]?(?:\s+Celsius)?|C\b)"
_FORM_SQL = [(rf"\[\s*{_N}\s*,\s*{_N}\s*\](?:\s*°?\s*C)?", "a", "b"), (rf"[iîÎ]ntre\s+{_N}\s+[sșSȘ]i\s+{_N}(?:\s*{_U})?", "a", "b"), (rf"\bpeste\s+{_N}\s*{_U}", "a", "a + 2"), (rf"\bsub\s+{_N}\s*{_U}", "a - 2", "a")]


def _form(k: int) -> str:
    p, low, high = _FORM_SQL[k]
    b = f"CAST(nullif(regexp_extract(h[i], '(?i){p}', 2), '') AS DOUBLE)" if k < 2 else "NULL"
    at = "list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(h, 1, i - 1), lambda x: length(x))), 0)"
    return f"SELECT doc_id, sentence, {k} * 1000 + i AS place, {low} AS low, {high} AS high, pos + len / 2 AS middle FROM (SELECT doc_id, sentence, i, CAST(regexp_extract(h[i], '(?i){p}', 1) AS DOUBLE) AS a, {b} AS b, {at} AS pos, length(h[i]) AS len FROM (SELECT doc_id, sentence, regexp_extract_all(s, '(?i){p}') AS h, string_split_regex(s, '(?i){p}') AS g FROM sent), unnest(generate_series(1, len(h))) AS k(i))"


PREDICTED = f"""{PARTS}, iv AS ({' UNION ALL '.join(_form(k) for k in range(4))}),
near AS (SELECT z.doc_id, z.sentence, z.start, z.axis, z.zone, z.cardinal, iv.low, iv.high, row_number() OVER (PARTITION BY z.doc_id, z.sentence, z.start ORDER BY abs(z.start - iv.middle), iv.place) AS rn FROM z JOIN iv ON z.doc_id = iv.doc_id AND z.sentence = iv.sentence),
pred AS (SELECT doc_id, sentence, start, axis, zone, cardinal, 2 * floor((low + high) / 4) AS low, 2 * floor((low + high) / 4) + 2 AS high, abs(2 * floor((low + high) / 4) - low) > 1e-9 OR abs(2 * floor((low + high) / 4) + 2 - high) > 1e-9 AS moved FROM near WHERE rn = 1)"""


@query(f"WITH {PREDICTED} SELECT doc_id, sentence, CAST(start AS BIGINT) AS start, axis, zone, cardinal, low, high, moved FROM pred")
def zone_predictions(spark, d):
    return Z.predictions(monthly(spark, d), "doc_id", "text")


@query(f"WITH {PREDICTED} SELECT doc_id, count(*) AS n_intervals, count(*) FILTER (WHERE moved) AS n_moved, round(1 - count(*) FILTER (WHERE moved) / count(*), 6) AS compliance FROM pred GROUP BY 1")
def interval_compliance(spark, d):
    """How many predictions of each paragraph lay on the grid of two degrees."""
    got = Z.compliance(Z.predictions(monthly(spark, d), "doc_id", "text"), ["doc_id"])
    return got.withColumn("compliance", F.round("compliance", 6))


# the registry has regions and counties but no directions and no climatic zones: these are stand-ins by county and by the last letter of the station
ZONE_TABLE = f"""reg AS (SELECT entity, parent AS pr, grp AS county, CASE parent WHEN 'MUNTENIA' THEN 'Muntenia' WHEN 'MOLDOVA' THEN 'Moldova' WHEN 'OLTENIA' THEN 'Oltenia' WHEN 'BANAT' THEN 'Banat-Crisana' END AS region, CASE grp WHEN 'BUCURESTI' THEN 'S' WHEN 'ILFOV' THEN 'N' WHEN 'DOLJ' THEN 'S' WHEN 'TIMIS' THEN 'V' WHEN 'IASI' THEN 'N' END AS cardinal FROM dim),
names AS (SELECT 'region' AS axis, region AS zone, cardinal, entity, county FROM reg WHERE region IS NOT NULL UNION ALL SELECT 'region_part', u.z, cardinal, entity, county FROM reg, (VALUES ('Banat'), ('Crisana')) u(z) WHERE region = 'Banat-Crisana'),
zt AS (SELECT axis, zone, NULL AS cardinal, entity, county FROM names UNION SELECT * FROM names WHERE cardinal IS NOT NULL UNION SELECT 'climatic', CASE WHEN entity LIKE '%A' THEN 'Litoral' ELSE 'Câmpie (zone joase extracarpatice)' END, NULL, entity, county FROM reg WHERE entity LIKE '%A' OR entity LIKE '%1')"""
_REGION_OF = {"MUNTENIA": "Muntenia", "MOLDOVA": "Moldova", "OLTENIA": "Oltenia", "BANAT": "Banat-Crisana"}
_SIDE_OF = {"BUCURESTI": "S", "ILFOV": "N", "DOLJ": "S", "TIMIS": "V", "IASI": "N"}


def _zone_table(spark, d):
    from brumar.plans.sensors import dim

    pick = lambda c, m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)]
    st = dim(spark, d).select("entity", pick("parent", _REGION_OF).alias("region"), F.col("grp").alias("county"), pick("grp", _SIDE_OF).alias("cardinal"))
    climatic = st.where("entity like '%A' or entity like '%1'").select(F.when(F.col("entity").like("%A"), "Litoral").otherwise("Câmpie (zone joase extracarpatice)").alias("zone"), "entity")
    return Z.zone_table(st, climatic)


@query("WITH {dim}, {zt}, {p} SELECT doc_id, pred.axis, pred.zone, pred.cardinal, count(*) AS n_stations FROM pred JOIN zt ON pred.axis = zt.axis AND pred.zone = zt.zone AND pred.cardinal IS NOT DISTINCT FROM zt.cardinal GROUP BY ALL")
def zone_stations(spark, d):
    """How many stations the predicted zones of each paragraph cover."""
    return Z.at_stations(Z.predictions(monthly(spark, d), "doc_id", "text"), _zone_table(spark, d)).groupBy("doc_id", "axis", "zone", "cardinal").agg(F.count(F.lit(1)).alias("n_stations"))


@query("WITH {dim}, {zt}, {p}, c AS (SELECT zt.axis, zt.zone, zt.cardinal, county, min(entity) AS f FROM zt WHERE county IS NOT NULL AND EXISTS (SELECT 1 FROM pred WHERE pred.axis = zt.axis AND pred.zone = zt.zone AND pred.cardinal IS NOT DISTINCT FROM zt.cardinal) GROUP BY ALL) SELECT axis, zone, cardinal, string_agg(county, ',' ORDER BY f, county) AS counties FROM c GROUP BY ALL")
def zone_counties(spark, d):
    """The counties of every zone that a paragraph predicts."""
    return Z.counties(Z.predictions(monthly(spark, d), "doc_id", "text"), _zone_table(spark, d))


@query("WITH {dim}, {zt}, {p}, s AS (SELECT doc_id, entity, low, high, row_number() OVER (PARTITION BY doc_id, entity ORDER BY sentence DESC, start DESC) AS rn FROM pred JOIN zt ON pred.axis = zt.axis AND pred.zone = zt.zone AND pred.cardinal IS NOT DISTINCT FROM zt.cardinal) SELECT doc_id, entity, low, high FROM s WHERE rn = 1")
def zone_last_mention(spark, d):
    """The interval of every station that a paragraph covers: that of its last mention."""
    return _station_intervals(spark, d).select("doc_id", "entity", "low", "high")


def _station_intervals(spark, d):
    named = Z.at_stations(Z.predictions(monthly(spark, d), "doc_id", "text"), _zone_table(spark, d))
    return Z.last_mention(named, ["doc_id", "entity"], ["sentence", "start"])


@query(f"WITH {WHOLE} SELECT doc_id, axis, zone, cardinal, arg_min(raw, start) AS raw, CAST(min(start) AS BIGINT) AS start FROM z GROUP BY ALL")
def zone_first_mention(spark, d):
    z = monthly(spark, d).select("doc_id", F.explode(Z.zones_of(F.col("text"))).alias("z")).select("doc_id", "z.*")
    return Z.first_mention(z, ["doc_id"], ["start"])


@query(f"WITH {WHOLE} SELECT CASE WHEN cardinal IS NOT NULL AND axis IN ('region', 'region_part', 'subregion') THEN zone || ' (' || CASE cardinal WHEN 'N' THEN 'nord' WHEN 'S' THEN 'sud' WHEN 'E' THEN 'est' ELSE 'vest' END || ')' ELSE zone END AS label, count(*) AS n FROM z GROUP BY 1")
def zone_labels(spark, d):
    """How often each zone is named, under its label."""
    z = monthly(spark, d).select(F.explode(Z.zones_of(F.col("text"))).alias("z")).select("z.*")
    return z.groupBy(Z.label(F.col("axis"), F.col("zone"), F.col("cardinal")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH {dim}, {daily}, {zt}, {p}, v AS (SELECT entity, avg((tmax + tmin) / 2) AS t FROM daily WHERE tmax IS NOT NULL AND tmin IS NOT NULL GROUP BY 1),
w AS ({whole}), tr AS (SELECT DISTINCT doc_id, entity FROM w JOIN zt ON w.axis = zt.axis AND w.zone = zt.zone AND w.cardinal IS NOT DISTINCT FROM zt.cardinal),
pr AS (SELECT doc_id, entity, low, high FROM (SELECT doc_id, entity, low, high, row_number() OVER (PARTITION BY doc_id, entity ORDER BY sentence DESC, start DESC) AS rn FROM pred JOIN zt ON pred.axis = zt.axis AND pred.zone = zt.zone AND pred.cardinal IS NOT DISTINCT FROM zt.cardinal WHERE low >= 0) WHERE rn = 1),
j AS (SELECT coalesce(tr.doc_id, pr.doc_id) AS doc_id, coalesce(tr.entity, pr.entity) AS entity, tr.entity IS NOT NULL AS a, pr.entity IS NOT NULL AS b, low, high FROM tr FULL JOIN pr ON tr.doc_id = pr.doc_id AND tr.entity = pr.entity),
s AS (SELECT doc_id, a, b, t, CASE WHEN t IS NULL THEN NULL WHEN a AND b THEN greatest(0, low - t, t - high) WHEN a THEN 2.0 ELSE greatest(2.0, low - t, t - high) END AS dd FROM j LEFT JOIN v ON j.entity = v.entity)
SELECT doc_id, round(coalesce(avg(dd), 2.0), 4)::DOUBLE AS d_bar, count(*) FILTER (WHERE t IS NOT NULL AND a AND b) AS n_intersection, count(*) FILTER (WHERE t IS NOT NULL AND a AND NOT b) AS n_missed, count(*) FILTER (WHERE t IS NOT NULL AND NOT a) AS n_false_positive, count(*) FILTER (WHERE t IS NULL) AS n_unscorable, round(1 / (1 + coalesce(avg(dd), 2.0) / 2), 4)::DOUBLE AS accuracy FROM s GROUP BY 1""")
def interval_distance_score(spark, d):
    """Scores the predictions of every paragraph at the stations they resolve to.

    Expected are the stations of all zones that the paragraph names; predicted are those with an interval not below zero, the
    last mention of a station counting; true values are the mean temperatures of the stations.
    """
    from brumar.plans.sensors import daily

    tab = _zone_table(spark, d)
    named = monthly(spark, d).select("doc_id", F.explode(Z.zones_of(F.col("text"))).alias("z")).select("doc_id", "z.axis", "z.zone", "z.cardinal")
    pred = Z.last_mention(Z.at_stations(Z.predictions(monthly(spark, d), "doc_id", "text").where("low >= 0"), tab), ["doc_id", "entity"], ["sentence", "start"])
    value = daily(spark, d).where("tmax is not null and tmin is not null").groupBy("entity").agg(F.avg((F.col("tmax") + F.col("tmin")) / 2).alias("t"))
    s = Z.interval_score(Z.at_stations(named, tab), pred, value, ["doc_id"])
    return s.select("doc_id", F.round("d_bar", 4).alias("d_bar"), *[c for c in s.columns if c.startswith("n_")], F.round("accuracy", 4).alias("accuracy"))


def _fill_in() -> None:
    from brumar.plans.registry import SQL
    from brumar.plans.sensors import DAILY, DIM

    whole = f"WITH {WHOLE} SELECT doc_id, axis, zone, cardinal FROM z"
    for k in ("zone_stations", "zone_counties", "zone_last_mention", "interval_distance_score"):
        SQL[k] = SQL[k].replace("{daily}", DAILY).replace("{dim}", DIM).replace("{zt}", ZONE_TABLE).replace("{p}", PREDICTED).replace("{whole}", whole)


_fill_in()

_QUALIFIED_SQL = r"(?:\b(sub|peste|de\s+la|p[aâÂ]n[aăĂ](?:\s+la)?|[iîÎ]ntre)\s+)?\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\](?:\s*(?:°\s*C|deg\s*C|C))?"
FLUENT = f"""{MONTHLY}, h AS (SELECT doc_id, text, regexp_extract_all(text, '(?i){_QUALIFIED_SQL}') AS hs, string_split_regex(text, '(?i){_QUALIFIED_SQL}') AS gs FROM m),
c AS (SELECT doc_id, text, gs, list_transform(hs, lambda x: struct_pack(q := lower(translate(regexp_replace(regexp_extract(x, '(?i){_QUALIFIED_SQL}', 1), '\\s+', ' ', 'g'), '{X.ACCENTED}', '{X.PLAIN}')), x := CAST(2 * floor((CAST(regexp_extract(x, '(?i){_QUALIFIED_SQL}', 2) AS DOUBLE) + CAST(regexp_extract(x, '(?i){_QUALIFIED_SQL}', 3) AS DOUBLE)) / 4) AS BIGINT))) AS cs FROM h),
e AS (SELECT *, list_min(list_transform(cs, lambda y: y.x)) AS lo, list_max(list_transform(cs, lambda y: y.x)) AS hi FROM c),
o AS (SELECT doc_id, text, gs, list_transform(cs, lambda y: CASE WHEN y.q IN ('sub', 'de la') AND y.x = lo THEN y.q || ' ' || y.x || ' °C' WHEN y.q = 'peste' AND y.x = hi THEN 'peste ' || (y.x + 2) || ' °C' WHEN y.q IN ('pana', 'pana la') AND y.x = hi THEN 'pana la ' || (y.x + 2) || ' °C' ELSE 'intre ' || y.x || ' si ' || (y.x + 2) || ' °C' END) AS ws FROM e),
f AS (SELECT doc_id, text, array_to_string(list_transform(gs, lambda g, i: g || coalesce(ws[i], '')), '') AS fluent FROM o)"""


@query(f"WITH {FLUENT} SELECT doc_id, fluent FROM f")
def bracket_rewrite(spark, d):
    return monthly(spark, d).select("doc_id", Z.rewritten(F.col("text")).alias("fluent"))


@query(f"WITH {FLUENT} SELECT count(*) AS n_paragraphs, count(*) FILTER (WHERE fluent <> text) AS n_changed FROM f")
def rewrite_refresh(spark, d):
    """How many paragraphs a new run of the rewriter would change."""
    m = monthly(spark, d).withColumn("fluent", Z.rewritten(F.col("text")))
    return m.agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(F.col("fluent") != F.col("text")).alias("n_changed"))


@query(f"""WITH {DOCS}, l AS (SELECT doc_id, regexp_split_to_array(text, '\\n') AS ls FROM d WHERE text LIKE '%ZIUA ȚINTĂ%'), x AS (SELECT doc_id, ls, len(ls) AS n, list_position(list_transform(ls, lambda s: starts_with(s, 'ZIUA ȚINTĂ')), true) AS a, coalesce(list_position(list_transform(ls, lambda s: starts_with(s, 'ZILELE DINAINTE')), true), list_position(list_transform(ls, lambda s: starts_with(s, 'Scrie diagnoza')), true), len(ls) + 1) AS b FROM l)
SELECT doc_id, array_to_string(list_slice(ls, a + 1, b - 1), chr(10)) AS section FROM x WHERE a IS NOT NULL""")
def section_slice(spark, d):
    """The lines between a header and the first of its end markers, else to the end of the text."""
    ls = docs(spark, d).where(F.col("text").contains("ZIUA ȚINTĂ")).select("doc_id", F.split("text", "\n").alias("ls"))
    at = lambda mark: F.nullif(F.array_position(F.transform("ls", lambda s: F.startswith(s, F.lit(mark))), True), F.lit(0))
    x = ls.withColumn("a", at("ZIUA ȚINTĂ")).withColumn("b", F.coalesce(at("ZILELE DINAINTE"), at("Scrie diagnoza"), F.size("ls") + 1)).where("a is not null")
    return x.select("doc_id", F.array_join(F.slice("ls", (F.col("a") + 1).cast("int"), F.greatest(F.col("b") - F.col("a") - 1, F.lit(0)).cast("int")), "\n").alias("section"))
