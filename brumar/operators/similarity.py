"""Overlap of a text with a reference text: token sets, n-grams, longest common subsequence, vectors."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_overlap(a: Column, b: Column) -> list[Column]:
    """Jaccard index, share of b covered by a, share of a covered by b, of token sets; null where a union or set is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    of = lambda n, m: F.when(m > 0, n / m)
    return [of(both, every).alias("jaccard"), of(both, F.size(y)).alias("reference_coverage"), of(both, F.size(x)).alias("response_coverage")]


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of an array of tokens, joined by blanks."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n(df: DataFrame, row_id: str, a: str, b: str, n: int) -> DataFrame:
    """Clipped n-gram overlap of the token arrays a (response) and b (reference): precision, recall, f."""
    one = lambda c, name: df.select(row_id, F.explode(ngrams(F.col(c), n)).alias("g")).groupBy(row_id, "g").agg(F.count(F.lit(1)).alias(name))
    j = one(a, "na").join(one(b, "nb"), [row_id, "g"], "full").na.fill(0, ["na", "nb"])
    s = j.groupBy(row_id).agg(F.sum(F.least("na", "nb")).alias("both"), F.sum("na").alias("sa"), F.sum("nb").alias("sb"))
    p, r = F.when(F.col("sa") > 0, F.col("both") / F.col("sa")).otherwise(0.0), F.when(F.col("sb") > 0, F.col("both") / F.col("sb")).otherwise(0.0)
    return s.select(row_id, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"))


def common_subsequence(x: list, y: list) -> int:
    """Length of the longest common subsequence, with one bit a token of y."""
    at: dict = {}
    for j, t in enumerate(y):
        at[t] = at.get(t, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for t in x:
        hit = row & at.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(y) - row.bit_count()


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "f")]))
def rouge_l(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Precision, recall and F measure of the longest common subsequence of the token arrays a (response) and b (reference)."""
    out = []
    for x, y in zip(a, b):
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        n = common_subsequence(x, y)
        out.append((n / len(x) if x else 0.0, n / len(y) if y else 0.0, 2 * n / (len(x) + len(y)) if n else 0.0))
    return pd.DataFrame(out, columns=["precision", "recall", "f"])


@F.pandas_udf(T.DoubleType())
def meteor(a: pd.Series, b: pd.Series) -> pd.Series:
    """METEOR with exact matches only: a mean of precision and recall that leans to recall, less for every break in the order.

    A word of the response goes with the word of the reference that follows its neighbour's, else with the first one that is free.
    """

    def one(x, y):
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        free: dict = {}
        for j, t in enumerate(y):
            free.setdefault(t, {})[j] = None
        m = chunks = 0
        before, before_i = -2, -2
        for i, t in enumerate(x):
            if not free.get(t):
                continue
            j = before + 1 if before_i == i - 1 and before + 1 in free[t] else next(iter(free[t]))
            del free[t][j]
            chunks += not (before_i == i - 1 and j == before + 1)
            m, before, before_i = m + 1, j, i
        if not m:
            return 0.0
        p, r = m / len(x), m / len(y)
        return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def bleu(a: pd.Series, b: pd.Series) -> pd.Series:
    """BLEU of up to four words with a brevity penalty; an order without a match counts 0.1 matches."""

    def one(x, y):
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        if not x or not y:
            return 0.0
        logs = 0.0
        for n in range(1, 5):
            gx, gy = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (x, y))
            total, hit = max(1, sum(gx.values())), sum((gx & gy).values())
            if n == 1 and not hit:
                return 0.0
            logs += math.log((hit or 0.1) / total) / 4
        return math.exp(logs + min(0.0, 1 - len(y) / len(x)))

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def best_matches(df: DataFrame, row_id: str, text: str, vector: str, block: int = 512) -> DataFrame:
    """(row id, text, other, s): the highest cosine of every vector to a vector of every text, its own text included, never to itself.

    Every vector is compared with every other one, a block of vectors against a block at a time; the number of blocks
    follows the number of rows.  Null and zero vectors have no cosine and are left out.
    """
    kinds = dict(df.dtypes)
    v = df.select(F.col(row_id).alias("id"), F.col(text).alias("t"), F.col(vector).cast("array<double>").alias("v")).where(F.col("t").isNotNull() & F.exists("v", lambda x: x != 0))
    n = max(1, -(-v.count() // block))
    v = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = v.withColumnRenamed("b", "i").withColumn("j", each), v.withColumnRenamed("b", "j").withColumn("i", each)

    def unit(x: pd.DataFrame) -> np.ndarray:
        m = np.vstack(x["v"].to_numpy())
        m = m / np.abs(m).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def most(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": a["id"][:0], "t": a["t"][:0], "other": b["t"][:0], "s": pd.Series(dtype=float)})
        b = b.sort_values("t", kind="stable")
        s = unit(a) @ unit(b).T
        s[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = -np.inf
        others, starts = np.unique(b["t"].to_numpy(), return_index=True)
        top = np.maximum.reduceat(s, starts, axis=1)
        k = len(others)
        got = pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), k), "t": np.repeat(a["t"].to_numpy(), k), "other": np.tile(others, len(a)), "s": top.ravel()})
        return got[got["s"] > -np.inf]

    got = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(most, f"id {kinds[row_id]}, t {kinds[text]}, other {kinds[text]}, s double")
    return got.groupBy(F.col("id").alias(row_id), F.col("t").alias(text), "other").agg(F.max("s").alias("s"))


def greedy_match(best: DataFrame, text: str) -> DataFrame:
    """(text, other, precision, recall, f) from ``best_matches``: means of the best cosines of the vectors of a text and of those of the other."""
    m = best.groupBy(text, "other").agg(F.avg("s").alias("precision"), F.count(F.lit(1)).alias("n"))
    back = m.select(F.col("other").alias(text), F.col(text).alias("other"), F.col("precision").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return m.join(back, [text, "other"]).select(text, "other", "precision", "recall", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"), "n")
