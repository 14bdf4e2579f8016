"""Problem 4: filling missing values from similar records.

A mixture model of ``components`` classes, each with a Gaussian over the numeric fields and
a table over each categorical field, is fitted by expectation-maximisation.  The numeric fields
are taken relative to the source (its mean and spread), and the state of the network at the same
hour is a field too, so that a class describes "a reading like this one, at a time like this one".
Every step is one pass over all rows that adds up sufficient statistics (a few hundred numbers,
whatever the size of the table); nothing else reaches the driver.  Rounds end when the likelihood gains
less than ``gain`` of itself.  Missing numeric cells get their
conditional expectation, missing categorical cells the most probable value.

Defined results: a cell is missing if null, NaN, blank or a no-value code, the sky code 9 too;
faulty numbers are not missing but do not take part in the fit; a time is filled from the loading
time and stays null where that is null as well; rows without source use the overall mean; an empty
table gives an empty one; the result has the columns named here only, whatever else the input has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brumar.common import HOUR_US, from_micros, join_small, micros, usable, usable_text

OKTAS = 9  # 0..8 eighths; 9 stands for a sky that can't be seen
NUMERIC = ("z", "c", "g")  # wind relative to the source, of the network at that hour, loading delay
MOST_LABELS = 255  # distinct weather labels that can be filled in, the most frequent ones; all others stay as they are


def _start(k: int, labels: int, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Classes spread over the wind scale and the sky states."""
    at = np.linspace(-1.5, 1.5, k)
    mu = np.zeros((k, 3))
    mu[:, 0] = at
    mu[:, 1] = 0.5 * at[::-1] * np.where(np.arange(k) % 2, 1, -1)
    sky = np.full((k, OKTAS), 1 / OKTAS)
    for i in range(k):
        sky[i, (i * OKTAS) // k] += 0.5
    sky /= sky.sum(1, keepdims=True)
    lab = (counts + 1) / (counts + 1).sum()
    lab = np.tile(lab, (k, 1)) * (1 + 0.2 * np.sin(np.arange(k)[:, None] + np.arange(labels)[None, :]))
    return {"pi": np.full(k, 1 / k), "mu": mu, "cov": np.tile(np.eye(3), (k, 1, 1)), "sky": sky, "lab": lab / lab.sum(1, keepdims=True), "net": sky.copy()}


def _expect(p: dict[str, np.ndarray], x: np.ndarray, sky: np.ndarray, lab: np.ndarray, net: np.ndarray):
    """Responsibilities (n, k), conditional expectations (k, n, 3) and, by pattern of known fields, conditional covariances."""
    n, k = len(x), len(p["pi"])
    logr = np.log(p["pi"]) + np.zeros((n, 1))
    for code, name in ((sky, "sky"), (lab, "lab"), (net, "net")):
        logr += np.vstack([np.log(p[name]).T, np.zeros(k)])[code]  # an unknown code, -1, meets the zeros
    full = np.empty((k, n, 3))
    pattern = (~np.isnan(x)) @ np.array([1, 2, 4])
    extra = np.zeros((8, k, 3, 3))
    for bits in np.flatnonzero(np.bincount(pattern, minlength=8)):
        rows = np.flatnonzero(pattern == bits)
        o = [j for j in range(3) if bits >> j & 1]
        m = [j for j in range(3) if not bits >> j & 1]
        seen = x[rows][:, o]
        for i in range(k):
            mu, cov = p["mu"][i], p["cov"][i]
            est = np.empty((len(rows), 3))
            if o:
                diff = seen - mu[o]
                # squares of what the Cholesky factor makes independent
                root = np.linalg.cholesky(np.linalg.inv(cov[np.ix_(o, o)]))
                white = diff @ root
                logr[rows, i] -= 0.5 * np.einsum("ij,ij->i", white, white) - np.log(np.diag(root)).sum() + 0.5 * len(o) * np.log(2 * np.pi)
                est[:, o] = seen
            if m:
                est[:, m] = mu[m]
                extra[bits, i] = 0.0
                extra[bits, i][np.ix_(m, m)] = cov[np.ix_(m, m)]
                if o:
                    gain = cov[np.ix_(m, o)] @ np.linalg.inv(cov[np.ix_(o, o)])
                    est[:, m] += diff @ gain.T
                    extra[bits, i][np.ix_(m, m)] -= gain @ cov[np.ix_(o, m)]
            full[i, rows] = est
    top = logr.max(1, keepdims=True)
    r = np.exp(logr - top)
    total = r.sum(1, keepdims=True)
    return r / total, full, extra, pattern, float((np.log(total) + top).sum())


def _statistics(p: dict[str, np.ndarray], x, sky, lab, net) -> np.ndarray:
    r, full, extra, pattern, fit = _expect(p, x, sky, lab, net)
    k = r.shape[1]
    by_pattern = np.stack([np.bincount(pattern, r[:, i], 8) for i in range(k)])
    second = np.stack([(full[i] * r[:, i, None]).T @ full[i] + np.einsum("b,bij->ij", by_pattern[i], extra[:, i]) for i in range(k)])
    parts = [r.sum(0), np.stack([r[:, i] @ full[i] for i in range(k)]), second]
    for code, name in ((sky, "sky"), (lab, "lab"), (net, "net")):
        known = code >= 0
        parts.append(np.stack([np.bincount(code[known], r[known, i], p[name].shape[1]) for i in range(k)]))
    return np.concatenate([q.ravel() for q in parts] + [np.array([fit])])


def _maximise(s: np.ndarray, k: int, labels: int) -> dict[str, np.ndarray]:
    cut = np.cumsum([k, 3 * k, 9 * k, OKTAS * k, labels * k, OKTAS * k])
    w, sx, sxx, sky, lab, net = np.split(s[: cut[-1]], cut[:-1])
    w = w + 1e-6
    mu = sx.reshape(k, 3) / w[:, None]
    cov = sxx.reshape(k, 3, 3) / w[:, None, None] - mu[:, :, None] * mu[:, None, :]
    share = lambda q, c: (q.reshape(k, c) + 0.01) / (q.reshape(k, c) + 0.01).sum(1, keepdims=True)
    return {"pi": w / w.sum(), "mu": mu, "cov": (cov + cov.transpose(0, 2, 1)) / 2 + 0.02 * np.eye(3), "sky": share(sky, OKTAS), "lab": share(lab, labels), "net": share(net, OKTAS)}


def _codes(pdf: pd.DataFrame):
    return pdf[list(NUMERIC)].to_numpy(float), pdf["sky"].to_numpy(int), pdf["lab"].to_numpy(int), pdf["net"].to_numpy(int)


def fill_readings(df: DataFrame, entity: str, time: str, value: str, sky: str, label: str, loaded: str, row_id: str, components: int = 8, rounds: int = 30, gain: float = 5e-3, low: float = 0.0, high: float = 75.0) -> DataFrame:
    """The named columns with their missing cells filled, ``lipsa`` (names of the missing cells) and ``umplut`` (of those filled)."""
    spark = df.sparkSession
    c = lambda name: F.col(f"`{name}`")
    base = df.select(c(row_id).alias("id"), c(entity).alias("e"), micros(c(time)).alias("t"), usable(c(value)).alias("v"), usable_text(c(sky)).alias("n0"), usable_text(c(label)).alias("f"), micros(c(loaded)).alias("l"))
    okta = F.expr("try_cast(n0 as double)")
    base = base.withColumn("n", F.when(okta == 9, None).otherwise(F.col("n0"))).withColumn("sky", F.when(okta.between(0, OKTAS - 1), okta.cast("int")))
    fit_v = F.when(F.col("v").between(low, high), F.col("v"))
    gap = (F.col("l") - F.col("t")) / 1e6
    delay = F.when(gap.isNotNull(), F.log1p(F.greatest(F.lit(0.0), gap)))
    base = base.withColumn("w", fit_v).withColumn("d", delay).withColumn("hr", F.floor(F.coalesce("t", "l") / HOUR_US))
    # what is normal at each source and, for rows without one, over all
    sums = base.groupBy("e").agg(*[f(c).alias(n + c) for c in ("w", "d") for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_pop, "v"))]).persist()
    total = lambda c: [F.sum("n" + c), F.sum(F.col("n" + c) * F.col("m" + c)), F.sum(F.col("n" + c) * (F.col("v" + c) + F.col("m" + c) ** 2))]
    o = sums.agg(*total("w"), *total("d")).first()
    overall = []
    for n, x, xx in (o[:3], o[3:]):
        mean = x / n if n else 0.0
        overall += [mean, max(xx / n - mean * mean, 0.0) ** 0.5 if n else 1.0]
    with_stats = join_small(base, sums.select("e", F.col("mw").alias("wm"), F.sqrt("vw").alias("ws"), F.col("md").alias("dm"), F.sqrt("vd").alias("ds")), ["e"], "left")
    for name, alt in zip(("wm", "ws", "dm", "ds"), overall):
        with_stats = with_stats.withColumn(name, F.coalesce(name, F.lit(alt)))
    clip = lambda q: F.when(q.isNotNull(), F.greatest(F.lit(-4.0), F.least(F.lit(4.0), q)))  # greatest and least pass over nulls
    with_stats = with_stats.withColumn("z", clip((F.col("w") - F.col("wm")) / F.greatest("ws", F.lit(0.1)))).withColumn("g", clip((F.col("d") - F.col("dm")) / F.greatest("ds", F.lit(0.1))))
    # the network at the same hour
    hours = with_stats.groupBy("hr").agg(F.avg("z").alias("c"), F.mode("sky").alias("net"))
    # labels that can be filled in: at most MOST_LABELS, so their list is bounded; none is left out in silence
    top = base.where("f is not null").groupBy("f").count().orderBy(F.desc("count"), "f").limit(MOST_LABELS + 1).collect()
    if len(top) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    names = [r["f"] for r in top] or [""]
    number = F.map_from_arrays(F.array(*[F.lit(q) for q in names]), F.array(*[F.lit(i) for i in range(len(names))]))
    feats = (
        join_small(with_stats, hours, ["hr"], "left")
        .select("id", "e", "t", "l", "v", "n", "f", "wm", "ws", "dm", "ds", "z", "c", "g", F.coalesce("sky", F.lit(-1)).alias("sky"), F.coalesce("net", F.lit(-1)).alias("net"), F.coalesce(F.try_element_at(number, F.col("f")), F.lit(-1)).alias("lab"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    labels = len(names)
    model = _start(components, labels, np.array([r["count"] for r in top] or [1.0], float))
    before = None
    for _ in range(rounds):

        def add_up(batches: Iterator[pd.DataFrame], p=model) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                if len(pdf):
                    s = _statistics(p, *_codes(pdf))
                    total = s if total is None else total + s
            if total is not None:
                yield pd.DataFrame({"at": np.arange(len(total)), "s": total})

        got = feats.select(*NUMERIC, "sky", "lab", "net").mapInPandas(add_up, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
        if not got:
            break
        stats = np.array([r["s"] for r in got])
        model = _maximise(stats, components, labels)
        # the last number is the log-likelihood under the model before; the fit ends when it hardly gains
        if before is not None and stats[-1] - before < gain * abs(before):
            break
        before = stats[-1]

    def fill(batches: Iterator[pd.DataFrame], p=model) -> Iterator[pd.DataFrame]:
        words = np.array(names, object)
        for pdf in batches:
            if not len(pdf):
                continue
            x, s, lab, net = _codes(pdf)
            r, full, _, _, _ = _expect(p, x, s, lab, net)
            est = sum(r[:, i, None] * full[i] for i in range(r.shape[1]))
            gone = {q: pdf[q].isna().to_numpy() for q in ("v", "n", "f", "t")}
            wind = np.round(np.clip(pdf["wm"] + est[:, 0] * np.maximum(pdf["ws"], 0.1), low, high), 1)
            late = np.expm1(np.clip(pdf["dm"] + est[:, 2] * np.maximum(pdf["ds"], 0.1), 0, 30))
            when = pdf["l"].astype("Int64") - pd.Series(np.nan_to_num(late) * 1e6, index=pdf.index).round().astype("int64")
            yield pd.DataFrame(
                {
                    "id": pdf["id"], "e": pdf["e"],
                    "t": pdf["t"].astype("Int64").where(~gone["t"], when),
                    "v": pdf["v"].where(~gone["v"], wind),
                    "n": pdf["n"].where(~gone["n"], pd.Series((r @ p["sky"]).argmax(1).astype(str), index=pdf.index)),
                    "f": pdf["f"].where(~gone["f"], pd.Series(words[(r @ p["lab"]).argmax(1)], index=pdf.index)),
                    "l": pdf["l"].astype("Int64"), "mv": gone["v"], "mn": gone["n"], "mf": gone["f"], "mt": gone["t"],
                }
            )

    out = feats.drop("hr").mapInPandas(fill, "id bigint, e string, t bigint, v double, n string, f string, l bigint, mv boolean, mn boolean, mf boolean, mt boolean")
    names_of = lambda *pairs: F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))
    return out.select(
        F.col("id").alias(row_id), F.col("e").alias(entity), from_micros(F.col("t")).alias(time), F.col("v").alias(value), F.col("n").alias(sky), F.col("f").alias(label), from_micros(F.col("l")).alias(loaded),
        names_of((value, F.col("mv")), (sky, F.col("mn")), (label, F.col("mf")), (time, F.col("mt"))).alias("lipsa"),
        names_of((value, F.col("mv")), (sky, F.col("mn")), (label, F.col("mf") & (F.col("f") != "")), (time, F.col("mt") & F.col("t").isNotNull())).alias("umplut"),
    )
