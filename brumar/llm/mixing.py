"""Problem 8: mixing sources to target shares of all tokens, by balanced sampling with the cube method.

Sizes are tokens of a public tokenizer.  The total to reach is the tokens of all listed documents
once over (or a parameter).  A source that cannot give its share even at its highest number of uses
gives all it can; the others share what is left in proportion to their targets.  Every document of a
source then has the same expected number of uses: its whole part is given to all, the fractional part
is sampled.

Documents of more than a ``LARGE``-th of what is wanted of their source would leave the landing too much to
mend, so they are decided first, each by its own probability as long as the others can still make up for
it, and what is then wanted of the others is worked out anew.  The flight phase moves the fractional probabilities of three
documents at a time along the null space of the two balancing equations (documents, tokens) until one of them is decided.  It
runs in blocks of a source; what a block leaves undecided goes on to the next level, of a hundredth as many blocks, until one
block a source is left.  Every block leaves ``LAST`` documents of all sizes open. In the
last one these and the two that the flight left are decided together: of all their subsets within ``NEAR`` of the tokens they stand for, or else the nearest, one is drawn by its probability.

Defined results: documents without source, of a source that is not listed, or without tokens (null and
empty texts) are not used; a source without documents, with no share or no uses allowed gets nothing
and is reported with a real share of 0; several rows of one source add up their shares and the lowest
number of uses holds; an empty table gives an empty mix; more than ``MOST_SOURCES`` sources are an error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brumar.llm.tokens import VOCABULARY, encoded

BLOCK = 2000
#: sources in the target table, which are worked on by the driver; more are an error
MOST_SOURCES = 10_000
#: documents larger than this part of what is wanted of their source are decided first
LARGE = 20
#: documents kept for the landing, and how near (as a share of what is wanted) a landing is near enough
LAST, NEAR = 12, 0.002


def land(p: np.ndarray, n: np.ndarray, near: float, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for each of a few documents, so that their tokens come near those of their probabilities; drawn by likelihood."""
    picks = np.array(np.meshgrid(*[[0.0, 1.0]] * len(p), indexing="ij")).reshape(len(p), -1).T
    off = np.abs(picks @ n - p @ n)
    ok = np.flatnonzero(off <= max(near, off.min() + 1e-9))
    chance = (picks[ok] @ np.log(p)) + ((1 - picks[ok]) @ np.log1p(-p))
    chance = np.exp(chance - chance.max())
    return picks[ok[rng.choice(len(ok), p=chance / chance.sum())]]


def _spread(n: np.ndarray) -> np.ndarray:
    """Places of up to LAST documents from the smallest to the largest."""
    order = np.argsort(n, kind="stable")
    return order[np.unique(np.linspace(0, len(n) - 1, LAST).round().astype(int))] if len(n) else order


def flight(p: np.ndarray, n: np.ndarray, rng: np.random.Generator, landing: bool, near: float = 0.0) -> np.ndarray:
    """Probabilities after the flight phase, all 0 or 1 but for two at most; if landing, of the last documents too."""
    if landing:
        p = p.astype(float).copy()
        open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
        late = open_[_spread(n[open_])]
        held = p[late]
        p[late] = 0.0
        p = flight(p, n, rng, False)
        p[late] = held
        left = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
        if len(left):
            p[left] = land(p[left], n[left], near, rng)
        return np.round(p)
    p = p.astype(float).copy()
    size = n / max(float(n.max(initial=1)), 1.0)
    eps = 1e-9
    live: list[int] = []
    draw = rng.random(2 * len(p) + 8)
    k = 0
    order = iter(np.flatnonzero((p > eps) & (p < 1 - eps)).tolist())
    while True:
        while len(live) < 3:
            i = next(order, None)
            if i is None:
                break
            live.append(i)
        if len(live) == 3:
            a, b, c = (size[i] for i in live)
            u = (c - b, a - c, b - a)
            if abs(u[0]) + abs(u[1]) + abs(u[2]) < 1e-12:
                u = (1.0, -1.0, 0.0)
        else:
            break
        up = min(((1 - p[i]) / x if x > 0 else -p[i] / x) for i, x in zip(live, u) if abs(x) > 1e-15)
        down = min((p[i] / x if x > 0 else (p[i] - 1) / x) for i, x in zip(live, u) if abs(x) > 1e-15)
        step = up if draw[k % len(draw)] * (up + down) < down else -down
        k += 1
        for i, x in zip(live, u):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
        live = [i for i in live if eps < p[i] < 1 - eps]
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    return p


def needs(shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens of each source: its share of the total, or all it can give, with the rest shared by the others."""
    whole = sum(shares.values()) or 1.0
    full: set[str] = {s for s in shares if caps.get(s, 0.0) <= 0}
    got = {s: 0.0 for s in full}
    while True:
        rest = max(0.0, total - sum(got.values()))
        open_share = sum(v for s, v in shares.items() if s not in full) / whole
        want = {s: rest * (v / whole) / open_share if open_share > 0 else 0.0 for s, v in shares.items() if s not in full}
        over = [s for s, v in want.items() if v >= caps[s]]
        if not over:
            return got | want
        for s in over:
            full.add(s)
            got[s] = caps[s]


def _fly(level: int, last: bool):
    def fly(key, pdf):
        pdf = pdf.sort_values(["n", "id"], ascending=[False, True])
        rng = np.random.default_rng([level, int(key[1]), *str(key[0]).encode()])
        near = NEAR * float(pdf["wanted"].iloc[0])
        p, n = pdf["p"].to_numpy(float), pdf["n"].to_numpy(float)
        if last:
            return pdf.drop(columns="b").assign(p=flight(p, n, rng, True, near))
        held = _spread(n)  # a few of every block stay open for the landing
        early = np.setdiff1d(np.arange(len(p)), held)
        p[early] = flight(p[early], n[early], rng, False)
        return pdf.drop(columns="b").assign(p=p)

    return fly


def decide_large(n: np.ndarray, rate: float, wanted: float, others: float, cap: float, rng: np.random.Generator, most: int) -> np.ndarray:
    """Uses of the large documents of a source, the ``most`` largest of them: of the two whole numbers around the rate, drawn, unless the
    rest could not make up for it.  The others stay open (NaN) for the landing."""
    uses = np.full(len(n), np.nan)
    rest = others + n.sum()
    for i in np.argsort(-n, kind="stable")[: max(0, most)]:
        rest -= n[i]
        low = math.floor(rate + 1e-12)
        first = min(cap, low + float(rng.random() < rate - low))
        options = [first, *sorted({float(k) for k in range(int(cap) + 1)} - {first}, key=lambda k: abs(k - rate))]
        fits = [k for k in options if -1e-9 <= wanted - k * n[i] <= cap * rest + 1e-9]
        uses[i] = fits[0] if fits else min(options, key=lambda k: max(k * n[i] - wanted, wanted - k * n[i] - cap * rest))
        wanted -= uses[i] * n[i]
    return uses


def mixed(docs: DataFrame, target: DataFrame, row_id: str, text: str, source: str, total: float | None = None, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """((row id, source, n_tokens, uses) of the documents chosen, the report by source)."""
    spark = docs.sparkSession
    listed_sources = target.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeat").alias("most")).limit(MOST_SOURCES + 1).collect()
    if len(listed_sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the target table")
    goal = {r["source"]: (float(r["share"] or 0), int(r["most"] or 0)) for r in listed_sources}
    listed = docs.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")).where(F.col("source").isin(list(goal)))
    kind = docs.schema[row_id].dataType.simpleString()
    # the source travels through the encoder as part of the key
    sizes = encoded(listed.select(F.struct("id", "source").alias("key"), "text"), "key", "text", path).select(F.col("key.id").alias("id"), F.col("key.source").alias("source"), F.size("ids").cast("bigint").alias("n")).where("n > 0").persist(StorageLevel.MEMORY_AND_DISK)
    have = {r["source"]: (r["docs"], r["tokens"]) for r in sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")).collect()}
    caps = {s: have[s][1] * goal[s][1] if s in have else 0.0 for s in goal}
    wanted = needs({s: g[0] for s, g in goal.items()}, caps, float(sum(t for _, t in have.values())) if total is None else total)
    wanted = {s: float(x) for s, x in wanted.items()}
    rate = {s: min(float(goal[s][1]), wanted[s] / have[s][1]) for s in have}
    parts = lambda x: (float(math.floor(x + 1e-12)), max(0.0, float(x - math.floor(x + 1e-12))))
    first = spark.createDataFrame([(s, wanted[s]) for s in have if 1e-12 < parts(rate[s])[1]] or [("", 0.0)], "source string, wanted double")
    big = sizes.join(F.broadcast(first), "source").where(F.col("n") * LARGE > F.col("wanted"))

    def large(key, pdf):
        pdf, s = pdf.sort_values("id"), key[0]
        rng = np.random.default_rng([99, *str(s).encode()])
        n = pdf["n"].to_numpy(float)
        return pdf.assign(uses=decide_large(n, rate[s], wanted[s], have[s][1] - n.sum(), float(goal[s][1]), rng, have[s][0] - LAST - 2))[["id", "source", "n", "uses"]]

    big = big.select("id", "source", "n").groupBy("source").applyInPandas(large, f"id {kind}, source string, n bigint, uses double").persist(StorageLevel.MEMORY_AND_DISK)
    given = {r["source"]: (r["docs"], r["tokens"] or 0, r["used"] or 0.0) for r in big.where(F.col("uses").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("uses")).alias("used")).collect()}
    left = {}
    for s in have:
        d, t, used = given.get(s, (0, 0, 0.0))
        over = have[s][1] - t
        left[s] = (*parts(min(float(goal[s][1]), max(0.0, wanted[s] - used) / over) if over else 0.0), have[s][0] - d)
    plan = spark.createDataFrame([(s, wanted[s], *left[s]) for s in have] or [("", 0.0, 0.0, 0.0, 0)], "source string, wanted double, base double, p double, docs bigint")
    rest = sizes.join(F.broadcast(first), "source", "left").where((F.col("n") * LARGE <= F.col("wanted")) | F.col("wanted").isNull()).drop("wanted")
    rest = rest.unionByName(big.where(F.col("uses").isNull()).drop("uses"))
    state = rest.join(F.broadcast(plan), "source").select("id", "source", "n", "base", "p", "docs", "wanted")
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    done = [state.where(~undecided), big.where(F.col("uses").isNotNull()).select("id", "source", "n", F.col("uses").alias("base"), F.lit(0.0).alias("p"), F.lit(0).cast("bigint").alias("docs"), F.lit(0.0).alias("wanted"))]
    level, most = 0, max((x[2] for x in left.values()), default=0)
    shape = f"id {kind}, source string, n bigint, base double, p double, docs bigint, wanted double"
    state = state.where(undecided)
    while most:
        blocks = max(1, math.ceil(most / BLOCK))
        last = blocks == 1
        of = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("bigint")
        flown = state.withColumn("b", F.pmod(F.xxhash64("id", F.lit(level)), of)).groupBy("source", "b").applyInPandas(_fly(level, last), shape).withColumn("docs", (LAST + 2) * of)
        if not last:
            flown = flown.persist(StorageLevel.MEMORY_AND_DISK)
        done.append(flown if last else flown.where(~undecided))
        state = flown.where(undecided)
        if last:
            break
        most, level = (LAST + 2) * blocks, level + 1
    chosen = done[0]
    for d in done[1:]:
        chosen = chosen.unionByName(d)
    chosen = chosen.select(F.col("id").alias(row_id), "source", F.col("n").alias("n_tokens"), (F.col("base") + F.col("p")).cast("int").alias("uses")).where("uses > 0")
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_chosen"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    goals = spark.createDataFrame([(s, g[0], g[1], *(have.get(s) or (0, 0)), float(wanted[s])) for s, g in goal.items()] or [("", 0.0, 0, 0, 0, 0.0)], "source string, target_share double, max_repeat int, n_docs bigint, source_tokens bigint, wanted_tokens double").where("source <> ''")
    report = goals.join(used, "source", "left").na.fill(0)
    whole = chosen.agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("whole"))
    report = report.join(F.broadcast(whole)).withColumn("real_share", F.when(F.col("whole") > 0, F.col("tokens") / F.col("whole")).otherwise(0.0)).drop("whole")
    return chosen, report
