"""Problem 1: faulty measurements, judged against the normal behaviour of their source.

Three tests, each on its own:

* impossible: outside the physical range;
* stuck: a run of at least ``min_run`` successive equal non-zero readings.  Runs are
  found inside blocks of days and stitched over block borders, so that no task ever
  holds the series of a whole source;
* spike: robust principal components split the daily profile matrix (days x slots) of
  each block into a low-rank normal part, dense noise and a sparse part.  The sparse part
  decides: a reading is a spike where its sparse part is more than ``SPARSE`` times the noise
  of the block and more than ``USUAL`` times the usual spread of the source, for at most three
  readings.  An exact check follows that only takes away: at least ``JUMP`` of the sparse part
  must be a jump against the readings around it, which an hour of a gale is not.

Defined results: rows without source, time or usable value are never reported; copies
of one (source, time) count once in a run and are all reported; an empty table gives an
empty result; columns other than the four named ones are ignored; of a reading that is both
stuck and a spike the run is reported.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brumar.common import HOUR_US, micros, usable

DAY_US = 24 * HOUR_US
#: sparse part over block noise, over the source's spread, and the share of it that must be a jump
SPARSE, USUAL, JUMP = 8.0, 3.0, 0.75
#: readings on either side that a jump is measured against, and the longest spike
AROUND, LONGEST = 6, 3
#: the resolution, in units of the measurement, at which the usual spread is counted
GRAIN = 0.01


def robust_pca(d: np.ndarray, known: np.ndarray, rank: int = 2, cut: float = 4.0, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, float]:
    """(low-rank part, the rest, noise scale of the rest) by projections in turn.

    The low-rank part is the nearest matrix of ``rank`` to the cells that are known and not sparse; a cell is sparse where the
    rest exceeds ``cut`` times the noise, its median absolute size over all known cells.  The start is the medians of rows and
    columns, which no spike can move, so that a few huge cells can't become a component.
    """
    seen = np.where(known, d, np.nan)
    with np.errstate(all="ignore"):
        rows = np.nan_to_num(np.nanmedian(seen, axis=1))
        low = rows[:, None] + np.nan_to_num(np.nanmedian(seen - rows[:, None], axis=0))[None, :]
    dense = None
    for _ in range(rounds):
        rest = d - low
        noise = max(1.4826 * float(np.median(np.abs(rest[known]))), 0.05) if known.any() else 0.05
        now = known & (np.abs(rest) <= cut * noise)
        if dense is not None and (now == dense).all():
            break
        dense = now
        u, w, v = np.linalg.svd(np.where(dense, d, low), full_matrices=False)
        low = (u[:, :rank] * w[:rank]) @ v[:rank]
    return low, d - low, noise


def _around(v: np.ndarray, k: int) -> np.ndarray:
    """Median of up to k readings on either side, itself left out."""
    n = len(v)
    p = np.concatenate([np.full(k, np.nan), v, np.full(k, np.nan)])
    w = np.stack([p[i : i + n] for i in range(2 * k + 1) if i != k])
    with np.errstate(all="ignore"):
        return np.nanmedian(w, axis=0) if n > 1 else np.full(n, np.nan)


def sparse_part(t: np.ndarray, v: np.ndarray, decompose=robust_pca) -> np.ndarray:
    """What the normal daily profile leaves of each reading, 0 where it is no sparse cell; t ascending and distinct."""
    n = len(v)
    if n < 5:
        return np.zeros(n)
    slots = 24 if np.median(np.diff(t)) > 0.75 * HOUR_US else 48
    days, row = np.unique(t // DAY_US, return_inverse=True)
    cell = row * slots + (t % DAY_US) * slots // DAY_US
    center = np.median(v)
    count = np.bincount(cell, minlength=len(days) * slots)
    m = np.bincount(cell, v - center, len(days) * slots) / np.maximum(count, 1)
    low, _, noise = decompose(m.reshape(-1, slots), (count > 0).reshape(-1, slots))
    rest = v - center - low.ravel()[cell]
    return np.where(np.abs(rest) > SPARSE * noise, rest, 0.0)


def spike_mask(t: np.ndarray, v: np.ndarray, sigma: float, decompose=robust_pca) -> np.ndarray:
    """Spikes among the readings v at the times t (microseconds, ascending, distinct) of one source."""
    if not len(v):
        return np.zeros(0, bool)
    s = sparse_part(t, v, decompose)
    hit = (np.abs(s) > USUAL * max(sigma, 0.1)) & (np.sign(s) * (v - _around(v, AROUND)) > JUMP * np.abs(s))
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a > LONGEST:
            hit[a:b] = False
    return hit


def usual_spread(df: DataFrame, entity: str, value: str) -> DataFrame:
    """(entity, sigma): the distance of the quartiles of each source, exact over all its readings.

    Values are counted on a grid of ``GRAIN`` first, so a source that holds most of the rows adds up in every task.
    """
    grid = df.groupBy(entity, (F.round(F.col(value) / GRAIN) * GRAIN).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    q = grid.groupBy(entity).agg(F.expr("percentile(x, array(0.25, 0.75), n)").alias("q"))
    return q.select(entity, ((F.col("q")[1] - F.col("q")[0]) / 1.349).alias("sigma"))


def faulty_readings(df: DataFrame, entity: str, time: str, value: str, row_id: str, low: float = 0.0, high: float = 75.0, min_run: int = 8, block_days: int = 32) -> DataFrame:
    """(row id, tip) of every row whose reading is impossible, stuck or a spike."""
    base = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{entity}`").alias("e"), micros(F.col(f"`{time}`")).alias("t"), usable(F.col(f"`{value}`")).alias("v")).where("e is not null and t is not null and v is not null")
    possible = F.col("v").between(low, high)
    once = base.where(possible).groupBy("e", "t").agg(F.min_by("v", "id").alias("v"))
    # a block sees one more day on either side, so that its first and last readings have theirs around them
    width = block_days * DAY_US
    seen = once.withColumn("b", F.explode(F.sequence(F.floor((F.col("t") - DAY_US) / width), F.floor((F.col("t") + DAY_US) / width))))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sparse readings of a block, its long runs, and the first and last run, which may go on elsewhere; a run's times in one array."""
        pdf = pdf.sort_values("t")
        e, b = pdf["e"].iloc[0], int(pdf["b"].iloc[0])
        t, v = pdf["t"].to_numpy(), pdf["v"].to_numpy()
        own = t // width == b
        out = []
        s = sparse_part(t, v)
        ok = own & (np.sign(s) * (v - _around(v, AROUND)) > JUMP * np.abs(s)) & (s != 0)
        # the neighbours of a sparse reading are kept too: whether a spike is too long shows only once the spread is known
        wide = np.flatnonzero((s != 0) & (np.sign(s) * (v - _around(v, AROUND)) > JUMP * np.abs(s)))
        place = np.arange(len(v))
        group = np.cumsum(np.r_[True, np.diff(wide) > 1]) if len(wide) else wide
        for i, g in zip(wide, group):
            out.append((e, b, "spike", int(g), bool(ok[i]), float(v[i]), float(abs(s[i])), 1, int(place[i]), [int(t[i])]))
        t, v = t[own], v[own]
        if len(v):
            at = np.flatnonzero(np.r_[True, v[1:] != v[:-1], True])
            for i, (x, y) in enumerate(zip(at[:-1], at[1:])):
                border = i == 0 or i == len(at) - 2
                if border or (y - x >= min_run and v[x] != 0):
                    out.append((e, b, "border" if border else "run", i, True, float(v[x]), 0.0, int(y - x), int(t[x]), t[x:y].tolist()))
        return pd.DataFrame(out, columns=["e", "b", "what", "g", "own", "v", "s", "n", "t0", "ts"])

    got = seen.groupBy("e", "b").applyInPandas(find, "e string, b bigint, what string, g int, own boolean, v double, s double, n bigint, t0 bigint, ts array<bigint>")
    spread = usual_spread(base.where(possible), "e", "v")
    far = got.join(spread, "e").where((F.col("what") != "spike") | (F.col("s") > USUAL * F.greatest("sigma", F.lit(0.1))))
    # border runs are chained over the blocks of a source, two rows a block; spikes are counted within their stretch, where a
    # reading that fell to the spread test parts its neighbours
    border = F.col("what") == "border"
    far = far.withColumns({"b0": F.when(~border, F.col("b")), "g0": F.when(~border, F.col("g"))})
    w = Window.partitionBy("e", "what", "b0", "g0").orderBy("t0")
    far = far.withColumn("cut", F.when(border, F.coalesce(((F.col("v") != F.lag("v").over(w)) | (F.col("b") == F.lag("b").over(w))).cast("int"), F.lit(1))))
    far = far.withColumn("part", F.when(border, F.sum("cut").over(w)).when(F.col("what") == "spike", F.col("t0") - F.row_number().over(w)))
    far = far.withColumn("n", F.sum("n").over(Window.partitionBy("e", "what", "b0", "g0", "part")))
    is_spike = F.col("what") == "spike"
    far = far.where(F.when(is_spike, F.col("own") & (F.col("n") <= LONGEST)).otherwise((F.col("n") >= min_run) & (F.col("v") != 0)))
    flags = far.select("e", F.explode("ts").alias("t"), "v", F.when(is_spike, "spike").otherwise("stuck").alias("tip"))
    flags = flags.groupBy("e", "t").agg(F.max_by(F.struct("v", "tip"), "tip").alias("f"))
    # a reload with a slightly revised value is still the same faulty reading
    near = F.when(F.col("f.tip") == "stuck", F.col("v") == F.col("f.v")).otherwise(F.abs(F.col("v") - F.col("f.v")) <= F.greatest(F.lit(0.5), 0.05 * F.abs(F.col("f.v"))))
    rest = base.where(possible).join(flags, ["e", "t"]).where(near).select("id", F.col("f.tip").alias("tip"))
    impossible = base.where(~possible).select("id", F.lit("impossible").alias("tip"))
    return impossible.unionByName(rest).withColumnRenamed("id", row_id)
