"""Problem 5: one consistent form for texts that look alike but differ in their characters.

The Arrow buffer of a whole batch becomes one array of code points.  Lookup tables give each
code point its replacement and the number of code points it expands to; marks are put in
canonical order and composed with their bases by searches in a sorted table.  No string
function is called for a row.

Two texts look the same here if they differ only in composed or combining accents, cedilla and
comma below s and t, full-width or styled forms, ligatures, kinds of space, degree signs, hyphens,
invisible characters, or Cyrillic and Greek letters drawn like Latin ones.  Digits, letter case,
words and accents that are there or not make a difference.

Defined results: null stays null, an empty text stays empty; line breaks are kept as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters they are drawn like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁԛԝһ", "ABESIJKMHOPCTXYaesijopcxydqwh"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
OTHER = {"º": "°", "˚": "°", "⁰": "°", "∘": "°", "℃": "°C", "℉": "°F", "‐": "-", "‑": "-", "−": "-", "﹣": "-", "ı": "i", "ˋ": "`"}
# Code points without width that Unicode does not class as format characters.
NO_WIDTH = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]
LIGATURES = range(0xFB00, 0xFB07)
COMMA, CEDILLA = 0x0326, 0x0327


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """Expansion tables, combining classes and compositions, made from the Unicode data of the interpreter by rule."""
    n = sys.maxunicode + 1
    lone = np.arange(n, dtype=np.uint32)
    many: dict[int, str] = {}
    invisible = set(NO_WIDTH)
    own = {ord(k): v for k, v in (CYRILLIC | GREEK | OTHER).items()}
    classes = np.zeros(n, np.uint8)
    pairs: dict[tuple[int, int], int] = {}
    for cp in range(0x80, 0x30000):
        if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        classes[cp] = unicodedata.combining(ch)
        if cp in invisible or cat == "Cf":
            many[cp] = ""
            continue
        if cat in ("Zs", "Zl", "Zp"):
            many[cp] = " "
            continue
        to = own.get(cp)
        if to is None:
            how = unicodedata.decomposition(ch)
            if how.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")) or cp in LIGATURES or 0x2160 <= cp < 0x2180:
                to = unicodedata.normalize("NFKC", ch)
        to = unicodedata.normalize("NFD", "".join(own.get(ord(c), c) for c in (ch if to is None else to)))
        if to != ch:
            many[cp] = to
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[a, b] = cp
    many[0x7F] = ""
    count = np.ones(n, np.int64)
    start = np.zeros(n, np.int64)
    flat: list[int] = []
    for cp, to in many.items():
        count[cp] = len(to)
        if len(to) == 1:
            lone[cp] = ord(to)
        elif to:
            start[cp] = len(flat)
            flat.extend(map(ord, to))
    keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
    joiners = np.array(sorted({b for _, b in pairs if not unicodedata.combining(chr(b))} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))), np.uint32)
    order = np.argsort(keys)
    return {"lone": lone, "count": count, "start": start, "flat": np.array(flat, np.uint32), "ccc": classes, "keys": keys[order], "composed": np.array(list(pairs.values()), np.uint32)[order], "joiners": joiners}


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The composed code point of each pair, 0 where there is none."""
    t = tables()
    a, b = a.astype(np.int64), b.astype(np.int64)
    key = (a << 21) | b
    where = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    got = np.where(t["keys"][where] == key, t["composed"][where], 0).astype(np.uint32)
    # Korean syllables are counted through: 19 first, 21 middle and 27 last sounds
    lead, vowel, tail = a - 0x1100, b - 0x1161, b - 0x11A7
    open_ = (lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21)
    got[open_] = 0xAC00 + (lead[open_] * 21 + vowel[open_]) * 28
    closed = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (tail > 0) & (tail < 28)
    got[closed] = a[closed] + tail[closed]
    return got


def consistent(array: pa.Array) -> pa.Array:
    """The consistent form of every text of an Arrow string array."""
    n = len(array)
    if not n:
        return pa.array([], pa.string())
    array = pa.concat_arrays([array.cast(pa.string()), pa.array([], pa.string())])
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off - off[0]]
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    t = tables()
    # gather the replacements; every row keeps its own stretch of the array
    size = t["count"][cps]
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(t["lone"][cps], size)
    wide = np.flatnonzero(size > 1)
    for j in range(int(size.max(initial=0))):
        at = wide[size[wide] > j]
        out[ends[at] + j] = t["flat"][t["start"][cps[at]] + j]
    row = ends[starts]
    breaks = np.zeros(len(out) + 1, bool)
    breaks[row] = True
    # canonical order of the marks on one base
    while len(out) > 1:
        c = t["ccc"][out]
        bad = np.flatnonzero((c[:-1] > c[1:]) & (c[1:] > 0) & ~breaks[1:-1])
        if not len(bad):
            break
        bad = bad[np.concatenate([[True], np.diff(bad) > 1])]
        out[bad], out[bad + 1] = out[bad + 1].copy(), out[bad].copy()
    # a mark joins its base unless one that stayed before it has the same class or a higher one
    keep = np.ones(len(out), bool)
    c = t["ccc"][out]
    marks = np.flatnonzero(c > 0)
    if len(marks):
        place = np.arange(len(out))
        base = np.maximum.accumulate(np.where((c == 0) | breaks[:-1], place, 0))
        depth = marks - base[marks]
        stayed = np.zeros(len(out), np.uint8)
        order = np.argsort(depth, kind="stable")
        for m in np.split(marks[order], np.flatnonzero(np.diff(depth[order])) + 1):
            m = m[base[m] < m]  # a mark without a base stays
            b = base[m]
            letter = out[b]
            soft = np.isin(letter, [ord(x) for x in "sStT"]) & (out[m] == CEDILLA)
            out[m[soft]] = COMMA
            joined = _joined(letter, out[m])
            hit = (joined > 0) & (stayed[b] < c[m])
            out[b[hit]] = joined[hit]
            keep[m[hit]] = False
            stayed[b[~hit]] = c[m[~hit]]
    row = np.concatenate([[0], np.cumsum(keep)])[row]
    out = out[keep]
    # signs without a class that join what stands right before them: vowel signs of some scripts, parts of Korean syllables
    while len(out) > 1 and np.isin(out, t["joiners"]).any():
        breaks = np.zeros(len(out) + 1, bool)
        breaks[row] = True
        joined = np.where(breaks[1:-1], 0, _joined(out[:-1], out[1:]))
        hit = np.flatnonzero(joined)
        if not len(hit):
            break
        hit = hit[np.concatenate([[True], np.diff(hit) > 1])]
        out[hit] = joined[hit]
        keep = np.ones(len(out), bool)
        keep[hit + 1] = False
        row = np.concatenate([[0], np.cumsum(keep)])[row]
        out = out[keep]
    wide8 = 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + (out > 0xFFFF)
    to = np.concatenate([[0], np.cumsum(wide8)])[row].astype(np.int32)
    text = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    valid = pa.py_buffer(np.packbits(np.asarray(array.is_valid()), bitorder="little").tobytes())
    return pa.StringArray.from_buffers(n, pa.py_buffer(to.tobytes()), pa.py_buffer(text), valid if array.null_count else None, array.null_count)


def with_consistent(df: DataFrame, text: str, to: str = "consistent") -> DataFrame:
    """df with the consistent form of its column ``text`` in the new column ``to``."""
    if to in df.columns:
        raise ValueError(f"the table already has a column {to}")
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, consistent(b.column(at))], [*b.schema.names, to])

    return df.mapInArrow(run, schema)


def alike_classes(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row id, class, n_rows, n_spellings): the class of each row, named by its form, and how many rows and spellings it has.

    Rows without text have no class.  Copies are counted, not paired.
    """
    rows = with_consistent(df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("x")), "x").where(F.col("consistent").rlike(r"\S"))
    m = rows.select("id", F.md5(F.col("consistent").cast("binary")).alias("class"), F.md5(F.col("x").cast("binary")).alias("r"))
    kinds = m.groupBy("class", "r").agg(F.count(F.lit(1)).alias("n")).groupBy("class").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_spellings"))
    return m.join(kinds, "class").select(F.col("id").alias(row_id), "class", "n_rows", "n_spellings")


def alike_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(a, b), a < b: every pair of rows whose texts look the same and are not the same sequence of characters.

    Copies are put into classes by their exact text first; classes are paired within one consistent
    form, and only then expanded to their rows, so that a group of copies is never compared with itself.
    """
    rows = with_consistent(df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("x")), "x")
    rows = rows.where(F.length(F.trim("consistent")) > 0).where(F.col("consistent").rlike(r"\S"))
    m = rows.select("id", F.unhex(F.md5(F.col("consistent").cast("binary"))).alias("k"), F.unhex(F.md5(F.col("x").cast("binary"))).alias("r")).persist(StorageLevel.MEMORY_AND_DISK)
    kinds = m.groupBy("k", "r").agg(F.count(F.lit(1)).alias("n"))
    several = kinds.groupBy("k").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("k")
    kinds = kinds.join(several, "k", "left_semi").select("k", "r")
    links = kinds.join(kinds.withColumnRenamed("r", "s"), "k").where("r <> s")
    a = m.withColumnRenamed("id", "a").join(links, ["k", "r"]).select("a", "k", "s")
    b = m.select(F.col("id").alias("b"), "k", F.col("r").alias("s"))
    return a.join(b, ["k", "s"]).where("a < b").select("a", "b")
