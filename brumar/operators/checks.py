"""Checks before work: panels that fit together, files that are there, tables whose headers are the wanted ones."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_panels(panels: dict[str, DataFrame], day: str, group: str, value: str) -> int:
    """The number of days that all panels have; a panel with a missing value, other groups than the first or no common day is an error."""
    names, common, first = list(panels), None, None
    for name in names:
        p = panels[name]
        bad = p.where(F.col(value).isNull() | F.isnan(value)).limit(1).count()
        if bad:
            raise ValueError(f"{name} has missing values")
        groups = p.select(group).distinct()
        if first is None:
            first = groups
        elif first.exceptAll(groups).limit(1).count() or groups.exceptAll(first).limit(1).count():
            raise ValueError(f"{name} has other groups than {names[0]}")
        days = p.select(day).distinct()
        common = days if common is None else common.join(days, day, "left_semi")
    n = common.count() if common is not None else 0
    if not n:
        raise ValueError("the panels have no day in common")
    return n


def required_files(folder: str, names: list[str]) -> list[str]:
    """Paths of the named files; missing ones are an error that lists them all."""
    gone = [n for n in names if not (Path(folder) / n).exists()]
    if gone:
        raise FileNotFoundError(f"not in {folder}: {', '.join(gone)}")
    return [str(Path(folder) / n) for n in names]


def required_item(df: DataFrame, by: str, item: str, wanted) -> DataFrame:
    """The rows with the wanted item; a group of ``by`` without one is an error."""
    lacking = df.groupBy(by).agg(F.max(F.coalesce(F.col(item) == wanted, F.lit(False))).alias("has")).where("not has").orderBy(by).limit(5).collect()
    if lacking:
        raise ValueError(f"no {item} = {wanted} at {[r[by] for r in lacking]}")
    return df.where(F.col(item) == wanted)


def _norm(header: str | None) -> str:
    return " ".join((header or "").split()).lower()


def _alike(a: str, b: str, words: float, letters: float) -> bool:
    wa, wb = set(a.split()), set(b.split())
    if a in b or b in a or len(wa & wb) >= words * min(len(wa), len(wb)):
        return True
    ca, cb = a.replace(" ", ""), b.replace(" ", "")
    return bool(ca and cb) and sum(c in cb for c in ca) >= letters * max(len(ca), len(cb))


def headers_match(found: list[str | None], wanted: list[str], exact: bool = False, share: float = 0.7, words: float = 0.6, letters: float = 0.7) -> bool:
    """Whether the headers of a table are the wanted ones.

    Exact: every wanted one is there.  Else ``share`` of the wanted ones resemble some header: one contains the other, they share
    ``words`` of the words of the shorter one, or ``letters`` of the letters of the longer one.  Case and white space don't count.
    """
    have, want = [_norm(h) for h in found if h is not None], [_norm(h) for h in wanted]
    if exact:
        return set(want) <= set(have)
    return sum(any(_alike(w, h, words, letters) for h in have) for w in want) >= share * len(want)


def continues(found: list[str | None], width: int) -> bool:
    """Whether the first row of a table on a next page is data of the table before: as wide, and with a number in it."""
    return len(found) == width and any((h or "").strip().replace(".", "", 1).lstrip("-").isdigit() for h in found)
