"""All core queries and their SQL, collected from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows.

    Results show days as text and whole numbers as bigint; ``dates`` names the days of the SQL.
    """

    def add(f):
        def plain(spark, d):
            df = f(spark, d)
            cast = {"date": "string", "int": "bigint"}
            return df.select(*[df[f"`{c}`"].cast(cast[t]).alias(c) if t in cast else df[f"`{c}`"] for c, t in df.dtypes])

        plain.__name__, plain.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = plain
        if sql is not None:
            days = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            SQL[f.__name__] = f"SELECT * REPLACE ({days}) FROM ({sql})" if dates else sql
        return plain

    return add


def _load() -> None:
    from brumar.plans import datasets, experiments, extras, forecasts, problems, reports, sensors, texts  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
