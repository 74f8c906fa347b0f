"""A module's book of queries: a DataFrame function and SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcells.plans.views import get, with_views


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``, as engines add in different orders."""
    return df.withColumns({n: F.round(F.col(n), places) for n, t in df.dtypes if t in ("double", "float")})


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, views: tuple[str, ...], sql: str | None):
        """The function gets the views as DataFrames (after spark and sf_dir if
        ``views`` begins with "*"); its doubles are rounded."""
        raw = views[:1] == ("*",)
        used = views[1:] if raw else views

        def wrap(fn):
            def query(spark, sf_dir):
                frames = [get(spark, sf_dir, v) for v in used]
                return rounded(fn(spark, sf_dir, *frames) if raw else fn(*frames))

            query.__doc__ = fn.__doc__
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = with_views(used, sql)
            return fn

        return wrap
