"""Two-valued predicates: leaves are never null, so NOT, AND and OR need no third value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq(a: Column, b) -> Column:
    """Null equals null, and nothing else."""
    return a.eqNullSafe(b)


def ne(a: Column, b) -> Column:
    return ~a.eqNullSafe(b)


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def lt(a: Column, b) -> Column:
    return _sure(a < b)


def le(a: Column, b) -> Column:
    return _sure(a <= b)


def gt(a: Column, b) -> Column:
    return _sure(a > b)


def ge(a: Column, b) -> Column:
    return _sure(a >= b)


def is_in(a: Column, values) -> Column:
    return _sure(a.isin(*values))


def not_in(a: Column, values) -> Column:
    """False for null on the left, as is_in."""
    return a.isNotNull() & ~_sure(a.isin(*values))


def between(a: Column, x, y) -> Column:
    """Bounds in either order."""
    lo, hi = (x, y) if x <= y else (y, x)
    return _sure(a.between(lo, hi))


def not_between(a: Column, x, y) -> Column:
    lo, hi = (x, y) if x <= y else (y, x)
    return _sure((a < lo) | (a > hi))


def like(a: Column, pattern: str | None) -> Column:
    """% is any text, ? any one character, _ itself. A pattern of % and plain text becomes LIKE, which reaches the scan.

    Null is like null only.
    """
    if pattern is None:
        return a.isNull()
    if re.fullmatch(r"[\w %#-]*", pattern):
        return _sure(a.like(pattern.replace("_", r"\_")))
    return _sure(a.rlike("(?s)^(?:" + pattern.replace("%", ".*").replace("?", ".") + ")$"))


def not_like(a: Column, pattern: str | None) -> Column:
    return a.isNotNull() & ~like(a, pattern) if pattern is not None else a.isNotNull()


def as_boolean(a: Column) -> Column:
    """Text to truth value: 'true' in any case."""
    return F.lower(a.cast("string")) == "true"


def key_lookup(df, keys: list[dict]):
    """Rows of df with one of the keys (equal columns in every dict): a semi join with the keys, which Spark broadcasts when small."""
    wanted = df.sparkSession.createDataFrame([tuple(k.values()) for k in keys], df.select(*keys[0]).schema)
    return df.join(wanted, list(keys[0]), "left_semi")
