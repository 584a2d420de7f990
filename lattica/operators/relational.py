"""Joins, aggregates, ordering and set operations where the meaning differs from Spark's defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINS = {None: "inner", "inner": "inner", "left": "left", "left outer": "left", "right": "right", "right outer": "right", "full": "full", "full outer": "full"}


def join(left: DataFrame, right: DataFrame, on: Column, how: str | None = None, where: Column | None = None, where_in_on: bool = False) -> DataFrame:
    """where_in_on (outer joins): the filter decides about matches and keeps unmatched driver rows."""
    kind = JOINS[how.lower() if how else None]
    if where is not None and where_in_on and kind != "inner":
        return left.join(right, on & F.coalesce(where, F.lit(False)), kind)
    out = left.join(right, on, kind)
    return out if where is None else out.filter(F.coalesce(where, F.lit(False)))


def join_all(first: DataFrame, *steps: tuple[DataFrame, Column, str | None]) -> DataFrame:
    return reduce(lambda df, s: join(df, *s), steps, first)


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def avg_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def exact_sum(x: Column, scale: int = 2) -> Column:
    """A double column's sum in decimal arithmetic: does not depend on the order of the rows."""
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def group(df: DataFrame, keys: list[str], *aggs: Column, null_keys: bool = True) -> DataFrame:
    """null_keys=False leaves groups with a null key out."""
    if not null_keys:
        df = df.dropna(subset=keys)
    return df.groupBy(*keys).agg(*aggs)


def last_by(value: str, order: str) -> Column:
    """A column that is not grouped: its value in the group's last row by the key."""
    return F.max_by(value, order)


def order(df: DataFrame, *keys: tuple[str, str] | str, missing: str | None = None) -> DataFrame:
    """Nulls last when ascending, first when descending. missing: of these keys one from the outer side of a join, null where a
    row has no partner; such rows come first when it ascends and last when it descends."""
    by = []
    for name, way in ((k, "asc") if isinstance(k, str) else k for k in keys):
        up = way == "asc"
        first = up if name == missing else not up
        c = F.col(name)
        by.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last()))
    return df.orderBy(*by)


def numbered(df: DataFrame, name: str = "place") -> DataFrame:
    """A sorted frame with each row's place from 0, without bringing the rows into one task: the sort's partitions are ranges in
    order, so a row's place is the number of rows of the partitions before plus its place in its own."""
    return _numbered(df, name)[0]


def _numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """See numbered(); the number of all rows too."""
    spark = df.sparkSession
    marked = df.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).persist()
    sizes = sorted((r["_part"], r["n"]) for r in marked.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a number a partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "_part int, _before long")
    return marked.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before"), total


def page(df: DataFrame, limit: int, offset: int = 0, one_based: bool = False) -> DataFrame:
    """one_based: offset k starts at the k-th row."""
    skip = max(0, offset - 1) if one_based else offset
    return (df.offset(skip) if skip else df).limit(limit)


def pages(df: DataFrame, size: int = 1000):
    """Cursor paging: lists of rows, one partition at a time on the driver. All rows pass through it; see page_starts()."""
    own = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        own.append(row)
        if len(own) == size:
            yield own
            own = []
    if own:
        yield own


def page_starts(df: DataFrame, size: int = 1000) -> DataFrame:
    """Of each page of a sorted frame its number from 0, its number of rows and its first row (page, n, first), found where the
    rows are: none goes to the driver, which learns only how many each partition has."""
    placed, total = _numbered(df, "_place")
    first = placed.filter(F.col("_place") % size == 0)
    return first.select((F.col("_place") / size).cast("long").alias("page"), F.least(F.lit(size).cast("long"), F.lit(total).cast("long") - F.col("_place")).alias("n"), F.struct(*df.columns).alias("first"))


SET_OPS = {"union": lambda a, b: a.union(b).distinct(), "union all": DataFrame.union, "intersect": DataFrame.intersect, "except": DataFrame.subtract, "intersect all": DataFrame.intersectAll, "except all": DataFrame.exceptAll}


def set_chain(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """From left to right, without precedence."""
    return reduce(lambda a, s: SET_OPS[s[0].lower()](a, s[1]), steps, first)
