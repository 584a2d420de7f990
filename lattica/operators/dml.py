"""Changes of tables. Every change is a plan from the table to the table after it, with the change rows beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class UniqueViolation(ValueError):
    pass


@dataclass
class Change:
    """The table after the change and, for publishing, its before and after rows (either may be None)."""

    table: DataFrame
    action: str
    before: DataFrame | None = None
    after: DataFrame | None = None
    #: Of an update: a row (before, after) for every row it touched, both images of it side by side.
    images: DataFrame | None = None


def _fit(table: DataFrame, rows: DataFrame, *also: str) -> DataFrame:
    """rows with the table's columns in its order and types, and those of `also`; missing ones are null."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*((F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema), *also)


def _same(keys: list[str], a: str = "a", b: str = "b") -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def duplicates(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys of rows that the table has, or that rows have more than once."""
    own = rows.groupBy(*key).count().filter("count > 1").select(*key)
    return rows.alias("a").join(table.select(*key).alias("b"), _same(key), "left_semi").select(*key).unionByName(own).distinct()


def insert(table: DataFrame, rows: DataFrame, key: list[str] | None = None, check: bool = True) -> Change:
    """Append; with a key, a repeated one raises (one short job). Tables without a key take anything."""
    rows = _fit(table, rows)
    if key and check and not duplicates(table, rows, key).isEmpty():
        raise UniqueViolation("Unique constraint violated: " + ", ".join(key))
    return Change(table.unionByName(rows), "INSERT", after=rows)


#: Statuses of a batch's rows, as JDBC has them: done, the key is used, failed for another reason.
DONE, KEY_USED, FAILED = -2, -100, -3


def _arrival(rows: DataFrame, order: Column | None, name: str = "_arrival") -> DataFrame:
    """rows with their place among new rows: by order, else as they come."""
    return rows.withColumn(name, F.monotonically_increasing_id() if order is None else order)


def batch_insert(table: DataFrame, rows: DataFrame, key: list[str], unique: list[list[str]] | None = None, order: Column | None = None, done: int = DONE) -> tuple[Change, DataFrame]:
    """Insert what does not collide; the second result has every row and its status: done, KEY_USED, or FAILED for a
    value that another unique index has.

    Of new rows of one key the first by `order` (else as they come) is inserted and the others have KEY_USED; of new rows
    of one value of a unique index the first of those whose key is free. Null keys equal each other.
    """
    place = F.struct(order if order is not None else F.monotonically_increasing_id(), F.xxhash64(*rows.columns)).alias("_arrival")
    marked = _fit(table, rows.withColumn("_arrival", place), "_arrival").withColumn("status", F.lit(done))
    for columns, code in ((key, KEY_USED), *((u, FAILED) for u in unique or ())):
        used = table.select(*columns).distinct().withColumn("_used", F.lit(True))
        marked = marked.alias("a").join(used.alias("b"), _same(columns), "left").select("a.*", "b._used")
        # rows that an index before has rejected hold no value of this one
        first = F.min(F.when(F.col("status") == done, F.col("_arrival"))).over(Window.partitionBy(*columns))
        clash = (F.col("status") == done) & (F.col("_used").isNotNull() | (first != F.col("_arrival")))
        marked = marked.withColumn("status", F.when(clash, code).otherwise(F.col("status"))).drop("_used")
    marked = marked.drop("_arrival")
    good = marked.filter(F.col("status") == done).drop("status")
    return Change(table.unionByName(good), "INSERT", after=good), marked


def upsert(table: DataFrame, rows: DataFrame, key: list[str] | None, order: Column | None = None) -> Change:
    """Insert, or replace the row of the same key; without a key a plain insert. Of several new rows of one key the last by
    `order` (else as they come) stays; of those that no order tells apart the greatest."""
    if not key:
        return insert(table, rows)
    rows = _fit(table, _arrival(rows, order), "_arrival")
    rows = rows.groupBy(*key).agg(F.max_by(F.struct(*table.columns), F.struct("_arrival", F.to_json(F.struct(*table.columns)))).alias("_last")).select("_last.*")
    kept = table.alias("a").join(rows.select(*key).alias("b"), _same(key), "left_anti")
    return Change(kept.unionByName(rows), "UPSERT", after=rows)


def insert_select(table: DataFrame, query: DataFrame, columns: list[str] | None = None, key: list[str] | None = None, check: bool = True) -> Change:
    """Columns of the query go to the given ones by place."""
    return insert(table, query.toDF(*(columns or table.columns)), key, check)


def update(table: DataFrame, values: dict[str, Column], where: Column | None = None) -> Change:
    """All rows without where; expressions see the row before the change."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    types = {f.name: f.dataType for f in table.schema}
    new = {c: v.cast(types[c]) for c, v in values.items()}
    touched = table.filter(hit)
    images = touched.select(F.struct(*table.columns).alias("before"), F.struct(*(new.get(c, F.col(c)).alias(c) for c in table.columns)).alias("after"))
    return Change(table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}), "UPDATE", touched, touched.withColumns(new), images)


def delete(table: DataFrame, where: Column | None = None) -> Change:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return Change(table.filter(~hit), "DELETE", before=table.filter(hit))


def truncate(table: DataFrame) -> Change:
    return Change(table.limit(0), "TRUNCATE")


def add_column(table: DataFrame, name: str, kind: str) -> DataFrame:
    return table.withColumn(name, F.lit(None).cast(kind))


def drop_column(table: DataFrame, name: str) -> DataFrame:
    return table.drop(name)
