"""User code: scalar functions by name, row evaluators, and procedures that run in every partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FUNCTIONS: dict[str, tuple[Callable, str]] = {}


def register(name: str, kind: str) -> Callable:
    """Register a function over pandas Series: f(a, b, ..) -> Series of the type."""

    def put(f: Callable) -> Callable:
        _FUNCTIONS[name] = (f, kind)
        return f

    return put


def custom(name: str, *cols: Column | str) -> Column:
    f, kind = _FUNCTIONS[name]

    def call(*series: pd.Series) -> pd.Series:
        return f(*series)

    call.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, kind)(*cols)


def evaluate(df: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which user code says so, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            yield b[keep(b)]

    return df.mapInPandas(run, df.schema)


class Procedure:
    """init once on the driver, execute in every partition, finalize once over the frame of all responses."""

    response = "value string"

    def init(self, *args) -> None:
        self.args = args

    def execute(self, rows: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        raise NotImplementedError

    def finalize(self, responses: DataFrame) -> DataFrame:
        return responses


class Parameters:
    """The arguments of a call, by place from 0, as the type that the procedure asks for; null stays null."""

    def __init__(self, values: tuple):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int):
        return self.values[i]

    def _as(self, i: int, make: Callable):
        v = self.values[i]
        return None if v is None else make(v)

    def get_string(self, i: int) -> str | None:
        return self._as(i, str)

    def get_long(self, i: int) -> int | None:
        return self._as(i, int)

    get_int = get_long

    def get_double(self, i: int) -> float | None:
        return self._as(i, float)

    def get_decimal(self, i: int) -> Decimal | None:
        return self._as(i, lambda v: Decimal(str(v)))

    def get_boolean(self, i: int) -> bool | None:
        return self._as(i, lambda v: v.strip().lower() == "true" if isinstance(v, str) else bool(v))

    def get_timestamp(self, i: int) -> datetime | None:
        return self._as(i, lambda v: v if isinstance(v, datetime) else datetime.fromisoformat(str(v)))

    def get_bytes(self, i: int) -> bytes | None:
        return self._as(i, lambda v: v.encode() if isinstance(v, str) else bytes(v))


class Records:
    """Collects a response's records: create() gives an empty one of the table's columns, frame() all that were filled."""

    def __init__(self, columns: list[str]):
        self.columns, self.rows = columns, []

    def create(self) -> dict:
        self.rows.append(dict.fromkeys(self.columns))
        return self.rows[-1]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.rows, columns=self.columns)


def call(procedure: Procedure, df: DataFrame, *args) -> DataFrame:
    procedure.init(*args)
    return procedure.finalize(df.mapInPandas(procedure.execute, procedure.response))


_PROCEDURES: dict[str, tuple[type[Procedure], Callable]] = {}


def procedure(name: str, source: Callable) -> Callable:
    """Register a Procedure class under a name for CALL; source(db, parameters) is the frame whose partitions it runs in."""

    def put(cls: type[Procedure]) -> type[Procedure]:
        _PROCEDURES[name] = (cls, source)
        return cls

    return put


def call_by_name(db, name: str, *args) -> DataFrame:
    if name not in _PROCEDURES:
        raise KeyError(f"no procedure {name}")
    cls, source = _PROCEDURES[name]
    own = cls()
    own.parameters = Parameters(args)
    return call(own, source(db, own.parameters), *args)


def into_table(db, name: str, result: DataFrame, key: list[str] | None = None) -> None:
    """A procedure's result as a table of the database, for statements that follow; replaced if it exists."""
    from lattica.sources.catalog import Table

    db.tables[name.lower()] = Table(name.lower(), result, key or [])
