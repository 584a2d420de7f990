"""The scalar function library as Column builders. All of them stay on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _d(x: C) -> Column:
    return _c(x).cast("double")


def _l(x: C) -> Column:
    return _c(x).cast("long")


# numbers
def ceiling(x): return F.ceil(_d(x)).cast("double")
def floor(x): return F.floor(_d(x)).cast("double")
def abs_(x): return F.abs(_c(x))
def str_(x): return _c(x).cast("string")


def round_(x):
    """Nearest integer, halves toward positive infinity."""
    return F.floor(_d(x) + 0.5)


def power(a, b): return F.pow(_d(a), _d(b))
def sqrt(x): return F.sqrt(_d(x))
def pi(): return F.pi()
def tan(x): return F.tan(_d(x))
def cos(x): return F.cos(_d(x))
def sin(x): return F.sin(_d(x))
def cot(x): return F.cot(_d(x))
def radians(x): return F.radians(_d(x))


def _log(f, x):
    x = _d(x)
    return F.when(x > 0, f(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def log(x):
    """Natural; minus infinity at 0, NaN below."""
    return _log(F.log, x)


def log10(x): return _log(F.log10, x)


def mod(a, b):
    """Double remainder; NaN by 0."""
    a, b = _d(a), _d(b)
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(a % b)


def div_truncating(a, b):
    """Integer quotient toward 0; null by 0."""
    return F.expr("cast(null as long)") if b is None else F.when(_l(b) != 0, F.call_function("div", _l(a), _l(b)))


# row-wise over any number of arguments, nulls left out
def avg_of(*xs):
    """0 when all are null."""
    n = reduce(lambda a, b: a + b, [_c(x).isNotNull().cast("double") for x in xs])
    s = reduce(lambda a, b: a + b, [F.coalesce(_d(x), F.lit(0.0)) for x in xs])
    return F.when(n > 0, s / F.greatest(n, F.lit(1.0))).otherwise(F.lit(0.0))


def sum_of(*xs):
    s = reduce(lambda a, b: a + b, [F.coalesce(_d(x), F.lit(0.0)) for x in xs])
    return F.when(F.coalesce(*map(_d, xs)).isNotNull(), s)


def _pick(f, xs, cast):
    xs = [cast(x) for x in xs]
    return xs[0] if len(xs) == 1 else f(*xs)


def max_of(*xs): return _pick(F.greatest, xs, _d)
def min_of(*xs): return _pick(F.least, xs, _d)
def max_timestamp(*xs): return _pick(F.greatest, xs, _c)
def min_timestamp(*xs): return _pick(F.least, xs, _c)


# bits, on 64-bit integers
def bit_shift_left(x, n): return F.call_function("shiftleft", _l(x), _c(n).cast("int"))


def bit_shift_right(x, n):
    """Fills with zeros."""
    return F.call_function("shiftrightunsigned", _l(x), _c(n).cast("int"))


def bit_and(a, b): return _l(a).bitwiseAND(_l(b))
def bit_or(a, b): return _l(a).bitwiseOR(_l(b))
def bit_xor(a, b): return _l(a).bitwiseXOR(_l(b))
def bit_not(a): return F.bitwise_not(_l(a))


# strings
def char_length(s): return F.char_length(_c(s))
def concat(a, b): return F.concat(_c(a), _c(b))


def substring(s, begin, end=None):
    """From 0-based begin up to, not including, end."""
    s = _c(s)
    return F.substring(s, begin + 1, end - begin) if end is not None else F.substring(s, F.lit(begin + 1), F.char_length(s))


def lower(s): return F.lower(_c(s))
def upper(s): return F.upper(_c(s))


def index_of(s, t):
    """0-based, -1 where it does not occur."""
    return F.instr(_c(s), t) - 1 if isinstance(t, str) else F.call_function("instr", _c(s), t) - 1


def replace(s, a, b): return F.replace(_c(s), F.lit(a) if isinstance(a, str) else a, F.lit(b) if isinstance(b, str) else b)


def hex_(s):
    """Upper-case hex of the text form's UTF-8 bytes."""
    return F.hex(_c(s).cast("string").cast("binary"))


def trim(s):
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(_c(s), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


# nulls
def coalesce(*xs): return F.coalesce(*map(_c, xs))
def is_null(x): return _c(x).isNull()


# times
def now(): return F.current_timestamp()


def date_add(ts, millis):
    """Milliseconds, not days."""
    return _c(ts) + F.make_interval(secs=_c(millis).cast("decimal(18,6)") / 1000) if not isinstance(millis, int) else _c(ts) + F.expr(f"interval '{millis / 1000:.3f}' second")


def day(ts): return F.dayofmonth(_c(ts))
def day_of_week(ts): return F.dayofweek(_c(ts))
def day_of_year(ts): return F.dayofyear(_c(ts))
def minute(ts): return F.minute(_c(ts))
def hour(ts): return F.hour(_c(ts))
def second(ts): return F.second(_c(ts))
def year(ts): return F.year(_c(ts))


def month(ts):
    """January is 0."""
    return F.month(_c(ts)) - 1


def week_of_month(ts):
    """Weeks start on Sunday; the first one holds day 1."""
    ts = _c(ts)
    return (F.floor((F.dayofmonth(ts) + F.dayofweek(F.trunc(ts.cast("date"), "MONTH")) - 2) / 7) + 1).cast("int")


def week_of_year(ts):
    """Weeks start on Sunday; the week of 1 January is the first, also for days before it."""
    d = _c(ts).cast("date")
    last = F.date_add(d, 7 - F.dayofweek(d))
    return F.when(F.year(last) > F.year(d), 1).otherwise((F.floor((F.dayofyear(d) + F.dayofweek(F.trunc(d, "YEAR")) - 2) / 7) + 1).cast("int"))


#: Names in queries to builders; `custom` is in plans.procedures.
REGISTRY = {
    "ceiling": ceiling, "floor": floor, "abs": abs_, "str": str_, "avg": avg_of, "max": max_of, "max_timestamp": max_timestamp, "sum": sum_of, "min": min_of, "min_timestamp": min_timestamp,
    "bit_shift_left": bit_shift_left, "bit_shift_right": bit_shift_right, "bit_and": bit_and, "bit_not": bit_not, "bit_or": bit_or, "bit_xor": bit_xor, "coalesce": coalesce, "char_length": char_length,
    "concat": concat, "now": now, "date_add": date_add, "day": day, "day_of_week": day_of_week, "day_of_year": day_of_year, "minute": minute, "month": month, "second": second, "hour": hour,
    "week_of_month": week_of_month, "week_of_year": week_of_year, "year": year, "power": power, "hex": hex_, "log": log, "log10": log10, "mod": mod, "lower": lower, "upper": upper, "index_of": index_of,
    "replace": replace, "round": round_, "pi": pi, "sqrt": sqrt, "tan": tan, "cos": cos, "sin": sin, "cot": cot, "trim": trim, "radians": radians, "is_null": is_null,
}


def register_sql(spark) -> None:
    """The functions whose meaning differs from Spark's, for SQL text, as lx_* temporary functions."""
    for head, body in (
        ("lx_month(ts TIMESTAMP) RETURNS INT", "month(ts) - 1"),
        ("lx_round(x DOUBLE) RETURNS BIGINT", "floor(x + 0.5D)"),
        ("lx_index_of(s STRING, t STRING) RETURNS INT", "instr(s, t) - 1"),
        ("lx_date_add(ts TIMESTAMP, millis BIGINT) RETURNS TIMESTAMP", "timestampadd(MILLISECOND, millis, ts)"),
        ("lx_hex(s STRING) RETURNS STRING", "hex(cast(s as binary))"),
        ("lx_bit_shift_right(x BIGINT, n INT) RETURNS BIGINT", "shiftrightunsigned(x, n)"),
        ("lx_mod(a DOUBLE, b DOUBLE) RETURNS DOUBLE", "case when b = 0 then double('NaN') else a % b end"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
