"""Operators on values: arithmetic, comparison, casts.

Fixed semantics: division is of doubles and gives infinities; + joins strings if either side is
one; values of different kinds are never equal and order by kind; times take days as integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect.lexer import QueryError
from ..plans.scope import NUMBERS, WHOLE
from ..plans.values import Atom, Emb, Interval, Open, Row, Value

INF = float("inf")


def rank(kind: T.DataType) -> int:
    """Null, numbers, strings, others: the order of kinds."""
    return 0 if isinstance(kind, T.NullType) else 1 if isinstance(kind, (*NUMBERS, T.BooleanType)) else 2 if isinstance(kind, T.StringType) else 3


def number(scope, col: Column) -> Column:
    """A boolean is 1 or 0; a null literal is a null number."""
    kind = scope.type(col)
    return col.cast("long") if isinstance(kind, T.BooleanType) else col.cast("double") if isinstance(kind, (T.NullType, T.DecimalType)) else col


def alike(scope, cols: list[Column]) -> list[Column]:
    """Columns of one type: their own, doubles, or strings."""
    kinds = [scope.type(c) for c in cols]
    real = [k for k in kinds if not isinstance(k, T.NullType)]
    if len({k.simpleString() for k in real}) <= 1:
        return cols
    if all(isinstance(k, (*NUMBERS, T.BooleanType)) for k in real):
        to = "bigint" if all(isinstance(k, (*WHOLE, T.BooleanType)) for k in real) else "double"
        return [(c.cast("int") if isinstance(k, T.BooleanType) else c).cast(to) for c, k in zip(cols, kinds, strict=True)]
    return [c.cast("string") for c in cols]


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a.isNotNull(), F.lit(float("nan")))).otherwise(F.try_divide(a, b))


def logarithm(c: Column) -> Column:
    """The natural logarithm, of 0 -inf and of less NaN."""
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(-INF)).when(c.isNotNull(), F.lit(float("nan")))


def unary(scope, op: str, x: Value) -> Value:
    if isinstance(x, Row):
        return Row({k: unary(scope, op, v) for k, v in x.leaves().items()})
    if isinstance(x, Emb):
        return Emb(F.transform(x.col, lambda v: -v if op == "-" else v))
    if isinstance(x, Interval):
        return Interval(-x.months, -x.days, -x.seconds) if op == "-" else x
    col = number(scope, x.column())
    if op == "~":
        return Atom(F.bitwise_not(col.cast("long")))
    return Atom(-col if op == "-" else col)


def binary(scope, op: str, x: Value, y: Value) -> Value:
    if op == "@":
        return Atom(x.column(), ts=y.column())
    if op in ("=", "==", "!=", "<>", "<", "<=", ">", ">=", "!<", "!>"):
        return Atom(compare(scope, {"==": "=", "<>": "!=", "!<": ">=", "!>": "<="}.get(op, op), x, y))
    if isinstance(x, Row) or isinstance(y, Row):
        if isinstance(x, Row) and isinstance(y, Row):
            a, b = x.leaves(), y.leaves()
            return Row({k: binary(scope, op, a.get(k, Atom(F.lit(None))), b.get(k, Atom(F.lit(None)))) for k in [*a, *[k for k in b if k not in a]]})
        if isinstance(x, Row):
            return Row({k: binary(scope, op, v, y) for k, v in x.leaves().items()})
        return Row({k: binary(scope, op, x, v) for k, v in y.leaves().items()})
    if isinstance(x, Emb) and isinstance(y, Emb):
        return Emb(F.zip_with(x.col, y.col, lambda a, b: plain(op, a, b)))
    if isinstance(x, Emb):
        c = y.column()
        return Emb(F.transform(x.col, lambda v: plain(op, v, c)))
    if isinstance(y, Emb):
        c = x.column()
        return Emb(F.transform(y.col, lambda v: plain(op, c, v)))
    if isinstance(x, Interval) or isinstance(y, Interval):
        return with_interval(scope, op, x, y)
    a, b = x.column(), y.column()
    ka, kb = scope.type(a), scope.type(b)
    times = (T.TimestampType, T.DateType, T.TimestampNTZType)
    if isinstance(ka, times) or isinstance(kb, times):
        return with_time(op, a, b, isinstance(ka, times), isinstance(kb, times))
    if op == "+" and (isinstance(ka, T.StringType) or isinstance(kb, T.StringType)):
        return Atom(F.concat(a.cast("string"), b.cast("string")))
    a, b = number(scope, a), number(scope, b)
    if op in "&|^":
        a, b = a.cast("long"), b.cast("long")
        return Atom({"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[op](b))
    if op == "/":
        return Atom(divide(a, b))
    if isinstance(ka, (*WHOLE, T.BooleanType)) and isinstance(kb, (*WHOLE, T.BooleanType)):
        a, b = a.cast("long"), b.cast("long")
        if op == "%":
            return Atom(F.try_mod(a, b))
    else:
        a, b = a.cast("double"), b.cast("double")
        if op == "%":
            return Atom(F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(F.try_mod(a, b)))
    return Atom(plain(op, a, b))


def plain(op: str, a: Column, b: Column) -> Column:
    """Whole numbers beyond 63 bits, and remainders of 0, are null."""
    if op == "/":
        return divide(a, b)
    known = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}
    if op in known:
        return known[op](a, b)
    raise QueryError(f"no {op} for embeddings")


def with_time(op: str, a: Column, b: Column, time_a: bool, time_b: bool) -> Value:
    if time_a and time_b:
        if op != "-":
            raise QueryError(f"no {op} for two times")
        # days and what is left of the last one
        seconds = a.cast("timestamp").cast("double") - b.cast("timestamp").cast("double")
        days = F.floor(F.abs(seconds) / 86400) * F.signum(seconds)
        return Interval(F.lit(0), days, seconds - days * 86400)
    time, n = (a, b) if time_a else (b, a)
    if op == "+" or op == "-" and time_a:
        step = F.make_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("int"))
        return Atom(time.cast("timestamp") + step if op == "+" else time.cast("timestamp") - step)
    raise QueryError(f"no {op} for a time")


def with_interval(scope, op: str, x: Value, y: Value) -> Value:
    if isinstance(x, Interval) and isinstance(y, Interval):
        if op not in "+-":
            raise QueryError(f"no {op} for intervals")
        s = 1 if op == "+" else -1
        return Interval(x.months + s * y.months, x.days + s * y.days, x.seconds + s * y.seconds)
    if isinstance(x, Interval) and op in "*/" or isinstance(y, Interval) and op == "*":
        i, n = (x, y.column().cast("double")) if isinstance(x, Interval) else (y, x.column().cast("double"))
        n = 1 / n if op == "/" else n
        days = i.days * n
        whole = F.floor(F.abs(days)) * F.signum(days)
        return Interval(F.round(i.months * n), whole, i.seconds * n + (days - whole) * 86400)
    if isinstance(y, Interval) and op in "+-":
        time = x.column().cast("timestamp")
        return Atom(time + y.spark() if op == "+" else time - y.spark())
    if isinstance(x, Interval) and op == "+":
        return Atom(y.column().cast("timestamp") + x.spark())
    raise QueryError(f"no {op} for an interval and a value")


def compare(scope, op: str, x: Value, y: Value) -> Column:
    if isinstance(x, Interval) and isinstance(y, Interval):
        def total(i):
            return i.months * 30 * 86400 + i.days * 86400 + i.seconds

        return apply(op, total(x), total(y))
    if isinstance(x, Row) and isinstance(y, Row) and op in ("=", "!="):
        a, b = x.leaves(), y.leaves()
        out = F.lit(set(a) == set(b))
        for k in set(a) & set(b):
            out = out & (a[k].column().eqNullSafe(b[k].column()))
        return out if op == "=" else ~out
    a, b = x.column(), y.column()
    ka, kb = scope.type(a), scope.type(b)
    ra, rb = rank(ka), rank(kb)
    if 0 in (ra, rb):
        return F.lit(None).cast("boolean")
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(ka, times) and isinstance(kb, T.StringType):
        return apply(op, a, b.try_cast("timestamp"))
    if isinstance(kb, times) and isinstance(ka, T.StringType):
        return apply(op, a.try_cast("timestamp"), b)
    if ra != rb:
        told = {"=": False, "!=": True, "<": ra < rb, "<=": ra < rb, ">": ra > rb, ">=": ra > rb}[op]
        return F.when(a.isNotNull() & b.isNotNull(), F.lit(told))
    if isinstance(ka, T.BooleanType) != isinstance(kb, T.BooleanType):
        a, b = number(scope, a), number(scope, b)
    if op in ("<", "<=", ">", ">=") and any(isinstance(k, (T.FloatType, T.DoubleType)) for k in (ka, kb)):
        return ordered(op, a.cast("double"), b.cast("double"))
    return apply(op, a, b)


def ordered(op: str, a: Column, b: Column) -> Column:
    """NaN comes before every number, where Spark has it after."""
    low = F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & ~F.isnan(b)).otherwise(a < b)
    same = F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise(a == b)
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, {"<": low, "<=": low | same, ">": ~(low | same), ">=": ~low}[op])


def apply(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def cast(scope, x: Value, to: str) -> Value:
    """A value that can't be converted becomes null."""
    if isinstance(x, Row):
        return Row({k: cast(scope, v, to) for k, v in x.leaves().items()})
    col = x.column()
    kind = scope.type(col)
    text = isinstance(kind, T.StringType)
    if to == "string":
        return Atom(col.cast("string"))
    if to == "boolean":
        if text:
            return Atom(F.when(F.lower(col) == "true", True).when(F.lower(col) == "false", False).otherwise(col.try_cast("double") != 0))
        return Atom(number(scope, col) != 0)
    if to in ("integer", "number"):
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = col.cast("timestamp").cast("double")
        col = number(scope, col).try_cast("double") if text or to == "number" else number(scope, col)
        return Atom(col.try_cast("bigint") if to == "integer" else col)
    if to == "timestamp":
        return Atom(col.try_cast("timestamp") if text or isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)) else F.timestamp_seconds(number(scope, col)))
    if to == "blob":
        return Atom(col.cast("string").cast("binary"))
    if to == "path":
        return Emb(F.split(col.cast("string"), r"\."))
    raise QueryError(f"unknown type {to!r} in CAST")
