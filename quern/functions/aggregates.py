"""Aggregates of groups.  Over no values a sum is 0 and a mean NaN; spread needs two values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import tree as t
from ..dialect.lexer import QueryError
from ..plans.values import Atom, Open, Row, Value
from .arithmetic import divide, logarithm, number

NAN = float("nan")


def _double(scope, c: Column) -> Column:
    return number(scope, c).cast("double")


def _extreme(scope, c: Column, least: bool) -> Column:
    if not isinstance(scope.type(c), (T.DoubleType, T.FloatType)):
        return F.min(c) if least else F.max(c)
    # NaN is below every number
    real = F.when(~F.isnan(c), c)
    some = F.max(F.isnan(c).cast("int")) == 1
    return F.when(some, F.lit(NAN)).otherwise(F.min(c)) if least else F.coalesce(F.max(real), F.when(some, F.lit(NAN)))


def _timed(v: Atom) -> Column:
    ts = v.ts if v.ts is not None else F.lit(None).cast("timestamp")
    return F.when(v.col.isNotNull(), F.struct(ts.alias("ts"), v.col.alias("v")))


def _earliest(scope, v: Value) -> Column:
    return F.min(F.array_min(v.versions) if isinstance(v, Atom) and v.versions is not None else _timed(v))["v"]


def _latest(scope, v: Value) -> Column:
    return F.max(F.array_max(v.versions) if isinstance(v, Atom) and v.versions is not None else _timed(v))["v"]


ONE: dict[str, Callable[..., Column]] = {
    "avg": lambda s, v: F.coalesce(F.avg(_double(s, v.column())), F.lit(NAN)),
    "sum": lambda s, v: F.coalesce(F.sum(_double(s, v.column())), F.lit(0.0)),
    "min": lambda s, v: _extreme(s, v.column(), True),
    "max": lambda s, v: _extreme(s, v.column(), False),
    "count": lambda s, v: F.count(v.column()),
    "count_distinct": lambda s, v: F.count_distinct(v.column()),
    "variance": lambda s, v: F.coalesce(F.var_samp(_double(s, v.column())), F.lit(NAN)),
    "stddev": lambda s, v: F.coalesce(F.stddev_samp(_double(s, v.column())), F.lit(NAN)),
    "earliest": _earliest,
    "latest": _latest,
}
NAMES = frozenset(["string_agg", "pivot", "likelihood_ratio", *ONE, *(f"vertical_{n}" for n in [*ONE, "string_agg"])])


def plain_name(name: str) -> str:
    return name.lower().removeprefix("vertical_")


def calls_in(e: object) -> list[t.Call]:
    """Calls of aggregates, outermost ones, in order."""
    if isinstance(e, t.Call) and e.name.lower() in NAMES:
        return [e]
    if isinstance(e, t.Select):
        return []
    if isinstance(e, (list, tuple)):
        return [c for x in e for c in calls_in(x)]
    if hasattr(e, "__dataclass_fields__"):
        return [c for f in e.__dataclass_fields__ for c in calls_in(getattr(e, f))]
    return []


def build(scope, e: t.Call) -> Value:
    """The aggregate as a value over the grouped table's input; rows give one result a column."""
    name = plain_name(e.name)
    if name == "count" and e.args and e.args[0].text == "*":
        cols = [v.column() for v in scope.whole().leaves().values()]
        return Atom(F.count(F.when(F.coalesce(*[F.when(c.isNotNull(), F.lit(1)) for c in cols]).isNotNull(), F.lit(1)))) if cols else Atom(F.count(F.lit(1)))
    args = [scope.value(x) for x in e.args]
    if name == "string_agg":
        sep = args[1] if len(args) > 1 else Atom(F.lit(""), const="")
        value = args[0].column().cast("string")
        key = args[2].column() if len(args) > 2 else F.lit(None).cast("string")
        rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(key.alias("k"), value.alias("v"), sep.column().cast("string").alias("s")))))
        if isinstance(sep, Atom) and sep.const is not None:
            return Atom(F.array_join(F.transform(rows, lambda r: r["v"]), str(sep.const)))
        return Atom(F.aggregate(rows, F.lit(None).cast("string"), lambda acc, r: F.when(acc.isNull(), r["v"]).otherwise(F.concat(acc, r["s"], r["v"]))))
    if name == "pivot":
        key = args[0].column().cast("string")
        pairs = F.array_sort(F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("key"), args[1].column().alias("value")))))
        # of several values of a name the largest stays, the last before another name; null names have no column
        ends = F.zip_with(pairs, F.slice(pairs, F.lit(2), F.greatest(F.size(pairs), F.lit(1))), lambda p, n: F.when(n.isNull() | (n["key"] != p["key"]), p))
        return Open(F.map_from_entries(F.filter(ends, lambda p: p.isNotNull())))
    if name == "likelihood_ratio":
        yes = scope.boolean(e.args[1])

        def ratio(c: Column) -> Column:
            a = divide(F.count(F.when(yes & c.isNotNull(), 1)), F.count(F.when(yes, 1)))
            b = divide(F.count(F.when(~yes & c.isNotNull(), 1)), F.count(F.when(~yes, 1)))
            return logarithm(divide(a, b))

        return Row({k: Atom(ratio(v.column())) for k, v in args[0].leaves().items()})
    one = ONE.get(name)
    if one is None or len(args) != 1:
        raise QueryError(f"wrong use of the aggregate {e.name}")
    if isinstance(args[0], Row):
        return Row({k: Atom(one(scope, v)) for k, v in args[0].leaves().items()})
    return Atom(one(scope, args[0]))
