"""Names, types and expressions in the scope of a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import tree as t
from ..dialect.lexer import QueryError
from .table import ROW, TS, Table, q
from .values import Atom, Emb, Interval, Open, Row, Value

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
UNITS = {
    "s": "second", "sec": "second", "second": "second", "seconds": "second", "m": "minute", "min": "minute", "minute": "minute", "minutes": "minute", "h": "hour", "hour": "hour", "hours": "hour",
    "d": "day", "day": "day", "days": "day", "w": "week", "week": "week", "weeks": "week", "month": "month", "months": "month", "y": "year", "year": "year", "years": "year",
}


def parse_interval(text: str) -> tuple[int, int, float]:
    months, days, seconds = 0, 0, 0.0
    found = re.findall(r"([+-]?\s*\d+(?:\.\d+)?)\s*([A-Za-z]+)", text)
    if not found or re.sub(r"([+-]?\s*\d+(?:\.\d+)?)\s*([A-Za-z]+)|[\s,]", "", text):
        raise QueryError(f"not an interval: {text!r}")
    for n, unit in found:
        # one letter M is minutes in either case, as MONTH is spelled out
        u = UNITS.get(unit.lower())
        if u is None:
            raise QueryError(f"unknown interval unit {unit!r}")
        x = float(n.replace(" ", ""))
        if u in ("month", "year"):
            months += round(x * (12 if u == "year" else 1))
        elif u in ("day", "week"):
            whole = x * (7 if u == "week" else 1)
            days += int(whole)
            seconds += (whole - int(whole)) * 86400
        else:
            seconds += x * {"second": 1, "minute": 60, "hour": 3600}[u]
    return months, days, seconds


class Scope:
    """Analyses expressions over the columns of a DataFrame.

    ``names`` maps a path to a column; unknown names are null.  ``known`` gives values for expressions
    by their text: group keys and aggregates of a grouped query.
    """

    def __init__(self, engine, df: DataFrame, versioned: frozenset[str] = frozenset(), aliases: tuple[str, ...] = (), params: dict | None = None, known: dict[str, Value] | None = None):
        self.engine, self.df, self.versioned, self.aliases = engine, df, versioned, aliases
        self.params, self.known = params or {}, known or {}
        self.names = [c for c in df.columns if c not in (ROW, TS) and not c.startswith("__")]
        self.ts = q(TS) if TS in df.columns else None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    # names and types

    def type(self, value: Value | Column) -> T.DataType:
        col = value.column() if isinstance(value, Value) else value
        return self.df.select(col.alias("x")).schema[0].dataType

    def wrap(self, col: Column, versions: Column | None = None) -> Value:
        """A column as the kind of value that its type makes it."""
        kind = self.type(col)
        if isinstance(kind, T.ArrayType):
            return Emb(col)
        if isinstance(kind, T.MapType):
            return Open(col)
        if isinstance(kind, T.StructType):
            if kind.fieldNames() == ["months", "days", "seconds"]:
                return Interval(col["months"], col["days"], col["seconds"])
            return Row({f.name: self.wrap(col.getField(f.name)) for f in kind.fields})
        return Atom(col, versions, self.ts)

    def by_name(self, name: str) -> Value:
        if name in self.versioned:
            v = q(name)
            return Atom(F.element_at(v, -1)["v"], v, F.element_at(v, -1)["ts"])
        return self.wrap(q(name))

    def lookup(self, path: tuple[str, ...]) -> Value:
        full = ".".join(path)
        if full in self.names:
            return self.by_name(full)
        if len(path) > 1 and path[0] in self.names:  # a column of an open row goes before an alias
            head = self.by_name(path[0])
            if isinstance(head, (Open, Row)):
                return self.field(head, ".".join(path[1:]))
        if len(path) > 1 and path[0] in self.aliases and len(self.aliases) == 1:
            return self.lookup(path[1:])
        # a whole row: its columns share the beginning
        under = [c for c in self.names if c.startswith(full + ".")]
        if under:
            return Row({c[len(full) + 1 :]: self.by_name(c) for c in under})
        for k in range(len(path) - 1, 0, -1):  # a field of a nested value
            head = ".".join(path[:k])
            if head in self.names:
                return self.field(self.by_name(head), ".".join(path[k:]))
        if len(self.aliases) > 1:
            found = [c for c in self.names if any(c == f"{a}.{full}" for a in self.aliases)]
            if len(found) > 1:
                raise QueryError(f"ambiguous column {full}")
            if found:
                return self.by_name(found[0])
        if len(path) == 1 and path[0] in self.aliases:
            return self.whole()
        return Atom(F.lit(None))

    def whole(self, table: str | None = None) -> Row:
        if table is not None and len(self.aliases) > 1:
            return Row({c[len(table) + 1 :]: self.by_name(c) for c in self.names if c.startswith(table + ".")})
        return Row({c: self.by_name(c) for c in self.names})

    def field(self, value: Value, key: str) -> Value:
        if isinstance(value, Row):
            if key in value.fields:
                return value.fields[key]
            under = {k[len(key) + 1 :]: v for k, v in value.leaves().items() if k.startswith(key + ".")}
            leaf = value.leaves().get(key)
            return leaf if leaf is not None else Row(under) if under else Atom(F.lit(None))
        if isinstance(value, Open):
            return self.wrap(F.try_element_at(value.col, F.lit(key)))
        if isinstance(value, Emb) and re.fullmatch(r"\d+(\.\d+)*", key):
            col = value.col
            for k in key.split("."):
                col = F.get(col, F.lit(int(k)))
            return self.wrap(col)
        return Atom(F.lit(None))

    # select lists

    def wildcard(self, item: t.Wildcard) -> dict[str, Value]:
        out = {}
        for name, value in self.whole(item.table).fields.items():
            if not name.startswith(item.prefix) or any(name.startswith(e) if p else name == e or name.startswith(e + ".") for e, p in item.excluding):
                continue
            out[name if item.as_prefix is None else item.as_prefix + name[len(item.prefix) :]] = value
        return out

    def items(self, items: list[t.Item]) -> dict[str, Value]:
        out: dict[str, Value] = {}
        for item in items:
            if isinstance(item, t.Wildcard):
                out |= self.wildcard(item)
            elif isinstance(item, t.ColumnExpr):
                out |= self.column_expr(item)
            else:
                value = self.value(item.expr)
                if item.splat or item.name == "*":
                    if isinstance(value, Row):
                        out |= value.fields
                    elif isinstance(value, Open):
                        out |= {k: self.field(value, k) for k in self.engine.keys_of(self.df, value.col)}
                    else:
                        out["value"] = value
                else:
                    out[_unquoted(item)] = value
        return out

    def column_expr(self, item: t.ColumnExpr) -> dict[str, Value]:
        """Runs a query over the columns; what it says of row counts takes one aggregation."""
        leaves = self.whole().fields if item.structured else self.whole().leaves()
        wants = any(_mentions(e, "rowcount") for e in (item.where, item.as_, item.select, *[e for e, _ in item.order]) if e is not None)
        counts: dict[str, int] = {}
        if wants and leaves:
            names = list(leaves)
            row = self.df.agg(*[F.count(v.column()).alias(f"c{i}") for i, v in enumerate(leaves.values())]).first()
            counts = dict(zip(names, row, strict=True))
        from .columns import ColumnScope

        chosen = []
        for name, value in leaves.items():
            scope = ColumnScope(name, value, counts.get(name, 0), self)
            if item.where is None or scope.constant(item.where):
                chosen.append((scope, name, value))
        for e, up in reversed(item.order):
            chosen.sort(key=lambda x: (lambda k: (k is not None, k))(x[0].constant(e)), reverse=not up)
        end = None if item.limit is None else item.offset + item.limit
        out = {}
        for scope, name, value in chosen[item.offset : end]:
            new = scope.constant(item.as_) if item.as_ is not None else name
            out[".".join(new) if isinstance(new, (list, tuple)) else str(new)] = value if item.select is None else scope.value(item.select)
        return out

    # expressions

    def value(self, e: t.Expr) -> Value:
        if e.text in self.known:
            return self.known[e.text]
        return getattr(self, "on_" + type(e).__name__.lower())(e)

    def column(self, e: t.Expr) -> Column:
        return self.value(e).column()

    def boolean(self, e: t.Expr) -> Column:
        col = self.column(e)
        kind = self.type(col)
        if isinstance(kind, T.BooleanType):
            return col
        if isinstance(kind, T.StringType):
            return F.length(col) > 0
        if isinstance(kind, T.NullType):
            return F.lit(None).cast("boolean")
        return col != 0 if isinstance(kind, NUMBERS) else col.isNotNull()

    def on_literal(self, e: t.Literal) -> Value:
        if e.kind == "timestamp":
            return Atom(F.timestamp_seconds(F.lit(e.value)) if isinstance(e.value, float) else F.lit(e.value).try_cast("timestamp"))
        if e.kind == "interval":
            return Interval(*map(F.lit, parse_interval(e.value)))
        return Atom(F.lit(e.value), const=e.value)

    def on_ref(self, e: t.Ref) -> Value:
        return self.lookup(e.path)

    def on_param(self, e: t.Param) -> Value:
        if e.name not in self.params:
            raise QueryError(f"no value for parameter ${e.name}")
        v = self.params[e.name]
        return v if isinstance(v, Value) else self.wrap(v) if isinstance(v, Column) else self.constant_value(v)

    def constant_value(self, v: object) -> Value:
        if isinstance(v, dict):
            return Row({k: self.constant_value(x) for k, x in v.items()})
        if isinstance(v, (list, tuple)):
            return Emb(F.array(*[self.constant_value(x).column() for x in v]))
        return Atom(F.lit(v), const=v)

    def on_rowliteral(self, e: t.RowLiteral) -> Value:
        return Row(self.items(e.items))

    def on_embedding(self, e: t.Embedding) -> Value:
        values = [self.value(x) for x in e.items]
        consts = [v.const if isinstance(v, Atom) else None for v in values]
        consts = None if None in consts else consts
        cols = [v.column() for v in values]
        if not cols:
            return Emb(F.array().cast("array<double>"))
        kinds = {type(self.type(c)) for c in cols}
        if len(kinds) > 1 and kinds <= set(NUMBERS) | {T.NullType}:
            cols = [c.cast("double") for c in cols]
        elif len(kinds) > 1:
            cols = [c.cast("string") for c in cols]
        return Emb(F.array(*cols), consts)

    def on_extract(self, e: t.Extract) -> Value:
        value = self.value(e.arg)
        if isinstance(e.key, t.RowLiteral):
            inner = value if isinstance(value, Row) else Row()
            sub = Scope.over(self, inner)
            return Row(sub.items(e.key.items))
        if isinstance(e.key, t.Ref) and isinstance(value, (Row, Open)) and not (len(e.key.path) == 1 and e.key.path[0] in self.names and isinstance(value, Open)):
            return self.field(value, ".".join(e.key.path))
        key = self.value(e.key)
        if isinstance(key, Atom) and key.const is not None:
            return self.field(value, str(key.const))
        if isinstance(value, Open):
            return self.wrap(F.try_element_at(value.col, key.column().cast("string")))
        if isinstance(value, Emb):
            return self.wrap(F.get(value.col, key.column().cast("int")))
        leaves = value.leaves() if isinstance(value, Row) else {}
        out = F.lit(None)
        for name, leaf in leaves.items():
            out = F.when(key.column().cast("string") == name, leaf.column()).otherwise(out)
        return Atom(out)

    @staticmethod
    def over(scope: Scope, row: Row) -> Scope:
        """A scope whose names are the fields of a row."""
        out = Scope(scope.engine, scope.df, params=scope.params, known=scope.known)
        out.names, fields = list(row.leaves()), row.leaves()
        out.by_name = lambda name: fields[name]  # type: ignore[method-assign]
        return out

    def on_unary(self, e: t.Unary) -> Value:
        from ..functions import arithmetic as a

        if e.op == "NOT":
            return Atom(~self.boolean(e.arg))
        return a.unary(self, e.op, self.value(e.arg))

    def on_binary(self, e: t.Binary) -> Value:
        from ..functions import arithmetic as a

        if e.op == "AND":
            return Atom(self.boolean(e.left) & self.boolean(e.right))
        if e.op == "OR":
            return Atom(self.boolean(e.left) | self.boolean(e.right))
        return a.binary(self, e.op, self.value(e.left), self.value(e.right))

    def on_between(self, e: t.Between) -> Value:
        from ..functions import arithmetic as a

        x = self.value(e.arg)
        out = a.binary(self, ">=", x, self.value(e.low)).column() & a.binary(self, "<=", x, self.value(e.high)).column()
        return Atom(~out if e.negated else out)

    def on_in(self, e: t.In) -> Value:
        """A null element is passed over, so the answer is never unknown unless the operand is."""
        from ..functions import arithmetic as a

        x = self.value(e.arg)
        col = x.column()
        if e.kind == "list":
            out = F.lit(False)
            for item in e.items:
                v = self.value(item)
                if isinstance(v, Row) and not v.fields:
                    continue
                out = out | F.coalesce(a.binary(self, "=", x, v).column(), F.lit(False))
        elif e.kind in ("keys", "values"):
            row = self.value(e.items[0])
            if isinstance(row, Open):
                inside = F.map_keys(row.col) if e.kind == "keys" else F.map_values(row.col)
                out = F.coalesce(F.array_contains(inside, col), F.lit(False))
            elif isinstance(row, Emb):
                out = F.coalesce(F.array_contains(row.col, col), F.lit(False)) if e.kind == "values" else (col.cast("int") >= 0) & (col.cast("int") < F.size(row.col))
            else:
                leaves = row.leaves() if isinstance(row, Row) else {}
                out = F.lit(False)
                for k, v in leaves.items():
                    out = out | (F.coalesce(col.cast("string") == k, F.lit(False)) & v.column().isNotNull() if e.kind == "keys" else F.coalesce(a.binary(self, "=", x, v).column(), F.lit(False)))
        else:
            flag = self.engine.in_flags.get(id(e))
            if flag is None:
                raise QueryError("IN (SELECT ...) can stand only in WHERE")
            out = F.coalesce(q(flag), F.lit(False))
        out = F.when(col.isNull(), F.lit(None).cast("boolean")).otherwise(out)
        return Atom(~out if e.negated else out)

    def on_like(self, e: t.Like) -> Value:
        x, p = self.value(e.arg), self.value(e.pattern)
        if not isinstance(p, Atom):
            raise QueryError("LIKE needs a string")
        out = x.column().like(p.const) if isinstance(p.const, str) else F.like(x.column(), p.col)
        return Atom(~out if e.negated else out)

    def on_is(self, e: t.Is) -> Value:
        x = self.value(e.arg)
        col = x.column()
        if e.what == "NULL":
            out = col.isNull()
        elif e.what in ("TRUE", "FALSE"):
            b = self.boolean(e.arg)
            out = F.coalesce(b if e.what == "TRUE" else ~b, F.lit(False))
        else:
            kind = self.type(col)
            if e.what == "INTEGER" and isinstance(kind, (T.FloatType, T.DoubleType)):
                out = col.isNotNull() & (F.floor(col) == col)
            else:
                right = {"STRING": T.StringType, "NUMBER": (*NUMBERS, T.BooleanType), "INTEGER": (*WHOLE, T.BooleanType), "TIMESTAMP": (T.TimestampType, T.TimestampNTZType), "INTERVAL": ()}[e.what]
                good = isinstance(x, Interval) if e.what == "INTERVAL" else isinstance(kind, right)
                out = col.isNotNull() if good else F.lit(False)
        return Atom(~out if e.negated else out)

    def on_case(self, e: t.Case) -> Value:
        from ..functions import arithmetic as a

        out = None
        subject = self.value(e.subject) if e.subject is not None else None
        values = [self.value(v) for _, v in e.whens] + ([self.value(e.otherwise)] if e.otherwise is not None else [])
        cols = a.alike(self, [v.column() for v in values])
        for (cond, _), col in zip(e.whens, cols, strict=False):
            c = self.boolean(cond) if subject is None else a.binary(self, "=", subject, self.value(cond)).column()
            out = F.when(c, col) if out is None else out.when(c, col)
        if e.otherwise is not None:
            out = out.otherwise(cols[-1])
        return self.wrap(out)

    def on_cast(self, e: t.Cast) -> Value:
        from ..functions import arithmetic as a

        return a.cast(self, self.value(e.arg), e.type)

    def on_call(self, e: t.Call) -> Value:
        from ..functions import registry

        return registry.call(self, e)


def _unquoted(item: t.Item) -> str:
    """Column names of plain references are the names themselves."""
    if isinstance(item.expr, t.Ref) and item.name == item.expr.text:
        return ".".join(item.expr.path)
    return item.name


def _mentions(e, name: str) -> bool:
    if isinstance(e, t.Call) and e.name.lower() == name:
        return True
    if isinstance(e, (list, tuple)):
        return any(_mentions(x, name) for x in e)
    return hasattr(e, "__dataclass_fields__") and any(_mentions(getattr(e, f), name) for f in e.__dataclass_fields__)


def scope_of(engine, table: Table, aliases: tuple[str, ...], params: dict | None) -> Scope:
    return Scope(engine, table.df, table.versioned, aliases, params)
