"""Lowers a SELECT to DataFrame operators; Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import tree as t
from ..dialect.lexer import QueryError
from ..functions import aggregates, arithmetic
from ..operators import tables
from .scope import Scope, _mentions
from .table import ROW, TS, Table, q
from .values import Atom, Emb, Open, Row, Value

ROW_WORDS = ("rowname", "rowpath", "rowpathelement", "rowhash")


def run(engine, s: t.Select, params: dict | None = None) -> Table:
    params = params or {}
    wants = any(_mentions(x, w) for x in (s.items, s.named, s.where, s.group, s.order, s.having, s.distinct_on) if x is not None for w in ROW_WORDS)
    table, aliases = source(engine, s.from_, params, wants)
    if wants:
        table = table.with_row_name()
    df = table.df
    scope = Scope(engine, df, table.versioned, aliases, params)
    if s.where is not None:
        df = where(engine, scope, s.where, params)
        scope = Scope(engine, df, table.versioned, aliases, params)
    if s.when is not None:
        df = when(scope, s.when)
        scope = Scope(engine, df, table.versioned, aliases, params)
    calls = aggregates.calls_in([s.items, s.having, s.order])
    if s.grouped or calls:
        return grouped(engine, s, scope, calls)
    return project(s, scope, ROW in df.columns)


# tables


def source(engine, f: t.From | None, params: dict, names: bool) -> tuple[Table, tuple[str, ...]]:
    if f is None:
        return Table(engine.spark.range(1).select(F.lit("result").alias(ROW))), ()
    if isinstance(f, t.Named):
        return engine.table(f.name), (f.alias or f.name,)
    if isinstance(f, t.SubSelect):
        return run(engine, f.select, params), ((f.alias,) if f.alias else ())
    if isinstance(f, t.TableCall):
        return call(engine, f, params), ((f.alias,) if f.alias else ())
    return join(engine, f, params)


def call(engine, f: t.TableCall, params: dict) -> Table:
    if f.name in ("row_dataset", "atom_dataset"):
        scope = Scope(engine, engine.spark.range(1), params=params)
        return tables.row_dataset(scope, scope.value(f.args[0]), f.name == "atom_dataset")
    parts = [source(engine, x, params, True)[0] for x in f.args]
    options: dict = {}
    if f.options is not None:
        scope = Scope(engine, engine.spark.range(1), params=params)
        options = {k: v.const for k, v in scope.value(f.options).fields.items()}
    return getattr(tables, f.name)(*parts, **options)


def _side(engine, f: t.From, params: dict) -> tuple[DataFrame, tuple[str, ...], Column]:
    """A join's side with its columns under the alias, and what its rows are called."""
    table, aliases = source(engine, f, params, True)
    if isinstance(f, t.Join):
        return table.df, aliases, q(ROW)
    if not aliases:
        raise QueryError("a joined sub-select needs a name")
    alias = aliases[0]
    if ROW not in table.df.columns and table.key:
        table = table.with_row_name()
    df = table.df
    name = f"__row_{alias}"
    has = ROW in df.columns
    out = df.select(*[q(c).alias(f"{alias}.{c}") for c in table.columns], (q(ROW) if has else F.lit("")).alias(name))
    return out, aliases, q(name)


def join(engine, f: t.Join, params: dict) -> tuple[Table, tuple[str, ...]]:
    left, la, ln = _side(engine, f.left, params)
    right, ra, rn = _side(engine, f.right, params)
    if set(la) & set(ra):
        raise QueryError(f"the name {sorted(set(la) & set(ra))[0]} stands on both sides of a join")
    if ROW in left.columns:
        left = left.withColumnRenamed(ROW, "__joined").drop("__left", "__right")
        ln = q("__joined")
    both = left.join(right, F.lit(True), "cross")
    cond = F.lit(True)
    if f.on is not None:
        cond = Scope(engine, both, aliases=(*la, *ra), params=params).boolean(f.on)
    df = both if f.on is None and f.how == "inner" else left.join(right, cond, f.how)
    nothing = "-".join(["[]"] * len(la))
    left_name = F.coalesce(ln, F.lit(nothing)) if len(la) > 1 else F.concat(F.lit("["), F.coalesce(ln, F.lit("")), F.lit("]"))
    df = df.withColumns({ROW: F.concat(left_name, F.lit("-["), F.coalesce(rn, F.lit("")), F.lit("]")), "__left": ln, "__right": rn})
    return Table(df), (*la, *ra)


# filters


def conjuncts(e: t.Expr) -> list[t.Expr]:
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, t.Binary) and e.op == "AND" else [e]


def subselects(e: object) -> list[t.In]:
    if isinstance(e, t.In) and e.kind == "select":
        return [e]
    if isinstance(e, t.Select):
        return []
    if isinstance(e, (list, tuple)):
        return [x for y in e for x in subselects(y)]
    return [x for f in getattr(e, "__dataclass_fields__", {}) for x in subselects(getattr(e, f))]


def _values(engine, s: t.Select, params: dict) -> DataFrame:
    """The non-null values of all columns of a sub-select."""
    table = run(engine, s, params)
    cols = table.columns
    df = table.df.select(q(cols[0]).alias("__v")) if len(cols) == 1 else table.df.select(F.explode(F.array(*[q(c) for c in cols])).alias("__v"))
    return df.where("__v is not null")


def _comparable(scope: Scope, x: Column, values: DataFrame) -> tuple[Column, DataFrame] | None:
    kind, other = scope.type(x), values.schema[0].dataType
    if arithmetic.rank(kind) != arithmetic.rank(other):
        return None
    return x, values


def where(engine, scope: Scope, e: t.Expr, params: dict) -> DataFrame:
    """IN (SELECT) among the conditions is a semi or anti join; nulls among its values tell nothing."""
    df = scope.df
    rest = []
    for c in conjuncts(e):
        if isinstance(c, t.In) and c.kind == "select":
            x = scope.column(c.arg)
            pair = _comparable(scope, x, _values(engine, c.select, params))
            if pair is None:
                df = df.where(x.isNotNull() if c.negated else F.lit(False))
                continue
            df = df.where(x.isNotNull()).join(pair[1], x == F.col("__v"), "left_anti" if c.negated else "left_semi")
        else:
            rest.append(c)
    flags = []
    for i, c in enumerate(subselects(rest)):  # within OR or NOT: a mark from a join with distinct values
        x = scope.column(c.arg)
        flag = f"__in{id(c)}"
        pair = _comparable(scope, x, _values(engine, c.select, params))
        if pair is None:
            df = df.withColumn(flag, F.lit(False))
        else:
            marks = pair[1].distinct().select(F.col("__v").alias(f"__v{i}"), F.lit(True).alias(flag))
            df = df.join(marks, x == F.col(f"__v{i}"), "left").drop(f"__v{i}")
        engine.in_flags[id(c)] = flag
        flags.append((id(c), flag))
    inner = Scope(engine, df, scope.versioned, scope.aliases, scope.params, scope.known)
    for c in rest:
        df = df.where(inner.boolean(c))
    for key, flag in flags:
        df = df.drop(flag)
        engine.in_flags.pop(key, None)
    return df


def when(scope: Scope, e: t.Expr) -> DataFrame:
    """Keeps the versions of cells whose time satisfies the condition; rows stay."""
    df = scope.df
    out = {}
    for name in scope.names:
        if name in scope.versioned:
            kept = F.filter(q(name), lambda v: _at(scope, e, v["ts"]))
            out[name] = F.when(F.size(kept) > 0, kept)
        elif scope.ts is not None:
            out[name] = F.when(_at(scope, e, scope.ts), q(name))
        else:
            out[name] = F.when(_at(scope, e, F.lit(None).cast("timestamp")), q(name))
    return df.withColumns(out) if out else df


def _at(scope: Scope, e: t.Expr, ts: Column) -> Column:
    """The condition with value_timestamp() bound; its other parts are constants or columns."""
    inner = Scope(scope.engine, scope.df, scope.versioned, scope.aliases, scope.params, dict(scope.known))
    stamp = Atom(ts)
    typed = inner.type

    def type_of(value):
        col = value.column() if isinstance(value, Value) else value
        return T.TimestampType() if col is ts else typed(value)

    inner.type = type_of  # type: ignore[method-assign]
    inner.known |= {"value_timestamp()": stamp}
    out = _condition(inner, e)
    return F.coalesce(out, F.lit(False))


def _condition(scope: Scope, e: t.Expr) -> Column:
    if isinstance(e, t.Binary) and e.op in ("AND", "OR"):
        a, b = _condition(scope, e.left), _condition(scope, e.right)
        return a & b if e.op == "AND" else a | b
    if isinstance(e, t.Unary) and e.op == "NOT":
        return ~_condition(scope, e.arg)
    if isinstance(e, t.Literal):
        return F.lit(bool(e.value)) if e.value is not None else F.lit(None).cast("boolean")
    return scope.value(e).column()


# projections


def spread(values: dict[str, Value]) -> list[tuple[str, Column]]:
    """Rows become dotted columns."""
    out: dict[str, Column] = {}
    for name, v in values.items():
        if isinstance(v, Row):
            out |= {f"{name}.{k}": x.column() for k, x in v.leaves().items()}
        else:
            out[name] = v.column()
    return list(out.items())


def order_keys(scope: Scope, order: list[tuple[t.Expr, bool]]) -> list[tuple[Column, bool]]:
    """Null, then numbers with NaN first, then texts."""
    out = []
    for e, up in order:
        v = scope.value(e)
        if isinstance(v, Atom) and v.const is not None:
            continue
        for c in [x.column() for x in v.leaves().values()] if isinstance(v, Row) else [v.column()]:
            if isinstance(scope.type(c), (T.DoubleType, T.FloatType)):
                out.append((F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2), up))
            out.append((c, up))
    return out


def project(s: t.Select, scope: Scope, named_rows: bool) -> Table:
    values = scope.items(s.items)
    cols = spread(values)
    aliases = {k: v for k, v in values.items() if k not in scope.names}
    ordering = Scope(scope.engine, scope.df, scope.versioned, scope.aliases, scope.params, {**aliases, **scope.known})
    ordering.by_name, ordering.names = scope.by_name, scope.names  # type: ignore[method-assign]
    keys = order_keys(ordering, s.order)
    distinct = [ordering.column(e) for e in s.distinct_on]
    has_row = named_rows or s.named is not None
    extra = [(f"__o{i}", c) for i, (c, _) in enumerate(keys)] + [(f"__d{i}", c) for i, c in enumerate(distinct)]
    if s.named is not None:
        v = scope.value(s.named)
        from ..functions.registry import stringify_path

        extra.append((ROW, stringify_path(scope, v).column() if isinstance(v, Emb) else v.column().cast("string")))
    elif named_rows:
        extra.append((ROW, q(ROW)))
    if TS in scope.df.columns:
        extra.append((TS, q(TS)))
    carried = _carried(scope, values)
    df = scope.df.select(*[c.alias(n) for n, c in cols if n not in carried], *[q(v).alias(n) for n, v in carried.items()], *[c.alias(n) for n, c in extra])
    df = df.select(*[q(n) for n, _ in cols], *[q(n) for n, _ in extra])
    sort = [F.col(f"__o{i}").asc() if up else F.col(f"__o{i}").desc() for i, (_, up) in enumerate(keys)]
    if sort and has_row:
        sort.append(F.xxhash64(ROW))
    if distinct:
        df = tables.first_of_each(df, [f"__d{i}" for i in range(len(distinct))], sort)
    if sort:
        df = df.orderBy(*sort)
    if s.offset:
        df = df.offset(s.offset)
    if s.limit is not None:
        df = df.limit(s.limit)
    return Table(df.drop(*[n for n, _ in extra if n.startswith("__")]), frozenset(carried))


def _carried(scope: Scope, values: dict[str, Value]) -> dict[str, str]:
    """Selected columns that keep all versions of their cells."""
    out = {}
    for name, v in values.items():
        if isinstance(v, Atom) and v.versions is not None:
            for c in scope.versioned:
                if str(v.versions) == str(q(c)):
                    out[name] = c
    return out


# groups


def grouped(engine, s: t.Select, scope: Scope, calls: list[t.Call]) -> Table:
    for item in s.items:
        if isinstance(item, t.Wildcard):
            raise QueryError("* can't be selected from groups")
    keys = [(e, scope.value(e)) for e in s.group]
    flat: list[Column] = []
    known_keys: list[tuple[t.Expr, Value]] = []
    for e, v in keys:
        if isinstance(v, Row):
            fields = {}
            for k, x in v.leaves().items():
                fields[k] = f"__k{len(flat)}"
                flat.append(x.column().alias(fields[k]))
            known_keys.append((e, Row({k: Atom(F.col(n)) for k, n in fields.items()})))
        else:
            name = f"__k{len(flat)}"
            flat.append(v.column().alias(name))
            known_keys.append((e, type(v)(F.col(name)) if isinstance(v, (Emb, Open)) else Atom(F.col(name))))
    made: list[Column] = []
    known: dict[str, Value] = {}
    for c in calls:
        if c.text in known:
            continue
        v = aggregates.build(scope, c)

        def name(col: Column) -> Column:
            made.append(col.alias(f"__a{len(made)}"))
            return F.col(f"__a{len(made) - 1}")

        if isinstance(v, Row):
            known[c.text] = Row({k: Atom(name(x.column())) for k, x in v.leaves().items()})
        elif isinstance(v, Open):
            known[c.text] = Open(name(v.col))
        else:
            known[c.text] = Atom(name(v.column()))
    counted = any(aggregates.plain_name(c.name) == "count" for c in calls)
    if flat:
        df = scope.df.groupBy(*flat).agg(*made) if made else scope.df.select(*flat).distinct()
    else:
        df = scope.df.agg(*made, F.count(F.lit(1)).alias("__n")) if made else scope.df.agg(F.count(F.lit(1)).alias("__n"))
        if not counted:
            df = df.where("__n > 0")
        df = df.drop("__n") if made else df
    known |= {e.text: v for e, v in known_keys}
    names = [F.col(f"__k{i}") for i in range(len(flat))]
    shown = [F.coalesce(_shown(df, c), F.lit("null")) for c in names]
    wants = s.named is None and any(_mentions(x, w) for x in (s.items, s.order) for w in ROW_WORDS)
    if wants or engine.group_names:
        parts: list[Column] = []
        for i, c in enumerate(shown):
            parts += ([F.lit(",")] if i else []) + [c]
        df = df.withColumn(ROW, F.concat(F.lit("["), *parts, F.lit("]")))
    inner = Scope(engine, df, aliases=scope.aliases, params=scope.params, known=known)
    inner.names = []
    for n, (_, v) in enumerate(known_keys):
        known[f"groupKeyElement({n})"] = known[f"group_key_element({n})"] = v
    # a key may also be named without its table
    for e, v in known_keys:
        if isinstance(e, t.Ref):
            known.setdefault(".".join(e.path), v)
            if len(e.path) > 1 and e.path[0] in scope.aliases:
                known.setdefault(".".join(e.path[1:]), v)
            elif len(scope.aliases) == 1:
                known.setdefault(f"{scope.aliases[0]}.{'.'.join(e.path)}", v)
    if s.having is not None:
        df = df.where(inner.boolean(s.having))
        inner.df = df
    return project(s, inner, ROW in df.columns)


def _shown(df: DataFrame, c: Column) -> Column:
    kind = df.select(c.alias("x")).schema[0].dataType
    if isinstance(kind, T.StringType):
        return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return c.cast("string")

