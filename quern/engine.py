"""The engine: named datasets, queries, functions and procedures over one Spark session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect.lexer import QueryError
from .dialect.parser import parse, parse_expr, parse_items
from .plans import select
from .plans.scope import Scope
from .plans.table import ROW, Table
from .plans.values import Value


@dataclass
class Function:
    """A named function: a query over its input, an expression, or any builder of values."""

    apply: Callable[[Scope, list[Value]], Value]
    state: dict = field(default_factory=dict)


class Engine:
    """Datasets by name, and what can be done with them.

    Identifiers tell case apart.  Nothing runs until a result is asked for, but for what a plan
    needs to know beforehand: names of columns that are data, and counts that a query selects by.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        spark.conf.set("spark.sql.caseSensitive", "true")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.tables: dict[str, Table] = {}
        self.functions: dict[str, Function] = {}
        self.sensors: dict[str, Callable[[], object]] = {}
        self.in_flags: dict[int, str] = {}
        self.group_names = False

    # datasets

    def register(self, name: str, data: DataFrame | Table, key: str | None = None) -> Table:
        """Names a dataset; ``key`` is the column that its rows are called by."""
        table = data if isinstance(data, Table) else Table(data, key=key)
        self.tables[name] = table
        return table

    def record(self, name: str, rows: list[tuple[str, list[tuple[str, object, object]]]]) -> Table:
        """A dataset from rows of cells (column, value, time); cells may have several versions."""
        cells, kinds = [], {type(v) for _, cs in rows for _, v, _ in cs if v is not None}
        kind = "double" if kinds <= {int, float, bool} and float in kinds else "bigint" if kinds <= {int, bool} else "string"
        to = {"double": float, "bigint": int, "string": str}[kind]
        for r, cs in rows:
            cells += [(r, c, to(v), ts) for c, v, ts in cs if v is not None]
        df = self.spark.createDataFrame(cells, f"row string, column string, value {kind}, ts timestamp")
        names = self.spark.createDataFrame([(r,) for r, _ in rows], "row string")
        return self.register(name, Table.of_cells(df, sorted({c[1] for c in cells}), names))

    def create_dataset(self, name: str, kind: str, **config: object):
        """A view by its settings (joined, merged, union, transposed, sampled), or a recorder of a new dataset."""
        from .sources.recorder import create

        return create(self, name, kind, **config)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise QueryError(f"no dataset {name!r}")
        return self.tables[name]

    def keys_of(self, df: DataFrame, col: Column) -> list[str]:
        """The names that occur in an open row: data, so they are looked up."""
        return sorted(r[0] for r in df.select(F.explode(F.map_keys(col)).alias("k")).distinct().collect())

    # queries

    def query(self, text: str, **params: object) -> Table:
        return select.run(self, parse(text), params)

    def sql(self, text: str, **params: object) -> DataFrame:
        """The result's columns; its row names only if the query names rows."""
        statement = parse(text)
        table = select.run(self, statement, params)
        keep = [*table.columns, *([ROW] if statement.named is not None and ROW in table.df.columns else [])]
        return table.df.select(*["`" + c.replace("`", "``") + "`" for c in keep])

    def select_items(self, table: Table, items: str, params: dict | None = None) -> list[tuple[str, Column]]:
        """A select list over a table, as named columns."""
        return select.spread(Scope(self, table.df, table.versioned, params=params).items(parse_items(items)))

    def render(self, text: str, format: str = "full", **params: object):  # noqa: A002
        """A query's result as plain values: full, table, aos, soa, sparse or atom."""
        from .plans.render import render

        return render(self.query(text, **params).with_row_name(), format)

    # functions

    def create_function(self, name: str, kind: str | Callable, **config: object) -> Function:
        from .functions.prepared import make

        self.functions[name] = make(self, kind, config)
        return self.functions[name]

    def apply(self, name: str, **inputs: object):
        """One call of a function, as a plain value."""
        from .plans.render import plain

        scope = Scope(self, self.spark.range(1).drop("id"))
        out = self.functions[name].apply(scope, [scope.constant_value(inputs)])
        return plain(scope.df.select(out.column().alias("x")).first()["x"])

    # procedures

    def run(self, kind: str, **params: object):
        """Runs a procedure and returns its result."""
        from .procedures import PROCEDURES

        if kind not in PROCEDURES:
            raise QueryError(f"unknown procedure {kind!r}")
        return PROCEDURES[kind](self, **params)

    def expression(self, df: DataFrame, text: str) -> Column:
        return Scope(self, df).column(parse_expr(text))
