"""Table operators: transpose, merge, union, sample, rows as tables, first of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.table import ROW, TS, Table, q
from ..plans.values import Emb, Open, Row, Value


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.  Spark keeps the first of each key in a task before it deals
    rows out (WindowGroupLimit), so a frequent key sends one row a task."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)]))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def transpose(table: Table) -> Table:
    """Columns become rows and rows columns.  The names of the new columns are the old row names,
    which are looked up, so the table must have few rows; ``Table.cells`` transposes any."""
    cells = table.cells()
    return Table.of_cells(cells.select(F.col("column").alias("row"), F.col("row").alias("column"), "value", "ts"))


def merge(*parts: Table) -> Table:
    """Rows of one name become one row with the columns of all."""
    if any(p.versioned for p in parts) or any(TS in p.df.columns for p in parts):
        cells = reduce(lambda a, b: a.unionByName(b), [p.cells() for p in parts]).distinct()
        return Table.of_cells(cells)
    out = parts[0].with_row_name().df
    for p in parts[1:]:
        other = p.with_row_name().df
        common = [c for c in out.columns if c in other.columns and c != ROW]
        other = other.select(q(ROW), *[q(c).alias(f"__o_{c}" if c in common else c) for c in p.columns])
        names = [c for c in out.columns if c != ROW] + [c for c in p.columns if c not in common]
        out = out.join(other, ROW, "full").select(q(ROW), *[(F.coalesce(q(c), q(f"__o_{c}")) if c in common else q(c)).alias(c) for c in names])
    return Table(out)


def union(*parts: Table) -> Table:
    """All rows; names get the number of their table, columns match by name."""
    dfs = []
    for i, p in enumerate(parts):
        df = p.with_row_name().df
        dfs.append(df.withColumn(ROW, F.concat(F.lit(f"{i}."), q(ROW))))
    return Table(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs), frozenset().union(*[p.versioned for p in parts]))


def sample(table: Table, rows: int | None = None, fraction: float | None = None, withReplacement: bool = False, seed: int = 0) -> Table:  # noqa: N803
    """A number of rows, exactly, or a share of them, by hash of the row's name and the seed."""
    df = table.with_row_name().df
    if withReplacement:
        if rows is not None:
            total = df.count()
            fraction = rows / max(1, total)
        df = df.sample(True, float(fraction or 0), seed)
    elif rows is not None:
        df = df.orderBy(F.xxhash64(q(ROW), F.lit(seed))).limit(int(rows))
    elif fraction is not None:
        df = df.where(F.pmod(F.xxhash64(q(ROW), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))
    return Table(df, table.versioned, table.key)


def row_dataset(scope, value: Value, atoms: bool = False) -> Table:
    """One row for each column of a row, or for each of its atoms."""
    from ..functions.arithmetic import alike

    df = scope.df
    if isinstance(value, Emb):
        col = value.col
        return Table(df.select(F.posexplode(col).alias("column", "value")).select(F.col("column").cast("string").alias("column"), "value", F.col("column").cast("string").alias(ROW)))
    if isinstance(value, Open):
        return Table(df.select(F.explode(value.col).alias("column", "value")).withColumn(ROW, F.col("column")))
    pairs: list[tuple[str, Column]] = []
    for name, v in (value.leaves() if isinstance(value, Row) else {"": value}).items():
        if atoms and isinstance(v, Emb):
            if v.constants is None:
                pairs.append((name, v.column().cast("string")))
            else:
                pairs += [(f"{name}.{i}", F.get(v.col, F.lit(i))) for i in range(len(v.constants))]
        else:
            pairs.append((name, v.column()))
    cols = alike(scope, [c for _, c in pairs])
    entries = F.array(*[F.struct(F.lit(n).alias("column"), c.alias("value")) for (n, _), c in zip(pairs, cols, strict=True)])
    return Table(df.select(F.explode(entries).alias("e")).select("e.column", "e.value").withColumn(ROW, F.col("column")))


def melt(df: DataFrame, fixed: list[str], melted: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """A row for each of the melted columns, with its name and value; nulls stay out."""
    return df.unpivot([q(c) for c in fixed], [q(c) for c in melted], key, value).where(q(value).isNotNull())
