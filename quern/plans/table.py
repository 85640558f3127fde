"""Datasets: named columns with a row name, and the encoding as cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_rowName"
TS = "_ts"


def q(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Table:
    """A DataFrame with a row name and, where cells have several versions, the names of such columns
    (each array<struct<ts, v>>, in order of time)."""

    df: DataFrame
    versioned: frozenset[str] = frozenset()
    key: str | None = None  # the column that the row name is made of, if it isn't there yet

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (ROW, TS) and not c.startswith("__")]

    def with_row_name(self) -> Table:
        """Row names come from the key, or else number the rows."""
        if ROW in self.df.columns:
            return self
        name = q(self.key).cast("string") if self.key else F.monotonically_increasing_id().cast("string")
        return Table(self.df.withColumn(ROW, name), self.versioned, self.key)

    def cells(self) -> DataFrame:
        """(row, column, value, ts): one row for each version of each cell that has a value.

        Values get one type: that of all columns if they agree, double for numbers, else string.
        """
        table = self.with_row_name()
        df, kinds = table.df, dict(table.df.dtypes)
        ts = q(TS) if TS in df.columns else F.lit(None).cast("timestamp")
        plain = {c: kinds[c] if c not in self.versioned else kinds[c].split("v:")[-1].rstrip(">") for c in table.columns}
        numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
        kind = next(iter(set(plain.values()))) if len(set(plain.values())) == 1 else "double" if all(k in numbers or k.startswith("decimal") for k in plain.values()) else "string"
        entries = []
        for c in table.columns:
            if c in self.versioned:
                entries.append(F.transform(F.coalesce(q(c), F.array().cast(kinds[c])), _version(c, kind)))
            else:
                value = q(c).cast("int").cast(kind) if plain[c] == "boolean" else q(c).cast(kind)
                entries.append(F.array(F.struct(F.lit(c).alias("column"), value.alias("value"), ts.alias("ts"))))
        if not entries:
            return df.select(q(ROW).alias("row"), F.lit("").alias("column"), F.lit(None).cast("string").alias("value"), ts.alias("ts")).limit(0)
        return df.select(q(ROW).alias("row"), F.explode(F.concat(*entries)).alias("e")).select("row", "e.column", "e.value", "e.ts").where("value is not null")

    @staticmethod
    def of_cells(cells: DataFrame, columns: list[str] | None = None, empty_rows: DataFrame | None = None, timed: bool = False) -> Table:
        """From (row, column, value, ts) to columns.  Names are looked up once unless given; a cell
        with several versions makes its column one of versions, and so does ``timed``, which keeps all times."""
        if columns is None:
            columns = sorted(r[0] for r in cells.select("column").distinct().collect())
        many = timed or cells.groupBy("row", "column").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
        if many:
            value = F.array_sort(F.collect_list(F.struct("ts", F.col("value").alias("v"))))
        else:
            value = F.first("value")
        df = cells.groupBy(F.col("row").alias(ROW)).pivot("column", columns).agg(value) if columns else cells.select(F.col("row").alias(ROW)).distinct()
        if empty_rows is not None:
            df = empty_rows.select(F.col("row").alias(ROW)).distinct().join(df, ROW, "left")
        if many:  # no version at all is null, not an empty list
            df = df.select(ROW, *[F.when(F.size(q(c)) > 0, q(c)).alias(c) for c in columns])
            return Table(df, frozenset(columns))
        return Table(df)


def _version(name: str, kind: str):
    return lambda x: F.struct(F.lit(name).alias("column"), x["v"].cast(kind).alias("value"), x["ts"].alias("ts"))
