"""Datasets that are recorded row by row or column by column, and views made from settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dialect.lexer import QueryError
from ..operators import tables
from ..plans.table import Table
from ..storage import stored

CELLS = "row string, column string, value string, number int, ts timestamp"
#: Cells that are held before they are written to the shared folder.
HELD = 200_000
#: Pairs of rows that a joined view without a condition may have; a fixed value.
MOST_PAIRS = 100_000_000
HOW = {"JOIN_INNER": "JOIN", "JOIN_LEFT": "LEFT JOIN", "JOIN_RIGHT": "RIGHT JOIN", "JOIN_FULL": "FULL JOIN"}


class Recorder:
    """Takes cells (column, value, time) of rows, or (row, value, time) of columns.

    Cells are kept in the shared folder beyond a bounded number, and can be read after ``commit``, which
    may follow each of several bouts of recording.  With ``timeQuantumSeconds`` cells keep their times,
    rounded down to its multiples.  Cells without a value are left out, but their rows stay.  A dataset's values have
    one type: whole numbers, numbers, or strings.
    """

    def __init__(self, engine, name: str, timeQuantumSeconds: float | None = None, held: int = HELD):  # noqa: N803
        self.engine, self.name, self.quantum, self.most = engine, name, timeQuantumSeconds, held
        self.held: list[tuple] = []
        self.written: list[DataFrame] = []

    def record_row(self, row: str, cells: list[tuple[str, object, object]]) -> None:
        self.held.append((str(row), None, None, None, None))
        for column, value, ts in cells:
            if value is not None:
                number = 0 if isinstance(value, (bool, int)) else 1 if isinstance(value, float) else 2
                self.held.append((str(row), str(column), str(int(value)) if number == 0 else str(value), number, ts))
        if len(self.held) >= self.most:
            self._write()

    def record_rows(self, rows: list[tuple[str, list[tuple[str, object, object]]]]) -> None:
        for row, cells in rows:
            self.record_row(row, cells)

    def record_column(self, column: str, cells: list[tuple[str, object, object]]) -> None:
        for row, value, ts in cells:
            self.record_row(row, [(column, value, ts)])

    def record_columns(self, columns: list[tuple[str, list[tuple[str, object, object]]]]) -> None:
        for column, cells in columns:
            self.record_column(column, cells)

    def _write(self) -> None:
        self.written.append(stored(self.engine.spark.createDataFrame(self.held, CELLS), "recorded"))
        self.held = []

    def commit(self) -> Table:
        """Makes what was recorded so far the dataset."""
        if self.held or not self.written:
            self._write()
        cells = reduce(DataFrame.union, self.written)
        names = cells.select("row").distinct()
        cells = cells.where("column is not null")
        if self.quantum:
            micros = round(self.quantum * 1_000_000)
            cells = cells.withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros("ts") / micros).cast("long") * micros))
        cells = cells.distinct()
        kind = ("bigint", "double", "string")[cells.agg(F.max("number")).first()[0] or 0]
        return self.engine.register(self.name, Table.of_cells(cells.select("row", "column", F.col("value").cast(kind).alias("value"), "ts"), None, names, bool(self.quantum)))


def _joined(engine, left: str, right: str, on: str | None = None, qualification: str = "JOIN_INNER") -> Table:
    if not on:
        sides = [engine.query(f"SELECT * FROM {x}").df.count() for x in (left, right)]
        if sides[0] * sides[1] > MOST_PAIRS:
            raise QueryError(f"a join without a condition would have {sides[0]} x {sides[1]} rows")
    return engine.query(f"SELECT * FROM {left} {HOW[qualification]} {right}" + (f" ON {on}" if on else ""))


#: Views by type, from names of datasets and settings.
VIEWS = {
    "joined": _joined,
    "merged": lambda engine, datasets: tables.merge(*map(engine.table, datasets)),
    "union": lambda engine, datasets: tables.union(*map(engine.table, datasets)),
    "transposed": lambda engine, dataset: tables.transpose(engine.table(dataset)),
    "sampled": lambda engine, dataset, **how: tables.sample(engine.table(dataset), **how),
}
#: Types that are recorded, with the resolution of their times in seconds.
RECORDED = {"sparse.mutable": 1.0, "structured.mutable": None, "tabular": None, "embedding": None}


def create(engine, name: str, kind: str, **config: object) -> Table | Recorder:
    """A view of other datasets, or what records a new one."""
    if kind in VIEWS:
        return engine.register(name, VIEWS[kind](engine, **config))
    if kind in RECORDED:
        quantum = config.get("timeQuantumSeconds", RECORDED[kind])
        return Recorder(engine, name, quantum)
    raise QueryError(f"unknown dataset type {kind!r}")
