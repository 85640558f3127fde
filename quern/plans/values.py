"""What an expression can be while it is analysed: an atom, a row, an embedding, an open row, an interval."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class Value:
    def column(self) -> Column:
        raise NotImplementedError


@dataclass
class Atom(Value):
    """One value; ``versions`` is array<struct<ts, v>> where a cell has several in time."""

    col: Column
    versions: Column | None = None
    ts: Column | None = None
    const: object = None

    def column(self) -> Column:
        return self.col


@dataclass
class Row(Value):
    """Named values whose names are known."""

    fields: dict[str, Value] = field(default_factory=dict)

    def column(self) -> Column:
        return F.struct(*[v.column().alias(k) for k, v in self.fields.items()]) if self.fields else F.lit(None)

    def leaves(self, prefix: str = "") -> dict[str, Value]:
        """Atoms and other ends by dotted name."""
        out: dict[str, Value] = {}
        for k, v in self.fields.items():
            out |= v.leaves(f"{prefix}{k}.") if isinstance(v, Row) else {prefix + k: v}
        return out


@dataclass
class Emb(Value):
    """An array, of any number of dimensions."""

    col: Column
    constants: list | None = None

    def column(self) -> Column:
        return self.col


@dataclass
class Open(Value):
    """A row whose names are data: map<string, value>."""

    col: Column

    def column(self) -> Column:
        return self.col


@dataclass
class Interval(Value):
    """Months, days and seconds, which don't convert into each other."""

    months: Column
    days: Column
    seconds: Column

    def column(self) -> Column:
        return F.struct(self.months.cast("int").alias("months"), self.days.cast("int").alias("days"), self.seconds.cast("double").alias("seconds"))

    def spark(self) -> Column:
        return F.make_interval(F.lit(0), self.months.cast("int"), F.lit(0), self.days.cast("int"), F.lit(0), F.lit(0), self.seconds.cast("decimal(18,6)"))
