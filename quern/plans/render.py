"""Results as plain Python values, in the formats of the query interface."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Row as SparkRow

from ..dialect.lexer import QueryError
from .table import ROW, Table


def plain(v: object) -> object:
    """Whole doubles are integers, booleans 1 and 0, times ISO texts."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and v == int(v) if isinstance(v, float) and abs(v) < 2**53 else False:
        return int(v)
    if isinstance(v, datetime):
        return v.isoformat() + "Z"
    if isinstance(v, SparkRow):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v


def render(table: Table, format: str = "full") -> object:  # noqa: A002
    columns = table.columns
    rows = [r.asDict() for r in table.df.collect()]
    for r in rows:
        for c in columns:
            r[c] = [(plain(x["v"]), plain(x["ts"])) for x in r[c]] if c in table.versioned and r[c] else plain(r[c])
    one = lambda r, c: r[c][-1][0] if c in table.versioned and r[c] else r[c]
    if format == "full":
        out = []
        for r in rows:
            cells = []
            for c in columns:
                if r[c] is not None:
                    cells += [[c, v, ts] for v, ts in r[c]] if c in table.versioned else [[c, r[c], plain(r.get("_ts"))]]
            out.append({"rowName": r[ROW], "columns": cells})
        return out
    if format == "table":
        return [["_rowName", *columns], *[[r[ROW], *[one(r, c) for c in columns]] for r in rows]]
    if format == "aos":
        return [{"_rowName": r[ROW]} | {c: one(r, c) for c in columns} for r in rows]
    if format == "soa":
        return {"_rowName": [r[ROW] for r in rows]} | {c: [one(r, c) for r in rows] for c in columns}
    if format == "sparse":
        return [[["_rowName", r[ROW]], *[[c, one(r, c)] for c in columns if r[c] is not None]] for r in rows]
    if format == "atom":
        if len(rows) != 1 or len(columns) != 1:
            raise QueryError(f"an atom needs one row and one column, not {len(rows)} and {len(columns)}")
        return one(rows[0], columns[0])
    raise QueryError(f"unknown format {format!r}")
