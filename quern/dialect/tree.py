"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    text: str = ""


@dataclass
class Literal(Expr):
    value: object
    kind: str = ""  # timestamp, interval, or none
    text: str = ""


@dataclass
class Ref(Expr):
    path: tuple[str, ...]
    text: str = ""


@dataclass
class Param(Expr):
    name: str
    text: str = ""


@dataclass
class Unary(Expr):
    op: str
    arg: Expr
    text: str = ""


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    text: str = ""


@dataclass
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool
    text: str = ""


@dataclass
class In(Expr):
    arg: Expr
    kind: str  # list, select, keys, values
    items: list[Expr] | None
    select: Select | None
    negated: bool
    text: str = ""


@dataclass
class Like(Expr):
    arg: Expr
    pattern: Expr
    negated: bool
    text: str = ""


@dataclass
class Is(Expr):
    arg: Expr
    what: str
    negated: bool
    text: str = ""


@dataclass
class Case(Expr):
    subject: Expr | None
    whens: list[tuple[Expr, Expr]]
    otherwise: Expr | None
    text: str = ""


@dataclass
class Cast(Expr):
    arg: Expr
    type: str
    text: str = ""


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    text: str = ""


@dataclass
class RowLiteral(Expr):
    items: list[Item]
    text: str = ""


@dataclass
class Embedding(Expr):
    items: list[Expr]
    text: str = ""


@dataclass
class Extract(Expr):
    arg: Expr
    key: Expr  # a value or a row literal
    text: str = ""


@dataclass
class Item:
    """One clause of a select list."""

    expr: Expr | None = None
    name: str | None = None
    splat: bool = False  # expr AS *


@dataclass
class Wildcard(Item):
    table: str | None = None
    prefix: str = ""
    excluding: list[tuple[str, bool]] = field(default_factory=list)  # name or prefix
    as_prefix: str | None = None


@dataclass
class ColumnExpr(Item):
    structured: bool = False
    select: Expr | None = None
    as_: Expr | None = None
    when: Expr | None = None
    where: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    offset: int = 0
    limit: int | None = None


class From:
    pass


@dataclass
class Named(From):
    name: str
    alias: str | None = None


@dataclass
class SubSelect(From):
    select: Select
    alias: str | None = None


@dataclass
class TableCall(From):
    name: str
    args: list
    options: Expr | None
    alias: str | None = None


@dataclass
class Join(From):
    left: From
    right: From
    how: str
    on: Expr | None


@dataclass
class Select:
    items: list[Item]
    distinct_on: list[Expr] = field(default_factory=list)
    named: Expr | None = None
    from_: From | None = None
    when: Expr | None = None
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    grouped: bool = False
    having: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
