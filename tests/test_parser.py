import pytest

from quern.dialect import tree as t
from quern.dialect.lexer import QueryError
from quern.dialect.parser import parse, parse_expr


def test_precedence():
    e = parse_expr("1 + 2 * 3 = 7 AND NOT a OR b")
    assert isinstance(e, t.Binary) and e.op == "OR"
    assert e.left.op == "AND" and e.left.left.op == "="
    assert parse_expr("1 + 2 * 3").right.op == "*"
    assert parse_expr("2IN(4)").kind == "list"


def test_is_binds_tighter_than_plus():
    e = parse_expr("1 + x IS NULL")
    assert e.op == "+" and isinstance(e.right, t.Is)


@pytest.mark.parametrize("bad", ["SELECT", "SELECT 1 FROM", "SELECT 'x", "SELECT DISTINCT x FROM t", "SELECT 1 HAVING 2", "SELECT (SELECT 1)", "SELECT a FROM t GROUP", "SELECT 1 2 3 FROM t ORDER"])
def test_errors(bad):
    with pytest.raises(QueryError):
        parse(bad)


def test_select_items():
    s = parse("SELECT y* EXCLUDING (yellow, yy*) AS z*, x: 1, {a, b: 2} AS r, ds.*, t[0], COLUMN EXPR STRUCTURED (AS columnName() WHERE rowCount() > 2 LIMIT 3)")
    w, x, r, d, e, c = s.items
    assert (w.prefix, w.excluding, w.as_prefix) == ("y", [("yellow", False), ("yy", True)], "z")
    assert x.name == "x" and r.name == "r" and d.table == "ds" and isinstance(e.expr, t.Extract) and c.structured and c.limit == 3


def test_multiplication_is_no_wildcard():
    assert isinstance(parse("SELECT a*b").items[0].expr, t.Binary)
    assert isinstance(parse("SELECT a * 2").items[0].expr, t.Binary)


def test_comments_and_quotes():
    s = parse('SELECT "a ""q" /* x */ AS z -- end\nFROM t')
    assert s.items[0].expr.path == ('a "q',) and s.from_.name == "t"


def test_distinct_on_must_lead_the_order():
    with pytest.raises(QueryError):
        parse("SELECT DISTINCT ON (x) y FROM t ORDER BY y, x")
