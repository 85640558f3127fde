import datetime as dt
import math

import pytest

from quern.dialect.lexer import QueryError


def T(day):
    return dt.datetime(1970, 1, day)


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(engine, expr):
    return engine.sql(f"SELECT {expr} AS x").first()[0]


@pytest.fixture()
def joined(engine):
    engine.record("a", [("row1", [("one", 1, T(1)), ("two", 1, T(1))]), ("row2", [("one", 1, T(1)), ("two", 2, T(1))]), ("row3", [("one", 2, T(1)), ("two", 1, T(1))]), ("row4", [("one", 2, T(1)), ("two", 2, T(1))])])
    engine.record("b", [("row0", [("one", 0, T(1))]), ("row1", [("one", 1, T(1))]), ("row2", [("one", 2, T(1))])])
    return engine


@pytest.mark.parametrize("how,expected", [
    ("JOIN", ["[row1]-[row1]", "[row2]-[row1]", "[row3]-[row2]", "[row4]-[row2]"]),
    ("RIGHT JOIN", ["[]-[row0]", "[row1]-[row1]", "[row2]-[row1]", "[row3]-[row2]", "[row4]-[row2]"]),
])
def test_join_names(joined, how, expected):
    out = joined.sql(f"SELECT rowName() AS n FROM a {how} b ON a.one = b.one")
    assert sorted(r[0] for r in out.collect()) == expected


def test_unmatched_left(joined):
    out = joined.sql("SELECT rowName() AS n FROM a LEFT JOIN b ON a.one = b.one AND b.one = 1")
    assert sorted(r[0] for r in out.collect()) == ["[row1]-[row1]", "[row2]-[row1]", "[row3]-[]", "[row4]-[]"]


def test_chained_join_names(joined):
    out = joined.sql("SELECT rowName() AS n FROM a JOIN b ON a.one = b.one JOIN b AS c ON b.one = c.one WHERE a.two = 1")
    assert sorted(r[0] for r in out.collect()) == ["[row1]-[row1]-[row1]", "[row3]-[row2]-[row2]"]


def test_same_name_on_both_sides(joined):
    with pytest.raises(QueryError):
        joined.sql("SELECT 1 AS x FROM a JOIN a ON a.one = a.two")


@pytest.mark.parametrize("expr,value", [
    ("1 / 2", 0.5), ("1 / 0", math.inf), ("-1 / 0", -math.inf), ("'a' + 1", "a1"), ("1 = '1'", False), ("null = null", None), ("2 IN (1, null)", False), ("2 NOT IN (1, null)", True), ("null IN (1)", None),
    ("7 % 3", 1), ("nothing", None), ("5 & 6", 4), ("~0", -1), ("CAST('abc' AS integer)", None), ("CAST('12' AS integer)", 12), ("CAST(1.7 AS integer)", 1), ("'abc' LIKE 'a%'", True), ("1 BETWEEN 1 AND 2", True),
    ("CASE WHEN false THEN 1 END", None), ("log(100)", 2.0), ("log(2, 8)", 3.0), ("ln(0)", -math.inf), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("sign(-3)", -1.0), ("norm([3, 4], 2)", 5.0), ("horizontal_sum({1 AS a, null AS b})", 1.0), ("horizontal_avg({null AS a})", None),
    ("regex_match('abc', 'b')", False), ("regex_search('abc', 'b')", True), ("regex_replace('abc', '(b)', '<\\1>')", "a<b>c"), ("jaccard_index({1 AS a}, {1 AS a, 2 AS b})", 0.5), ("clamp(5, 1, 3)", 3.0), ("replace_null(null, 3)", 3.0),
    ("date_part('dow', TIMESTAMP '2015-01-04')", 0), ("date_part('isodow', TIMESTAMP '2015-01-04')", 7), ("date_part('doy', TIMESTAMP '2015-01-01')", 0), ("date_part('isoyear', TIMESTAMP '2014-12-31')", 2015), ("path_element(parse_path('a.b'), 1)", "b"), ("token_extract('a,b,c', 1)", "b"),
    ("shape([[1,2,3],[4,5,6]])", [2, 3]), ("flatten([[1,2],[3,4]])", [1, 2, 3, 4]), ("slice([[1,2],[3,4]], 1)", [2, 4]), ("concat([1],[2,3])", [1, 2, 3]), ("reshape([1,2,3,4], [2,2])", [[1.0, 2.0], [3.0, 4.0]]), ("base64_encode('ab')", "YWI="), ("mime_type('%PDF-1')", "application/pdf"),
])
def test_expressions(engine, expr, value):
    got = one(engine, expr)
    assert got == value or isinstance(value, float) and got == pytest.approx(value)


def test_times(engine):
    assert one(engine, "TIMESTAMP '2015-01-31' + INTERVAL '1 month'") == dt.datetime(2015, 2, 28)
    assert one(engine, "TIMESTAMP '2015-01-01' + 2") == dt.datetime(2015, 1, 3)
    assert tuple(one(engine, "TIMESTAMP '2015-01-03' - TIMESTAMP '2015-01-01'")) == (0, 2, 0.0)
    assert one(engine, "INTERVAL '60 MINUTE' = INTERVAL '1H'") and one(engine, "INTERVAL '10 s' = INTERVAL '10second'")
    with pytest.raises(QueryError):
        one(engine, "INTERVAL '3 cows'")


def test_rows_and_embeddings(engine):
    assert rows(engine.sql("SELECT {x: 1, y: {z: 2}} AS r")) == [(1, 2)]
    assert engine.sql("SELECT {x: 1, y: {z: 2}} AS r").columns == ["r.x", "r.y.z"]
    assert rows(engine.sql("SELECT {x: 1, y: 2} AS *")) == [(1, 2)]
    assert one(engine, "[1, 2] + [3, 4]") == [4, 6]
    assert rows(engine.sql("SELECT column, value FROM row_dataset({a: 1, b: 2})")) == [("a", 1), ("b", 2)]
    assert sorted(rows(engine.sql("SELECT column, value FROM atom_dataset({a: 1, b: [5, 6]})"))) == [("a", 1), ("b.0", 5), ("b.1", 6)]


@pytest.fixture()
def cells(engine):
    engine.record("when_ts", [("row1", [("colA", 1, T(2)), ("colA", 1, T(4)), ("colA", 1, T(6))])])
    engine.record("temporal", [(f"row{i}", [("x", -i, T(1)), ("x", 0, T(2)), ("x", i + 1, T(3)), ("y", i, T(1)), ("y", 0, T(2)), ("y", -i - 1, T(3))]) for i in (1, 2)])
    return engine


def test_when_keeps_versions(cells):
    full = cells.render("SELECT * FROM when_ts WHEN value_timestamp() > TIMESTAMP '1970-01-03'")
    assert full == [{"rowName": "row1", "columns": [["colA", 1, "1970-01-04T00:00:00Z"], ["colA", 1, "1970-01-06T00:00:00Z"]]}]


def test_temporal(cells):
    got = rows(cells.sql("SELECT temporal_min(x) AS a, temporal_max(x) AS b, temporal_sum(y) AS c, temporal_count(y) AS d, temporal_earliest(y) AS e, temporal_latest(x) AS f, x + 0 AS now FROM temporal ORDER BY rowName()"))
    assert sorted(got) == [(-2, 3, -1.0, 3, 2, 3, 3), (-1, 2, -1.0, 3, 1, 2, 2)]


def test_vertical_aggregates_use_the_latest(cells):
    assert rows(cells.sql("SELECT sum(x) AS s, max(y) AS m FROM temporal")) == [(5.0, -2)]


def test_formats(engine):
    engine.record("f", [("ex1", [("x", 0, T(1)), ("y", 3, T(1))]), ("ex4", [("x", 3, T(1))])])
    text = "SELECT x, y FROM f ORDER BY x"
    assert engine.render(text, "aos") == [{"_rowName": "ex1", "x": 0, "y": 3}, {"_rowName": "ex4", "x": 3, "y": None}]
    assert engine.render(text, "soa") == {"_rowName": ["ex1", "ex4"], "x": [0, 3], "y": [3, None]}
    assert engine.render(text, "table") == [["_rowName", "x", "y"], ["ex1", 0, 3], ["ex4", 3, None]]
    assert engine.render(text, "sparse") == [[["_rowName", "ex1"], ["x", 0], ["y", 3]], [["_rowName", "ex4"], ["x", 3]]]
    assert engine.render("SELECT 1 AS x", "atom") == 1
    with pytest.raises(QueryError):
        engine.render(text, "atom")


def test_groups(engine):
    engine.record("g", [("a", [("x", 1, T(1))]), ("b", [("x", 2, T(1))]), ("d", [("x", 1, T(1))]), ("e", [("x", 3, T(1))])])
    assert rows(engine.sql("SELECT count_distinct(x) AS n FROM g")) == [(3,)]
    assert rows(engine.sql("SELECT rowName() AS r, count(*) AS n FROM g GROUP BY x ORDER BY x")) == [("[1]", 2), ("[2]", 1), ("[3]", 1)]
    assert rows(engine.sql("SELECT x, count(*) AS n FROM g GROUP BY x HAVING count(*) > 1")) == [(1, 2)]
    assert rows(engine.sql("SELECT groupKeyElement(0) AS k FROM g GROUP BY x ORDER BY x LIMIT 1")) == [(1,)]
    assert rows(engine.sql("SELECT sum(x) AS s FROM g WHERE x > 9")) == []
    assert rows(engine.sql("SELECT count(*) AS n, sum(x) AS s FROM g WHERE x > 9")) == [(0, 0.0)]
    assert math.isnan(engine.sql("SELECT stddev(x) AS s FROM g WHERE x = 3").first()[0])


def test_distinct_on(engine):
    engine.record("d", [(f"row{i}", [("x", x, T(1)), ("y", i, T(1))]) for i, x in enumerate((1, 2, 1, 1, 2), 1)])
    assert rows(engine.sql("SELECT DISTINCT ON (x) x, y FROM d ORDER BY x, y")) == [(1, 1), (2, 2)]
    assert rows(engine.sql("SELECT DISTINCT ON (x) x, y FROM d ORDER BY x, y LIMIT 1 OFFSET 1")) == [(2, 2)]


def test_pivot_and_string_agg(engine):
    engine.record("p", [("r1", [("person", "nick", T(1)), ("thing", "appl", T(1)), ("has", "1", T(1))]), ("r2", [("person", "nick", T(1)), ("thing", "goog", T(1)), ("has", "2", T(1))])])
    assert rows(engine.sql("SELECT pivot(thing, has) AS p FROM p GROUP BY person")) == [({"appl": "1", "goog": "2"},)]
    assert rows(engine.sql("SELECT string_agg(thing, ',', has) AS s FROM p")) == [("appl,goog",)]


def test_table_operators(engine):
    engine.record("u1", [("r1", [("a", 1, T(1))])])
    engine.record("u2", [("r1", [("b", 2, T(1))]), ("r2", [("a", 3, T(1))])])
    assert sorted(rows(engine.sql("SELECT rowName() AS r, a, b FROM union(u1, u2)")), key=str) == [("0.r1", 1, None), ("1.r1", None, 2), ("1.r2", 3, None)]
    assert sorted(rows(engine.sql("SELECT rowName() AS r, a, b FROM merge(u1, u2)")), key=str) == [("r1", 1, 2), ("r2", 3, None)]
    assert sorted(rows(engine.sql("SELECT rowName() AS r, r1, r2 FROM transpose(u2)"))) == [("a", None, 3), ("b", 2, None)]
    assert sorted(rows(engine.sql("SELECT rowName() AS r, a, b FROM transpose(transpose(u2))")), key=str) == [("r1", None, 2), ("r2", 3, None)]
    assert engine.sql("SELECT * FROM sample(u2, {rows: 1})").count() == 1


def test_column_expressions(engine):
    engine.record("c", [("r1", [("x", 1, T(1)), ("y", 2, T(1))]), ("r2", [("x", 3, T(1))])])
    assert engine.sql("SELECT COLUMN EXPR (WHERE rowCount() > 1) FROM c").columns == ["x"]
    assert engine.sql("SELECT COLUMN EXPR (AS 'c_' + columnName() ORDER BY rowCount() DESC LIMIT 1) FROM c").columns == ["c_x"]
    assert sorted(rows(engine.sql("SELECT COLUMN EXPR (SELECT value() + 1) FROM c")), key=str) == [(2, 3), (4, None)]


def test_json_and_tokens(engine):
    assert one(engine, """parse_json('{"a":"b","c":{"d":1},"f":["g","h"]}')""") == {"a": "b", "c.d": "1", "f.0": "g", "f.1": "h"}
    assert one(engine, """parse_json('{"f":["g","h"],"i":[{"j":"k"}]}', {arrays: 'encode'})""") == {"f.g": "1", "f.h": "1", "i.0": '{"j":"k"}'}
    assert one(engine, "tokenize('a b c a', {splitChars: ' '})") == {"a": 2, "b": 1, "c": 1}
    assert one(engine, "tokenize('a,b,c', {ngramRange: [2, 2]})") == {"a_b": 1, "b_c": 1}
    assert one(engine, """tokenize('a,"b,c"', {quoteChar: '"'})""") == {"a": 1, "b,c": 1}


def test_recorder(engine):
    """Cells by row and by column, in several bouts; times have the resolution asked for."""
    from quern.sources.recorder import Recorder

    rec = engine.create_dataset("rec", "sparse.mutable", timeQuantumSeconds=60)
    rec.record_row("r1", [("x", 1, dt.datetime(2020, 1, 1, 0, 0, 59)), ("y", None, T(1))])
    rec.record_columns([("x", [("r2", 5, dt.datetime(2020, 1, 1, 0, 2, 1))]), ("z", [("r1", True, T(1))])])
    rec.record_rows([("empty", [])])
    rec.commit()
    assert sorted(rows(engine.sql("SELECT rowName() AS n, x + 0 AS x, z + 0 AS z FROM rec")), key=str) == [("empty", None, None), ("r1", 1, 1), ("r2", 5, None)]
    cells = {(r["row"], r["column"]): r["ts"] for r in engine.table("rec").cells().collect()}
    assert engine.table("rec").df.count() == 3 and cells.keys() == {("r1", "x"), ("r1", "z"), ("r2", "x")}
    assert cells["r1", "x"] == dt.datetime(2020, 1, 1) and cells["r2", "x"] == dt.datetime(2020, 1, 1, 0, 2)
    rec.record_row("r1", [("x", 2.5, dt.datetime(2020, 1, 2))])
    rec.commit()
    assert rows(engine.sql("SELECT x + 0 AS x FROM rec WHERE rowName() = 'r1'")) == [(2.5,)]
    small = Recorder(engine, "small", held=3)
    small.record_rows([(str(i), [("v", "a", T(1))]) for i in range(10)])
    assert len(small.held) < 3 and small.commit().df.count() == 10
    Recorder(engine, "nothing").commit()
    assert engine.table("nothing").df.count() == 0
    with pytest.raises(QueryError):
        engine.create_dataset("x", "no.such")


def test_views_by_settings(joined):
    joined.create_dataset("j", "joined", left="a", right="b", on="a.one = b.one", qualification="JOIN_RIGHT")
    assert sorted(r[0] for r in joined.sql("SELECT rowName() AS n FROM j").collect())[:2] == ["[]-[row0]", "[row1]-[row1]"]
    joined.create_dataset("x", "joined", left="a", right="b")
    assert joined.sql("SELECT count(*) AS n FROM x").first()[0] == 12
    joined.create_dataset("s", "sampled", dataset="a", rows=2, seed=3)
    joined.create_dataset("u", "union", datasets=["a", "b"])
    joined.create_dataset("m", "merged", datasets=["a", "b"])
    joined.create_dataset("t", "transposed", dataset="b")
    assert [joined.sql(f"SELECT count(*) AS n FROM {d}").first()[0] for d in "sumt"] == [2, 7, 5, 1]
    big = joined.spark.range(20_000)
    joined.register("p", big)
    joined.register("q", big)
    with pytest.raises(QueryError):
        joined.create_dataset("no", "joined", left="p", right="q")
