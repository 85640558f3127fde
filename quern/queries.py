"""One query per operator on the standard tables, with DuckDB SQL to compare where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans.table import ROW, Table, q
from .procedures import features, learning
from .storage import shared_path
from .streaming.continuous import latest_by_key

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": None}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine that knows the standard tables."""
    e = Engine(spark)
    for name, key in KEYS.items():
        e.tables[name] = LazyTable(spark, f"{sf_dir}/{name}.parquet", key)
    return e


class LazyTable(Table):
    """A table whose files are looked at when it is first used."""

    def __init__(self, spark: SparkSession, path: str, key: str | None):
        self._spark, self._path, self._df = spark, path, None
        self.versioned, self.key = frozenset(), key

    @property
    def df(self) -> DataFrame:  # type: ignore[override]
        if self._df is None:
            self._df = self._spark.read.parquet(self._path)
        return self._df


def _run(spark: SparkSession, sf_dir: str, text: str, digits: dict[str, int]) -> DataFrame:
    df = engine(spark, sf_dir).sql(text)
    return df.withColumns({c: F.round(q(c), n) for c, n in digits.items()}) if digits else df


def query(name: str, text: str, oracle: str | None = None, **digits: int) -> None:
    """Registers a query of the dialect; digits tell to how many places to round a column."""
    QUERIES[name] = partial(_run, text=text, digits=digits)
    if oracle:
        ORACLE_SQL[name] = oracle


def builder(name: str, oracle: str | None = None):
    def add(f: Callable[[Engine, SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(engine(spark, sf_dir), spark, sf_dir)
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# clauses

query("q01_group_order", "SELECT l_returnflag, sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_returnflag ORDER BY l_returnflag",
      "select l_returnflag, sum(l_quantity) as q, count(*) as n from lineitem where l_shipdate < timestamp '1997-01-01' group by 1")
query("q02_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity % 7 AS m, 'L' + l_linenumber AS tag FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R', null) AND l_linestatus LIKE '_' AND NOT l_tax > 0.05",
      "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, l_quantity % 7 as m, 'L' || l_linenumber as tag from lineitem where l_quantity between 10 and 12 and l_returnflag in ('A','R') and l_linestatus like '_' and not l_tax > 0.05", net=4)
query("q03_case_is_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f, CAST(o_totalprice AS integer) AS whole, CAST('x' AS number) AS bad, o_orderpriority IS STRING AS s, nothing IS NULL AS z, CAST(o_orderkey AS string) AS t FROM orders",
      "select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band, case o_orderstatus when 'F' then 1 else 0 end as f, trunc(o_totalprice)::bigint as whole, null::double as bad, true as s, true as z, o_orderkey::varchar as t from orders")
query("q04_having_limit", "SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY c_nationkey HAVING count(*) > 1 ORDER BY n DESC, c_nationkey LIMIT 7 OFFSET 2",
      "select c_nationkey, count(*) as n, max(c_acctbal) as top from customer group by 1 having count(*) > 1 order by n desc, c_nationkey limit 7 offset 2")
query("q05_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts, event_id",
      "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) where rn = 1")
query("q06_implicit_group", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_tax) AS a, min(l_shipdate) AS first, stddev(l_quantity) AS sd, variance(l_quantity) AS v FROM lineitem",
      "select count(*) as n, sum(l_quantity) as s, round(avg(l_tax), 6) as a, min(l_shipdate) as first, round(stddev_samp(l_quantity), 6) as sd, round(var_samp(l_quantity), 5) as v from lineitem", a=6, sd=6, v=5)
query("q07_empty_aggregates", "SELECT count(*) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_quantity < 0", "select 0::bigint as n, 0.0::double as s")
query("q08_nulls_in_arithmetic", "SELECT n_nationkey, 1 / 2 AS half, 1 / 0 AS inf, n_nationkey / 4 AS quarter, null + 1 AS none, 1 = '1' AS same, n_nationkey IN (1, null) AS one, n_nationkey NOT IN (1, null) AS other FROM nation",
      "select n_nationkey, 0.5::double as half, 'infinity'::double as inf, n_nationkey / 4::double as quarter, null::double as none, false as same, n_nationkey = 1 as one, n_nationkey <> 1 as other from nation")
query("q09_named", "SELECT n_name, n_regionkey NAMED 'r' + n_regionkey + '.' + n_name FROM nation", "select n_name, n_regionkey, 'r' || n_regionkey || '.' || n_name as \"_rowName\" from nation")
query("q10_wildcards", "SELECT c_* EXCLUDING (c_name, c_mkt*) AS k_* FROM customer", "select c_custkey as k_custkey, c_nationkey as k_nationkey, c_acctbal as k_acctbal from customer")
query("q11_column_expr", "SELECT COLUMN EXPR (AS upper(columnName()) WHERE columnName() IN ('s_acctbal', 's_name') AND rowCount() > 0 ORDER BY columnName() LIMIT 2) FROM supplier", 'select s_acctbal as "S_ACCTBAL", s_name as "S_NAME" from supplier')
query("q12_sub_select", "SELECT x.r AS r, count(*) AS n FROM (SELECT n_regionkey AS r, n_name AS m FROM nation WHERE n_name LIKE '%1%') AS x GROUP BY x.r", "select n_regionkey as r, count(*) as n from nation where n_name like '%1%' group by 1")
query("q13_row_dataset", "SELECT column, value FROM row_dataset({a: 1, b: 2, c: {d: 4}})", "select * from (values ('a', 1), ('b', 2), ('c.d', 4)) t(\"column\", \"value\")")
query("q14_bitwise", "SELECT p_partkey, p_size & 6 AS a, p_size | 1 AS o, p_size ^ 5 AS x, ~p_size AS n FROM part", "select p_partkey, (p_size & 6)::bigint as a, (p_size | 1)::bigint as o, xor(p_size, 5)::bigint as x, (~p_size)::bigint as n from part")

# joins

query("q20_join_inner", "SELECT c.c_name AS name, o.o_orderkey AS k, o.o_totalprice AS p FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000",
      "select c_name as name, o_orderkey as k, o_totalprice as p from customer join orders on c_custkey = o_custkey where o_totalprice > 200000")
query("q21_join_left", "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000",
      "select c_custkey as c, o_orderkey as o from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000")
query("q22_join_right", "SELECT o.o_orderkey AS o, c.c_custkey AS c FROM orders AS o RIGHT JOIN customer AS c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'",
      "select o_orderkey as o, c_custkey as c from orders right join customer on c_custkey = o_custkey and o_orderstatus = 'P'")
query("q23_join_full", "SELECT s.s_suppkey AS s, n.n_nationkey AS n FROM (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000) AS s OUTER JOIN nation AS n ON s.s_nationkey = n.n_nationkey",
      "select s_suppkey as s, n_nationkey as n from (select * from supplier where s_acctbal > 5000) full join nation on s_nationkey = n_nationkey")
query("q24_join_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation AS a JOIN region AS b ON a.n_regionkey < b.r_regionkey", "select n_nationkey as a, r_regionkey as b from nation join region on n_regionkey < r_regionkey")
query("q25_join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region AS a JOIN region AS b", "select a.r_name as a, b.r_name as b from region a cross join region b")
query("q26_join_chain", "SELECT r.r_name AS r, count(*) AS n, sum(c.c_acctbal) AS s FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
      "select r_name as r, count(*) as n, round(sum(c_acctbal), 2) as s from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1", s=2)
query("q27_join_names", "SELECT rowName() AS name, leftRowName() AS l, rightRowName() AS r FROM nation AS n JOIN region AS g ON n.n_regionkey = g.r_regionkey",
      "select '[' || n_nationkey || ']-[' || r_regionkey || ']' as name, n_nationkey::varchar as l, r_regionkey::varchar as r from nation join region on n_regionkey = r_regionkey")
query("q28_in_select", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000)")
query("q29_not_in_select", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey END AS k FROM customer)",
      "select o_orderkey from orders where not exists (select 1 from customer where c_acctbal > 0 and c_custkey = o_custkey)")
query("q30_in_select_or", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900) OR o_totalprice > 490000", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9900) or o_totalprice > 490000")

# aggregates

query("q40_aggregates", "SELECT event_type, count(value) AS n, count_distinct(user_id) AS users, vertical_min(value) AS lo, vertical_max(value) AS hi, vertical_avg(value) AS mean FROM events GROUP BY event_type",
      "select event_type, count(value) as n, count(distinct user_id) as users, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean from events group by 1", mean=6)
query("q41_string_agg", "SELECT n_regionkey, string_agg(n_name, ',', n_name) AS names FROM nation GROUP BY n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1")
query("q42_row_aggregate", "SELECT count({*}) AS n FROM orders", 'select count(o_orderkey) as "n.o_orderkey", count(o_custkey) as "n.o_custkey", count(o_orderstatus) as "n.o_orderstatus", count(o_totalprice) as "n.o_totalprice", count(o_orderdate) as "n.o_orderdate", count(o_orderpriority) as "n.o_orderpriority" from orders')
query("q43_group_expression", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY date_trunc('month', o_orderdate)", "select date_trunc('month', o_orderdate) as m, count(*) as n from orders group by 1")


@builder("q44_earliest_latest", "select user_id, arg_min(event_type, (ts, event_id)) as first, arg_max(event_type, (ts, event_id)) as last from (select * from events where event_id in (select min(event_id) from events group by user_id, ts)) group by 1")
def earliest_latest(e, spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    once = events.groupBy("user_id", "ts").agg(F.min_by("event_type", "event_id").alias("event_type"))
    e.register("once", Table(once.withColumn("_ts", F.col("ts"))))
    return e.sql("SELECT user_id, earliest(event_type) AS first, latest(event_type) AS last FROM once GROUP BY user_id")


@builder("q45_pivot", "select user_id, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'view') as view from events group by 1")
def pivot(e, spark, sf_dir):
    e.register("p", e.query("SELECT user_id AS user_id, pivot(event_type, value) AS p FROM events GROUP BY user_id"))
    return e.sql("SELECT user_id, p.click AS click, p.view AS view FROM p")


query("q46_likelihood_ratio", "SELECT likelihood_ratio({a: CASE WHEN value > 50 THEN 1 END, b: CASE WHEN user_id < 20 THEN 1 END}, event_type = 'click') AS r FROM events",
      """select round(ln((count(*) filter (value > 50 and event_type = 'click') / (count(*) filter (event_type = 'click'))::double) / (count(*) filter (value > 50 and event_type <> 'click') / (count(*) filter (event_type <> 'click'))::double)), 6) as "r.a",
      round(ln((count(*) filter (user_id < 20 and event_type = 'click') / (count(*) filter (event_type = 'click'))::double) / (count(*) filter (user_id < 20 and event_type <> 'click') / (count(*) filter (event_type <> 'click'))::double)), 6) as "r.b" from events""", **{"r.a": 6, "r.b": 6})  # fmt: skip

# time

query("q50_date_part", "SELECT event_id, date_part('hour', ts) AS h, date_part('dow', ts) AS dow, date_part('doy', ts) AS doy, date_part('isodow', ts) AS iso, date_part('isoweek', ts) AS isoweek, date_part('week', ts) AS week, date_part('quarter', ts) AS quarter, date_part('year', ts) AS year FROM events",
      "select event_id, hour(ts) as h, dayofweek(ts) as dow, dayofyear(ts) - 1 as doy, isodow(ts) as iso, weekofyear(ts) as isoweek, (dayofyear(ts) - 1) // 7 as week, quarter(ts) as quarter, year(ts) as year from events")
query("q51_date_trunc", "SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type", "select date_trunc('day', ts) as d, event_type, count(*) as n from events group by 1, 2")
query("q52_intervals", "SELECT o_orderkey, o_orderdate + INTERVAL '1 month 2d' AS later, o_orderdate - INTERVAL '36H' AS before, o_orderdate + 3 AS days FROM orders",
      "select o_orderkey, o_orderdate + interval 1 month + interval 2 day as later, o_orderdate - interval 36 hour as before, o_orderdate + interval 3 day as days from orders")


@builder("q53_when", "select event_id, case when ts between timestamp '2024-01-05' and timestamp '2024-01-10' then event_type end as event_type from events")
def when(e, spark, sf_dir):
    e.register("timed", Table(spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"_ts": F.col("ts"), ROW: F.col("event_id").cast("string")})))
    return e.sql("SELECT CAST(rowName() AS integer) AS event_id, event_type FROM timed WHEN value_timestamp() BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")


@builder("q54_temporal", "select user_id, count(value) as n, round(sum(value), 4) as s, min(value) as lo, max(value) as hi, arg_min(value, (ts, value)) as first, arg_max(value, (ts, value)) as last from events group by 1")
def temporal(e, spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("row"), F.lit("value").alias("column"), "value", "ts")
    e.register("cells", Table.of_cells(cells, ["value"]))
    out = e.sql("SELECT CAST(rowName() AS integer) AS user_id, temporal_count(value) AS n, temporal_sum(value) AS s, temporal_min(value) AS lo, temporal_max(value) AS hi, temporal_earliest(value) AS first, temporal_latest(value) AS last FROM cells")
    return out.withColumn("s", F.round("s", 4))


@builder("q55_latest_by_key", "select user_id, max(ts) as ts from events where ts <= timestamp '2024-01-15' group by 1")
def latest(e, spark, sf_dir):
    return latest_by_key(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "2024-01-15").select("user_id", "ts")


# scalar functions

query("q60_math", "SELECT l_orderkey, l_linenumber, round(l_tax * 100) AS r, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, abs(l_discount - 0.05) AS a, sqrt(l_quantity) AS s, ln(l_quantity) AS n, log(l_quantity) AS d, log(2, l_quantity) AS b, pow(l_quantity, 2) AS p, exp(l_tax) AS e, sign(l_discount - 0.05) AS g, clamp(l_quantity, 10, 20) AS k, quantize(l_quantity, 5) AS z FROM lineitem",
      "select l_orderkey, l_linenumber, round(l_tax * 100) as r, ceil(l_extendedprice) as c, floor(l_extendedprice) as f, round(abs(l_discount - 0.05), 6) as a, round(sqrt(l_quantity), 6) as s, round(ln(l_quantity), 6) as n, round(log10(l_quantity), 6) as d, round(ln(l_quantity) / ln(2), 6) as b, l_quantity * l_quantity as p, round(exp(l_tax), 6) as e, sign(l_discount - 0.05)::double as g, least(greatest(l_quantity, 10), 20) as k, round(l_quantity / 5) * 5 as z from lineitem", a=6, s=6, n=6, d=6, b=6, e=6)
query("q61_trigonometry", "SELECT p_partkey, sin(p_size) AS s, cos(p_size) AS c, atan(p_size) AS a, tanh(p_size / 50) AS h, atan2(p_size, 3) AS t FROM part", "select p_partkey, round(sin(p_size), 6) as s, round(cos(p_size), 6) as c, round(atan(p_size), 6) as a, round(tanh(p_size / 50.0), 6) as h, round(atan2(p_size, 3), 6) as t from part", s=6, c=6, a=6, h=6, t=6)
query("q62_strings", "SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u, length(c_name) AS n, remove_prefix(c_name, 'Customer') AS p, remove_suffix(c_mktsegment, 'ING') AS s, regex_replace(c_name, '[0-9]+', '#') AS r, regex_match(c_mktsegment, 'B.*') AS m, regex_search(c_name, '99') AS f, levenshtein_distance(c_mktsegment, 'BUILD') AS d, base64_encode(c_name) AS b FROM customer",
      "select c_custkey, lower(c_name) as l, upper(c_mktsegment) as u, length(c_name) as n, replace(c_name, 'Customer', '') as p, regexp_replace(c_mktsegment, 'ING$', '') as s, regexp_replace(c_name, '[0-9]+', '#', 'g') as r, regexp_full_match(c_mktsegment, 'B.*') as m, contains(c_name, '99') as f, levenshtein(c_mktsegment, 'BUILD') as d, to_base64(encode(c_name)) as b from customer")
query("q63_horizontal", "SELECT l_orderkey, l_linenumber, horizontal_sum({l_quantity, l_tax}) AS s, horizontal_avg({l_quantity, l_tax, nothing}) AS a, horizontal_count({l_quantity, nothing}) AS n, horizontal_max({l_quantity, l_discount}) AS m FROM lineitem",
      "select l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) as s, round((l_quantity + l_tax) / 2, 6) as a, 1 as n, greatest(l_quantity, l_discount) as m from lineitem", s=6, a=6)
query("q64_binomial", "SELECT n_nationkey, binomial_lb_80(100, n_nationkey) AS lo, binomial_ub_80(100, n_nationkey) AS hi FROM nation",
      "with z as (select 1.2815515655446004 as z), p as (select n_nationkey, n_nationkey / 100.0 as p from nation) select n_nationkey, round((p + z*z/200 - z * sqrt((p*(1-p) + z*z/400)/100)) / (1 + z*z/100), 6) as lo, round((p + z*z/200 + z * sqrt((p*(1-p) + z*z/400)/100)) / (1 + z*z/100), 6) as hi from p, z", lo=6, hi=6)
query("q65_geo_distance", "SELECT n_nationkey, geo_distance(n_nationkey, n_nationkey, 45, 5) AS d FROM nation",
      "select n_nationkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(45 - n_nationkey) / 2), 2) + cos(radians(n_nationkey)) * cos(radians(45)) * pow(sin(radians(5 - n_nationkey) / 2), 2))), 3) as d from nation", d=3)
query("q66_contains_point", """SELECT n_nationkey, ST_Contains_Point('{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]]]}', n_nationkey + 0.5, 5) AS inside FROM nation""", "select n_nationkey, n_nationkey < 10 as inside from nation")
query("q67_domain", "SELECT page_id, extract_domain(url) AS host FROM pages", "select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host from pages")
query("q68_replace", "SELECT p_partkey, replace_null(CASE WHEN p_size > 25 THEN p_size END, 0) AS a, replace_inf(1 / (p_size - p_size), -1) AS b, replace_not_finite(0 / (p_size - p_size), 7) AS c FROM part", "select p_partkey, (case when p_size > 25 then p_size else 0 end)::double as a, -1.0::double as b, 7.0::double as c from part")
query("q69_paths", """SELECT n_nationkey, path_element(parse_path('a."b.c".' + n_name), 1) AS e, path_length(parse_path('x.y.' + n_name)) AS l, stringify_path(parse_path('a."b.c"')) AS s FROM nation""", "select n_nationkey, 'b.c' as e, 3 as l, 'a.\"b.c\"' as s from nation")

# texts, JSON and rows

query("q70_tokenize", "SELECT x.doc_id AS doc_id, x.t.the AS n FROM (SELECT doc_id, tokenize(lower(text), {splitChars: ' '}) AS t FROM documents) AS x",
      "select doc_id, nullif(len(list_filter(regexp_split_to_array(lower(text), ' '), lambda w: w = 'the')), 0) as n from documents")
query("q71_token_extract", "SELECT doc_id, token_extract(text, 1, {splitChars: ' '}) AS w, horizontal_count(split_part(text, ' ')) AS n FROM documents",
      "select doc_id, list_filter(string_split(text, ' '), lambda w: length(w) > 0)[2] as w, len(string_split(text, ' ')) as n from documents")


@builder("q72_parse_json", "select event_id, json_extract_string(props, '$.k') as k from events")
def parse_json(e, spark, sf_dir):
    return e.sql("SELECT x.event_id AS event_id, x.j.k AS k FROM (SELECT event_id, parse_json(props) AS j FROM events) AS x")


query("q73_jaccard", "SELECT p_partkey, jaccard_index({a: p_size, b: p_name, c: nothing}, {a: 1, c: 2}) AS j FROM part", "select p_partkey, round(1 / 3.0::double, 6) as j from part", j=6)
query("q74_links", "SELECT page_id, shape(extract_links(html))[0] AS n FROM pages", "select page_id, len(regexp_extract_all(html, '<a href=')) as n from pages")
query("q75_print_json", "SELECT n_nationkey, print_json({a: n_nationkey, b: n_name}) AS j FROM nation", """select n_nationkey, '{"a":' || n_nationkey || ',"b":"' || n_name || '"}' as j from nation""")

# embeddings

query("q80_vectors", "SELECT vec_id, norm(embedding, 2) AS n2, norm(embedding, 0) AS n0, horizontal_sum(embedding) AS s, slice(embedding, 3) AS e, horizontal_sum(vector_product(embedding, embedding)) AS sq FROM embeddings",
      "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) as n2, len(list_filter(embedding, lambda x: x <> 0))::double as n0, round(list_sum(embedding::double[]), 4) as s, round(embedding[4]::double, 4) as e, round(list_dot_product(embedding::double[], embedding::double[]), 4) as sq from embeddings", n2=4, s=4, e=4, sq=4)


@builder("q81_neighbors", "select vec_id as query, n as key, rank, round(d, 4) as distance from (select a.vec_id, b.vec_id as n, list_distance(a.embedding::double[], b.embedding::double[]) as d, row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rank from embeddings a join embeddings b on a.vec_id % 100 = 0) where rank <= 5")
def neighbors(e, spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = learning.nearest(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"), 5)
    return out.select("query", F.col("vec_id").alias("key"), "rank", F.round("distance", 4).alias("distance"))


query("q82_tensors", "SELECT n_nationkey, flatten([[n_nationkey, 2], [3, 4]]) [0] AS a, slice([[1, n_nationkey], [3, 4]], 1)[0] AS b, reshape([1, 2, 3, n_nationkey], [2, 2])[1][1] AS c, concat([1, 2], [n_nationkey])[2] AS d, shape([[1, 2, 3], [4, 5, 6]])[1] AS e FROM nation",
      "select n_nationkey, n_nationkey as a, n_nationkey as b, n_nationkey::double as c, n_nationkey as d, 3 as e from nation")


@builder("q83_fft")
def fft(e, spark, sf_dir):
    return e.sql("SELECT vec_id, fft(embedding)[0] AS dc, norm(fft(embedding), 2) AS n FROM embeddings")


# tables


@builder("q90_transpose", "select n_nationkey::varchar as r, 'n_nationkey' as c, n_nationkey as v from nation union all select n_nationkey::varchar, 'n_regionkey', n_regionkey from nation")
def transpose(e, spark, sf_dir):
    e.register("n2", e.query("SELECT n_nationkey, n_regionkey NAMED CAST(n_nationkey AS string) FROM nation"))
    cells = e.query("SELECT * FROM transpose(n2)").cells()
    return cells.select(F.col("column").alias("r"), F.col("row").alias("c"), F.col("value").alias("v"))


@builder("q91_merge", "select coalesce(c_custkey, s_suppkey) as k, c_name, s_name from customer full join supplier on c_custkey = s_suppkey")
def merge(e, spark, sf_dir):
    e.register("a", e.query("SELECT c_name NAMED CAST(c_custkey AS string) FROM customer"))
    e.register("b", e.query("SELECT s_name NAMED CAST(s_suppkey AS string) FROM supplier"))
    return e.sql("SELECT CAST(rowName() AS integer) AS k, c_name, s_name FROM merge(a, b)")


query("q92_union", "SELECT rowName() AS name, n_name, r_name FROM union(nation, region)", "select '0.' || n_nationkey as name, n_name, null as r_name from nation union all select '1.' || r_regionkey, null, r_name from region")
query("q93_sample_rows", "SELECT c_custkey FROM sample(customer, {rows: 100, seed: 3})")
query("q94_sample_fraction", "SELECT l_orderkey FROM sample((SELECT l_orderkey NAMED CAST(l_orderkey AS string) + '.' + l_linenumber FROM lineitem), {fraction: 0.1, seed: 3})")

# procedures


@builder("q100_melt", "select s_suppkey, name as key, value from (unpivot (select s_suppkey, s_nationkey::double as s_nationkey, s_acctbal from supplier) on s_nationkey, s_acctbal)")
def melt(e, spark, sf_dir):
    return e.run("melt", inputData="SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier", to_fix=["s_suppkey"]).drop(ROW)


@builder("q101_bucketize", "with r as (select c_custkey, row_number() over (order by c_acctbal, c_custkey) - 1 as p, count(*) over () as n from customer) select c_custkey::varchar as \"_rowName\", case when p < trunc(0.25 * n) then 'low' when p >= trunc(0.75 * n) then 'high' else 'mid' end as bucket from r")
def bucketize(e, spark, sf_dir):
    return e.run("bucketize", inputData="SELECT c_acctbal, c_custkey NAMED CAST(c_custkey AS string) FROM customer", orderBy="c_acctbal, c_custkey", percentileBuckets={"low": (0, 25), "mid": (25, 75), "high": (75, 100)})


@builder("q102_ranking", "select o_orderkey::varchar as \"_rowName\", row_number() over (order by o_totalprice desc, o_orderkey) - 1 as rank from orders")
def ranking(e, spark, sf_dir):
    return e.run("ranking", inputData="SELECT o_totalprice, o_orderkey NAMED CAST(o_orderkey AS string) FROM orders", orderBy="o_totalprice DESC, o_orderkey")


@builder("q103_summary", """with c as (select c_acctbal as v, count(*) as k from customer group by 1), r as (select v, sum(k) over (order by v) as cum from c), n as (select count(c_acctbal) as n from customer)
select 'c_acctbal' as "column", 'number' as data_type, count(*) filter (c_acctbal is null) as num_null, count(distinct c_acctbal) as num_unique, min(c_acctbal) as min, max(c_acctbal) as max, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as stddev,
(select min(v) from r, n where cum > n * 0.25) as first_quartile, (select min(v) from r, n where cum > n * 0.5) as median, (select min(v) from r, n where cum > n * 0.75) as third_quartile from customer
union all select 'c_mktsegment', 'categorical', count(*) filter (c_mktsegment is null), count(distinct c_mktsegment), null, null, null, null, null, null, null from customer""")
def summary(e, spark, sf_dir):
    out = e.run("summary.statistics", inputData="SELECT c_acctbal, c_mktsegment FROM customer")
    return out.drop("most_frequent").withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


@builder("q104_split", "select c_mktsegment, round(count(*) * 0.8) as train, count(*) - round(count(*) * 0.8) as test from customer group by 1")
def split(e, spark, sf_dir):
    a, b = e.run("split", labels="c_mktsegment", inputData="SELECT c_mktsegment NAMED CAST(c_custkey AS string) FROM customer", splits=[0.8, 0.2])
    one = lambda df, n: df.groupBy("c_mktsegment").agg(F.count("*").cast("double").alias(n))
    return one(a, "train").join(one(b, "test"), "c_mktsegment", "full")


@builder("q105_tfidf", """with w as (select doc_id, unnest(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 0)) as t from documents), c as (select doc_id, t, count(*) as k from w group by 1, 2),
d as (select t, count(*) as df from c group by 1), n as (select count(*) as n from documents) select doc_id, t as term, round(k * ln(1 + n / df), 5) as weight from c join d using (t), n""")
def tfidf(e, spark, sf_dir):
    bags = e.query("SELECT doc_id, tokenize(lower(text), {splitChars: ' '}) AS t FROM documents").df
    e.register("bags", bags, key="doc_id")
    df = e.run("tfidf.train", trainingData="bags")
    out = features.weigh(bags, "doc_id", "t", df, bags.count())
    return out.withColumn("weight", F.round("weight", 5))


@builder("q106_stats_table", """select event_id::varchar as "_rowName", count(*) over w as "trial-user_id", coalesce(sum((value > 50)::int) over w, 0)::bigint as "high-user_id" from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)""")
def stats_table(e, spark, sf_dir):
    return e.run("statsTable.train", trainingData="SELECT user_id, value, ts, event_id NAMED CAST(event_id AS string) FROM events", select="user_id", outcomes=[("high", "value > 50")], orderBy="ts, event_id")


@builder("q107_dist_table", """select event_id::varchar as "_rowName", count(value) over w as "v.event_type.count", round(avg(value) over w, 8) as "v.event_type.avg", max(value) over w as "v.event_type.max" from events window w as (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding)""")
def dist_table(e, spark, sf_dir):
    out = e.run("experimental.distTable.train", trainingData="SELECT event_type, value, ts, event_id NAMED CAST(event_id AS string) FROM events", select="event_type", outcomes=[("v", "value")], statistics=("count", "avg", "max"), orderBy="ts, event_id")
    return out.withColumn("v.event_type.avg", F.round(q("v.event_type.avg"), 8))


@builder("q108_bag_of_words", "select word, count(*) as trial, sum((quality = 0)::int)::bigint as bad from (select distinct doc_id, unnest(list_filter(string_split(text, ' '), lambda x: length(x) > 0)) as word from documents) join labels using (doc_id) group by 1")
def bag_of_words(e, spark, sf_dir):
    e.register("labelled", spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id"), key="doc_id")
    return e.run("statsTable.bagOfWords.train", trainingData="labelled", select="tokenize(text, {splitChars: ' '}) AS t", outcomes=[("bad", "quality = 0")])


@builder("q109_transform", "select c_custkey, c_acctbal * 2 as twice from customer where c_acctbal > 0")
def transform(e, spark, sf_dir):
    e.run("transform", inputData="SELECT c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 0", outputDataset="t", skipEmptyRows=True)
    return e.sql("SELECT * FROM t")


@builder("q110_kmeans")
def kmeans(e, spark, sf_dir):
    return e.run("kmeans.train", trainingData="SELECT embedding NAMED CAST(vec_id AS string) FROM embeddings", numClusters=4, metric="euclidean", maxIterations=10)


@builder("q111_svd")
def svd(e, spark, sf_dir):
    return e.run("svd.train", trainingData="SELECT embedding NAMED CAST(vec_id AS string) FROM embeddings", numSingularValues=5)


@builder("q112_classifier")
def classifier(e, spark, sf_dir):
    data = "SELECT {l_quantity, l_extendedprice, l_discount} AS features, l_returnflag = 'N' AS label FROM lineitem"
    model = e.run("classifier.train", trainingData=data, configuration={"type": "decision_tree", "max_depth": 4}, mode="boolean")
    table, df, _ = learning._training(e, data)
    e.register("scored", Table(model.score(df).select("score", "label")))
    return e.run("classifier.test", testingData="scored")


@builder("q113_dataset_stats", "select count(*) as rows, 3 as columns, 'n_name' as \"column\", count(n_name) as \"values\" from nation union all select count(*), 3, 'n_nationkey', count(n_nationkey) from nation union all select count(*), 3, 'n_regionkey', count(n_regionkey) from nation")
def dataset_stats(e, spark, sf_dir):
    return e.run("dataset.stats", inputData="nation")


@builder("q114_sql_expression", "select n_nationkey, n_nationkey * 10 + 1 as y from nation")
def sql_expression(e, spark, sf_dir):
    e.create_function("f", "sql.expression", expression="x * 10 + 1 AS y")
    return e.sql("SELECT n_nationkey, f({x: n_nationkey})[y] AS y FROM nation")


@builder("q115_list_files")
def list_files(e, spark, sf_dir):
    return e.run("list.files", path=sf_dir).select("size")


# more of the language

query("q15_in_keys", "SELECT n_nationkey, n_regionkey IN (VALUES OF {a: 1, b: 3}) AS v, n_name IN (KEYS OF {x: 1}) AS k, n_name NOT IN (KEYS OF {x: 1}) AS nk FROM nation",
      "select n_nationkey, n_regionkey in (1, 3) as v, n_name in ('x') as k, n_name not in ('x') as nk from nation")
query("q16_atom_dataset", "SELECT column, value FROM atom_dataset({a: 1, b: {c: 2}})", "select * from (values ('a', 1), ('b.c', 2)) t(\"column\", \"value\")")
query("q17_as_star", "SELECT {n_name AS a, n_regionkey + 1 AS b} AS *, n_nationkey -- the key\nFROM nation /* all of them */", "select n_name as a, n_regionkey + 1 as b, n_nationkey from nation")
query("q19_comparisons", "SELECT o_orderkey, o_totalprice !< 100000 AS ge, o_totalprice !> 100000 AS le, o_orderstatus <> 'F' AS ne, o_totalprice NOT BETWEEN 1 AND 200000 AS nb, o_orderpriority NOT LIKE '1%' AS nl, o_orderdate IS TIMESTAMP AS t, o_orderkey IS INTEGER AS i, o_totalprice IS NOT NULL AS nn FROM orders",
      "select o_orderkey, o_totalprice >= 100000 as ge, o_totalprice <= 100000 as le, o_orderstatus <> 'F' as ne, o_totalprice not between 1 and 200000 as nb, o_orderpriority not like '1%' as nl, true as t, true as i, true as nn from orders")


@builder("q18_parameters", "select c_custkey, c_acctbal + 10 as x from customer where c_acctbal > 5000")
def parameters(e, spark, sf_dir):
    return e.sql("SELECT c_custkey, c_acctbal + $more AS x FROM customer WHERE c_acctbal > $least", least=5000, more=10)


query("q31_join_full_theta", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region AS a FULL JOIN region AS b ON a.r_regionkey > b.r_regionkey + 2",
      "select a.r_regionkey as a, b.r_regionkey as b from region a full join region b on a.r_regionkey > b.r_regionkey + 2")
query("q32_scope_names", "SELECT rowName() AS n, rowPathElement(0) AS p, columnCount() AS c, leftRowPath() IS NULL AS l, rowPath()[0] AS q FROM nation", "select n_nationkey::varchar as n, n_nationkey::varchar as p, 3::bigint as c, true as l, n_nationkey::varchar as q from nation")
query("q47_horizontal", "SELECT l_orderkey, l_linenumber, horizontal_min({l_tax, l_discount}) AS lo, horizontal_max({l_tax, l_discount}) AS hi, horizontal_string_agg({l_returnflag, l_linestatus}, '-') AS s, horizontal_count({l_tax, null AS z}) AS n FROM lineitem",
      "select l_orderkey, l_linenumber, least(l_tax, l_discount) as lo, greatest(l_tax, l_discount) as hi, l_returnflag || '-' || l_linestatus as s, 1::bigint as n from lineitem")


@builder("q48_odd_aggregates", "select n_regionkey, max(case when n_nationkey > 4 then n_nationkey end) as hi, 0 as none, true as inf, true as undefined from nation group by 1")
def odd_aggregates(e, spark, sf_dir):
    e.register("p", e.query("SELECT n_regionkey AS n_regionkey, pivot(CASE WHEN n_nationkey > 4 THEN 'big' END, n_nationkey) AS p FROM nation GROUP BY n_regionkey"))
    e.register("l", e.query("SELECT n_regionkey AS r, likelihood_ratio({a: CASE WHEN n_nationkey < 0 THEN 1 END}, n_nationkey > 10) AS x, likelihood_ratio({a: n_name}, n_nationkey > 1000) AS y FROM nation GROUP BY n_regionkey"))
    return e.sql("SELECT p.n_regionkey AS n_regionkey, p.p.big AS hi, CASE WHEN p.p.nothing IS NULL THEN 0 ELSE 1 END AS none, isnan(l.x.a) AS inf, isnan(l.y.a) AS undefined FROM p JOIN l ON p.n_regionkey = l.r")


query("q84_waves", "SELECT s_suppkey, impulse(4) AS i, shifted_impulse(4, 2) AS s, norm(amplitude(reshape(z, [16, 2])), 2) AS a, norm(real(reshape(z, [16, 2])), 1) AS re, norm(imag(reshape(z, [16, 2])), 1) AS im, shape(phase(reshape(z, [16, 2])))[0] AS n FROM (SELECT s_suppkey, fft(impulse(32)) AS z FROM supplier) AS w",
      "select s_suppkey, [1.0, 0, 0, 0]::double[] as i, [0, 0, 1.0, 0]::double[] as s, round(sqrt(17), 6) as a, 16.0::double as re, 1.0::double as im, 16::bigint as n from supplier", a=6, re=6, im=6)
query("q85_trigonometry", "SELECT p_partkey, asin(p_size / 100) AS a, acos(p_size / 100) AS b, tan(p_size / 100) AS c, sinh(p_size / 50) AS d, cosh(p_size / 50) AS e, asinh(p_size) AS f, acosh(p_size) AS g, atanh(p_size / 100) AS h, pi() AS p, e() AS o, power(p_size, 2) AS w, mod(p_size, 7) AS m FROM part",
      "select p_partkey, round(asin(p_size / 100), 6) as a, round(acos(p_size / 100), 6) as b, round(tan(p_size / 100), 6) as c, round(sinh(p_size / 50), 6) as d, round(cosh(p_size / 50), 6) as e, round(asinh(p_size), 6) as f, round(acosh(p_size), 6) as g, round(atanh(p_size / 100), 6) as h, round(pi(), 6) as p, round(exp(1), 6) as o, (p_size * p_size)::double as w, (p_size % 7)::bigint as m from part",
      a=6, b=6, c=6, d=6, e=6, f=6, g=6, h=6, p=6, o=6)
query("q86_not_finite", "SELECT n_nationkey, isnan(n_nationkey / 0) AS n, isinf(n_nationkey / 0) AS i, isfinite(n_nationkey / 2) AS f, replace_nan(n_nationkey / 0, -1) AS r, log(1, 5) AS l, quantize(n_nationkey, 0) IS NULL AS q, isnan(binomial_ub_80(0, 0)) AS b, (9223372036854775807 + n_nationkey + 1) IS NULL AS o, norm(normalize([0, 3, 4], 2), 2) AS u, isnan(norm(normalize([0, 0], 2), 2)) AS z FROM nation",
      "select n_nationkey, n_nationkey = 0 as n, n_nationkey <> 0 as i, true as f, case when n_nationkey = 0 then -1.0 else 'infinity'::double end as r, 'infinity'::double as l, false as q, true as b, true as o, 1.0::double as u, true as z from nation", u=6)
query("q87_vectors", "SELECT vec_id, norm(vector_diff(embedding, embedding), 1) AS d, norm(vector_sum(embedding, embedding), 2) AS s, norm(vector_quotient(embedding, embedding), 1) AS n FROM embeddings",
      "select vec_id, 0.0::double as d, round(2 * sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as s, 64.0::double as n from embeddings", s=4)
query("q88_encodings", "SELECT c_custkey, CAST(base64_decode(base64_encode(c_name)) AS string) AS n, blob_length(CAST(c_name AS blob)) AS l, try(regex_match(c_name, '('), 'bad') AS t, try(c_name, 'x') AS u, flatten_path(unflatten_path('a.b')) AS f, CAST(implicit_cast('12') AS integer) AS i FROM customer",
      "select c_custkey, c_name as n, strlen(c_name)::bigint as l, 'bad' as t, c_name as u, 'a.b' as f, 12::bigint as i from customer")
query("q89_extract_text", "SELECT page_id, shape(extract_links(html))[0] IS NOT NULL AS l, length(extract_text(html)) > 0 AS t, extract_domain(url, {removeSubdomain: false}) AS d FROM pages",
      "select page_id, true as l, true as t, regexp_extract(url, '://([^/]+)', 1) as d from pages")


@builder("q56_versions", "select user_id, round(avg(value), 3) as mean, count(distinct ts) as n, min(ts) as first, max(ts) as last from (select user_id, ts, max(value) as value from events group by 1, 2) group by 1")
def versions(e, spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    cells = df.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", F.col("value").alias("v")))).alias("value"))
    e.register("v", Table(cells, versioned=frozenset(["value"]), key="user_id"))
    out = e.sql("SELECT user_id, temporal_avg(value) AS mean, shape(distinct_timestamps(value))[0] AS n, earliest_timestamp(value) AS first, latest_timestamp(value) AS last FROM v")
    return out.withColumn("mean", F.round("mean", 3))


@builder("q116_csv_and_back", "select n_nationkey, n_name, n_regionkey, n_nationkey as line from nation")
def csv_and_back(e, spark, sf_dir):
    path = shared_path(spark, "csv")
    e.run("export.csv", exportData="SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey", dataFileUrl=path, singleFile=True)
    out = e.run("import.text", dataFileUrl=path, outputDataset="back")
    return e.sql("SELECT n_nationkey, n_name, n_regionkey, CAST(rowName() AS integer) - 2 AS line FROM back")


@builder("q117_json_and_back", "select s_suppkey, s_name, s_acctbal as \"box.b\" from supplier")
def json_and_back(e, spark, sf_dir):
    path = shared_path(spark, "json")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.struct(F.col("s_acctbal").alias("b")).alias("box")).write.json(path)
    e.run("import.json", dataFileUrl=path, outputDataset="js")
    return e.sql("SELECT s_suppkey, s_name, box.b FROM js")


@builder("q118_tree_function", "select o_orderkey, (o_orderkey > (select avg(o_orderkey) from orders))::int::double as score from orders")
def tree_function(e, spark, sf_dir):
    """A tree as a function of columns: the label is told by one feature at one place."""
    mean = float(e.sql("SELECT avg(o_orderkey) AS m FROM orders").first()[0])
    e.register("lab", e.query("SELECT *, o_orderkey > $m AS hit FROM orders", m=mean))
    e.run("classifier.train", trainingData="SELECT {side: CASE WHEN hit THEN 3 ELSE 1 END} AS features, hit AS label FROM lab", functionName="tree", configuration={"type": "decision_tree", "max_depth": 2})
    return e.sql("SELECT o_orderkey, tree({features: {side: CASE WHEN hit THEN 3 ELSE 1 END}})[score] AS score FROM lab")


@builder("q119_neighbors_function", """select vec_id, list(n order by d, n::varchar)[2] as second from (
select a.vec_id, b.vec_id as n, list_distance(a.embedding::double[], b.embedding::double[]) as d from embeddings a, embeddings b qualify row_number() over (partition by a.vec_id order by d, b.vec_id::varchar) <= 2) group by 1""")
def neighbors_function(e, spark, sf_dir):
    """The nearest other vector of each row, by a function of its column."""
    e.run("embedding.neighbors", dataset="embeddings", functionName="nn", vectorColumn="embedding", numNeighbors=2)
    # a row is compared with all points, so rows are dealt to all cores, however few files they come from
    e.register("asked", e.query("SELECT vec_id, embedding FROM embeddings").df.repartition(4 * spark.sparkContext.defaultParallelism), key="vec_id")
    return e.sql("SELECT vec_id, CAST(nn({coords: embedding})[neighbors][1] AS integer) AS second FROM asked")


@builder("q120_samples", "select 100 as n, 100 as different, true as near")
def samples(e, spark, sf_dir):
    e.register("some", e.query("SELECT c_custkey FROM sample(customer, {rows: 100, seed: 3})"))
    e.register("part_of", e.query("SELECT l_orderkey FROM sample((SELECT l_orderkey NAMED CAST(l_orderkey AS string) + '.' + l_linenumber FROM lineitem), {fraction: 0.1, seed: 3})"))
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return e.sql("SELECT a.n AS n, a.d AS different, b.n > 0.08 * $all AND b.n < 0.12 * $all AS near FROM (SELECT count(*) AS n, count_distinct(c_custkey) AS d FROM some) AS a JOIN (SELECT count(*) AS n FROM part_of) AS b", all=n)


query("q121_wave_sums", "SELECT vec_id, fft(embedding)[0] AS dc, fft(embedding)[1] AS high FROM embeddings",
      "select vec_id, round(list_sum(embedding::double[]), 3) + 0.0 as dc, round(list_sum(list_transform(embedding, lambda x, i: case when i % 2 = 1 then x::double else -x::double end)), 3) + 0.0 as high from embeddings", dc=3, high=3)


@builder("q122_learned", "select true as clusters, true as near_own_centre, true as orthonormal, true as better_than_chance")
def learned(e, spark, sf_dir):
    """Metrics against bounds: what learners give depends on their start, what they must reach does not."""
    vectors = "SELECT embedding NAMED CAST(vec_id AS string) FROM embeddings"
    k = e.run("kmeans.train", trainingData=vectors, numClusters=4, metric="euclidean", maxIterations=10, centroidsDataset="centres")
    clusters = k.agg(F.count_distinct("cluster").alias("n"), F.count("*").alias("rows")).first()
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias(ROW), F.col("embedding").cast("array<double>").alias("x"))
    # one of four centres
    centres = F.array(*[F.struct(F.lit(int(r[ROW])).alias("i"), F.lit(r["center"]).alias("c")) for r in e.table("centres").df.collect()])
    far = lambda c: F.aggregate(F.zip_with("x", c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    nearest = F.array_min(F.transform(centres, lambda c: F.struct(far(c).alias("d"), c["i"].alias("i"))))["i"]
    strays = data.join(k, ROW).where(nearest != F.col("cluster")).count()
    u = e.run("svd.train", trainingData=vectors, numSingularValues=5)
    dot = {f"{i}{j}": F.sum(F.col("embedding")[i] * F.col("embedding")[j]) for i in range(5) for j in range(i, 5)}
    products = u.agg(*[c.alias(n) for n, c in dot.items()]).first()
    orthonormal = all(abs(products[n] - (n[0] == n[1])) < 1e-6 for n in dot)
    found = (1 < clusters["n"] <= 4 and clusters["rows"] == data.count(), strays == 0, orthonormal, classifier(e, spark, sf_dir).first()["auc"] > 0.5)
    return spark.createDataFrame([found], "clusters boolean, near_own_centre boolean, orthonormal boolean, better_than_chance boolean")


@builder("q123_stats_function", """with s as (select event_type, count(value) as n, round(avg(value), 6) as mean, min(value) as lo, max(value) as hi, arg_max(value, (ts, event_id)) as last from events where value is not null group by 1)
select event_id, coalesce(n, 0)::bigint as n, mean, lo, hi, last from events left join s using (event_type)""")
def stats_function(e, spark, sf_dir):
    e.run("experimental.distTable.train", trainingData="SELECT event_type, value, ts, event_id NAMED CAST(event_id AS string) FROM events", select="event_type", outcomes=[("v", "value")], statistics=("count", "avg", "min", "max", "last"), orderBy="ts, event_id", functionName="stats")
    out = e.sql("SELECT event_id, stats({features: {event_type}})[stats] AS s FROM events")
    p = "s.v.event_type"
    return out.select("event_id", q(f"{p}.count").alias("n"), F.round(q(f"{p}.avg"), 6).alias("mean"), q(f"{p}.min").alias("lo"), q(f"{p}.max").alias("hi"), q(f"{p}.last").alias("last"))


@builder("q124_counts_function", "select o_orderkey, count(*) over (partition by o_custkey) as n, (sum((o_totalprice > 150000)::int) over (partition by o_custkey))::bigint as high from orders")
def counts_function(e, spark, sf_dir):
    e.run("statsTable.train", trainingData="SELECT o_custkey, o_totalprice NAMED CAST(o_orderkey AS string) FROM orders", select="o_custkey", outcomes=[("high", "o_totalprice > 150000")], functionName="counts")
    out = e.sql("SELECT o_orderkey, counts({keys: {o_custkey}})[counts] AS c FROM orders")
    return out.select("o_orderkey", q("c.trial-o_custkey").alias("n"), q("c.high-o_custkey").alias("high"))


@builder("q125_recorded", "select r_regionkey::varchar as k, r_name as name, timestamp '2024-01-01 00:01:00' + to_minutes(r_regionkey) as at from region")
def recorded(e, spark, sf_dir):
    """Rows and a column recorded, times to the minute; the table is as small as what a client records by hand."""
    rec = e.create_dataset("rec", "sparse.mutable", timeQuantumSeconds=60)
    start = dt.datetime(2024, 1, 1, 0, 1, 30)
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    rec.record_rows([(str(r["r_regionkey"]), []) for r in regions])
    rec.record_column("name", [(str(r["r_regionkey"]), r["r_name"], start + dt.timedelta(minutes=r["r_regionkey"])) for r in regions])
    rec.commit()
    return e.sql("SELECT rowName() AS k, temporal_latest(name) AS name, latest_timestamp(name) AS at FROM rec")


@builder("q126_joined_view", "select n_name, r_name from nation full join region on n_regionkey = r_regionkey and n_nationkey > 3")
def joined_view(e, spark, sf_dir):
    e.create_dataset("both", "joined", left="nation", right="region", on="nation.n_regionkey = region.r_regionkey AND nation.n_nationkey > 3", qualification="JOIN_FULL")
    return e.sql('SELECT nation.n_name AS n_name, region.r_name AS r_name FROM both')


@builder("q127_lines_of_a_file", "select n_nationkey, n_name, n_nationkey + 2 as line, 0 as part, true as told, true as timed from nation")
def lines_of_a_file(e, spark, sf_dir):
    path = shared_path(spark, "lines")
    e.run("export.csv", exportData="SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey", dataFileUrl=path, singleFile=True)
    return e.run("import.text", dataFileUrl=path, select=f"n_nationkey, n_name, lineNumber() AS line, lineOffset() AS part, dataFileUrl() = '{path}' AS told, fileTimestamp() > TIMESTAMP '2000-01-01' AS timed").drop(ROW)


@builder("q128_stems", """with w as (select doc_id, unnest(string_split(text, ' ')) as w from documents) select doc_id, (count(*) filter (regexp_matches(w, '^[a-z]*[bcdfghjklmnpqrtvwxz]s$') and regexp_matches(left(w, length(w) - 2), '[aeiouy]')))::bigint as plurals from w group by 1""")
def stems(e, spark, sf_dir):
    """Words whose plural ending the stemmer takes off: those in a consonant and s, with a vowel before."""
    e.create_function("sd", "stemmerdoc", language="english")
    ends = "^[a-z]*[bcdfghjklmnpqrtvwxz]s$"
    words = e.sql("SELECT doc_id, text FROM documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    e.register("words", words)
    out = e.sql("SELECT doc_id, w, sd({document: w})[document] AS s FROM words")
    return out.groupBy("doc_id").agg(F.count_if(F.col("w").rlike(ends) & ~F.col("s").endswith("s")).alias("plurals"))


@builder("q129_links", "select link, true as rises, true as better_than_chance from (values ('comp_log_log'), ('linear'), ('logit'), ('probit')) as l(link)")
def links(e, spark, sf_dir):
    """Metrics against bounds: each link's chances rise with a price that makes orders urgent."""
    data = "SELECT o_totalprice / 100000 AS price, o_totalprice + 100000 * (o_orderkey % 3) > 300000 AS hit FROM orders"
    found = []
    for link in ("comp_log_log", "linear", "logit", "probit"):
        e.run("classifier.train", trainingData=f"SELECT {{price}} AS features, hit AS label FROM ({data}) AS d", configuration={"type": "glz", "link_function": link}, functionName="f")
        scored = e.sql(f"SELECT price, hit, f({{features: {{price}}}})[score] AS score FROM ({data}) AS d")
        e.register("scored", scored.withColumnRenamed("hit", "label"))
        auc = e.run("classifier.test", testingData="SELECT score, label FROM scored").first()["auc"]
        found.append((link, scored.agg(F.corr("price", "score")).first()[0] > 0.8, auc > 0.7))
    return spark.createDataFrame(found, "link string, rises boolean, better_than_chance boolean")
