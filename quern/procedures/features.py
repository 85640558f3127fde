"""Feature procedures: tf-idf, rolling statistics by key, pooling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dialect.lexer import QueryError
from ..dialect.parser import parse_expr, parse_order
from ..engine import Function
from ..plans import select
from ..plans.scope import Scope
from ..plans.table import ROW, Table, q
from ..plans.values import Atom, Open, Row
from ..storage import stored
from .tabular import input_table

IDF = {
    "unary": lambda n, df, most: F.lit(1.0),
    "inverse": lambda n, df, most: F.ln(n / df),
    "inverseSmooth": lambda n, df, most: F.ln(1 + n / df),
    "inverseMax": lambda n, df, most: F.ln(1 + most / df),
    "probabilisticInverse": lambda n, df, most: F.ln((n - df) / df),
}


def tf(kind: str, k: Column, most: Column, total: Column) -> Column:
    k = k.cast("double")
    if kind == "raw":
        return k
    if kind == "log":
        return F.ln(1 + k)
    if kind == "augmented":
        return 0.5 + 0.5 * k / most
    if kind == "relative":
        return k / total
    raise ValueError(f"unknown term frequency {kind!r}")


def document_frequencies(table: Table) -> DataFrame:
    """(term, df): the number of rows that have a column; open rows count by their names."""
    kinds = dict(table.df.dtypes)
    maps = [c for c in table.columns if kinds[c].startswith("map")]
    if maps:
        terms = table.df.select(F.explode(F.map_keys(q(maps[0]))).alias("term"))
    else:
        terms = table.cells().select(F.col("column").alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(engine, trainingData: str, outputDataset: str | None = None, functionName: str | None = None, tfType: str = "raw", idfType: str = "inverseSmooth", **_: object) -> DataFrame:  # noqa: N803
    """Counts in how many rows each term occurs; the function weighs a bag of words by that."""
    table = input_table(engine, trainingData).with_row_name()
    n = table.df.count()
    df = document_frequencies(table)
    if outputDataset:
        engine.register(outputDataset, df, key="term")
    if functionName:
        most = df.agg(F.max("df")).first()[0] or 1
        size = df.count()
        if size > 2_000_000:
            raise ValueError("too many terms to send along; use weigh(), which joins")
        weights = {r["term"]: r["df"] for r in df.collect()}
        lookup = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if len(weights) <= 5000 else None

        def apply(scope, args):
            v = args[0].fields.get("input", args[0]) if isinstance(args[0], Row) else args[0]
            bag = v.col if isinstance(v, Open) else F.create_map(*[c for k, x in v.fields.items() for c in (F.lit(k), x.column().cast("bigint"))])
            values = F.map_values(bag)
            top, total = F.array_max(values), F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
            if lookup is None:
                raise ValueError("too many terms for a function; use weigh(), which joins")
            return Row({"output": Open(F.transform_values(bag, lambda t, k: tf(tfType, k, top, total) * IDF[idfType](F.lit(n), F.coalesce(F.try_element_at(lookup, t), F.lit(0)) + 0.0, F.lit(most))))})

        engine.functions[functionName] = Function(apply)
    return df


def weigh(bags: DataFrame, key: str, bag: str, df: DataFrame, n: int, tf_type: str = "raw", idf_type: str = "inverseSmooth") -> DataFrame:
    """(key, term, weight) for all bags, by a join with document frequencies of any number."""
    most = df.agg(F.max("df").alias("most"))
    values = F.map_values(q(bag))
    rows = bags.select(q(key), F.array_max(values).alias("top"), F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("total"), F.explode(q(bag)).alias("term", "k"))
    rows = rows.join(df, "term").crossJoin(F.broadcast(most))
    return rows.select(q(key), "term", (tf(tf_type, F.col("k"), F.col("top"), F.col("total")) * IDF[idf_type](F.lit(n), F.col("df"), F.col("most"))).alias("weight"))


def _ordered(engine, data: str, orderBy: str | None):  # noqa: N803
    text, order = data, orderBy
    if order is None and "ORDER BY" in data.upper():
        at = data.upper().rfind("ORDER BY")
        text, order = data[:at], data[at + 8 :]
    table = input_table(engine, text).with_row_name()
    scope = Scope(engine, table.df, table.versioned)
    keys = select.order_keys(scope, parse_order(order)) if order else []
    return table, scope, [*keys, (F.xxhash64(q(ROW)), True), (q(ROW), True)]


def _sums_before(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each row the sums over the rows of its key that come before it.  Rows are dealt in ranges of key and
    order; a range adds what the ranges before it hold of the key, so a frequent key takes many tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, F.col(key), *order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__part", key).agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    parts = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select(F.col("__part").alias("__p"), F.col(key).alias("__k"), *[F.coalesce(F.sum(f"__t{i}").over(parts), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    within = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(totals, (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k")))
    return out.select(*df.columns, *[(F.col(f"__b{i}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for i, (name, c) in enumerate(sums.items())])


def stats_table(engine, trainingData: str, outcomes: list[tuple[str, str]], select: str = "*", outputDataset: str | None = None, functionName: str | None = None, orderBy: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """For each column, how often its value was seen before, and with each outcome."""
    table, scope, order = _ordered(engine, trainingData, orderBy)
    columns = engine.select_items(table, select)
    hits = [(name, scope.boolean(parse_expr(text))) for name, text in outcomes]
    sort = [f"__o{i}" for i in range(len(order))]
    down = [F.col(c).asc() if up else F.col(c).desc() for c, (_, up) in zip(sort, order, strict=True)]
    df = table.df.select(q(ROW), *[c.alias(f"__c{i}") for i, (_, c) in enumerate(columns)], *[F.coalesce(h.cast("long"), F.lit(0)).alias(f"__h{i}") for i, (_, h) in enumerate(hits)], *[c.alias(s) for s, (c, _) in zip(sort, order, strict=True)])
    result, names = df, []
    for i, (name, _) in enumerate(columns):
        sums = {f"trial-{name}": F.lit(1)} | {f"{o}-{name}": F.col(f"__h{j}") for j, (o, _) in enumerate(hits)}
        result = _sums_before(result, f"__c{i}", down, sums)
        names += sums
    result = result.select(q(ROW), *map(q, names))
    if outputDataset:
        engine.register(outputDataset, result)
    if functionName:
        counts = {}
        for i, (name, _) in enumerate(columns):
            counts[name] = df.groupBy(F.col(f"__c{i}").cast("string").alias("v")).agg(F.count("*").alias("trial"), *[F.sum(f"__h{j}").alias(o) for j, (o, _) in enumerate(hits)])
        engine.functions[functionName] = Function(_counts(counts, [o for o, _ in hits]))
    return result


#: Values of a column whose counts a function sends along.
MOST_VALUES = 2_000_000


def _lookup(table: DataFrame):
    """A function from a column of strings to the numbers that a table (v, ...) has for them, or null.  The table is
    read when it is first asked; its size is checked."""
    found: list = []

    def of(x: Column) -> Column:
        if not found:
            import numpy as np

            rows = table.limit(MOST_VALUES + 1).toArrow()
            if rows.num_rows > MOST_VALUES:
                raise QueryError("too many values to send along; join the procedure's result")
            numbers = np.column_stack([np.array(c.to_pylist(), float) for c in rows.columns[1:]])
            shared = table.sparkSession.sparkContext.broadcast((dict(zip(rows.column(0).to_pylist(), range(rows.num_rows), strict=True)), numbers))

            @F.pandas_udf("array<double>")
            def find(values: pd.Series) -> pd.Series:
                at, numbers = shared.value
                return pd.Series([numbers[at[v]] if v in at else None for v in values.where(values.notna(), None)], dtype=object)

            found.append(find)
        return found[0](x)

    return of


def _counts(tables: dict[str, DataFrame], outcomes: list[str]):
    """Final counts of a value, by column."""
    of = {name: _lookup(df.select("v", "trial", *[q(o) for o in outcomes])) for name, df in tables.items()}

    def apply(scope, args):
        keys = args[0].fields.get("keys", args[0])
        out: dict[str, object] = {}
        for name, v in keys.fields.items():
            row = of[name](v.column().cast("string")) if name in of else None
            for i, what in enumerate(("trial", *outcomes)):
                out[f"{what}-{name}"] = Atom(F.coalesce(F.get(row, F.lit(i)).cast("long"), F.lit(0)) if row is not None else F.lit(0))
        return Row({"counts": Row(out)})

    return apply


def _statistics(tables: dict[str, DataFrame], outcomes: list[str], statistics: tuple[str, ...]):
    """Statistics of each outcome over all rows with a value, by column: none is a count of 0 and no numbers."""
    of = {name: _lookup(df) for name, df in tables.items()}

    def apply(scope, args):
        given = args[0].fields.get("features", args[0])
        out: dict[str, object] = {}
        for j, o in enumerate(outcomes):
            for name, v in given.fields.items():
                if name in of:
                    row = of[name](v.column().cast("string"))
                    for k, s in enumerate(statistics):
                        x = F.get(row, F.lit(j * len(statistics) + k))
                        out[f"{o}.{name}.{s}"] = Atom(F.coalesce(x.cast("long"), F.lit(0)) if s == "count" else F.coalesce(x, F.lit(float("nan"))))
        return Row({"stats": Row(out)})

    return apply


def bag_of_words(engine, trainingData: str, outcomes: list[tuple[str, str]], select: str = "*", outputDataset: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """For each word, in how many rows it occurs, and with each outcome."""
    table = input_table(engine, trainingData).with_row_name()
    scope = Scope(engine, table.df, table.versioned)
    hits = [(name, F.coalesce(scope.boolean(parse_expr(text)).cast("long"), F.lit(0))) for name, text in outcomes]
    cols = engine.select_items(table, select)
    kinds = {n: table.df.select(c.alias("x")).dtypes[0][1] for n, c in cols}
    words = F.concat(*[F.map_keys(c) if kinds[n].startswith("map") else F.array(F.when(c.isNotNull(), F.lit(n))) for n, c in cols])
    rows = table.df.select(F.explode(F.array_distinct(words)).alias("word"), *[h.alias(n) for n, h in hits]).where("word is not null")
    out = rows.groupBy("word").agg(F.count("*").alias("trial"), *[F.sum(n).alias(n) for n, _ in hits])
    if outputDataset:
        engine.register(outputDataset, out, key="word")
    return out


def dist_table(engine, trainingData: str, outcomes: list[tuple[str, str]], select: str = "*", outputDataset: str | None = None, statistics: tuple[str, ...] = ("count", "avg", "std", "min", "max", "last", "sum"), windowSize: int | None = None, orderBy: str | None = None, functionName: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """For each column, statistics of each outcome over earlier rows with the same value; with ``functionName``
    also a function that gives those of all rows."""
    table, scope, order = _ordered(engine, trainingData, orderBy)
    columns = engine.select_items(table, select)
    values = [(name, scope.column(parse_expr(text)).cast("double")) for name, text in outcomes]
    df = table.df.withColumns({f"__c{i}": c for i, (_, c) in enumerate(columns)} | {f"__v{i}": v for i, (_, v) in enumerate(values)})
    first = -windowSize if windowSize else Window.unboundedPreceding
    fns = {"count": F.count, "avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "last": lambda c: F.last(c, True)}
    out = [q(ROW)]
    for i, (name, _) in enumerate(columns):
        before = Window.partitionBy(f"__c{i}").orderBy(*[c.asc() if up else c.desc() for c, up in order]).rowsBetween(first, -1)
        out += [fns[s](f"__v{j}").over(before).alias(f"{o}.{name}.{s}") for j, (o, _) in enumerate(values) for s in statistics]
    if functionName:
        # the last row is that with the greatest order; numbers and times are turned round where it descends
        place = F.struct(*[c if up else -F.unix_micros(c) if scope.type(c).typeName().startswith("timestamp") else -c for c, up in order])
        last = lambda v: F.max_by(v, F.when(v.isNotNull(), place))
        whole = {"count": F.count, "avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "last": last}
        known = {name: df.groupBy(F.col(f"__c{i}").cast("string").alias("v")).agg(*[whole[s](F.col(f"__v{j}")).cast("double").alias(f"__s{j}_{s}") for j in range(len(values)) for s in statistics]) for i, (name, _) in enumerate(columns)}
        engine.functions[functionName] = Function(_statistics(known, [o for o, _ in values], tuple(statistics)))
    result = df.select(*out)
    if outputDataset:
        engine.register(outputDataset, result)
    return result


def pool(engine, inputData: str, embeddingDataset: str, wordsColumn: str = "words", aggregators: tuple[str, ...] = ("avg",), outputDataset: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """Pools the vectors of each row's words by a join; for vectors of any number."""
    table = input_table(engine, inputData).with_row_name()
    vectors = engine.table(embeddingDataset).with_row_name()
    kind = dict(table.df.dtypes)[wordsColumn]
    words = table.df.select(q(ROW), F.explode(F.map_keys(q(wordsColumn)) if kind.startswith("map") else q(wordsColumn)).alias("__w"))
    fns = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
    v = vectors.df.select(q(ROW).alias("__w"), *[q(c).cast("double").alias(c) for c in vectors.columns])
    pooled = words.join(v, "__w").groupBy(ROW).agg(*[fns[a](q(c)).alias(f"{a}.{c}") for a in aggregators for c in vectors.columns])
    out = table.df.select(ROW).join(pooled, ROW, "left").na.fill(0.0)
    if outputDataset:
        engine.register(outputDataset, out)
    return out
