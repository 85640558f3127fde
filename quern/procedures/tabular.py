"""Procedures on tables: transform, melt, bucketize, ranking, statistics, split, orchestration."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dialect.parser import parse_order
from ..operators import tables
from ..plans import select
from ..plans.scope import NUMBERS, Scope
from ..plans.table import ROW, Table, q
from ..storage import stored


def input_table(engine, data: str) -> Table:
    """A query, or the name of a dataset."""
    return engine.query(data) if data.strip().upper().startswith("SELECT") else engine.table(data)


def transform(engine, inputData: str, outputDataset: str | None = None, skipEmptyRows: bool = False, path: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """Runs a query and keeps its result as a dataset; with ``path``, as Parquet files."""
    table = input_table(engine, inputData)
    if skipEmptyRows and table.columns:
        table = Table(table.df.where(F.coalesce(*[F.when(q(c).isNotNull(), True) for c in table.columns])), table.versioned, table.key)
    if path:
        table.df.write.mode("overwrite").parquet(path)
        table = Table(engine.spark.read.parquet(path), table.versioned, table.key)
    if outputDataset:
        engine.register(outputDataset, table)
    return table.df


def melt(engine, inputData: str, outputDataset: str | None = None, keyColumnName: str = "key", valueColumnName: str = "value", to_fix: list[str] | None = None, to_melt: list[str] | None = None, **_: object) -> DataFrame:  # noqa: N803
    """A row for each melted column that has a value, called rowName.columnName."""
    table = input_table(engine, inputData).with_row_name()
    fixed = to_fix or []
    melted = to_melt or [c for c in table.columns if c not in fixed]
    kinds = {f.name: f.dataType for f in table.df.schema.fields}
    df = table.df
    if len({kinds[c].simpleString() for c in melted}) > 1:
        to = "double" if all(isinstance(kinds[c], NUMBERS) for c in melted) else "string"
        df = df.withColumns({c: q(c).cast(to) for c in melted})
    out = tables.melt(df, [ROW, *fixed], melted, keyColumnName, valueColumnName)
    out = out.withColumn(ROW, F.concat_ws(".", q(ROW), q(keyColumnName)))
    if outputDataset:
        engine.register(outputDataset, out)
    return out


def _numbered(engine, table: Table, order: str, name: str) -> DataFrame:
    """Rows with their place in an order, without bringing them together in one task: places within
    ranges of the order, and the sizes of ranges before."""
    scope = Scope(engine, table.df, table.versioned)
    keys = select.order_keys(scope, parse_order(order))
    cols = {f"__s{i}": c for i, (c, _) in enumerate(keys)} | {"__tie": F.xxhash64(q(ROW))}
    df = table.df.withColumns(cols)
    sort = [F.col(f"__s{i}").asc() if up else F.col(f"__s{i}").desc() for i, (_, up) in enumerate(keys)] + [F.col("__tie"), q(ROW)]
    n = int(engine.spark.conf.get("spark.sql.shuffle.partitions"))
    df = stored(df.repartitionByRange(n, *sort).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = df.groupBy("__part").count().collect()  # one row a partition
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        before[r["__part"]] = at
        at += r["count"]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("__part")] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*sort))
    return df.withColumn(name, (start + place - 1).cast("long")).drop("__part", *cols)


def ranking(engine, inputData: str, outputDataset: str | None = None, rankingType: str = "index", rankingColumnName: str = "rank", orderBy: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """The place of each row in the order, from 0."""
    data, order = _ordered(inputData, orderBy)
    table = input_table(engine, data).with_row_name()
    out = _numbered(engine, table, order, rankingColumnName).select(q(ROW), q(rankingColumnName))
    if outputDataset:
        engine.register(outputDataset, out)
    return out


def _ordered(data: str, order: str | None) -> tuple[str, str]:
    if order is not None:
        return data, order
    at = data.upper().rfind("ORDER BY")
    if at < 0:
        raise ValueError("an order is needed: ORDER BY in the query, or orderBy")
    return data[:at], data[at + 8 :]


def bucketize(engine, inputData: str, percentileBuckets: dict[str, tuple[float, float]], outputDataset: str | None = None, orderBy: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """Names the percentile range that each row falls in; bounds are whole rows, cut down."""
    data, order = _ordered(inputData, orderBy)
    table = input_table(engine, data).with_row_name()
    ranked = _numbered(engine, table, order, "__place")
    n = ranked.count()
    bucket = F.lit(None).cast("string")
    for name, (low, high) in percentileBuckets.items():
        a, b = int(low / 100 * n), int(high / 100 * n)
        bucket = F.when((F.col("__place") >= a) & (F.col("__place") < b), F.lit(name)).otherwise(bucket)
    out = ranked.select(q(ROW), bucket.alias("bucket")).where("bucket is not null")
    if outputDataset:
        engine.register(outputDataset, out)
    return out


def summary(engine, inputData: str, outputDataset: str | None = None, top: int = 10, **_: object) -> DataFrame:  # noqa: N803
    """One row a column.  A quartile is the first value at which the cumulative count passes its share."""
    table = input_table(engine, inputData)
    parts = []
    for c in table.columns:
        kind = table.df.schema[c].dataType
        numeric = isinstance(kind, NUMBERS)
        x = q(c)
        counts = table.df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count("*").alias("k"))
        base = table.df.agg(F.sum(x.isNull().cast("long")).alias("num_null"), F.count(x).alias("n"), *([F.min(x.cast("double")).alias("min"), F.max(x.cast("double")).alias("max"), F.avg(x).cast("double").alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(float("nan"))).alias("stddev")] if numeric else [F.lit(None).cast("double").alias(k) for k in ("min", "max", "mean", "stddev")]))
        stats = counts.agg(F.count("*").alias("num_unique"))
        frequent = counts.orderBy(F.desc("k"), F.col("v").cast("string")).limit(top).agg(F.to_json(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col("v").cast("string").alias("v"))))).alias("m"))
        frequent = frequent.select(F.expr("to_json(transform(from_json(m, 'array<struct<k:bigint,v:string>>'), e -> named_struct('value', e.v, 'count', -e.k)))").alias("most_frequent"))
        row = base.crossJoin(stats).crossJoin(frequent)
        if numeric:
            quart = _quartiles(engine, counts, [0.25, 0.5, 0.75])
            row = row.crossJoin(quart)
        else:
            row = row.select("*", *[F.lit(None).cast("double").alias(k) for k in ("first_quartile", "median", "third_quartile")])
        parts.append(row.select(F.lit(c).alias("column"), F.lit("number" if numeric else "categorical").alias("data_type"), "num_null", "num_unique", "min", "max", "mean", "stddev", "first_quartile", "median", "third_quartile", "most_frequent"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    if outputDataset:
        engine.register(outputDataset, out.withColumn(ROW, q("column")))
    return out


def _quartiles(engine, counts: DataFrame, shares: list[float]) -> DataFrame:
    """From distinct values and counts: ranges of values, their totals, and the place within."""
    n = int(engine.spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(counts.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.sum("k").alias("t"))
    before = totals.alias("a").join(totals.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.t"), F.lit(0)).alias("before"))
    whole = totals.agg(F.sum("t").alias("n"))
    w = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(before, "part").withColumn("cum", F.col("before") + F.sum("k").over(w)).crossJoin(whole)
    names = ("first_quartile", "median", "third_quartile")
    return run.agg(*[F.min(F.when(F.col("cum") > F.col("n") * s, F.col("v").cast("double"))).alias(k) for k, s in zip(names, shares, strict=True)])


def dataset_stats(engine, inputData: str, **_: object) -> DataFrame:  # noqa: N803
    """Numbers of rows, columns and cells, and of values by column."""
    table = input_table(engine, inputData)
    cols = table.columns
    base = table.df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("values")) for i, c in enumerate(cols)])
    return base.select("rows", F.lit(len(cols)).alias("columns"), F.explode(cells).alias("e")).select("rows", "columns", "e.column", "e.values")


def split(engine, labels: str, splits: list[float] = (0.8, 0.2), outputDatasets: list[str] | None = None, inputData: str | None = None, reproducible: bool = True, randomSeed: int = 1, **_: object) -> list[DataFrame]:  # noqa: N803
    """Splits rows so that each label falls into the parts by their shares.

    Within a combination of labels rows are placed by hash, and a row's place decides its part, so
    shares are right to one row a combination; no rows are gathered.
    """
    table = input_table(engine, inputData or labels).with_row_name()
    marks = [c for c in table.columns] if inputData is None else [c for c, _ in engine.select_items(table, labels)]
    df = table.df.withColumn("__combo", F.concat_ws(",", *[F.when(q(c).isNotNull() & (q(c).cast("string") != "0"), F.concat(F.lit(c + "="), q(c).cast("string"))) for c in marks]))
    seed = randomSeed if reproducible else __import__("random").getrandbits(31)
    h = F.xxhash64(q(ROW), F.lit(seed))
    # place within the combination: 64 hash ranges are counted, then rows within a range numbered
    df = df.withColumn("__h", h).withColumn("__r", F.shiftrightunsigned("__h", 58))
    counts = df.groupBy("__combo", "__r").agg(F.count("*").alias("__k"))
    w = Window.partitionBy("__combo").orderBy("__r")
    counts = counts.withColumn("__before", F.coalesce(F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__k").over(Window.partitionBy("__combo"))).drop("__k")
    df = df.join(counts, ["__combo", "__r"])
    df = df.withColumn("__place", F.col("__before") + F.row_number().over(Window.partitionBy("__combo", "__r").orderBy("__h", q(ROW))) - 1)
    total = sum(splits)
    out, low = [], 0.0
    for i, s in enumerate(splits):
        high = low + s / total
        inside = (F.col("__place") >= F.round(F.col("__n") * low)) & ((F.col("__place") < F.round(F.col("__n") * high)) if i + 1 < len(splits) else F.lit(True))
        part = df.where(inside).drop("__combo", "__h", "__r", "__before", "__n", "__place")
        if outputDatasets:
            engine.register(outputDatasets[i], part)
        out.append(part)
        low = high
    return out


def permuter(engine, procedure: dict, permutations: dict[str, list], **_: object) -> list:
    """Runs a procedure for every combination of the given settings."""
    out = []
    for values in itertools.product(*permutations.values()):
        setting = dict(zip(permutations, values, strict=True))
        params = json.loads(json.dumps(procedure.get("params", {}))) | setting
        out.append({"configuration": setting, "results": engine.run(procedure["type"], **params)})
    return out


def serial(engine, steps: list[dict], **_: object) -> list:
    return [engine.run(s["type"], **s.get("params", {})) for s in steps]


def null(engine, **_: object) -> None:
    return None


def create_entity(engine, kind: str, id: str, type: str | None = None, params: dict | None = None, **_: object):  # noqa: A002
    """Makes a function or runs a procedure by configuration."""
    if kind == "function":
        return engine.create_function(id, type, **(params or {}))
    if kind == "procedure":
        return engine.run(type, **(params or {}))
    raise ValueError(f"can't create a {kind}")


def script(engine, source: Callable, args: object = None, **_: object):
    """Calls a Python function with the engine."""
    return source(engine, args) if args is not None else source(engine)

