"""Files in and out: text, JSON lines, listings, word lists and vectors, CSV."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import select
from ..plans.scope import Scope
from ..plans.table import ROW, TS, Table, q
from ..dialect.parser import parse_expr, parse_items


def _finish(engine, table: Table, outputDataset: str | None, items: str, where: str | None, named: str | None, timestamp: str | None = None) -> DataFrame:  # noqa: N803
    """Applies select, where, named and timestamp of an import, and names the dataset."""
    scope = Scope(engine, table.df)
    df = table.df
    if where:
        df = df.where(scope.boolean(parse_expr(where)))
        scope = Scope(engine, df)
    cols = select.spread(scope.items(parse_items(items)))
    extra = []
    if named:
        extra.append(scope.column(parse_expr(named)).cast("string").alias(ROW))
    elif ROW in df.columns:
        extra.append(q(ROW))
    if timestamp:
        extra.append(scope.column(parse_expr(timestamp)).cast("timestamp").alias(TS))
    out = df.select(*[c.alias(n) for n, c in cols], *extra)
    if outputDataset:
        engine.register(outputDataset, out)
    return out


def _numbered(df: DataFrame) -> DataFrame:
    """Lines by number from 1, in the order of the files' paths and of lines.  Blocks of files are counted first; how
    Spark deals them to tasks, larger ones first, does not matter."""
    parts = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__at"), F.col("_metadata.file_modification_time").alias("__modified"), F.monotonically_increasing_id().alias("__i"))
    blocks = parts.groupBy("__path", "__at").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__path", "__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a block
    blocks = blocks.select("__path", "__at", (before - F.col("first")).alias("__shift"))
    return parts.join(blocks, ["__path", "__at"]).withColumn("__line", F.col("__i") + F.col("__shift") + 1).drop("__path", "__at", "__i", "__shift")


def _fields(lines: DataFrame, headers: list[str] | None, generate: bool, options: dict[str, str], ignore_bad: bool, ignore_extra: bool) -> DataFrame:
    """Numbered lines cut into columns.  The first line has the names unless they are given or made; a column's
    type is the narrowest that all its values allow, which takes one aggregation."""
    head = lines.agg(F.min(F.struct("__line", "value")).alias("h")).first()["h"]
    first = head["value"] if head else ""
    spark = lines.sparkSession
    width = len(spark.range(1).select(F.schema_of_csv(F.lit(first), options).alias("s")).first()["s"].split(",")) if first else 0
    if headers is None and not generate and first:
        cells = ", ".join(f"c{i} string" for i in range(width))
        header = spark.range(1).select(F.from_csv(F.lit(first), F.lit(cells), options).alias("r")).first()["r"]
        names = _names(list(header), False)
        lines = lines.where(F.col("__line") > head["__line"])
    else:
        names = headers or _names([None] * width, True)
    if not names:
        return lines.drop("value")
    lines = lines.where(F.length(F.trim("value")) > 0)
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    bad = ignore_bad or not ignore_extra
    cut = lines.withColumn("__r", F.from_csv("value", F.lit(cells + (", bad string" if bad else "")), options | {"columnNameOfCorruptRecord": "bad"}))
    if ignore_bad:
        cut = cut.where("__r.bad is null")
    elif bad:
        cut = cut.withColumn("__r", F.when(F.col("__r.bad").isNull(), F.col("__r")).otherwise(F.raise_error(F.concat(F.lit("a line has a wrong number of fields: "), F.col("value")))))
    df = cut.select(*[F.col(f"__r.c{i}").alias(n) for i, n in enumerate(names)], *[c for c in lines.columns if c != "value"])
    # whole, number, time
    order = ("int", "bigint", "double", "timestamp")
    fits = df.agg(*[F.min(q(n).isNull() | q(n).try_cast(k).isNotNull()).alias(f"{k}{i}") for i, n in enumerate(names) for k in order], *[F.count(q(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    kind = [next((k for k in order if fits[f"{k}{i}"]), "string") if fits[f"n{i}"] else "string" for i in range(len(names))]
    return df.withColumns({n: q(n).cast(k) for n, k in zip(names, kind, strict=True) if k != "string"})


def _names(header: list[str | None], generate: bool) -> list[str]:
    out: list[str] = []
    for i, h in enumerate(header):
        name = h if h else (str(i) if generate else f"_c{i}")
        while name in out:
            name += "_"
        out.append(name)
    return out


def import_text(engine, dataFileUrl: str, outputDataset: str | None = None, headers: list[str] | None = None, quoteChar: str = '"', delimiter: str = ",", limit: int = -1, offset: int = 0, preHeaderOffset: int = 0, encoding: str = "utf-8", ignoreBadLines: bool = False, structuredColumnNames: bool = False, replaceInvalidCharactersWith: str = "", select: str = "*", where: str | None = None, named: str | None = None, timestamp: str | None = None, allowMultiLines: bool = False, autoGenerateHeaders: bool = False, ignoreExtraColumns: bool = False, processExcelFormulas: bool = False, skipLineRegex: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """Delimited or raw text.  Lines are read in parallel unless fields may hold line breaks; types
    are those that all values of a column allow."""
    spark = engine.spark
    if not delimiter or preHeaderOffset or skipLineRegex:
        lines = _numbered(spark.read.option("encoding", encoding).text(dataFileUrl))
        if skipLineRegex:
            lines = lines.where(~F.col("value").rlike(f"^(?:{skipLineRegex})$"))
        if preHeaderOffset:
            lines = lines.where(F.col("__line") > preHeaderOffset)
        skipped = 0
        if not delimiter:
            df = lines.withColumnRenamed("value", "lineText")
            offset += preHeaderOffset
        else:
            df = _fields(lines, headers, autoGenerateHeaders, {"sep": delimiter, "quote": quoteChar or "\u0000", "escape": quoteChar or "\\", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}, ignoreBadLines, ignoreExtraColumns)
            offset += preHeaderOffset + (headers is None and not autoGenerateHeaders)
    else:
        read = spark.read.option("sep", delimiter).option("quote", quoteChar or "\u0000").option("escape", quoteChar or "\\").option("encoding", encoding).option("inferSchema", True).option("multiLine", allowMultiLines).option("mode", "DROPMALFORMED" if ignoreBadLines else "PERMISSIVE" if ignoreExtraColumns else "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        in_file = headers is None and not autoGenerateHeaders
        df = read.option("header", in_file).csv(dataFileUrl)
        names = headers or (_names([None] * len(df.columns), True) if autoGenerateHeaders else _names(df.columns, False))
        if len(names) < len(df.columns) and ignoreExtraColumns:
            df = df.select(*df.columns[: len(names)])
        df = df.toDF(*names)
        mentioned = [x or "" for x in (select, where, named, timestamp)]
        numbered = offset or limit >= 0 or named is None or any(f in x.lower() for x in mentioned for f in ("linenumber", "lineoffset", "filetimestamp"))
        df = _numbered(df) if numbered else df
        skipped = int(in_file)
    if "__line" in df.columns:
        if offset:
            df = df.where(F.col("__line") > offset)
        if limit >= 0:
            df = df.where(F.col("__line") <= offset + limit)
        df = df.withColumn("__line", F.col("__line") + skipped).withColumn(ROW, F.col("__line").cast("string")).withColumn("__offset", F.lit(0).cast("long"))
    kinds = dict(df.dtypes)
    texts = [c for c in df.columns if kinds[c] == "string" and c != ROW]
    if processExcelFormulas:
        df = df.withColumns({c: F.regexp_replace(q(c), r'^="?(.*?)"?$', "$1") for c in texts})
    if replaceInvalidCharactersWith:
        df = df.withColumns({c: F.regexp_replace(q(c), "\ufffd", re.escape(replaceInvalidCharactersWith)) for c in texts})
    return _finish(engine, Table(df.withColumn("__url", F.lit(dataFileUrl))), outputDataset, select, where, named, timestamp)


def import_json(engine, dataFileUrl: str, outputDataset: str | None = None, limit: int = -1, offset: int = 0, ignoreBadLines: bool = False, select: str = "*", where: str | None = None, named: str | None = None, arrays: str = "parse", **_: object) -> DataFrame:  # noqa: N803
    """JSON lines; nested objects become dotted columns."""
    read = engine.spark.read.option("mode", "DROPMALFORMED" if ignoreBadLines else "FAILFAST")
    df = _numbered(read.json(dataFileUrl))
    if offset:
        df = df.where(F.col("__line") > offset)
    if limit >= 0:
        df = df.where(F.col("__line") <= offset + limit)
    df = df.withColumn(ROW, F.col("__line").cast("string")).drop("__line", "__modified")
    scope = Scope(engine, df)
    if arrays == "encode":
        df = df.withColumns({c: F.to_json(q(c)) for c, k in df.dtypes if k.startswith("array<struct")})
        scope = Scope(engine, df)
    flat = df.select(*[c.alias(n) for n, c in _spread(scope)], q(ROW))
    return _finish(engine, Table(flat), outputDataset, select, where, named)


def _spread(scope: Scope):
    return select.spread(scope.whole().fields)


def list_files(engine, path: str, outputDataset: str | None = None, modifiedSince: str | None = None, maxDepth: int = -1, **_: object) -> DataFrame:  # noqa: N803
    """Files below a path, without reading them."""
    df = engine.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    if modifiedSince:
        df = df.where(F.col("last_modified") >= F.lit(modifiedSince).cast("timestamp"))
    if maxDepth >= 0:
        root = re.sub(r"^[a-z]+:/+", "/", path).rstrip("/").count("/")
        depth = F.size(F.split(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "/")) - 1 - root
        df = df.where(depth <= maxDepth + 1)
    df = df.withColumn(ROW, F.col("path"))
    if outputDataset:
        engine.register(outputDataset, df)
    return df


def import_sentiwordnet(engine, dataFileUrl: str, outputDataset: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """Word scores: the mean over senses, earlier senses weighing more."""
    lines = engine.spark.read.text(dataFileUrl).where("value not like '#%' and length(trim(value)) > 0")
    p = F.split("value", "\t")
    rows = lines.select(p[0].alias("pos"), p[2].cast("double").alias("good"), p[3].cast("double").alias("bad"), F.explode(F.split(p[4], " ")).alias("term"))
    rows = rows.select(F.concat(F.split("term", "#")[0], F.lit("#"), "pos").alias("word"), F.split("term", "#")[1].cast("int").alias("sense"), "good", "bad")
    w = 1 / F.col("sense")
    out = rows.groupBy("word").agg((F.sum(F.col("good") * w) / F.sum(w)).alias("SentiPos"), (F.sum(F.col("bad") * w) / F.sum(w)).alias("SentiNeg"), F.count("*").alias("senses"))
    out = out.withColumn("baseWord", F.split("word", "#")[0]).withColumn(ROW, F.col("word")).drop("word")
    if outputDataset:
        engine.register(outputDataset, out)
    return out


def _binary_vectors(batches, first: int, most: int):
    """Words and vectors of files in the binary format: a head of counts, then for each word its name, a space
    and its numbers as 4-byte floats, with or without a line break behind."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            end = raw.index(b"\n")
            count, width = map(int, raw[:end].split())
            at, words, parts = end + 1, [], []
            for i in range(count if most < 0 else min(count, first + most)):
                space = raw.index(b" ", at)
                if i >= first:
                    words.append(raw[at:space].decode("utf-8", "replace").lstrip("\n"))
                    parts.append(raw[space + 1 : space + 1 + 4 * width])
                at = space + 1 + 4 * width
                if len(words) == 10_000 or words and i + 1 == min(count, count if most < 0 else first + most):
                    flat = np.frombuffer(b"".join(parts), "<f4").astype(np.float64)
                    vectors = pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * width, flat)
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), vectors], names=["word", "vector"])
                    words, parts = [], []


def import_word2vec(engine, dataFileUrl: str, outputDataset: str | None = None, limit: int = -1, offset: int = 0, named: str | None = None, binary: bool | None = None, **_: object) -> DataFrame:  # noqa: N803
    """Vectors by word, in the binary format or as text (a head of counts, then a word and its numbers a line); the
    second line tells which unless it is said.  A binary file has no marks to split it at, so a task reads it
    whole and Spark takes up to 2 GB; text is read in parallel."""
    if binary is None:
        head = [r["value"].split() for r in engine.spark.read.text(dataFileUrl).limit(2).collect()]
        binary = len(head) < 2 or len(head[1]) != int(head[0][1]) + 1
    if binary:
        files = engine.spark.read.format("binaryFile").load(dataFileUrl).select("content")
        out = files.mapInArrow(lambda batches: _binary_vectors(batches, offset, limit), "word string, vector array<double>")
    else:
        lines = _numbered(engine.spark.read.text(dataFileUrl)).where("__line > 1")
        p = F.split(F.trim("value"), " ")
        if offset:
            lines = lines.where(F.col("__line") > 1 + offset)
        if limit >= 0:
            lines = lines.where(F.col("__line") <= 1 + offset + limit)
        out = lines.select(p[0].alias("word"), F.transform(F.slice(p, 2, 1 << 30), lambda x: x.cast("double")).alias("vector"))
    name = Scope(engine, out).column(parse_expr(named)).cast("string") if named else F.col("word")
    out = out.select(name.alias(ROW), "vector")
    if outputDataset:
        engine.register(outputDataset, out)
    return out


def import_xlsx(engine, dataFileUrl: str, outputDataset: str | None = None, **_: object) -> DataFrame:  # noqa: N803
    """A spreadsheet, read on the driver by pandas where it has a reader for them."""
    import pandas as pd

    sheets = pd.read_excel(dataFileUrl, sheet_name=None)
    frames = [engine.spark.createDataFrame(pdf.assign(sheet=name)) for name, pdf in sheets.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if outputDataset:
        engine.register(outputDataset, out)
    return out


def import_jdbc(engine, url: str, query: str | None = None, dbtable: str | None = None, outputDataset: str | None = None, partitionColumn: str | None = None, lowerBound: int | None = None, upperBound: int | None = None, numPartitions: int | None = None, **options: str) -> DataFrame:  # noqa: N803
    """A relational database, in parallel where a partition column is given."""
    read = engine.spark.read.format("jdbc").option("url", url).options(**options)
    read = read.option("query", query) if query else read.option("dbtable", dbtable)
    for k, v in (("partitionColumn", partitionColumn), ("lowerBound", lowerBound), ("upperBound", upperBound), ("numPartitions", numPartitions)):
        if v is not None:
            read = read.option(k, v)
    out = read.load()
    if outputDataset:
        engine.register(outputDataset, out)
    return out


def export_csv(engine, exportData: str, dataFileUrl: str, headers: bool = True, delimiter: str = ",", quoteChar: str = '"', skipDuplicateCells: bool = False, singleFile: bool = False, **_: object) -> str:  # noqa: N803
    """A query's result as CSV: a folder of files in order, or one file if asked for."""
    table = engine.query(exportData)
    df = table.df.select(*[(F.element_at(q(c), -1)["v"] if skipDuplicateCells else F.element_at(q(c), 1)["v"]).alias(c) if c in table.versioned else q(c) for c in table.columns])
    kinds = dict(df.dtypes)
    df = df.withColumns({c: q(c).cast("int") for c in df.columns if kinds[c] == "boolean"} | {c: F.to_json(q(c)) for c in df.columns if kinds[c].startswith(("array", "map", "struct"))})
    out = df.coalesce(1) if singleFile else df
    out.write.mode("overwrite").option("header", headers).option("sep", delimiter).option("quote", quoteChar).option("escape", quoteChar).csv(dataFileUrl)
    return dataFileUrl
