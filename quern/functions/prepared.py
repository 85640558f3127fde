"""Functions made from configurations: prepared queries and expressions, and what procedures train."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..dialect.lexer import QueryError
from ..dialect.parser import parse, parse_items
from ..plans.values import Atom, Emb, Open, Row, Value
from .stemming import stem
from .useragents import user_agent

# Common English words without content.
STOP_WORDS = frozenset("a an and are as at be but by for from has have he her his i if in into is it its me my no not of on or our she so such that the their them then there these they this to us was we were what when where which who will with you your".split())


def make(engine, kind: str | Callable, config: dict):
    from ..engine import Function

    if callable(kind):
        return Function(lambda scope, args: _wrapped(scope, kind(*[a.column() for a in args])))
    if kind not in KINDS:
        raise QueryError(f"unknown function type {kind!r}")
    return Function(KINDS[kind](engine, **config))


def _wrapped(scope, col) -> Value:
    return scope.wrap(col)


def _inputs(args: list[Value]) -> dict[str, Value]:
    if len(args) != 1 or not isinstance(args[0], Row):
        raise QueryError("a function takes one row of named inputs")
    return dict(args[0].fields)


def sql_expression(engine, expression: str, prepared: bool = False, raw: bool = False, autoInput: bool = False):  # noqa: N803
    items = parse_items(expression)

    def apply(scope, args):
        inputs = {"input": args[0]} if autoInput and args and not isinstance(args[0], Row) else _inputs(args) if args else {}
        inner = type(scope).over(scope, Row(inputs))
        out = inner.items(items)
        return next(iter(out.values())) if raw and len(out) == 1 else Row(out)

    return apply


def sql_query(engine, query: str, output: str = "FIRST_ROW"):
    """The query runs once for each distinct input; inputs are constants here."""
    statement = parse(query)

    def apply(scope, args):
        from ..plans import select

        params = {k: v.const if isinstance(v, Atom) and v.const is not None else v for k, v in (_inputs(args) if args else {}).items()}
        table = select.run(engine, statement, params)
        if output == "NAMED_COLUMNS":
            rows = table.df.select("column", "value").collect()
            return scope.constant_value({r["column"]: r["value"] for r in rows})
        first = table.df.limit(1).collect()
        return scope.constant_value({c: first[0][c] for c in table.columns} if first else {})

    return apply


def token_split(engine, tokens: list[str], splitChars: str = " ,", splitCharToInsert: str = " "):  # noqa: N803
    """Puts a split character around given tokens where there is none."""

    def apply(scope, args):
        text = _inputs(args)["text"].column() if isinstance(args[0], Row) else args[0].column()
        for tok in sorted(tokens, key=len, reverse=True):
            quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in tok)
            chars = "[" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in splitChars) + "]"
            text = F.regexp_replace(text, f"(?<=[^{chars[1:-1]}])({quoted})", splitCharToInsert + "$1")
            text = F.regexp_replace(text, f"({quoted})(?=[^{chars[1:-1]}])", "$1" + splitCharToInsert)
        return Row({"output": Atom(text)})

    return apply


def filter_stopwords(engine, language: str = "english", words: list[str] | None = None):
    """Leaves out columns that are called like stop words."""
    stop = frozenset(words) if words is not None else STOP_WORDS

    def apply(scope, args):
        v = _inputs(args).get("words", args[0])
        if isinstance(v, Open):
            return Row({"words": Open(F.map_filter(v.col, lambda k, _: ~F.lower(k).isin(*stop)))})
        return Row({"words": Row({k: x for k, x in v.fields.items() if k.lower() not in stop})})

    return apply


@lru_cache(1 << 17)
def _stem(word: str) -> str:
    """A worker remembers that many stems; others are found again when they occur in another batch."""
    return stem(word)


@arrow_udf(T.MapType(T.StringType(), T.LongType()))
def _stem_bag(bags: pa.Array) -> pa.Array:
    """Words are stemmed once a batch and counts added in whole columns."""
    begin = bags.offsets.to_numpy()
    row = np.repeat(np.arange(len(bags)), np.diff(begin))
    words, counts = (x[begin[0] : begin[-1]] for x in (bags.keys, bags.items))
    known = np.flatnonzero(counts.is_valid().to_numpy(zero_copy_only=False) & (bags.is_valid().to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, bool)))
    words = words.take(pa.array(known)).dictionary_encode()
    stems = pa.array([_stem(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    sums = pa.table({"row": row[known], "stem": stems.indices.take(words.indices), "n": counts.take(pa.array(known)).cast(pa.int64())}).group_by(["row", "stem"], use_threads=False).aggregate([("n", "sum")]).sort_by("row")
    ends = np.searchsorted(sums["row"].to_numpy(), np.arange(len(bags) + 1)).tolist()
    valid = bags.is_valid().to_pylist()
    starts = pa.array([x if ok else None for x, ok in zip(ends, [*valid, True], strict=True)], pa.int32())
    return pa.MapArray.from_arrays(starts, stems.dictionary.take(sums["stem"].combine_chunks()), sums["n_sum"].combine_chunks())


@arrow_udf(T.StringType())
def _stem_text(texts: pa.Array) -> pa.Array:
    """Equal texts of a batch, such as single words, are stemmed once."""
    texts = texts.dictionary_encode()
    stems = pa.array([" ".join(map(_stem, x.split())) for x in texts.dictionary.to_pylist()], pa.string())
    return stems.take(texts.indices)


def _english(language: str) -> None:
    if language != "english":
        raise QueryError(f"no stemmer for {language!r}")


def stemmer(engine, language: str = "english"):
    """The words of a bag by their stems, counts added; a string counts as 1."""
    _english(language)

    def count(scope, c):
        return F.when(c.isNotNull(), F.lit(1)).cast("bigint") if scope.type(c).typeName() == "string" else c.cast("bigint")

    def apply(scope, args):
        v = _inputs(args).get("words", args[0])
        if isinstance(v, Open):
            strings = scope.type(v.col).simpleString().endswith(",string>")
            col = F.transform_values(v.col, lambda _, c: F.when(c.isNotNull(), F.lit(1)).cast("bigint")) if strings else v.col.cast("map<string,bigint>")
        else:
            col = F.create_map(*[c for k, x in v.fields.items() for c in (F.lit(k), count(scope, x.column()))])
        return Row({"words": Open(_stem_bag(col))})

    return apply


def stemmerdoc(engine, language: str = "english"):
    """A text with each of its words by its stem."""
    _english(language)
    return lambda scope, args: Row({"document": Atom(_stem_text(_inputs(args)["document"].column()))})


def pooling(engine, embeddingDataset: str, aggregators: tuple[str, ...] = ("avg",)):  # noqa: N803
    """Pools the vectors of the words of a bag.  The dataset of vectors is read once and sent along;
    its size is checked, and larger ones are pooled by ``quern.procedures.pool``, which joins."""
    table = engine.table(embeddingDataset).with_row_name()
    n = table.df.count()
    if n * len(table.columns) > 20_000_000:
        raise QueryError("too many vectors to send along; use the procedure pool, which joins")
    rows = {r["_rowName"]: [float(r[c] or 0) for c in table.columns] for r in table.df.collect()}
    width = len(table.columns)
    how = {"avg": "mean", "min": "min", "max": "max", "sum": "sum"}

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def pool(words: pd.Series) -> pd.Series:
        import numpy as np

        def one(ws):
            found = [rows[w] for w in ([] if ws is None else ws) if w in rows]
            if not found:
                return [0.0] * (width * len(aggregators))
            m = np.array(found)
            return [float(x) for a in aggregators for x in getattr(m, how[a])(axis=0)]

        return words.map(one)

    def apply(scope, args):
        v = _inputs(args)["words"]
        words = F.map_keys(v.col) if isinstance(v, Open) else v.col if isinstance(v, Emb) else F.filter(F.array(*[F.when(x.column().isNotNull(), F.lit(k)) for k, x in v.leaves().items()]), lambda k: k.isNotNull())
        return Row({"embedding": Emb(pool(words))})

    return apply


def feature_hasher(engine, numBits: int = 8, mode: str = "columns"):  # noqa: N803
    """Hashes columns into 2 ** numBits signed features."""
    size = 1 << numBits

    def apply(scope, args):
        row = _inputs(args).get("columns", args[0])
        terms = []
        for k, v in row.leaves().items():
            c = v.column()
            name = F.lit(k) if mode == "columns" else F.concat(F.lit(k + "="), c.cast("string"))
            h = F.when(c.isNotNull(), F.xxhash64(name))
            weight = c.try_cast("double") if mode == "columns" else F.lit(1.0)
            terms.append(F.struct(F.pmod(h, F.lit(size)).cast("int").alias("i"), (F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0) * F.coalesce(weight, F.lit(1.0))).alias("v")))
        present = F.filter(F.array(*terms), lambda e: e["i"].isNotNull())
        return Row({"hash": Emb(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(present, lambda e: e["i"] == i), F.lit(0.0), lambda acc, e: acc + e["v"])))})

    return apply


def pos_neg(engine, statsTable: str, outcomeToUse: str, numPosNeg: int = 50, minTrials: int = 50):  # noqa: N803
    """The chances of an outcome for those words of a bag that speak most for it or most against it.
    The dataset is what statsTable.bagOfWords.train made; no more than the asked words come back."""
    table = engine.table(statsTable)
    p = (F.col(outcomeToUse) / F.col("trial")).alias("p")
    rated = table.df.where(F.col("trial") >= minTrials).select("word", p)
    rows = rated.orderBy(F.desc("p"), "word").limit(numPosNeg).union(rated.orderBy("p", "word").limit(numPosNeg)).distinct().collect()
    chances = F.create_map(*[F.lit(x) for r in rows for x in (r["word"], float(r["p"]))]) if rows else F.create_map().cast("map<string,double>")

    def apply(scope, args):
        v = _inputs(args).get("words", args[0])
        words = F.map_keys(v.col) if isinstance(v, Open) else F.filter(F.array(*[F.when(x.column().isNotNull(), F.lit(k)) for k, x in v.fields.items()]), lambda k: k.isNotNull())
        known = F.filter(words, lambda w: F.map_contains_key(chances, w))
        return Row({"probs": Open(F.map_from_arrays(known, F.transform(known, lambda w: F.try_element_at(chances, w))))})

    return apply


def derived_columns(engine, columns: list[str], expression: str, outcomes: list[str], columnId: str = "derived"):  # noqa: N803
    """Applies one expression over trial and outcomes to the counts of each column of a statistics table."""
    from ..dialect.parser import parse_expr

    def apply(scope, args):
        counts = _inputs(args).get("counts", args[0])
        fields = counts.leaves()
        out: dict[str, Value] = {}
        for c in columns:
            inner = type(scope).over(scope, Row({k: fields.get(f"{k}-{c}", Atom(F.lit(None).cast("double"))) for k in ("trial", *outcomes)}))
            out[f"{columnId}-{c}"] = inner.value(parse_expr(expression))
        return Row(out)

    return apply


def explain(engine, classifier):
    """What each feature adds to the score of a linear classifier, and its bias."""
    model = classifier.model
    if not hasattr(model, "coefficients"):
        raise QueryError("only linear classifiers can be explained")
    names = [c.removeprefix("features.") for c in classifier.columns]

    def apply(scope, args):
        given = _inputs(args).get("features", args[0]).leaves()
        parts = {n: Atom(F.coalesce(given[n].column().cast("double"), F.lit(0.0)) * float(w)) for n, w in zip(names, model.coefficients.toArray(), strict=True) if n in given}
        return Row({"bias": Atom(F.lit(float(model.intercept))), "explanation": Row(parts)})

    return apply


KINDS: dict[str, Callable] = {
    "sql.expression": sql_expression, "sql.query": sql_query, "tokensplit": token_split, "filter_stopwords": filter_stopwords, "stemmer": stemmer, "stemmerdoc": stemmerdoc,
    "pooling": pooling, "feature_hasher": feature_hasher, "http.useragent": user_agent,
    "statsTable.bagOfWords.posneg": pos_neg, "experimental.statsTable.derivedColumnsGenerator": derived_columns, "classifier.explain": explain,
}
