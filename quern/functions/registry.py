"""Functions of rows, values and texts.  Names are looked up here before anything of Spark's, whose
log, hash, concat, norm, slice and split_part mean something else."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import tree as t
from ..dialect.lexer import QueryError
from ..plans.table import ROW, q
from ..plans.values import Atom, Emb, Interval, Open, Row, Value
from . import arithmetic as a
from . import udfs

NAN, INF = float("nan"), float("inf")
FUNCTIONS: dict[str, Callable] = {}


def function(*names: str):
    def add(f):
        for n in names:
            FUNCTIONS[n.lower()] = f
        return f

    return add


def call(scope, e: t.Call) -> Value:
    name = e.name.lower()
    f = FUNCTIONS.get(name)
    if f is not None:
        return f(scope, *[scope.value(x) for x in e.args])
    special = SPECIAL.get(name)
    if special is not None:
        return special(scope, e)
    own = scope.engine.functions.get(e.name)
    if own is not None:
        return own.apply(scope, [scope.value(x) for x in e.args])
    if name in AGGREGATES_ONLY:
        raise QueryError(f"{e.name} can't stand here: it is an aggregate")
    raise QueryError(f"unknown function {e.name}")


def const(v: Value, what: str):
    if isinstance(v, Atom) and (v.const is not None):
        return v.const
    raise QueryError(f"{what} must be a constant")


def option(v: Value | None, name: str, default):
    if not isinstance(v, Row) or name not in v.fields:
        return default
    x = v.fields[name]
    if isinstance(x, Atom):
        return x.const
    return x


def each(f: Callable[[Column], Column], scope, x: Value, to_double: bool = True) -> Value:
    """Maps over a value, the leaves of a row, or the elements of an embedding."""
    if isinstance(x, Row):
        return Row({k: each(f, scope, v, to_double) for k, v in x.leaves().items()})
    if isinstance(x, Emb):
        return Emb(F.transform(x.col, lambda v: f(v.cast("double") if to_double else v)))
    if isinstance(x, Open):
        return Open(F.transform_values(x.col, lambda _, v: f(v.cast("double") if to_double else v)))
    col = a.number(scope, x.column())
    return Atom(f(col.cast("double") if to_double else col))


_log = a.logarithm


UNARY: dict[str, Callable[[Column], Column]] = {
    "ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double"), "round": lambda c: F.round(c), "exp": F.exp, "abs": F.abs,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "ln": _log, "sqrt": F.sqrt, "isnan": F.isnan, "isinf": lambda c: F.abs(c) == INF, "isfinite": lambda c: ~F.isnan(c) & (F.abs(c) != INF),
}
for _name, _f in UNARY.items():
    FUNCTIONS[_name] = lambda scope, x, _f=_f: each(_f, scope, x)

for _names, _f in {
    ("pow", "power"): lambda x, y: F.pow(x, y), ("atan2",): F.atan2, ("quantize",): lambda x, y: F.round(a.divide(x, y)) * y,
}.items():
    for _name in _names:
        FUNCTIONS[_name] = lambda scope, x, y, _f=_f: each(lambda c: _f(c, y.column().cast("double")), scope, x)


@function("mod")
def mod(scope, x, y):
    return a.binary(scope, "%", x, y)


@function("sign")
def sign(scope, x):
    if isinstance(scope.type(x), T.StringType):
        return Atom(F.when(x.column().isNotNull(), F.lit(NAN)))
    return each(lambda c: F.when(F.isnan(c), F.lit(NAN)).otherwise(F.signum(c)), scope, x)


@function("log")
def log(scope, x, y=None):
    if y is None:
        return each(lambda c: _log(c) / math.log(10), scope, x)
    base = x.column().cast("double")
    return each(lambda c: a.divide(_log(c), _log(base)), scope, y)


@function("pi")
def pi(scope):
    return Atom(F.pi())


@function("e")
def euler(scope):
    return Atom(F.e())


for _name, _test in {
    "replace_nan": lambda c: F.isnan(c), "replace_inf": lambda c: F.abs(c) == INF, "replace_not_finite": lambda c: F.isnan(c) | (F.abs(c) == INF), "replace_null": lambda c: c.isNull(),
}.items():

    def _replace(scope, x, y, _test=_test, _name=_name):
        if isinstance(x, Atom) and isinstance(scope.type(x), (T.StringType, T.TimestampType)):
            return Atom(F.coalesce(x.col, y.column())) if _name == "replace_null" else x
        return each(lambda c: F.when(_test(c), y.column().cast("double")).otherwise(c), scope, x)

    FUNCTIONS[_name] = _replace

for _name, _op in {"vector_diff": "-", "vector_sum": "+", "vector_product": "*", "vector_quotient": "/"}.items():
    FUNCTIONS[_name] = lambda scope, x, y, _op=_op: a.binary(scope, _op, x, y)


@function("clamp")
def clamp(scope, x, low, high):
    lo, hi = low.column().cast("double"), high.column().cast("double")
    return each(lambda c: F.when(c.isNull(), c).when(F.isnan(c), lo).otherwise(F.least(F.greatest(c, lo), hi)), scope, x)


def _wilson(trials: Column, good: Column, side: int) -> Column:
    z = 1.2815515655446004  # fixed value: the normal quantile at 0.9
    n, p = trials.cast("double"), a.divide(good, trials)
    share = lambda x, m: a.divide(F.lit(x), m)
    return a.divide(p + share(z * z, 2 * n) + side * z * F.sqrt(a.divide(p * (1 - p) + share(z * z, 4 * n), n)), 1 + share(z * z, n))


@function("binomial_ub_80")
def binomial_ub(scope, n, k):
    return Atom(_wilson(n.column(), k.column(), 1))


@function("binomial_lb_80")
def binomial_lb(scope, n, k):
    return Atom(_wilson(n.column(), k.column(), -1))


# texts


def text(name: str, f: Callable[..., Column]) -> None:
    FUNCTIONS[name] = lambda scope, *args: Atom(f(*[x.column().cast("string") for x in args]))


text("lower", F.lower)
text("upper", F.upper)
text("length", F.char_length)
text("levenshtein_distance", F.levenshtein)
text("remove_prefix", lambda s, p: F.when(F.startswith(s, p), F.substr(s, F.char_length(p) + 1)).otherwise(s))
text("remove_suffix", lambda s, p: F.when(F.endswith(s, p), F.substr(s, F.lit(1), F.char_length(s) - F.char_length(p))).otherwise(s))
def pattern(name: str, f: Callable[..., Column]) -> None:
    """A constant pattern is looked at while the query is analysed, where ``try`` catches its errors."""

    def checked(scope, *args):
        if len(args) > 1 and isinstance(args[1], Atom) and isinstance(args[1].const, str):
            try:
                scope.df.sparkSession._jvm.java.util.regex.Pattern.compile(args[1].const)
            except Exception as why:  # the Java side's error
                raise QueryError(f"bad pattern {args[1].const!r}") from why
        return Atom(f(*[x.column().cast("string") for x in args]))

    FUNCTIONS[name] = checked


pattern("regex_search", lambda s, p: F.regexp_like(s, p))
pattern("regex_match", lambda s, p: F.regexp_like(s, F.concat(F.lit("^(?:"), p, F.lit(")\\z"))))
pattern("regex_replace", lambda s, p, r: F.regexp_replace(s, p, F.regexp_replace(F.regexp_replace(r, F.lit(r"\\(\d)"), F.lit(r"\$$1")), F.lit(r"\$&"), F.lit(r"\$0"))))


@function("blob_length")
def blob_length(scope, x):
    return Atom(F.octet_length(x.column()))


@function("base64_encode")
def base64_encode(scope, x):
    return Atom(F.base64(x.column().cast("binary")))


@function("base64_decode")
def base64_decode(scope, x):
    return Atom(F.unbase64(x.column()))


@function("implicit_cast")
def implicit_cast(scope, x):
    """A column has one type: numbers if every text of it is one is not known beforehand, so a text
    that is no number keeps the column a text, with numbers spelled plainly."""
    if not isinstance(scope.type(x), T.StringType):
        return x
    c = x.column()
    n = c.try_cast("double")
    return Atom(F.when(c == "", F.lit(None)).when(n.isNull(), c).when(n == F.floor(n), n.cast("decimal(20,0)").cast("string")).otherwise(n.cast("string")))


def tokens_of(c: Column, options: Value | None) -> Column:
    """The tokens of a text, n-grams included."""
    chars = option(options, "splitChars", option(options, "splitchars", ","))
    quote = option(options, "quoteChar", option(options, "quotechar", ""))
    start, limit, least = (option(options, k, option(options, k.lower(), d)) for k, d in (("offset", 0), ("limit", -1), ("minTokenLength", 1)))
    words = _split_quoted(c, chars, quote) if quote else F.split(c, _any_of(chars))
    if start:
        words = F.slice(words, int(start) + 1, 1 << 30)
    if limit is not None and limit >= 0:
        words = F.slice(words, 1, int(limit))
    words = F.filter(words, lambda w: F.char_length(w) >= max(1, int(least)))
    grams = option(options, "ngramRange", option(options, "ngram_range", None))
    if grams is not None:
        low, high = (int(x) for x in scope_constants(grams))
        parts = [words] if low <= 1 else []
        for n in range(max(low, 2), high + 1):
            parts.append(_grams(words, n))
        words = F.concat(*parts) if parts else words
    return words


def _any_of(chars: str) -> str:
    """A pattern for one of these characters."""
    return "[" + "".join("\\" + ch if not ch.isalnum() else ch for ch in chars) + "]"


def _split_quoted(c: Column, chars: str, quote: str) -> Column:
    """The tokens of a text where characters between quotes don't split; quotes are dropped wherever they stand."""
    piece = lambda w, new: F.struct(w.alias("w"), new.alias("new"))

    def pieces(p: Column, i: Column) -> Column:
        whole = F.array(piece(p, F.lit(False)))
        return F.when(i % 2 == 0, F.transform(F.split(p, _any_of(chars)), lambda w, j: piece(w, j > 0))).otherwise(whole) if chars else whole

    def tokens(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | F.get(s, i - 1)["new"])

        def joined(b: Column) -> Column:
            size = lambda i, j: F.coalesce(F.get(b, j + 1), F.size(s) + 1) - i
            return F.transform(b, lambda i, j: F.array_join(F.transform(F.slice(s, i, size(i, j)), lambda p: p["w"]), ""))

        return _bound(begins, joined)

    quoted = F.when(c.isNotNull(), _bound(F.flatten(F.transform(F.split(c, _any_of(quote)), pieces)), tokens))
    return F.when(~c.rlike(_any_of(quote)), F.split(c, _any_of(chars)) if chars else F.array(c)).otherwise(quoted)


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def bag_of(words: Column) -> Column:
    """How often each word occurs: words are sorted, and runs of equal ones end where the next differs."""

    def bag(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))

        def counts(e: Column) -> Column:
            before = lambda j: F.when(j > 0, F.get(e, j - 1)).otherwise(F.lit(0))
            return F.map_from_arrays(F.transform(e, lambda i: F.get(s, i - 1)), F.transform(e, lambda i, j: (i - before(j)).cast("bigint")))

        return F.when(F.size(s) > 0, _bound(ends, counts)).when(s.isNotNull(), F.create_map().cast("map<string,bigint>"))

    return _bound(F.sort_array(words), bag)


def _grams(words: Column, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), "_"))


def scope_constants(v: Value | list) -> list:
    if isinstance(v, Emb) and getattr(v, "constants", None) is not None:
        return v.constants
    raise QueryError("ngramRange must be two numbers")


@function("tokenize")
def tokenize(scope, x, options=None):
    words = tokens_of(x.column(), options)
    value = option(options, "value", None)
    if value is not None:
        distinct = F.array_distinct(words)
        return Open(F.map_from_arrays(distinct, F.transform(distinct, lambda w: F.lit(value).cast("long"))))
    return Open(bag_of(words))


@function("token_extract")
def token_extract(scope, x, n, options=None):
    return Atom(F.get(tokens_of(x.column(), options), n.column().cast("int")))


@function("split_part")
def split_part(scope, x, chars):
    c = const(chars, "the split characters")
    return Emb(F.split(x.column(), _any_of(c)))


@function("extract_domain")
def extract_domain(scope, x, options=None):
    host = F.try_parse_url(x.column(), F.lit("HOST"))
    if option(options, "removeSubdomain", False):
        host = F.regexp_extract(host, r"([^.]+\.(?:(?:co|com|org|net|gov|ac|edu)\.[a-z]{2}|[^.]+))$", 1)
    return Atom(host)


@function("extract_links")
def extract_links(scope, x):
    return Emb(udfs.links(x.column()))


@function("extract_text")
def extract_text(scope, x):
    return Atom(udfs.page_text(x.column()))


@function("mime_type")
def mime_type(scope, x):
    return Atom(udfs.mime(x.column().cast("binary")))


@function("parse_exif")
def parse_exif(scope, x):
    return Open(udfs.exif(x.column().cast("binary")))


@function("fetcher")
def fetcher(scope, x):
    got = udfs.fetch(x.column())
    return Row({"content": Atom(got["content"]), "error": Atom(got["error"])})


# JSON


@function("parse_json")
def parse_json(scope, x, options=None):
    """A row with open names: dotted paths to texts; numbers are spelled as JSON has them."""
    how = option(options, "arrays", "parse")
    skip = bool(option(options, "ignoreErrors", False)) or getattr(scope, "trying", False)
    return Open(udfs.flat_json(x.column(), F.lit(how), F.lit(skip)))


@function("print_json")
def print_json(scope, x):
    if isinstance(x, Atom):
        kind = scope.type(x)
        c = x.column()
        if isinstance(kind, T.StringType):
            return Atom(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))
        return Atom(c.cast("string"))
    return Atom(F.to_json(x.column()))


# paths


@function("parse_path", "unflatten_path")
def parse_path(scope, x):
    return Emb(udfs.path_parts(x.column().cast("string")))


@function("stringify_path", "flatten_path")
def stringify_path(scope, x):
    if not isinstance(x, Emb):
        return Atom(x.column().cast("string"))
    return Atom(F.array_join(F.transform(x.col.cast("array<string>"), lambda p: F.when(p.rlike(r'[."]') | (p == ""), F.concat(F.lit('"'), F.replace(p, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(p)), "."))


@function("path_element")
def path_element(scope, x, n):
    p = x.col if isinstance(x, Emb) else udfs.path_parts(x.column())
    i = n.column().cast("int")
    return Atom(F.get(p, F.when(i < 0, F.size(p) + i).otherwise(i)))


@function("path_length")
def path_length(scope, x):
    return Atom(F.size(x.col if isinstance(x, Emb) else udfs.path_parts(x.column())))


# times


def versions(x: Value) -> list[Column]:
    """Arrays of (ts, v) of a value or of the cells of a row."""
    if isinstance(x, Row):
        return [c for v in x.leaves().values() for c in versions(v)]
    if isinstance(x, Atom) and x.versions is not None:
        return [x.versions]
    c = x.column()
    ts = x.ts if isinstance(x, Atom) and x.ts is not None else F.lit(None).cast("timestamp")
    return [F.when(c.isNotNull(), F.array(F.struct(ts.alias("ts"), c.alias("v"))))]


def per_cell(x: Value, f: Callable[[Column], Column]) -> Value:
    if isinstance(x, Row):
        return Row({k: per_cell(v, f) for k, v in x.leaves().items()})
    return Atom(f(versions(x)[0]))


def _numbers(v: Column) -> Column:
    return F.transform(F.filter(v, lambda e: e["v"].isNotNull()), lambda e: e["v"].cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e)


for _name, _f in {
    "temporal_earliest": lambda v: F.array_min(v)["v"],
    "temporal_latest": lambda v: F.array_max(v)["v"],
    "temporal_min": lambda v: F.array_min(F.transform(v, lambda e: e["v"])),
    "temporal_max": lambda v: F.array_max(F.transform(v, lambda e: e["v"])),
    "temporal_sum": lambda v: _sum(_numbers(v)),
    "temporal_avg": lambda v: _sum(_numbers(v)) / F.size(_numbers(v)),
    "temporal_count": lambda v: F.coalesce(F.size(F.filter(v, lambda e: e["v"].isNotNull())), F.lit(0)).cast("long"),
}.items():
    FUNCTIONS[_name] = lambda scope, x, _f=_f: per_cell(x, _f)


def _stamps(x: Value) -> Column:
    parts = [F.transform(v, lambda e: e["ts"]) for v in versions(x)]
    return F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))


FUNCTIONS["earliest_timestamp"] = lambda scope, x: Atom(F.array_min(_stamps(x)))
FUNCTIONS["latest_timestamp"] = lambda scope, x: Atom(F.array_max(_stamps(x)))
FUNCTIONS["distinct_timestamps"] = lambda scope, x: Emb(F.array_sort(F.array_distinct(_stamps(x))))
FUNCTIONS["to_timestamp"] = lambda scope, x: a.cast(scope, x, "timestamp")
FUNCTIONS["at"] = lambda scope, x, ts: Atom(x.column(), ts=ts.column())
FUNCTIONS["now"] = lambda scope: Atom(F.current_timestamp())


def _stamp(scope, x: Value) -> Column:
    c = a.cast(scope, x, "timestamp").column()
    return c


DATE_PARTS: dict[str, Callable[[Column], Column]] = {
    "microsecond": lambda c: F.pmod(F.unix_micros(c), F.lit(1_000_000)), "millisecond": lambda c: F.floor(F.pmod(F.unix_micros(c), F.lit(1_000_000)) / 1000), "second": F.second, "minute": F.minute, "hour": F.hour, "day": F.dayofmonth,
    "dow": lambda c: F.dayofweek(c) - 1, "doy": lambda c: F.dayofyear(c) - 1, "week": lambda c: F.floor((F.dayofyear(c) - 1) / 7), "month": F.month, "quarter": F.quarter, "year": F.year,
    "isodow": lambda c: F.weekday(c) + 1, "isoweek": F.weekofyear, "isoyear": lambda c: F.extract(F.lit("YEAROFWEEK"), c),
    "isodoy": lambda c: F.weekofyear(c) * 7 - 7 + F.weekday(c) + 1,
}


def _moved(c: Column, zone: Value | None) -> Column:
    """Times move by a zone given as an offset, +hh:mm."""
    if zone is None:
        return c
    s = str(const(zone, "the time zone")).replace(":", "")
    if s in ("Z", "z", "UTC"):
        return c
    minutes = int(s[1:3]) * 60 + int(s[3:5] or 0)
    return c + F.make_interval(mins=F.lit(minutes if s[0] != "-" else -minutes))


@function("date_part")
def date_part(scope, unit, x, zone=None):
    u = str(const(unit, "the unit")).lower()
    if u not in DATE_PARTS:
        raise QueryError(f"unknown time unit {u!r}")
    return Atom(DATE_PARTS[u](_moved(_stamp(scope, x), zone)).cast("long"))


@function("date_trunc")
def date_trunc(scope, unit, x, zone=None):
    u = str(const(unit, "the unit")).lower()
    c = _moved(_stamp(scope, x), zone)
    if u not in DATE_PARTS:
        raise QueryError(f"unknown time unit {u!r}")
    if u == "isoyear":
        thursday = F.date_trunc("week", c) + F.make_interval(days=F.lit(3))
        return Atom(F.date_trunc("week", F.date_trunc("year", thursday) + F.make_interval(days=F.lit(3))))
    if u == "week":  # weeks begin on Sunday, ISO weeks on Monday
        return Atom(F.date_trunc("day", c) - F.make_interval(days=F.dayofweek(c) - 1))
    return Atom(F.date_trunc({"dow": "day", "doy": "day", "isodow": "day", "isodoy": "day", "isoweek": "week"}.get(u, u), c))


# rows


def _leaf_columns(scope, x: Value) -> list[Column]:
    if isinstance(x, Row):
        return [v.column() for v in x.leaves().values() if not isinstance(v, (Emb, Open, Interval))]
    return [x.column()]


def _as_array(scope, x: Value, to: str | None = None) -> Column:
    if isinstance(x, Emb):
        return x.col.cast(f"array<{to}>") if to else x.col
    if isinstance(x, Open):
        return F.map_values(x.col).cast(f"array<{to}>") if to else F.map_values(x.col)
    cols = _leaf_columns(scope, x)
    cols = [a.number(scope, c).try_cast(to) if to == "double" else c.cast(to) for c in cols] if to else a.alike(scope, cols)
    return F.array(*cols) if cols else F.array().cast("array<double>")


def _present(c: Column) -> Column:
    return F.filter(c, lambda v: v.isNotNull())


@function("horizontal_count")
def horizontal_count(scope, x):
    return Atom(F.size(_present(_as_array(scope, x, "string"))).cast("long"))


@function("horizontal_sum")
def horizontal_sum(scope, x):
    return Atom(_sum(_present(_as_array(scope, x, "double"))))


@function("horizontal_avg")
def horizontal_avg(scope, x):
    v = _present(_as_array(scope, x, "double"))
    return Atom(F.when(F.size(v) > 0, _sum(v) / F.size(v)))


@function("horizontal_min")
def horizontal_min(scope, x):
    return Atom(F.array_min(_as_array(scope, x)))


@function("horizontal_max")
def horizontal_max(scope, x):
    return Atom(F.array_max(_as_array(scope, x)))


@function("horizontal_string_agg")
def horizontal_string_agg(scope, x, sep=None):
    return Atom(F.array_join(_present(_as_array(scope, x, "string")), const(sep, "the separator") if sep is not None else ""))


def _by_time(x: Value, pick) -> Column:
    all_ = [F.transform(v, lambda e: F.struct(e["ts"].alias("ts"), e["v"].cast("string").alias("v"))) for v in versions(x)]
    return pick(F.flatten(F.filter(F.array(*all_), lambda p: p.isNotNull())))["v"]


FUNCTIONS["horizontal_earliest"] = lambda scope, x: Atom(_by_time(x, F.array_min))
FUNCTIONS["horizontal_latest"] = lambda scope, x: Atom(_by_time(x, F.array_max))
FUNCTIONS["extract_column"] = lambda scope, x: x


@function("jaccard_index")
def jaccard_index(scope, x, y):
    def keys(v):
        if isinstance(v, Open):
            return F.map_keys(F.map_filter(v.col, lambda _, e: e.isNotNull()))
        if isinstance(v, Emb):
            return F.array_distinct(v.col)
        return _present(F.array(*[F.when(c.column().isNotNull(), F.lit(k)) for k, c in v.leaves().items()]))

    kx, ky = keys(x), keys(y)
    union = F.size(F.array_union(kx, ky))
    return Atom(F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(kx, ky)) / union))


# embeddings


def vector(scope, x: Value) -> Column:
    return _as_array(scope, x, "double")


@function("norm")
def norm(scope, x, p):
    return Atom(_norm(vector(scope, x), float(const(p, "the order of the norm"))))


def _norm(v: Column, p: float) -> Column:
    if p == 0:
        return F.size(F.filter(v, lambda e: e != 0)).cast("double")
    if p == INF:
        return F.array_max(F.transform(v, F.abs))
    if p == 1:
        return _sum(F.transform(v, F.abs))
    if p == 2:
        return F.sqrt(_sum(F.transform(v, lambda e: e * e)))
    return F.pow(_sum(F.transform(v, lambda e: F.pow(F.abs(e), F.lit(p)))), F.lit(1 / p))


@function("normalize")
def normalize(scope, x, p):
    v = vector(scope, x)
    n = _norm(v, float(const(p, "the order of the norm")))
    if isinstance(x, Row):
        return Row({k: Atom(a.divide(c.column(), n)) for k, c in x.leaves().items()})
    return Emb(F.transform(v, lambda e: a.divide(e, n)))


def _depth(kind: T.DataType) -> int:
    return 1 + _depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


@function("shape")
def shape(scope, x):
    out, c = [], x.column()
    for _ in range(max(1, _depth(scope.type(x)))):
        out.append(F.size(c))
        c = F.get(c, F.lit(0))
    return Emb(F.array(*out))


def _flat(scope, x: Value) -> Column:
    c = x.column()
    for _ in range(_depth(scope.type(x)) - 1):
        c = F.flatten(c)
    return c


@function("flatten")
def flatten(scope, x):
    return Emb(_flat(scope, x)) if isinstance(x, Emb) else Emb(_as_array(scope, x))


@function("reshape")
def reshape(scope, x, dims, new=None):
    """Dimensions are constants; values beyond are left out, missing ones are ``new``."""
    sizes = [int(d) for d in scope_constants(dims)]
    flat = _flat(scope, x).cast("array<double>")
    total = math.prod(sizes)
    if new is not None:
        flat = F.slice(F.concat(flat, F.array_repeat(new.column().cast("double"), total)), 1, total)
    for size in reversed(sizes[1:]):
        flat = _chunks(flat, size)
    return Emb(flat)


def _chunks(c: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(c) / size).cast("int") - 1), lambda i: F.slice(c, i * size + 1, size))


@function("concat")
def concat(scope, *xs):
    """Joins embeddings along their last dimension."""

    def join(cols, depth):
        if depth <= 1:
            return F.concat(*cols)
        out = cols[0]
        for c in cols[1:]:
            out = F.zip_with(out, c, lambda p, r: join([p, r], depth - 1))
        return out

    return Emb(join([x.column() for x in xs], _depth(scope.type(xs[0]))))


@function("slice")
def slice_(scope, x, i):
    """The i-th entry of the last dimension."""

    def take(c, depth):
        return F.get(c, i.column().cast("int")).cast("double") if depth <= 1 else F.transform(c, lambda r: take(r, depth - 1))

    depth = _depth(scope.type(x))
    out = take(x.column(), depth)
    return Atom(out) if depth <= 1 else Emb(out)


@function("fft")
def fft(scope, x, direction=None, kind=None):
    return Emb(udfs.fft(vector(scope, x), F.lit(const(direction, "the direction") if direction else "forward"), F.lit(const(kind, "the type") if kind else "real")))


def _pairs(f):
    return lambda scope, x: Emb(F.transform(x.col, f))


FUNCTIONS["real"] = _pairs(lambda p: p[0])
FUNCTIONS["imag"] = _pairs(lambda p: p[1])
FUNCTIONS["amplitude"] = _pairs(lambda p: F.sqrt(p[0] * p[0] + p[1] * p[1]))
FUNCTIONS["phase"] = _pairs(lambda p: F.atan2(p[0], p[1]))


@function("impulse")
def impulse(scope, n):
    return shifted_impulse(scope, n, Atom(F.lit(0)))


@function("shifted_impulse")
def shifted_impulse(scope, n, at):
    return Emb(F.transform(F.sequence(F.lit(0), n.column().cast("int") - 1), lambda i: F.when(i == at.column().cast("int"), 1.0).otherwise(0.0)))


# places


@function("geo_distance")
def geo_distance(scope, lat1, lon1, lat2, lon2):
    r = [F.radians(x.column().cast("double")) for x in (lat1, lon1, lat2, lon2)]
    h = F.pow(F.sin((r[2] - r[0]) / 2), 2) + F.cos(r[0]) * F.cos(r[2]) * F.pow(F.sin((r[3] - r[1]) / 2), 2)
    return Atom(2 * 6371008.8 * F.asin(F.sqrt(h)))  # fixed value: the mean radius of the Earth in metres


@function("st_contains_point")
def contains_point(scope, shape_, lat, lon):
    return Atom(udfs.contains_point(shape_.column().cast("string"), lat.column().cast("double"), lon.column().cast("double")))


@function("hash")
def hash_(scope, x):
    return Atom(F.when(x.column().isNotNull(), F.xxhash64(x.column())))


# what is known while the plan is made


FUNCTIONS["static_type"] = lambda scope, x: Atom(F.lit(scope.type(x).simpleString()))
FUNCTIONS["static_known_columns"] = lambda scope, x: Atom(F.lit(json.dumps([{"columnName": k, "valueInfo": scope.type(v).simpleString()} for k, v in x.leaves().items()] if isinstance(x, Row) else [])))
FUNCTIONS["static_expression_info"] = lambda scope, x: Atom(F.lit(json.dumps({"kind": type(x).__name__.lower(), "type": scope.type(x).simpleString()})))
FUNCTIONS["__isconst"] = lambda scope, x: Atom(F.lit(isinstance(x, Atom) and x.const is not None))
FUNCTIONS["_fail_memory_allocation"] = lambda scope: Atom(F.raise_error(F.lit("memory allocation failed on request")))


# of the scope


def _row_name(scope, e):
    return Atom(q(ROW) if ROW in scope.df.columns else F.lit("result"))


def _row_path(scope, e):
    return Emb(udfs.path_parts(_row_name(scope, e).col))


def _row_part(scope, e):
    n = scope.column(e.args[0]).cast("int")
    p = _row_path(scope, e).col
    return Atom(F.get(p, F.when(n < 0, F.size(p) + n).otherwise(n)))


def _side(name: str):
    return lambda scope, e: Atom(q(name) if name in scope.df.columns else F.lit(None))


def _try(scope, e):
    """Errors while a query is analysed give the alternative; expressions themselves are built so
    that bad values give nulls, which take it too."""
    other = scope.value(e.args[1]) if len(e.args) > 1 else None
    before, scope.trying = getattr(scope, "trying", False), True
    try:
        x = scope.value(e.args[0])
    except (QueryError, ValueError) as why:
        return other or Atom(F.lit(str(why)))
    finally:
        scope.trying = before
    if isinstance(x, Open):  # a row of open names: the alternative, if a value, stands under the name "error"
        return x if other is None or isinstance(other, Row) else Open(F.coalesce(x.col, F.create_map(F.lit("error"), other.column().cast("string"))))
    if other is None or not isinstance(x, Atom):
        return x
    cols = a.alike(scope, [x.column(), other.column()])
    return Atom(F.coalesce(*cols))


def _timestamp(scope, e):
    if scope.ts is None:
        return Atom(F.lit(None).cast("timestamp"))
    return Atom(scope.ts)


def _analyze(scope, e):
    return Atom(F.lit(json.dumps([x.text for x in e.args])))


def _jseval(scope, e):
    raise QueryError("no script engine: register a Python function with Engine.create_function")


def _sensor(scope, e):
    return scope.constant_value(scope.engine.sensors[const(scope.value(e.args[0]), "the sensor's name")]())


def _of_file(column: str, name: str):
    def value(scope, e):
        if column not in scope.df.columns:
            raise QueryError(f"{name}() is only known while a text file is read")
        return Atom(q(column))

    return value


SPECIAL: dict[str, Callable] = {
    "linenumber": _of_file("__line", "lineNumber"), "lineoffset": _of_file("__offset", "lineOffset"), "filetimestamp": _of_file("__modified", "fileTimestamp"), "datafileurl": _of_file("__url", "dataFileUrl"),
    "rowname": _row_name, "rowpath": _row_path, "rowpathelement": _row_part, "rowhash": lambda scope, e: Atom(F.xxhash64(_row_name(scope, e).col)),
    "columncount": lambda scope, e: horizontal_count(scope, scope.whole()),
    "leftrowname": _side("__left"), "rightrowname": _side("__right"), "leftrowpath": lambda scope, e: Emb(udfs.path_parts(_side("__left")(scope, e).col)), "rightrowpath": lambda scope, e: Emb(udfs.path_parts(_side("__right")(scope, e).col)),
    "value_timestamp": _timestamp, "try": _try, "_analyze_join": _analyze, "_remove_table_name": _analyze, "jseval": _jseval, "read_sensor": _sensor,
}
AGGREGATES_ONLY = frozenset("pivot string_agg earliest latest likelihood_ratio".split())
