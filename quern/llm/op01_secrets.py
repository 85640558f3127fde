"""Secret scans.

Three fixed patterns give the base spans.  Beside them, candidate strings (runs
of the base64/URL alphabet) are scanned, for each character class, with a sliding
window whose Shannon entropy is kept by incremental counts: each step adds one
character and removes one, and only the two changed terms n*log2(n) are updated.
A window counts as secret when its entropy reaches the class's threshold, the
expected entropy of as many random characters of its alphabet less a margin;
adjoining windows make one span.  Runs too short for the wide window get a narrow
one if they mix capitals, small letters and digits.

The allow-list suppresses spans, not candidates: what is left of a candidate
beside a UUID, a digest named as such, or an alphabet is scanned as any other.
Windows are suppressed whose parts between separators are all numbers or
word-like, that is letters without a run of five consonants.

Texts are scanned whole, each in the task that reads it: no shuffle, and memory
is that of one Arrow batch.  A null or empty text has no spans; a null doc_id stays
null.  Repeated rows give repeated rows, spans that begin together come in the
order of kinds; extra columns are ignored by the query and kept by ``redact`` and
``scan``, where one with the name of the result goes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_batches

# Fixed values of the contract: the patterns, their least lengths, and the order of base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_MIN, ACCESS_MIN = 8, 16
BASE = ("assign", "access", "hex")
WORDS = ("passw", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Window lengths for long runs and for short ones, and bits below the expected entropy that are enough.
WIDE, NARROW, MARGIN = 24, 16, 0.35
#: Character classes, narrow ones first: name, runs, size of the alphabet.
CLASSES = (
    ("hex", re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}"), 16),
    ("base32", re.compile(r"[A-Z2-7]{24,}"), 32),
    ("base36", re.compile(r"[a-z0-9]{24,}"), 36),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 64),
)
SHORT = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{16,23}(?![A-Za-z0-9])")
KINDS = (*BASE, *(f"entropy_{name}" for name, _, _ in CLASSES))


def _on(rest: str) -> str:
    """Matches as much of a run of neighbours as there is."""
    return f"(?:{rest[0]}{_on(rest[1:])})?" if rest else ""


#: Spans that look random but are public, or are made by rule; an alphabet is a run of eight neighbours.
ALLOW = re.compile(
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?i:md5[-_:=][0-9a-f]{32}|sha1[-_:=][0-9a-f]{40}|sha256[-_:=][0-9a-f]{64}|sha384[-_:=][0-9a-f]{96}|sha512[-_:=][0-9a-f]{128})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?:sha256-[A-Za-z0-9+/]{43}=|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86}==)(?![0-9A-Za-z+/=])"
    + "".join(f"|{x[i : i + 8]}{_on(x[i + 8 :])}" for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") for i in range(len(x) - 7))
)
SEPARATOR = re.compile(r"[-_/+=]+")
#: Letters that aren't word-like.
UNWORDY = re.compile(r"[b-df-hj-np-tv-xz]{5}", re.I)


def expected_entropy(size: int, width: int) -> float:
    """Mean entropy in bits of ``width`` random characters of an alphabet of ``size``."""
    p = 1 / size
    mean = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) * k * math.log2(k) for k in range(1, width + 1))
    return math.log2(width) - size * mean / width


def entropy_windows(text: str, least: float, width: int = WIDE) -> list[int]:
    """Starts of windows of ``width`` characters with at least ``least`` bits a character; found by
    incremental counts, in time linear in the text."""
    if len(text) < width:
        return []
    xlogx = [0.0] + [i * math.log2(i) for i in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    # entropy = log2(width) - total / width, so it reaches `least` when total is at most this
    most = (math.log2(width) - least) * width + 1e-9
    starts = []
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += xlogx[k + 1] - xlogx[k]
        if i >= width:
            d = text[i - width]
            k = counts[d]
            counts[d] = k - 1
            total += xlogx[k - 1] - xlogx[k]
        if i >= width - 1 and total <= most:
            starts.append(i - width + 1)
    return starts


def plain(window: str) -> bool:
    """Whether all parts between separators are numbers or word-like."""
    return all(x.isdigit() or x.isalpha() and not UNWORDY.search(x) for x in SEPARATOR.split(window) if x)


def spans_of(text: str, least: float, width: int) -> list[tuple[int, int]]:
    """Spans of text whose windows are random enough and not plain."""
    spans: list[tuple[int, int]] = []
    for a in entropy_windows(text, least, width):
        if not plain(text[a : a + width]):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], a + width)
            else:
                spans.append((a, a + width))
    return spans


LEAST = {name: expected_entropy(size, WIDE) - MARGIN for name, _, size in CLASSES}
LEAST_SHORT = expected_entropy(64, NARROW) - MARGIN


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of candidate strings by class; one within a span of a narrower class is left out."""
    out: list[tuple[int, int, str]] = []
    for m in CANDIDATE.finditer(text):
        # a name before a digest is no part of the candidate if a colon or the like follows it
        cuts, at = [], m.start()
        for x in ALLOW.finditer(text, max(0, m.start() - 7), m.end()):
            cuts.append((at, max(at, x.start())))
            at = max(at, x.end())
        for a, b in (*cuts, (at, m.end())):
            if b - a < NARROW:
                continue
            part = text[a:b]
            own: list[tuple[int, int, str]] = []
            for name, runs, _ in CLASSES:
                for r in runs.finditer(part):
                    found = [(a + r.start() + i, a + r.start() + j, f"entropy_{name}") for i, j in spans_of(r[0], LEAST[name], WIDE)]
                    own += [x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] for y in own)]
            for r in SHORT.finditer(part):
                own += [(a + r.start() + i, a + r.start() + j, "entropy_base64") for i, j in spans_of(r[0], LEAST_SHORT, NARROW) if not any(y[0] <= a + r.start() + i and a + r.start() + j <= y[1] for y in own)]
            out += own
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns; start and end are those of the whole match."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans by start, then by the order of ``KINDS``."""
    if not text:
        return []
    return sorted(base_spans(text) + entropy_spans(text), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def scan(df: DataFrame, text: str = "text", into: str = "secret_spans") -> DataFrame:
    """Adds a column of spans (start, end, kind) in code points.  Other columns stay as they are."""
    fields = [f for f in df.schema.fields if f.name != into]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"start": a, "end": b, "kind": k} for a, b, k in find_spans(t)] for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [pa.array(found, kind)], names=[f.name for f in fields] + [into])

    return map_batches(df.select([F.col(f"`{f.name}`") for f in fields]), one, T.StructType([*fields, T.StructField(into, SPAN)]))


def mask(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str | None:
    """The text with each union of spans replaced by the mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every secret masked; a text without one is unchanged.
    ``length`` names a column that holds the number of code points, kept true if present."""
    schema = df.schema
    n = schema.fieldNames().index(length) if length in schema.fieldNames() else None

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index(text)
        old = batch.column(i).to_pylist()
        found = [find_spans(t) for t in old]
        if not any(found):
            return batch
        new = [mask(t, s) for t, s in zip(old, found, strict=True)]
        columns = list(batch.columns)
        columns[i] = pa.array(new, batch.schema.field(i).type)
        if n is not None:
            was = columns[n].to_pylist()
            columns[n] = pa.array([len(t) if s else k for t, s, k in zip(new, found, was, strict=True)], batch.schema.field(n).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(df, one, schema)


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts by base kind, the digest of the base spans, and all spans."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for t in batch.column("text").to_pylist():
            spans = find_spans(t)
            base = [x for x in spans if x[2] in BASE]
            kinds = [x[2] for x in base]
            for k in BASE:
                rows[f"n_{k}"].append(kinds.count(k))
            rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows["spans"].append(joined(spans))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **rows})

    return map_batches(documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text"), one, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
