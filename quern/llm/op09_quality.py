"""Quality classifier from weak labels.

Heuristic labellers look at a document and vote bad, good or nothing.  They
overlap and err, so expectation-maximisation estimates each labeller's rates and
the share of bad documents from how often each combination of votes occurs
[Dawid and Skene, 1979].  Combinations are counted over all documents; their
number is bounded by the number of labellers.  The posterior of its combination
labels a document, and such labels train a linear scorer over hashed features.

Toxicity has no shape that heuristics could see, so the second head of the
scorer learns it from labelled rows: words and their beginnings, hashed, kept
where they are much more frequent in toxic documents.

Two bounds, both parameters: the scorer is fitted on at most ``sample`` documents,
and its toxic head on at most ``labelled`` rows of ``labels``, chosen by hash.
Everything else covers every document.  Texts are read whole.  A null or empty
text has no votes and is scored as good; a null doc_id has no label and stays null.
Repeated rows count and are scored each, equal texts alike.  Rows of ``labels`` that
repeat a doc_id count as toxic if one of them says so.  Other columns don't matter,
whatever their names, and stay in ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_batches, stored

DIMS = 1 << 18
SAMPLE, LABELLED = 4096, 6000
SYMBOLS = set("%$#*&@^~+=<>\\{}[]")
PREFIXES = (4, 5, 6, 7)
STRIP = ".,;:!?\"'()%$#*&|"

#: Labellers: name of the measure, and the values from which it votes bad and up to which it
#: votes good (in between, nothing).
LABELLERS = (
    ("shouting", 0.5, 0.05),
    ("bangs", 0.3, 0.01),
    ("rules", 0.15, 0.01),
    ("symbols", 0.3, 0.02),
    ("stutter", 0.25, 0.05),
    ("sameness", 0.48, 0.36),
    ("unwordy", 0.3, 0.05),
    ("again", 0.6, 0.1),
)
LEAST_WORDS = 5
#: Labellers that say nothing of texts with fewer words than this.
FEW_WORDS, UNSURE = 40, frozenset(("sameness", "unwordy", "again"))


def measures(text: str) -> dict[str, float] | None:
    """Shares of a text that the labellers and the scorer look at; None if it has too few words."""
    words = text.split()
    n = len(words)
    if n < LEAST_WORDS:
        return None
    kinds = Counter(words)
    up = bang = rule = sym = odd = 0
    for w, k in kinds.items():
        c = w[-1]
        if len(w) > 1 and w.isupper():
            up += k
        if c == "!" and w.endswith("!!"):
            bang += k
        if c in SYMBOLS:
            sym += k
        if not w[0].isalnum():
            odd += k
            if w == "|":
                rule += k
    same = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    # distinct words fall with length by rule; what is left beside that is sameness
    expected = min(1.0, 1.6 * n**-0.1)
    return {
        "shouting": up / n,
        "bangs": bang / n,
        "rules": rule / n,
        "symbols": sym / n,
        "stutter": same / (n - 1),
        "sameness": max(0.0, 1 - len(kinds) / n / expected),
        "unwordy": (odd + sym) / n,
        "again": 1 - len(set(lines)) / len(lines),
        "words": n,
    }


def votes(m: dict[str, float] | None) -> tuple[int, ...]:
    """1 for bad, 0 for good, -1 for nothing, by labeller."""
    if m is None:
        return (-1,) * len(LABELLERS)
    few = m["words"] < FEW_WORDS
    return tuple(-1 if few and name in UNSURE else 1 if m[name] >= bad else 0 if m[name] <= good else -1 for name, bad, good in LABELLERS)


@dataclass
class WeakLabels:
    """Share of bad documents and, by labeller, the rates of its votes in either class; that a
    labeller says nothing tells nothing."""

    prior: float
    rates: np.ndarray  # labeller, class (good, bad), vote (good, bad)

    def posterior(self, pattern: tuple[int, ...]) -> float:
        log = np.log([1 - self.prior, self.prior])
        for j, v in enumerate(pattern):
            if v >= 0:
                log = log + np.log(self.rates[j, :, v])
        log -= log.max()
        p = np.exp(log)
        return float(p[1] / p.sum())


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 200) -> WeakLabels:
    """Expectation-maximisation over counted combinations of votes."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    if not len(patterns) or n.sum() == 0:
        return WeakLabels(0.1, np.full((len(LABELLERS), 2, 2), 1 / 2))
    v = np.array(patterns)
    # first guess: a document is bad if any labeller says so
    p = np.where((v == 1).any(1), 0.9, 0.02)
    model = None
    for _ in range(rounds):
        prior = float(np.clip((n * p).sum() / n.sum(), 1e-4, 0.9))
        rates = np.empty((v.shape[1], 2, 2))
        for j in range(v.shape[1]):
            for c, w in enumerate((n * (1 - p), n * p)):
                for k in (0, 1):
                    rates[j, c, k] = w[v[:, j] == k].sum() + 0.01
                rates[j, c] /= rates[j, c].sum()
        # a labeller is taken to do better than chance
        flip = rates[:, 1, 1] < rates[:, 0, 1]
        rates[flip, 1, 1], rates[flip, 0, 1] = rates[flip, 0, 1], rates[flip, 1, 1]
        rates /= rates.sum(2, keepdims=True)
        model = WeakLabels(prior, rates)
        new = np.array([model.posterior(tuple(x)) for x in v.tolist()])
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def _slot(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % DIMS


def shape_features(m: dict[str, float] | None) -> list[int]:
    """Hashed features of the measures, in steps, so that a linear scorer can bend."""
    if m is None:
        return [_slot("few words")]
    return [_slot(f"{name}>{step}") for name, _, _ in LABELLERS for step in (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9) if m[name] > step and (m["words"] >= FEW_WORDS or name not in UNSURE)]


def word_slots(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its beginnings of ``PREFIXES`` letters."""
    w = word.strip(STRIP)
    return (_slot("w:" + w), *(_slot("p:" + w[:k]) for k in PREFIXES if len(w) > k)) if w else ()


def logistic(index: np.ndarray, of: np.ndarray, y: np.ndarray, dims: int = DIMS, steps: int = 300, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for rows whose features are ``index`` where ``of`` names the row, by
    full-batch gradient steps with per-weight rates (AdaGrad)."""
    w, b = np.zeros(dims), 0.0
    if not len(y):
        return w, -20.0
    if y.min() == y.max():
        return w, 20.0 if y.max() > 0.5 else -20.0
    used, index = np.unique(index, return_inverse=True)
    x, g2, gb = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    # each class weighs the same
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    for _ in range(steps):
        z = b + np.bincount(of, x[index], len(y))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(index, e[of], len(used)) + l2 * x
        g2 += g * g
        x -= rate * g / np.sqrt(g2)
        gb += e.sum() ** 2
        b -= rate * e.sum() / np.sqrt(gb)
    w[used] = x
    return w, float(b)


@dataclass
class QualityModel:
    weak: WeakLabels
    shape: np.ndarray
    shape_bias: float
    toxic: np.ndarray
    toxic_bias: float

    def score(self, text: str | None, memo: dict[str, float]) -> tuple[float, float, tuple[int, ...]]:
        """Chance that the text is junk, chance that it is toxic, and the labellers' votes."""
        if not text:
            return 0.0, 0.0, votes(None)
        m = measures(text)
        z = self.shape_bias + sum(self.shape[s] for s in shape_features(m))
        t = self.toxic_bias
        for w in set(text.lower().split()):
            x = memo.get(w)
            if x is None:
                if len(memo) > 300_000:
                    memo.clear()
                x = memo[w] = float(sum(self.toxic[s] for s in word_slots(w)))
            t += x
        squash = lambda v: float(1 / (1 + np.exp(-np.clip(v, -30, 30))))
        return squash(z), squash(t), votes(m)


def _lists(found: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """A column of lists as flat values and the row of each, without a Python object for each value."""
    table = found.toArrow().combine_chunks()
    lists = table.column(column).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists), dtype=np.int32), sizes), table


def _candidates(known: DataFrame, n1: int, n0: int, ratio: float = 12.0) -> dict[int, float]:
    """Features at least ``ratio`` times as frequent in toxic rows as in others, with how telling
    they are.  Counted by Spark; only features of one toxic row in fifty or more come back."""
    least = max(3, round(0.02 * n1))
    each = known.select("y", F.explode(F.array_distinct("features")).alias("f"))
    counts = each.groupBy("f").agg(F.sum("y").alias("bad"), F.count("*").alias("all")).where(F.col("bad") >= least)
    odds = (F.col("bad") / max(1, n1)) / ((F.col("all") - F.col("bad") + 0.5) / max(1, n0))
    return {r["f"]: r["bad"] * math.log(r["odds"]) for r in counts.select("f", "bad", odds.alias("odds")).where(F.col("odds") >= ratio).collect()}


def _screen(values: np.ndarray, of: np.ndarray, y: np.ndarray, telling: dict[int, float], cover: int = 4) -> np.ndarray:
    """Of the candidates, the most telling first; one counts only by toxic rows that fewer than
    ``cover`` earlier ones explain, so what copies of a toxic text have in common besides its
    insults is left out."""
    least = max(3, round(0.02 * int(y.sum())))
    toxic = y[of] > 0.5
    covered, out = np.zeros(len(y), np.int64), []
    for f in sorted(telling, key=lambda f: (-telling[f], f)):
        rows = np.unique(of[toxic & (values == f)])
        if (covered[rows] < cover).sum() >= least:
            out.append(f)
            covered[rows] += 1
    return np.array(sorted(out), np.int64)


def fit(docs: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, labelled: int = LABELLED) -> QualityModel:
    """Fits both heads; reads all documents once, and takes to the driver the counts of vote
    combinations and the features of bounded samples."""
    spark = docs.sparkSession
    chosen: dict[int, int] = {}
    if labels is not None:
        rows = labels.select(F.col("doc_id").cast("long").alias("d"), F.col("toxic").cast("int").alias("t")).where("d is not null and t is not null")
        rows = rows.groupBy("d").agg(F.max("t").alias("t"))
        chosen = {r["d"]: int(r["t"] > 0) for r in rows.orderBy(F.xxhash64("d"), "d").limit(labelled).collect()}
    total = docs.count()
    cut = int(min(1.0, sample / max(1, total)) * (1 << 32))
    sent = spark.sparkContext.broadcast(chosen)

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        patterns: Counter = Counter()
        out: dict[str, list] = {k: [] for k in ("pattern", "n", "kind", "y", "features")}

        def put(pattern, n, kind, y, features):
            for k, v in zip(out, (pattern, n, kind, y, features), strict=True):
                out[k].append(v)

        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            m = measures(t) if t else None
            p = votes(m)
            patterns[p] += 1
            if m is not None and xxhash.xxh3_64_intdigest(str(d), 1) >> 32 < cut:
                put(list(p), 1, 1, 0, shape_features(m))
            if t and d in sent.value:
                put(list(p), 1, 2, sent.value[d], [s for w in set(t.lower().split()) for s in word_slots(w)])
        for p, n in patterns.items():
            put(list(p), n, 0, 0, [])
        return pa.RecordBatch.from_arrays([pa.array(out["pattern"], pa.list_(pa.int32())), pa.array(out["n"], pa.int64()), pa.array(out["kind"], pa.int32()), pa.array(out["y"], pa.int32()), pa.array(out["features"], pa.list_(pa.int32()))], names=list(out))

    seen = stored(map_batches(docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")), look, "pattern array<int>, n long, kind int, y int, features array<int>"), "quality-votes")
    weak = estimate({tuple(r["pattern"]): r["n"] for r in seen.where("kind = 0").groupBy("pattern").agg(F.sum("n").alias("n")).collect()})
    values, of, table = _lists(seen.where("kind = 1").orderBy(F.xxhash64("features"), "pattern").limit(2 * sample).select("pattern", "features"), "features")
    y = np.array([weak.posterior(tuple(p)) for p in table.column("pattern").to_pylist()])
    shape, shape_bias = logistic(values, of, y)
    known = seen.where("kind = 2")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if sum(n.values()) > 2 * labelled:  # rows that repeat labelled ids: what comes to the driver stays bounded
        known = stored(known.dropDuplicates(["y", "features"]).limit(2 * labelled), "quality-labelled")
        n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    telling = _candidates(known, n.get(1, 0), n.get(0, 0))
    some = spark.sparkContext.broadcast(np.array(sorted(telling), np.int64))

    def reduce(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        keep = np.isin(values, some.value)
        left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        offsets = np.r_[0, np.cumsum(left)].astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[keep].astype(np.int32)))], names=["y", "features"])

    values, of, table = _lists(map_batches(known.select("y", "features"), reduce, "y int, features array<int>"), "features")
    y = table.column("y").to_numpy().astype(float)
    strong = np.isin(values, _screen(values, of, y, telling))
    toxic, toxic_bias = logistic(values[strong], of[strong], y)
    return QualityModel(weak, shape.astype(np.float32), shape_bias, toxic.astype(np.float32), toxic_bias)


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", least: float = 0.5, least_toxic: float = 0.7) -> DataFrame:
    """One row per document: both chances, the votes' posterior, and whether it is kept: a document
    goes if its chance to be junk reaches ``least`` or that to be toxic ``least_toxic``.  The latter
    is higher since insults leave little doubt: on held-out rows it halves false alarms."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[str, float] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        got = [m.score(t, memo) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0),
            "p_junk": pa.array([round(a, 6) for a, _, _ in got], pa.float64()),
            "p_toxic": pa.array([round(b, 6) for _, b, _ in got], pa.float64()),
            "p_weak": pa.array([round(m.weak.posterior(v), 6) for _, _, v in got], pa.float64()),
            "keep": pa.array([a < least and b < least_toxic for a, b, _ in got], pa.bool_()),
        })

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), one, "doc_id long, p_junk double, p_toxic double, p_weak double, keep boolean")


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text", least: float = 0.5, least_toxic: float = 0.7) -> DataFrame:
    """The rows that are neither junk nor toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[str, float] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = (sent.value.score(t, memo) for t in batch.column(batch.schema.get_field_index(text)).to_pylist())
        return batch.filter(pa.array([a < least and b < least_toxic for a, b, _ in got], pa.bool_()))

    return map_batches(docs, one, T.StructType(docs.schema.fields))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
