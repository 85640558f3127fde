"""Benchmark decontamination.

Every benchmark item gets a 64-bit SimHash of its 5-word shingles, weighted by
count.  A document's windows of item size get theirs from running sums of
shingle bits, so a window costs two lookups.

The radius comes from the similarity looked for.  Multisets of equal size with
weighted similarity 0.8 have a cosine of 2 * 0.8 / 1.8, an angle of 0.1515 pi, so
9.7 of 64 bits differ on average, with a deviation of 2.9: a radius of 15 holds
97.8 % of pairs at the very limit and more of closer ones (a test measures it).
Fingerprints within 15 bits are within 3 in one of four blocks of 16 bits.  The
index has the items by size, block and value, under every value within 2 bits; a
window looks under the values within 1 bit of its own, so no fingerprint within
the radius is missed, and 4 % of pairs of random fingerprints meet.  What meets
is verified by the exact weighted similarity of shingles, the sum of smaller
counts over the sum of larger ones.

Only stretches around shingles that occur in some item are slid over, which
loses nothing: a similarity above 0 needs a common shingle.  Items with fewer
words than a shingle count as one shingle of all their words, and windows of
that many words are compared alike.

The benchmark is a set of evaluation items, small beside the corpus; it is sent
to the tasks in slices of a fixed number of items, one after another.  Documents
stay where they are: no shuffle.  Null or empty texts and items match nothing, nor
do items with a null id; a document with a null id matches as any other.
Repeated rows give repeated rows.  Other columns don't matter, whatever their
names, and stay in ``drop_contaminated``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_batches
from .shingles import shingle_hashes, words_of

K, RADIUS, BLOCKS, LEAST = 5, 15, 4, 0.8
BITS = 64 // BLOCKS
#: Items sent to the tasks at once; more are taken in slices of this many.
SLICE = 5_000
#: Shingles of a text, and windows, that are looked at together.
STRETCH, TOGETHER = 1 << 16, 1024


def simhash(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 bit sums to fingerprints; a bit is set where its sum is positive."""
    return np.packbits(sums > 0, axis=-1).view(">u8").astype(np.uint64).reshape(sums.shape[:-1])


def masks(bits: int) -> np.ndarray:
    """Values of a block with at most so many bits set."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(BITS), k)], np.uint64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 0.0


class Benchmark:
    """Fingerprints, block index and shingles of items (item_id, text)."""

    def __init__(self, items: Iterable[tuple[int, str | None]], k: int = K, least: float = LEAST):
        self.k, self.least = k, least
        self.ids, self.counts, self.prints, self.sizes = [], [], [], []
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, text in items:
            words = words_of(text)
            if not words or i is None:
                continue
            s = shingle_hashes(words, k)
            if len(words) < k:
                short[len(words)][int(s[0])].append(i)
                continue
            self.ids.append(i)
            self.counts.append(Counter(s.tolist()))
            self.prints.append(int(simhash(signs(s).sum(0))))
            self.sizes.append(len(s))
        self.short = {n: dict(x) for n, x in short.items()}
        self.shingles = np.unique(np.array([s for c in self.counts for s in c], np.uint64))
        self.windows = sorted(set(self.sizes))
        # for each block, (size, value) of all items and of all values within two bits, in order
        self.table = np.array(self.prints, np.uint64)
        size = np.searchsorted(self.windows, self.sizes).astype(np.int64)
        self.index = []
        for b in range(BLOCKS):
            values = self._part(self.table, b)[:, None] ^ masks(2)[None, :]
            keys = (size[:, None] << BITS) + values.astype(np.int64)
            order = np.argsort(keys, axis=None, kind="stable")
            self.index.append((keys.ravel()[order], (order // keys.shape[1]).astype(np.int32)))
        self.masks = masks(1)

    def _part(self, fingerprints: np.ndarray, block: int) -> np.ndarray:
        return (fingerprints >> np.uint64(block * BITS)) & np.uint64((1 << BITS) - 1)

    def met(self, fingerprints: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a fingerprint and an item of size w, as positions, that some block of the index brings together."""
        size = int(np.searchsorted(self.windows, w)) << BITS
        found = []
        for b, (keys, items) in enumerate(self.index):
            asked = size + (self._part(fingerprints, b)[:, None] ^ self.masks[None, :]).astype(np.int64).ravel()
            low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, side="right")
            n = high - low
            at = np.repeat(np.arange(len(asked)) // len(self.masks), n)
            place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            found.append(np.unique(at * len(self.table) + items[place]))
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.table)), pairs % max(1, len(self.table))

    def within(self, fingerprints: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a fingerprint and an item of size w within the radius, as positions."""
        parts = [(at + a, item) for a in range(0, len(fingerprints), TOGETHER) for at, item in [self.met(fingerprints[a : a + TOGETHER], w)]]
        at, item = (np.concatenate(x) for x in zip(*parts, strict=True))
        good = np.bitwise_count(fingerprints[at] ^ self.table[item]) <= RADIUS
        return at[good], item[good]

    def match(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, end word) of the best window of each item found."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}

        def take(i: int, sim: float, a: int, b: int) -> None:
            if i not in best or (sim, -a) > (best[i][0], -best[i][1]):
                best[i] = (sim, a, b)

        for n, of in self.short.items():
            for a in range(len(words) - n + 1):
                for i in of.get(int(shingle_hashes(words[a : a + n], self.k)[0]), ()):
                    take(i, 1.0, a, a + n)
        if len(words) >= self.k and len(self.shingles):
            s = shingle_hashes(words, self.k)
            at = np.searchsorted(self.shingles, s)
            at[at == len(self.shingles)] = 0
            hits = np.flatnonzero(self.shingles[at] == s)
            if len(hits):
                self._slide(s, hits, take)
        return sorted((i, *x) for i, x in best.items())

    def _slide(self, s: np.ndarray, hits: np.ndarray, take) -> None:
        widest = self.windows[-1]
        # stretches in which some window can hold a hit
        cut = np.flatnonzero(np.diff(hits) > widest)
        stretches = []
        for a, b in zip(hits[np.r_[0, cut + 1]].tolist(), hits[np.r_[cut, len(hits) - 1]].tolist(), strict=True):
            a, b = max(0, a - widest + 1), min(len(s), b + widest)
            # long ones in pieces that overlap by a window
            stretches += [(at, min(b, at + STRETCH + widest - 1)) for at in range(a, max(a + 1, b - widest + 1), STRETCH)]
        for a, b in stretches:
            inside = np.zeros(b - a, np.int64)
            inside[hits[(hits >= a) & (hits < b)] - a] = 1
            seen = np.r_[0, np.cumsum(inside)]
            part = s[a:b]
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(part), axis=0, dtype=np.int32)])
            for w in self.windows:
                n = min(w, b - a)  # a text shorter than the item is one window
                starts = np.arange(b - a - n + 1)
                # a similarity of `least` needs at least this many shingles in common
                starts = starts[seen[starts + n] - seen[starts] >= self.least * max(w, n) - 1e-9]
                if not len(starts):
                    continue
                at, items = self.within(simhash(sums[starts + n] - sums[starts]), w)
                for start, i in zip(starts[at].tolist(), items.tolist(), strict=True):
                    sim = weighted_similarity(Counter(part[start : start + n].tolist()), self.counts[i])
                    if sim >= self.least:
                        take(self.ids[i], sim, a + start, a + start + n + self.k - 1)


FOUND = "doc_id long, item_id long, similarity double, first_word long, end_word long"


def _slices(benchmark: DataFrame, key: str, text: str) -> Iterator[Benchmark]:
    """The items in slices of a bounded number, one at a time: no more is on the driver or sent to the tasks at once."""
    items = benchmark.select(F.col(key).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    parts = max(1, -(-items.count() // SLICE))
    for p in range(parts):
        yield Benchmark([tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).collect()])


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it, with the best window."""
    spark = docs.sparkSession
    out = None
    for bench in _slices(benchmark, item_key, item_text):
        sent = spark.sparkContext.broadcast(bench)

        def one(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in sent.value.match(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if j == 2 else pa.int64()) for j, c in enumerate(cols)], names=["doc_id", "item_id", "similarity", "first_word", "end_word"])

        found = map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), one, FOUND)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows in whose text no item is found, with all their columns."""
    spark, schema = docs.sparkSession, docs.schema
    for bench in _slices(benchmark, item_key, item_text):
        sent = spark.sparkContext.broadcast(bench)

        def one(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            return batch.filter(pa.array([not sent.value.match(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], pa.bool_()))

        docs = map_batches(docs, one, T.StructType(schema.fields))
    return docs


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
