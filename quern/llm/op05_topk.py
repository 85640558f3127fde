"""Exact top-k inner-product search by pivot-table elimination.

Vectors become integers, floor(1024 * x).  Pivots, far apart from each other, are
chosen once from a bounded sample, and a table of the distances from every vector
to all pivots is stored beside the vectors.  For a query q the triangle
inequality gives d(q, x) >= max over p of |d(q, p) - d(x, p)|, and since
2 q.x = |q|^2 + |x|^2 - d(q, x)^2, with each vector's own norm, an upper bound on
its score; |q| |x| is another.  Taken together the distances to all pivots say
more: they tell where q and x lie in the span of the pivots and how far from it, so
d(q, x) is least if both lie on the same side of the span.  That is the greatest
lower bound that the table holds.

The best scores of a query in the sample give a score that the k-th best can't
fall below; it goes to all tasks with the query.  There the first pivots one by one
and then all together sort out rows; the rest is evaluated in the order of bounds
until the next one is below the k-th best so far.  With clusters few rows are
left; random vectors of 64 components leave 4 % to 48 pivots together, and all of
them to each alone.  Equal bounds are evaluated, so ties
are exact.  Scores are integers, computed in floats only where they are exact.

Queries come in blocks of bounded size, each sent to all tasks; candidates stay
where they are, and only k rows a query leave a task.  Vectors that are null or
hold null or non-finite components take no part, nor do rows with a null id.
Rows with the query's id are no candidates of it; other repeated rows count each.
Vectors of another length than the query's are no candidates; extra columns don't
matter, whatever their names.  Scores beyond 63 bits are cut to that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, stored

SCALE = 1024
EXACT = 2.0**52
LONG = 2**63 - 1
#: Rows of the sample, pivots, pivots that are looked at first, and queries in a block.
SAMPLE, PIVOTS, FIRST, BLOCK = 4096, 48, 8, 8192


def quantise(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, dim, v array<double>, n2): the integer vectors, held as doubles, and their squared norms."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, v = batch.column(0), batch.column(1)
        size = pc.fill_null(pc.list_value_length(v), 0).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # nulls are NaN
            n2 = np.bincount(row, flat * flat, len(size))
        keep = ids.is_valid().to_numpy(zero_copy_only=False) & v.is_valid().to_numpy(zero_copy_only=False)
        keep &= np.bincount(row, ~np.isfinite(flat), len(size)) == 0
        if not keep.any():
            return None
        offsets = np.r_[0, np.cumsum(size[keep])].astype(np.int32)
        return pa.RecordBatch.from_pydict({"id": ids.filter(pa.array(keep)), "dim": pa.array(size[keep].astype(np.int32)), "v": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[keep[row]])), "n2": pa.array(n2[keep])})

    return map_batches(df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), one, "id long, dim int, v array<double>, n2 double")


def scores_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with q, as int64."""
    most = (np.abs(x).max(initial=0) or 1) * (np.abs(q).max(initial=0) or 1) * max(1, len(q))
    if most < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(t) for t in q]
    return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(r, whole, strict=True)))) for r in x], np.int64)


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows, each the farthest from those before.  Rows of more than eight times the usual norm are
    passed over, since distances to them tell little of others."""
    if not len(x):
        return x
    n2 = (x * x).sum(1)
    x = x[n2 <= 64 * max(1.0, float(np.median(n2)))]
    at = [int((x * x).sum(1).argmax())]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < n and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


class PivotTable:
    """Distances to the pivots; bounds scores from above.  The slack covers rounding, so that no bound is too low."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.n2 = pivots, (pivots * pivots).sum(1)
        size = np.sqrt(self.n2)[:, None]
        u, s, _ = np.linalg.svd(np.divide(pivots, size, out=np.zeros_like(pivots), where=size > 0), full_matrices=False)
        keep = s > 1e-3 * s.max(initial=0)
        # from inner products with pivots to coordinates in their span
        self.span = np.divide(1, size, out=np.zeros_like(size), where=size > 0) * (u[:, keep] / s[keep])
        self.error = 1e-14 * float(np.sqrt((self.span * self.span).sum()))

    def rows(self, x: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(n2[:, None] + self.n2[None, :] - 2 * (x @ self.pivots.T), 0))

    def query(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(q @ q + self.n2 - 2 * (self.pivots @ q), 0))

    def within(self, table: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, ...]:
        """Coordinates in the span of the pivots, how far off they may be by rounding, their norm with that, and an
        upper bound on the distance from the span."""
        at = ((n2[:, None] + self.n2[None, :] - table * table) / 2) @ self.span
        error = self.error * (n2 + self.n2.max(initial=0))
        a2 = (at * at).sum(1)
        norm = np.sqrt(a2) + error
        return at, error, norm, np.sqrt(np.maximum(n2 - a2, 0) + 2 * norm * error)

    @staticmethod
    def alone(table: np.ndarray, n2: np.ndarray, of_q: np.ndarray, q2: float) -> np.ndarray:
        """An upper bound on the score of each row, from each column of the table by itself."""
        low = np.abs(table - of_q).max(1, initial=0)
        return np.minimum((q2 + n2 - low * low) / 2, np.sqrt(q2) * np.sqrt(n2)) + 1 + 1e-6 * (q2 + n2)

    @staticmethod
    def together(at: np.ndarray, error: np.ndarray, norm: np.ndarray, off: np.ndarray, n2: np.ndarray, asked: Query) -> np.ndarray:
        """The same from all columns together."""
        return at @ asked.at + error * asked.norm + asked.error * norm + off * asked.off + 1 + 1e-9 * (asked.q2 + n2)


class Rows:
    """Vectors of one length with their part of the table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n2: np.ndarray, table: np.ndarray, pivots: PivotTable):
        self.ids, self.x, self.n2, self.table = ids, x, n2, table
        self.span = *pivots.within(table, n2), n2


class Query:
    """A query with its distances, and a score that the k-th best of all rows does not fall below."""

    def __init__(self, name: int, q: np.ndarray, pivots: PivotTable, least: float = -np.inf):
        self.name, self.q, self.least = name, q, least
        self.q2 = float(q @ q)
        self.far = pivots.query(q)
        self.at, self.error, self.norm, self.off = (x[0] for x in pivots.within(self.far[None, :], np.array([self.q2])))


def search_block(rows: Rows, asked: Query, k: int, best: list[tuple[int, int]], step: int = 256) -> tuple[list[tuple[int, int]], int]:
    """The k best (-score, id) of the block and of ``best``, and how many rows were evaluated."""
    least = max(asked.least, -best[-1][0]) if len(best) == k else asked.least
    left = np.flatnonzero(PivotTable.alone(rows.table[:, :FIRST], rows.n2, asked.far[:FIRST], asked.q2) >= least)
    bounds = PivotTable.together(*(x[left] for x in rows.span), asked)
    left, bounds = left[bounds >= least], bounds[bounds >= least]
    order = np.argsort(-bounds, kind="stable")
    at = 0
    while at < len(order):
        if len(best) == k:
            least = max(least, -best[-1][0])
        if bounds[order[at]] < least:
            break  # every candidate left is bounded below the k-th score
        take = left[order[at : at + step]]
        s = scores_of(rows.x[take], asked.q)
        own = rows.ids[take]
        good = (own != asked.name) & (s >= least)
        s, own = s[good], own[good]
        first = np.lexsort((own, -s))[:k]
        best = sorted([*best, *zip((-s[first]).tolist(), own[first].tolist(), strict=True)])[:k]
        at += step
    return best, min(at, len(order))


def least_scores(ids: np.ndarray, x: np.ndarray, queries: list[tuple[int, np.ndarray]], k: int) -> list[float]:
    """For each query the k-th best score of the sample: that of all rows is no less."""
    out = []
    for q_id, q in queries:
        s = scores_of(x, q)[ids != q_id]
        out.append(float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else -np.inf)
    return out


def _matrix(batch: pa.RecordBatch, column: str, rows: np.ndarray, width: int) -> np.ndarray:
    flat, offsets = batch.column(column).values.to_numpy(), batch.column(column).offsets.to_numpy()
    return flat[(offsets[rows][:, None] + np.arange(width)).ravel()].reshape(len(rows), width)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` against ``vectors``, both from ``quantise``.
    Of queries that repeat an id the one with the smallest vector is answered."""
    spark = vectors.sparkSession
    queries = stored(queries.groupBy("id").agg(F.min(F.struct("v", "dim")).alias("q")).select("id", "q.*"), "topk-queries")
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "dim", "v").collect()  # as many as the parameter says
    samples: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["dim"] for r in some}:
        own = [r for r in some if r["dim"] == d]
        samples[d] = np.array([r["id"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64).reshape(len(own), d)
    by_dim = {d: PivotTable(far_apart(x, pivots)) for d, (_, x) in samples.items()}

    def of(d: int) -> PivotTable:
        return by_dim.get(d) or PivotTable(np.empty((0, d)))

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, n2 = batch.column("dim").to_numpy(), batch.column("n2").to_numpy()
        far: list = [None] * len(dims)
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            for i, r in zip(rows.tolist(), of(d).rows(_matrix(batch, "v", rows, d), n2[rows]), strict=True):
                far[i] = r
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.list_(pa.float64()))], names=[*batch.schema.names, "far"])

    indexed = stored(map_batches(vectors.select("id", "dim", "v", "n2"), index, "id long, dim int, v array<double>, n2 double, far array<double>"), "topk-index")
    blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(blocks):
        # about `block` queries, whatever the number of vectors; sent to every task
        rows = [(r["id"], r["dim"], np.array(r["v"], np.float64)) for r in queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "dim", "v").collect()]
        asked: dict[int, list[Query]] = {}
        for d in {d for _, d, _ in rows}:
            own = [(i, q) for i, e, q in rows if e == d]
            ids, x = samples.get(d, (np.empty(0, np.int64), np.empty((0, d))))
            asked[d] = [Query(i, q, of(d), t) for (i, q), t in zip(own, least_scores(ids, x, own, k), strict=True)]
        sent = spark.sparkContext.broadcast(asked)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[int, int]]] = {}
            for batch in batches:
                ids, dims, n2 = (batch.column(c).to_numpy() for c in ("id", "dim", "n2"))
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    block = Rows(ids[at], _matrix(batch, "v", at, d), n2[at], _matrix(batch, "far", at, len(of(d).pivots)), of(d))
                    for q in sent.value.get(d, ()):
                        best[q.name], _ = search_block(block, q, k, best.get(q.name, []))
            out = [(q, i, -s) for q, found in best.items() for s, i in found]
            if out:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

        part = stored(indexed.mapInArrow(search, "query_id long, vec_id long, score long"), "topk-part")
        found = part if found is None else found.union(part)
    discard(indexed, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "topk-vectors")
    return top_k(vectors, vectors.where("id % 100 = 0"))


TOPK_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE}::double * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score
  from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id
)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
) where rank <= 10
"""
