"""Nearest points by blocks: products of matrices in single precision, with a bound on their error, tell which pairs
may be near enough; only those are measured.  Memory is bounded by the blocks, whatever the number of points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Queries and points of a block, and pairs that are measured at once.
QUERIES, POINTS, PAIRS = 512, 4096, 1 << 16
#: The place of a neighbour that is not there.
NONE = np.iinfo(np.int64).max
NEAR, LARGE, NEVER = 0, 1, 2


def distances(p: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """From each row of ``p`` to that of ``v``."""
    with np.errstate(all="ignore"):
        if metric == "cosine":
            return 1 - (p * v).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((v * v).sum(1)))
        return np.sqrt(((p - v) ** 2).sum(1))


def kinds(x: np.ndarray, metric: str) -> np.ndarray:
    """NEAR rows go into products, LARGE ones would leave single precision, and NEVER is a distance a number."""
    top = np.abs(x).max(1, initial=0)
    if metric == "cosine":
        with np.errstate(all="ignore"):
            never = ~np.isfinite(top) | ((x * x).sum(1) == 0)
        return np.where(never, NEVER, np.where(top > 1e150, LARGE, NEAR))
    return np.where(np.isnan(top), NEVER, np.where(top > 1e15, LARGE, NEAR))


def flat(c: pa.Array) -> np.ndarray:
    """Rows of a list array as a matrix; missing components are NaN."""
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    n = len(c)
    values = c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = len(values) // n if n else 0
    if len(values) != n * width or n and (np.diff(c.offsets.to_numpy()) != width).any():
        raise ValueError("vectors of different lengths have no distance")
    return values.reshape(n, width)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, starts, members): equal rows as groups, so that copies are compared once."""
    if not len(x) or not x.shape[1]:
        return np.arange(min(1, len(x))), np.array([0, len(x)][: 1 + bool(len(x))]), np.arange(len(x))
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, group, size = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    return first, np.r_[0, np.cumsum(size)], np.argsort(group.ravel(), kind="stable")


class Search:
    """The ``k`` nearest to each of many queries, of points that come in slices; of equally near ones those that
    came first.  ``far`` are their distances and ``at`` the numbers of the points, by nearness."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.v, self.k, self.metric, self.seen = queries, k, metric, 0
        self.far, self.at = np.full((len(queries), k), np.nan), np.full((len(queries), k), NONE)
        self.ids, self.keys = np.array([], np.int64), None
        of = kinds(queries, metric)
        self.near, self.large, self.never = (np.flatnonzero(of == kind) for kind in (NEAR, LARGE, NEVER))
        y = self._unit(queries[self.near])
        self.centre = y.mean(0) if len(y) else np.zeros(queries.shape[1])
        y = (y - self.centre).astype(np.float32)
        self.norms = (y.astype(float) ** 2).sum(1)
        self.y = np.c_[-2 * y, np.ones(len(y), np.float32)]

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(1, keepdims=True)) if self.metric == "cosine" else x

    def add(self, points: np.ndarray, starts: np.ndarray, members: np.ndarray, keys: pa.Array) -> None:
        """A slice: different points, and for each group of copies where they stand among ``keys``, in order."""
        n = len(keys)
        if not n or not self.k or not len(self.v):
            return
        if points.shape[1] != self.v.shape[1]:
            raise ValueError("vectors of different lengths have no distance")
        size = np.minimum(np.diff(starts), self.k)
        of = kinds(points, self.metric)

        def measure(qi: np.ndarray, gj: np.ndarray) -> None:
            for i in range(0, len(qi), PAIRS):
                a, g = qi[i : i + PAIRS], gj[i : i + PAIRS]
                d = distances(points[g], self.v[a], self.metric)
                # the first k of a group of copies will do
                for j in range(0, len(g), max(1, PAIRS // self.k)):
                    h = g[j : j + max(1, PAIRS // self.k)]
                    times = size[h]
                    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    self._merge(np.repeat(a[j : j + len(h)], times), np.repeat(d[j : j + len(h)], times), self.seen + members[np.repeat(starts[h], times) + within])

        def every(qs: np.ndarray, gs: np.ndarray) -> None:
            for i in range(0, len(qs), QUERIES):
                for j in range(0, len(gs), POINTS):
                    a, g = qs[i : i + QUERIES], gs[j : j + POINTS]
                    measure(np.repeat(a, len(g)), np.tile(g, len(a)))

        every(self.large, np.flatnonzero(of != NEVER))
        every(self.near, np.flatnonzero(of == LARGE))
        # no number compares: of these the first that came
        last = np.sort(np.concatenate([members[starts[g] : starts[g] + size[g]] for g in np.flatnonzero(of == NEVER)] or [np.array([], np.int64)]))[: self.k]
        for qs, at in ((np.r_[self.near, self.large], last), (self.never, np.arange(min(n, self.k)))):
            for i in range(0, len(qs) if len(at) else 0, QUERIES):
                a = qs[i : i + QUERIES]
                self._merge(np.repeat(a, len(at)), np.full(len(a) * len(at), np.nan), self.seen + np.tile(at, len(a)))
        groups = np.flatnonzero(of == NEAR)
        for j in range(0, len(groups) if len(self.near) else 0, POINTS):
            g = groups[j : j + POINTS]
            self._block(g, points[g], measure)
        self.seen += n
        self._keep(keys)

    def _block(self, g: np.ndarray, points: np.ndarray, measure) -> None:
        x = (self._unit(points) - self.centre).astype(np.float32)
        norms = (x.astype(float) ** 2).sum(1)
        x = np.ascontiguousarray(np.c_[x, norms.astype(np.float32)].T)
        for i in range(0, len(self.near), QUERIES):
            qs, own = self.near[i : i + QUERIES], self.norms[i : i + QUERIES]
            s = self.y[i : i + QUERIES] @ x  # the square of the distance without the query's own norm
            error = (len(x) + 16) * 2.0**-22 * (norms.max() + own) + (1e-12 if self.metric == "cosine" else 1e-30)  # cosines are measured to about 1e-15
            worst = self.far[qs, -1]
            most = (2 * worst if self.metric == "cosine" else worst * worst) * (1 + 1e-9) - own + error
            short = np.flatnonzero(np.isnan(worst))
            if len(short):
                most[short] = np.partition(s[short], self.k - 1, axis=1)[:, self.k - 1] + 2 * error[short] if len(g) >= self.k else np.inf
            with np.errstate(over="ignore"):  # infinite: all
                most = np.nextafter(most.astype(np.float32), np.float32(np.inf))
            hit = np.flatnonzero(s <= most[:, None])
            if len(hit):
                measure(qs[hit // len(g)], g[hit % len(g)])

    def _merge(self, qi: np.ndarray, d: np.ndarray, at: np.ndarray) -> None:
        rows = np.unique(qi)
        qi, d, at = np.r_[np.repeat(rows, self.k), qi], np.r_[self.far[rows].ravel(), d], np.r_[self.at[rows].ravel(), at]
        order = np.lexsort((at, d, qi))
        first = np.searchsorted(qi[order], rows)
        best = order[first[:, None] + np.arange(self.k)]
        self.far[rows], self.at[rows] = d[best], at[best]

    def _keep(self, keys: pa.Array) -> None:
        """Keeps the keys of those that are still among the nearest."""
        ids = np.unique(self.at[self.at != NONE])
        begun = self.seen - len(keys)
        old, new = ids[ids < begun], ids[ids >= begun]
        parts = [self.keys.take(pa.array(np.searchsorted(self.ids, old)))] if len(old) else []
        self.ids, self.keys = ids, pa.concat_arrays([*parts, keys.take(pa.array(new - begun))])

    def found(self) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
        """(query, distance, key) by query and nearness."""
        qi, rank = np.nonzero(self.at != NONE)
        at = self.at[qi, rank]
        return qi, self.far[qi, rank], self.keys.take(pa.array(np.searchsorted(self.ids, at))) if len(at) else None
