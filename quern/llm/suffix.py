"""Suffix arrays by induced sorting and permuted common prefixes.

Suffixes are classified, the leftmost-smaller substrings sorted and named, the string of names sorted
in the same way, and the array induced from that order [Nong, Zhang, Chan, "Linear Suffix Array
Construction by Almost Pure Induced-Sorting", 2009].
"""

from __future__ import annotations

from array import array

import numpy as np

#: Symbols up to which buckets are swept as whole arrays.
SWEPT = 1024


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol must be the only least one."""
    n = len(t)
    out = np.empty(n, bool)
    out[-1] = True
    if n > 1:
        change = t[:-1] != t[1:]
        # the next position at which neighbours differ decides for a run of equal symbols
        at = np.where(change, np.arange(n - 1), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[:-1] = t[at] < t[at + 1]
    return out


def _place(sa: np.ndarray, pos: np.ndarray, symbol: np.ndarray, at: np.ndarray, step: int) -> None:
    """Appends positions to the buckets of their symbols in order, from the front or the back."""
    order = np.argsort(symbol, kind="stable")
    s = symbol[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    sizes = np.diff(np.r_[first, len(s)])
    within = np.arange(len(s)) - np.repeat(first, sizes)
    sa[at[s] + step * within] = pos[order]
    at[s[first]] += step * sizes


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix order that the order of the leftmost-smaller suffixes ``lms`` implies.

    ``starts`` has the first place of each symbol's bucket and the end.  Buckets are swept in order;
    within one, positions that its own positions bring in are taken in rounds, one for each repeat
    of the symbol, so every position is handled once.
    """
    n = len(t)
    sa = np.full(n, -1, np.int64)
    symbols = len(starts) - 1
    low, high = starts[:-1].copy(), starts[1:] - 1
    # larger ones, from the front of buckets
    groups = np.searchsorted(t[lms] if len(lms) else np.empty(0, t.dtype), np.arange(symbols + 1))
    for c in range(symbols):
        a = starts[c]
        while a < low[c]:
            b = low[c]
            pre = sa[a:b] - 1
            pre = pre[pre >= 0]
            pre = pre[~is_s[pre]]
            if len(pre):
                _place(sa, pre, t[pre], low, 1)
            a = b
        pre = lms[groups[c] : groups[c + 1]] - 1
        pre = pre[pre >= 0]
        if len(pre):
            _place(sa, pre, t[pre], low, 1)
    # smaller ones, from the back; the larger ones stand already
    for c in range(symbols - 1, -1, -1):
        a = starts[c + 1] - 1
        while a > high[c]:
            b = high[c]
            pre = sa[b + 1 : a + 1][::-1] - 1
            pre = pre[pre >= 0]
            pre = pre[is_s[pre]]
            if len(pre):
                _place(sa, pre, t[pre], high, -1)
            a = b
        pre = sa[starts[c] : low[c]][::-1] - 1
        pre = pre[pre >= 0]
        pre = pre[is_s[pre]]
        if len(pre):
            _place(sa, pre, t[pre], high, -1)
    sa[0] = n - 1
    return sa


def _same_pieces(t: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether pieces of t at a and b are equal."""
    same = size_a == size_b
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        ok = t[a[live] + k] == t[b[live] + k]
        same[live[~ok]] = False
        live = live[ok]
        k += 1
        live = live[size_a[live] > k]
    return same


def induce_wide(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """As ``induce``, for alphabets too large to sweep by buckets: the array is scanned place by place.
    ``lms`` may be in any order within a symbol."""
    n = len(t)
    symbol, smaller = array("i", t.astype(np.int32).tobytes()), is_s.astype(np.uint8).tobytes()
    low, high = array("i", starts[:-1].astype(np.int32).tobytes()), array("i", starts[1:].astype(np.int32).tobytes())
    sa = array("i", b"\xff" * (4 * n))
    for p in reversed(lms.tolist()):
        c = symbol[p]
        high[c] -= 1
        sa[high[c]] = p
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not smaller[p]:
            c = symbol[p]
            sa[low[c]] = p
            low[c] += 1
    high = array("i", starts[1:].astype(np.int32).tobytes())
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and smaller[p]:
            c = symbol[p]
            high[c] -= 1
            sa[high[c]] = p
    return np.frombuffer(sa, np.int32).astype(np.int64)


def _array_of(t: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of t, whose last symbol is its only 0 and whose symbols are below ``symbols``.
    Each call sorts at most half as many suffixes as the one before, so all take linear time."""
    starts = np.r_[0, np.cumsum(np.bincount(t, minlength=symbols))]
    step = induce if symbols <= SWEPT else induce_wide
    is_s = s_types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sa = step(t, is_s, lms[np.argsort(t[lms], kind="stable")], starts)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    pieces = sa[is_lms[sa]]  # sorted by their piece up to the next such position
    nxt = np.zeros(len(t), np.int64)
    nxt[lms] = np.r_[lms[1:], len(t) - 1]
    size = nxt[pieces] - pieces + 1
    fresh = np.r_[True, ~_same_pieces(t, pieces[:-1], pieces[1:], size[:-1], size[1:])]
    name = np.empty(len(t), np.int64)
    name[pieces] = np.cumsum(fresh) - 1
    names = name[lms]
    # the end mark is such a position, the least and by itself: names end as texts do
    order = np.argsort(names) if fresh.all() else _array_of(names, int(names.max()) + 1)
    return step(t, is_s, lms[order], starts)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of small non-negative integers, an end mark below all others implied."""
    if not len(text):
        return np.empty(0, np.int64)
    t = np.r_[text.astype(np.int64) + 1, 0].astype(np.uint16 if text.max() < 60_000 else np.int64)
    return _array_of(t, int(t.max()) + 1)[1:]


def permuted_prefixes(text: bytes, sa: np.ndarray, least: int) -> np.ndarray:
    """For each position, in text order, whether the suffix before it in the array has its first
    ``least`` symbols in common with it; compared eight symbols at a time."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = text + bytes(8)
    word = np.ndarray((n,), "<u8", padded, strides=(1,))
    same = (before >= 0) & (np.arange(n) + least <= n) & (before + least <= n)
    live = np.flatnonzero(same)
    for k in range(0, least, 8):
        k = min(k, max(0, least - 8))
        if least < 8:
            ok = (word[live] ^ word[before[live]]) & np.uint64((1 << (8 * least)) - 1) == 0
        else:
            ok = word[live + k] == word[before[live] + k]
        same[live[~ok]] = False
        live = live[ok]
    return same
