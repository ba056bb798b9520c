"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's rule, in numpy."""

from __future__ import annotations

import numpy as np

#: The first sort is by as many symbols of so many bits as fit into a number.
_BITS = 9
_FIRST = 63 // _BITS


def _packed(symbols: np.ndarray) -> np.ndarray:
    """The first _FIRST symbols of every suffix as a number; the first one alone where symbols are large."""
    if not _small(symbols):
        return symbols.astype(np.int64) + 1
    key = np.zeros(len(symbols), np.int64)
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(_FIRST, np.int64)])
    for j in range(_FIRST):
        key = key << _BITS | padded[j : j + len(symbols)]
    return key


def _small(symbols: np.ndarray) -> bool:
    return not len(symbols) or int(symbols.max()) < (1 << _BITS) - 1


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes in order of their first `depth` symbols (all, if None). Symbols are not negative; below 511 seven are sorted at once.

    Refinement sorts groups that are still equal by the rank of what follows, doubling what is compared.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    key = _packed(symbols)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(n + 1, bool)
    head[1:n] = key[1:] != key[:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    h = _FIRST if _small(symbols) else 1
    while h < (depth or n):
        at = np.flatnonzero(~(head[:n] & head[1:]))
        if not len(at):
            break
        start = order[at]
        key = rank[start] << 32 | rank[np.minimum(start + h, n)] + 1
        by = np.argsort(key, kind="stable")
        key, start = key[by], start[by]
        order[at] = start
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[at] = fresh
        rank[start] = np.maximum.accumulate(np.where(fresh, at, 0))
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, cap: int, stripes: int = 4096, full: bool = False) -> np.ndarray:
    """lcp[i]: symbols that suffixes order[i - 1] and order[i] have in common, at most cap; lcp[0] is 0.

    Kasai's rule (a suffix shares at least one symbol less than the one before it in the text) runs down
    many stripes of the text at once. It carries on from a pair that differs within the depth of the sort.
    Unless `full` says that the order is that of whole suffixes, the depth may end at cap: suffixes that
    agree so far are then in any order, and nothing is known of those that follow them.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    step = _FIRST if _small(symbols) else 1
    key = np.concatenate([_packed(symbols), np.zeros(cap + _FIRST + 1, np.int64)])
    text = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(cap + _FIRST + 1, np.int64)])
    shared = np.zeros(n, np.int64)
    width = -(-n // stripes)
    base = np.arange(0, n, width)
    h = np.zeros(len(base), np.int64)
    for t in range(width):
        here = base + t
        live = here < n
        i, a = here[live], np.maximum(h[live] - 1, 0)
        j = before[i]
        a[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (a < cap))
        while len(go):
            go = go[key[i[go] + a[go]] == key[j[go] + a[go]]]
            a[go] += step
            go = go[a[go] < cap]
        go = np.flatnonzero((j >= 0) & (a < cap))
        while len(go):
            x, y = text[i[go] + a[go]], text[j[go] + a[go]]
            go = go[(x == y) & (x > 0)]
            a[go] += 1
            go = go[a[go] < cap]
        # What ends the text is equal to nothing.
        a = np.minimum(a, np.minimum(cap, n - np.maximum(i, j)))
        shared[i] = a
        h[live] = a if full else np.where(a < cap, a, 0)
    return shared[order]
