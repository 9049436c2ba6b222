"""Strings of a minimum length that occur twice, found by expanding intervals of a Burrows-Wheeler transform.

Breadth-first backward extension: from the interval of the empty string, the interval of
each string w is extended by every symbol c that precedes it. The extended interval's right
border gets the common-prefix value |w| unless it has a smaller one already; only intervals
that set a border are extended further. Values so come by increasing length, and the search
stops at the minimum length: a border without a value then separates two suffixes that
share at least that many symbols.
"""

from __future__ import annotations

import numpy as np

UNSET = np.uint16(65535)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by prefix doubling; symbols are below 511, their number below 2**31."""
    n = len(symbols)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = symbols + 1  # the end comes before every symbol
    key = np.zeros(n, np.uint64)
    for i in range(7):  # seven symbols of nine bits
        key = (key << np.uint64(9)) | padded[i : i + n]
    sa = np.argsort(key, kind="stable").astype(np.int32)
    start = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]])
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    h = 7
    tied = _tied(start)
    while len(tied):
        own = sa[tied]
        after = own + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key2 = rank[own].astype(np.int64) * (n + 1) + second
        order = np.argsort(key2, kind="stable")
        own, key2 = own[order], key2[order]
        sa[tied] = own
        begins = np.concatenate([[True], key2[1:] != key2[:-1]])
        start[tied] = begins
        rank[own] = np.maximum.accumulate(np.where(begins, tied, 0))
        tied = tied[_tied(begins)]
        h *= 2
    return sa, rank


def _tied(start: np.ndarray) -> np.ndarray:
    """Rows whose group, of those that begin at start, has another row."""
    alone = start & np.concatenate([start[1:], [True]])
    return np.flatnonzero(~alone).astype(np.int32)


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Common-prefix values below ``length`` of neighbours in the suffix array; UNSET where they share that much.

    Symbol 0 separates strings: it is extended to from the empty string alone, so values
    across separators aren't followed.
    """
    n = len(sa)
    lcp = np.full(n + 1, UNSET, np.uint16)
    lcp[0] = lcp[n] = 0
    first = symbols[sa]
    lf = rank[sa - 1]  # the row of the suffix one longer; the whole text's wraps round to a separator
    bwt = symbols[sa - 1]
    psi = np.empty(n, np.int32)
    psi[lf] = np.arange(n, dtype=np.int32)
    following = np.full(n, n, np.int32)
    same = np.flatnonzero(first[1:] == first[:-1])
    following[psi[same]] = psi[same + 1]
    block = np.searchsorted(first, np.arange(int(first[-1]) + 2))
    lb, rb = np.array([0]), np.array([n - 1])
    for value in range(length):
        size = rb - lb + 1
        rows = np.repeat(lb - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        end = np.repeat(rb, size)
        last = following[rows] > end  # the last row of its symbol in the interval
        if value:
            last &= bwt[rows] != 0
        border = lf[rows[last]]
        new = lcp[border + 1] == UNSET
        border = border[new]
        if not len(border):
            break
        interval = np.repeat(np.arange(len(lb)), size)[last][new]
        border, at = np.unique(border, return_index=True)
        interval = interval[at]
        lcp[border + 1] = value
        # The extended interval begins at the first row of that symbol whose source lies in the interval.
        lo = np.maximum(border - size[interval] + 1, block[first[border]])
        hi, least = border.copy(), lb[interval]
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            inside = psi[mid] >= least
            hi = np.where(open_ & inside, mid, hi)
            lo = np.where(open_ & ~inside, mid + 1, lo)
        lb, rb = lo, border
    return lcp


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, where a string of ``length`` bytes starts that also starts elsewhere in the texts."""
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int((sizes + 1).sum()), np.uint16)
    for t, b in zip(texts, begins):
        symbols[b : b + len(t)] = np.frombuffer(t, np.uint8).astype(np.uint16) + 1
    sa, rank = suffix_array(symbols)
    lcp = common_prefixes(symbols, sa, rank, length)
    shared = (lcp[:-1] == UNSET) | (lcp[1:] == UNSET)
    marked = np.zeros(len(symbols), bool)
    marked[sa[shared]] = True
    return [np.flatnonzero(marked[b : b + max(0, s - length + 1)]) for b, s in zip(begins, sizes)]
