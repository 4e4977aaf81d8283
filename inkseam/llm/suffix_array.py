r"""Suffix arrays by induced sorting, and permuted common prefixes.

Texts with a narrow alphabet (bytes) are induced bucket by bucket with numpy; reduced texts, whose alphabet is as wide as
they have different leftmost-S substrings, sign by sign, as most of their buckets hold a few suffixes only.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than their right neighbour). The end counts as the smallest sign."""
    n = len(t)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differ = np.flatnonzero(t[:-1] != t[1:])
    if not len(differ):
        return out
    # a sign equal to its right neighbour has the type of the next pair that differs
    following = np.searchsorted(differ, np.arange(n - 1))
    known = following < len(differ)
    at = differ[np.minimum(following, len(differ) - 1)]
    out[:-1] = known & (t[at] < t[at + 1])
    return out


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the given leftmost-S suffixes.

    Buckets are visited in order, each in rounds: what a round has placed induces the suffixes one to the left, and these
    join the ends of their buckets in the order in which they were induced.
    """
    n, k = len(t), len(bounds) - 1
    sa = np.full(n, -1, np.int64)
    head = bounds[:-1].copy()
    first = t[lms]
    by = np.argsort(first, kind="stable")
    lms_sorted = lms[by]
    cuts = np.searchsorted(first[by], np.arange(k + 1))

    def left(front: np.ndarray, want_s: bool) -> np.ndarray:
        before = front[front > 0] - 1
        return before[s_type[before] == want_s]

    def append(found: np.ndarray) -> None:
        signs = t[found]
        order = np.argsort(signs, kind="stable")
        signs, found = signs[order], found[order]
        starts = np.flatnonzero(np.append(True, signs[1:] != signs[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(found)]):
            c = int(signs[a])
            sa[head[c] : head[c] + b - a] = found[a:b]
            head[c] += b - a

    # L-type, ascending: the empty suffix induces the last one
    if not s_type[n - 1]:
        append(np.array([n - 1]))
    for c in range(k):
        done = bounds[c]
        while done < head[c]:
            front = sa[done : head[c]].copy()
            done = head[c]
            if len(found := left(front, False)):
                append(found)
        if cuts[c + 1] > cuts[c] and len(found := left(lms_sorted[cuts[c] : cuts[c + 1]], False)):
            append(found)
    # S-type, descending; buckets fill from their ends
    tail = bounds[1:].copy()

    def prepend(found: np.ndarray) -> None:
        signs = t[found]
        order = np.argsort(signs, kind="stable")
        signs, found = signs[order], found[order]
        starts = np.flatnonzero(np.append(True, signs[1:] != signs[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(found)]):
            c = int(signs[a])
            sa[tail[c] - (b - a) : tail[c]] = found[a:b][::-1]
            tail[c] -= b - a

    for c in range(k - 1, -1, -1):
        done = bounds[c + 1]
        while done > tail[c]:
            front = sa[tail[c] : done][::-1].copy()
            done = tail[c]
            if len(found := left(front, True)):
                prepend(found)
        front = sa[bounds[c] : head[c]][::-1].copy()  # the bucket's L-type suffixes
        if len(front) and len(found := left(front, True)):
            prepend(found)
    return sa


def _named(t: np.ndarray, s_type: np.ndarray, sa: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-S substrings in text order; equal names for equal substrings."""
    n = len(t)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    size = np.zeros(n, np.int64)
    size[lms] = np.append(lms[1:] - lms[:-1] + 1, n - lms[-1] + 1)  # the last one holds the end
    a, b = order[:-1], order[1:]
    differ = size[a] != size[b]
    differ |= (a == lms[-1]) | (b == lms[-1])
    open_, step = np.flatnonzero(~differ), 0
    while len(open_):
        x, y = a[open_] + step, b[open_] + step
        unequal = t[x] != t[y]
        differ[open_[unequal]] = True
        step += 1
        open_ = open_[~unequal & (size[a[open_]] > step)]
    names = np.zeros(n, np.int64)
    names[order] = np.cumsum(np.append(0, differ))
    return names[lms], int(names[order[-1]]) + 1


def _induce_wide(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The same as _induce(), one suffix after the other: for alphabets with few suffixes a sign."""
    n = len(t)
    sa = [-1] * n
    tail = bounds[1:].tolist()
    for i, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist()):
        tail[c] -= 1
        sa[tail[c]] = i
    head = bounds[:-1].tolist()
    # the sign to the left of each suffix if it starts one of the type wanted, else -1; the last place stands for "none"
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = np.where(s_type[: n - 1], -1, t[: n - 1])
    left = before.tolist()
    if not s_type[n - 1]:  # the empty suffix induces the last one
        c = int(t[n - 1])
        sa[head[c]] = n - 1
        head[c] += 1
    for i in sa:  # grows ahead of the place that is read
        c = left[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    tail = bounds[1:].tolist()
    before[1:n] = np.where(s_type[: n - 1], t[: n - 1], -1)
    left = before.tolist()
    for i in reversed(sa):
        c = left[i]
        if c >= 0:
            at = tail[c] - 1
            sa[at] = i - 1
            tail[c] = at
    return np.array(sa, np.int64)


#: Suffixes a sign, from which on buckets are worth numpy's calls.
_WIDE = 64


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of t, non-negative integers; reduced texts are sorted the same way, recursively."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = np.asarray(t, np.int64)
    k = int(t.max()) + 1
    induce = _induce if n >= _WIDE * k else _induce_wide
    bounds = np.append(0, np.cumsum(np.bincount(t, minlength=k)))
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if not len(lms):
        return induce(t, s_type, lms, bounds)
    names, kinds = _named(t, s_type, induce(t, s_type, lms, bounds), lms)
    order = np.argsort(names, kind="stable") if kinds == len(lms) else suffix_array(names)
    return induce(t, s_type, lms[order], bounds)


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes up to cap: for each suffix in text order, with its left and its right neighbour in sa.

    A suffix has a prefix one shorter than the suffix before it, unless the signs to the left differ; only these
    irreducible ones are compared, all at once.
    """
    n = len(t)
    left = np.zeros(n, np.int64)
    if n < 2:
        return left, left.copy()
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    has = before >= 0
    reducible = has.copy()
    reducible[0] = False
    inner = reducible & (before > 0)
    same = np.zeros(n, bool)
    same[inner] = t[at[inner] - 1] == t[before[inner] - 1]
    # its neighbour one to the left must be the neighbour of the suffix before
    same[inner] &= before[at[inner] - 1] == before[inner] - 1
    work = np.flatnonzero(has & ~same)
    size = np.zeros(n, np.int64)
    x, y = work, before[work]
    open_ = np.arange(len(work))
    step = 0
    # each irreducible prefix is wanted to its full length, so that the capped ones after it stay right
    while len(open_):
        px, py = x[open_] + step, y[open_] + step
        inside = (px < n) & (py < n)
        equal = inside & (t[np.minimum(px, n - 1)] == t[np.minimum(py, n - 1)])
        size[work[open_[~equal]]] = step
        open_ = open_[equal]
        step += 1
    start = np.maximum.accumulate(np.where(has & ~same, at, -1))
    ok = has & (start >= 0)
    left[ok] = np.maximum(size[start[ok]] - (at[ok] - start[ok]), 0)
    right = np.zeros(n, np.int64)
    right[sa[:-1]] = left[sa[1:]]
    return np.minimum(left, cap), np.minimum(right, cap)
