"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

The sequential scans of induced sorting run bucket by bucket: all suffixes that a bucket holds so far are taken at once,
those that precede them are dealt stably to their buckets, and what falls into the same bucket is taken next. Over a
large alphabet (strings of names) the same scans run suffix by suffix. Leftmost-smaller substrings are sorted by
induction at every level of the recursion.
"""

from __future__ import annotations

import numpy as np

#: Symbols up to which a scan takes a bucket at a time; the order that it gives is the same.
MOST_BUCKETS = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next (the last, a unique least symbol, is one)."""
    n = len(t)
    differ = t[1:] != t[:-1]
    at = np.where(differ, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(t[1:] > t[:-1], True)[at], True)


def _deal(sa: np.ndarray, fill: np.ndarray, chars: np.ndarray, values: np.ndarray, down: bool) -> None:
    """Appends values to their buckets, in order; down: buckets grow to the left."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(first, len(c)))
    place = np.arange(len(c)) - np.repeat(first, size)
    if down:
        sa[fill[c] - 1 - place] = values[order]
        fill[c[first]] -= size
    else:
        sa[fill[c] + place] = values[order]
        fill[c[first]] += size


def _induce(t: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """The suffix array that this order of the leftmost-smaller suffixes induces."""
    n = len(t)
    count, larger = np.bincount(t, minlength=k), np.bincount(t[~small], minlength=k)
    tail = np.cumsum(count)
    head = tail - count
    chars = t[lms]
    by_char = np.argsort(chars, kind="stable")
    seeds, upto = lms[by_char], np.concatenate([[0], np.cumsum(np.bincount(chars, minlength=k))])
    sa = np.full(n, -1, np.int32)
    fill = head.copy()

    def push(batch: np.ndarray, want_small: bool, down: bool) -> None:
        prev = batch[batch > 0] - 1
        prev = prev[small[prev] == want_small]
        if len(prev):
            _deal(sa, fill, t[prev], prev, down)

    for c in np.flatnonzero(count).tolist():
        p = head[c]
        while p < fill[c]:
            q = fill[c]
            push(sa[p:q].copy(), False, False)
            p = q
        if upto[c] < upto[c + 1]:
            push(seeds[upto[c] : upto[c + 1]], False, False)
    fill = tail.copy()
    for c in np.flatnonzero(count)[::-1].tolist():
        p = tail[c]
        if c == t[n - 1]:
            sa[head[c]] = n - 1
            fill[c] = head[c]
            push(np.array([n - 1], np.int32), True, True)
            continue
        while p > fill[c]:
            q = fill[c]
            push(sa[q:p][::-1].copy(), True, True)
            p = q
        if larger[c]:
            push(sa[head[c] : head[c] + larger[c]][::-1].copy(), True, True)
    return sa


def _induce_each(t: np.ndarray, small: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """What _induce gives, suffix by suffix: for strings of names, whose buckets hold a few suffixes each."""
    tail = np.cumsum(np.bincount(t, minlength=k))
    head, n = np.append(0, tail[:-1]).tolist(), len(t)
    text, is_small, sa = t.tolist(), small.tolist(), [-1] * n
    fill = tail.tolist()
    for j in lms[::-1].tolist():
        c = text[j]
        fill[c] -= 1
        sa[fill[c]] = j
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not is_small[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    fill = tail.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and is_small[j]:
            c = text[j]
            fill[c] -= 1
            sa[fill[c]] = j
    return np.array(sa, np.int32)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """t: integers below k, ending in a 0 that occurs once. Returns the starts of the suffixes in order."""
    n = len(t)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    small = _types(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    induce = _induce if k <= MOST_BUCKETS else _induce_each
    sa = induce(t, small, k, lms)
    if len(lms) == 1:
        return sa
    order = sa[is_lms[sa]]
    # Names: equal neighbours in this order are equal substrings, up to and with the next leftmost-smaller suffix.
    end = np.full(n, n - 1, np.int32)
    end[lms[:-1]] = lms[1:]
    a, b = order[:-1], order[1:]
    same = (end[a] - a) == (end[b] - b)
    live, k_off = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live], b[live]
        equal = t[x + k_off] == t[y + k_off]
        same[live[~equal]] = False
        live = live[equal & (x + k_off < end[x])]
        k_off += 1
    name_of = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(n, np.int32)
    names[order] = name_of
    reduced, m = names[lms], int(name_of[-1]) + 1
    sorted_lms = order if m == len(lms) else lms[suffix_array(reduced, m)]
    return induce(t, small, k, sorted_lms)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix of each suffix with the one before it in order, that suffix), by place in the text.

    Only irreducible entries (another symbol before, or none) are compared; from one to the next the prefix of each place
    is one shorter than the last.
    """
    n = len(t)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    irreducible = phi <= 0
    irreducible[0] = True
    rest = np.flatnonzero(~irreducible).astype(np.int32)
    irreducible[rest] = t[rest - 1] != t[phi[rest] - 1]
    del rest
    lcp = np.zeros(n, np.int32)
    x = np.flatnonzero(irreducible & (phi >= 0)).astype(np.int32)
    y, got = phi[x], 0
    while len(x):
        inside = np.maximum(x, y) + got < n
        same = inside & (t[np.minimum(x + got, n - 1)] == t[np.minimum(y + got, n - 1)])
        lcp[x[~same]] = got
        x, y = x[same], y[same]
        got += 1
    at = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.where(phi >= 0, np.maximum(lcp[last] - (at - last), 0), 0), phi
