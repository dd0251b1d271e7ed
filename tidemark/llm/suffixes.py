"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

A text is several segments, each ended by a separator of its own below all bytes, so no common prefix runs past a
segment. Suffixes are classified as smaller (S) or larger (L) than the one behind them; leftmost S suffixes (LMS) are
sorted by their substrings, recursively where those repeat; all others are induced from them in linear time. With few
different symbols a bucket is induced in whole array steps, with many (the recursion) entry by entry.
"""

from __future__ import annotations

import numpy as np


def types_of(t):
    """True for S suffixes; the last symbol is the one smallest."""
    step = np.sign(np.diff(t))
    n = len(t)
    behind = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1), n)[::-1])[::-1]  # next change of symbol
    return np.append(step[behind] > 0, True)


def induced(t, is_s, lms, symbols: int, alone: int):
    """Suffix array from LMS suffixes in the order of their first symbols; the first ``alone`` symbols occur once
    each and only before larger ones."""
    counts = np.bincount(t, minlength=symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    if len(t) < 100 * (symbols - alone):
        return _induced_singly(t, is_s, lms, starts, ends)
    out = np.full(len(t), -1, np.int64)
    first = t[lms]
    lms = lms[np.argsort(first, kind="stable")]
    lms_ends = np.cumsum(np.bincount(first, minlength=symbols))
    head, tail = starts.copy(), ends.copy()
    buckets = [c for c in range(alone, symbols) if counts[c]]

    def larger(chunk):
        p = chunk[chunk > 0] - 1
        p = p[~is_s[p]]
        if len(p):
            q = t[p]
            order = np.argsort(q, kind="stable")
            p, q = p[order], q[order]
            n = np.bincount(q, minlength=symbols)
            out[head[q] + np.arange(len(q)) - (np.cumsum(n) - n)[q]] = p
            np.add(head, n, out=head)

    def smaller(chunk):
        p = chunk[chunk > 0] - 1
        p = p[is_s[p]]
        if len(p):
            q = t[p]
            order = np.argsort(q, kind="stable")
            p, q = p[order], q[order]
            n = np.bincount(q, minlength=symbols)
            out[tail[q] - 1 - np.arange(len(q)) + (np.cumsum(n) - n)[q]] = p
            np.subtract(tail, n, out=tail)

    if alone:
        larger(lms[: lms_ends[alone - 1]])
    for c in buckets:
        done = starts[c]
        while done < head[c]:  # a bucket grows while runs of its own symbol are induced
            done, begin = head[c], done
            larger(out[begin:done])
        larger(lms[lms_ends[c] - np.count_nonzero(first == c) if c == 0 else lms_ends[c - 1] : lms_ends[c]])
    out[ends[t[-1]] - 1] = len(t) - 1
    tail[t[-1]] -= 1
    for c in reversed(buckets):
        done = ends[c]
        while tail[c] < done:
            done, end = tail[c], done
            smaller(out[done:end][::-1])
        smaller(out[starts[c] : head[c]][::-1])
    return out


def _induced_singly(t, is_s, lms, starts, ends):
    t, is_s = t.tolist(), is_s.tolist()
    out, tail, head = [-1] * len(t), ends.tolist(), starts.tolist()
    for j in reversed(lms.tolist()):
        tail[t[j]] -= 1
        out[tail[t[j]]] = j
    for j in out:
        if j > 0 and not is_s[j - 1]:
            c = t[j - 1]
            out[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    for i in range(len(t) - 1, -1, -1):
        j = out[i]
        if j > 0 and is_s[j - 1]:
            c = t[j - 1]
            tail[c] -= 1
            out[tail[c]] = j - 1
    return np.array(out, np.int64)


def named(t, lms, order):
    """Names of LMS substrings in text order, equal for equal substrings, by ``order`` of the sorted substrings."""
    length = np.append(np.diff(lms), 0) + 1
    rank = np.empty(len(t), np.int64)
    rank[lms] = length
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), bool)
    at, k = np.flatnonzero(rank[a] == rank[b]), 0
    while len(at):
        at = at[t[a[at] + k] == t[b[at] + k]]
        k += 1
        full = rank[a[at]] == k
        same[at[full]] = True
        at = at[~full]
    rank[order] = np.concatenate(([0], np.cumsum(~same)))
    return rank[lms]


def suffix_array(t, symbols: int, alone: int = 0):
    """Suffix array of ``t``, whose last symbol is the only smallest one."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    is_s = types_of(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    found = induced(t, is_s, lms, symbols, alone)
    order = found[is_lms[found]]
    names = named(t, lms, order)
    most = int(names.max()) + 1
    if most < len(lms):
        order = lms[suffix_array(names, most)]
    return induced(t, is_s, order, symbols, alone)


def joined(segments: list[bytes]):
    """``t, symbols, starts``: the segments with their separators, the last of which is the smallest symbol."""
    n = len(segments)
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    t = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + n
    t[starts + sizes] = np.append(np.arange(1, n), 0)
    return t, n + 256, starts


def permuted_prefixes(t, found, segments: list[bytes]):
    """For each position, the common prefix with the suffix before it in the suffix array.

    Where the symbols in front of both are equal, the value follows from the position before; only the others are
    compared, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[found[1:]] = found[:-1]
    prior = np.concatenate(([-1], t[:-1]))
    follows = (before > 0) & (np.arange(n) > 0) & (prior == prior[before])
    sizes = np.array([len(s) for s in segments])
    left = np.concatenate([np.arange(s, -1, -1) for s in sizes])  # bytes to the segment's end
    raw = np.frombuffer(b"\0".join(segments) + b"\0" * 16, np.uint8)
    words = raw.astype(np.uint64)
    for shift in (1, 2, 4):
        words = words[:-shift] | (words[shift:] << np.uint64(8 * shift))
    at = np.flatnonzero(~follows & (before >= 0))
    size = np.zeros(n, np.int64)
    most = np.minimum(left[at], left[before[at]])
    k = 0
    while len(at):
        x = words[at + k] ^ words[before[at] + k]
        lowest = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)
        size[at] = np.minimum(k + equal, most)
        more = (x == 0) & (k + 8 < most)
        at, most = at[more], most[more]
        k += 8
    last = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return size[last] - (np.arange(n) - last)
