"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

# Reduced texts with more names than this are ordered by doubling: their buckets hold so
# few suffixes that inducing them one bucket at a time gains nothing.
NAMES = 1024


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``: small non-negative integers, the last a single 0."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].copy()
    if s.max() < 1 << 16:
        # Symbols of 16 bits sort by radix.
        s = s.astype(np.uint16)
    smaller = _smaller(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    first = _induce(s, smaller, leftmost)
    place = np.zeros(n, bool)
    place[leftmost] = True
    in_order = first[place[first]]
    names = _names(s, leftmost, in_order)
    if names.max() + 1 < len(leftmost):
        if names.max() < NAMES:
            order = suffix_array(names)
        else:
            order = _doubling(names)
        in_order = leftmost[order]
    return _induce(s, smaller, in_order)


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether a suffix is smaller than the next one; the last one is."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.where(at < n, step[np.minimum(at, n - 2)] > 0, False)
    return out


def _induce(s: np.ndarray, smaller: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Places the given suffixes at their buckets' ends, then all others from them.

    A bucket is worked off as a whole; suffixes that it puts into itself follow in turn.
    """
    n = len(s)
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    tail = ends.copy()
    _place(sa, tail, s, in_order[::-1], -1)
    lms = {c: sa[tail[c] : ends[c]].copy() for c in np.flatnonzero(tail < ends)}
    head = starts.copy()
    for c in range(len(counts)):
        done = starts[c]
        while done < head[c]:
            now, done = sa[done : head[c]], head[c]
            _place(sa, head, s, _before(now, ~smaller), 1)
        if c in lms:
            _place(sa, head, s, _before(lms[c], ~smaller), 1)
    tail = ends.copy()
    for c in range(len(counts) - 1, -1, -1):
        done = ends[c]
        while done > tail[c]:
            now, done = sa[tail[c] : done][::-1].copy(), tail[c]
            _place(sa, tail, s, _before(now, smaller), -1)
        larger = sa[starts[c] : head[c]][::-1].copy()
        _place(sa, tail, s, _before(larger, smaller), -1)
    # The single smallest suffix follows no other.
    sa[0] = n - 1
    return sa


def _before(now: np.ndarray, kind: np.ndarray) -> np.ndarray:
    p = now[now > 0] - 1
    return p[kind[p]]


def _place(sa: np.ndarray, at: np.ndarray, s: np.ndarray, new: np.ndarray, way: int) -> None:
    """Puts ``new`` into the buckets of their symbols in order, from ``at`` up or down."""
    if not len(new):
        return
    c = s[new]
    order = np.argsort(c, kind="stable")
    c, new = c[order], new[order]
    fresh = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    sizes = np.diff(np.r_[fresh, len(c)])
    rank = np.arange(len(c)) - np.repeat(fresh, sizes)
    if way > 0:
        sa[at[c] + rank] = new
        at[c[fresh]] += sizes
    else:
        sa[at[c] - 1 - rank] = new
        at[c[fresh]] -= sizes


def _names(s: np.ndarray, leftmost: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between leftmost-smaller suffixes, equal ones sharing one."""
    ends = np.r_[leftmost[1:], len(s) - 1]
    turn = np.empty(len(s), np.int64)
    turn[leftmost] = np.arange(len(leftmost))
    at = turn[in_order]
    length = ends[at] - in_order + 1
    same = np.zeros(len(in_order), bool)
    pair = np.flatnonzero(length[1:] == length[:-1]) + 1
    k = 0
    while len(pair):
        over = k >= length[pair]
        same[pair[over]] = True
        pair = pair[~over]
        pair = pair[s[in_order[pair] + k] == s[in_order[pair - 1] + k]]
        k += 1
    names = np.empty(len(in_order), np.int64)
    names[at] = np.cumsum(~same) - 1
    return names


def _doubling(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes by twice as many symbols in each turn.

    A rank is the place where a suffix's group begins, so only groups of several suffixes
    are sorted again.
    """
    n, k = len(s), 1
    order = np.argsort(s, kind="stable")
    at, key, rank = np.arange(n), s[order], np.empty(n, np.int64)
    while True:
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        at = at[~(fresh & np.r_[fresh[1:], True])]
        if not len(at):
            return order
        open_ = order[at]
        second = np.zeros(len(at), np.int64)
        inside = open_ + k < n
        second[inside] = rank[open_[inside] + k] + 1
        key = rank[open_] * (n + 1) + second
        turn = np.argsort(key)
        key, order[at] = key[turn], open_[turn]
        k *= 2


def _words(s: np.ndarray) -> tuple[np.ndarray, int, int]:
    """At each position the symbols from there on that fit into 63 bits, their number, bits of each."""
    bits = max(1, int(s.max()).bit_length())
    many = max(1, 63 // bits)
    padded = np.r_[s, np.zeros(many - 1, s.dtype)]
    out = np.zeros(len(s), np.int64)
    for k in range(many):
        out <<= bits
        out |= padded[k : k + len(s)]
    return out, many, bits


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int, anew: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix and the one before it in order, by text position.

    Only where the symbols before the two differ is it compared, up to ``most`` symbols
    beyond; from there on each next position has one less. A prefix cut at ``most`` is too
    short for positions far behind, so the comparison starts ``anew`` at given places.
    """
    n = len(s)
    if s.max() < 1 << 16:
        s = s.astype(np.uint16)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    fresh = (before <= 0) | (i == 0)
    fresh |= s[i - 1] != s[before - 1]
    if anew is not None:
        fresh[anew] = True
    at = np.flatnonzero(fresh & (before >= 0))
    plcp = np.zeros(n, np.int64)
    # Words of several symbols; the single last symbol keeps equal ones inside the text.
    words, many, bits = _words(s)
    one, two, k = at, before[at], 0
    while len(one) and k < most:
        apart = words[one + k] ^ words[two + k]
        plcp[one] += sum((apart < 1 << bits * j).astype(np.int64) for j in range(many))
        same = apart == 0
        one, two, k = one[same], two[same], k + many
    np.minimum(plcp, most, out=plcp)
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.where(fresh, plcp, np.maximum(plcp[last] - (i - last), 0))
