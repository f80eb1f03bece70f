"""Suffix arrays by induced sorting, and permuted common prefixes.

A text's leftmost-smaller (LMS) substrings are sorted by induction and named; the string of names, in text
order, is sorted in the same way, level by level, until all names differ; its order induces the whole array.
Over few symbols (bytes) induction scans buckets, not entries: all entries of one first symbol that are known
so far induce their predecessors at once, in the order of the scan. Over many (names) it goes by distance: the
suffixes one run of equal symbols before a known one get their places at once, then those two runs before one,
and so on. Texts whose names rise or fall for long stretches that repeat are scanned entry by entry, which is
linear for any text.
"""

from __future__ import annotations

import numpy as np

from gavelflow.llm.textbytes import _eights

#: Up to so many symbols, and runs of one symbol up to so long, buckets are scanned.
SYMBOLS, RUN = 512, 1000
#: Elsewhere places are induced by distance, as long as rounds place no more than so many suffixes for each of
#: the text (a round counts as ROUND suffixes at least), and entries are scanned beyond.
WORK, ROUND = 16, 500


def classify(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than their successor). The end is smaller than all."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    if n < 2:
        return s
    up, down = t[:-1] < t[1:], t[:-1] > t[1:]
    # a run of equal symbols has the type of the first difference after it
    known = np.flatnonzero(up | down)
    if len(known):
        s[: known[-1] + 1] = np.repeat(up[known], np.diff(known, prepend=-1))
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order; their LMS substrings in order, given any order."""
    k = len(sizes)
    same = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
    if k > SYMBOLS or np.diff(same).max() > RUN:
        sa = _induce_distances(t, s, lms, sizes, same)
        return _induce_entries(t.tolist(), s.tolist(), lms.tolist(), np.cumsum(sizes).tolist()) if sa is None else sa
    t = t.astype(np.uint16)  # sorted by radix
    order = np.argsort(t[lms], kind="stable")
    lms_by = np.split(lms[order], np.cumsum(np.bincount(t[lms], minlength=k))[:-1])
    n = len(t)
    left: list[list[np.ndarray]] = [[] for _ in range(k)]

    def deal(into: list[list[np.ndarray]], pre: np.ndarray, sym: np.ndarray) -> None:
        o = np.argsort(sym, kind="stable")
        pre, sym = pre[o], sym[o]
        cuts = np.flatnonzero(sym[1:] != sym[:-1]) + 1
        for part in np.split(pre, cuts) if len(pre) else []:
            into[t[part[0]]].append(part)

    # L-types, from the smallest bucket on; the end of the text comes first and induces the last suffix
    left[t[n - 1]].append(np.array([n - 1]))
    l_sorted: list[np.ndarray] = []
    for c in range(k):
        queue, done, out = left[c], [], []
        while queue:
            block = np.concatenate(queue)
            queue = []
            done.append(block)
            pre = block[block > 0] - 1
            pre = pre[~s[pre]]
            same = t[pre] == c
            if same.any():
                queue.append(pre[same])
            out.append(pre[~same])
        bucket = np.concatenate(done) if done else np.empty(0, dtype=np.int64)
        l_sorted.append(bucket)
        pre = lms_by[c] - 1
        out.append(pre[(pre >= 0)])
        pre = np.concatenate(out)
        deal(left, pre, t[pre])

    # S-types, from the largest bucket down
    right: list[list[np.ndarray]] = [[] for _ in range(k)]
    s_sorted: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * k
    for c in range(k - 1, -1, -1):
        queue, done, out = right[c], [], []
        while queue:
            block = np.concatenate(queue)  # in descending order
            queue = []
            done.append(block)
            pre = block[block > 0] - 1
            pre = pre[s[pre]]
            same = t[pre] == c
            if same.any():
                queue.append(pre[same])
            out.append(pre[~same])
        bucket = np.concatenate(done) if done else np.empty(0, dtype=np.int64)
        s_sorted[c] = bucket[::-1]
        block = l_sorted[c][::-1]
        pre = block[block > 0] - 1
        out.append(pre[s[pre]])
        pre = np.concatenate(out)
        deal(right, pre, t[pre])
    return np.concatenate([x for c in range(k) for x in (l_sorted[c], s_sorted[c])])


def _induce_distances(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray, runs: np.ndarray) -> np.ndarray | None:
    """_induce, by the distance from what is known, in runs of equal symbols (which begin at runs; its last is the
    end); None where that is too much work. Suffixes of one symbol and type stand by the length of the run that
    they begin with, L-types the shortest first and S-types the longest, and then as what follows the run."""
    n, k = len(t), len(sizes)
    ends = np.cumsum(sizes)
    after = np.repeat(runs[1:], np.diff(runs))
    length = after - np.arange(n)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = 0  # the end is smaller than all
    order = lms[np.argsort(t[lms], kind="stable")]
    rank[order] = (ends - np.cumsum(np.bincount(t[lms], minlength=k)))[t[order]] + np.arange(len(lms)) + 1
    for kind in (False, True):
        own = np.flatnonzero(s == kind)
        first = ends - np.bincount(t[own], minlength=k) if kind else ends - sizes
        rank[own] = first[t[own]] + 1
        more = own[length[own] > 1]
        if kind:
            one = own[length[own] == 1]
            rank[one] += np.bincount(t[more], minlength=k)[t[one]]
        else:
            rank[more] += (np.bincount(t[own], minlength=k) - np.bincount(t[more], minlength=k))[t[more]]
        _split(rank, more, n - length[more] if kind else length[more])
        done = 0
        while len(own):
            done += max(len(own), ROUND)
            if done > WORK * max(n, ROUND):
                return None
            own = _split(rank, own, rank[after[own]])
    sa = np.empty(n, dtype=np.int64)
    sa[rank[:n] - 1] = np.arange(n)
    return sa


def _split(rank: np.ndarray, live: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Tells suffixes of one rank apart: each gets the rank plus the number of those that come before it. live are
    whole ranks; the suffixes that still share one are returned."""
    if not len(live):
        return live
    key = rank[live] * len(rank) + by
    order = np.argsort(key)
    live, key = live[order], key[order]
    old = rank[live]
    at = np.arange(len(live))
    cut = np.ones(len(live) + 1, dtype=bool)
    cut[1:-1] = key[1:] != key[:-1]
    whole = np.ones(len(live), dtype=bool)
    whole[1:] = old[1:] != old[:-1]
    rank[live] = old + np.maximum.accumulate(np.where(cut[:-1], at, 0)) - np.maximum.accumulate(np.where(whole, at, 0))
    return live[~(cut[:-1] & cut[1:])]


def _name(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sa: np.ndarray, is_lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, equal for equal substrings; the number of names."""
    ordered = sa[is_lms[sa]]
    rank = np.empty(len(t), dtype=np.int64)
    rank[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], len(t) - 1)  # the substring goes to the next LMS position, included
    a, b = ordered[:-1], ordered[1:]
    la, lb = ends[rank[a]] - a, ends[rank[b]] - b
    equal = la == lb
    # the last LMS substring runs to the end and equals no other
    equal &= (rank[a] != len(lms) - 1) & (rank[b] != len(lms) - 1)
    live = np.flatnonzero(equal)
    step = 0
    while len(live):
        pa, pb = a[live] + step, b[live] + step
        differ = (t[pa] != t[pb]) | (s[pa] != s[pb])
        equal[live[differ]] = False
        live = live[~differ & (la[live] > step)]
        step += 1
    names = np.empty(len(lms), dtype=np.int64)
    names[rank[ordered]] = np.concatenate([[0], np.cumsum(~equal)])
    return names, int((~equal).sum()) + 1


def _induce_entries(t: list[int], s: list[bool], lms: list[int], ends: list[int]) -> np.ndarray:
    """_induce, entry by entry. A bucket has its L-type suffixes first, then its S-type ones; the order of the
    scan sees to it that an entry stands before it is read."""
    n = len(t)
    sa = [-1] * n
    free = ends[:]
    for i in reversed(lms):
        free[t[i]] -= 1
        sa[free[t[i]]] = i
    free = [0, *ends[:-1]]
    sa[free[t[-1]]] = n - 1  # the end comes first and induces the last suffix
    free[t[-1]] += 1
    for i in sa:  # reads what the loop writes further on
        if i > 0 and not s[i - 1]:
            c = t[i - 1]
            sa[free[c]] = i - 1
            free[c] += 1
    free = ends[:]
    for at in range(n - 1, -1, -1):
        i = sa[at] - 1
        if i >= 0 and s[i]:
            c = t[i]
            free[c] -= 1
            sa[free[c]] = i
    return np.array(sa, dtype=np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t (small non-negative integers) in order."""
    t = t.astype(np.int64)
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = classify(t)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(t)
    sa = _induce(t, s, lms, sizes)
    if len(lms) < 2:
        return sa
    names, count = _name(t, s, lms, sa, is_lms)
    order = np.argsort(names) if count == len(lms) else suffix_array(names)
    return _induce(t, s, lms[order], sizes)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In text order, each position's predecessor in the suffix array (-1 for the first), and the length of
    their common prefix. t are bytes.

    Where the symbols before both are equal, the prefix is one shorter than that of the position before. Only
    the other positions are compared, eight bytes a step; their prefixes add up to O(n log n)."""
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    own = np.ones(n, dtype=bool)
    later = np.flatnonzero(phi[1:] > 0) + 1
    own[later] = t[later - 1] != t[phi[later] - 1]
    eight = _eights(np.concatenate([t, np.zeros(8, dtype=np.uint8)]))
    lcp = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(own & (phi >= 0))
    done = 0
    while len(live):
        x = eight[live + done] ^ eight[phi[live] + done]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8)
        lcp[live] = np.minimum(done + same, n - np.maximum(live, phi[live]))
        done += 8
        live = live[lcp[live] == done]
        live = live[np.maximum(live, phi[live]) + done < n]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(own, at, 0))
    return phi, lcp[first] - (at - first)


def repeated(t: np.ndarray, size: int) -> np.ndarray:
    """Starts, as a mask, of the strings of size bytes that also start elsewhere in t."""
    out = np.zeros(len(t), dtype=bool)
    if len(t) > size:
        phi, lcp = permuted_lcp(t, suffix_array(t))
        ok = lcp >= size
        out[ok] = True
        out[phi[ok]] = True
    return out
