"""A run-length index of a set of strings: suffix order, run-compressed BWT, samples at run ends.

The index keeps one entry per run of the Burrows-Wheeler transform: its symbol, its length, and
the text positions at its first and last row, each with the length of the match to the row outside
the run. Inside a run, the symbols before two neighbouring rows are equal, so the match of a
position with its neighbour is one shorter than that of the position before it. Matching statistics
are therefore streamed from left to right: at a sampled position the stored length, elsewhere one
less than before. Each string ends in a symbol of its own, so no match crosses an end.
"""

import numpy as np


def suffix_order(codes):
    """Rank of every suffix of codes (small integers, all suffixes differ), by doubling prefixes."""
    n = len(codes)
    pad = np.concatenate([codes + 1, np.zeros(3, codes.dtype)])
    key = (pad[:n] << 48) | (pad[1 : n + 1] << 32) | (pad[2 : n + 2] << 16) | pad[3 : n + 3]
    order = np.argsort(key)
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = 4
    open_ = order[~(first & np.append(first[1:], True))]
    while len(open_):
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + h, n)] + 1
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        old = rank[open_]
        at = np.arange(len(open_))
        group = np.append(True, old[1:] != old[:-1])
        place = old + at - np.maximum.accumulate(np.where(group, at, 0))
        first = np.append(True, key[1:] != key[:-1])
        rank[open_] = np.maximum.accumulate(np.where(first, place, 0))
        open_ = open_[~(first & np.append(first[1:], True))]
        h *= 2
    return rank[:n]


def common(codes, a, b):
    """Length of the common prefix of the suffixes at a and b, pair by pair; a and b differ."""
    n, out = len(codes), np.zeros(len(a), np.int64)
    pad = np.concatenate([codes, np.full(64, -1, codes.dtype)])
    at, width = np.arange(len(a)), 4
    while len(at):
        x, y = a[at] + out[at], b[at] + out[at]
        cols = np.arange(width)
        same = pad[np.minimum(x[:, None] + cols, n + 63)] == pad[np.minimum(y[:, None] + cols, n + 63)]
        k = np.where(same.all(axis=1), width, same.argmin(axis=1))
        out[at] += k
        at = at[k == width]
        width = min(64, width * 2)
    return out


class RunIndex:
    """Index of a list of byte strings."""

    def __init__(self, strings):
        lens = np.array([len(s) for s in strings], np.int64)
        n = int(lens.sum()) + len(strings)
        self.ends = np.cumsum(lens + 1) - 1
        self.starts = self.ends - lens
        codes = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        codes[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + len(strings)
        codes[self.ends] = np.arange(len(strings))
        if len(strings) + 256 >= 1 << 15:
            raise ValueError("too many strings for one index")
        rank = suffix_order(codes)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        bwt = codes[order - 1]
        heads = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        tails = np.append(heads[1:], n) - 1
        self.n = n
        self.symbols, self.lengths = bwt[heads], np.diff(np.append(heads, n))
        self.head_at, self.tail_at = order[heads], order[tails]
        self.head_match = np.append(0, common(codes, order[heads[1:]], order[heads[1:] - 1]))
        self.tail_match = np.append(common(codes, order[tails[:-1]], order[tails[:-1] + 1]), 0)

    def matches(self):
        """For every position of the joined text, the longest match with any other position."""
        best, here = None, np.arange(self.n)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            stored = np.full(self.n, -1, np.int64)
            stored[at] = match
            last = np.maximum.accumulate(np.where(stored >= 0, here, 0))
            now = stored[last] - (here - last)
            best = now if best is None else np.maximum(best, now)
        return best

    def repeated(self, length):
        """For each string, the places where a substring of `length` starts that is elsewhere too."""
        hits = np.flatnonzero(self.matches() >= length)
        which = np.searchsorted(self.ends, hits)
        hits = hits - self.starts[which]
        cuts = np.searchsorted(which, np.arange(len(self.ends) + 1))
        return [hits[a:b] for a, b in zip(cuts, cuts[1:])]
