"""FM-index over sequences of small integers, in numpy: suffix order, Burrows-Wheeler transform, wavelet matrix
with constant-time ranks, vectorised backward search, and locating by sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. Zeros separate texts: each is a symbol of its own, in order of place.

    Suffixes are sorted by as many first symbols as fit in 64 bits; those that still tie, by doubled ranks.
    """
    n = len(seq)
    bits = max(1, int(seq.max(initial=0)).bit_length())
    have = max(1, 63 // bits)
    long = np.concatenate([seq.astype(np.uint64), np.zeros(have, np.uint64)])
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(have):
        part = long[k : k + n]
        key = (key << np.uint64(bits)) | np.where(open_, part, np.uint64(0))
        open_ &= part > 0
    # Suffixes whose keys hold a zero and are equal have it at the same distance: a stable sort puts them in order of place.
    order = np.argsort(key, kind="stable")
    sorted_key, done = key[order], ~open_[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | done[1:]
    while True:
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            return order
        rank = np.empty(n + 1, np.int64)
        rank[order] = group
        rank[n] = -1
        rows = order[tied]
        after = rank[np.minimum(rows + have, n)]
        sort = np.lexsort((after, group[tied]))
        order[tied] = rows[sort]
        g, a = group[tied], after[sort]
        new[tied] = np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1])])
        have *= 2


class BitRank:
    """Bit vector with rank directory: ones before each 64-bit word, then a population count."""

    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64) * 64
        full = np.zeros(n, np.uint8)
        full[: len(bits)] = bits
        self.words = np.packbits(full, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1))).astype(np.int64)


class FMIndex:
    """Index of seq, whose symbols are 1..sigma-1 with 0 between texts; seq begins and ends with 0."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16):
        order = suffix_order(seq)
        self.n = len(seq)
        bwt = seq[order - 1]
        self.levels = max(1, int(sigma - 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.bits, self.zeros = [], []
        cur = bwt
        for lev in range(self.levels - 1, -1, -1):
            bit = ((cur >> lev) & 1).astype(np.uint8)
            self.bits.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        start = np.zeros(sigma, np.int64)  # where a symbol's zone begins in the last level
        sym, at = np.unique(cur, return_index=True)
        start[sym] = at
        self.zone = start
        # Sampled: every sample-th position, and each text's first symbol, so that no walk crosses a separator.
        kept = (order % sample == 0) | (bwt == 0)
        self.kept = BitRank(kept.astype(np.uint8))
        self.samples = order[kept]

    def rank(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often sym occurs in the first i symbols of the transform."""
        p = i
        for d, lev in enumerate(range(self.levels - 1, -1, -1)):
            one = self.bits[d].rank1(p)
            p = np.where((sym >> lev) & 1, self.zeros[d] + one, p - one)
        return p - self.zone[sym]

    def back(self, i: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one place before those of rows i, by wavelet access to the transform."""
        p, sym = i, np.zeros(len(i), np.int64)
        for d in range(self.levels):
            one, bit = self.bits[d].rank1(p), self.bits[d].get(p)
            p = np.where(bit, self.zeros[d] + one, p - one)
            sym = 2 * sym + bit
        return self.first[sym] + p - self.zone[sym]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of phrases (rows, left-aligned) by backward search, all phrases in step."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            act = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(act):
                break
            sym = phrases[act, lengths[act] - back]
            lo[act] = self.first[sym] + self.rank(sym, lo[act])
            hi[act] = self.first[sym] + self.rank(sym, hi[act])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: steps back to the next sampled one."""
        pos, step, row = np.zeros(len(rows), np.int64), 0, rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.kept.get(row[open_])
            done = open_[hit]
            pos[done] = self.samples[self.kept.rank1(row[done])] + step
            open_ = open_[~hit]
            row[open_] = self.back(row[open_])
            step += 1
        return pos
