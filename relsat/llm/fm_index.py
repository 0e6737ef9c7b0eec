"""An FM-index over an array of small integers, with a wavelet matrix for ranks."""

from __future__ import annotations

import numpy as np


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Suffixes of ``sym`` in order. 0 separates segments: separators differ, the earlier is less.

    Prefix doubling; from round to round only the groups that are still tied are sorted. The
    last symbol must be a separator, so that no comparison runs over the end.
    """
    n = len(sym)
    sep = sym == 0
    first = np.where(sep, np.cumsum(sep) - 1, int(sep.sum()) - 1 + sym.astype(np.int64))
    sa = np.argsort(first, kind="stable")
    s = first[sa]
    head = np.r_[True, s[1:] != s[:-1]]
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, at, 0))
    tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
    k = 1
    while len(tied):
        idx = sa[tied]
        one, two = rank[idx], rank[idx + k]
        order = np.lexsort((two, one))
        idx, one, two = idx[order], one[order], two[order]
        sa[tied] = idx
        head = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        rank[idx] = np.maximum.accumulate(np.where(head, tied, 0))
        tied = tied[~(head & np.r_[head[1:], True])]
        k *= 2
    return sa


class WaveletMatrix:
    """Symbols below ``2**bits``; level by level the zeros before each position."""

    def __init__(self, a: np.ndarray, bits: int) -> None:
        self.bits, self.zeros = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (a >> level) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - bit))).astype(np.int32))
            a = np.concatenate((a[bit == 0], a[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` stands before ``i`` (element by element)."""
        lo = np.zeros_like(i)
        for z, level in zip(self.zeros, range(self.bits - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            zl, zi = z[lo], z[i]
            lo, i = np.where(one, z[-1] + lo - zl, zl), np.where(one, z[-1] + i - zi, zi)
        return i - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and how often it stands before ``i``."""
        c, lo = np.zeros_like(i), np.zeros_like(i)
        for z in self.zeros:
            one = z[i + 1] == z[i]
            zl, zi = z[lo], z[i]
            c = 2 * c + one
            lo, i = np.where(one, z[-1] + lo - zl, zl), np.where(one, z[-1] + i - zi, zi)
        return c, i - lo


class FMIndex:
    def __init__(self, sym: np.ndarray, symbols: int, every: int = 32) -> None:
        """``sym``: values from 0 (separator, also the last one) to ``symbols``."""
        sa = suffix_array(sym)
        before = sym[sa - 1]  # of suffix 0 the last symbol, a separator
        self.n, self.symbols = len(sym), symbols
        self.less = np.concatenate(([0], np.cumsum(np.bincount(sym, minlength=symbols + 1)))).astype(np.int64)
        self.wavelet = WaveletMatrix(before.astype(np.int64), max(1, int(symbols).bit_length()))
        # segment starts are sampled too, so that no walk has to pass a separator
        self.sampled = (sa % every == 0) | (before == 0)
        self.order = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (rows of a padded array)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, lengths[live] - back]
            lo[live] = self.less[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.less[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: walk backwards to a sampled one."""
        out, row, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = row[live]
            done = self.sampled[r]
            out[live[done]] = self.samples[self.order[r[done]]] + steps[live[done]]
            live = live[~done]
            c, before = self.wavelet.access(row[live])
            row[live] = self.less[c] + before
            steps[live] += 1
        return out
