"""A full-text index (FM-index) over integer sequences with a large alphabet.

The text is the concatenation of documents, each closed by symbol 0. At rest are the sorted alphabet, the
Burrows-Wheeler transform and the document and offset of each suffix, compressed. On loading, the rows of each symbol
are put in order, so that one binary search is a rank query and a backward-search step for a whole batch of patterns is
two calls of searchsorted; the documents themselves are read off the transform.
"""

from __future__ import annotations

import zlib

import numpy as np


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order of their symbols up to the document's end; prefix doubling, at most log2(longest)+1 sorts."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        after[rank == 0] = -1  # what follows a document's end says nothing
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        rank = new
        step *= 2
        if step > longest or rank[order[-1]] == n - 1:
            return order


def ramps(width: np.ndarray) -> np.ndarray:
    """0, 1, ..., width[0]-1, 0, 1, ..., width[1]-1 and so on."""
    ends = np.cumsum(width)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width)


def least_common(a: np.ndarray, d: np.ndarray, share: float) -> np.ndarray:
    """The fewest values that sets of a and d values have in common if they share ``share`` of all values of either."""
    return np.ceil(share / (1 + share) * (a + d) - 1e-9).astype(np.int64)


def seed_plan(size: int, share: float) -> tuple[int, int]:
    """(length, places): some common span of ``length`` values ends in the first ``places`` of a set of that size.

    Let two sets of a and d values have c in common, both in the same order. Outside values break the common ones into at
    most b+1 spans, b = a+d-2c. The first a-c+l values of one and d-c+l of the other have l in common; with l = b+2 two of
    them are neighbours in both sets. That needs c >= b+2 for every d that is near enough; where some d lacks it
    (one-value sets, low shares), single values are sought, in the first a-c+1 places.
    """
    d = np.arange(max(1, int(np.ceil(share * size - 1e-9))), int(np.floor(size / share + 1e-9)) + 1)
    c = least_common(np.full(len(d), size), d, share)
    c, d = c[c <= np.minimum(size, d)], d[c <= np.minimum(size, d)]
    if (3 * c >= size + d + 2).all():
        return 2, int(min(size, (2 * size + d - 3 * c + 2).max()))
    return 1, int((size - c + 1).max())


class FMIndex:
    """Documents offsets[i]:offsets[i+1] of ``values``, each a set, stored with the shard's rarest value first."""

    def __init__(self, alphabet: np.ndarray, symbol: np.ndarray, bwt: np.ndarray, doc: np.ndarray, at: np.ndarray, sizes: np.ndarray):
        self.alphabet, self.symbol, self.bwt, self.doc, self.at, self.sizes = alphabet, symbol, bwt, doc, at, sizes
        self.n = len(bwt)
        rows = np.argsort(bwt, kind="stable")
        self.keys = bwt[rows].astype(np.int64) * self.n + rows
        # the symbol before each suffix, put at its place, is the text again
        self.start = np.cumsum(sizes) - sizes
        inner = at > 0
        self.text = np.zeros(int(sizes.sum()), np.int32)
        self.text[self.start[doc[inner]] + at[inner] - 1] = bwt[inner]

    @classmethod
    def build(cls, values: np.ndarray, offsets: np.ndarray) -> FMIndex:
        alphabet, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        symbol = np.empty(len(alphabet), np.int32)
        symbol[np.argsort(counts, kind="stable")] = np.arange(1, len(alphabet) + 1)
        sizes = np.diff(offsets)
        doc_of = np.repeat(np.arange(len(sizes)), sizes)
        ids = symbol[inverse]
        order = np.lexsort((ids, doc_of))
        n = len(values) + len(sizes)
        text = np.zeros(n, np.int32)
        text[np.arange(len(values)) + doc_of] = ids[order]
        doc_at = np.repeat(np.arange(len(sizes)), sizes + 1)
        sa = suffix_array(text, int(sizes.max(initial=1)))
        return cls(alphabet, symbol, text[sa - 1], doc_at[sa].astype(np.int32), ramps(sizes + 1)[sa].astype(np.int32), sizes.astype(np.int32))

    def dumps(self) -> bytes:
        head = np.array([self.n, len(self.alphabet), len(self.sizes)], np.int64)
        return zlib.compress(b"".join(x.tobytes() for x in (head, self.alphabet, self.symbol, self.bwt, self.doc, self.at, self.sizes)), 1)

    @classmethod
    def loads(cls, blob: bytes) -> FMIndex:
        raw = zlib.decompress(blob)
        n, k, d = np.frombuffer(raw, np.int64, 3)
        at, parts = 24, []
        for count, kind in ((k, np.int64), (k, np.int32), (n, np.int32), (n, np.int32), (n, np.int32), (d, np.int32)):
            parts.append(np.frombuffer(raw, kind, int(count), at))
            at += int(count) * np.dtype(kind).itemsize
        return cls(*parts)

    def symbols(self, values: np.ndarray) -> np.ndarray:
        """The symbol of each value, 0 for values the index doesn't hold."""
        if not len(self.alphabet):
            return np.zeros(len(values), np.int64)
        i = np.minimum(np.searchsorted(self.alphabet, values), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == values, self.symbol[i], 0).astype(np.int64)

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward-search step: the suffix intervals of the patterns with ``symbol`` put before them."""
        return np.searchsorted(self.keys, symbol * self.n + lo), np.searchsorted(self.keys, symbol * self.n + hi)

    def maximal_spans(self, sym: np.ndarray, begin: np.ndarray, places: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, doc, from, at, length) of the spans of at least least[query] symbols that can't be made longer.

        Query i is sym[begin[i]:], of which the first places[i] are read, right to left. ``from`` and ``at`` are the span's
        places in query and document. Held are, for each query, the ends of patterns that begin at the present place, with
        their suffix intervals; a longer pattern's interval lies within a shorter one's, so an end whose interval equals
        that of the next longer one only stands for spans that go on to the right and is dropped for good. The rows that
        are in an interval, not in the next longer one's, and don't go on to the left are the maximal spans. The work is
        the number of interval steps and of maximal spans, however many documents share a long stretch.
        """
        q = end = lo = hi = np.zeros(0, np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for s in range(int(places.max(initial=0)) - 1, -1, -1):
            here = np.nonzero(places > s)[0]
            c = sym[begin[here] + s]
            here, c = here[c > 0], c[c > 0]
            new_lo, new_hi = self.back(c, np.zeros(len(here), np.int64), np.full(len(here), self.n))
            # the intervals at s+1 were already carried back to s below; the pattern of one symbol is new
            q, end = np.concatenate([q, here]), np.concatenate([end, np.full(len(here), s)])
            lo, hi = np.concatenate([lo, new_lo]), np.concatenate([hi, new_hi])
            keep = hi > lo
            q, end, lo, hi = q[keep], end[keep], lo[keep], hi[keep]
            order = np.lexsort((end, q))
            q, end, lo, hi = q[order], end[order], lo[order], hi[order]
            longer = np.append(q[1:] == q[:-1], False) if len(q) else np.zeros(0, bool)
            same = longer.copy()
            same[:-1] &= (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1]) if len(q) else True
            q, end, lo, hi = q[~same], end[~same], lo[~same], hi[~same]
            if not len(q):
                continue
            longer = np.append(q[1:] == q[:-1], False)
            in_lo, in_hi = np.where(longer, np.append(lo[1:], 0), lo), np.where(longer, np.append(hi[1:], 0), lo)
            before = np.where(s > 0, sym[np.maximum(begin[q] + s - 1, 0)], 0)
            next_lo, next_hi = self.back(before, lo, hi)
            next_hi = np.where(before > 0, next_hi, next_lo)
            going = next_hi - next_lo
            left = going - np.where(longer, np.append(going[1:], 0), 0)  # rows of this end alone that go on to the left
            look = np.nonzero((end - s + 1 >= least[q]) & ((hi - lo) - (in_hi - in_lo) > left))[0]
            for a, b in ((lo, in_lo), (in_hi, hi)):
                width = b[look] - a[look]
                i = np.repeat(look, width)
                row = ramps(width) + a[i]
                stop = (self.bwt[row] != before[i]) | (before[i] == 0)
                i, row = i[stop], row[stop]
                out.append((q[i], self.doc[row].astype(np.int64), np.full(len(i), s), self.at[row].astype(np.int64), end[i] - s + 1))
            alive = going > 0
            q, end, lo, hi = q[alive], end[alive], next_lo[alive], next_hi[alive]
        if not out:
            return (np.zeros(0, np.int64),) * 5
        return tuple(np.concatenate(x) for x in zip(*out))

    def matches(self, values: np.ndarray, offsets: np.ndarray, share: float) -> tuple[np.ndarray, ...]:
        """(query, doc, spans, matched, longest, sim) for the pairs that have ``share`` of all values of either in common.

        Every query set is put in the index's order; values that the index lacks come first, as they are the rarest of all.
        Backward search gives the maximal spans that begin among the leading places in which similar sets must have one
        (``seed_plan``, for query and document alike). The pairs they make are spelled out over the whole sets: every common
        value belongs to one span, so the merged spans cover all that is common, and their cover decides.
        """
        sizes = np.diff(offsets).astype(np.int64)
        query = np.repeat(np.arange(len(sizes)), sizes)
        sym = self.symbols(values)
        sym = sym[np.lexsort((sym, query))]
        begin = offsets[:-1] - offsets[0]
        length, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes[sizes > 0]):
            length[sizes == size], places[sizes == size] = seed_plan(int(size), share)
        q, doc, _, at, _ = self.maximal_spans(sym, begin, places, length)
        a, d = sizes[q], self.sizes[doc].astype(np.int64)
        c = least_common(a, d, share)
        within = np.where(length[q] == 2, 2 * d + a - 3 * c + 2, d - c + 1)
        fits = (c <= np.minimum(a, d)) & (at + length[q] <= within)
        pair = np.unique(q[fits] * max(1, len(self.sizes)) + doc[fits])
        q, doc = np.divmod(pair, max(1, len(self.sizes)))
        # all common values of each pair, in order
        d = self.sizes[doc].astype(np.int64)
        k = np.repeat(np.arange(len(q)), d)
        place = ramps(d)
        wanted = q[k] * (len(self.alphabet) + 1) + self.text[self.start[doc[k]] + place]
        held = query * (len(self.alphabet) + 1) + sym
        spot = np.minimum(np.searchsorted(held, wanted), max(0, len(held) - 1))
        hit = held[spot] == wanted if len(held) else np.zeros(len(wanted), bool)
        k, place, spot = k[hit], place[hit], spot[hit]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (place[1:] != place[:-1] + 1) | (spot[1:] != spot[:-1] + 1)
        heads = np.nonzero(fresh)[0]
        run = np.diff(np.append(heads, len(k)))
        matched = np.bincount(k, minlength=len(q))
        spans = np.bincount(k[heads], minlength=len(q))
        longest = np.zeros(len(q), np.int64)
        np.maximum.at(longest, k[heads], run)
        sim = matched / np.maximum(1, sizes[q] + d - matched)
        ok = sim >= share
        return q[ok], doc[ok], spans[ok], matched[ok], longest[ok], sim[ok]
