"""An n-gram trie in Elias-Fano levels: roots, what follows each, what stood before it, and what follows both.

A level is a monotone sequence: upper parts in unary with a directory of counts, lower parts at their exact width, both
packed into 64-bit words. Pointers into the next level are monotone sequences too. Entries of the last level are not
words but places among all that follow their shorter context, which takes fewer bits. Probabilities and back-off weights
are quantised logarithms of two bytes. A trie is one file, mapped into memory, and its packed form is what is searched.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from dataclasses import dataclass

import numpy as np

#: Steps of a quantised binary logarithm; a code of two bytes reaches down to 2**-255.
STEPS = 256
#: Bits of a word's hash inside its root.
BITS = 32
#: Keys that are worked on at a time, so that what is made of them stays in a processor's cache.
_AT_ONCE = 1 << 14
_BITS = np.array([[i for i in range(8) if b >> i & 1] + [0] * (8 - bin(b).count("1")) for b in range(256)], np.int64)
_M1, _M2, _M4, _EACH, _TOP = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string, each at a multiple of 8 bytes."""
    out, at, head = [], 8 + 12 * len(arrays) + -(8 + 12 * len(arrays)) % 8, []
    for x in arrays:
        head.append(struct.pack("<4sq", x.dtype.str.encode().ljust(4), x.nbytes))
        out.append(x.tobytes() + bytes(-x.nbytes % 8))
    return (struct.pack("<q", len(arrays)) + b"".join(head)).ljust(at, b"\0") + b"".join(out)


def unpacked(data) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<q", data)
    at, out = 8 + 12 * n + -(8 + 12 * n) % 8, []
    for k in range(n):
        kind, size = struct.unpack_from("<4sq", data, 8 + 12 * k)
        kind = np.dtype(kind.decode().strip())
        out.append(np.frombuffer(data, kind, size // kind.itemsize, at))
        at += size + -size % 8
    return out


def codes(p: np.ndarray) -> np.ndarray:
    """Quantised logarithms of numbers from 0 to 1; 0 has a code of its own."""
    out = np.zeros(len(p), np.uint16)
    some = p > 0
    out[some] = np.clip(np.round(-np.log2(p[some]) * STEPS), 0, 65534) + 1
    return out


def decoded(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 2.0 ** ((1.0 - code) / STEPS), 0.0)


class EliasFano:
    """A sorted sequence of whole numbers below 2**64, as it stands in the file."""

    def __init__(self, head: np.ndarray, low: np.ndarray, upper: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.most = (int(x) for x in head)
        self.low, self.upper, self.ones = low, upper, ones

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        values = np.asarray(values, np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (most // max(1, n)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            bits, at = values & np.uint64((1 << width) - 1), np.arange(n, dtype=np.int64) * width
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, bits << shift)
            np.bitwise_or.at(low, (at >> 6) + 1, np.where(shift > 0, bits >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)))
        high = (values >> np.uint64(width)).astype(np.int64)
        size = (int(high[-1]) if n else 0) + n + 1
        at = high + np.arange(n)
        upper = np.zeros(-(-size // 64), np.uint64)
        np.bitwise_or.at(upper, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
        return [np.array([n, width, most], np.uint64), low, upper, ones]

    def _select(self, k: np.ndarray, bit: bool) -> np.ndarray:
        """Place of the k-th set (or unset) bit, counting from 0, of the upper parts."""
        before = self.ones if bit else np.arange(len(self.ones)) * 64 - self.ones
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), _AT_ONCE):
            own = k[a : a + _AT_ONCE]
            at = np.searchsorted(before, own, "right") - 1
            left = (own - before[at]).astype(np.uint8)
            word = self.upper[at] if bit else ~self.upper[at]
            # set bits of each byte, then of it and all bytes below
            held = word - ((word >> np.uint64(1)) & _M1)
            held = (held & _M2) + ((held >> np.uint64(2)) & _M2)
            held = ((held + (held >> np.uint64(4))) & _M4) * _EACH
            # bytes that hold more than are left keep their highest bit
            more = ((held | _TOP) - (left.astype(np.uint64) + np.uint64(1)) * _EACH) & _TOP
            byte = np.uint64(8) - np.bitwise_count(more)
            shift = byte << np.uint64(3)
            left = left - (((held << np.uint64(8)) >> shift) & np.uint64(255)).astype(np.uint8)
            out[a : a + _AT_ONCE] = at * 64 + shift.astype(np.int64) + _BITS[((word >> shift) & np.uint64(255)).astype(np.uint8), left]
        return out

    def _next(self, place: np.ndarray, k: np.ndarray, bit: bool) -> np.ndarray:
        """Place of the next such bit after the k-th, which is at ``place``: mostly in the same word."""
        word = self.upper[place >> 6]
        shift = (place & 63).astype(np.uint64)
        word = ((word if bit else ~word) >> shift) >> np.uint64(1)
        out = place + 1 + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(word == 0)
        out[far] = self._select(k[far] + 1, bit)
        return out

    def pair(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries at each place and at the one after it."""
        place = self._select(at, True)
        values = ((p - k).astype(np.uint64) << np.uint64(self.width) | self._low(k) for p, k in ((place, at), (self._next(place, at, True), at + 1)))
        first, second = (x.astype(np.int64) for x in values)
        return first, second

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at * self.width
        shift = (bit & 63).astype(np.uint64)
        more = np.where(shift > 0, self.low[(bit >> 6) + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((self.low[bit >> 6] >> shift) | more) & np.uint64((1 << self.width) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, True) - at).astype(np.uint64) << np.uint64(self.width)) | self._low(at)

    def find(self, keys: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The place of each key, or -1; ``lo`` and ``hi`` bound the places of each."""
        out = np.empty(len(keys), np.int64)
        for a in range(0, len(keys), _AT_ONCE):
            part = slice(a, a + _AT_ONCE)
            out[part] = self._find(keys[part], *(None if x is None else x[part] for x in (lo, hi)))
        return out

    def _find(self, keys: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None) -> np.ndarray:
        out = np.full(len(keys), -1)
        ask = np.flatnonzero(keys <= np.uint64(self.most)) if self.n else np.zeros(0, np.int64)
        if not len(ask):
            return out
        key = keys[ask]
        high = (key >> np.uint64(self.width)).astype(np.int64)
        # entries with one upper part stand between two unset bits
        before = np.maximum(high - 1, 0)
        place = self._select(before, False)
        a = np.where(high > 0, place - high + 1, 0)
        b = np.where(high > 0, self._next(place, before, False), place) - high
        if lo is not None:
            a, b = np.maximum(a, lo[ask]), np.minimum(b, hi[ask])
        low, end = key & np.uint64((1 << self.width) - 1), b.copy()
        while (open_ := np.flatnonzero(a < b)).size:  # the first entry that is not smaller
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_], b[open_] = np.where(less, mid + 1, a[open_]), np.where(less, b[open_], mid)
        inside = a < end
        hit = np.flatnonzero(inside)
        hit = hit[self._low(a[hit]) == low[hit]]
        out[ask[hit]] = a[hit]
        return out


@dataclass
class Trie:
    """Roots (last words of contexts), what follows a root, contexts (root and the word before), what follows a context.

    Words are BITS-bit hashes inside the range of their root.
    """

    roots: EliasFano
    totals: EliasFano
    follows: EliasFano
    follow: EliasFano
    contexts: EliasFano
    context: EliasFano
    bases: EliasFano
    triples: EliasFano
    triple: EliasFano
    follow_codes: np.ndarray
    back_codes: np.ndarray
    triple_codes: np.ndarray

    @staticmethod
    def build(roots: np.ndarray, root: np.ndarray, before: np.ndarray, word: np.ndarray, counts: np.ndarray, totals: np.ndarray, strength: tuple[float, float]) -> bytes:
        """``roots`` are sorted hashes; entries (root: a place in them, before, word) are distinct and sorted, with ``counts``.

        ``totals`` has how often each root was followed; an entry's discounted probability after two words is
        c / (c(context) + strength[1]), that after one is c / (total + strength[0]).
        """
        key = lambda x: (root.astype(np.uint64) << np.uint64(BITS)) | x
        pair, back = np.unique(key(word), return_inverse=True)
        pair_count = np.bincount(back, counts, len(pair)).astype(np.int64)
        context, own = np.unique(key(before), return_inverse=True)
        context_count = np.bincount(own, counts, len(context)).astype(np.int64)
        place_of = lambda of: (of >> np.uint64(BITS)).astype(np.int64)
        edge = lambda of: np.searchsorted(place_of(of), np.arange(len(roots) + 1))
        pairs_at, contexts_at = edge(pair), edge(context)
        # the place of a word among all that follow the root stands for it
        size = np.diff(pairs_at)
        bases = np.concatenate([[0], np.cumsum(size * np.diff(contexts_at))])
        at = place_of(context)
        offset = bases[at] + (np.arange(len(context)) - contexts_at[at]) * size[at]
        place = offset[own] + back - pairs_at[root]
        order = np.argsort(place, kind="stable")
        levels = [roots, np.cumsum(totals), pairs_at, pair, contexts_at, context, bases, np.searchsorted(own[order], np.arange(len(context) + 1)), place[order]]
        follow = codes(pair_count / (totals[place_of(pair)] + strength[0]))
        weight = codes(strength[1] / (context_count + strength[1]))
        triple = codes((counts / (context_count[own] + strength[1]))[order])
        return packed(*(x for level in levels for x in EliasFano.encode(level)), follow, weight, triple)

    @staticmethod
    def open(data: bytes) -> Trie:
        """The trie in a file of its own, which goes with the last use of it."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            x = unpacked(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        return Trie(*(EliasFano(*x[4 * k : 4 * k + 4]) for k in range(9)), *x[36:])

    def total(self, root: np.ndarray) -> np.ndarray:
        """How often each root (hash) was followed; 0 if it is not known."""
        at = self.roots.find(root)
        seen = np.flatnonzero(at >= 0)
        out = np.zeros(len(root), np.int64)
        upto = self.totals[at[seen]].astype(np.int64)
        first = at[seen] > 0
        upto[first] -= self.totals[at[seen][first] - 1].astype(np.int64)
        out[seen] = upto
        return out

    def _places(self, level: EliasFano, edges: EliasFano, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the distinct keys (root's place and word) in a level: root, place or -1, and where the root's own range begins; then which of them each key is."""
        key, back = np.unique(keys, return_inverse=True)
        used, own = np.unique((key >> np.uint64(BITS)).astype(np.int64), return_inverse=True)
        lo, hi = (x[own] for x in edges.pair(used))
        return used[own], level.find(key, lo, hi), lo, back

    def probabilities(self, root: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of each (root, before, word), decoded: after both words, after the root alone, and the context's back-off weight; 0, 0 and 1 where nothing is known.

        Each level is asked once for each distinct key, however many entries have it.
        """
        triple, follow, weight = np.zeros(len(root)), np.zeros(len(root)), np.ones(len(root))
        fresh = np.ones(len(root), bool)
        fresh[1:] = root[1:] != root[:-1]
        first = np.flatnonzero(fresh)
        distinct, back = np.unique(root[first], return_inverse=True)
        r = np.repeat(self.roots.find(distinct)[back], np.diff(np.append(first, len(root))))
        at = np.flatnonzero(r >= 0)
        key = lambda x: (r[at].astype(np.uint64) << np.uint64(BITS)) | x[at]
        _, pair, lo, of_pair = self._places(self.follow, self.follows, key(word))
        follow[at] = np.where(pair >= 0, decoded(self.follow_codes[pair]) if self.follow.n else 0.0, 0.0)[of_pair]
        own, context, low, of_context = self._places(self.context, self.contexts, key(before))
        weight[at] = np.where(context >= 0, decoded(self.back_codes[context]) if self.context.n else 1.0, 1.0)[of_context]
        # where the entries of each known context begin: in numbers, and in places
        seen = np.flatnonzero(context >= 0)
        used, mine = np.unique(own[seen], return_inverse=True)
        begin, end = self.follows.pair(used)
        offset, a, b = (np.zeros(len(context), np.int64) for _ in range(3))
        offset[seen] = self.bases[used].astype(np.int64)[mine] + (context[seen] - low[seen]) * (end - begin)[mine]
        a[seen], b[seen] = self.triples.pair(context[seen])
        both = np.flatnonzero((pair >= 0)[of_pair] & (context >= 0)[of_context])
        number, which = np.unique(offset[of_context[both]] + (pair - lo)[of_pair[both]], return_inverse=True)
        from_, to = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        from_[which], to[which] = a[of_context[both]], b[of_context[both]]
        place = self.triple.find(number.astype(np.uint64), from_, to)
        triple[at[both]] = np.where(place >= 0, decoded(self.triple_codes[place]) if self.triple.n else 0.0, 0.0)[which]
        return triple, follow, weight
