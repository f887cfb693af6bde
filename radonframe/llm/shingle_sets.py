"""SimHash fingerprints of shingle sets, cut into segments of which sets with a Jaccard similarity of 0.8 or more share one.

The fingerprint has ``POOL`` bits: bit i is 1 if it is in over half of the set's hashes under a function of its own. Two sets of similarity J differ in a
bit with a probability of about acos(2 J / (1 + J)) / pi, 0.152 at 0.8, one text within the other included; ``SHARES`` has the worst exact
figures, which small sets decide. A segment is a choice of some of the bits, and its place is their values: entries meet where all
bits of a segment agree. Choices are cut from permutations of the fingerprint, as many as it takes for two sets at 0.8 to agree in
none with a probability of ``MISS`` only: 16 bits take 208 segments (236 for sets of up to 50 shingles, 415 for up to 5). Longer segments, for larger
tables, are more (22 bits: 709): no list of places grows with the length of texts, and meetings by chance do not grow with the table.

``forest`` takes the entries of a bucket, those that agree in a few bits, and links those that share a segment of 16 bits and are near in all bits. Buckets
are such places of ``table_bits`` bits, 3 at least, in as many tables as it takes (13 for 3 bits); each table has its choice of segments, so that a pair at 0.8, which is
together in half of the tables or so, is missed with a probability of ``MISS`` in all.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

WORDS = 16  # 64-bit words of a fingerprint
POOL = 64 * WORDS
LEAST_BITS, MOST_BITS = 16, 32
LEAST_TABLE_BITS, BUCKET = 3, 1 << 15  # entries of a bucket
MISS = 1.5e-5
#: Largest size and, at 0.8, the largest probability that a bit differs. The other set of a pair with 40 shingles has up to 50.
SHARES = ((5, 0.1875), (50, 0.1612), (2**62, 0.1552))
_EPS = 1e-9
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes of each row have each bit: (rows, 64)."""
    out = np.zeros((len(hashes), 8, 8), np.int64)
    for at in range(0, hashes.shape[1], 1 << 14):
        some = hashes[:, at : at + (1 << 14)]
        cuts = np.arange(0, some.shape[1], 255)
        for k in range(8):  # bit k of each byte; up to 255 of them add up within their bytes
            sums = np.add.reduceat((some >> np.uint64(k)) & np.uint64(0x0101010101010101), cuts, axis=1)
            out[:, :, k] += sums.view(np.uint8).reshape(len(hashes), -1, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(len(hashes), 64)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` hashes for each hash, one row for each."""
    return mixed(hashes[None, :] + (_STEP * np.arange(1, words + 1, dtype=np.uint64))[:, None])


def sketch(elements: np.ndarray) -> np.ndarray:
    """The SimHash bits of a set of distinct 64-bit hashes, as ``WORDS`` words."""
    total = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(elements), 1 << 13):
        total += ones(widened(elements[at : at + (1 << 13)], WORDS))
    return packed(2 * total > len(elements))


@cache
def segments(bits: int, share: float) -> int:
    """How many segments two fingerprints take to share one but for ``MISS``, if each of their bits differs with a probability of ``share``."""
    of, d = math.lgamma, range(POOL - bits + 1)
    chance = np.exp([of(POOL + 1) - of(x + 1) - of(POOL - x + 1) + x * math.log(share) + (POOL - x) * math.log1p(-share) for x in d])
    agree = np.exp([of(POOL - x + 1) - of(POOL - x - bits + 1) - of(POOL + 1) + of(POOL - bits + 1) for x in d])
    low, high = 0, 1 << 20
    while high - low > 1:
        n = (low + high) // 2
        low, high = (n, high) if (chance * (1 - np.minimum(agree, 1)) ** n).sum() > MISS else (low, n)
    return high


@cache
def choices(bits: int, n: int) -> np.ndarray:
    """The bits of each of ``n`` segments: permutations of the fingerprint, cut."""
    each = POOL // bits
    turns = [np.argsort(mixed(np.arange(k * POOL, (k + 1) * POOL, dtype=np.uint64) + _STEP))[: each * bits] for k in range(-(-n // each))]
    return np.concatenate(turns).reshape(-1, bits)[:n]


def bits_for(entries: int) -> int:
    """Bits of a segment for so many entries: two to four of them are at a place by chance in large tables, fewer in small ones."""
    return min(max(math.ceil(math.log2(max(entries, 1))) - 2, LEAST_BITS), MOST_BITS)


def rounds(bits: int, most: int) -> int:
    """In how many parts of at most ``most`` segments of large sets the segments are taken."""
    return -(-segments(bits, SHARES[-1][1]) // most)


def places_of(sketches: np.ndarray, sizes: np.ndarray, bits: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of fingerprints (rows, ``WORDS``) in one of the parts of their segments: the segment and its bits. Empty sets have none."""
    counts = [segments(bits, share) for _, share in SHARES]
    at, spread = choices(bits, counts[0]), np.unpackbits(sketches.view(np.uint8), axis=1, bitorder="little")
    rows, places, done = [], [], 0
    for (most, _), n in zip(SHARES[::-1], counts[::-1], strict=True):  # smaller sets have those of larger ones and more
        lo, hi = done + (n - done) * part // parts, done + (n - done) * (part + 1) // parts
        own = np.flatnonzero((sizes > 0) & (sizes <= most))
        if len(own) and hi > lo:
            values = np.zeros((len(own), hi - lo, 8), np.uint8)
            values[:, :, : -(-bits // 8)] = np.packbits(spread[own][:, at[lo:hi]], axis=2, bitorder="little")
            rows.append(np.repeat(own, hi - lo))
            places.append((values.view("<u8")[:, :, 0] | (np.arange(lo, hi, dtype=np.uint64) << np.uint64(32))).ravel())
        done = n
    return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.uint64), *places])


def places(elements: np.ndarray, bits: int = LEAST_BITS) -> np.ndarray:
    """The places of a set of distinct 64-bit hashes, one for each segment; none for an empty set."""
    return places_of(sketch(elements)[None, :], np.array([len(elements)]), bits)[1]


def table_bits(entries: int) -> int:
    """Bits of a bucket's place for so many entries: about ``BUCKET`` of them or fewer share one by chance."""
    return min(max(math.ceil(math.log2(max(entries, 1) / BUCKET)), LEAST_TABLE_BITS), LEAST_BITS)


def limits(bits: int, deviations: float = 6) -> np.ndarray:
    """For each of ``SHARES``, by the size of the larger set: bits of so many in which two sets at 0.8 differ, plus ``deviations`` standard deviations."""
    return np.array([math.floor(bits * x + deviations * math.sqrt(bits * x * (1 - x))) for _, x in SHARES])


class _Forest:
    """Edges between entries that sizes and fingerprints do not rule out, at most one less than entries."""

    def __init__(self, sizes: np.ndarray, sketches: np.ndarray, similarity: float):
        self.sizes, self.sketches, self.similarity = sizes, sketches, similarity
        self.first, self.all = limits(128), limits(POOL)
        self.label, self.edges = np.arange(len(sizes)), []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 1 << 15):
            self._link(a[at : at + (1 << 15)], b[at : at + (1 << 15)])

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        a, b = a[apart], b[apart]
        low, high = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        keep = low >= self.similarity * high - _EPS
        a, b, tier = a[keep], b[keep], np.searchsorted([x for x, _ in SHARES], high[keep])
        for words, most in ((2, self.first), (WORDS, self.all)):
            near = np.bitwise_count(self.sketches[a, :words] ^ self.sketches[b, :words]).sum(axis=1) <= most[tier]
            a, b, tier = a[near], b[near], tier[near]
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for i, j, x, y in zip(a.tolist(), b.tolist(), self.label[a].tolist(), self.label[b].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                self.edges.append((i, j))
        if up:
            to = np.arange(len(self.label))
            to[list(up)] = [root(x) for x in list(up)]
            self.label = to[self.label]

    def link_all(self) -> None:
        """All pairs."""
        x, y = self.sketches[:, 0].copy(), self.sketches[:, 1].copy()
        for lo in range(0, len(x), 64):
            hi = lo + 64
            near = np.bitwise_count(x[lo:hi, None] ^ x[None, lo:]) + np.bitwise_count(y[lo:hi, None] ^ y[None, lo:]) <= self.first.max()
            i, j = np.nonzero(near & (self.label[lo:hi, None] != self.label[None, lo:]))
            self.link(lo + i[j > i], lo + j[j > i])


def forest(sizes: np.ndarray, sketches: np.ndarray, similarity: float, table: int = 0, dense: int = 8) -> np.ndarray:
    """(a, b), rows of the fingerprints: a spanning forest of the pairs that share a segment of the table and are near in size and in all bits.

    Where a segment has more than ``dense`` pairs for each entry still to compare, all pairs of entries are compared at once.
    """
    counts = [segments(LEAST_BITS, share) for _, share in SHARES]
    at, number = (choices(LEAST_BITS, counts[0]) + 37 * table) % POOL, np.array(counts)[np.searchsorted([x for x, _ in SHARES], sizes)]
    spread = np.ascontiguousarray(np.unpackbits(np.ascontiguousarray(sketches).view(np.uint8), axis=1, bitorder="little").T)
    trees = _Forest(sizes, sketches, similarity)
    for k in range(counts[0]):
        own = np.flatnonzero((number > k) & (sizes > 0))
        if len(own) < 2:
            continue
        key = np.zeros(len(sizes), np.uint16)
        for x, bit in enumerate(at[k]):
            key |= spread[bit].astype(np.uint16) << np.uint16(x)
        order = own[np.argsort(key[own], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        trees.link(order[:-1][same], order[1:][same])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        lengths, label = np.diff(starts, append=len(order)), trees.label[order]
        mixed_runs = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        if (lengths * (lengths - 1) // 2)[mixed_runs].sum() > dense * len(own):
            trees.link_all()
            break
        left = np.repeat(mixed_runs, lengths)
        run, order, step = np.repeat(np.arange(len(starts)), lengths)[left], order[left], 2
        at_run = np.arange(len(order))
        while len(at_run := at_run[: np.searchsorted(at_run, len(order) - step)]) and len(at_run := at_run[run[at_run] == run[at_run + step]]):
            trees.link(order[at_run], order[at_run + step])
            step += 1
    return np.array(trees.edges, np.int64).reshape(-1, 2)


def similar(a: np.ndarray, b: np.ndarray, t: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``t``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < t * len(b) - _EPS:
        return len(a) == len(b)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both >= t * (len(a) + len(b) - both) - _EPS
