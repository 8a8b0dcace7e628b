"""Covering codes as anchors of binary fingerprints.

Two perfect codes cover blocks of bits: the binary Golay code (every word of 23 bits lies within 3 bits
of exactly one of its 4096 code words) and the Hamming code (15 bits, within 1 bit, 2048 code words). The
nearest code word is a word's anchor. Words within t bits of each other meet at the anchor of one of
them if the other is replicated to every anchor within the covering radius plus t bits that one of its
neighbours within t bits owns. Bits that stand beside such a block are their own anchor (a code of
covering radius 0).

The 64 bits are cut into blocks with thresholds t_i whose (t_i + 1) add up to more than the link
threshold: then two linked fingerprints differ by at most t_i bits in some block i. Every layout
finds all links; they differ in replicas a fingerprint and in fingerprints an anchor.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
POLYNOMIAL = 0b101011100011
GOLAY, HAMMING = 23, 15

#: (lowest bit, Golay blocks of 23 bits, Hamming blocks of 15 bits, plain bits, threshold). Each adds up for links of up to 4 bits.
#: About 11 replicas a fingerprint and 2^12 anchors a block.
WIDE = ((0, 1, 0, 0, 1), (23, 1, 0, 0, 1), (46, 0, 0, 18, 0))
#: About 32 replicas and 2^19 anchors.
MIDDLE = ((0, 0, 1, 8, 1), (23, 0, 1, 8, 1), (46, 0, 0, 18, 0))
#: About 220 replicas and 2^24 anchors.
DEEP = ((0, 0, 2, 2, 2), (32, 0, 2, 2, 1))
#: The layout up to a number of distinct fingerprints, so that an anchor's share of them stays small.
LAYOUTS = ((1 << 15, WIDE), (1 << 24, MIDDLE))


def layout_for(n: int):
    return next((layout for most, layout in LAYOUTS if n <= most), DEEP)


def _remainder(word: int) -> int:
    for bit in range(GOLAY - 1, 10, -1):
        if word >> bit & 1:
            word ^= POLYNOMIAL << bit - 11
    return word


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each single bit, and the error pattern of up to 3 bits for each remainder."""
    single = np.array([_remainder(1 << b) for b in range(GOLAY)], np.uint64)
    errors = np.zeros(2048, np.uint64)
    for k in range(1, 4):
        for bits in combinations(range(GOLAY), k):
            errors[int(np.bitwise_xor.reduce(single[list(bits)]))] = sum(1 << b for b in bits)
    return single, errors


def golay_anchor(words: np.ndarray) -> np.ndarray:
    """The code word nearest to each 23-bit word."""
    single, errors = _tables()
    rest = np.zeros(words.shape, np.uint64)
    for b in range(GOLAY):
        rest ^= (words >> np.uint64(b) & np.uint64(1)) * single[b]
    return words ^ errors[rest.astype(np.int64)]


@lru_cache(1)
def _syndromes() -> np.ndarray:
    """For each word of 15 bits the number of the bit to flip, counted from 1; 0 for code words."""
    words = np.arange(1 << HAMMING, dtype=np.uint16)
    out = np.zeros(len(words), np.uint8)
    for b in range(HAMMING):
        out ^= (words >> np.uint16(b) & np.uint16(1)).astype(np.uint8) * np.uint8(b + 1)
    return out


def hamming_anchor(words: np.ndarray) -> np.ndarray:
    """The code word nearest to each 15-bit word."""
    wrong = _syndromes()[words.astype(np.int64)].astype(np.uint64)
    return words ^ (np.uint64(1) << wrong >> np.uint64(1))


def homes(values: np.ndarray, golay: int, hamming: int) -> np.ndarray:
    out, at = values, 0
    for size, count, anchor in ((GOLAY, golay, golay_anchor), (HAMMING, hamming, hamming_anchor)):
        for _ in range(count):
            part = values >> np.uint64(at) & np.uint64((1 << size) - 1)
            out = out ^ (part ^ anchor(part)) << np.uint64(at)
            at += size
    return out


def replicas(fingerprints: np.ndarray, layout=WIDE):
    """Per block: (block, home anchors (n,), anchors of all neighbours within the threshold (n, k))."""
    for number, (low, golay, hamming, plain, t) in enumerate(layout):
        width = golay * GOLAY + hamming * HAMMING + plain
        values = fingerprints >> np.uint64(low) & np.uint64((1 << width) - 1)
        flips = [0] + [sum(1 << b for b in bits) for k in range(1, t + 1) for bits in combinations(range(width), k)]
        around = np.stack([homes(values ^ np.uint64(f), golay, hamming) for f in flips], axis=1)
        yield number, around[:, 0], around
