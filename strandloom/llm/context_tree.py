"""Context-tree weighting over bytes, decomposed into binary decisions.

A text is coded as the bytes of its lower-cased words, one space apart, and a closing byte. A byte
is eight binary decisions; decision z (1..255, the bits so far behind a leading one) has a context
tree of its own over the preceding bytes, up to `DEPTH` of them. Every node s keeps a
Krichevsky-Trofimov estimate; the weighted probability of its data is the even mixture of the
estimate at s and the product over its children, and the code length of a byte mixes the estimates
of all depths on its path by the posterior weights that follow.

Every context is kept. The tree is cut at depth `CUT`: the subtrees below are weighed apart (`subtrees`,
`solved`), and `crown` weighs what is above from their sums: 256 contexts by 255 decisions at most,
whatever the corpus.

A key is one integer: the context, the latest byte in the highest place, and the byte that follows
in the lowest, so that a shorter context is a shift.
"""

from __future__ import annotations

import math

import numpy as np

DEPTH = 5
#: Subtrees hang from contexts of so many bytes; the contexts above them fit one dense table.
CUT = 2
#: Bits of one byte of a context.
BITS = 8
END = 0xFF


def coded(words: list[bytes]) -> bytes:
    return b" ".join(words) + bytes([END])


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """The key of every byte of coded texts in a row.

    Bytes of a context are kept as their complement: the closing byte, and all that lies before it, is 0.
    """
    past = (data ^ END).astype(np.int64)
    out = data.astype(np.int64)
    for d in range(1, depth + 1):
        out[d:] |= past[:-d] << BITS * (depth + 1 - d)
    # what lies beyond the last closing byte belongs to another text
    ends = np.flatnonzero(data == END)
    for d in range(1, depth):
        at = ends + d
        out[at[at < len(data)]] &= (-1 << BITS * (depth + 1 - d)) | 255
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order; sorting integers is several times faster than numpy's hashing of them."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2, by Stirling's series eight steps up."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    inv = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - inv * (1 / 360 - inv / 1260)) / y - shift


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi)


def _levels(keys: np.ndarray, counts: np.ndarray, depth: int):
    """Per depth from the deepest to CUT: distinct (context, byte) keys in order, counts, and their places one depth up."""
    out = [(keys, counts.astype(np.float64))]
    up = []
    for _ in range(depth - CUT):
        k, c = out[-1]
        above, where = np.unique(k >> BITS + 8 << 8 | k & 255, return_inverse=True)
        out.append((above, np.bincount(where, c, len(above))))
        up.append(where)
    return out, up


def _decisions(rows, up, level: int):
    """Per depth, deepest first: (context, decision) keys, zeros, ones, ln of own estimate, of the product below and weighted."""
    out, places, below = [], None, None
    for i, (k, c) in enumerate(rows):
        z = k >> 8 << 8 | 1 << level | (k & 255) >> 8 - level
        first = np.flatnonzero(np.concatenate(([True], z[1:] != z[:-1])))
        here = np.zeros(len(z), np.int64)
        here[first[1:]] = 1
        here = np.cumsum(here)
        one = k >> 7 - level & 1 == 1
        b = np.bincount(here[one], c[one], len(first)).astype(np.float64)
        a = np.bincount(here[~one], c[~one], len(first)).astype(np.float64)
        own = _estimate(a, b)
        if i:
            below = np.bincount(here[up[i - 1][places]], out[-1][5], len(first))
            weighted = np.logaddexp(own, below) - math.log(2)
        else:
            below, weighted = own, own
        places = first
        out.append((z[first], a, b, own, below, weighted))
    return out


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(context of CUT bytes, decision) keys, zeros, ones and ln of the weighted probability, from whole subtrees of distinct keys in order."""
    rows, up = _levels(keys, counts, depth)
    parts = [_decisions(rows, up, level)[-1] for level in range(8)]
    return tuple(np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 5))


def crown(keys: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(end, mixed, rest) by context of CUT - 1 bytes and decision, from sums over the subtrees below each.

    end is the probability of a one where no deeper context was seen; mixed and rest enter the subtrees.
    """
    held = []
    for d in range(CUT - 1, -1, -1):
        shape = (1 << BITS * d, 256)
        if d == CUT - 1:
            n_a, n_b, below = (np.bincount(keys, x, shape[0] * 256).astype(np.float64).reshape(shape) for x in (a, b, w))
        else:
            n_a, n_b, below = (x.reshape(shape[0], -1, 256).sum(1) for x in (n_a, n_b, weighted))
        own = _estimate(n_a.ravel(), n_b.ravel()).reshape(shape)
        weighted = np.logaddexp(own, below) - math.log(2)
        weighted[n_a + n_b == 0] = 0
        stop = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
        held.append(((n_a + n_b).any(1), (n_b + 0.5) / (n_a + n_b + 1), stop))
    end = mixed = rest = None
    for d, (seen, kt, stop) in enumerate(reversed(held)):
        if d:
            end, mixed, rest = (np.repeat(x, 1 << BITS, axis=0) for x in (end, mixed, rest))
            seen = seen[:, None]
            end = np.where(seen, mixed + rest * kt, end)
            mixed, rest = mixed + rest * stop * kt, rest * (1 - stop)
        else:
            end, mixed, rest = kt, stop * kt, 1 - stop
    return end, mixed, rest


def solved(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, depth: int, model: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 of the probability of each asked key, in order, from the whole subtrees they fall into."""
    end, mixed, rest = model
    contexts_at = [asked >> 8 + BITS * i for i in range(depth - CUT + 1)]
    total = np.zeros(len(asked))
    rows, up = _levels(keys, counts, depth)
    there = []
    for (k, _), c in zip(rows, contexts_at):
        known = distinct(k >> 8)
        at = np.minimum(np.searchsorted(known, c), max(len(known) - 1, 0))
        there.append(known[at] == c if len(known) else np.zeros(len(c), bool))
    top = contexts_at[-1] >> BITS
    for level in range(8):
        z = 1 << level | (asked & 255) >> 8 - level
        m, r, p = mixed[top, z], rest[top, z], end[top, z]
        nodes = _decisions(rows, up, level) if len(keys) else []
        for i in range(len(nodes) - 1, -1, -1):
            known, a, b, own, below, _ = nodes[i]
            want = contexts_at[i] << 8 | z
            # questions that share a context and the bits so far stand together
            first = np.flatnonzero(np.concatenate(([True], want[1:] != want[:-1])))
            again = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(want))))
            at = np.minimum(np.searchsorted(known, want[first]), len(known) - 1)
            met = known[at] == want[first]
            kt = np.where(met, ((b + 0.5) / (a + b + 1))[at], 0.5)[again]
            stop = np.where(met, (1 / (1 + np.exp(np.clip(below - own, -700, 700))))[at], 0.5)[again]
            p = np.where(there[i], m + r * kt, p)
            m, r = m + r * stop * kt, r * (1 - stop)
        p = np.clip(p, 1e-12, 1 - 1e-12)
        total += np.log10(np.where(asked >> 7 - level & 1 == 1, p, 1 - p))
    return total


def plain_score(text: bytes, counts: dict, depth: int) -> float:
    """One text by the textbook recursion on counts[context, latest byte first] -> 256 counts: for tests."""
    nodes = set(counts)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def ab(s, z):
        level = z.bit_length() - 1
        width = 256 >> level
        lo = (z - (1 << level)) * width
        c = counts[s]
        return sum(c[lo : lo + width // 2]), sum(c[lo + width // 2 : lo + width])

    kids = {s: [t for t in nodes if len(t) == len(s) + 1 and t[:-1] == s] for s in nodes}
    memo = {}

    def weighted(s, z):
        if (s, z) not in memo:
            own = kt(*ab(s, z))
            if not kids[s]:
                memo[s, z] = own, None
            else:
                prod = sum(weighted(k, z)[0] for k in kids[s])
                hi = max(own, prod)
                memo[s, z] = hi + math.log(0.5 * math.exp(own - hi) + 0.5 * math.exp(prod - hi)), own - prod
        return memo[s, z]

    total = 0.0
    for i, byte in enumerate(text):
        past = (bytes([END]) * depth + text[:i])[::-1]
        path = [past[:d] for d in range(depth + 1) if past[:d] in nodes]
        z = 1
        for level in range(7, -1, -1):
            bit = byte >> level & 1
            q = None
            for s in reversed(path):
                a, b = ab(s, z)
                p = (b + 0.5) / (a + b + 1)
                if q is None:
                    q = p
                else:
                    ratio = math.exp(max(-700, min(700, weighted(s, z)[1])))
                    q = (ratio * p + q) / (ratio + 1)
            total += math.log10(q if bit else 1 - q)
            z = z << 1 | bit
    return total
