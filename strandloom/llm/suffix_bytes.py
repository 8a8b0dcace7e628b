"""Byte-level kernels of the suffix order: anchors, window runs and window digits.

A window is a suffix cut to its first `width` bytes. Its anchor is the gram of `gram` bytes
with the smallest hash that lies inside it, the leftmost of equals. Equal windows hold the
same anchor at the same place, so the anchor may be read as the first digit of a window.

In a text of a short period the anchor moves with every window; such runs repeat inside the text and
are told apart by `span`, which names all that a run covers.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 22
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as one integer."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for shift in range(8):
        part = data[shift : shift + (n - shift + 7) // 8 * 8]
        out[shift::8] = part[: len(part) // 8 * 8].view(np.uint64)[: len(out[shift::8])]
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes (a multiple of 8) from every position."""
    words = _words(data)
    n = len(data) - gram + 1
    out = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        out += words[at : at + n]
        out *= _A
        out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _named(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` bytes (a multiple of 8) from some positions."""
    out = np.zeros(len(at), np.uint64)
    for k in range(0, width, 8):
        out += words[at + k]
        out *= _B
        out ^= out >> np.uint64(31)
    out *= _C
    return out ^ out >> np.uint64(32)


def window_runs(text: bytes, width: int, gram: int):
    """Runs of neighbouring windows that share an anchor: (start, windows, anchor, gram, span) arrays.

    gram is the hash of the anchor's bytes, span that of all bytes of the run: its first and last windows overlap.
    """
    out = []
    n_windows = len(text) - width + 1
    low = np.uint64((1 << 24) - 1)
    for base in range(0, max(n_windows, 0), CHUNK):
        data = np.frombuffer(text, np.uint8, min(len(text) - base, CHUNK + width - 1), base)
        hashes = gram_hashes(data, gram)
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        at = (_sliding_min(ranked, width - gram + 1) & low).astype(np.int64)
        cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        n = np.diff(np.append(cut, len(at)))
        words = _words(data)
        span = _named(words, cut, width) * _D + _named(words, cut + n - 1, width)
        span = (span ^ span >> np.uint64(33)) * _A + n.astype(np.uint64)
        out.append((cut + base, n, at[cut] + base, hashes[at[cut]].view(np.int64), span.view(np.int64)))
    if not out:
        return (np.empty(0, np.int64),) * 5
    return tuple(np.concatenate(c) for c in zip(*out))


def folded(start, n, off, gram, span, width: int):
    """Runs with the copies inside one text counted on the first, and the stretches (a, b) that such copies cover.

    Copies agree in all their bytes and in the anchor's place.
    """
    _, first, of, count = np.unique(span + off * 0x9E3779B1, return_index=True, return_inverse=True, return_counts=True)
    if len(first) == len(start):
        return (start, n, off, gram, span), np.ones(len(start), np.int64), np.empty((0, 2), np.int64)
    again = count[of] > 1
    a, b = start[again], (start + n - 1 + width)[again]
    far = np.maximum.accumulate(b)
    new = np.flatnonzero(np.concatenate(([True], a[1:] > far[:-1])))
    stretches = np.stack((a[new], far[np.append(new[1:], len(a)) - 1]), axis=1)
    return tuple(x[first] for x in (start, n, off, gram, span)), count, stretches
