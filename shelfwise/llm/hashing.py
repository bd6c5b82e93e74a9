"""Hashes of words and word shingles of many texts at once, for tasks that work in numpy."""

from __future__ import annotations

import numpy as np

from .common import SHINGLE

#: An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
CHUNK = 1 << 20

_letters = np.zeros(256, bool)
_letters[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _letters[_c] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(texts: list[str]):
    """Index ranges of texts of about CHUNK characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order. Words are runs of a-z, 0-9 and non-ASCII in the text's lower case."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _letters[b]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    if not len(edge):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends = edge[::2], edge[1::2]
    sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)))
    upto = lambda at: np.where(at > 0, sums[np.maximum(at, 1) - 1], np.uint64(0))
    h = mix((upto(ends) - upto(starts)) * powers(INVERSE, len(b))[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    return h, np.searchsorted(first, starts, side="right") - 1


def shingle_sets(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; a text of 1 to n-1 words is one shingle."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        w, of = word_hashes(texts[lo:hi])
        k = hi - lo
        if len(w) >= n:
            g = np.zeros(len(w) - n + 1, np.uint64)
            for j, p in enumerate(powers(BASE, n + 1)[1:].tolist()):
                g += w[j : j + len(g)] * np.uint64(p)
            g = mix(g)[whole := of[n - 1 :] == of[: len(g)]]
            bounds = np.searchsorted(of[: len(whole)][whole], np.arange(k + 1))
        else:
            g, bounds = np.zeros(0, np.uint64), np.zeros(k + 1, np.int64)
        counts = np.bincount(of, minlength=k)
        at = np.concatenate([[0], np.cumsum(counts)])
        for i in range(k):
            if counts[i] >= n:
                out.append(np.unique(g[bounds[i] : bounds[i + 1]]))
            elif counts[i]:
                own = w[at[i] : at[i + 1]]
                out.append(mix(np.array([sum(int(x) * pow(BASE, j + 2, 2**64) for j, x in enumerate(own)) % 2**64], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
