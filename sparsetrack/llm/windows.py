"""Numpy core of the repeated-window operators: anchors, contexts and their hashes.

A *window* is ``width`` consecutive tokens of one document.  Its *anchor* is the smallest (by hash, the rightmost on
ties) of its ``k``-token grams, so equal windows have equal anchors at the same place, wherever they stand.
Neighbouring windows that share one anchor form a *run*: window starts ``lo..hi``, tokens ``lo .. hi + width``.
Everything here is a function of token content alone, so any two machines agree on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from .shared import kept

U = np.uint64
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
BASE2, BASE2_INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
POSITION = U((1 << 24) - 1)  # low bits of an order key hold the place
#: Tokens hashed at once: bounds a worker's memory whatever a document's length.
PIECE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))
_powers: dict[int, np.ndarray] = {}
kept(_powers.clear)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, n + 1 + n // 8)
        have = np.ones(size, U)
        have[1:] = base
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Running polynomial sums; ``span`` makes the hash of any slice from two of them."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int) -> np.ndarray:
    """Hashes of token slices [start, end)."""
    return (sums[end] - sums[start]) * powers(inverse, len(sums))[start]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the runs of bytes other than space, tab, LF, VT, FF and CR."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a text, made piecewise."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + 4 * PIECE)
        if end < len(text):  # not inside a word
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                cut = min((c for c in (text.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if c >= 0), default=len(text) - 1)
            end = cut + 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        start, stop = word_spans(data)
        if len(start):
            out.append(mix(span(prefix(BYTE[data], BASE), start, stop, BASE_INV) + (stop - start).astype(U)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def byte_values(text: bytes) -> np.ndarray:
    return BYTE[np.frombuffer(text, np.uint8)]


class Runs(NamedTuple):
    doc: np.ndarray  #: which of the given documents
    lo: np.ndarray  #: first window start in the document
    hi: np.ndarray  #: last window start in the document
    anchor: np.ndarray  #: hash of the anchor gram
    context: np.ndarray  #: hash of the whole run: its tokens and where the anchor stands in it
    at: np.ndarray  #: anchor's place in the document


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def runs_of(values: np.ndarray, bounds: np.ndarray, width: int, k: int) -> Runs:
    """Runs of the documents ``values[bounds[i]:bounds[i + 1]]``, none of them across a bound."""
    n, w = len(values), width - k + 1
    empty = np.zeros(0, np.int64)
    if n < width:
        return Runs(empty, empty, empty, empty.astype(U), empty.astype(U), empty)
    assert n <= int(POSITION)
    sums, sums2 = prefix(values, BASE), prefix(values, BASE2)
    place = np.arange(n - k + 1)
    gram = mix(span(sums, place, place + k, BASE_INV))
    least = sliding_min((gram & ~POSITION) | (POSITION - place.astype(U)), w)
    at = (POSITION - (least & POSITION)).astype(np.int64)
    which = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = which[: n - width + 1] == which[width - 1 :]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~whole[:-1] | (which[1 : n - width + 1] != which[: n - width])
    first = np.flatnonzero(fresh & whole)
    # a run ends before the next start of a run, or before the first window that isn't whole
    stop = np.flatnonzero(np.concatenate((fresh[1:] | ~whole[1:], [True])) & whole)
    at = at[first]
    doc = which[first]
    context = mix(span(sums2, first, stop + width, BASE2_INV) + mix((stop - first).astype(U) * U(1009) + (at - first).astype(U)))
    return Runs(doc, first - bounds[doc], stop - bounds[doc], gram[at], context, at - bounds[doc])


def batches(items: Iterator[tuple[tuple, np.ndarray]], width: int, k: int, size: int = PIECE) -> Iterator[tuple[list[tuple], Runs]]:
    """Runs of many documents (key, token values), short ones together, long ones in overlapping pieces.

    A piece of a long document gets the tokens of every window that starts in it plus one window more on either side, so
    each run is found whole in the piece in which its anchor lies in the core; runs found in halves elsewhere are left out.
    """
    keys: list[tuple] = []
    parts: list[np.ndarray] = []
    total = 0

    def flush():
        nonlocal keys, parts, total
        if parts:
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            out = keys, runs_of(np.concatenate(parts), bounds, width, k)
            keys, parts, total = [], [], 0
            return [out]
        return []

    for key, values in items:
        if len(values) < width:
            continue
        if len(values) > size:
            halo = 2 * width
            for core in range(0, len(values), size):
                a, b = max(0, core - halo), min(len(values), core + size + halo)
                r = runs_of(values[a:b], np.array([0, b - a]), width, k)
                mine = (r.at + a >= core) & (r.at + a < core + size)
                yield [key], Runs(r.doc[mine], r.lo[mine] + a, r.hi[mine] + a, r.anchor[mine], r.context[mine], r.at[mine] + a)
            continue
        if total + len(values) > size:
            yield from flush()
        keys.append(key)
        parts.append(values)
        total += len(values)
    yield from flush()
