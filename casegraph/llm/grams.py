"""Anchors: positions of texts that a 50-byte string carries along wherever it occurs."""

from __future__ import annotations

import numpy as np

from .common import _BYTE, MULT, mix

#: Bytes of a match, of a gram, and grams in a match; any match holds the least hash of its own grams.
MATCH, GRAM = 50, 20
SPAN = MATCH - GRAM + 1
#: Bytes of text whose hashes are taken at once.
SLICE_BYTES = 1 << 20
_INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        np.multiply.accumulate(np.full(size - 1, MULT), out=up[1:])
        np.multiply.accumulate(np.full(size - 1, _INVERSE), out=down[1:])
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"][:n], _POWERS["down"][:n]


def window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width bytes: differences of prefix sums, moved back to the same power, finalised."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _tables(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up)))
    return mix((total[width:] - total[:-width]) * down[:n])


def spans(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Unfinished hash of each run raw[first : first + size], the same wherever it stands."""
    up, down = _tables(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[:-1])))
    return (total[first + size] - total[first]) * down[first]


def span_hashes(raw: np.ndarray, first: np.ndarray, size: np.ndarray, sized: bool = False) -> np.ndarray:
    """Hash of each run raw[first : first + size], first ascending, in slices; sized mixes the size in."""
    out = np.empty(len(first), np.uint64)
    edges = np.append(np.unique(np.searchsorted(first, np.arange(0, len(raw), SLICE_BYTES))), len(first)).tolist()
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        if y > x:
            lo, hi = int(first[x]), int((first[x:y] + size[x:y]).max())
            h = spans(raw[lo:hi], first[x:y] - lo, size[x:y])
            out[x:y] = mix(h + size[x:y].astype(np.uint64) if sized else h)
    return out


def _sliding(x: np.ndarray, width: int, fold) -> np.ndarray:
    """Fold of each run of width values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = fold(x[:-step], x[step:])
        have += step
    return x


class Grams:
    """Anchors of concatenated texts: starts are their first bytes. Matches never cross texts."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        h = window_hashes(self.raw, GRAM)
        if len(h) < SPAN:
            self.low = self.least = np.zeros(0, np.uint32)
            self.hashes = np.zeros(0, np.uint64)
            self.at = np.zeros(0, np.int64)
            return
        upper = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))  # the least is by this half; equal ones all are anchors
        self.low = _sliding(upper, SPAN, np.minimum)
        for lo, n in zip(self.start.tolist(), self.size.tolist(), strict=True):  # windows into the next text
            self.low[max(lo, lo + n - MATCH + 1) : lo + n] = 0
        edge = np.zeros(SPAN - 1, np.uint32)
        most = _sliding(np.concatenate((edge, self.low, edge)), SPAN, np.maximum)
        self.at = np.flatnonzero(most == upper)
        self.hashes, self.least = h[self.at], upper[self.at]

    def owners(self) -> np.ndarray:
        return np.searchsorted(self.start + self.size, self.at, side="right")

    def contexts(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the anchors some: first byte and size of what their matches span.

        A match counts for an anchor if the anchor is its least gram; such matches start in one run.
        """
        at, h = self.at[some], self.least[some]
        first, last = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
        for back in range(SPAN):
            s = at - back
            hit = (s >= 0) & (s < len(self.low))
            hit[hit] = self.low[s[hit]] == h[hit]
            first[hit] = s[hit]
            last[hit & (last < 0)] = s[hit & (last < 0)]
        return first, last - first + MATCH
