"""Vectorised hashes over the bytes and words of many texts at once (numpy, 64 bits, wrapping)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Units that are hashed at a time where a sequence may be of any length; places in a block fit into ``_POSITION_BITS``.
BLOCK = 1 << 20
_POSITION_BITS = 22
_kept = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to n at least. Long tables aren't kept."""
    global _kept
    if len(_kept[0]) > n:
        return _kept
    steps = [np.full((1 << int(n).bit_length()) + 1, b, np.uint64) for b in (_BASE, _INVERSE)]
    for x in steps:
        x[0] = 1
        np.cumprod(x, dtype=np.uint64, out=x)
    if n <= 2 * BLOCK:
        _kept = tuple(steps)
    return steps[0], steps[1]


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit values, equal for equal ranges."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word's index of each text and one past the last's.

    ``word_bytes`` says of each byte value whether it belongs to words; words end with their text.
    """
    inside = word_bytes[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[edges] = inside[edges]
    ends[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys."""
    if len(keys) < w:
        return np.zeros(0, keys.dtype)
    done, out = 1, keys
    while done * 2 <= w:
        out = np.minimum(out[done:], out[:-done])
        done *= 2
    rest = w - done
    return np.minimum(out[rest:], out[: len(out) - rest]) if rest else out


def range_hashes(values: Callable[[int, int], np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges in the order of their starts, equal for equal ranges, about a block of units at a time.

    ``values`` gives the values of the units from one place to another; ranges are of any lengths.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(starts, low + BLOCK)))
        high = int(ends[at:upto].max())
        while high > low + 2 * BLOCK and upto > at + 1:  # a range of more than a block stands alone
            upto = at + (upto - at) // 2
            high = int(ends[at:upto].max())
        out[at:upto] = Rolling(values(low, high)).ranges(starts[at:upto] - low, ends[at:upto] - low)
        at = upto
    return out


def anchor_runs(
    values: Callable[[int, int], np.ndarray], gram: int, bounds: np.ndarray, window: int, allowed: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: of each window's grams, the one with the least hash is its anchor.

    Equal windows have equal anchors at equal places. ``values`` gives the values of the units from one
    place to another, ``bounds`` holds where the sequences begin, and the end; ``window`` and ``gram`` are
    lengths in units. Returns, for each run of windows of one sequence with a common anchor: the first
    window's start, their number, the anchor's place and its hash. Long sequences are taken in blocks, so
    that memory doesn't grow with them; a run that crosses blocks comes as two. With ``allowed``, which says of
    each unit whether a gram there may be an anchor, windows without such a gram have none, and are left out.
    """
    n, w = int(bounds[-1]), window - gram + 1
    low, none = np.uint64((1 << _POSITION_BITS) - 1), np.uint64((1 << 64) - 1)  # no place in a block has all bits set
    out: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(n - window + 1, 0), BLOCK):
        high = min(begin + BLOCK + window - 1, n)
        grams = Rolling(values(begin, high)).grams(gram)
        ordered = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        if allowed is not None:
            ordered[allowed[begin : begin + len(grams)] == 0] = none
        least = sliding_min(ordered, w)
        valid = np.zeros(len(least) + 1, np.int32)
        a = np.clip(bounds[:-1] - begin, 0, len(least))
        b = np.clip(bounds[1:] - window + 1 - begin, 0, len(least))
        real = b > a
        np.add.at(valid, a[real], 1)
        np.add.at(valid, b[real], -1)
        at = np.flatnonzero((np.cumsum(valid)[:-1] > 0) & (least != none))
        if not len(at):
            continue
        anchor = (least[at] & low).astype(np.int64)
        text = np.searchsorted(bounds, at + begin, "right")
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]))))
        out.append((at[new] + begin, np.diff(np.append(new, len(at))), anchor[new] + begin, grams[anchor[new]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
