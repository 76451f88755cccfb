"""Bags of word shingles and their BagMinHash signatures, for many texts at once.

A shingle of weight w covers the weights [0, w). That line is cut into blocks [0, 1),
[1, 2), [2, 4), [4, 8), … Every shingle and block has a Poisson process of its own whose
points carry a time, a register and a place inside the block; a text meets the points
whose place is below its weight, so the process of a smaller weight is part of that of a
larger one. A register holds the smallest time it has met. Two registers agree with the
probability of the weighted Jaccard similarity. Points come in order of time, and a process
is left as soon as it is later than all registers of its text, which is soon for all but
very short texts.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
POINTS_AT_ONCE = 500_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted shingle hashes of texts; word hashes are kept, up to a bound."""

    def __init__(self, size: int = SHINGLE, kept: int = 300_000) -> None:
        self.size, self.kept = size, kept
        self.words: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        code = self.words.get(word)
        if code is None:
            code = xxhash.xxh3_64_intdigest(word)
            if len(self.words) < self.kept:
                self.words[word] = code
        return code

    def bag(self, text: bytes | None) -> np.ndarray:
        """Hash of every run of ``size`` words, sorted; of all words if there are fewer; none without words."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        codes = np.array([self._hash(word) for word in words], np.uint64)
        width = min(self.size, len(codes))
        runs = len(codes) - width + 1
        total = codes[:runs].copy()
        for k in range(1, width):
            total = mix(total + _GOLDEN) + codes[k : k + runs]
        total = mix(total + np.uint64(width))
        total.sort()
        return total


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def units(bag: np.ndarray) -> np.ndarray:
    """The bag as a set: each repeat of a shingle under a hash of its own, sorted."""
    starts, sizes = _runs(bag)
    nth = np.arange(len(bag)) - np.repeat(starts, sizes)
    found = mix(bag + _GOLDEN * nth.astype(np.uint64))
    found.sort()
    return found


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection of two sorted unit arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Multiset Jaccard of at least so many percent; two empty bags are alike."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = overlap(a, b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _unit_interval(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(bags: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """Register times, one row for each bag; infinite for empty bags."""
    held = np.full(len(bags) * registers, np.inf)
    parts = []
    for number, bag in enumerate(bags):
        starts, sizes = _runs(bag)
        parts.append((np.full(len(starts), number), bag[starts], sizes))
    if not parts:
        return held.reshape(0, registers)
    doc, code, weight = (np.concatenate(x) for x in zip(*parts))
    levels = np.zeros(len(weight), np.int64)
    levels[weight > 1] = np.ceil(np.log2(weight[weight > 1])).astype(np.int64)
    # one process for each shingle and block that its weight reaches
    at = np.repeat(np.arange(len(code)), levels + 1)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    doc, weight = doc[at], weight[at].astype(np.float64)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    size = np.where(level == 0, 1.0, low)
    seed = mix(code[at] + _GOLDEN * level.astype(np.uint64))
    time, drawn, count = np.zeros(len(seed)), np.zeros(len(seed), np.uint64), 1
    while len(seed):
        step = np.arange(1, count + 1, dtype=np.uint64)
        draw = mix(seed[:, None] + _GOLDEN * (drawn[:, None] + step))
        times = time[:, None] + np.cumsum(-np.log(_unit_interval(draw)), axis=1) / (registers * size)[:, None]
        second = mix(draw + _GOLDEN)
        register = ((second & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        place = low[:, None] + (second >> np.uint64(32)).astype(np.float64) / 2.0**32 * size[:, None]
        met = place < weight[:, None]
        np.minimum.at(held, (doc[:, None] * registers + register)[met], times[met])
        latest = held.reshape(-1, registers).max(1)
        time, drawn = times[:, -1], drawn + np.uint64(count)
        live = time < latest[doc]
        seed, time, drawn, doc, weight, low, size = (x[live] for x in (seed, time, drawn, doc, weight, low, size))
        count = max(1, min(2 * count, 64, POINTS_AT_ONCE // max(len(seed), 1)))
    return held.reshape(-1, registers)


def band_codes(times: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One code for each text and band; equal only if all registers of the band are."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, rows)
    code = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + _GOLDEN), (len(times), bands)).copy()
    for row in range(rows):
        code = mix(code + _GOLDEN + mix(bits[:, :, row]))
    return code.view(np.int64)


def short_registers(times: np.ndarray) -> np.ndarray:
    """One byte of each register, enough to estimate a similarity from."""
    return (mix(np.ascontiguousarray(times).view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
