"""Sets of word shingles as sorted 64-bit hashes, computed in blocks with numpy.

Two different shingles of two texts share a hash with a chance of 2**-64 or so;
apart from that, sizes and overlaps are exact.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 19
_ODD = 0xD1342543DE82EF95
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        inverse = pow(_ODD, -1, 1 << 64)
        for name, base in (("up", _ODD), ("down", inverse)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


def _block_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word in a block that starts and ends between words."""
    up, down = _powers(max(len(b), _BLOCK) + 1)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * up[: len(b)])))
    return mix((sums[end] - sums[start]) * down[start]), start


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw`` (UTF-8 bytes, A-Z counting as a-z), and where they start."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        to = min(at + _BLOCK, len(raw))
        if to < len(raw):
            spaces = np.flatnonzero(_SPACE[raw[at:to]])
            if len(spaces):
                to = at + int(spaces[-1]) + 1
            else:  # a word longer than a block
                while to < len(raw) and not _SPACE[raw[to]]:
                    to += 1
        h, s = _block_words(raw[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _combine(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        out = (out ^ h[j : j + n]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return mix(out)


def sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; one for all words where these are fewer than ``width``."""
    out: list[np.ndarray] = []
    group, size = [], 0
    for text in [*texts, None]:
        if text is not None or len(out) + len(group) < len(texts):
            group.append(text or b"")
            size += len(group[-1]) + 1
        if group and (size > _BLOCK or len(out) + len(group) == len(texts)):
            h, at = words(np.frombuffer(b"\n".join(group), dtype=np.uint8))
            cuts = np.searchsorted(at, np.cumsum([0, *(len(g) + 1 for g in group)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                n = b - a
                out.append(np.unique(_combine(h[a:b], min(width, n))) if n else np.zeros(0, np.uint64))
            group, size = [], 0
    return out


def signature(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(np.bitwise_xor.reduce(mix(s ^ _U(0xA0761D6478BD642F)), initial=_U(len(s))).astype(np.int64)) if len(s) else 0
