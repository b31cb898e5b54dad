"""64-bit hashes of words and word n-grams of many texts at once, in numpy."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Scripts written without spaces (first and last code point): Thai, Lao, Myanmar, Khmer, kana, Han and their extensions.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
            (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


@cache
def _kinds() -> np.ndarray:
    """For each code point: 0 ends words, 1 belongs to a word (letters, marks, digits), 2 is a word (those of UNSPACED)."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
    for lo, hi in UNSPACED:
        kinds[lo: hi + 1] *= 2
    return kinds


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _STEP
    h ^= h >> np.uint64(29)
    h *= _BASE
    return h ^ (h >> np.uint64(32))


def token_hashes(texts: list[str | None], block: int = 1 << 21) -> list[np.ndarray]:
    """For each text, the hashes of its words: lower-cased runs of letters, marks and digits of any script; in scripts
    without spaces every character is a word.

    Texts are joined to blocks of about *block* bytes; a word's hash is a difference of running sums of character x power.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        b = b"" if t is None else t.lower().encode("utf-32-le", "replace")
        held.append(b)
        size += len(b) + 4
        if size >= block:
            out += _hash_block(held)
            held, size = [], 0
    return out + _hash_block(held) if held else out


def _hash_block(texts: list[bytes]) -> list[np.ndarray]:
    space = " ".encode("utf-32-le")
    data = np.frombuffer(space.join(texts) + space, np.uint32)
    kind = _kinds()[data]
    inside = (kind == 1).astype(np.int8)
    first = np.flatnonzero((np.diff(inside, prepend=0) == 1) | (kind == 2))
    end = np.flatnonzero((np.diff(inside, append=0) == -1) | (kind == 2)) + 1
    run = np.zeros(len(data) + 1, np.uint64)
    # Equal words at different places differ by a power of the base only; it is divided out by the power of the inverse.
    power = _powers(len(data))
    np.cumsum(data.astype(np.uint64) * power, out=run[1:])
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.full(len(data), inverse, np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    hashes = _mix((run[end] - run[first]) * back[first] + (end - first).astype(np.uint64) * _STEP)
    bounds = np.cumsum([len(t) // 4 + 1 for t in texts])
    cut = np.searchsorted(first, bounds)
    return np.split(hashes, cut[:-1])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of *n* words."""
    return pick_hashes(words, tuple(range(n)))


def pick_hashes(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """For each word, the hash of those at *offsets* (ascending, from 0) after it, as long as there are such."""
    m = len(words) - offsets[-1]
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in offsets[1:]:
        h = h * _BASE + words[k: k + m]
    return _mix(h)
