"""Word shingles of whole texts as sorted 64-bit hashes, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 16
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base & MASK)
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, 2 * _CHUNK + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), 2 * _CHUNK + 1)


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, in order."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    out, rest = [], b""
    for at in range(0, max(len(raw), 1), _CHUNK):
        part = rest + raw[at:at + _CHUNK]
        rest = b""
        if at + _CHUNK < len(raw):  # a word cut by the slice goes to the next one
            cut = max(part.rfind(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) + 1
            part, rest = part[:cut], part[cut:]
            if len(rest) > _CHUNK:  # a word longer than a slice
                return _plain(raw)
        out.append(_hashes(part))
    return np.concatenate(out)


def _hashes(part: bytes) -> np.ndarray:
    a = np.frombuffer(part, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = ~_SPACE[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _UP[:len(a)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _DOWN[start] + mix((end - start).astype(np.uint64)))


def _plain(raw: bytes) -> np.ndarray:
    """The same hashes word by word, for texts with words longer than a slice."""
    out = []
    for word in raw.split():
        total, power = 0, 1
        for at in range(0, len(word), _CHUNK):
            a = np.frombuffer(word[at:at + _CHUNK], np.uint8).astype(np.uint64) + np.uint64(1)
            total = (total + int((a * _UP[:len(a)]).sum(dtype=np.uint64)) * power) & MASK
            power = power * int(_UP[_CHUNK]) & MASK
        out.append((total + int(mix(np.array([len(word)], np.uint64))[0])) & MASK)
    return mix(np.array(out, np.uint64))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run; none without words."""
    if not text:
        return np.empty(0, np.uint64)
    words = word_hashes(text)
    if len(words) == 0:
        return np.empty(0, np.uint64)
    n = max(len(words) - width + 1, 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        total = mix(total + words[k:k + n] + np.uint64(k + 1))
    if len(words) < width:
        total = mix(total + np.uint64(1000 + len(words)))
    return np.unique(total)
