"""Vectorised word and shingle hashing over UTF-8 bytes, for operators that run in Python workers.

A batch of texts is laid out as one byte buffer and hashed with a handful of numpy passes, so the cost per
byte does not depend on how long the single documents are. Separators and case folding are ASCII only, which
makes byte-wise handling of UTF-8 exact.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: ASCII lower-casing of A-Z only, every other byte unchanged.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that end a word: space and tab to carriage return.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, *range(9, 14)]] = True

#: Bytes that are hashed at once: a worker's arrays stay at a few MB however long the texts are.
BLOCK = 1 << 18
_pow_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64, grown by doubling; n is at most BLOCK + 1."""
    if len(_pow_cache.get("f", ())) < n:
        size = min(BLOCK + 1, 1 << max(16, int(n - 1).bit_length()))
        for key, b in (("f", _BASE), ("i", _BASE_INV)):
            p = np.ones(size, dtype=_U)
            p[1:] = b
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            _pow_cache[key] = p
    return _pow_cache["f"], _pow_cache["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that order by hash is order at random."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_spans(buf: np.ndarray, blanks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of every maximal run of bytes that are not blanks."""
    word = np.empty(len(buf) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~blanks[buf]
    d = np.diff(word)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _sums(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of each span's bytes in an odd base, for spans in a buffer of at most BLOCK bytes."""
    fwd, inv = _powers(len(buf) + 1)
    pre = np.empty(len(buf) + 1, dtype=_U)
    pre[0] = 0
    np.cumsum((buf.astype(_U) + _U(1)) * fwd[: len(buf)], out=pre[1:])
    return (pre[end] - pre[start]) * inv[start]


def _long_sum(buf: np.ndarray) -> np.uint64:
    """The polynomial of one span of any length, block by block."""
    total, shift = 0, 1
    for low in range(0, len(buf), BLOCK):
        part = buf[low : low + BLOCK]
        total += shift * int(_sums(part, np.array([0]), np.array([len(part)]))[0])
        shift = shift * pow(int(_BASE), len(part), 1 << 64) % (1 << 64)
    return _U(total % (1 << 64))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, in order of start, in blocks of BLOCK bytes, so memory follows the spans only."""
    out, i = np.empty(len(start), dtype=_U), 0
    with np.errstate(over="ignore"):
        while i < len(start):
            low = int(start[i])
            j = int(np.searchsorted(end, low + BLOCK, "right"))
            if j <= i:
                out[i] = _long_sum(buf[low : end[i]])
                j = i + 1
            else:
                out[i:j] = _sums(buf[low : end[j - 1]], start[i:j] - low, end[i:j] - low)
            i = j
        return mix(out + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _slabs(raw: list[bytes], limit: int):
    """Consecutive runs of texts of about limit bytes; a longer text is a run by itself."""
    i = 0
    while i < len(raw):
        j, n = i, 0
        while j < len(raw) and (j == i or n + len(raw[j]) < limit):
            n += len(raw[j]) + 1
            j += 1
        yield i, j
        i = j


def word_hashes(raw: list[bytes], limit: int = BLOCK):
    """Yields (index, hashes of the text's words in order) for every text, lower-casing A-Z."""
    for i, j in _slabs(raw, limit):
        buf = np.frombuffer(b" ".join(raw[i:j]).translate(ASCII_LOWER), dtype=np.uint8)
        start, end = word_spans(buf)
        hashes = hash_spans(buf, start, end)
        ends = np.cumsum([len(t) + 1 for t in raw[i:j]])
        cut = np.searchsorted(start, ends)
        low = 0
        for k, high in enumerate(cut.tolist()):
            yield i + k, hashes[low:high]
            low = high


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles of a word sequence as sorted hashes; a shorter sequence is one shingle."""
    if len(words) == 0:
        return words
    with np.errstate(over="ignore"):
        if len(words) < n:
            h = _U(len(words))
            for w in words:
                h = mix(np.array([h * _BASE + w], dtype=_U))[0]
            return np.array([h], dtype=_U)
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = h * _BASE + words[k : len(words) - n + 1 + k]
        return np.unique(mix(h))
