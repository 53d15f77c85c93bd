"""Sets of hashed word shingles of whole texts, vectorised over the bytes of a batch."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; what is held beside them is some hundred bytes a word.
SLICE = 1 << 18
#: Bytes from which on a word is hashed on its own.
LONG = 256
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_ASCII_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16, 2 * len(have) if have is not None else 0), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S33)) * _C1
    h = (h ^ (h >> _S29)) * _C2
    return h ^ (h >> _S33)


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of texts that lie one after another in ``data`` (lower-cased A-Z).

    Words are runs of bytes for which ``word`` is true; without it, runs without white space. Polynomials modulo 2**64 are told
    apart safely while short; words over ``LONG`` bytes have a cryptographic hash.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if word is None:
        word = ~_BLANK[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text's first byte follows nothing
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    terms = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n)
    total = np.cumsum(terms, dtype=np.uint64)
    h = (total[e] - total[s] + terms[s]) * _power("down", _INVERSE, n)[s]
    h = _mix(h + (e - s).astype(np.uint64) * _C1)
    for i in np.flatnonzero(e - s >= LONG):
        h[i] = int.from_bytes(hashlib.blake2b(_LOWER[data[s[i] : e[i] + 1]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(offsets, s, "right") - 1


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to words: ASCII letters and digits, and other characters but typographic punctuation."""
    word = _ASCII_WORD[data]
    n = len(data)
    for lead, length, first, last in ((0xC2, 2, 0xA0, 0xBF), (0xE2, 3, 0x80, 0x81), (0xE3, 3, 0x80, 0x80)):  # U+00A0-00BF, U+2000-207F, U+3000-303F
        at = np.flatnonzero(data == lead)
        at = at[at + length <= n]
        at = at[(data[at + 1] >= first) & (data[at + 1] <= last)]
        if lead == 0xC2:
            at = at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]  # letters among them
        for k in range(length):
            word[at + k] = False
    return word


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 text with the capitals of Latin-1, Greek and Cyrillic in lower case (A-Z are folded by ``word_hashes``)."""
    data = data.copy()
    end = len(data) - 1
    # lead byte, first and last second byte of the capitals, steps of both bytes to the small letters
    for lead, first, last, up, step in ((0xC3, 0x80, 0x9E, 0, 32), (0xCE, 0x91, 0x9F, 0, 32), (0xCE, 0xA0, 0xAB, 1, -32), (0xD0, 0x90, 0x9F, 0, 32), (0xD0, 0xA0, 0xAF, 1, -32), (0xD0, 0x80, 0x8F, 1, 16)):
        at = np.flatnonzero(data == lead)
        at = at[at < end]
        second = data[at + 1]
        at = at[(second >= first) & (second <= last) & ~((lead == 0xC3) & (second == 0x97))]  # a multiplication sign is no letter
        data[at] += np.uint8(up)
        data[at + 1] = (data[at + 1].astype(np.int64) + step).astype(np.uint8)
    return data


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and where each text begins (and the last ends)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.empty(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray):
    """(first, end) of runs of texts of about ``SLICE`` bytes, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1))
        yield lo, hi
        lo = hi


def shingle_sets(texts: pa.Array, width: int):
    """For each text its sorted distinct shingle hashes (unsigned order).

    A text of fewer than ``width`` words has its whole sequence as one shingle; one without words has none.
    """
    n = len(texts)
    if n == 0:
        return
    data, offsets = text_bytes(texts)
    multipliers = [_mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(width)]
    for lo, hi in slices(offsets):
        h, owner = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo])
        counts = np.bincount(owner, minlength=hi - lo)
        starts = np.cumsum(counts) - counts
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k, m in enumerate(multipliers):
            rolled += h[k : k + len(rolled)] * m
        rolled = _mix(rolled)
        for i, (a, c) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
            if c >= width:
                yield np.unique(rolled[a : a + c - width + 1])
            elif c:
                yield _mix(np.array([sum((int(x) * int(m)) for x, m in zip(h[a : a + c], multipliers, strict=False)) + c & (1 << 64) - 1], np.uint64))
            else:
                yield h[:0]


def fingerprint(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
