"""Sets of hashed word shingles of whole texts, vectorised over the bytes of Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Words of a shingle.
WORDS = 5
#: Texts are hashed in runs of about so many bytes, which bounds the scratch memory to some 40 times that.
RUN_BYTES = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_C = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(n, _B), np.full(n, _B_INV)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _run(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of the texts that end at ``ends`` in ``data``."""
    none = np.empty(0, np.uint64)
    if not len(data):
        return [none] * len(ends)
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = np.concatenate([[0], ends[:-1]])
    at = begins[begins < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * power[:-1])])
    words = mixed((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * _C[0])
    stop = np.searchsorted(lo, ends)
    start = np.concatenate([[0], stop[:-1]])
    grams = none
    if len(words) >= WORDS:
        total = np.zeros(len(words) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            total += words[k : len(words) - WORDS + 1 + k] * _C[k]
        grams = mixed(total)
    out = []
    for i, j in zip(start.tolist(), stop.tolist(), strict=True):
        if j - i >= WORDS:
            out.append(np.unique(grams[i : j - WORDS + 1]))
        elif j > i:
            out.append(mixed((words[i:j] * _C[: j - i]).sum(keepdims=True) + np.uint64(j - i)))
        else:
            out.append(none)
    return out


def shingle_sets(texts) -> Iterator[np.ndarray]:
    """For each text of an Arrow string array, the sorted distinct hashes of its shingles of five words.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text with fewer than five
    words has one shingle, all of them; one without words, and null, has none.
    """
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + RUN_BYTES, "right")) - 1)
        yield from _run(raw[bounds[i] : bounds[j]], bounds[i + 1 : j + 1] - bounds[i])
        i = j


def fingerprint(hashes: np.ndarray, taken: frozenset = frozenset()) -> int:
    """A signed 64-bit hash of a set: half of a 128-bit one, the other half if the first is in ``taken``."""
    first, second = halves(hashes)
    return second if first in taken else first


def halves(hashes: np.ndarray) -> tuple[int, int]:
    """The two signed 64-bit halves of a set's hash."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
