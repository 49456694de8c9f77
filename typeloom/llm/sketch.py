"""Word shingles and HyperMinHash sketches of one text, in numpy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import xxhash

#: Registers of a sketch; bits that pick one; mantissa bits that it keeps beside its count of leading zeros.
BITS = 8
REGISTERS = 1 << BITS
MANTISSA = 10
#: The chance that a pair just at the threshold shares no band is below this.
MISSED = 1e-6
MEMORY = 400_000
EMPTY = np.uint16(0xFFFF)


class Words(dict):
    """The hash of each word, worked out once; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


words_seen = Words()
_odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _odd[3]
    x = (x ^ (x >> np.uint64(27))) * _odd[4]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles: A-Z in lower case, words parted by ASCII white space. With fewer
    words the whole sequence is one shingle; without words there is none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64)
    h = np.fromiter(map(words_seen.__getitem__, words), np.uint64, n)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out = mixed(out * _odd[0] + _odd[1]) + h[j : n - k + 1 + j] * _odd[2]
    return np.unique(mixed(out))


def signature(found: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return blake2b(found.tobytes(), digest_size=16).digest()


def registers(found: np.ndarray) -> np.ndarray:
    """Of each bucket the least value, as its count of leading zeros and MANTISSA bits after the first one; EMPTY
    without values. The bucket is in the top bits, so the sorted hashes are in order of bucket and value."""
    out = np.full(REGISTERS, EMPTY)
    if len(found):
        bucket = (found >> np.uint64(64 - BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        v = found[first] << np.uint64(BITS)
        v = v | np.uint64(1 << (BITS - 1))
        zeros = 63 - np.floor(np.log2(v.astype(np.float64))).astype(np.int64)
        zeros = np.clip(zeros, 0, 56)
        # rounding up to a power of two may hide one leading zero
        zeros += ((v << zeros.astype(np.uint64)) >> np.uint64(63) == 0).astype(np.int64)
        mantissa = (v << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return out


def filled(sketches: np.ndarray) -> np.ndarray:
    """Each empty register of each row takes the next full one's value, around the end, with how far it was: so small
    sets fill their bands too."""
    rows, m = sketches.shape
    twice = np.concatenate([sketches, sketches], 1)
    at = np.where(twice != EMPTY, np.arange(2 * m), 2 * m)
    nxt = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :m]
    ok = nxt < 2 * m
    value = np.take_along_axis(twice, np.where(ok, nxt, 0), 1).astype(np.uint64)
    return np.where(ok, value | ((nxt - np.arange(m)).astype(np.uint64) << np.uint64(20)), np.uint64(0))


def band_length(threshold: float) -> int:
    """The most registers in a band with which a pair at the threshold is missed with a chance under MISSED."""
    fits = [r for r in range(1, 33) if (1 - threshold**r) ** (REGISTERS // r) < MISSED]
    return max(fits, default=1)


def band_keys(sketches: np.ndarray, band: int) -> np.ndarray:
    """The 64-bit keys of each row's bands of `band` registers."""
    full, bands = filled(sketches), REGISTERS // band
    h = np.zeros((len(sketches), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(band):
        h = mixed(h * _odd[0] + full[:, j : bands * band : band] + _odd[1])
    return h.view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of a and b, and the number of registers that they rest on.

    Of the registers that either side fills, those that agree are counted, less those expected to agree by chance:
    at least of n values in a bucket falls in a cell of width 2^-(zeros+1+MANTISSA), so two independent registers agree
    with a chance of about 2^-MANTISSA times a number near 1/2 that depends on the sizes little."""
    either = (a != EMPTY) | (b != EMPTY)
    agree = ((a == b) & (a != EMPTY)).sum(-1)
    used = np.maximum(1, either.sum(-1))
    chance = 0.5 * np.minimum(na, nb) / np.maximum(1, np.maximum(na, nb)) / (1 << MANTISSA)
    return (agree / used - chance) / (1 - chance), used
