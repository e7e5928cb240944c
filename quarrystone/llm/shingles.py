"""Word shingles of a text as a set of 64-bit hashes, and PartEnum signatures of such sets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: Words of a shingle, and the similarity at least, as a fraction.
WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100
#: Parts of a partition of the feature domain, and how many of them may differ: subsets of one part less are enumerated.
SECOND, LEVEL = 3, 1
#: Words kept with their hashes by a worker; the table starts anew when full.
KEPT_WORDS = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_S = np.uint64(31)


class _Hashes(dict):
    def forget(self) -> None:
        self.clear()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


HASHES = _Hashes()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> _S)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles, ascending; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    total = h[:n].copy()
    for k in range(1, width):
        total = mix(total, k) + h[k : k + n]
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


@lru_cache(maxsize=4096)
def bands(size: int) -> tuple[tuple[int, int, int], ...]:
    """(tag, partitions of the first level, bad ones at most) for the size bands of a set.

    Bands are [2**i, 2**(i + 1)).  Two similar sets either share a band, or they lie on both sides
    of one band's upper bound, each within a factor 0.8 of it; those get a tag of the bound.  Similar
    sets of m and n elements differ in (m + n) / 9 elements at most.  The band's bound on that sets the
    number of partitions; the set's own, with any partner in the tag, how many of them can hold more
    than ``LEVEL`` differences.  No partitions stand for one signature of the whole set.
    """

    def differ(m: int, n: int) -> int:
        return (m + n) * (DENOMINATOR - NUMERATOR) // (NUMERATOR + DENOMINATOR)

    def tagged(tag: int, most: int, own: int) -> tuple[int, int, int]:
        bad = most // (LEVEL + 1)
        return (tag, bad + 1 + bad // 6 + min(bad, 2) if most else 0, min(most, own) // (LEVEL + 1))

    i = size.bit_length() - 1
    upper, largest = (2 << i) - 1, size * DENOMINATOR // NUMERATOR
    out = [tagged(2 * i, differ(upper, upper), differ(size, min(upper, largest)))]
    for j in range(max(0, i - 1), i + 1):
        bound = 2 << j
        most = differ(bound - 1, (bound - 1) * DENOMINATOR // NUMERATOR)
        if size < bound <= largest:
            out.append(tagged(2 * j + 1, most, differ(size, largest)))
        elif size >= bound and NUMERATOR * size <= DENOMINATOR * (bound - 1):
            out.append(tagged(2 * j + 1, most, differ(size, bound - 1)))
    return tuple(out)


def signatures(s: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """PartEnum signatures: for every tag the digests of enumerated subsets of the domain's partitions.

    The first level cuts the domain into partitions, of which some differ in ``LEVEL`` elements at
    most; the second cuts each of those into ``SECOND`` parts and takes all subsets of ``SECOND - LEVEL``
    parts, of which one then agrees.  A partition with elements in more than ``LEVEL`` parts has some in
    every subset; if more partitions are like that than can be bad, a similar set shares a subset that
    is not empty.  A set with fewer also gets the signatures of other cuts of the domain, round by
    round, until it has more; of two sets, the one that stops first shares one of its last round.

    Also returns (tag, need) for each tag: how many signatures of it every similar set shares.  So
    all but any need - 1 of them suffice.  The last byte of a signature is twice its tag, plus one
    beyond the first round.
    """
    out, needs = [], []
    for tag, parts, bad in bands(len(s)):
        if not parts:
            out.append((mix(s, tag + 1).sum(keepdims=True, dtype=np.uint64) & ~np.uint64(255)) | np.uint64(2 * tag))
            needs.append((tag, 1))
            continue
        turn = 0
        while True:
            h = mix(s, (tag + 1 << 16) + turn)
            cell = ((h >> np.uint64(32)) * np.uint64(parts * SECOND)) >> np.uint64(32)
            # A part's digest: the sum of its elements' hashes, salted by its number; 0 for none.
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            digest = np.zeros(parts * SECOND, np.uint64)
            digest[cell[first]] = mix(np.add.reduceat(h[order], first) ^ mix(cell[first], turn)) | np.uint64(1)
            digest = digest.reshape(parts, SECOND)
            full = (digest > 0).sum(1)
            subsets = digest.sum(1, keepdims=True) - digest
            held = full[:, None] - (digest > 0) > 0
            place = np.arange(parts * SECOND, dtype=np.uint64).reshape(parts, SECOND)
            out.append((mix(subsets[held] ^ mix(place[held], (tag << 8) + turn + 1)) & ~np.uint64(255)) | np.uint64(2 * tag + (turn > 0)))
            rich = int((full > LEVEL).sum())
            if rich > bad:
                needs.append((tag, 1 if turn else rich - bad))
                break
            turn += 1
    return np.concatenate(out), needs
