"""Word shingles, MinHash bands and exact set similarity, as small functions for tasks."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
KNOWN_WORDS = 50_000


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs without space, tab, newline, VT, FF or CR."""
    return (text or "").encode().lower().split()


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ h >> np.uint64(33)


class _Known(dict):
    """Hashes of words by word; forgets all when it is full, and long words at once."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = found
        return found


_KNOWN = _Known()


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, in order."""
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of ``words_of(text)``, in order."""
    return hashes_of(words_of(text))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position; a shorter sequence is one shingle of its own length."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = h * _FACTOR + words[i : n - size + 1 + i]
        h ^= h >> np.uint64(29)
    return mix64(h)


def shingles_of(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` of many texts whose words stand in a row, ``counts`` of each, and how many each has."""
    sizes = np.where(counts < k, np.minimum(counts, 1), counts - k + 1)
    starts, first = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    if not len(words):
        return words, sizes
    whole = shingle_hashes(words, k)
    found = whole[np.minimum(np.arange(sizes.sum()) + np.repeat(starts - first, sizes), len(whole) - 1)]
    for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        found[first[i]] = shingle_hashes(words[starts[i] : starts[i] + counts[i]], k)[0]
    return found, sizes


def distinct(values: np.ndarray) -> np.ndarray:
    """``np.unique`` of a short array, without its checks."""
    found = np.sort(values)
    new = found[1:] != found[:-1]
    return found if new.all() else found[np.concatenate([[True], new])]


def fold(columns: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit key of each row."""
    key = np.full(len(columns), salt, np.uint64)
    for column in columns.T:
        key = mix64(key * _FACTOR + column.astype(np.uint64))
    return key


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per band of a signature, as signed numbers; keys of different bands differ."""
    table = np.concatenate([np.arange(bands, dtype=np.uint64)[:, None], signature.astype(np.uint64).reshape(bands, rows)], axis=1)
    return fold(table, 17).astype(np.int64)


def band_keys_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of many signatures at once, equal to ``band_keys`` of each."""
    table = np.empty((len(signatures), bands, rows + 1), np.uint64)
    table[:, :, 0] = np.arange(bands)
    table[:, :, 1:] = signatures.reshape(len(signatures), bands, rows)
    return fold(table.reshape(-1, rows + 1), 17).astype(np.int64).reshape(len(signatures), bands)


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Fewest bands of ``rows`` coordinates that find a pair of that similarity with that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def shingle_set(text: str | None, k: int) -> frozenset:
    """The set of distinct shingles themselves, for exact comparison."""
    words = words_of(text)
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*[words[i:] for i in range(k)]))


class SetCache:
    """The last few shingle sets; pairs arrive sorted, so one side repeats."""

    def __init__(self, k: int, size: int = 64):
        self.k, self.size, self.kept = k, size, OrderedDict()

    def __call__(self, node: object, text: str) -> frozenset:
        found = self.kept.get(node)
        if found is None:
            found = self.kept[node] = shingle_set(text, self.k)
            if len(self.kept) > self.size:
                self.kept.popitem(last=False)
        else:
            self.kept.move_to_end(node)
        return found


def similar(a: frozenset, b: frozenset, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; sets without members are like nothing."""
    small, large = sorted((len(a), len(b)))
    if small == 0 or 100 * small < percent * large:
        return False
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)
